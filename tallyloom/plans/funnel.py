"""Funnel reports."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..catalog import Catalog
from ..model import Funnel
from ..operators import funnel as op


def funnel(f: Funnel, events: DataFrame, catalog: Catalog, bin_ms: int = 3_600_000) -> DataFrame:
    catalog.validate_funnel(f, events.columns)
    found = op.attempts(events, f, catalog)
    if f.chart == "frequency":
        return op.frequency(found, f)
    if f.chart == "time_to_convert":
        return op.histogram(found, f, bin_ms)
    return op.report(found, f)
