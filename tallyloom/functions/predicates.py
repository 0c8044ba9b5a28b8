"""Conditions as boolean Columns, so that Catalyst pushes them into the scan."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from datetime import datetime
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..catalog import Catalog
from ..model import Condition, EventRef, Filter, FilterGroup, TimeRange
from .buckets import instant

_COMPARE: dict[str, Callable[[Column, object], Column]] = {
    "neq": lambda c, v: c != v, "gt": lambda c, v: c > v, "gte": lambda c, v: c >= v, "lt": lambda c, v: c < v, "lte": lambda c, v: c <= v,
    "regex": lambda c, v: c.rlike(v), "not_regex": lambda c, v: ~c.rlike(v), "like": lambda c, v: c.like(v), "not_like": lambda c, v: ~c.like(v),
}
NEGATED = ("neq", "not_regex", "not_like")


def all_of(parts: Iterable[Column]) -> Column:
    return reduce(and_, parts, F.lit(True))


def any_of(parts: Iterable[Column]) -> Column:
    parts = list(parts)
    return reduce(or_, parts) if parts else F.lit(False)


def compare(left: Column, op: str, value: object) -> Column:
    return left == value if op == "eq" else _COMPARE[op](left, value)


def filter_column(f: Filter, catalog: Catalog) -> Column:
    """values are alternatives, also under negation, unless the filter asks for strict negation."""
    c = F.col(f"`{catalog.column(f.prop)}`")
    if f.op == "true":
        return c.eqNullSafe(True)
    if f.op == "false":
        return c.eqNullSafe(False)
    if f.op == "empty":
        return c.isNull()
    if f.op == "exists":
        return c.isNotNull()
    values = [instant(v) if isinstance(v, datetime) else v for v in f.values]
    if f.op == "eq":
        return c.isin(*values) if len(values) > 1 else c == values[0]
    parts = [_COMPARE[f.op](c, v) for v in values]
    return all_of(parts) if f.strict_negation and f.op in NEGATED else any_of(parts)


def condition(c: Condition, catalog: Catalog) -> Column:
    if isinstance(c, FilterGroup):
        return (all_of if c.how == "and" else any_of)(condition(x, catalog) for x in c.parts)
    return filter_column(c, catalog)


def conditions(cs: Iterable[Condition], catalog: Catalog) -> Column:
    return all_of(condition(c, catalog) for c in cs)


def event_column(e: EventRef, catalog: Catalog) -> Column:
    own = any_of(event_column(x, catalog) for x in catalog.custom_events[e.name].events) if e.custom else F.col("event") == e.name
    return own & conditions(e.filters, catalog) if e.filters else own


def time_column(t: TimeRange, column: str = "created_at") -> Column:
    parts = []
    if t.start is not None:
        parts.append(F.col(column) >= instant(t.start))
    if t.end is not None:
        parts.append(F.col(column) <= instant(t.end))
    return all_of(parts)
