"""Event segmentation: per event and segment one aggregation over one scan, then shaping."""

from __future__ import annotations

from dataclasses import replace
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..catalog import DECIMAL, Catalog
from ..functions.buckets import bucket_list, moved
from ..functions.predicates import conditions, event_column, time_column
from ..model import Segmentation, TimeRange
from ..operators import metrics, segments, shaping


def wide(r: Segmentation, events: DataFrame, catalog: Catalog, profiles: DataFrame | None = None) -> list[DataFrame]:
    """For each event: segment, bucket, its and the request's breakdowns, m0, m1, ..."""
    catalog.validate_segmentation(r, events.columns)
    mine, out = events.where((F.col("project_id") == r.project_id) & conditions(r.filters, catalog)), []
    who = None
    if r.segments:  # ids may be many: Spark broadcasts them only below its size limit
        who = segments.memberships(events.where(F.col("project_id") == r.project_id), r.segments, r.group, catalog, profiles, "_segment")
    for q in r.events:
        keys = [*dict.fromkeys((*q.breakdowns, *r.breakdowns))]
        scope = time_column(metrics.history(r.time, r.unit, q.metrics))
        rows = mine.where(scope & event_column(q.event, catalog)).withColumns({k: F.col(f"`{catalog.column(k)}`") for k in keys})
        if who is None:
            found = metrics.aggregate(rows, q.metrics, keys, r.group, r.unit, catalog, r.time)
            out.append(shaping.add_string(found, "segment", "all"))
            continue
        found = metrics.aggregate(rows.join(who, r.group), q.metrics, ["_segment", *keys], r.group, r.unit, catalog, r.time)
        out.append(found.select(F.col("_segment").alias("segment"), *[f"`{c}`" for c in found.columns if c != "_segment"]))
    return out


def typed(r: Segmentation, events: DataFrame, catalog: Catalog, profiles: DataFrame | None = None) -> list[tuple[str, DataFrame]]:
    """For each event its name and wide rows under the metrics' names, with types of their own: counts are long, averages and
    formulas double, sums of whole numbers long and of decimals decimal, extremes of their property's type."""
    out = []
    for q, df in zip(r.events, wide(r, events, catalog, profiles), strict=True):
        kind = {f"m{i}": metrics.result_type(m, dict(events.dtypes), catalog) for i, m in enumerate(q.metrics)}
        names = {f"m{i}": metrics.label(m) for i, m in enumerate(q.metrics)}
        out.append((q.label or q.event.name, df.select(*[F.col(f"`{c}`").cast(kind[c]).alias(names[c]) if c in kind else F.col(f"`{c}`") for c in df.columns])))
    return out


def compact(r: Segmentation, events: DataFrame, catalog: Catalog, profiles: DataFrame | None = None) -> DataFrame:
    """event, segment, bucket, breakdowns, agg_name, value: one row per number, before any charting. A comparison is the same
    request over the time before."""
    parts = []
    for q, df in zip(r.events, wide(r, events, catalog, profiles), strict=True):
        names = {f"m{i}": metrics.label(m) for i, m in enumerate(q.metrics)}
        long = shaping.rename_rows(shaping.unpivot(df, list(names)), "agg_name", names)
        parts.append((q.label or q.event.name, long))
    out = shaping.append(parts)
    series = [c for c in out.columns if c not in ("bucket", "value")]
    if r.analysis != "linear":
        all_buckets = bucket_list(r.time, r.unit) if r.analysis != "logarithmic" else []
        out = shaping.analyse(out, r.analysis, "value", series, all_buckets, r.window).withColumn("value", F.col("value").cast(DECIMAL))
    if r.compare is not None:
        n, unit = r.compare
        earlier = replace(r, compare=None, time=TimeRange(moved(r.time.start, -n, unit), moved(r.time.end, -n, unit)))
        out = shaping.compare(out, compact(earlier, events, catalog, profiles), "value", series, n, unit, r.unit)
    return out


def chart(r: Segmentation, events: DataFrame, catalog: Catalog, profiles: DataFrame | None = None, limit: int = 50) -> DataFrame:
    """A row per event, segment, breakdown values and metric; columns Average and a bucket each, greatest average first.

    Of each event, rows beyond the first `limit` of a value of its own breakdowns are left out."""
    parts = []
    for q in r.events:
        long = compact(replace(r, events=(q,)), events, catalog, profiles)
        dims = [c for c in long.columns if c not in ("bucket", "value", "compare_value")]
        by_time = shaping.pivot_time(long.drop("compare_value"), r.time, r.unit)
        out = shaping.average_and_sort(by_time.select(*dims, *[c for c in by_time.columns if c not in dims]), len(dims))
        order = [F.desc_nulls_last("Average"), *[F.col(d) for d in dims]]
        parts.append(shaping.limit_groups(out, [c for c in dims if c not in ("event", "segment", "agg_name")], order, limit))
    capped = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    breakdowns = [*dict.fromkeys(k for q in r.events for k in (*q.breakdowns, *r.breakdowns))]
    named = shaping.rename(shaping.reorder(capped, ["event", "segment", *breakdowns, "agg_name", "Average"]), {"event": "Event", "segment": "Segment", "agg_name": "Formula"})
    return named.orderBy(F.desc_nulls_last("Average"))


def roles(df: DataFrame, r: Segmentation) -> dict[str, str]:
    """Which columns of a chart are dimensions and which are metrics; "metricValue" are the buckets."""
    dims = {"Event", "Segment", "Formula", *(k for q in r.events for k in (*q.breakdowns, *r.breakdowns))}
    return {c: "dimension" if c in dims else "metric" if c == "Average" else "metricValue" for c in df.columns}


def shares(r: Segmentation, events: DataFrame, catalog: Catalog, profiles: DataFrame | None = None) -> DataFrame:
    """For a pie: event, segment, breakdowns, agg_name, value over the whole range, and its share of the metric's sum."""
    whole = replace(r, unit="year", analysis="linear", compare=None)
    long = compact(whole, events, catalog, profiles)
    dims = [c for c in long.columns if c not in ("bucket", "value")]
    total = long.groupBy(*dims).agg(F.sum("value").cast("double").alias("value"))
    return total.withColumn("share", F.col("value") / F.sum("value").over(Window.partitionBy("event", "segment", "agg_name")))


def shown(r: Segmentation, events: DataFrame, catalog: Catalog, profiles: DataFrame | None = None) -> DataFrame:
    """The result as its chart_type wants it: lines and columns by bucket, a pie by share."""
    return shares(r, events, catalog, profiles) if r.chart_type == "pie" else chart(r, events, catalog, profiles)
