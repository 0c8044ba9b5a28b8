"""An event's metrics in one pass: a first aggregate per key and group (if any metric asks for it), a second over groups.

Whatever can be added up per group (counts, sums, extremes, averages as sum and count) shares these two hash aggregates,
which combine map-side. Only percentiles and distinct counts of a property need aggregates of their own."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..catalog import DECIMAL, Catalog
from ..functions.buckets import bucket, floor
from ..functions.predicates import time_column
from ..model import ActiveGroups, Agg, AggregateProperty, AggregatePropertyPerGroup, CountEvents, CountPerGroup, CountUniqueGroups, CustomMetric, Formula, Metric, TimeRange, Unit

SIMPLE = ("count", "sum", "min", "max", "avg")


def plain(agg: str, c: Column, times: Column | None = None) -> Column:
    """The aggregate of a column; times: by sketches if 0, else how often a row's value stands."""
    if agg in SIMPLE:
        return getattr(F, agg)(c)
    if agg == "distinct_count":
        return F.countDistinct(c) if times is not None else F.approx_count_distinct(c)
    share = 0.5 if agg == "median" else int(agg[1:]) / 100
    return F.percentile(c, share, times) if times is not None else F.percentile_approx(c, share)


def label(m: Metric) -> str:
    """The metric's name in a result."""
    match m:
        case CountEvents():
            return "Count Events"
        case CountUniqueGroups():
            return "Count Unique Groups"
        case ActiveGroups():
            return f"{'Weekly' if m.days == 7 else 'Monthly'} Active Groups"
        case CountPerGroup():
            return f"{m.outer.capitalize()} Count Per Group"
        case AggregateProperty():
            return f"{m.agg.capitalize()} {m.prop}"
        case AggregatePropertyPerGroup():
            return f"{m.outer.capitalize()} of {m.inner.capitalize()} {m.prop} Per Group"
        case Formula():
            return m.text
        case CustomMetric():
            return m.name


def _returns(agg: str, kind: str) -> str:
    """The type of an aggregate of a property of this type."""
    if agg in ("count", "distinct_count"):
        return "bigint"
    if agg in ("min", "max"):
        return kind
    if agg == "sum":
        return "bigint" if kind in ("tinyint", "smallint", "int") else kind if kind in ("double", "float") else DECIMAL.simpleString()
    return "double"


def result_type(m: Metric, types: dict[str, str], catalog: Catalog) -> str:
    """The type of a metric's values, from the types of the events' columns."""
    match m:
        case CountEvents() | CountUniqueGroups() | ActiveGroups():
            return "bigint"
        case CountPerGroup():
            return _returns(m.outer, "bigint")
        case AggregateProperty():
            return _returns(m.agg, types[catalog.column(m.prop)])
        case AggregatePropertyPerGroup():
            return _returns(m.outer, _returns(m.inner, types[catalog.column(m.prop)]))
    return "double"


def active_groups(df: DataFrame, keys: Sequence[str], group: str, days: int, unit: Unit, time: TimeRange) -> DataFrame:
    """keys, bucket, metric: groups active in the `days` days that end with each bucket's first day; only buckets of the range
    whose window holds activity. df also has to hold the days - 1 days before the range, as history() has them. Each active day
    of a group goes to the buckets it counts for before the distinct count."""
    active = df.where(F.col(group).isNotNull()).select(*keys, group, F.to_date("created_at").alias("_day")).distinct()
    step = F.expr({"hour": "interval 1 day", "day": "interval 1 day", "week": "interval 7 day", "month": "interval 1 month", "year": "interval 1 year"}[unit])
    coarse = "day" if unit == "hour" else unit
    first = F.to_date(bucket(F.col("_day"), coarse))
    last = F.to_date(bucket(F.date_add("_day", days - 1), coarse))
    spread = active.withColumn("_b", F.explode(F.sequence(first, last, step))).where(F.col("_b") >= F.col("_day"))
    if time.start is not None:
        spread = spread.where(F.col("_b") >= F.lit(floor(time.start, coarse).date()))
    if time.end is not None:
        spread = spread.where(F.col("_b") <= F.lit(time.end.date()))
    return spread.groupBy(*keys, F.col("_b").cast("timestamp_ntz").alias("bucket")).agg(F.countDistinct(group).alias("metric"))


def history(time: TimeRange, unit: Unit, metrics: Sequence[Metric]) -> TimeRange:
    """The range whose rows these metrics need: trailing ones look back from the range's first bucket."""
    days = max((m.days for m in metrics if isinstance(m, ActiveGroups)), default=0)
    if not days or time.start is None:
        return time
    return TimeRange(floor(time.start, "day" if unit == "hour" else unit) - timedelta(days=days - 1), time.end)


def aggregate(df: DataFrame, metrics: Sequence[Metric], keys: Sequence[str], group: str, unit: Unit, catalog: Catalog, time: TimeRange = TimeRange()) -> DataFrame:
    """df's rows by bucket and keys: one row each, columns bucket, keys, m0, m1, ... of the metrics.

    Nulls are skipped; rows without a group count for no per-group metric. df holds the rows of history(time, ...); all but
    the trailing metrics see those of time alone. Values come in two levels, how often each stands and then their percentiles,
    so that a hot key's rows meet as counts of distinct values."""
    base = df.where(time_column(time)).withColumn("bucket", bucket(F.col("created_at"), unit))
    by = ["bucket", *keys]
    inner: dict[str, Column] = {"_n": F.count("event")}
    outer: dict[str, Column] = {}
    own: dict[str, AggregateProperty] = {}
    later: dict[str, Formula] = {}
    trailing: dict[str, ActiveGroups] = {}
    extra: dict[str, CustomMetric] = {}
    has = F.col(f"`{group}`").isNotNull()

    def part(agg: Agg, prop: str) -> str:
        name = f"_{agg}_{prop}"
        inner[name] = getattr(F, agg)(F.col(f"`{catalog.column(prop)}`"))
        return f"`{name}`"

    for i, m in enumerate(metrics):
        name = f"m{i}"
        match m:
            case CountEvents():
                outer[name] = F.sum("_n")
            case CountUniqueGroups():
                outer[name] = (F.approx_count_distinct if m.approximate else F.count)(F.when(has, F.col(f"`{group}`")))
            case ActiveGroups():
                trailing[name] = m
            case CountPerGroup():
                outer[name] = getattr(F, m.outer)(F.when(has, F.col("_n")))
            case AggregatePropertyPerGroup():
                outer[name] = getattr(F, m.outer)(F.when(has, F.col(part(m.inner, m.prop))))
            case AggregateProperty(agg="avg"):
                outer[name] = F.sum(F.col(part("sum", m.prop))) / F.sum(F.col(part("count", m.prop)))
            case AggregateProperty(agg="count"):
                outer[name] = F.sum(F.col(part("count", m.prop)))
            case AggregateProperty() if m.agg in SIMPLE:
                outer[name] = getattr(F, m.agg)(F.col(part(m.agg, m.prop)))
            case AggregateProperty():
                own[name] = m
            case Formula():
                later[name] = m
            case CustomMetric():
                extra[name] = m
    out = None
    if outer or later:
        per_group = any(isinstance(m, CountUniqueGroups | CountPerGroup | AggregatePropertyPerGroup) for m in metrics)
        # Without a per-group metric the first aggregate is by key alone, and the second needs no further exchange.
        out = base.groupBy(*by, *([group] if per_group else [])).agg(*[c.alias(n) for n, c in inner.items()]).groupBy(*by).agg(*[c.alias(n) for n, c in outer.items()] or [F.sum("_n").alias("_n")])
    sides = [base.groupBy(*by).agg(*[F.expr(m.sql).alias(n) for n, m in extra.items()])] if extra else []
    sketched = {n: m for n, m in own.items() if m.approximate}
    if sketched:
        sides.append(base.groupBy(*by).agg(*[plain(m.agg, F.col(f"`{catalog.column(m.prop)}`")).alias(n) for n, m in sketched.items()]))
    for prop in dict.fromkeys(m.prop for n, m in own.items() if n not in sketched):
        counted = base.groupBy(*by, F.col(f"`{catalog.column(prop)}`").alias("_value")).agg(F.count(F.lit(1)).alias("_times"))
        sides.append(counted.groupBy(*by).agg(*[plain(m.agg, F.col("_value"), F.col("_times")).alias(n) for n, m in own.items() if m.prop == prop and n not in sketched]))
    sides += [active_groups(df, keys, group, m.days, unit, time).withColumnRenamed("metric", n) for n, m in trailing.items()]
    for side in sides:  # a row per bucket and key: the joined tables are results
        if out is None:
            out = side
            continue
        renamed = side.select(*[F.col(k).alias(f"_r_{k}") for k in by], *[c for c in side.columns if c not in by])
        on = [out[k].eqNullSafe(renamed[f"_r_{k}"]) for k in by]
        out = out.join(renamed, on, "full").select(*[F.coalesce(k, f"_r_{k}").alias(k) for k in by], *[c for c in (*out.columns, *side.columns) if c not in by])
    for name, m in later.items():
        out = out.withColumn(name, F.expr(m.text))
    return out.select(*by, *[f"m{i}" for i in range(len(metrics))])
