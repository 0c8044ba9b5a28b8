"""Segments: which groups (users) meet conditions on what they did and have.

All conditions on events are aggregates of one groupBy; a profile condition joins the latest profiles."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..catalog import Catalog
from ..functions.buckets import bucket, bucket_list, instant
from ..functions.predicates import all_of, any_of, compare, condition, event_column, time_column
from ..model import (
    DidEventAfterFirstUse, DidEventAggregate, DidEventCount, DidEventEach, DidEventRelative, HadPropertyValue, HasPropertyValue, Segment, SegmentCondition
)


def _aggregates(c: SegmentCondition, catalog: Catalog) -> tuple[list[Column], object]:
    """What to aggregate per group, and how to make the condition of these aggregates."""
    count = lambda p: F.count_if(F.coalesce(p, F.lit(False)))
    match c:
        case DidEventCount():
            return [count(event_column(c.event, catalog) & time_column(c.time))], lambda n: compare(n, c.op, c.value)
        case DidEventAggregate():
            seen = F.when(event_column(c.event, catalog) & time_column(c.time), F.col(f"`{catalog.column(c.prop)}`"))
            return [getattr(F, c.agg)(seen)], lambda v: compare(v, c.op, c.value)
        case DidEventRelative():
            when = time_column(c.time)
            return [count(event_column(c.event, catalog) & when), count(event_column(c.other, catalog) & when)], lambda a, b: compare(a, c.op, b)
        case DidEventEach():
            when, at = event_column(c.event, catalog) & time_column(c.time), bucket(F.col("created_at"), c.unit)
            slots = [count(when & (at == instant(t))) for t in bucket_list(c.time, c.unit)]
            return slots, lambda *n: all_of(compare(x, c.op, c.value) for x in n)
        case DidEventAfterFirstUse():
            limit = F.col("_first_use") + F.make_dt_interval(secs=F.lit(c.within.total_seconds()))
            return [count(event_column(c.event, catalog) & (F.col("created_at") <= limit))], lambda n: compare(n, c.op, c.value)
        case HadPropertyValue():
            return [count(condition(c.filter, catalog) & time_column(c.time))], lambda n: n >= 1
    raise TypeError(c)


def _tested(events: DataFrame, wanted: Sequence[Segment], group: str, catalog: Catalog, profiles: DataFrame | None) -> tuple[DataFrame, list[Column]]:
    """A row per group that has events, and each segment's condition on it. All come from one aggregate (two with a first use)."""
    base = events.where(F.col(group).isNotNull())
    flat = [c for s in wanted for alternative in s.any_of for c in alternative]
    if any(isinstance(c, DidEventAfterFirstUse) for c in flat):
        first = base.groupBy(group).agg(F.min("created_at").alias("_first_use"))
        base = base.join(first, group)
    parts: list[Column] = []
    tests: dict[int, Column] = {}
    for i, c in enumerate(flat):
        if isinstance(c, HasPropertyValue):
            continue
        columns, made = _aggregates(c, catalog)
        names = [f"_a{len(parts) + k}" for k in range(len(columns))]
        parts += [x.alias(n) for x, n in zip(columns, names, strict=True)]
        tests[i] = F.coalesce(made(*map(F.col, names)), F.lit(False))
    found = base.groupBy(group).agg(*parts) if parts else base.select(group).distinct()
    if any(isinstance(c, HasPropertyValue) for c in flat):
        if profiles is None:
            raise ValueError("a segment on profile values needs profiles")
        flags = []
        for i, c in enumerate(flat):
            if isinstance(c, HasPropertyValue):
                flags.append(F.coalesce(condition(c.filter, catalog), F.lit(False)).alias(f"_p{i}"))
                tests[i] = F.coalesce(F.col(f"_p{i}"), F.lit(False))
        found = found.join(profiles.select(F.col("id").alias(group), *flags), group, "left")
    out, at = [], 0
    for s in wanted:
        where = []
        for alternative in s.any_of:
            where.append(all_of(tests[at + k] for k in range(len(alternative))))
            at += len(alternative)
        out.append(any_of(where))
    return found, out


def members(events: DataFrame, segment: Segment, group: str, catalog: Catalog, profiles: DataFrame | None = None) -> DataFrame:
    """(group): the ids that meet the segment. Null ids are in none. profiles: latest rows, with the id in column id."""
    found, (test,) = _tested(events, [segment], group, catalog, profiles)
    return found.where(test).select(group)


def memberships(events: DataFrame, wanted: Sequence[Segment], group: str, catalog: Catalog, profiles: DataFrame | None = None, name: str = "segment") -> DataFrame:
    """(group, name): a row for each segment that an id meets, from one scan of the events for all segments."""
    found, tests = _tested(events, wanted, group, catalog, profiles)
    met = F.filter(F.array(*[F.when(t, F.lit(s.name)) for s, t in zip(wanted, tests, strict=True)]), lambda x: x.isNotNull())
    return found.select(group, F.explode(met).alias(name))
