"""Requests: what to filter, group, count and how to show it. Plain data; plans/ turns them into DataFrames."""

from __future__ import annotations

from dataclasses import dataclass, field
from datetime import datetime, timedelta
from typing import Any, Literal

Unit = Literal["hour", "day", "week", "month", "year"]
MAX_GROUPS = 5


@dataclass(frozen=True)
class TimeRange:
    """Both ends inclusive; an open end is None. last: so many units back from now, by the calendar."""

    start: datetime | None = None
    end: datetime | None = None

    @staticmethod
    def last(n: int, unit: Unit, now: datetime) -> TimeRange:
        if unit in ("hour", "day", "week"):
            return TimeRange(now - timedelta(**{f"{unit}s": n}), now)
        months = now.year * 12 + now.month - 1 - n * (12 if unit == "year" else 1)
        year, month = divmod(months, 12)
        month += 1
        days = [31, 29 if year % 4 == 0 and (year % 100 or year % 400 == 0) else 28, 31, 30, 31, 30, 31, 31, 30, 31, 30, 31][month - 1]
        return TimeRange(now.replace(year=year, month=month, day=min(now.day, days)), now)


Op = Literal["eq", "neq", "gt", "gte", "lt", "lte", "regex", "not_regex", "like", "not_like", "true", "false", "empty", "exists"]
#: Operations that take no value.
VALUELESS = ("true", "false", "empty", "exists")


@dataclass(frozen=True)
class Filter:
    """values are alternatives (or), also for the negated operations unless strict_negation is set (then: and)."""

    prop: str
    op: Op
    values: tuple[Any, ...] = ()
    strict_negation: bool = False


@dataclass(frozen=True)
class FilterGroup:
    """Filters or further groups, joined by all of ("and") or any of ("or") them."""

    how: Literal["and", "or"]
    parts: tuple[Filter | FilterGroup, ...]


Condition = Filter | FilterGroup


@dataclass(frozen=True)
class EventRef:
    """An event by name, or a custom event of the catalog, with filters of its own."""

    name: str
    filters: tuple[Condition, ...] = ()
    custom: bool = False


Agg = Literal["count", "sum", "min", "max", "avg"]
WideAgg = Literal["count", "sum", "min", "max", "avg", "median", "distinct_count", "p25", "p75", "p90", "p99"]


@dataclass(frozen=True)
class CountEvents:
    pass


@dataclass(frozen=True)
class CountUniqueGroups:
    """Also stands for daily active groups, which count by the request's interval."""

    approximate: bool = False


@dataclass(frozen=True)
class ActiveGroups:
    """Groups active in the trailing 7 or 30 days of each bucket's first day."""

    days: Literal[7, 30]


@dataclass(frozen=True)
class CountPerGroup:
    outer: Agg


@dataclass(frozen=True)
class AggregateProperty:
    """approximate: medians, percentiles and distinct counts by sketches of bounded size."""

    prop: str
    agg: WideAgg
    approximate: bool = False


@dataclass(frozen=True)
class AggregatePropertyPerGroup:
    prop: str
    inner: Agg
    outer: Agg


@dataclass(frozen=True)
class Formula:
    """An SQL expression over the event's other metrics, named m0, m1, ... in their order."""

    text: str


@dataclass(frozen=True)
class CustomMetric:
    """A metric of one's own: sql is an aggregate expression over the event's rows, by the table's columns."""

    name: str
    sql: str


Metric = CustomMetric | CountEvents | CountUniqueGroups | ActiveGroups | CountPerGroup | AggregateProperty | AggregatePropertyPerGroup | Formula


@dataclass(frozen=True)
class EventQuery:
    event: EventRef
    metrics: tuple[Metric, ...]
    breakdowns: tuple[str, ...] = ()
    label: str | None = None


# Segments: what users did or have.


@dataclass(frozen=True)
class DidEventCount:
    event: EventRef
    op: Op
    value: int
    time: TimeRange = TimeRange()


@dataclass(frozen=True)
class DidEventAggregate:
    event: EventRef
    prop: str
    agg: Agg
    op: Op
    value: float
    time: TimeRange = TimeRange()


@dataclass(frozen=True)
class DidEventRelative:
    """More (or fewer, ...) of one event than of another."""

    event: EventRef
    op: Op
    other: EventRef
    time: TimeRange = TimeRange()


@dataclass(frozen=True)
class DidEventEach:
    """The count condition holds in each bucket of unit that the time range covers."""

    event: EventRef
    op: Op
    value: int
    unit: Unit
    time: TimeRange


@dataclass(frozen=True)
class DidEventAfterFirstUse:
    """Counts only the given time after the user's first event of any kind."""

    event: EventRef
    op: Op
    value: int
    within: timedelta


@dataclass(frozen=True)
class HadPropertyValue:
    """Some event in the time range had the value."""

    filter: Filter
    time: TimeRange = TimeRange()


@dataclass(frozen=True)
class HasPropertyValue:
    """The latest profile has the value."""

    filter: Filter


SegmentCondition = DidEventCount | DidEventAggregate | DidEventRelative | DidEventEach | DidEventAfterFirstUse | HadPropertyValue | HasPropertyValue


@dataclass(frozen=True)
class Segment:
    """Any of the alternatives, each of which is all of its conditions."""

    name: str
    any_of: tuple[tuple[SegmentCondition, ...], ...]


@dataclass(frozen=True)
class Segmentation:
    time: TimeRange
    unit: Unit
    events: tuple[EventQuery, ...]
    group: str = "group_0"
    project_id: int = 1
    filters: tuple[Condition, ...] = ()
    breakdowns: tuple[str, ...] = ()
    segments: tuple[Segment, ...] = ()
    analysis: Literal["linear", "rolling_average", "logarithmic", "cumulative"] = "linear"
    window: int = 2  # of the rolling average
    compare: tuple[int, Unit] | None = None  # offset in units
    chart_type: Literal["line", "column", "pie"] = "line"


@dataclass(frozen=True)
class Exclude:
    """events that end an attempt; steps (first, last), zero-based, limits where: the step that is waited for."""

    event: EventRef
    steps: tuple[int, int] | None = None


@dataclass(frozen=True)
class FunnelFilter:
    """drop_off_any; drop_off_on: exactly so many steps done; time_to_convert: done within (least, most)."""

    kind: Literal["drop_off_any", "drop_off_on", "time_to_convert"]
    step: int = 0
    least: timedelta = timedelta(0)
    most: timedelta = timedelta(days=36500)


@dataclass(frozen=True)
class Funnel:
    time: TimeRange
    steps: tuple[tuple[EventRef, ...], ...]
    window: timedelta
    count: Literal["unique", "non_unique", "session"] = "non_unique"
    any_order: tuple[tuple[int, int], ...] = ()  # ranges of steps, zero-based, ends inclusive
    exclude: tuple[Exclude, ...] = ()
    constants: tuple[str, ...] = ()
    filter: FunnelFilter | None = None
    touch: Literal["row", "first", "last"] | int = "row"
    chart: Literal["steps", "over_time", "time_to_convert", "frequency"] = "steps"
    unit: Unit = "day"
    breakdowns: tuple[str, ...] = ()
    filters: tuple[Condition, ...] = ()
    group: str = "group_0"
    project_id: int = 1
    session_gap: timedelta | None = None  # attempts then stay within a session
    fold: Literal["arrays", "rows"] = "arrays"  # rows: for users with so many events that they fit no array
    least: timedelta | None = None  # bounds of the chart of times to convert
    most: timedelta | None = None

    def __post_init__(self):
        if not 1 <= len(self.steps) <= 5:
            raise ValueError("a funnel has 1 to 5 steps")
        n = len(self.steps)
        for first, last in (*self.any_order, *(e.steps for e in self.exclude if e.steps)):
            if not 0 <= first <= last < n:
                raise ValueError("steps out of range")
        if len(set(self.breakdowns)) < len(self.breakdowns):
            raise ValueError("a breakdown is given twice")


@dataclass(frozen=True)
class EventSearch:
    time: TimeRange = TimeRange()
    events: tuple[EventRef, ...] = ()
    filters: tuple[Condition, ...] = ()
    properties: tuple[str, ...] = ()
    project_id: int = 1
    limit: int = 100


@dataclass(frozen=True)
class GroupSearch:
    group_id: int = 0
    time: TimeRange = TimeRange()
    filters: tuple[Condition, ...] = ()
    properties: tuple[str, ...] = ()
    sort: tuple[str, Literal["asc", "desc"]] | None = None
    project_id: int = 1
    limit: int = 100


@dataclass(frozen=True)
class PropertyValues:
    prop: str
    event: EventRef | None = None
    filter: Filter | None = None
    project_id: int = 1
    limit: int = 1000


@dataclass
class CustomEvent:
    """Any of its events, which may be custom themselves, up to three levels."""

    name: str
    events: tuple[EventRef, ...] = field(default_factory=tuple)
