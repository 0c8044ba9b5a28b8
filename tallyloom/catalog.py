"""What is known of events and properties: types, physical columns, custom events, dictionaries, request validation."""

from __future__ import annotations

import re
from collections.abc import Iterable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .functions.numbering import numbered
from .model import (
    MAX_GROUPS, VALUELESS, AggregateProperty, AggregatePropertyPerGroup, Condition, CustomEvent, EventRef, EventSearch, FilterGroup, Funnel, GroupSearch, PropertyValues, Segmentation, TimeRange
)

DECIMAL = T.DecimalType(28, 16)
TYPES = {
    "string": T.StringType(), "int8": T.ByteType(), "int16": T.ShortType(), "int32": T.IntegerType(), "int64": T.LongType(), "decimal": DECIMAL, "boolean": T.BooleanType(),
    "timestamp": T.TimestampNTZType(),
}
#: Short names of types in physical column names.
SHORT = {"string": "str", "int8": "i8", "int16": "i16", "int32": "i32", "int64": "i64", "decimal": "dec", "boolean": "b", "timestamp": "ts"}
ORDERED = ("int8", "int16", "int32", "int64", "decimal", "timestamp")
CUSTOM_LEVELS = 3


@dataclass(frozen=True)
class Property:
    name: str
    type: str
    group: int | None = None  # None: of events
    order: int = 0
    system: bool = False
    nullable: bool = True

    @property
    def column(self) -> str:
        if self.system:
            return re.sub(r"\W+", "_", self.name.strip()).lower()
        return f"{'e' if self.group is None else f'g_{self.group}'}_{SHORT[self.type]}_{self.order}"


@dataclass
class Catalog:
    """Names resolve to physical columns; a name the catalog does not know is a column of the table itself."""

    properties: dict[str, Property] = field(default_factory=dict)
    custom_events: dict[str, CustomEvent] = field(default_factory=dict)
    groups: list[str] = field(default_factory=lambda: ["user"])

    def add(self, name: str, type: str, group: int | None = None, system: bool = False, nullable: bool = True) -> Property:
        """Get or create; orders count per type over event and group properties, so that columns never clash."""
        if type not in TYPES:
            raise ValueError(f"no type {type}")
        if found := self.properties.get(name):
            if found.type != type:
                raise ValueError(f"{name} is of type {found.type}, not {type}")
            return found
        order = sum(p.type == type and not p.system for p in self.properties.values())
        self.properties[name] = Property(name, type, group, order, system, nullable)
        return self.properties[name]

    def add_group(self, name: str) -> int:
        if name not in self.groups:
            if len(self.groups) >= MAX_GROUPS:
                raise ValueError(f"at most {MAX_GROUPS} groups")
            self.groups.append(name)
        return self.groups.index(name)

    def add_custom(self, event: CustomEvent) -> None:
        self.custom_events[event.name] = event
        self.levels(event.name)

    def levels(self, name: str, seen: tuple[str, ...] = ()) -> int:
        if name in seen:
            raise ValueError(f"custom event {name} contains itself")
        event = self.custom_events[name]
        n = 1 + max((self.levels(e.name, (*seen, name)) for e in event.events if e.custom), default=0)
        if n > CUSTOM_LEVELS:
            raise ValueError(f"custom event {name} has more than {CUSTOM_LEVELS} levels")
        return n

    def column(self, name: str) -> str:
        return self.properties[name].column if name in self.properties else name

    def display(self, df: DataFrame) -> DataFrame:
        """Physical columns under their display names; a name that comes again gets the suffix 2, 3, ..."""
        names, seen = {p.column: p.name for p in self.properties.values()}, {}
        out = []
        for c in df.columns:
            name = names.get(c, c)
            seen[name] = seen.get(name, 0) + 1
            out.append(F.col(f"`{c}`").alias(name if seen[name] == 1 else f"{name} {seen[name]}"))
        return df.select(*out)

    def infer(self, name: str, value: object, group: int | None = None) -> Property:
        """The property for a value that comes in, with the type rules of ingestion."""
        from datetime import date

        kind = "boolean" if isinstance(value, bool) else "decimal" if isinstance(value, int | float) else "timestamp" if isinstance(value, date) else "string"
        return self.add(name, kind, group)

    def validate(self, c: Condition) -> None:
        if isinstance(c, FilterGroup):
            for x in c.parts:
                self.validate(x)
            return
        p = self.properties.get(c.prop)
        if (c.op in VALUELESS) == bool(c.values):
            raise ValueError(f"{c.op} takes {'no' if c.op in VALUELESS else 'at least one'} value")
        if p is None:
            return
        if c.op in ("gt", "gte", "lt", "lte") and p.type not in ORDERED:
            raise ValueError(f"{c.op} needs a number or a time; {p.name} is {p.type}")
        if c.op in ("true", "false") and p.type != "boolean":
            raise ValueError(f"{c.op} needs a boolean; {p.name} is {p.type}")
        if c.op in ("empty", "exists") and not p.nullable:
            raise ValueError(f"{p.name} is never null")
        if c.op in ("regex", "not_regex", "like", "not_like") and p.type != "string":
            raise ValueError(f"{c.op} needs a string; {p.name} is {p.type}")
        for v in c.values:
            good = isinstance(v, bool) if p.type == "boolean" else isinstance(v, str) if p.type == "string" else not isinstance(v, bool | str) or p.type == "timestamp"
            if not good:
                raise ValueError(f"{v!r} is no {p.type}")

    # Requests. columns: those of the table that is asked, whose names need not be in the catalog.

    def _names(self, names: Iterable[str], columns: Iterable[str], what: str) -> None:
        for n in names:
            if n not in self.properties and n not in columns:
                raise ValueError(f"{what}: no property {n}")

    def _conditions(self, cs: Iterable[Condition], columns: Iterable[str]) -> None:
        for c in cs:
            if isinstance(c, FilterGroup):
                self._conditions(c.parts, columns)
            else:
                self._names([c.prop], columns, "filter")
                self.validate(c)

    def _event(self, e: EventRef, columns: Iterable[str], what: str) -> None:
        if e.custom and e.name not in self.custom_events:
            raise ValueError(f"{what}: no custom event {e.name}")
        self._conditions(e.filters, columns)

    @staticmethod
    def _scope(time: TimeRange, group: str | None = None) -> None:
        if time.start and time.end and time.start > time.end:
            raise ValueError("the time range ends before it starts")
        if group is not None and not re.fullmatch(rf"group_[0-{MAX_GROUPS - 1}]", group):
            raise ValueError(f"no group {group}")

    def validate_segmentation(self, r: Segmentation, columns: Iterable[str] = ()) -> None:
        if not r.events or any(not e.metrics for e in r.events):
            raise ValueError("at least one event, and one metric for each")
        self._scope(r.time, r.group)
        self._conditions(r.filters, columns)
        for e in r.events:
            self._event(e.event, columns, "event")
            self._names((*e.breakdowns, *r.breakdowns), columns, "breakdown")
            self._names([m.prop for m in e.metrics if isinstance(m, AggregateProperty | AggregatePropertyPerGroup)], columns, "metric")
        if len({s.name for s in r.segments}) < len(r.segments):
            raise ValueError("two segments have the same name")
        for c in (c for s in r.segments for alternative in s.any_of for c in alternative):
            for e in (getattr(c, "event", None), getattr(c, "other", None)):
                if e is not None:
                    self._event(e, columns, "segment")
            if getattr(c, "time", None) is not None:
                self._scope(c.time)

    def validate_funnel(self, f: Funnel, columns: Iterable[str]) -> None:
        """What the request's own class cannot see: names, filters, the time, the group; its steps are checked as it is made."""
        self._scope(f.time, f.group)
        self._conditions(f.filters, columns)
        for i, step in enumerate(f.steps):
            if not step:
                raise ValueError(f"step {i} has no events")
            for e in step:
                self._event(e, columns, f"step {i}")
        for x in f.exclude:
            self._event(x.event, columns, "exclude")
        self._names(f.breakdowns, columns, "breakdown")
        self._names(f.constants, columns, "constant")
        if f.filter is not None and f.filter.kind == "drop_off_on" and not 0 < f.filter.step < len(f.steps):
            raise ValueError("the filter's step is out of range")
        if not isinstance(f.touch, str) and not 0 <= f.touch < len(f.steps):
            raise ValueError("the touched step is out of range")

    def validate_search(self, r: EventSearch | GroupSearch, columns: Iterable[str]) -> None:
        self._scope(r.time)
        self._conditions(r.filters, columns)
        self._names(r.properties, columns, "property")
        for e in getattr(r, "events", ()):
            self._event(e, columns, "event")
        if getattr(r, "sort", None) is not None:
            self._names([r.sort[0]], columns, "sort")
        if r.limit < 1:
            raise ValueError("the limit is below 1")

    def validate_values(self, r: PropertyValues, columns: Iterable[str]) -> None:
        self._names([r.prop], columns, "property")
        if r.event is not None:
            self._event(r.event, columns, "event")
        if r.filter is not None:
            self._conditions([r.filter], columns)


def build_dictionary(df: DataFrame, column: str) -> DataFrame:
    """(value, key): keys of the distinct values, from 1 in the order of values, by a sort over all tasks."""
    return numbered(df.select(F.col(column).alias("value")).where("value is not null").distinct(), ["value"], 1, "key")
