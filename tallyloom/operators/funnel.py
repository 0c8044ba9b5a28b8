"""Funnels: a greedy walk over each user's events, as one fold over a sorted array, inside the JVM; or over rows sorted within
partitions, in Python, which holds one attempt at a time and so takes users with any number of events.

An attempt is the list of steps a user has matched in order. Per event, in this order: an exclusion drops the running
attempt, the window closes it, another value of a held constant drops it, and the event is matched to the step waited for.
Dropped attempts are not counted; closed, completed and last ones are."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import partial

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..catalog import Catalog
from ..functions.buckets import bucket, from_micros, instant, micros
from ..functions.predicates import any_of, conditions, event_column, time_column
from ..model import Funnel

_STEP = "struct<t:bigint,b:array<string>>"
_STATE = f"struct<st:array<{_STEP}>,used:int,c:array<string>,out:array<array<{_STEP}>>,done:boolean>"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def attempts(events: DataFrame, f: Funnel, catalog: Catalog) -> DataFrame:
    """(group, breakdowns..., n, st): each counted attempt, n its steps, st their (t in microseconds, b breakdown values)."""
    base = events.where((F.col("project_id") == f.project_id) & time_column(f.time) & conditions(f.filters, catalog) & F.col(f.group).isNotNull())
    steps = [any_of(event_column(e, catalog) for e in step) for step in f.steps]
    stops = [event_column(e.event, catalog) for e in f.exclude]
    yes = lambda cs: F.array(*[F.coalesce(c, F.lit(False)) for c in cs]) if cs else F.array().cast("array<boolean>")
    text = lambda names: F.array(*[F.col(f"`{catalog.column(p)}`").cast("string") for p in names]) if names else F.array().cast("array<string>")
    by = list(f.breakdowns) if f.touch == "row" else []
    if f.count == "session" or f.session_gap is not None:
        order = Window.partitionBy(f.group).orderBy("created_at", "event_id")
        gap = int((f.session_gap.total_seconds() if f.session_gap else 1800) * 1e6)
        new = F.coalesce((micros(F.col("created_at")) - F.lag(micros(F.col("created_at"))).over(order)) > gap, F.lit(True)).cast("int")
        base = base.withColumn("_new", new).withColumn("_session", F.sum("_new").over(order))
    if not f.constants:  # other rows can't change an attempt
        base = base.where(any_of([*steps, *stops]))
    row = F.struct(
        micros(F.col("created_at")).alias("t"), F.col("event_id").alias("id"), yes(steps).alias("f"), yes(stops).alias("x"), text(f.constants).alias("c"),
        text(f.breakdowns if f.touch != "row" else ()).alias("b"),
    )
    keys = [F.col(f.group), *[F.col(f"`{catalog.column(b)}`").alias(b) for b in by], *([F.col("_session")] if "_session" in base.columns else [])]
    if f.fold == "rows":
        found = _fold_rows(base.select(*keys, row.alias("r")).select(*[F.col(k) for k in (f.group, *by)], *(["_session"] if "_session" in base.columns else []), "r.*"), f, by)
        return _counted(found.select(f.group, *by, "st"), f)
    rows = base.groupBy(*keys).agg(F.sort_array(F.collect_list(row)).alias("rows"))
    start = F.struct(
        F.array().cast(f"array<{_STEP}>").alias("st"), F.lit(0).alias("used"), F.lit(None).cast("array<string>").alias("c"), F.array().cast(f"array<array<{_STEP}>>").alias("out"),
        F.lit(False).alias("done"),
    ).cast(_STATE)
    n, span = len(f.steps), int(f.window.total_seconds() * 1e6)
    none = F.array().cast(f"array<{_STEP}>")

    def state(st, used, c, out, done):
        return F.struct(st.alias("st"), used.alias("used"), c.alias("c"), out.alias("out"), done.alias("done")).cast(_STATE)

    def clear(a: Column, emit: bool) -> Column:
        return state(none, F.lit(0), F.lit(None), F.concat(a["out"], F.array(a["st"])) if emit else a["out"], a["done"])

    def stopped(a: Column, x: Column) -> Column:
        at = F.size(a["st"])
        tests = [F.get(x["x"], F.lit(i)) & (F.lit(True) if e.steps is None else at.between(*e.steps)) for i, e in enumerate(f.exclude)]
        return (at > 0) & any_of(tests)

    def matched(a: Column, x: Column) -> Column:
        """The step that x matches, or null."""
        at = F.size(a["st"])
        choice = F.when(F.get(x["f"], at), at)
        for first, last in reversed(f.any_order):
            free = [F.when(F.get(x["f"], F.lit(j)) & (a["used"].bitwiseAND(1 << j) == 0), F.lit(j)) for j in range(first, last + 1)]
            choice = F.when(at.between(first, last), F.coalesce(*free) if len(free) > 1 else free[0]).otherwise(choice)
        return choice

    def advance(a: Column, x: Column) -> Column:
        def take(j: Column) -> Column:
            st = F.concat(a["st"], F.array(F.struct(x["t"].alias("t"), x["b"].alias("b"))))
            used = a["used"].bitwiseOR(F.pow(F.lit(2), j).cast("int"))
            full = F.size(a["st"]) + 1 == n
            constants = F.when(F.size(a["st"]) == 0, x["c"]).otherwise(a["c"])
            return F.when(full, state(none, F.lit(0), F.lit(None), F.concat(a["out"], F.array(st)), F.lit(f.count == "unique"))).otherwise(state(st, used, constants, a["out"], a["done"]))

        return let(matched(a, x), lambda j: F.when(j.isNull(), a).otherwise(take(j)))

    def step(a: Column, x: Column) -> Column:
        chain: list[Callable[[Column], Column]] = []
        if f.exclude:
            chain.append(lambda s: F.when(stopped(s, x), clear(s, False)).otherwise(s))
        chain.append(lambda s: F.when((F.size(s["st"]) > 0) & (x["t"] - F.get(s["st"], F.lit(0))["t"] > span), clear(s, True)).otherwise(s))
        if f.constants:
            chain.append(lambda s: F.when((F.size(s["st"]) > 0) & ~s["c"].eqNullSafe(x["c"]), clear(s, False)).otherwise(s))
        chain.append(lambda s: advance(s, x))

        def run(s: Column, i: int = 0) -> Column:
            return chain[i](s) if i == len(chain) - 1 else let(chain[i](s), lambda v: run(v, i + 1))

        return F.when(a["done"], a).otherwise(run(a))

    folded = F.aggregate("rows", start, step, lambda a: F.when(F.size(a["st"]) > 0, F.concat(a["out"], F.array(a["st"]))).otherwise(a["out"]))
    return _counted(rows.select(f.group, *by, F.explode(folded).alias("st")), f)


def _walk(batches: Iterator[pa.RecordBatch], f: Funnel, keys: list[str], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    n, span = len(f.steps), int(f.window.total_seconds() * 1e6)
    who: tuple | None = None
    st: list[dict] = []
    used, held, done, out = 0, None, False, []

    def emit() -> None:
        out.append(dict(zip(keys, who, strict=True)) | {"st": st})

    for batch in batches:
        for r in batch.to_pylist():
            key = tuple(r[k] for k in keys)
            if key != who:
                if st:
                    emit()
                who, st, used, held, done = key, [], 0, None, False
            if done:
                continue
            if st and any(x and (e.steps is None or e.steps[0] <= len(st) <= e.steps[1]) for x, e in zip(r["x"], f.exclude, strict=True)):
                st, used = [], 0
            if st and r["t"] - st[0]["t"] > span:
                emit()
                st, used = [], 0
            if f.constants and st and held != r["c"]:
                st, used = [], 0
            at = len(st)
            within = next(((a, b) for a, b in f.any_order if a <= at <= b), None)
            step = next((j for j in range(within[0], within[1] + 1) if r["f"][j] and not used >> j & 1), None) if within else at if r["f"][at] else None
            if step is None:
                continue
            held = r["c"] if not st else held
            st, used = [*st, {"t": r["t"], "b": r["b"]}], used | 1 << step
            if len(st) == n:
                emit()
                st, used, done = [], 0, f.count == "unique"
        if out:
            yield pa.RecordBatch.from_pylist(out, schema)
            out = []
    if st:
        emit()
        yield pa.RecordBatch.from_pylist(out, schema)


def _fold_rows(rows: DataFrame, f: Funnel, by: list[str]) -> DataFrame:
    keys = [c for c in (f.group, *by, "_session") if c in rows.columns]
    types = {x.name: x.dataType for x in rows.schema.fields}
    out = T.StructType([*[T.StructField(k, types[k]) for k in keys], T.StructField("st", T.ArrayType(T._parse_datatype_string(_STEP)))])
    placed = rows.repartition(*[F.col(f"`{k}`") for k in keys]).sortWithinPartitions(*[F.col(f"`{k}`") for k in keys], "t", "id")
    return placed.mapInArrow(partial(_walk, f=f, keys=keys, schema=to_arrow_schema(out)), out)


def _counted(found: DataFrame, f: Funnel) -> DataFrame:
    """Attempts that the request's filter lets pass, with n and, by its touch, breakdown values."""
    n = len(f.steps)
    found = found.withColumn("n", F.size("st"))
    if f.filter is not None:
        took = F.element_at("st", -1)["t"] - F.get("st", F.lit(0))["t"]
        found = found.where({
            "drop_off_any": F.col("n") < n, "drop_off_on": (F.col("n") == f.filter.step) & (F.col("n") < n),
            "time_to_convert": (F.col("n") == n) & took.between(int(f.filter.least.total_seconds() * 1e6), int(f.filter.most.total_seconds() * 1e6)),
        }[f.filter.kind])
    if f.touch != "row":
        at = {"first": F.lit(0), "last": F.size("st") - 1}.get(f.touch, F.lit(f.touch) if isinstance(f.touch, int) else None)
        found = found.select(*found.columns, *[F.get(F.get("st", at)["b"], F.lit(i)).alias(b) for i, b in enumerate(f.breakdowns)])
    return found


def report(found: DataFrame, f: Funnel) -> DataFrame:
    """A row per bucket (of the first step; null unless the chart is over time), breakdown values and step.

    total, conversion_ratio, drop_off_ratio in percent of the first step; times in milliseconds."""
    n, by = len(f.steps), list(f.breakdowns)
    over_time = f.chart in ("over_time", "time_to_convert")
    first = from_micros(F.get("st", F.lit(0))["t"])
    at = bucket(first, f.unit) if over_time else instant(f.time.start)
    t = lambda i: F.get("st", F.lit(i))["t"]
    sums = []
    for i in range(n):
        got = F.col("n") > i
        sums += [F.count_if(got).alias(f"n{i}"), F.coalesce(F.sum(F.when(got, t(i) - t(max(i - 1, 0)))), F.lit(0)).alias(f"p{i}"), F.coalesce(F.sum(F.when(got, t(i) - t(0))), F.lit(0)).alias(f"s{i}")]
    totals = found.groupBy(at.alias("bucket"), *by).agg(*sums).where("n0 > 0")
    rows = []
    for i in range(n):
        count, ratio = F.col(f"n{i}"), F.col(f"n{i}") / F.col("n0") * 100
        rows.append(F.struct(
            F.lit(i).alias("step"), count.alias("total"), ratio.alias("conversion_ratio"), (F.col(f"n{max(i - 1, 0)}") - count).alias("dropped_off"), (F.lit(100.0) - ratio).alias("drop_off_ratio"),
            F.expr(f"p{i} DIV 1000").alias("time_to_convert"), F.expr(f"s{i} DIV 1000").alias("time_to_convert_from_start"),
            F.when(count > 0, F.col(f"p{i}") / 1000 / count).alias("avg_time_to_convert"), F.when(count > 0, F.col(f"s{i}") / 1000 / count).alias("avg_time_to_convert_from_start"),
        ))
    return totals.select("bucket", *by, F.explode(F.array(*rows)).alias("r")).select("bucket", *by, "r.*")


def histogram(found: DataFrame, f: Funnel, width_ms: int) -> DataFrame:
    """(breakdowns..., bin, total): completed attempts by whole multiples of width_ms from first to last step, of those that took
    at least f.least and at most f.most, if given."""
    took = F.element_at("st", -1)["t"] - F.get("st", F.lit(0))["t"]
    done = found.where(F.col("n") == len(f.steps))
    if f.least is not None:
        done = done.where(took >= int(f.least.total_seconds() * 1e6))
    if f.most is not None:
        done = done.where(took <= int(f.most.total_seconds() * 1e6))
    return done.groupBy(*f.breakdowns, F.floor(took / (width_ms * 1000)).cast("long").alias("bin")).agg(F.count(F.lit(1)).alias("total"))


def frequency(found: DataFrame, f: Funnel) -> DataFrame:
    """(breakdowns..., times, users): how many users completed the funnel so often."""
    each = found.where(F.col("n") == len(f.steps)).groupBy(f.group, *f.breakdowns).agg(F.count(F.lit(1)).alias("times"))
    return each.groupBy(*f.breakdowns, "times").agg(F.count(F.lit(1)).alias("users"))
