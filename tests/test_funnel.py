"""The fold against a plain walk, on fixed cases and on random sequences."""

import random
from dataclasses import replace
from datetime import datetime, timedelta

import pytest

from tallyloom.catalog import Catalog
from tallyloom.model import EventRef, Exclude, Filter, Funnel, FunnelFilter, TimeRange
from tallyloom.operators import funnel as op

T0 = datetime(2024, 1, 1)
TIME = TimeRange(T0, T0 + timedelta(days=300))
E = lambda *names: tuple((EventRef(n),) for n in names)


def frame(spark, rows):
    """rows: (user, minute, event, const)."""
    return spark.createDataFrame([(1, u, T0 + timedelta(minutes=m), i, e, c) for i, (u, m, e, c) in enumerate(rows)], "project_id long, group_0 long, created_at timestamp_ntz, event_id long, event string, const int")


def walk(rows, f):
    """(user, steps done) of each attempt, step by step as the rules say."""
    out = []
    n, window = len(f.steps), f.window.total_seconds() / 60
    hits = lambda e, refs: any(r.name == e for r in refs)
    for user in sorted({r[0] for r in rows if r[0] is not None}):
        st, used, const, done = [], set(), None, False
        for _, m, e, c in sorted((r for r in rows if r[0] == user), key=lambda r: r[1]):
            if done:
                break
            if st and any(hits(e, (x.event,)) and (x.steps is None or x.steps[0] <= len(st) <= x.steps[1]) for x in f.exclude):
                st, used = [], set()
            if st and m - st[0] > window:
                out.append((user, len(st)))
                st, used = [], set()
            if st and f.constants and c != const:
                st, used = [], set()
            at = len(st)
            options = [at]
            for a, b in f.any_order:
                if a <= at <= b:
                    options = [j for j in range(a, b + 1) if j not in used]
                    break
            j = next((j for j in options if hits(e, f.steps[j])), None)
            if j is not None:
                const = c if not st else const
                st.append(m)
                used.add(j)
                if len(st) == n:
                    out.append((user, n))
                    st, used, done = [], set(), f.count == "unique"
        if st:
            out.append((user, len(st)))
    return sorted(out)


def run(spark, rows, f):
    """Attempts by the fold over arrays, which have to be those of the fold over rows."""
    found = [sorted(map(str, op.attempts(frame(spark, rows), replace(f, fold=how), Catalog()).collect())) for how in ("arrays", "rows")]
    assert found[0] == found[1]
    return sorted((r["group_0"], r["n"]) for r in op.attempts(frame(spark, rows), f, Catalog()).collect())


U = lambda *events: [(1, i, *(e if isinstance(e, tuple) else (e, 0))) for i, e in enumerate(events)]
HOUR = timedelta(hours=1)


@pytest.mark.parametrize(
    "rows,f,want",
    [
        (U("a", "b", "c"), Funnel(TIME, E("a", "b", "c"), HOUR), [(1, 3)]),
        (U("a", "b", "c", "a", "b"), Funnel(TIME, E("a", "b", "c"), HOUR, count="unique"), [(1, 3)]),
        (U("a", "b", "c", "a", "b", "c"), Funnel(TIME, E("a", "b", "c"), HOUR), [(1, 3), (1, 3)]),
        (U("a", "x", "b", "c"), Funnel(TIME, E("a", "b", "c"), HOUR), [(1, 3)]),
        (U(("a", 1), ("b", 1), ("c", 1)), Funnel(TIME, E("a", "b", "c"), HOUR, constants=("const",)), [(1, 3)]),
        (U(("a", 1), ("b", 2), ("a", 2), ("b", 2)), Funnel(TIME, E("a", "b"), HOUR, constants=("const",)), [(1, 2)]),
        (U("a", "x", "a", "b", "c"), Funnel(TIME, E("a", "b", "c"), HOUR, exclude=(Exclude(EventRef("x")),)), [(1, 3)]),
        (U("a", "b", "x", "c"), Funnel(TIME, E("a", "b", "c"), HOUR, exclude=(Exclude(EventRef("x"), (1, 1)),)), [(1, 3)]),
        (U("a", "c", "b", "d"), Funnel(TIME, E("a", "b", "c", "d"), HOUR, any_order=((1, 2),)), [(1, 4)]),
        (U("a", "c", "c", "d"), Funnel(TIME, E("a", "b", "c", "d"), HOUR, any_order=((1, 2),)), [(1, 2)]),
        (U("a", "a", "a"), Funnel(TIME, E("a", "a"), HOUR), [(1, 1), (1, 2)]),
        ([(1, 0, "a", 0), (1, 60, "b", 0)], Funnel(TIME, E("a", "b"), HOUR), [(1, 2)]),
        ([(1, 0, "a", 0), (1, 61, "b", 0)], Funnel(TIME, E("a", "b"), HOUR), [(1, 1)]),
        ([(1, 0, "a", 0), (2, 1, "a", 0), (2, 2, "b", 0), (0, 3, "a", 0), (None, 1, "a", 0)], Funnel(TIME, E("a", "b"), HOUR), [(0, 1), (1, 1), (2, 2)]),
        (U("a", "b", "a", "a"), Funnel(TIME, E("a", "b"), timedelta(0), filter=FunnelFilter("drop_off_on", 1)), [(1, 1)] * 3),
    ],
)
def test_cases(spark, rows, f, want):
    assert run(spark, rows, f) == want
    if f.filter is None:
        assert walk(rows, f) == want


def test_random_sequences(spark):
    r = random.Random(3)
    for f in (
        Funnel(TIME, E("a", "b", "c"), timedelta(minutes=7)), Funnel(TIME, E("a", "b", "a", "c"), timedelta(minutes=20), count="unique", exclude=(Exclude(EventRef("d"), (1, 2)), Exclude(EventRef("e")))),
        Funnel(TIME, E("a", "b", "c", "d"), timedelta(minutes=15), any_order=((1, 3),), constants=("const",)), Funnel(TIME, ((EventRef("a"), EventRef("b")), (EventRef("b"), EventRef("c"))), timedelta(minutes=4)),
    ):
        rows = [(u, m, r.choice("abcde"), r.choice([0, 0, 0, 1])) for u in range(25) for m in sorted(r.sample(range(200), 40))]
        assert run(spark, rows, f) == walk(rows, f)


def test_report_and_validation(spark):
    f = Funnel(TIME, E("a", "b"), HOUR, breakdowns=("const",))
    rows = [(1, 0, "a", 1), (1, 2, "b", 1), (2, 0, "a", 1), (3, 5, "a", None)]
    got = {(r["const"], r["step"]): r for r in op.report(op.attempts(frame(spark, rows), f, Catalog()), f).collect()}
    assert got[1, 0]["total"] == 2 and got[1, 1]["total"] == 1 and got[1, 1]["conversion_ratio"] == 50 and got[1, 1]["dropped_off"] == 1
    assert got[1, 1]["time_to_convert"] == 120_000 and got[1, 1]["avg_time_to_convert"] == 120_000 and got[None, 1]["total"] == 0 and got[None, 1]["avg_time_to_convert"] is None
    for bad in (dict(steps=()), dict(steps=E(*"abcdef")), dict(steps=E("a"), exclude=(Exclude(EventRef("x"), (0, 1)),)), dict(steps=E("a"), breakdowns=("p", "p"))):
        with pytest.raises(ValueError):
            Funnel(time=TIME, window=HOUR, **bad)
    assert Filter("k", "exists").values == ()


def test_touch(spark):
    rows = [(1, 0, "a", 1), (1, 1, "b", 2), (1, 2, "c", 3)]
    for touch, want in (("first", "1"), ("last", "3"), (1, "2")):
        f = Funnel(TIME, E("a", "b", "c"), HOUR, touch=touch, breakdowns=("const",))
        assert [(r["const"], r["n"]) for r in op.attempts(frame(spark, rows), f, Catalog()).collect()] == [(want, 3)]
