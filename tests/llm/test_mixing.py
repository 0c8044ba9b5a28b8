import re
from collections import defaultdict

import pytest

from tallyloom.llm import mixing as M

DOCS = "doc_id long, text string, source string, size string, block long"


def brute_targets(sizes, weights=(5, 2, 1), share=1.5, most=2.0):
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    left, free, out = share * sum(sizes.values()), set(names), {}
    while free:
        level = left / sum(weight[s] for s in free)
        over = {s for s in free if level * weight[s] > most * sizes[s] - 1e-9}
        if not over:
            return out | {s: level * weight[s] for s in free}
        for s in over:
            out[s] = most * sizes[s]
            left -= out[s]
        free -= over
    return out


def check(rows, got, block):
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    by_source = defaultdict(int)
    for _, text, source in rows:
        by_source[source] += size(text)
    goal = brute_targets(by_source)
    source_of = {i: s for i, _, s in rows}
    assert len(got) == len(rows)
    taken = defaultdict(int)
    for r in got:
        assert r["source_size"] == by_source[source_of[r["doc_id"]]]
        assert r["target"] == pytest.approx(goal[source_of[r["doc_id"]]])
        assert 0 <= r["taken"] <= 2 * r["size"]
        taken[source_of[r["doc_id"]]] += r["taken"]
    for s, t in taken.items():
        assert abs(t - goal[s]) <= 0.5 + 1e-6


@pytest.mark.parametrize("block", [7, 1024])
def test_targets_are_met(spark, block):
    rows = [(i, " ".join(["w"] * ((i * 37) % 90 + (3000 if i == 5 else 0))), ["big", "big", "b", "ä", None, "z"][i % 6]) for i in range(200)]
    rows += [(900, None, "none"), (901, " \t\n", "none"), (902, "x", "solo")]
    docs = spark.createDataFrame([(i, t, s, "", 0) for i, t, s in rows], DOCS)
    got = M.mix_documents(docs, block_words=block).collect()
    check(rows, got, block)
    assert sorted(map(tuple, got)) == sorted(map(tuple, M.mix_documents(docs.repartition(5), block_words=block).collect()))


def test_schedule_is_a_spread_permutation(spark):
    sizes = spark.createDataFrame([("a", 6000), ("b", 3000), ("c", 1000)], "source string, size long")
    planned, n = M.plan_sources(M.targets(sizes), 10)
    slots = M.schedule(planned, n).orderBy("slot").collect()
    assert [r["slot"] for r in slots] == list(range(n))
    quota = {r["sid"]: r["quota"] for r in planned.collect()}
    for sid, q in quota.items():
        mine = [r for r in slots if r["sid"] == sid]
        assert [r["rank"] for r in mine] == list(range(q))
        for upto in range(50, n, 50):  # each prefix of the mix is close to the weights
            assert abs(sum(r["slot"] < upto for r in mine) - upto * q / n) < 6


def test_empty_and_wordless(spark):
    assert M.mix_documents(spark.createDataFrame([], DOCS)).collect() == []
    got = M.mix_documents(spark.createDataFrame([(1, None, None, "", 0), (None, "", "s", "", 0)], DOCS)).collect()
    assert sorted(map(tuple, got), key=str) == sorted([(1, 0, 0, 0.0, 0, None, 0), (None, 0, 0, 0.0, 0, None, 0)], key=str)


def brute_mix(rows, block):
    """taken and slots of each row, by walking the mix slot by slot; rows (doc_id, size, source) in the order of each source's stream."""
    by, out = defaultdict(list), {}
    for i, n, source in rows:
        by[source].append((i, n))
    names = sorted(by, key=lambda s: (s is None, (s or "").encode()))
    total = {s: sum(n for _, n in by[s]) for s in names}
    goal = brute_targets(total)
    n_blocks = {s: max(1, int(total[s] / block + 0.5)) for s in names}
    want = {s: int(goal[s] + 0.5) for s in names}
    quota = {s: want[s] // total[s] * n_blocks[s] + -(-(want[s] % total[s] * n_blocks[s]) // total[s]) for s in names}
    n = sum(quota.values())
    owner = [s for s in names for _ in range(quota[s])]
    step, used = M.golden_step(n), defaultdict(int)
    taken, slots, left = defaultdict(int), defaultdict(list), dict(want)
    for slot in range(n):
        s = owner[slot * step % n]
        k = used[s] % n_blocks[s]
        used[s] += 1
        lo, hi, at = k * total[s] // n_blocks[s], (k + 1) * total[s] // n_blocks[s], 0
        hi = min(hi, lo + left[s])
        left[s] -= max(0, hi - lo)
        for i, size in by[s]:
            taken[i] += max(0, min(hi, at + size) - max(lo, at))
            if lo <= at < (k + 1) * total[s] // n_blocks[s]:
                slots[i].append(slot)
            at += size
    return taken, slots


def test_same_as_walking_the_mix(spark):
    sizes = [((i * 37) % 90 + 1 + (3000 if i == 5 else 0), ["big", "big", "b", "ä", None, "z"][i % 6]) for i in range(150)]
    docs = spark.createDataFrame([(i, " ".join(["w"] * n), s, "", 0) for i, (n, s) in enumerate(sizes)], DOCS)
    got = M.mix_documents(docs, block_words=64).collect()
    order = [(r["doc_id"], r["size"], sizes[r["doc_id"]][1]) for r in sorted(got, key=lambda r: r["lo"])]
    taken, slots = brute_mix(order, 64)
    for r in got:
        assert r["taken"] == taken[r["doc_id"]] and (r["slots"] or []) == slots[r["doc_id"]]


def test_the_lattice_makes_the_order(spark, monkeypatch):
    docs = spark.createDataFrame([(i, "w " * 50, "abc"[i % 3], "", 0) for i in range(90)], DOCS)
    slots = lambda: {r["doc_id"]: r["slots"] for r in M.mix_documents(docs, block_words=100).collect()}
    spread = slots()
    monkeypatch.setattr(M, "golden_step", lambda n: 1)
    assert slots() != spread


def test_mix_of_repeated_rows_and_odd_columns(spark):
    """Repeated rows, a shared doc_id, a null one, a very long text, columns named as the operator's own."""
    schema = "doc_id long, text string, source string, _copy string, _own_id int, slots string, _Slots int, _lo string"
    rows = [(1, "a b c", "s"), (1, "a b c", "s"), (2, "x " * 30, "s"), (2, "y " * 10, "t"), (None, "q " * 20, "t"), (3, "w " * 200_000, "long"), (4, None, "s"), (5, " ", None)]
    docs = spark.createDataFrame([(*r, "c", 7, "d", 8, "e") for r in rows], schema)
    assert sum(r["taken"] for r in M.mix_documents(docs).collect()) > 0
    got = M.mixed(docs)
    assert got.columns == docs.columns
    found = got.collect()
    assert all(tuple(r)[3:] == ("c", 7, "d", 8, "e") for r in found) and {r["doc_id"] for r in found} >= {3, None} and not {4, 5} & {r["doc_id"] for r in found}
    assert M.mixed(docs.limit(0)).collect() == []


def test_the_mix_lies_in_the_order_of_slots(spark):
    docs = spark.createDataFrame([(i, "w " * 50, "abc"[i % 3], "", 0) for i in range(300)], DOCS)
    at = {r["doc_id"]: r["slots"] for r in M.mix_documents(docs, block_words=100).collect()}
    seen, places = defaultdict(int), []
    for r in M.mixed(docs, block_words=100).collect():
        places.append(at[r["doc_id"]][seen[r["doc_id"]]])
        seen[r["doc_id"]] += 1
    assert len(places) > 400 and places == sorted(places)
