import random

import numpy as np
import pytest

from tallyloom.llm import superminhash as S
from tallyloom.llm.components import components

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def brute(rows, width, percent):
    """By all pairs, with sets of word tuples."""
    sets = []
    for _, text in rows:
        w = (text or "").encode().lower().split()
        sets.append({tuple(w[i : i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else ({tuple(w)} if w else set()))
    ids = [i for i, _ in rows]
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = find(ids[a]), find(ids[b])
                root[max(x, y)] = min(x, y)
    return sorted((i, len(s), find(i) if s else i, (find(i) if s else i) == i) for i, s in zip(ids, sets, strict=True))


def made(seed, n=120):
    r = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(400)] + ["É", "straße", "ÄÖ"]
    rows, texts = [], []
    for i in range(n):
        kind = r.random()
        if texts and kind < 0.55:
            words = r.choice(texts).split()
            for _ in range(r.choice([0, 1, 1, 2, 3])):
                if words:
                    words[r.randrange(len(words))] = r.choice(vocabulary)
            text = r.choice([" ", "\t", "\n "]).join(words)
        else:
            text = " ".join(r.choices(vocabulary, k=r.choice([1, 2, 8, 30, 60])))
        texts.append(text)
        rows.append((i, text if kind < 0.95 else r.choice([None, "", " \t "])))
    return rows


@pytest.mark.parametrize("width,seed", [(2, 1), (5, 2)])
def test_same_as_all_pairs(spark, width, seed):
    rows = made(seed)
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], DOCS)
    got = sorted(tuple(r) for r in S.near_duplicates(docs, width=width).drop("text_hash").collect())
    assert got == brute(rows, width, 80)


def test_one_hot_family_with_weak_ends(spark):
    """Variants that are near the base but not near each other; the hub may be any of them."""
    r = random.Random(5)
    base = [f"b{k}" for k in range(100)]
    rows = []
    for i in range(60):
        words = list(base)
        for k in r.sample(range(100), 4):
            words[k] = f"x{i}_{k}"
        rows.append((i + 1, " ".join(words)))
    rows.append((0, " ".join(base)))
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], DOCS)
    got = sorted(tuple(x) for x in S.near_duplicates(docs, width=2).drop("text_hash").collect())
    assert got == brute(rows, 2, 80)


def test_nulls_repeats_empty_and_clashing_columns(spark):
    schema = "doc_id long, text string, bucket string, node string, bands string"
    rows = [(None, "a b c", "", "", ""), (7, "a b c", None, None, None), (7, "a b c", None, None, None), (9, None, "", "", ""), (3, "A B C", "", "", "")]
    got = sorted((tuple(x) for x in S.near_duplicates(spark.createDataFrame(rows, schema), width=2).drop("text_hash").collect()), key=str)
    assert got == sorted([(None, 2, 3, False), (7, 2, 3, False), (7, 2, 3, False), (9, 0, 9, True), (3, 2, 3, True)], key=str)
    assert S.near_duplicates(spark.createDataFrame([], schema)).collect() == []


def test_keep_one(spark):
    rows = [(4, "a b c d e f", 1), (2, "A b c d e f", 2), (2, "A b c d e f", 2), (2, "other words than those", 3), (8, None, 4), (None, "q r s", 5), (None, "q r s", 6)]
    kept = S.keep_one(spark.createDataFrame(rows, "doc_id long, text string, _d int"))
    assert sorted(((r["doc_id"], r["text"]) for r in kept.collect()), key=str) == sorted([(2, "A b c d e f"), (8, None), (None, "q r s")], key=str)


def test_estimates_follow_jaccard():
    r = np.random.default_rng(1)
    pool = r.integers(0, 2**63, 400, dtype=np.uint64)
    with np.errstate(over="ignore"):
        sig = S.signatures([np.unique(pool[:300]), np.unique(pool[100:])], 512)
    assert abs((sig[0] == sig[1]).mean() - 0.5) < 0.08
    with np.errstate(over="ignore"):
        short = S.signatures([pool[:3]], 128)
    assert (short != 0xFFFFFFFF).all()  # every place gets a value even from three elements


def test_components_of_a_path(spark):
    n = 200
    links = spark.createDataFrame([(i, i + 1) for i in range(n)] + [(1000, 1001), (5, 5)], "a long, b long")
    got = {x["node"]: x["component_id"] for x in components(links).collect()}
    assert got == {**{i: 0 for i in range(n + 1)}, 1000: 1000, 1001: 1000}


@pytest.mark.parametrize("width", [2, 5])
def test_large_family_needs_few_pairs(spark, width, monkeypatch):
    """2,500 near copies of a text that is not among them, changed a little or more: the pairs that are compared grow with the
    members, not with their square, and the components are those of all pairs."""
    r = random.Random(7)
    base = [f"b{k}" for k in range(150)]
    rows = []
    for i in range(2500):
        words = list(base)
        for k in r.sample(range(150), r.choice([1, 2, 2, 3, 4, 6, 9])):
            words[k] = f"x{r.randrange(400)}"
        rows.append((i, " ".join(words)))
    counts = []
    missed = S._missed

    def counted(*args):
        found = missed(*args)
        counts.append(found.count())
        return found

    monkeypatch.setattr(S, "_missed", counted)
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], DOCS)
    got = {x["doc_id"]: x["component_id"] for x in S.near_duplicates(docs, width=width).collect()}
    sets = [{tuple(w[k : k + width]) for k in range(len(w) - width + 1)} for w in (t.split() for _, t in rows)]
    number = {x: j for j, x in enumerate({x for s in sets for x in s})}
    has = np.zeros((len(sets), len(number)), np.float32)
    for i, s in enumerate(sets):
        has[i, [number[x] for x in s]] = 1
    both, size = has @ has.T, has.sum(1)
    linked = 100 * both >= 80 * (size[:, None] + size[None, :] - both)
    comp = np.arange(len(sets))
    while True:
        least = np.where(linked, comp[None, :], len(sets)).min(1)
        least = least[least]
        if (least == comp).all():
            break
        comp = least
    assert [got[i] for i in range(len(sets))] == comp.tolist() and len({*comp.tolist()}) > 10
    assert counts[0] < 10 * len(rows)
