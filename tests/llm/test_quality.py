import math
import random

import numpy as np
import pytest

from tallyloom.llm import quality as Q

DOCS = "doc_id long, text string, lang string, source string, n_chars long, host string, x long"
LABELS = "doc_id long, quality int, toxic int"


def made(n=300):
    r = random.Random(3)
    rows, labels = [], []
    for i in range(n):
        good = r.random() < 0.7
        words = [r.choice("the of and lorem ipsum dolor sit amet consectetur adipiscing elit".split()) + (r.choice(["", "", ","])) for _ in range(r.randint(15, 60))]
        text = " ".join(words) if good else r.choice([" ".join(w + "###" for w in words), " ".join(words[:2] * 20), " | ".join(words).upper() + "!!"])
        rows.append((i, text, r.choice(["en", "de", None]), r.choice(["hot", "hot", "b", None]), len(text), "clash", 0))
        if i % 2:
            labels.append((i, int(good), None))
    return rows, labels


def brute(rows, labels):
    """The same model and the same posteriors, in plain Python over all rows."""
    x = {r[0]: Q.features((r[1] or "").encode()) for r in rows}
    y = dict((a, b) for a, b, _ in labels)
    w = Q.fit(np.array([x[i] for i in sorted(y)]), np.array([float(y[i]) for i in sorted(y)]))
    base = sum(y.values()) / len(y)
    ev = {i: max(-12.0, min(12.0, float(np.dot(v, w)))) for i, v in x.items()}
    p = {i: 1 / (1 + math.exp(-e)) for i, e in ev.items()}
    hosts, paths = {}, {}
    for r in rows:
        for key, d in ((r[3], hosts), ((r[3], r[2]), paths)):
            n, s = d.get(key, (0, 0.0))
            d[key] = n + 1, s + p[r[0]]
    n, mean = len(rows), sum(p.values()) / len(rows)
    strength = lambda spread, k: min(1e4, max(1.0, mean * (1 - mean) / max(spread - mean * (1 - mean) * k / n, 1e-9) - 1))
    kh = strength(sum(c * (s / c - mean) ** 2 for c, s in hosts.values()) / n, len(hosts))
    up = {h: (s + kh * mean) / (c + kh) for h, (c, s) in hosts.items()}
    kp = strength(sum(c * (s / c - up[h]) ** 2 for (h, _), (c, s) in paths.items()) / n, len(paths))
    out = {}
    for r in rows:
        c, s = hosts[r[3]]
        host = (s - p[r[0]] + kh * mean) / (c - 1 + kh)
        c, s = paths[r[3], r[2]]
        path = (s - p[r[0]] + kp * host) / (c - 1 + kp)
        z = ev[r[0]] - math.log(base / (1 - base)) + math.log(path / (1 - path))
        out[r[0]] = (ev[r[0]], host, path, 1 / (1 + math.exp(-z)))
    return out


def test_same_as_plain_python(spark):
    rows, labels = made()
    got = Q.score_documents(spark.createDataFrame(rows, DOCS), spark.createDataFrame(labels, LABELS)).collect()
    want = brute(rows, labels)
    assert len(got) == len(rows)
    for g in got:
        assert (g["evidence"], g["host_posterior"], g["path_posterior"], g["score"]) == pytest.approx(want[g["doc_id"]], rel=1e-5, abs=1e-7)


def test_held_out_accuracy(spark):
    d = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    learn, test = labels.where("doc_id % 2 = 0"), {r["doc_id"]: r["quality"] for r in labels.where("doc_id % 2 = 1").collect()}
    got = {r["doc_id"]: r["kept"] for r in Q.score_documents(docs, learn).collect()}
    assert sum(got[i] == bool(q) for i, q in test.items()) / len(test) > 0.96
    clean = [i for i, q in test.items() if q]
    assert sum(got[i] for i in clean) / len(clean) > 0.98


def test_edges(spark):
    none = spark.createDataFrame([], LABELS)
    assert Q.score_documents(spark.createDataFrame([], DOCS), none).collect() == []
    rows = [(None, None, None, None, None, None, None), (1, "", "en", "a", 0, "", 0), (1, "", "en", "a", 0, "", 0), (2, "word " * 50000, "en", "a", 0, "", 0)]
    docs = spark.createDataFrame(rows, DOCS)
    flat = Q.score_documents(docs, none).collect()
    assert len(flat) == 4 and all(r["evidence"] == 0 and r["kept"] for r in flat)
    kept = Q.keep_good(docs, spark.createDataFrame([(2, 0, 0), (1, 1, 0), (None, 1, 0), (5, None, 0)], LABELS))
    assert kept.columns == docs.columns and kept.where("doc_id = 1").count() == 2
