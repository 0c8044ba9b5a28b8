import random
import zlib

import numpy as np

from tallyloom.llm import toxicity as T

DOCS = "doc_id long, text string, lang string, source string, score double"
LABELS = "doc_id long, quality int, toxic int"


def made(n=600):
    r = random.Random(9)
    vocabulary = ["".join(r.choices("aeioubcdlmnrst", k=r.randint(2, 9))) for _ in range(800)]
    rows, labels = [], []
    for i in range(n):
        words = r.choices(vocabulary, k=r.randint(5, 120))
        toxic = r.random() < 0.3
        for _ in range(2 * toxic):
            words.insert(r.randrange(len(words)), r.choice(["zork", "gribble"]) + r.choice(["", "s", "ly", "ing", "est", "ish"]))
        rows.append((i, " ".join(words), r.choice(["en", "de", None]), "s", 0.0))
        labels.append((i, 1, int(toxic)))
    return rows, labels


def test_held_out_accuracy_and_untouched_labels(spark):
    rows, labels = made()
    docs = spark.createDataFrame(rows, DOCS)
    got = {r["doc_id"]: r for r in T.score_documents(docs, spark.createDataFrame(labels, LABELS)).collect()}
    held = {i for i in got if zlib.crc32(str(i).encode()) % 4 == 2}
    assert {i for i, r in got.items() if r["held_out"]} == held and len(held) > 100
    truth = {i: t for i, _, t in labels}
    assert sum(got[i]["predicted"] == truth[i] for i in held) / len(held) > 0.93
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in got.values())
    turned = [(i, q, 1 - t if i in held else t) for i, q, t in labels]
    again = {r["doc_id"]: r["score"] for r in T.score_documents(docs.selectExpr("doc_id", "text", "lang", "'x' AS source", "0 AS ids"), spark.createDataFrame(turned, LABELS)).collect()}
    assert again == {i: r["score"] for i, r in got.items()}


def small_model(r, kind=np.float64):
    embedding = r.standard_normal((T.BUCKETS + 1, T.DIM)).astype(kind)
    embedding[T.BUCKETS] = 0
    filters = [r.standard_normal((w, T.DIM, T.FILTERS)).astype(kind) for w in T.WIDTHS]
    return T.Model(embedding, filters, [r.standard_normal(T.FILTERS).astype(kind) for _ in T.WIDTHS], r.standard_normal(len(T.WIDTHS) * T.FILTERS).astype(kind), 0.3)


TEXTS = [b"one two three four five six", b"", b"zork", b"Two, words", b"a b c d e f g h i j k l m one two three " * 3]


def plain_logit(text, model):
    """The network word by word, window by window, filter by filter."""
    stems = lambda w: [T._hash(w, 0) % T.BUCKETS, *[T._hash(w[:k], k) % T.BUCKETS for k in T.STEMS if k < len(w)]]
    words = [w.strip(T._EDGE).decode().lower() for w in text.lower().split()] or [""]
    rows = [sum((model.embedding[p] for p in stems(w)), np.zeros(T.DIM)) if w else np.zeros(T.DIM) for w in words]
    rows += [np.zeros(T.DIM)] * (len(T.WIDTHS) - 1)
    out, at = model.offset, 0
    for filters, bias in zip(model.filters, model.bias, strict=True):
        for f in range(T.FILTERS):
            best = max(sum(float(rows[i + o] @ filters[o][:, f]) for o in range(len(filters))) for i in range(len(words)))
            out += max(0.0, best + bias[f]) * model.out[at]
            at += 1
    return out


def test_forward_pass_is_the_plain_one():
    model, hasher = small_model(np.random.default_rng(1)), T.Hasher()
    ids = hasher.ids(TEXTS)
    np.testing.assert_allclose(T.logits(ids, hasher.pieces(), model), [plain_logit(t, model) for t in TEXTS], rtol=1e-9, atol=1e-9)


def test_gradients_are_those_of_the_loss():
    r = np.random.default_rng(2)
    model, hasher, y = small_model(r), T.Hasher(), np.array([1, 0, 1, 0, 1])
    ids = hasher.ids(TEXTS)
    pieces = hasher.pieces()

    def loss():
        z = T.logits(ids, pieces, model)
        return float(np.mean(np.logaddexp(0, z) - y * z)) + 1e-4 / 2 * float((model.out**2).sum())

    grads, error = T.gradients(model, ids, y, pieces)
    checked = 0
    for w, g in zip([model.embedding, *model.filters, *model.bias, model.out], grads, strict=True):
        spots = [tuple(x) for x in np.argwhere(g != 0)]
        for spot in [spots[i] for i in r.permutation(len(spots))[:12]]:
            old, step = w[spot], 1e-6
            w[spot] = old + step
            up = loss()
            w[spot] = old - step
            down = loss()
            w[spot] = old
            assert abs((up - down) / (2 * step) - g[spot]) < 1e-5
            checked += 1
    model.offset += 1e-6
    up = loss()
    model.offset -= 2e-6
    assert abs((up - loss()) / 2e-6 - error) < 1e-6 and checked > 60


def test_thresholds_are_the_best_of_each_language(spark):
    r = np.random.default_rng(3)
    for _ in range(20):
        y = (r.random(200) < 0.3).astype(float)
        score = np.clip(0.25 * y + r.random(200) * 0.7, 0, 1)
        f1 = {t: 2 * (((score >= t) & (y == 1)).sum() + 2) / ((score >= t).sum() + (y == 1).sum() + 4) for t in np.linspace(0.05, 0.95, 19)}
        got = T._threshold(score, y)
        assert f1[min(f1, key=lambda t: abs(t - got))] == max(f1.values())
    rows, labels = made()
    docs = spark.createDataFrame([*rows, (9000, "zorkly gribbles", "xx", "s", 0.0)], DOCS)
    frame = spark.createDataFrame(labels, LABELS)
    limits = T.fit(docs, frame).thresholds
    assert {*limits} == {"en", "de", None}
    for x in T.score_documents(docs, frame).join(docs.select("doc_id", "lang"), "doc_id").collect():
        limit = limits.get(x["lang"], T.THRESHOLD)
        assert x["lang_threshold"] == limit and x["flagged"] == (x["score"] >= limit)


def test_documents_that_share_an_id_count_once(spark):
    rows, labels = made(100)
    same = [(5, f"text {i}", "en", "s", 0.0) for i in range(500)]
    docs = spark.createDataFrame(rows + same, DOCS)
    assert T.fit(docs, spark.createDataFrame(labels, LABELS)).offset == T.fit(docs.repartition(7), spark.createDataFrame(labels, LABELS)).offset
    assert len(T.score_documents(docs, spark.createDataFrame(labels, LABELS)).collect()) == 600


def test_sample_corpus(spark):
    d = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    rows = T.score_documents(docs, labels).join(labels, "doc_id").where("held_out").collect()
    hit = sum(r["predicted"] and r["toxic"] for r in rows)
    assert hit / sum(r["toxic"] for r in rows) > 0.85 and hit / sum(r["predicted"] for r in rows) > 0.85


def test_edges(spark):
    none = spark.createDataFrame([], LABELS)
    assert T.score_documents(spark.createDataFrame([], DOCS), none).collect() == []
    rows = [(None, None, None, None, None), (1, "", "en", "", 0.0), (1, "", "en", "", 0.0), (2, " ... !!", "en", "", 0.0), (3, "long " * 100_000, "en", "", 0.0)]
    got = T.score_documents(spark.createDataFrame(rows, DOCS), spark.createDataFrame([(1, 1, None), (None, 1, 1), (3, 0, 1)], LABELS)).collect()
    assert len(got) == 5 and len({r["score"] for r in got}) == 1
    assert [r["held_out"] for r in got if r["doc_id"] is None] == [False]
