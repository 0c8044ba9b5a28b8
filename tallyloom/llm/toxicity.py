"""Toxicity by a small convolutional network: hashed word embeddings, filters of widths 1 to 3, max pooling; numpy only.

A word's embedding is the sum of hashed pieces, the word and its first letters, so that forms of one stem share what is
learned of it."""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc32_text, release, settle, tidy
from .superminhash import chunks

#: At most so many labelled documents, the first by a hash of doc_id, are used for training; of those that share a doc_id one.
MAX_TRAIN = 12_000
BUCKETS, DIM, WIDTHS, FILTERS = 1 << 16, 8, (1, 2, 3), 8
#: Pieces of a word besides itself: its first so many letters.
STEMS = (3, 4, 5, 6, 7)
THRESHOLD = 0.3
_hash = xxhash.xxh3_64_intdigest
#: Words that a worker remembers.
MEMO = 400_000
_NO_PIECE = BUCKETS
_EDGE = b".,;:!?\"'()[]{}#$%&*|-_~<>/\\+=@^`"


class Hasher:
    """Words, lower-cased and stripped of ASCII punctuation, as numbers; pieces[number] are the hash buckets of a word's pieces.

    Number 0 is no word (punctuation alone, or a text without words): its pieces are empty."""

    def __init__(self):
        self.reset()

    def reset(self) -> None:
        self.memo, self.rows = {}, []  # rows: of new words, not yet in table
        self.table = np.full((1, 1 + len(STEMS)), _NO_PIECE, np.int32)

    def _number(self, word: bytes) -> int:
        core = word.strip(_EDGE).decode("utf-8", "replace").lower()
        if not core:
            return 0
        stems = [_hash(core[:k], k) % BUCKETS for k in STEMS if k < len(core)]
        self.rows.append((_hash(core, 0) % BUCKETS, *stems, *[_NO_PIECE] * (len(STEMS) - len(stems))))
        return len(self.table) + len(self.rows) - 1

    def ids(self, texts: list[bytes | None]) -> list[np.ndarray]:
        memo = self.memo
        split = [(t or b"").lower().split() for t in texts]
        for w in {w for words in split for w in words} - memo.keys():
            memo[w] = self._number(w)
        return [np.fromiter((memo[w] for w in words), np.int32, len(words)) if words else np.zeros(1, np.int32) for words in split]

    def pieces(self) -> np.ndarray:
        if self.rows:
            self.table = np.concatenate([self.table, np.array(self.rows, np.int32)])
            self.rows = []
        return self.table


@dataclass
class Model:
    embedding: np.ndarray  # [BUCKETS + 1, DIM]; the last row, no piece, is zero
    filters: list[np.ndarray]  # per width: [width, DIM, FILTERS]
    bias: list[np.ndarray]
    out: np.ndarray
    offset: float
    scale: tuple[float, float] = (1.0, 0.0)
    thresholds: dict[str | None, float] = field(default_factory=dict)


def pooled(ids: list[np.ndarray], pieces: np.ndarray, model: Model, where: bool = False) -> tuple[np.ndarray, np.ndarray | None, np.ndarray, np.ndarray]:
    """Maxima over each text's windows [text, filter], their places (if asked for), the padded word numbers, and the
    embedding of each."""
    gap = np.zeros(len(WIDTHS) - 1, np.int32)
    flat = np.concatenate([x for t in ids for x in (t, gap)])
    starts = np.cumsum([0, *(len(t) + len(gap) for t in ids[:-1])])
    ends = starts + [len(t) for t in ids]
    kinds, place = np.unique(flat, return_inverse=True)
    words = model.embedding[pieces[kinds]].sum(1)[place]
    # All filters' products in one; a window's value is then a sum of its words' columns.
    each = words @ np.concatenate([f[o] for f in model.filters for o in range(len(f))], 1)
    n, at, sums = len(flat), 0, np.empty((len(flat), len(WIDTHS) * FILTERS), each.dtype)
    for j, f in enumerate(model.filters):
        a = sums[:, j * FILTERS : (j + 1) * FILTERS]
        for o in range(len(f)):
            part = each[o:, at : at + FILTERS]
            at += FILTERS
            if o:
                a[: n - o] += part
            else:
                a[:] = part
    if where:
        places = np.stack([s + sums[s:e].argmax(0) for s, e in zip(starts, ends, strict=True)])
        return np.take_along_axis(sums, places, 0), places, flat, words
    return np.maximum.reduceat(sums, np.stack([starts, ends], 1).ravel(), 0)[::2], None, flat, words


def logits(ids: list[np.ndarray], pieces: np.ndarray, model: Model) -> np.ndarray:
    top = pooled(ids, pieces, model)[0]
    return np.maximum(top + np.concatenate(model.bias), 0) @ model.out + model.offset


def _log_odds(ids: list[np.ndarray], y: np.ndarray, pieces: np.ndarray, share: float, prior: float = 4.0) -> np.ndarray:
    """Each bucket's log odds of toxic texts against all texts' odds, shrunk by prior texts of the usual kind."""
    counts = np.zeros((2, BUCKETS + 1))
    for t, label in zip(ids, y, strict=True):
        counts[int(label), np.unique(pieces[np.unique(t)])] += 1
    odds = np.log((counts[1] + prior * share) / (counts[0] + prior * (1 - share))) - np.log(share / (1 - share))
    odds[_NO_PIECE] = 0
    return odds


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _platt(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    a, b = 1.0, 0.0
    for _ in range(50):
        p = _sigmoid(a * x + b)
        g = np.array([((p - y) * x).sum() + 0.1 * (a - 1), (p - y).sum() + 0.1 * b])
        w = p * (1 - p)
        h = np.array([[(w * x * x).sum() + 0.1, (w * x).sum()], [(w * x).sum(), w.sum() + 0.1]])
        da, db = np.linalg.solve(h, g)
        a, b = a - np.clip(da, -1, 1), b - np.clip(db, -2, 2)
    return (float(a), float(b)) if a > 0 else (1.0, 0.0)


def gradients(model: Model, ids: list[np.ndarray], y: np.ndarray, pieces: np.ndarray, ridge: float = 1e-4) -> tuple[list[np.ndarray], float]:
    """Of the mean logistic loss (and ridge / 2 times out's square): by embedding, filters, biases and out; and by the offset."""
    weights, k = [model.embedding, *model.filters, *model.bias, model.out], len(WIDTHS)
    top, places, flat, words = pooled(ids, pieces, model, where=True)
    hidden = np.maximum(top + np.concatenate(model.bias), 0)
    error = (_sigmoid(hidden @ model.out + model.offset) - y) / len(y)
    back = np.outer(error, model.out) * (hidden > 0)
    grads = [np.zeros_like(w) for w in weights]
    for j, w in enumerate(WIDTHS):
        cols = slice(j * FILTERS, (j + 1) * FILTERS)
        for o in range(w):
            spot = np.minimum(places[:, cols] + o, len(flat) - 1)
            grads[1 + j][o] = np.einsum("bfd,bf->df", words[spot], back[:, cols])
            np.add.at(grads[0], pieces[flat[spot]], (back[:, cols, None] * model.filters[j][o].T[None])[:, :, None, :])
        grads[1 + k + j][:] = back[:, cols].sum(0)
    grads[-1][:] = hidden.T @ error + ridge * model.out
    grads[0][_NO_PIECE] = 0
    return grads, float(error.sum())


def train(ids: list[np.ndarray], y: np.ndarray, languages: list[str | None], pieces: np.ndarray, epochs: int = 4, batch: int = 32, rate: float = 0.01, seed: int = 7) -> Model:
    """Embeddings start from the log odds of pieces in 2 of 5 texts, one dimension for each kind of piece; Adam fits the network
    to 2 others, which these odds do not know; the last scales the scores (Platt) and sets each language's threshold.

    Without two classes the model is flat: it scores every text by the share of toxic ones."""
    rng = np.random.default_rng(seed)
    embedding = (rng.standard_normal((BUCKETS + 1, DIM)) * 0.02).astype(np.float32)
    filters = [(rng.standard_normal((w, DIM, FILTERS)) * 0.1).astype(np.float32) for w in WIDTHS]
    model = Model(embedding, filters, [np.zeros(FILTERS, np.float32) for _ in WIDTHS], np.zeros(len(WIDTHS) * FILTERS, np.float32), 0.0)
    share = float(np.clip(y.mean() if len(y) else 0.0, 0.01, 0.99))
    model.offset = float(np.log(share / (1 - share)))
    embedding[_NO_PIECE] = 0
    if len(y) < 10 or y.min() == y.max():
        return model
    order = rng.permutation(len(y))
    fifth = len(y) // 5
    known, learn, held = order[: 2 * fifth], order[2 * fifth : 4 * fifth], order[4 * fifth :]
    odds = _log_odds([ids[i] for i in known], y[known], pieces, share)
    for kind in range(pieces.shape[1]):  # buckets are shared by kinds, so that a bucket's odds go to the kinds that use it
        used = np.unique(pieces[:, kind])
        embedding[used, kind] = odds[used]
    embedding[_NO_PIECE] = 0
    for f in filters:
        f[:, : pieces.shape[1], :] = np.abs(f[:, : pieces.shape[1], :]) + 0.1
    model.out += 0.2
    for b in model.bias:
        b -= 0.5
    weights = [embedding, *filters, *model.bias, model.out]
    first, second = [np.zeros_like(w) for w in weights], [np.zeros_like(w) for w in weights]
    offset_state, step = [0.0, 0.0], 0
    for _ in range(epochs):
        for at in range(0, len(learn), batch):
            part = learn[at : at + batch]
            grads, error = gradients(model, [ids[i] for i in part], y[part], pieces)
            step += 1
            for w, g, m, v in zip(weights, grads, first, second, strict=True):
                m += 0.1 * (g - m)
                v += 0.01 * (g * g - v)
                w -= (rate * (0.1 if w is embedding else 1)) * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-6)
            g = error
            offset_state = [offset_state[0] + 0.1 * (g - offset_state[0]), offset_state[1] + 0.01 * (g * g - offset_state[1])]
            model.offset -= rate * (offset_state[0] / (1 - 0.9**step)) / ((offset_state[1] / (1 - 0.99**step)) ** 0.5 + 1e-6)
        learn = rng.permutation(learn)
    raw = np.concatenate([logits([ids[i] for i in held[a : a + 256]], pieces, model) for a in range(0, len(held), 256)])
    model.scale = _platt(raw, y[held])
    score = _sigmoid(model.scale[0] * raw + model.scale[1])
    for lang in {*languages}:
        mine = np.array([languages[i] == lang for i in held])
        model.thresholds[lang] = _threshold(score[mine], y[held][mine])
    return model


def _threshold(score: np.ndarray, y: np.ndarray, prior: float = 2.0) -> float:
    """The threshold with the best F1 on these; ties and few examples go to THRESHOLD."""
    best, at = -1.0, THRESHOLD
    for t in sorted(np.linspace(0.05, 0.95, 19), key=lambda t: abs(t - THRESHOLD)):
        hit, said = ((score >= t) & (y == 1)).sum(), (score >= t).sum()
        f1 = 2 * (hit + prior) / (said + (y == 1).sum() + 2 * prior)
        if f1 > best + 1e-9:
            best, at = f1, float(round(t, 2))
    return at


@tidy
def _score(batches: Iterator[pa.RecordBatch], model: Model) -> Iterator[pa.RecordBatch]:
    hasher = Hasher()
    for batch in batches:
        texts = batch.column(0).cast(pa.binary()).to_pylist()
        for a, b in chunks(texts):
            if len(hasher.memo) > MEMO:
                hasher.reset()
            ids = hasher.ids(texts[a:b])
            z = logits(ids, hasher.pieces(), model)
            score = pa.array(_sigmoid(model.scale[0] * z.astype(np.float64) + model.scale[1]))
            yield pa.RecordBatch.from_arrays([*(c[a:b] for c in batch.columns[1:]), score], names=["doc_id", "lang", "score"])


@tidy
def _train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One task trains, as the sample is bounded; the driver gets the model only. Rows are taken in the order of doc_id."""
    hasher, rows = Hasher(), []
    for batch in batches:
        ids = hasher.ids(batch.column(0).cast(pa.binary()).to_pylist())
        rows += zip(batch.column(3).to_pylist(), (t.tobytes() for t in ids), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)
    hasher.memo.clear()
    if rows:
        rows.sort(key=lambda r: (r[0], len(r[1]), r[2]))
        model = train([np.frombuffer(r[1], np.int32) for r in rows], np.array([r[2] for r in rows]), [r[3] for r in rows], hasher.pieces())
        yield pa.RecordBatch.from_pydict({"model": pa.array([pickle.dumps(model)], pa.binary())})


def held_out_rows():
    return F.coalesce(F.pmod(crc32_text("doc_id"), F.lit(4)) == 2, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, max_train: int = MAX_TRAIN) -> Model:
    """Train on at most max_train labelled rows that are not held out."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("double").alias("y")).where("doc_id is not null and y is not null")
    known = known.where(~held_out_rows()).groupBy("doc_id").agg(F.max("y").alias("y")).withColumn("h", F.xxhash64("doc_id"))
    # By a count the share of labels that is about to be the sample; so each task hands on its part of it only.
    share = min(1.0, 1.2 * max_train / max(1, known.count()))
    chosen = settle(known.where(F.col("h") <= F.lit(min(2**63 - 1, int((2 * share - 1) * 2**63)))).orderBy("h", "doc_id").limit(max_train).drop("h"), "sample")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.struct(F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang")).alias("said"))
    one = texts.join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "y").agg(F.min_by("said", F.xxhash64("said")).alias("said"))
    rows = one.select("said.text", "y", "said.lang", "doc_id").repartition(1).mapInArrow(_train, "model binary")
    found = rows.first()
    release(chosen)
    return pickle.loads(found[0]) if found else train([], np.zeros(0), [], Hasher().pieces())


def score_documents(docs: DataFrame, labels: DataFrame, max_train: int = MAX_TRAIN) -> DataFrame:
    """(doc_id, held_out, score, predicted, lang_threshold, flagged) for each row of docs (doc_id, text, lang).

    Only the text makes the score. held_out: crc32 of doc_id as text, modulo 4, is 2; such rows' labels are never used.
    predicted: score >= 0.3; flagged: score >= the threshold of the row's language (an unseen one: 0.3). Null or blank
    text is scored like a text without words; null doc_ids are not held out; repeated rows repeat; labels with nulls are
    skipped; without labels of both kinds every score is the same. Empty docs: empty result."""
    model = fit(docs, labels, max_train)
    source = docs.select(F.col("text").cast("string").alias("text"), F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"))
    rows = source.mapInArrow(partial(_score, model=model), "doc_id long, lang string, score double")
    limit = F.lit(THRESHOLD)
    for lang, t in sorted(model.thresholds.items(), key=lambda x: str(x[0])):
        limit = F.when(F.col("lang").eqNullSafe(F.lit(lang)), F.lit(t)).otherwise(limit)
    rows = rows.withColumn("lang_threshold", limit)
    return rows.select(
        "doc_id", held_out_rows().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), "lang_threshold", (F.col("score") >= F.col("lang_threshold")).alias("flagged")
    )
