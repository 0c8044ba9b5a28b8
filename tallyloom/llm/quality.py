"""Quality classifier with hierarchical empirical Bayes over hosts and paths.

A logistic model on surface features gives each document's own evidence. Sums of its probabilities per host and per path
give posteriors that shrink toward the level above (path -> host -> all), the more the fewer documents a site has; how
much is estimated from the spread between sites (method of moments). A document's score joins its evidence with its path's
posterior, from which its own share is left out."""

from __future__ import annotations

import math
from collections.abc import Iterator
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lookup, release, settle, tidy, without
from .superminhash import chunks

#: At most so many labelled documents, the first by a hash of doc_id, are used to fit the model.
MAX_TRAIN = 20_000
#: Under even odds, as losing a clean document costs more than keeping a poor one.
THRESHOLD = 0.3

_LETTERS = bytes(range(65, 91)) + bytes(range(97, 123)) + bytes(range(128, 256))
_UPPER, _DIGITS = bytes(range(65, 91)), bytes(range(48, 58))
_PLAIN = _LETTERS + _DIGITS + b" \t\r\n\x0b\x0c.,;:'\"-()?"
N_FEATURES = 12


def features(text: bytes) -> list[float]:
    words = text.split()
    n, k = len(text), len(words)
    if not k:
        return [1.0, *[0.0] * (N_FEATURES - 2), 1.0]
    share = lambda drop: (n - len(text.translate(None, drop))) / n
    letters, kinds = share(_LETTERS), len({*words})
    lines = [x for x in text.split(b"\n") if x]
    again = sum(map(eq, words, words[1:])) / k
    odd = 1 - share(_PLAIN)
    return [
        1.0,
        min(1.0, 10 * odd),
        odd,
        min(1.0, 5 * share(_DIGITS)),
        share(_UPPER) / max(letters, 1e-9),
        min(1.0, 20 * share(b"!")),
        min(1.0, 5 * again),
        math.log(kinds) / math.log(k) if k > 1 else 1.0,
        min(2.0, n / k / 8),
        min(1.5, math.log1p(k) / 8),
        1 - len({*lines}) / len(lines),
        0.0,
    ]


@tidy
def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = batch.column(3).cast(pa.binary()).to_pylist()
        for a, b in chunks(texts):
            rows = np.array([features(t or b"") for t in texts[a:b]]).reshape(-1, N_FEATURES)
            offsets = pa.array(np.arange(0, rows.size + 1, N_FEATURES, dtype=np.int32))
            x = pa.ListArray.from_arrays(offsets, pa.array(rows.ravel()))
            yield pa.RecordBatch.from_arrays([*(batch.column(i)[a:b] for i in range(3)), batch.column(4)[a:b], x], names=["doc_id", "host", "path", "text_hash", "x"])


def fit(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2, rounds: int = 30) -> np.ndarray:
    """Ridge logistic regression by Newton's method; a flat model where there is nothing to learn."""
    w = np.zeros(x.shape[1] if x.size else N_FEATURES)
    if not len(y):
        return w
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p) + 1e-6)[:, None]).T @ x + ridge * np.eye(x.shape[1]), x.T @ (p - y) + ridge * w)
        w -= step
        if np.abs(step).max() < 1e-7:
            break
    return w


def _logit(p):
    p = F.greatest(F.lit(1e-6), F.least(F.lit(1 - 1e-6), p))
    return F.log(p / (1 - p))


def _strength(mean: float, spread: float, noise: float) -> float:
    """Pseudo-count of a Beta prior with this mean whose sites differ by spread, of which noise is due to small sites."""
    between = max(spread - noise, 1e-9)
    return float(min(1e4, max(1.0, mean * (1 - mean) / between - 1)))


def score_documents(docs: DataFrame, labels: DataFrame, host: str = "source", path: str = "lang", max_train: int = MAX_TRAIN, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, evidence, host_posterior, path_posterior, score, kept, text_hash) for each row of docs.

    docs: doc_id, text and the columns host and path; labels: doc_id, quality (others are not read; rows with a null
    in either are skipped). evidence is the model's log odds, score the posterior probability of good quality, kept
    = score >= threshold. Null hosts and paths are sites of their own; a null text has the features of an empty one.
    Repeated rows are scored alike. Without labels the model is flat (evidence 0). Empty docs: empty result."""
    source = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col(host).cast("string").alias("host"), F.col(path).cast("string").alias("path"),
        F.col("text").cast("string").alias("text"), F.xxhash64(F.col("text").cast("string")).alias("text_hash"),
    )
    seen = settle(source.mapInArrow(_features, "doc_id long, host string, path string, text_hash long, x array<double>"), "features")
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("double").alias("y")).where("doc_id is not null and y is not null")
    # The share of rows that is about to be the sample is found by a count, so that no task sends the driver more than its part.
    joined = seen.join(known, "doc_id").groupBy("doc_id", "text_hash").agg(F.first("x").alias("x"), F.max("y").alias("y")).withColumn("h", F.xxhash64("doc_id", "text_hash"))
    joined = settle(joined, "labelled")
    share = min(1.0, 1.2 * max_train / max(1, joined.count()))
    sample = joined.where(F.col("h") <= F.lit(min(2**63 - 1, int((2 * share - 1) * 2**63)))).orderBy("h", "doc_id").limit(max_train)
    rows = sample.select("x", "y").toPandas()
    release(joined)
    w = fit(np.stack(rows["x"].to_numpy()) if len(rows) else np.zeros((0, N_FEATURES)), rows["y"].to_numpy())
    base = float(np.clip(rows["y"].mean(), 1e-3, 1 - 1e-3)) if len(rows) else 0.5
    evidence = sum((F.col("x")[i] * float(v) for i, v in enumerate(w)), F.lit(0.0))
    scored = seen.select("doc_id", "host", "path", "text_hash", F.least(F.lit(12.0), F.greatest(F.lit(-12.0), evidence)).alias("evidence"))
    scored = settle(scored.withColumn("p", 1 / (1 + F.exp(-F.col("evidence")))), "evidence")

    paths = settle(scored.groupBy("host", "path").agg(F.count(F.lit(1)).alias("n"), F.sum("p").alias("s")), "paths")
    hosts = settle(paths.groupBy("host").agg(F.sum("n").alias("host_n"), F.sum("s").alias("host_s"), F.count(F.lit(1)).alias("n_paths")), "hosts")
    n, s = hosts.agg(F.sum("host_n"), F.sum("host_s")).first()
    if not n:
        return scored.select("doc_id", "evidence", *[F.lit(0.0).alias(c) for c in ("host_posterior", "path_posterior", "score")], F.lit(True).alias("kept"), "text_hash")
    mean = min(1 - 1e-3, max(1e-3, s / n))
    apart = hosts.agg(F.sum(F.col("host_n") * (F.col("host_s") / F.col("host_n") - mean) ** 2) / n, F.count(F.lit(1))).first()
    k_host = _strength(mean, apart[0], mean * (1 - mean) * apart[1] / n)
    upper = (F.col("host_s") + k_host * mean) / (F.col("host_n") + k_host)
    sites = lookup(paths, hosts, ["host"], "n_paths", F.col("path"))
    apart = sites.agg(F.sum(F.col("n") * (F.col("s") / F.col("n") - upper) ** 2) / n, F.count(F.lit(1))).first()
    k_path = _strength(mean, apart[0], mean * (1 - mean) * apart[1] / n)
    sites = settle(sites.withColumn("n_docs", F.col("n")), "sites")
    release(seen, paths, hosts)

    both = lookup(scored, sites, ["host", "path"], "n_docs", F.col("text_hash"))
    by_host = (F.col("host_s") - F.col("p") + k_host * mean) / (F.col("host_n") - 1 + k_host)
    by_path = (F.col("s") - F.col("p") + k_path * F.col("host_posterior")) / (F.col("n") - 1 + k_path)
    both = both.withColumn("host_posterior", by_host).withColumn("path_posterior", by_path)
    score = 1 / (1 + F.exp(-(F.col("evidence") - math.log(base / (1 - base)) + _logit(F.col("path_posterior")))))
    return both.withColumn("score", score).select(
        "doc_id", "evidence", "host_posterior", "path_posterior", "score", (F.col("score") >= threshold).alias("kept"), "text_hash"
    )


def keep_good(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """docs without the rows that score_documents rejects; all columns stay, whatever their names.

    Null texts are judged as empty ones, null doc_ids as any; of repeated rows all stay or go. Empty table: empty result."""
    bad = score_documents(docs, labels, **options).where(~F.col("kept")).select(F.col("doc_id").alias("_own_id"), F.col("text_hash").alias("_own_hash")).distinct()
    return without(docs, settle(bad, "rejected"))
