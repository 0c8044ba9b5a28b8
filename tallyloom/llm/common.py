"""What the training-text operators share: tables, the shared folder, cut lineage, hot keys."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable
from contextlib import suppress
from functools import reduce, wraps
from operator import and_

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.shared import new_path

#: White space that separates words: \x20 and \x09-\x0D, which is what bytes.split() splits on.
SPACE_CLASS = r"[\x20\x09-\x0D]+"
WORD_CLASS = r"[^\x20\x09-\x0D]+"

#: A key with more than 1/HOT_SHARE of all rows is hot, so that there are fewer than HOT_SHARE hot keys.
HOT_SHARE = 1000


ARROW_BYTES = 8 << 20


def small_batches(spark: SparkSession) -> None:
    """Arrow batches of ARROW_BYTES for this session, unless it has its own limit: whole texts can be long, and the JVM and
    Python each hold batches outside the heap."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(name) in ("64MB", "67108864b", "67108864"):
        spark.conf.set(name, str(ARROW_BYTES))


def tidy(f: Callable) -> Callable:
    """Of a function over Arrow batches: at the end of a task its worker, which waits for the next one, gives memory back."""

    @wraps(f)
    def run(*args, **options):
        yield from f(*args, **options)
        gc.collect()
        pa.default_memory_pool().release_unused()
        with suppress(OSError, AttributeError):  # only where the C library is the usual one
            ctypes.CDLL(None).malloc_trim(0)

    return run


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def settle(df: DataFrame, label: str, fmt: str = "parquet", **options: str) -> DataFrame:
    """Write df into the shared folder and read it again: cuts the lineage, survives lost executors, and lets
    the planner see the true size (a later join broadcasts it only below spark.sql.autoBroadcastJoinThreshold)."""
    spark = df.sparkSession
    small_batches(spark)
    path = new_path(spark, label)
    df.write.format(fmt).options(**options).save(path)
    out = spark.read.schema(df.schema).format(fmt).load(path)
    out.settled_at = path
    return out


def release(*frames: DataFrame) -> None:
    """Delete settled tables that nothing reads any more, and let Spark drop the shuffles behind them."""
    for df in frames:
        jvm, sc = df.sparkSession._jvm, df.sparkSession.sparkContext
        p = jvm.org.apache.hadoop.fs.Path(df.settled_at)
        p.getFileSystem(sc._jsc.hadoopConfiguration()).delete(p, True)


def hot_keys(counts: DataFrame, keys: list[str], count: str = "n", share: int = HOT_SHARE) -> DataFrame:
    """The rows of counts (one per key) whose count is over 1/share of all: fewer than share rows at any size."""
    total = counts.agg(F.sum(count)).first()[0] or 0
    return counts.where(F.col(count) > F.lit(max(1, total // share)))


def lookup(left: DataFrame, right: DataFrame, keys: list[str], count: str, spread: Column) -> DataFrame:
    """left with right's other columns (null where right has no such keys); null keys match each other.

    right has one row per key and in column count how many rows of left have it (dropped); it is read twice, so it
    should be settled. Hot keys (fewer than HOT_SHARE of them, by their definition) are looked up in a broadcast, and
    their rows are then dealt out by spread, an expression over left, instead of by the key; the others meet in a
    join that Spark plans by size."""
    values = [c for c in right.columns if c not in (*keys, count)]
    hot = hot_keys(right, keys, count).select(
        *[F.col(k).alias(f"_h_{k}") for k in keys], *[F.col(v).alias(f"_h_{v}") for v in values], F.lit(True).alias("_hot")
    )
    rest = right.select(*[F.col(k).alias(f"_k_{k}") for k in keys], *values, F.lit(0).alias("_k_salt"))
    same = lambda prefix: [F.col(k).eqNullSafe(F.col(f"{prefix}{k}")) for k in keys]
    found = left.join(F.broadcast(hot), reduce(and_, same("_h_")), "left")
    salt = F.when(F.col("_hot"), F.pmod(F.xxhash64(spread), F.lit(1 << 20)).cast("int") + 1).otherwise(F.lit(0))
    both = found.withColumn("_salt", salt).join(rest, reduce(and_, [*same("_k_"), F.col("_salt") == F.col("_k_salt")]), "left")
    return both.select(*left.columns, *[F.when(F.col("_hot"), F.col(f"_h_{v}")).otherwise(F.col(v)).alias(v) for v in values])


#: A bit filter has 2^FILTER_BITS bits at any number of keys, in numbers of 64: at most 2^20 rows, 16 MB.
FILTER_BITS = 26


def fresh(df: DataFrame, name: str) -> str:
    """name, or name with underscores in front if df has such a column."""
    while name.lower() in (c.lower() for c in df.columns):
        name = f"_{name}"
    return name


def bit_filter(keys: DataFrame, hashed: Column) -> DataFrame:
    """Settled (word, bits) of a filter of fixed size that every row of keys passes by its hash, a long."""
    at = keys.select(F.shiftrightunsigned(hashed, 64 - FILTER_BITS).alias("at"))
    return settle(at.groupBy(F.expr("at >> 6").alias("word")).agg(F.expr("bit_or(shiftleft(1L, int(at & 63)))").alias("bits")), "filter")


def sift(df: DataFrame, filtered: DataFrame, hashed: Column) -> tuple[DataFrame, DataFrame]:
    """df's rows that the filter lets pass, and the others, whose keys surely are not in it; no row is shuffled."""
    at, word, bits = (fresh(df, x) for x in ("_at", "_word", "_bits"))
    words = filtered.select(F.col("word").alias(word), F.col("bits").alias(bits))
    placed = df.withColumn(at, F.shiftrightunsigned(hashed, 64 - FILTER_BITS))
    met = placed.join(F.broadcast(words), F.shiftright(F.col(at), 6) == F.col(word), "left")
    passes = F.coalesce(F.expr(f"shiftrightunsigned(`{bits}`, int(`{at}` & 63)) & 1"), F.lit(0)) == 1
    return met.where(passes).select(*df.columns), met.where(~passes).select(*df.columns)


def row_hash(df: DataFrame) -> Column:
    """One hash of doc_id and text, which tell rows of documents apart."""
    return F.xxhash64(df["doc_id"].cast("long"), F.xxhash64(df["text"].cast("string")))


def same_row(df: DataFrame, keys: DataFrame) -> Column:
    return df["doc_id"].cast("long").eqNullSafe(keys["_own_id"]) & (F.xxhash64(df["text"].cast("string")) == keys["_own_hash"])


def without(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """docs (doc_id, text and any others) without the rows that gone (_own_id, _own_hash of the text; settled) names.

    Rows that a bit filter of gone rules out are not shuffled; only the others meet gone, the same way at any size."""
    hashed = F.xxhash64("_own_id", "_own_hash")
    maybe, stay = sift(docs, bit_filter(gone, hashed), row_hash(docs))
    return stay.unionByName(maybe.join(gone.hint("merge"), same_row(maybe, gone), "left_anti"))


def crc32_text(column: str):
    """crc32 of an integer's decimal text, as zlib has it."""
    return F.crc32(F.col(column).cast("string").cast("binary"))
