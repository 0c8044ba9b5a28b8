"""Consecutive numbers in a given order, without a window over all rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def numbered(df: DataFrame, order: Sequence[str], first: int, name: str) -> DataFrame:
    """df with column name: numbers from first on, in the given order; ties go by all that can be hashed, so that a partition
    that is computed again numbers its rows as before. Of rows, only a count per partition comes to the driver."""
    hashed = [F.col(f"`{f.name}`") for f in df.schema.fields if not isinstance(f.dataType, T.MapType)]
    placed = df.orderBy(*order, F.xxhash64(*hashed)).withColumn("_part", F.spark_partition_id()).withColumn("_at", F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)).persist()
    base, done = [], first
    for part, n in sorted((r["_part"], r["count"]) for r in placed.groupBy("_part").count().collect()):
        base.append((part, done))
        done += n
    starts = df.sparkSession.createDataFrame(base, "_part int, _base long")
    return placed.join(F.broadcast(starts), "_part").withColumn(name, F.col("_at") + F.col("_base")).drop("_part", "_at", "_base")


def numbered_by(df: DataFrame, key: str, order: Sequence[str], name: str) -> DataFrame:
    """df with column name: numbers from 0 on within each key, in the given order. A key with most of the rows is as good as many."""
    ranked = numbered(df, [key, *order], 0, "_rank")
    least = ranked.groupBy(F.col(key).alias("_key")).agg(F.min("_rank").alias("_least"))
    return ranked.join(least, ranked[key].eqNullSafe(least["_key"])).withColumn(name, F.col("_rank") - F.col("_least")).drop("_key", "_least", "_rank")
