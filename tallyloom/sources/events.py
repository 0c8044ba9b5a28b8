"""Events and profiles from plain tables, in the event model's columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..catalog import DECIMAL


def clickstream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events.parquet: value is the event's decimal property, k a number from its JSON properties, and some derived ones."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    k = F.get_json_object("props", "$.k").cast("int")
    return e.select(
        F.lit(1).cast("long").alias("project_id"), F.col("user_id").alias("group_0"), F.col("ts").cast("timestamp_ntz").alias("created_at"), "event_id", F.col("event_type").alias("event"),
        F.col("value").cast(DECIMAL).alias("value"), k.alias("k"), (k % 2 == 0).alias("even"), F.when(k % 3 == 0, F.lit(None)).when(k % 3 == 1, True).otherwise(False).alias("flag"),
        F.when(k < 50, F.lit("low")).when(k < 90, F.lit("high")).alias("band"), (F.col("user_id") % 3).cast("string").alias("plan"),
    )


def orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """orders.parquet with its customer and nation as denormalised group properties."""
    o, c, n = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("orders", "customer", "nation"))
    wide = o.join(c, F.col("o_custkey") == F.col("c_custkey")).join(n, F.col("c_nationkey") == F.col("n_nationkey"))
    return wide.select(
        F.lit(1).cast("long").alias("project_id"), F.col("o_custkey").alias("group_0"), F.col("c_nationkey").cast("long").alias("group_1"), F.col("o_orderdate").cast("timestamp_ntz").alias("created_at"),
        F.col("o_orderkey").alias("event_id"), F.concat(F.lit("Order "), F.col("o_orderstatus")).alias("event"), F.col("o_totalprice").cast(DECIMAL).alias("price"), F.col("o_orderpriority").alias("priority"),
        F.col("c_mktsegment").alias("segment_name"), F.col("n_name").alias("nation"),
    )


def customer_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Versions of each customer's profile: 1 + key % 3 of them, three days apart, the balance growing with the version."""
    c = spark.read.parquet(f"{sf_dir}/customer.parquet")
    v = F.explode(F.sequence(F.lit(1), (F.col("c_custkey") % 3 + 1).cast("int")))
    return c.select("*", v.alias("version")).select(
        F.lit(1).cast("long").alias("project_id"), F.col("c_custkey").alias("id"), F.col("version").cast("long").alias("version"),
        (F.lit("2024-01-01").cast("timestamp_ntz") + F.make_dt_interval(days=(F.col("c_custkey") % 20 + 3 * (F.col("version") - 1)).cast("int"))).alias("created_at"),
        F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment_name"), (F.col("c_acctbal") + F.col("version") * 100).alias("balance"),
    )


def latest(versions: DataFrame, keys: tuple[str, ...] = ("project_id", "id"), version: str = "version") -> DataFrame:
    """The row of each key with the greatest version, by a partial aggregate; equal versions: any one of them."""
    values = [c for c in versions.columns if c not in keys]
    best = versions.groupBy(*keys).agg(F.max_by(F.struct(*values), version).alias("_row"))
    return best.select(*keys, "_row.*").select(*versions.columns)


def as_of(events: DataFrame, versions: DataFrame, group: str = "group_0") -> DataFrame:
    """events with the profile that was valid at created_at, as columns profile_<name>; null before the first version.

    A union and a running last value: one shuffle by id, no join on a range."""
    props = [c for c in versions.columns if c not in ("project_id", "id", "created_at")]
    left = events.select(F.col(group).alias("_id"), F.col("created_at").alias("_t"), F.lit(1).alias("_side"), F.struct(*events.columns).alias("_e"))
    right = versions.select(F.col("id").alias("_id"), F.col("created_at").alias("_t"), F.lit(0).alias("_side"), F.struct(*props).alias("_p"))
    both = left.unionByName(right, allowMissingColumns=True)
    order = Window.partitionBy("_id").orderBy("_t", "_side", F.col("_p.version") if "version" in props else F.lit(0)).rowsBetween(Window.unboundedPreceding, 0)
    seen = both.withColumn("_p", F.last("_p", ignorenulls=True).over(order)).where("_side = 1")
    return seen.select("_e.*", *[F.col(f"_p.{c}").alias(f"profile_{c}") for c in props])
