"""Collapse of logged snapshots: a conversation that another one continues is dropped before rendering."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import release, settle

#: What surrounds a turn in the rendered text.
OPEN, MIDDLE, CLOSE = "<|im_start|>", "\n", "<|im_end|>\n"


def _turn_hash(seed: int):
    return F.xxhash64(F.lit(seed), F.col("role").isNull(), F.coalesce("role", F.lit("")), F.col("text").isNull(), F.coalesce("text", F.lit("")))


def _base(turns: DataFrame) -> DataFrame:
    """Typed turns with their hashes, and conv: which conversation a turn is of. Without a conv_id a turn is one by itself."""
    typed = turns.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text")
    )
    hashed = typed.withColumn("h1", _turn_hash(1)).withColumn("h2", _turn_hash(2))
    lone = lambda c: F.when(F.col("conv_id").isNull(), F.col(c)).alias(c)
    return hashed.withColumn("conv", F.struct("conv_id", lone("turn"), lone("h1"), lone("h2")))


def prefix_hashes(turns: DataFrame) -> DataFrame:
    """Settled (conv, i, last, p1, p2): the rolling hash of a conversation's first i turns, and whether it has no more.

    The hash is the exclusive or of hashes of (position, role, text), 128 bits, so that it rolls on by one term a turn. Only hashes
    are shuffled, never the text. Turns are sorted over all tasks and scanned part by part, however long a conversation is;
    what goes on from part to part, one row each, is added up on the driver."""
    spark = turns.sparkSession
    light = _base(turns).select("conv", "turn", "h1", "h2").distinct().orderBy("conv", "turn", "h1", "h2")
    placed = settle(light.withColumn("part", F.spark_partition_id()).withColumn("at", F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)), "turns")
    order = Window.partitionBy("part").orderBy("at")
    upto = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    starts = (F.col("at") > 0) & ~F.col("conv").eqNullSafe(F.lag("conv").over(order))  # where a conversation begins inside its part
    scanned = placed.withColumn("from", F.max(F.when(starts, F.col("at"))).over(upto)).withColumn("last", ~F.coalesce(F.lead("conv").over(order).eqNullSafe(F.col("conv")), F.lit(False)))
    ends = scanned.groupBy("part").agg(F.count(F.lit(1)).alias("n"), F.min_by("conv", "at").alias("head"), F.max_by("conv", "at").alias("tail"), F.max("from").alias("from"))
    goes_on, before, carried, held, tail = set(), None, {}, 0, None
    for r in sorted(ends.collect(), key=lambda r: r["part"]):  # one row a part
        same = tail is not None and tail == r["head"]
        carried[r["part"]] = held if same else 0
        if same:
            goes_on.add(before)
        held = (r["n"] if r["from"] is None else r["n"] - r["from"]) + (held if same and r["from"] is None else 0)
        before, tail = r["part"], r["tail"]
    if not carried:
        release(placed)
        return settle(spark.createDataFrame([], "conv struct<conv_id:long,turn:long,h1:long,h2:long>, i long, last boolean, p1 long, p2 long"), "prefixes")
    parts = spark.createDataFrame([(p, c, p in goes_on) for p, c in carried.items()], "part int, carried long, goes_on boolean")
    own = F.col("at") - F.coalesce("from", F.lit(0)) + 1
    numbered = scanned.join(F.broadcast(parts), "part").withColumn("i", own + F.when(F.col("from").isNull(), F.col("carried")).otherwise(0))
    tail_row = F.col("at") == F.max("at").over(Window.partitionBy("part"))
    numbered = numbered.withColumn("last", F.col("last") & ~(F.col("goes_on") & tail_row))
    numbered = numbered.select("part", "at", "conv", "from", "i", "last", F.xxhash64("i", "h1").alias("t1"), F.xxhash64("i", "h2").alias("t2"))
    numbered = settle(numbered, "numbered")
    segment = Window.partitionBy("part", "from").orderBy("at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rolled = numbered.withColumn("p1", F.bit_xor("t1").over(segment)).withColumn("p2", F.bit_xor("t2").over(segment))
    sums = numbered.groupBy("part").agg(F.max("from").alias("from")).withColumnRenamed("from", "_from")
    sums = numbered.join(F.broadcast(sums), "part").where(F.col("from").eqNullSafe(F.col("_from"))).groupBy("part", "_from").agg(F.bit_xor("t1").alias("x1"), F.bit_xor("t2").alias("x2"))
    into, x1, x2 = [], 0, 0
    for r in sorted(sums.collect(), key=lambda r: r["part"]):
        into.append((r["part"], x1 if carried[r["part"]] else 0, x2 if carried[r["part"]] else 0))
        x1, x2 = (r["x1"] ^ into[-1][1], r["x2"] ^ into[-1][2]) if r["_from"] is None else (r["x1"], r["x2"])
    carry = spark.createDataFrame(into, "part int, c1 long, c2 long")
    first = F.col("from").isNull()
    rolled = rolled.join(F.broadcast(carry), "part")
    out = rolled.select("conv", "i", "last", *[F.col(p).bitwiseXOR(F.when(first, F.col(c)).otherwise(F.lit(0))).alias(p) for p, c in (("p1", "c1"), ("p2", "c2"))])
    out = settle(out, "prefixes")
    release(placed, numbered)
    return out


def maximal(turns: DataFrame) -> DataFrame:
    """Settled (conv, conv_id, n_turns, copies): one conversation of each content that no longer one continues."""
    rows = prefix_hashes(turns)
    first = F.struct(F.col("conv.conv_id").isNull(), "conv")
    whole = rows.where("last").groupBy("i", "p1", "p2").agg(F.min_by("conv", first).alias("conv"), F.count(F.lit(1)).alias("copies"))
    longer = rows.where("NOT last").select("i", "p1", "p2").distinct()
    kept = whole.join(longer, ["i", "p1", "p2"], "left_anti").select("conv", "conv.conv_id", F.col("i").alias("n_turns"), "copies")
    kept = settle(kept, "maximal")
    release(rows)
    return kept


def collapse(turns: DataFrame) -> DataFrame:
    """(conv_id, n_turns, copies, text) of each maximal conversation of turns (conv_id, turn, role, text; others not read).

    A conversation goes if its turns are the first turns of a longer one; of equal ones the smallest conv_id stays, and
    copies counts them. Turns stand in the order of turn, ties in that of a hash; repeated rows of a conversation count
    once. A row without a conv_id is a conversation of one turn, which stays under a null id unless an equal one has an id. Null
    role or text is different from an empty one, but renders as empty. Empty table: empty result."""
    kept = maximal(turns)
    rows = _base(turns)
    chosen = rows.join(kept.select(F.col("conv").alias("_conv"), "n_turns", "copies"), rows["conv"].eqNullSafe(F.col("_conv"))).drop("_conv")
    said = F.array_sort(F.collect_set(F.struct("turn", "h1", "h2", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))))
    grouped = chosen.groupBy("conv", "n_turns", "copies").agg(said.alias("said"))
    shown = F.transform("said", lambda x: F.concat(F.lit(OPEN), x["role"], F.lit(MIDDLE), x["text"], F.lit(CLOSE)))
    return grouped.select("conv.conv_id", "n_turns", "copies", F.array_join(shown, "").alias("text"))


ORACLE = r"""
WITH t AS (SELECT *, CASE WHEN conv_id IS NULL THEN row_number() OVER () END AS lone FROM (SELECT DISTINCT conv_id, turn, role, text FROM conversations)),
p AS (
  SELECT *, row_number() OVER w AS i, count(*) OVER (PARTITION BY conv_id, lone) AS n,
    string_agg(coalesce(length(role)::VARCHAR || ':' || role, '-') || coalesce(length(text)::VARCHAR || ':' || text, '-'), '|') OVER w AS k
  FROM t WINDOW w AS (PARTITION BY conv_id, lone ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
whole AS (SELECT k, n, min(conv_id) AS conv_id, CASE WHEN min(conv_id) IS NULL THEN min(lone) END AS lone, count(*) AS copies FROM p WHERE i = n GROUP BY k, n),
kept AS (SELECT * FROM whole WHERE NOT EXISTS (SELECT 1 FROM p WHERE p.i < p.n AND p.i = whole.n AND p.k = whole.k))
SELECT kept.conv_id, kept.n AS n_turns, kept.copies,
  string_agg('<|im_start|>' || coalesce(t.role, '') || chr(10) || coalesce(t.text, '') || '<|im_end|>' || chr(10), '' ORDER BY t.turn) AS text
FROM kept JOIN t ON t.conv_id IS NOT DISTINCT FROM kept.conv_id AND t.lone IS NOT DISTINCT FROM kept.lone GROUP BY kept.conv_id, kept.n, kept.copies, kept.lone
"""
