"""Mix sources to target weights by a low-discrepancy schedule of equal-token blocks.

Each source's documents, in a hashed order, form a stream of words that is cut into blocks of equal size. The mix is a
sequence of slots, one block each. Slot t holds the point t * a mod N of a golden-ratio lattice (a: the integer next
to 0.618 N that has no factor in common with N); as this visits each of the N points once, every source owns exactly
its quota of slots, evenly spread. Ranks of slots within a source tell which block a slot takes."""

from __future__ import annotations

from math import gcd, isqrt, sqrt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD_CLASS, fresh, lookup, release, settle

#: Sources in code-point order weigh these, repeating.
WEIGHTS = (5, 2, 1)
#: Words in a block, before it is fitted to its source.
BLOCK_WORDS = 1024


def _wide(x: str) -> str:
    return f"CAST({x} AS DECIMAL(19, 0))"


def _numbered(df: DataFrame, order: Column, label: str) -> DataFrame:
    """df, settled, with column at: its rank in order from 0. Only one count per partition comes to the driver."""
    placed = df.orderBy(order).withColumn("part", F.spark_partition_id()).withColumn("at", F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1))
    kept = settle(placed, label)
    base, done = {}, 0
    for part, n in sorted((r["part"], r["count"]) for r in kept.groupBy("part").count().collect()):
        base[part], done = done, done + n
    if not base:
        return kept.drop("part")
    bases = kept.sparkSession.createDataFrame(list(base.items()), "part int, base long")
    return kept.join(F.broadcast(bases), "part").withColumn("at", F.col("at") + F.col("base")).drop("part", "base")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = 1.5, most: float = 2.0) -> DataFrame:
    """sizes (source, size): settled (source, n_docs, sid, source_size, target); sid is the source's rank.

    Targets are share of all sizes, by weight, at most `most` times the source's size; what is over goes to the others by
    weight until none is above. Each pass is one aggregate over the sources and can only add to those at their limit."""
    grouped = sizes.groupBy("source").agg(F.count(F.lit(1)).alias("n_docs"), F.sum("size").alias("source_size"))
    named = settle(_numbered(grouped, F.col("source").asc_nulls_last(), "ranks"), "sources")
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(F.col("at"), F.lit(len(weights))) + 1).cast("int"))
    named = named.withColumn("weight", weight)
    limit = F.col("source_size") * F.lit(float(most))
    all_words = named.agg(F.sum("source_size")).first()[0] or 0
    level, full = 0.0, -1
    while True:
        over = F.lit(level) * F.col("weight") >= limit if full >= 0 else F.lit(False)
        n, held, open_weight = named.agg(F.count(F.when(over, 1)), F.sum(F.when(over, limit)), F.sum(F.when(~over, F.col("weight")))).first()
        if n == full or not open_weight:
            break
        level, full = (share * all_words - (held or 0.0)) / open_weight, n
    target = F.least(limit, F.lit(level) * F.col("weight")) if all_words else F.lit(0.0)
    return settle(named.select("source", "n_docs", F.col("at").alias("sid"), "source_size", target.alias("target")), "targets")


def plan_sources(named: DataFrame, block_words: int = BLOCK_WORDS) -> tuple[DataFrame, int]:
    """Adds n_blocks, want (words to take), quota (slots) and first_slot; also the number of all slots."""
    cut = named.withColumn("n_blocks", F.greatest(F.lit(1), F.round(F.col("source_size") / block_words).cast("long")))
    cut = cut.withColumn("want", F.round("target").cast("long"))
    quota = f"""CASE WHEN source_size = 0 THEN 0 ELSE (want DIV source_size) * n_blocks
        + ({_wide('want % source_size')} * n_blocks + source_size - 1) DIV source_size END"""
    cut = cut.withColumn("quota", F.expr(quota).cast("long"))
    chunk = F.expr("sid DIV 4096")
    sums = cut.groupBy(chunk.alias("chunk")).agg(F.sum("quota").alias("n")).collect()  # one row per 4096 sources
    base, done = [], 0
    for c, n in sorted((r["chunk"], r["n"]) for r in sums):
        base.append((c, done))
        done += n
    bases = cut.sparkSession.createDataFrame(base, "chunk long, base long")
    within = Window.partitionBy("chunk").orderBy("sid").rowsBetween(Window.unboundedPreceding, -1)
    before = cut.withColumn("chunk", chunk).withColumn("inner", F.coalesce(F.sum("quota").over(within), F.lit(0)))
    return before.join(F.broadcast(bases), "chunk").withColumn("first_slot", F.col("inner") + F.col("base")).drop("inner", "base", "chunk"), done


def golden_step(n: int) -> int:
    a = max(1, round(n * (sqrt(5) - 1) / 2))
    while gcd(a, n) != 1:
        a += 1
    return a


def schedule(planned: DataFrame, n: int) -> DataFrame:
    """Settled (slot, sid, rank, epoch, block): slot in 0..n-1 is the mix's order, rank the slot's within its source.

    Points find their source by an equi-join on stretches of sqrt(n) points. Ranks are counted in two levels, by stretch
    of slots and within it, so that a source that owns a third of the slots is in no single task."""
    spark = planned.sparkSession
    stretch = isqrt(n) + 1
    back = pow(golden_step(n), -1, n) if n > 1 else 0
    owners = planned.where("quota > 0").select("sid", "first_slot", (F.col("first_slot") + F.col("quota")).alias("end"), "n_blocks")
    owners = settle(owners.withColumn("piece", F.explode(F.expr(f"sequence(first_slot DIV {stretch}, (end - 1) DIV {stretch})"))), "owners")
    points = spark.range(n).select(F.col("id").alias("point"), F.expr(f"id DIV {stretch}").alias("piece"))
    slots = points.join(owners, "piece").where("point >= first_slot AND point < end")
    slots = slots.select(F.expr(f"CAST(({_wide('point')} * {_wide(str(back))}) % {n} AS BIGINT)").alias("slot"), "sid", "n_blocks")
    slots = settle(slots.withColumn("piece", F.expr(f"slot DIV {stretch}")), "slots")
    counts = slots.groupBy("sid", "piece").agg(F.count(F.lit(1)).alias("n"))
    earlier = Window.partitionBy("sid").orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)
    bases = settle(counts.select("sid", "piece", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("base")), "bases")
    within = Window.partitionBy("sid", "piece").orderBy("slot")
    ranked = slots.withColumn("inner", F.row_number().over(within) - 1).join(bases, ["sid", "piece"]).withColumn("rank", F.col("inner") + F.col("base"))
    found = settle(ranked.select("slot", "sid", "rank", F.expr("rank DIV n_blocks").alias("epoch"), F.expr("rank % n_blocks").alias("block")), "schedule")
    release(owners, slots, bases)
    return found


def mix_documents(docs: DataFrame, block_words: int = BLOCK_WORDS, weights: tuple[int, ...] = WEIGHTS, share: float = 1.5, most: float = 2.0) -> DataFrame:
    """(doc_id, size, source_size, target, taken, slots, lo) for each row of docs (doc_id, text, source; others are not read).

    size: words of the text (null: 0); taken: words that the mix takes of it, repeats counted; slots: where in the mix the block
    comes in which it begins, ascending, null if nowhere; lo: words before it in its source. A source's taken words add
    up to its rounded target; the last of its slots is trimmed. Null is a source of its own, the last. Documents
    without words take part with 0. Rows that share a doc_id stay rows of their own. Order within a source is by a hash
    of doc_id, so reruns agree. Empty table: empty result."""
    spark = docs.sparkSession
    words = F.coalesce(F.regexp_count(F.col("text").cast("string"), F.lit(WORD_CLASS)).cast("long"), F.lit(0).cast("long"))
    sizes = settle(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), words.alias("size")), "sizes")
    n_docs = sizes.count()
    if not n_docs:
        return spark.createDataFrame([], "doc_id long, size long, source_size long, target double, taken long, slots array<long>, lo long")
    planned, n = plan_sources(targets(sizes, weights, share, most), block_words)
    planned = settle(planned, "planned")
    placed = lookup(sizes, planned.drop("first_slot", "quota"), ["source"], "n_docs", F.col("doc_id")).drop("source")
    hashed = F.xxhash64(F.col("doc_id"), F.lit(8))
    placed = settle(placed.withColumn("hash", hashed).withColumn("bucket", F.pmod("hash", F.lit(isqrt(n_docs) + 1))), "placed")
    earlier = Window.partitionBy("sid").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    bases = placed.groupBy("sid", "bucket").agg(F.sum("size").alias("n")).select("sid", "bucket", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("base"))
    within = Window.partitionBy("sid", "bucket").orderBy("hash", "doc_id", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ordered = placed.withColumn("hi", F.sum("size").over(within)).join(settle(bases, "bases"), ["sid", "bucket"])
    ordered = ordered.withColumn("hi", F.col("hi") + F.col("base")).withColumn("lo", F.col("hi") - F.col("size"))
    kept = settle(ordered.select("doc_id", "size", "source_size", "target", "sid", "n_blocks", "want", "lo", "hi"), "streams")
    release(sizes, placed)
    shown = ["doc_id", "size", "source_size", "target"]
    none = kept if not n else kept.where("size = 0")
    none = none.select(*shown, F.lit(0).cast("long").alias("taken"), F.lit(None).cast("array<long>").alias("slots"), "lo")
    if not n:
        return none
    block = lambda x: f"({_wide(f'{x} + 1')} * n_blocks - 1) DIV source_size"
    pieces = kept.where("size > 0").withColumn("block", F.explode(F.expr(f"sequence({block('lo')}, {block('hi - 1')})")))
    drawn = schedule(planned, n).groupBy("sid", "block").agg(F.count(F.lit(1)).alias("draws"), F.sort_array(F.collect_list("slot")).alias("slots"))  # at most 1 + `most` of them
    pieces = pieces.join(settle(drawn, "drawn"), ["sid", "block"], "left")
    pieces = pieces.withColumn("b_lo", F.expr(f"({_wide('block')} * source_size) DIV n_blocks")).withColumn("b_hi", F.expr(f"({_wide('block + 1')} * source_size) DIV n_blocks"))
    # A block drawn so often is taken once less if its last draw is where the source reaches `want`, then as far as that.
    end = F.expr("want - (draws - 1) * source_size")
    whole = F.least("hi", "b_hi") - F.greatest("lo", "b_lo")
    last = F.greatest(F.lit(0), F.least(F.col("hi"), F.col("b_hi"), end) - F.greatest("lo", "b_lo"))
    took = F.when(F.col("draws").isNull(), F.lit(0)).otherwise((F.col("draws") - 1) * whole + last)
    # A row of its own is told by its place in its source.
    some = pieces.withColumn("took", took).groupBy("sid", "lo", *shown).agg(F.sum("took").alias("taken"), F.min_by("slots", "block").alias("slots"))
    return none.unionByName(some.select(*none.columns))


def mixed(docs: DataFrame, **options) -> DataFrame:
    """docs as the mix holds them: each row as often (0 to 2 times) as the words taken of it make whole copies, rounded, in the
    order of the schedule's slots.

    A document that alone fills its source's target has one copy at least. All columns stay, whatever their names. Rows that share
    a doc_id share their count and places; a null doc_id is one of them. Documents without words (null text too) are not in a mix.
    Empty table: empty result. The text is shuffled twice, to meet its places and into their order."""
    found = mix_documents(docs, **options).where("size > 0")
    taken = found.groupBy(F.col("doc_id").alias("_own_id")).agg(
        F.sum("taken").alias("taken"), F.sum("size").alias("size"), F.max(F.col("taken") >= F.greatest(F.lit(1), F.round("target"))).alias("alone"), F.min(F.when(F.col("slots").isNotNull(), F.struct("slots", "lo"))).alias("at")
    )
    copies = F.greatest(F.round(F.col("taken") / F.col("size")).cast("int"), F.col("alone").cast("int"))
    slot = F.transform(F.sequence(F.lit(0), F.col("copies") - 1), lambda k: F.coalesce(F.get("at.slots", k), F.element_at("at.slots", -1)))
    placed = settle(taken.withColumn("copies", copies).where("copies > 0").select("_own_id", slot.alias("_slots"), F.col("at.lo").alias("_lo")), "places")
    names = {c: fresh(docs, c) for c in ("_own_id", "_slots", "_lo")}
    placed = placed.withColumnsRenamed(names)
    own, slots, lo = names.values()
    joined = docs.join(placed.hint("merge"), docs["doc_id"].cast("long").eqNullSafe(placed[own]))
    at = fresh(docs, "_slot")
    rows = joined.select(*[docs[c] for c in docs.columns], F.explode(slots).alias(at), lo)
    return rows.repartitionByRange(at, lo).sortWithinPartitions(at, lo).select(*docs.columns)
