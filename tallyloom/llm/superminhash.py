"""Near-duplicate documents: SuperMinHash signatures, banding, verification on full sets, union by contraction.

Plan: every text becomes its set of hashed word shingles in one Arrow pass, which emits the set's size, a 128-bit
fingerprint and one key per band. Texts with equal sets collapse into a class by a partial aggregate, so groups of exact
copies of any size cost one class. Classes that share a band key form a bucket; each is paired with one hub of its bucket, its
most central member, never all with all. Where that leaves a bucket in several components, _missed finds the pairs that could
still join them. Every pair is confirmed on the whole sets, inside the JVM. Shingles are compared by 64-bit hashes."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import bit_filter, lookup, release, row_hash, same_row, settle, sift, tidy, without
from .components import components

#: Bands x rows a band = length of the signature. At a similarity of 0.8 a pair shares none of 32 bands of 4 rows with
#: a probability of 5e-8.
BANDS, ROWS = 32, 4
#: A pass over texts handles so many bytes at a time.
CHUNK_BYTES = 1 << 20
#: The memo of word hashes is emptied beyond so many words.
MEMO = 100_000

_GOLDEN = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """splitmix64's finaliser."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Shingler:
    """Sets of hashed shingles of width words; lower-cases A-Z only, words are what ASCII white space separates."""

    def __init__(self, width: int):
        self.width, self.memo = width, {}

    def hashes(self, words: list[bytes]) -> np.ndarray:
        memo = self.memo
        if len(memo) > MEMO:
            memo.clear()
        for w in {*words} - memo.keys():
            memo[w] = xxhash.xxh3_64_intdigest(w)
        return np.fromiter((memo[w] for w in words), np.uint64, len(words))

    def sets(self, texts: list[str | None]) -> list[np.ndarray]:
        """One sorted array of distinct hashes per text; empty without words. Fewer words than width: one shingle."""
        split = [(t or "").encode("utf-8", "surrogatepass").lower().split() for t in texts]
        flat = self.hashes([w for words in split for w in words])
        rolled, n = np.zeros(len(flat), np.uint64), len(flat)
        for k in range(min(self.width, n)):
            rolled[: n - k] = mix(rolled[: n - k] * _GOLDEN + flat[k:] + np.uint64(k + 1))
        out, at = [], 0
        for words in split:
            if len(words) >= self.width:
                out.append(np.unique(rolled[at : at + len(words) - self.width + 1]))
            elif words:
                out.append(np.array([xxhash.xxh3_64_intdigest(b"\x00".join(words), seed=len(words))], np.uint64))
            else:
                out.append(np.zeros(0, np.uint64))
            at += len(words)
        return out


def signatures(sets: list[np.ndarray], m: int) -> np.ndarray:
    """SuperMinHash: uint32 [set, m], each value rank << 24 | uniform 24 bits; all ones for empty sets.

    Element d deals its step-j value j + r to place p_d(j) of a random permutation p_d. All elements take step j
    together; an element stops as soon as every place of its set holds a value below j, which no later step can lower."""
    out = np.full((len(sets), m), 0xFFFFFFFF, np.uint32)
    element = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    picks: list[np.ndarray] = []
    for j in range(m):
        if not len(element):
            break
        with np.errstate(over="ignore"):
            drawn = mix(element + np.uint64(j + 1) * _GOLDEN)
        place = j + ((drawn >> np.uint64(32)) % np.uint64(m - j)).astype(np.int64)
        at = place.copy()
        for i in range(j - 1, -1, -1):  # where earlier swaps have put what now stands at `place`
            at = np.where(at == picks[i], i, at)
        picks.append(place)
        np.minimum.at(out, (owner, at), (np.uint32(j) << np.uint32(24)) | (drawn & np.uint64(0xFFFFFF)).astype(np.uint32))
        alive = (out.max(axis=1) >> np.uint32(24)) > j
        keep = alive[owner]
        if not keep.all():
            element, owner, picks = element[keep], owner[keep], [p[keep] for p in picks]
    return out


def band_keys(sig: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """int64 [set, bands]; the band's number is part of its key."""
    key = np.repeat(np.arange(1, bands + 1, dtype=np.uint64)[None, :], len(sig), 0)
    part = sig.reshape(len(sig), bands, rows).astype(np.uint64)
    with np.errstate(over="ignore"):
        for k in range(rows):
            key = mix(key * _GOLDEN + part[:, :, k] + np.uint64(1))
    return key.view(np.int64)


def stretches(sizes: Iterable[int], size: int) -> Iterator[tuple[int, int]]:
    """Runs (start, end) of consecutive entries whose sizes add up to about size."""
    start = held = end = 0
    for end, n in enumerate(sizes, 1):
        held += n
        if held >= size:
            yield start, end
            start, held = end, 0
    if start < end:
        yield start, end


def chunks(texts: list[str | None], size: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    return stretches((len(t or "") for t in texts), size)


@tidy
def _profile(batches: Iterator[pa.RecordBatch], width: int, bands: int, rows: int) -> Iterator[pa.RecordBatch]:
    shingler = Shingler(width)
    for batch in batches:
        ids, texts, hashes = batch.column(0), batch.column(1).to_pylist(), batch.column(2)
        for a, b in chunks(texts):
            with np.errstate(over="ignore"):
                sets = shingler.sets(texts[a:b])
                keys = band_keys(signatures(sets, bands * rows), bands, rows)
            prints = np.frombuffer(b"".join(xxhash.xxh3_128_digest(s.tobytes()) for s in sets), "<i8").reshape(-1, 2)
            flat = pa.ListArray.from_arrays(pa.array(np.arange(0, len(sets) * bands + 1, bands, dtype=np.int32)), pa.array(keys.ravel()))
            yield pa.RecordBatch.from_arrays(
                [ids[a:b], hashes[a:b], pa.array([len(s) for s in sets], pa.int64()), pa.array(prints[:, 0]), pa.array(prints[:, 1]), flat],
                names=["doc_id", "text_hash", "n_shingles", "fp1", "fp2", "bands"],
            )


@tidy
def _tokens(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    shingler = Shingler(width)
    for batch in batches:
        texts = batch.column(1).to_pylist()
        for a, b in chunks(texts):
            with np.errstate(over="ignore"):
                sets = shingler.sets(texts[a:b])
            ends = pa.array(np.cumsum([0, *map(len, sets)]), pa.int32())
            flat = pa.array(np.concatenate(sets).view(np.int64) if sets else [], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0)[a:b], pa.ListArray.from_arrays(ends, flat)], names=["node", "tokens"])


def full_sets(source: DataFrame, kinds: DataFrame, wanted: DataFrame, width: int) -> DataFrame:
    """Settled (node, tokens): the whole shingle set of each class that wanted (node) names, of one of its texts.

    Texts of other rows are not shuffled: a bit filter rules them out."""
    rows = kinds.join(wanted, "node").select("node", F.col("own.doc_id").alias("_own_id"), F.col("own.text_hash").alias("_own_hash"))
    rows = settle(rows, "wanted")
    near, _ = sift(source, bit_filter(rows, F.xxhash64("_own_id", "_own_hash")), row_hash(source))
    texts = near.join(rows.hint("merge"), same_row(near, rows)).select("node", "text").dropDuplicates(["node"])
    sets = settle(texts.mapInArrow(partial(_tokens, width=width), "node long, tokens array<long>"), "sets")
    release(rows)
    return sets


def confirm(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """pairs (hub, node) whose full shingle sets are similar; settled (a, b)."""
    own, other = sets.select("node", F.col("tokens").alias("own")), sets.select(F.col("node").alias("hub"), F.col("tokens").alias("other"))
    joined = pairs.hint("merge").join(own, "node").join(other.hint("merge"), "hub")
    both = F.size(F.array_intersect("own", "other"))
    return settle(joined.where(100 * both >= percent * (F.size("own") + F.size("other") - both)).select(F.col("hub").alias("a"), F.col("node").alias("b")), "confirmed")


def _near(percent: int):
    return F.lit(100) * F.least("n", "hub_n") >= F.lit(percent) * F.greatest("n", "hub_n")


def hubs_of(members: DataFrame) -> DataFrame:
    """(bucket, hub, hub_n) of members (node, n, bucket, size): the bucket's most central member.

    That is the one with the most bucket mates in all: in a family of near copies this is a text with few changes, to which most
    others are similar, so that little is left for _missed. Ties go by hash."""
    mates = members.groupBy("node").agg(F.sum("size").alias("mates"))
    order = F.struct(-F.col("mates"), F.xxhash64("node"))
    return members.join(mates, "node").groupBy("bucket").agg(F.min_by(F.struct("node", "n"), order).alias("h")).select("bucket", F.col("h.node").alias("hub"), F.col("h.n").alias("hub_n"))


def _missed(rest: DataFrame, sets: DataFrame, comp: DataFrame, percent: int) -> DataFrame:
    """Pairs (hub, node) of different components that could still be linked, for buckets that hold several components.

    An exact prefix filter over the members of such buckets: shingles are ordered from rare to common; two sets of sizes
    n and m with an overlap of o = percent / (100 + percent) * (n + m) at least share a shingle among the first n - o + 1 and
    m - o + 1 of theirs. In a family of many near copies these are the places where a text differs from the family, so the
    few that are in no component meet those with the same changes, not the whole family."""
    now = rest.join(comp, "node", "left").select("bucket", "node", F.coalesce("component_id", "node").alias("comp"))
    now = settle(now, "members")
    ends = now.groupBy("bucket").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi").select("bucket")
    still = settle(now.join(ends, "bucket").select("node", "comp").distinct(), "open")
    each = settle(still.join(sets, "node").select("node", "comp", F.size("tokens").cast("long").alias("n"), F.explode("tokens").alias("token")), "tokens")
    often = settle(each.groupBy("token").agg(F.count(F.lit(1)).alias("df")).where("df > 1"), "often")
    # A shingle that no other text has stands first and can't match: only its place counts.
    ranked = each.join(often, "token", "left").withColumn("at", F.row_number().over(Window.partitionBy("node", "n", "comp").orderBy(F.coalesce("df", F.lit(1)), "token")) - 1)
    front = settle(ranked.where(F.col("df").isNotNull() & (100 * F.col("at") <= (100 - percent) * F.col("n"))).select("token", "node", "comp", "n", "at"), "fronts")
    other = front.select("token", F.col("node").alias("hub"), F.col("comp").alias("hub_comp"), F.col("n").alias("hub_n"), F.col("at").alias("hub_at"))
    need = F.ceil(F.lit(percent) * (F.col("n") + F.col("hub_n")) / F.lit(100.0 + percent) - 1e-9)
    meet = (F.col("node") > F.col("hub")) & (F.col("comp") != F.col("hub_comp")) & _near(percent) & (F.col("n") - F.col("at") >= need) & (F.col("hub_n") - F.col("hub_at") >= need)
    pairs = settle(front.join(other, (front["token"] == other["token"]) & meet).select("hub", "node").distinct(), "pairs")
    release(now, still, each, often, front)
    return pairs


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept, text_hash) for each row of docs (doc_id, text; other columns are not read).

    Documents are linked if their sets of distinct shingles of width words have 100 * intersection >= percent *
    union; component_id is the smallest doc_id that links reach, kept = it is the document's own.
    - Null, empty or blank text: n_shingles 0, its own component, kept. Fewer than width words: one shingle of all.
    - Rows that share a doc_id are rows of their own, each linked by its text; the smallest doc_id stands for all of them.
    - A null doc_id is linked like any other but never is the smallest of a component that has ids; without any, the
      component_id is null and its rows are kept.
    - An empty table gives an empty result; texts of any length are read whole."""
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    schema = "doc_id long, text_hash long, n_shingles long, fp1 long, fp2 long, bands array<long>"
    profile = settle(source.withColumn("text_hash", F.xxhash64("text")).mapInArrow(partial(_profile, width=width, bands=bands, rows=rows), schema), "profile")
    full = profile.where("n_shingles > 0")
    own = F.struct("doc_id", "text_hash")
    kinds = full.groupBy("fp1", "fp2").agg(
        F.min("doc_id").alias("doc_id"), F.min(own).alias("own"), F.count(F.lit(1)).alias("n_docs"), F.max("n_shingles").alias("n"), F.first("bands").alias("bands")
    )
    kinds = settle(kinds.withColumn("node", F.monotonically_increasing_id()), "classes")  # written, so that numbers stay
    keyed = kinds.select("node", "n", F.explode("bands").alias("bucket"))
    sizes = settle(keyed.groupBy("bucket").agg(F.count(F.lit(1)).alias("size")).where("size > 1"), "buckets")
    members = settle(keyed.join(sizes, "bucket"), "members")
    met = settle(members.join(settle(hubs_of(members), "hubs"), "bucket").where(F.col("node") != F.col("hub")), "met")
    pairs = settle(met.where(_near(percent)).select("hub", "node").distinct(), "pairs")
    sets = full_sets(source, kinds, members.select("node").distinct(), width)
    links = confirm(pairs, sets, percent)
    comp = components(links)
    missed = _missed(met.where("size > 2").select("bucket", "node"), sets, comp, percent)
    more = confirm(missed, sets, percent)
    if not more.isEmpty():
        comp = components(links.unionByName(more))
    rooted = kinds.select("fp1", "fp2", "doc_id", "n_docs", "node").join(comp, "node", "left").withColumn("root", F.coalesce("component_id", "node"))
    least = rooted.where("component_id is not null").groupBy("root").agg(F.min("doc_id").alias("least"))
    named = rooted.join(least, "root", "left").select("fp1", "fp2", "n_docs", F.coalesce("least", "doc_id").alias("component_id"))
    named = settle(named, "named")
    release(sizes, members, met, pairs, missed, sets, links, more, kinds)
    mine = F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    found = lookup(profile.drop("bands"), named, ["fp1", "fp2"], "n_docs", F.col("doc_id"))
    return found.select("doc_id", "n_shingles", mine.alias("component_id"), mine.eqNullSafe(F.col("doc_id")).alias("kept"), "text_hash")


def keep_one(docs: DataFrame, **options) -> DataFrame:
    """docs with one row of each group that near_duplicates finds; all columns stay.

    Of rows that share the kept doc_id (or, without one, the text) the first by text stays."""
    found = settle(near_duplicates(docs, **options), "groups")
    key = [F.col("doc_id").alias("_own_id"), F.col("text_hash").alias("_own_hash")]
    gone = found.where(~F.col("kept")).select(*key).distinct()
    group = [F.col("doc_id").isNull().alias("none"), F.coalesce("doc_id", "text_hash").alias("own")]
    kept = found.where("kept").groupBy(*group, "doc_id", "text_hash").count()
    many = kept.groupBy("none", "own").agg(F.sum("count").alias("n")).where("n > 1")
    rows = settle(kept.join(many, ["none", "own"]).select(*key).distinct().withColumn("_again", F.lit(True)).unionByName(gone.withColumn("_again", F.lit(False))), "not-as-is")
    single, again = without(docs, rows), rows.where("_again")
    if again.isEmpty():
        return single
    near, _ = sift(docs, bit_filter(again, F.xxhash64("_own_id", "_own_hash")), row_hash(docs))
    packed = near.select(F.struct(*[near[c] for c in docs.columns]).alias("row"), near["doc_id"].cast("long").alias("id"), F.xxhash64(near["text"].cast("string")).alias("hash"))
    whole = packed.join(again, F.col("id").eqNullSafe(F.col("_own_id")) & (F.col("hash") == F.col("_own_hash")))
    whole = whole.select("row", F.coalesce("id", "hash").alias("own"), F.col("id").isNull().alias("none"))
    first = whole.groupBy("own", "none").agg(F.min_by("row", F.coalesce("row.text", F.lit(""))).alias("row"))
    return single.unionByName(first.select("row.*"))
