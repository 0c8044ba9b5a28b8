"""Benchmark decontamination by templates: numbers, units and names become typed slots, windows of the template are
looked up by hash, and slots must be filled consistently, so that a question with other numbers or names is caught."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial
from itertools import product

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import settle, tidy, without
from .superminhash import mix, stretches

WINDOW, COVERAGE = 5, 0.8
#: The filter of the benchmark's windows that all documents pass: 2^FILTER_BITS bits, at any number of windows.
FILTER_BITS = 26
#: Words that are units where they follow a number.
UNITS = frozenset(
    """mm cm m km inch inches foot feet yard yards mile miles mg g kg gram grams kilogram kilograms ton tons tonnes pound pounds lb
    ounce ounces ml l litre litres liter liters gallon gallons second seconds minute minutes hour hours day days week weeks month
    months year years dollar dollars cent cents euro euros percent degree degrees meter meters metre metres kilometer kilometers
    kilometre kilometres watt watts volt volts joule joules newton newtons hertz byte bytes""".split()
)
#: Numbers written as words.
NUMBER_WORDS = frozenset(
    """zero two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen
    twenty thirty forty fifty sixty seventy eighty ninety hundred thousand million billion""".split()
)
_NUMBER = re.compile(r"[+-]?[$€£]?\d[\d.,:/]*(?:%|st|nd|rd|th)?", re.ASCII)
_GLUED = re.compile(r"([+-]?[$€£]?\d[\d.,]*)([^\W\d_]+)")
_EDGE = re.compile(r"^[\W_]+|[\W_]+$")
#: What may stand around a word that is taken as it is.
_BEFORE, _AFTER = "\"'“”‘’«»([{", "\"'“”‘’«»)]}.,;:!?"
WORD, NUMBER, UNIT, NOTHING = range(4)
#: Forms of a window: names as slots, names as words, words that open sentences as slots too, words as they stand.
SLOTS, NAMED, OPENING, LITERAL = range(4)
_BREAK = "\x01"
#: A word's kind, whether it looks like a name, whether it ends a sentence, its hash, and that of it as it stands (0: none).
_SYMBOL = [("k", "i1"), ("n", "?"), ("e", "?"), ("h", "u8"), ("l", "u8")]
#: Words that a worker remembers.
MEMO = 600_000
#: A pass over texts handles so many bytes at a time.
CHUNK_BYTES = 2 << 20
_xxh = xxhash.xxh3_64_intdigest


@dataclass
class Symbols:
    """The template symbols of many texts, one text behind the other. Words of punctuation alone have none.

    forms: hashes and whether each is a slot, first with names as slots, then with names as words, as capitals are no sure
    sign of them, last also with the capitalised words that open sentences as slots."""

    words: pa.StringArray  # all kinds of words
    code: np.ndarray  # which of them each symbol is
    owner: np.ndarray  # the text of each symbol
    kind: np.ndarray  # 1 number, 2 unit, 3 name, 0 word, in the form in which most are slots
    forms: list[tuple[np.ndarray, np.ndarray]]
    literal: np.ndarray  # hashes of the words as they stand, with numbers and operators, without outer quotes, brackets and stops
    literal_owner: np.ndarray


class Templates:
    """Turns texts into template symbols, in numpy over many texts at once."""

    def __init__(self):
        self._forget()

    def _forget(self) -> None:
        self.words = pa.array([], pa.string())
        self.table = np.zeros(0, _SYMBOL)
        self.parts = np.zeros((0, 2), np.int64)  # of a word that is a number and a unit, their numbers; else its own, and -1

    @staticmethod
    def _look(raw: str) -> tuple[int, bool, bool, int, int]:
        core = raw if raw.isalpha() else raw.rstrip(".,;:!?")
        plain = core.isalpha()  # most words: nothing else to strip, and no digits
        low = core.lower()
        as_it_stands = low
        if not plain:
            core = _EDGE.sub("", raw)
            low = core.lower()
            as_it_stands = raw.lstrip(_BEFORE).rstrip(_AFTER).lower() if raw != _BREAK else ""
        ends = raw == _BREAK or raw[-1:] in ".!?:" or raw[-2:-1] in (".", "!", "?")
        if not core:
            kind = NOTHING
        elif low in NUMBER_WORDS or not plain and _NUMBER.fullmatch(core):
            kind = NUMBER
        else:
            kind = UNIT if low in UNITS else WORD
        named = len(core) > 1 and core[0].isupper() and core[1:].islower()
        h = _xxh(low)
        return kind, named, ends, h, 0 if not as_it_stands else h if as_it_stands == low else _xxh(as_it_stands)

    def _known(self, words: pa.StringArray) -> np.ndarray:
        """The numbers of words, distinct ones; new ones are looked at first."""
        found = pc.index_in(words, value_set=self.words)
        at = found.fill_null(-1).to_numpy().astype(np.int64)
        new = words.filter(found.is_null())
        if len(new):
            listed, n = new.to_pylist(), len(self.words)
            glued = {i: _parts(w) for i, w in enumerate(listed) if w[:1].isdigit() and len(_parts(w)) > 1}
            self.words = pa.concat_arrays([self.words, new])
            self.table = np.concatenate([self.table, np.fromiter(map(self._look, listed), _SYMBOL, len(listed))])
            self.parts = np.concatenate([self.parts, np.stack([np.arange(n, n + len(new)), np.full(len(new), -1)], 1)])
            at[at < 0] = np.arange(n, n + len(new))
            if glued:
                self._known(pc.unique(pa.array([x for p in glued.values() for x in p])))  # all of them at once
                for i, p in glued.items():
                    self.parts[n + i] = self._known(pa.array(p))
        return at

    def symbols(self, texts: pa.StringArray) -> Symbols:
        if len(self.words) > MEMO:
            self._forget()
        lines = pc.replace_substring(pc.fill_null(texts, ""), "\n", f" {_BREAK} ")
        split = pc.utf8_split_whitespace(pc.utf8_trim_whitespace(lines))
        coded = split.flatten().dictionary_encode()
        code = self._known(coded.dictionary)[coded.indices.to_numpy()] if len(coded) else np.zeros(0, np.int64)
        owner = np.repeat(np.arange(len(texts)), split.value_lengths().to_numpy())
        two = self.parts[code]
        code, owner = two.ravel()[two.ravel() >= 0], np.repeat(owner, 1 + (two[:, 1] >= 0))
        kind, named, ends, h, as_it_stands = (self.table[c][code] for c in "knehl")
        first = np.diff(owner, prepend=-1) > 0
        before = np.concatenate([[NOTHING], kind[:-1]])[: len(kind)]
        opens = first | np.concatenate([[True], ends[:-1]])[: len(kind)]
        slot = np.select([kind == NUMBER, (kind == UNIT) & (before == NUMBER) & ~first, named & ~opens & (kind != NOTHING)], [1, 2, 3], 0)
        opening = np.where((slot == 0) & named & (kind != NOTHING), 3, slot)
        real, lit = kind != NOTHING, as_it_stands != 0
        forms = [(np.where(x > 0, x.astype(np.uint64), h)[real], x[real] > 0) for x in (slot, np.where(slot == 3, 0, slot), opening)]
        return Symbols(self.words, code[real], owner[real], opening[real], forms, as_it_stands[lit], owner[lit])


def _parts(word: str) -> tuple[str, ...]:
    if word[:1].isdigit() and (m := _GLUED.fullmatch(word.rstrip(".,;:!?"))) and m[2].lower() in UNITS:
        return m[1], m[2] + word[m.end() :]
    return (word,)


def _roll(h: np.ndarray, width: int, seed: int) -> np.ndarray:
    n = max(0, len(h) - width + 1)
    rolled = np.full(n, seed, np.uint64)
    for k in range(width):
        rolled = rolled * np.uint64(0x9E3779B97F4A7C15) + h[k : n + k]
        rolled ^= rolled >> np.uint64(29)
    return mix(rolled)


def _each(x: np.ndarray, width: int) -> np.ndarray:
    """How many of each window's places hold true."""
    total = np.concatenate([[0], np.cumsum(x)])
    return total[width:] - total[: max(0, len(x) - width + 1)]


def _strip(w: str) -> str:
    return _EDGE.sub("", w).lower()


def _among(rolled: np.ndarray, bits: np.ndarray | None) -> np.ndarray | bool:
    if bits is None:
        return True
    at = rolled >> np.uint64(64 - FILTER_BITS)
    return bits[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8) & 1 > 0


def _windows(s: Symbols, widths: list[int], exact: list[int], whole: int, bits: np.ndarray | None) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, list[list[str]], int]]:
    """Of windows that the filter lets pass: their hashes, texts, places, slots' kinds and values, and the form. Words that open
    sentences are slots only in windows of `whole` symbols, as one word more or less is much of a shorter item. A window counts
    if at least half of it, and two words, are words. exact: widths of windows of the words as they stand, which have no slots."""
    begins = np.searchsorted(s.owner, np.arange(s.owner[-1] + 1)) if len(s.owner) else np.zeros(0, np.int64)
    for width, (form, (h, slot)) in product(widths, enumerate(s.forms)):
        n = len(h) - width + 1
        if n <= 0 or form == OPENING and width < whole:
            continue
        rolled = _roll(h, width, width)
        good = (s.owner[:n] == s.owner[width - 1 :]) & _among(rolled, bits)
        least = max(min(2, width), (width + 1) // 2)
        # Openings count among the windows with names as words; two words must remain.
        good &= width - _each(s.forms[1][1] if form == OPENING else slot, width) >= least
        if form:  # what has no names is there already
            good &= _each(s.forms[0][1] != slot, width) > 0
        if form == OPENING:
            good &= width - _each(slot, width) >= min(2, width)
        p = np.flatnonzero(good)
        if len(p):
            places = p[:, None] + np.arange(width)
            words, kinds = s.words.take(pa.array(s.code[places.ravel()])).to_pylist(), s.kind[places].ravel().tolist()
            slots = [[f"{kinds[j]}:{_strip(words[j])}" for j in range(i * width, (i + 1) * width) if own[j - i * width]] for i, own in enumerate(slot[places].tolist())]
            yield rolled[p], s.owner[p], p - begins[s.owner[p]], slots, form
    begins = np.searchsorted(s.literal_owner, np.arange(s.literal_owner[-1] + 1)) if len(s.literal_owner) else np.zeros(0, np.int64)
    for width in exact:
        n = len(s.literal) - width + 1
        if n > 0:
            rolled = _roll(s.literal, width, width + (1 << 32))
            p = np.flatnonzero((s.literal_owner[:n] == s.literal_owner[width - 1 :]) & _among(rolled, bits))
            yield rolled[p], s.literal_owner[p], p - begins[s.literal_owner[p]], [[]] * len(p), LITERAL


@tidy
def _scan(batches: Iterator[pa.RecordBatch], widths: list[int], exact: list[int], whole: int, bits: np.ndarray | None) -> Iterator[pa.RecordBatch]:
    """A row for each of _windows."""
    templates = Templates()
    for batch in batches:
        size = pc.binary_length(batch.column(2)).to_numpy()
        for a, b in stretches(size, CHUNK_BYTES):
            with np.errstate(over="ignore"):
                for rolled, owner, pos, slots, form in _windows(templates.symbols(batch.column(2)[a:b]), widths, exact, whole, bits):
                    at = pa.array(a + owner)
                    yield pa.RecordBatch.from_arrays(
                        [batch.column(0).take(at), batch.column(1).take(at), pa.array(rolled.view(np.int64)), pa.array(pos, pa.int64()), pa.array(slots, pa.list_(pa.string())), pa.array(np.full(len(pos), form, np.int32))],
                        names=["id", "text_hash", "hash", "pos", "slots", "form"],
                    )


_ROWS = "id long, text_hash long, hash long, pos long, slots array<string>, form int"


def _texts(df: DataFrame, key: str) -> DataFrame:
    text = F.col("text").cast("string")
    return df.select(F.col(key).cast("long").alias("id"), F.xxhash64(text).alias("text_hash"), text.alias("text")).where(text.isNotNull())


@tidy
def _length(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    templates = Templates()
    for batch in batches:
        s, k = templates.symbols(batch.column(2)), batch.num_rows
        counts = (np.bincount(s.owner, minlength=k), np.bincount(s.owner[~s.forms[1][1]], minlength=k), np.bincount(s.literal_owner, minlength=k))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *map(pa.array, counts)], names=["id", "text_hash", "n", "plain", "words"])


def _filter(known: DataFrame) -> np.ndarray | None:
    """A bit for each hash's first FILTER_BITS bits; None if there is no hash. The driver gets at most 2^(FILTER_BITS - 6) numbers."""
    places = known.select(F.shiftrightunsigned("hash", 64 - FILTER_BITS).alias("at"))
    words = places.groupBy(F.expr("int(at >> 6)").alias("word")).agg(F.expr("bit_or(shiftleft(1L, int(at & 63)))").alias("bits"))
    rows = words.toPandas()
    if not len(rows):
        return None
    bits = np.zeros(1 << (FILTER_BITS - 6), "<i8")
    bits[rows["word"].to_numpy()] = rows["bits"].to_numpy()
    return bits.view(np.uint8)


def find_leaks(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, coverage: float = COVERAGE) -> DataFrame:
    """(doc_id, item_id, matched, n_windows, reworded, text_hash): documents that hold a benchmark item's template.

    docs: doc_id, text; benchmark: item_id, text; other columns are not read. An item leaks into a document if at least
    coverage of its windows of `window` template symbols occur there, counting only alignments in which equal slot values of
    the item have equal values in the document, and its different names different ones. Names are slots, or words where all windows with few enough slots are counted together; in
    items of at least a window, names that open sentences are slots too. reworded: some slot's value differs. Windows with too few
    plain words are not counted; an item that has no others is looked for by windows of its words as they stand, with numbers and operators, so that
    its copies are found (but not if it is shorter than a window and has no plain word: such a run of numbers is no item).
    Items shorter than a window are one window. Null or empty texts hold nothing and are no items; copies of a row
    are reported once; a null doc_id is reported as null, an item without an item_id is none. Empty tables: empty result."""
    items = settle(_texts(benchmark, "item_id"), "items")
    lengths = settle(items.mapInArrow(_length, "id long, text_hash long, n long, plain long, words long"), "lengths")
    schema = "doc_id long, item_id long, matched long, n_windows long, reworded boolean, text_hash long"

    def widths_of(some: DataFrame, n: str) -> tuple[DataFrame, list[int]]:  # at most `window` of them
        some = some.where(F.col(n) > 0).select(F.col("id").alias("_id"), F.col("text_hash").alias("_hash"), F.least(F.col(n), F.lit(window)).alias("w")).distinct()
        return items.join(some, items["id"].eqNullSafe(some["_id"]) & (items["text_hash"] == some["_hash"])), sorted(r["w"] for r in some.select("w").distinct().collect())

    def scanned(wide: DataFrame, w: int, **how) -> DataFrame:
        return wide.where(F.col("w") == w).select("id", "text_hash", "text").mapInArrow(partial(_scan, whole=window, bits=None, **how), _ROWS)

    known = docs.sparkSession.createDataFrame([], _ROWS)
    wide, widths = widths_of(lengths, "n")
    for w in widths:
        known = known.unionByName(scanned(wide, w, widths=[w], exact=[]))
    known = settle(known.distinct(), "templates")
    has = known.select(F.col("id").alias("_known"), F.col("text_hash").alias("_known_hash")).distinct()
    rest = lengths.where((F.col("plain") > 0) | (F.col("words") >= window)).join(has, lengths["id"].eqNullSafe(has["_known"]) & (lengths["text_hash"] == has["_known_hash"]), "left_anti")
    wide, exact = widths_of(rest, "words")
    if exact:
        for w in exact:
            known = known.unionByName(scanned(wide, w, widths=[], exact=[w]).distinct())
        known = settle(known, "templates")
    sizes = known.groupBy("id", "text_hash").agg(F.countDistinct("pos").alias("n_windows"), F.countDistinct(F.when(F.col("form") == SLOTS, F.col("pos"))).alias("n_slots"))
    known = settle(known.join(sizes, ["id", "text_hash"]).select(F.col("id").alias("item_id"), F.col("text_hash").alias("item_hash"), "hash", F.col("pos").alias("at"), F.col("slots").alias("item_slots"), F.col("form").alias("item_form"), "n_windows", "n_slots"), "templates")
    bits = _filter(known)
    if bits is None:
        return docs.sparkSession.createDataFrame([], schema)
    seen = settle(_texts(docs, "doc_id").mapInArrow(partial(_scan, widths=widths, exact=exact, whole=window, bits=bits), _ROWS), "hits")
    pairs = seen.withColumnRenamed("id", "doc_id").join(known, "hash")
    pairs = pairs.withColumn("filled", F.arrays_zip(F.col("item_slots").alias("a"), F.col("slots").alias("b")))
    # An alignment counts without the words that open sentences as slots, or with them: these may fit it or spoil it. Windows with
    # names as slots count for themselves as well, if they are half of an item's and 3 at least: in a question of many slots
    # the others hold names, and stand in no text with other names.
    open_ = (F.col("form") == OPENING) | (F.col("item_form") == OPENING)
    alone = (F.col("form") == SLOTS) & (F.col("item_form") == SLOTS) & (F.col("n_slots") >= 3) & (2 * F.col("n_slots") >= F.col("n_windows"))
    views = F.array(F.when(~open_, F.lit("plain")), F.lit("openings"), F.when(alone, F.lit("slots")))
    pairs = pairs.withColumn("view", F.explode(F.filter(views, lambda v: v.isNotNull())))
    pairs = pairs.withColumn("least", F.ceil(F.lit(coverage) * F.when(F.col("view") == "slots", F.col("n_slots")).otherwise(F.col("n_windows"))))
    key = ["doc_id", "text_hash", "item_id", "item_hash", "n_windows", "view", "least"]
    aligned = pairs.groupBy(*key, (F.col("pos") - F.col("at")).alias("shift")).agg(
        F.collect_set("at").alias("at"), F.array_distinct(F.flatten(F.collect_list("filled"))).alias("filled")
    )
    names = F.filter("filled", lambda x: x["a"].startswith("3:"))
    one_to_one = (F.size(F.array_distinct(F.transform("filled", lambda x: x["a"]))) == F.size("filled")) & (F.size(F.array_distinct(F.transform(names, lambda x: x["b"]))) == F.size(names))
    aligned = aligned.where(one_to_one)
    other = F.exists("filled", lambda x: ~x["a"].eqNullSafe(x["b"]))
    found = aligned.groupBy(*key).agg(F.size(F.array_distinct(F.flatten(F.collect_list("at")))).cast("long").alias("matched"), F.max(other).alias("reworded"))
    found = found.where(F.col("matched") >= F.col("least"))
    return found.groupBy("doc_id", "item_id", "text_hash").agg(F.max("matched").alias("matched"), F.max("n_windows").alias("n_windows"), F.max("reworded").alias("reworded")).select(
        "doc_id", "item_id", "matched", "n_windows", "reworded", "text_hash"
    )


def drop_leaks(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """docs without the rows into which a benchmark item leaked; all columns stay, whatever their names.

    Null and empty texts stay; of repeated rows all stay or go. Empty docs: empty result; empty benchmark: docs."""
    bad = settle(find_leaks(docs, benchmark, **options).select(F.col("doc_id").alias("_own_id"), F.col("text_hash").alias("_own_hash")).distinct(), "leaks")
    return without(docs, bad)
