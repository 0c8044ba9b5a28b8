"""Token ids as ORC: stripes with run-length coded integers, row indexes and Bloom filters on document ids."""

from __future__ import annotations

import os
import re
import unicodedata
import zlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import new_path, tidy
from .superminhash import stretches

#: Words whose ids a worker remembers; beyond that it starts anew.
MEMO = 1_000_000
#: A pass over texts handles so many bytes at a time.
CHUNK_BYTES = 4 << 20
END_ID = 1
#: ASCII punctuation but the apostrophe, with which some pieces begin.
_MARKS = "".join(c for c in map(chr, range(33, 127)) if not c.isalnum() and c != "'")
#: What the files hold. part and part_start: the file's number, and how many ids stand in it before this document.
FILE_SCHEMA = "doc_id long, part int, part_start long, n_tokens int, ids array<int>"


def _ends_a_piece(core: str) -> bool:
    """Whether marks behind core are a piece of their own: core, normalised, ends with a letter or digit."""
    return unicodedata.category(unicodedata.normalize("NFC", core).lower()[-1])[0] in "LN"


def _pick(flat: np.ndarray, first: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The stretches of flat that begin at first, one behind the other, and where each begins there (with the end)."""
    begins = np.concatenate([[0], np.cumsum(size)])
    return flat[np.repeat(first - begins[:-1], size) + np.arange(begins[-1])], begins


class WordEncoder:
    """Encodes texts with a tokenizers file, each distinct word once for all texts of a call, with a memo.

    Exact for vocabularies whose pieces never cross ASCII white space and drop it (NFC, per-character lower case and a
    pre-tokenizer that splits there): no step then looks beyond a word. Special tokens in a text are met inside words."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self._forget()

    def _forget(self) -> None:
        self.words, self.ids = pa.array([], pa.string()), np.zeros(0, "<i4")
        self.first = self.size = np.zeros(0, np.int64)  # of each word's ids

    def encode(self, texts: pa.StringArray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, end_id behind each, and where in them each text begins (with the end of the last)."""
        if len(self.words) > MEMO:
            self._forget()
        # The vocabulary is lower case; special tokens are looked for before that, so texts that may hold one stay as they are.
        plain = pc.fill_null(texts, "")
        split = pc.ascii_split_whitespace(pc.if_else(pc.match_substring(plain, "<|"), plain, pc.ascii_lower(plain)))
        coded = split.flatten().dictionary_encode()
        at = self._known(coded.dictionary)[coded.indices.to_numpy()]
        ids, upto = _pick(self.ids, self.first[at], self.size[at])
        begins = upto[np.concatenate([[0], np.cumsum(split.value_lengths().to_numpy())])] + np.arange(len(texts) + 1)
        out = np.full(len(ids) + len(texts), end_id, "<i4")
        own = np.ones(len(out), bool)
        own[begins[1:] - 1] = False
        out[own] = ids
        return out, begins

    def _known(self, words: pa.StringArray) -> np.ndarray:
        """The numbers of words (distinct ones), which are learned first if they are new."""
        found = pc.index_in(words, value_set=self.words)
        new = words.filter(found.is_null())
        at, n = found.fill_null(-1).to_numpy().astype(np.int64), len(self.words)
        if len(new):
            self._learn(new)
            at[at < 0] = n + pc.index_in(new, value_set=self.words[n:]).to_numpy()
        return at

    def _add(self, words: pa.StringArray, ids: np.ndarray, size: np.ndarray) -> None:
        self.first = np.concatenate([self.first, len(self.ids) + np.cumsum(size) - size])
        self.words, self.size, self.ids = pa.concat_arrays([self.words, words]), np.concatenate([self.size, size]), np.concatenate([self.ids, ids])

    def _learn(self, new: pa.StringArray) -> None:
        """Marks behind a letter or digit are a piece of their own, so that a word is learned once for all marks."""
        core = pc.ascii_rtrim(new, characters=_MARKS)
        cut = pc.and_(pc.and_(pc.less(pc.binary_length(core), pc.binary_length(new)), pc.greater(pc.binary_length(core), 0)), pc.invert(pc.match_substring(new, "<|")))
        cut = cut.to_numpy(zero_copy_only=False)
        odd = np.flatnonzero(cut & ~pc.match_substring_regex(core, "[0-9A-Za-z]$").to_numpy(zero_copy_only=False))
        cut[odd] = [_ends_a_piece(x) for x in core.take(pa.array(odd)).to_pylist()]
        both, core = new.filter(pa.array(cut)), core.filter(pa.array(cut))
        tail = pc.struct_field(pc.extract_regex(both, f"(?P<tail>[{re.escape(_MARKS)}]+)$"), "tail")
        parts = pc.unique(pa.concat_arrays([new.filter(pa.array(~cut)), core, tail]))
        parts = parts.filter(pc.invert(pc.is_in(parts, value_set=self.words)))
        self._add(parts, *self._encode_parts(parts))
        halves = np.stack([pc.index_in(x, value_set=self.words).to_numpy() for x in (core, tail)], 1).ravel()
        ids, begins = _pick(self.ids, self.first[halves], self.size[halves])
        self._add(both, ids, np.diff(begins[::2]))

    def _encode_parts(self, parts: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
        """ids and sizes of each. A word of letters is one piece, so that many can be encoded at once."""
        letters = pc.utf8_is_alpha(parts).to_numpy(zero_copy_only=False)
        where, others = np.flatnonzero(letters), [np.flatnonzero(~letters)]
        groups = pa.ListArray.from_arrays(pa.array([*range(0, len(where), 128), len(where)], pa.int32()), parts.take(pa.array(where)))
        done, ids, sizes = [], [], []
        for i, text in enumerate(pc.binary_join(groups, " ").to_pylist()):
            group, e = where[128 * i : 128 * (i + 1)], self.tokenizer.encode(text, add_special_tokens=False)
            n = np.bincount(e.word_ids) if e.ids else []
            if len(n) != len(group):
                others.append(group)
                continue
            done.append(group)
            ids += e.ids
            sizes.append(n)
        rest = np.concatenate(others)
        for e in self.tokenizer.encode_batch_fast(parts.take(pa.array(rest)).to_pylist(), add_special_tokens=False):
            ids += e.ids
            sizes.append([len(e.ids)])
        order = np.argsort(np.concatenate([*done, rest]))
        size = np.concatenate([*sizes, np.zeros(0, np.int64)]).astype(np.int64)
        return _pick(np.array(ids, "<i4"), (np.cumsum(size) - size)[order], size[order])[0], size[order]


@tidy
def _encode(batches: Iterator[pa.RecordBatch], path: str, end_id: int) -> Iterator[pa.RecordBatch]:
    encoder, part, done = WordEncoder(path), TaskContext.get().partitionId(), 0
    for batch in batches:
        size = pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy()
        for a, b in stretches(size, CHUNK_BYTES):
            ids, begins = encoder.encode(batch.column(1)[a:b], end_id)
            lists = pa.ListArray.from_arrays(pa.array(begins, pa.int32()), pa.array(ids))
            columns = [batch.column(0)[a:b], pa.array(np.full(b - a, part, np.int32)), pa.array(done + begins[:-1]), pa.array(np.diff(begins), pa.int32()), lists]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "part", "part_start", "n_tokens", "ids"])
            done += len(ids)


def write_orc(docs: DataFrame, path: str, tokenizer_path: str, end_id: int = END_ID, stripe_bytes: int = 64 << 20, stride: int = 2000, as_stored: bool = False) -> None:
    """Encode docs (doc_id, text; other columns are not read) and write them in ascending doc_id order, or as_stored: in the order
    of the Parquet files that docs is read from, by their numbers, and of the rows in them.

    The text, which is smaller than its ids, is what gets shuffled: once, by ranges. ORC codes the ids with
    integer run lengths; a stripe's index entries (every stride rows) hold the range of doc_id and a Bloom filter, so a
    reader looking for some documents skips whole stripes and strides.
    Null text counts as empty (one id, the end); a null doc_id sorts first; rows that share a doc_id are ordered by text."""
    order = ["doc_id", "text"]
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    if as_stored:
        file, order = F.col("_metadata.file_name"), ["number", "file", "row"]
        number = F.regexp_extract(file, r"^part-(\d+)", 1).try_cast("int")
        source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), number.alias("number"), file.alias("file"), F.col("_metadata.row_index").alias("row"))
    dealt = source.repartitionByRange(*order[:1] if not as_stored else order).sortWithinPartitions(*order).select("doc_id", "text")
    coded = dealt.mapInArrow(partial(_encode, path=tokenizer_path, end_id=end_id), FILE_SCHEMA)
    coded.write.options(
        **{
            "orc.bloom.filter.columns": "doc_id", "orc.bloom.filter.fpp": "0.01", "orc.create.index": "true", "orc.row.index.stride": str(stride),
            "orc.stripe.size": str(stripe_bytes), "compression": "zstd",
        }
    ).orc(path)


def read_orc(spark: SparkSession, path: str, doc_ids: list[int] | None = None) -> DataFrame:
    """The files' rows; with doc_ids only these, found by the stripes' ranges and Bloom filters."""
    df = spark.read.schema(FILE_SCHEMA).orc(path)
    return df if doc_ids is None else df.where(F.col("doc_id").isin(doc_ids))


@tidy
def _digest(batches: Iterator[pa.RecordBatch], base: dict[int, int]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        doc, part, start, _, ids = batch.columns
        ends = ids.offsets.to_numpy()
        raw = memoryview(np.ascontiguousarray(ids.values.to_numpy(zero_copy_only=False), "<u4")).cast("B")
        crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
        first = [base[p] + s for p, s in zip(part.to_pylist(), start.to_pylist(), strict=True)]
        yield pa.RecordBatch.from_arrays(
            [doc, pa.array(first, pa.int64()), pa.array(np.diff(ends), pa.int64()), pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"]
        )


def digests(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of each document in the files at path.

    Only one total per file comes to the driver."""
    rows = read_orc(spark, path)
    totals = rows.groupBy("part").agg(F.max(F.col("part_start") + F.col("n_tokens")).alias("n")).collect()
    base, done = {}, 0
    for part, n in sorted((r["part"], r["n"]) for r in totals):
        base[part], done = done, done + n
    return rows.mapInArrow(partial(_digest, base=base), "doc_id long, start long, n_tokens long, ids_crc32 long")


def tokenize(docs: DataFrame, tokenizer_path: str, end_id: int = END_ID, as_stored: bool = False) -> DataFrame:
    """Write docs as ORC into the shared folder and return the digests of what is read back. Empty in, empty out."""
    spark = docs.sparkSession
    path = new_path(spark, "tokens-orc")
    write_orc(docs, path, tokenizer_path, end_id, as_stored=as_stored)
    return digests(spark, path)
