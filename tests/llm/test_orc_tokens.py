import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.orc
from tokenizers import Tokenizer

from tallyloom.llm import orc_tokens as O

PATH = public_tokenizers.path("word_bpe_49k.json")
DOCS = "doc_id long, text string, part string, ids string"


def brute(rows):
    t, out, start = Tokenizer.from_file(PATH), [], 0
    for i, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or "")):
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 1]
        out.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


ROWS = [
    (5, "The Café isn't 12.5km away; ΣΑΣ İstanbul K"), (3, None), (4, ""), (9, "<|endoftext|> a<|startoftext|>b < | x y z\x1ct"), (2, "é ́x it's\tTHEY'RE"),
    (7, "word " * 30000), (None, "no id"), (2, "again"), (2, "again"), (11, "中文 かな 🎉🎉 " * 3), (12, "a\x00b \x0b\x0c\r\n")]


def test_words_as_in_whole_texts():
    """Random texts, among them letters whose lower case ends in a mark, against the encoding of the whole text."""
    r, whole, own = random.Random(3), Tokenizer.from_file(PATH), O.WordEncoder(PATH)
    cores = ["SAFİ", "İ", "i\u0307", "Straße", "ǅ", "ΣΑΣ", "e\u0301", "x\u0338", "it's", "3", "½", "中", "🎉", "don't", "K", "a\u00a0b", "<|endoftext|>", "<|x", "_", "ab_c", "\u0301", "ﬁ", "\x1c"]
    marks = ["", "", ".", "!!", ",###", "'", "\"", "***)", "$%&", "'s", "|>", "...'re", "_", "-"]
    texts = ["".join(r.choice(marks) + r.choice(cores) + r.choice(marks) + r.choice([" ", "  ", "\t", "\n", "\x0b"]) for _ in range(r.randint(0, 9))) for _ in range(4000)]
    for i in range(0, len(texts), 500):
        ids, begins = own.encode(pa.array(texts[i : i + 500]), 1)
        for k, text in enumerate(texts[i : i + 500]):
            assert ids[begins[k] : begins[k + 1]].tolist() == [*whole.encode(text, add_special_tokens=False).ids, 1], text


def test_same_as_whole_text_encoding(spark):
    docs = spark.createDataFrame([(i, t, "", "") for i, t in ROWS], DOCS)
    got = sorted((tuple(r) for r in O.tokenize(docs, PATH).collect()), key=lambda r: r[1])
    assert got == brute(ROWS)


def test_corpus_sample(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got = sorted((tuple(r) for r in O.tokenize(docs, PATH).collect()), key=lambda r: r[1])
    assert got == brute([(r["doc_id"], r["text"]) for r in docs.collect()])


def test_files_hold_bloom_filters_and_serve_lookups(spark, tmp_path):
    docs = spark.range(5000).selectExpr("id AS doc_id", "concat('doc ', id) AS text")
    path = str(tmp_path / "t")
    O.write_orc(docs, path, PATH)
    got = O.read_orc(spark, path, [17, 4321]).collect()
    assert sorted(r["doc_id"] for r in got) == [17, 4321]
    assert "PushedFilters: [In(doc_id" in O.read_orc(spark, path, [17, 4321])._jdf.queryExecution().toString()
    for file in (tmp_path / "t").glob("*.orc"):
        meta = pa.orc.ORCFile(file)
        assert meta.row_index_stride == 2000


def test_stripes_are_pruned(spark, tmp_path):
    """Of a file of many stripes a look-up reads few rows: by the ranges of doc_id, and for an id within a range that no row has
    by the Bloom filter alone."""
    docs = spark.range(60_000).selectExpr("id * 2 AS doc_id", "concat('doc ', id, ' ', repeat(md5(cast(id AS string)), 3)) AS text").coalesce(1)
    path = str(tmp_path / "t")
    O.write_orc(docs, path, PATH, stripe_bytes=1 << 20, stride=1000)

    def rows_read(ids):
        df = O.read_orc(spark, path, ids).select("doc_id")
        got = [r[0] for r in df.collect()]
        plan = df._jdf.queryExecution().executedPlan()
        plan = plan.executedPlan() if plan.getClass().getSimpleName() == "AdaptiveSparkPlanExec" else plan
        scan = next(x for x in (plan.collectLeaves().apply(i) for i in range(plan.collectLeaves().size())))
        return got, scan.metrics().apply("numOutputRows").value()

    assert rows_read(None)[1] == 60_000
    got, read = rows_read([60_000])
    assert got == [60_000] and read <= 1000
    assert sum(rows_read([i])[1] for i in range(20_001, 100_000, 8000)) <= 1000  # odd ids: ten strides without the filter


def test_empty(spark):
    assert O.tokenize(spark.createDataFrame([], DOCS), PATH).collect() == []
