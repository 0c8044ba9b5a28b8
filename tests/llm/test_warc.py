import gzip
import hashlib
import io
import random

import pytest

from tallyloom.llm import warc as W

PAGES = "page_id long, url string, html string, digest string, n long"


def brute(rows, least):
    best = {}
    for i, _, html in rows:
        b = (html or "").encode()
        if i is not None:
            best[b] = max(best.get(b, i), i)
    out = []
    for i, _, html in rows:
        b = (html or "").encode()
        first = best.get(b) if len(b) >= least else i
        again = first is not None and first != i
        out.append((i, len(b), W.base32_sha1(b), "revisit" if again else "response", first if again else None))
    return sorted(out, key=str)


ROWS = [(1, "http://a/ü x", "<p>ä</p>"), (2, None, None), (3, "http://c", ""), (4, "http://a/", "<p>ä</p>"), (None, "http://n", "<p>ä</p>"), (7, "u", "WARC/1.1\r\n\r\n\r\n\r\nx"), (7, "u", "WARC/1.1\r\n\r\n\r\n\r\nx"),
        (None, "v", "only nulls"), (9, "big", "long text " * 200_000)]


@pytest.mark.parametrize("least", [0, 5])
def test_round_trip(spark, least):
    pages = spark.createDataFrame([(*r, "clash", 1) for r in ROWS], PAGES)
    assert sorted((tuple(r) for r in W.round_trip(pages, least).collect()), key=str) == brute(ROWS, least)


def test_hot_payload(spark):
    rows = [(i, "u", "same" if i % 3 else f"own {i}") for i in range(3000)]
    pages = spark.createDataFrame([(*r, "", 0) for r in rows], PAGES)
    assert sorted((tuple(r) for r in W.round_trip(pages).collect()), key=str) == brute(rows, 0)


def test_empty(spark):
    assert W.round_trip(spark.createDataFrame([], PAGES)).collect() == []


def test_every_record_is_a_member_that_the_index_finds(tmp_path):
    r = random.Random(2)
    records = [W.record("response", f"urn:page:{i}", r.randbytes(r.choice([0, 3, 70_000])), WARC_Payload_Digest=None) for i in range(40)]
    (tmp_path / "in.warc.gz").write_bytes(gzip.compress(b"".join(records)))
    archive, index, n = W.normalise_file(f"file://{tmp_path}/in.warc.gz", f"file://{tmp_path}/out")
    data = open(archive.removeprefix("file://"), "rb").read()
    assert n == 40 and gzip.decompress(data) == b"".join(records)
    import json

    entries = [json.loads(x) for x in open(index.removeprefix("file://"))]
    for e, whole in zip(entries, records, strict=True):
        assert gzip.decompress(data[e["offset"] : e["offset"] + e["length"]]) == whole


def test_damage_is_an_error():
    data = gzip.compress(W.record("response", "urn:x:1", b"abc"))
    for cut in (data[:-9], gzip.compress(gzip.decompress(data)[:-4])):
        with pytest.raises(ValueError):
            list(W.split_records(W.inflate(io.BytesIO(cut))))
    assert hashlib.sha1(b"").digest() and W.base32_sha1(b"") == "3I42H3S6NNFQ2MSVX7XZKYAYSCX5QBYJ"
