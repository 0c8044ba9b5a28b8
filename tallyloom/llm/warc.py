"""WARC archives: writing whole-file gzip streams, normalising them to one member a record, reading by the offset index."""

from __future__ import annotations

import base64
import hashlib
import json
import uuid
import zlib
from collections.abc import Iterable, Iterator
from functools import partial

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bit_filter, lookup, new_path, release, settle, sift

DATE = "2024-01-01T00:00:00Z"
#: A new archive is begun after so many bytes of records; members are read in stretches of about so many.
FILE_BYTES, STRETCH_BYTES = 512 << 20, 4 << 20
#: Compressed bytes inflated at a time, which can be some 1000 times as many.
_READ = 1 << 16
_GZIP = 31  # zlib's window bits for a gzip header


def _fs(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path)


def record(kind: str, record_id: str, block: bytes, **headers: str | None) -> bytes:
    """A WARC/1.1 record; headers' names are given with _ for -, those without a value are left out."""
    lines = [f"WARC-Type: {kind}", f"WARC-Record-ID: <{record_id}>", f"WARC-Date: {DATE}"]
    lines += [f"{k.replace('_', '-')}: {v}" for k, v in headers.items() if v is not None]
    return "\r\n".join(["WARC/1.1", *lines, f"Content-Length: {len(block)}", "", ""]).encode() + block + b"\r\n\r\n"


def split_records(pieces: Iterable[bytes]) -> Iterator[tuple[dict[str, str], bytes, bytes]]:
    """(headers by lower-case name, block, the whole record) of each record in a stream of bytes; holds one record."""
    it, held = iter(pieces), bytearray()

    def more() -> bool:
        for piece in it:
            held.extend(piece)
            return True
        return False

    while True:
        seen = 0
        while (end := held.find(b"\r\n\r\n", max(0, seen - 3))) < 0:
            seen = len(held)
            if not more():
                if bytes(held).strip():
                    raise ValueError("a WARC record is cut off in its headers")
                return
        first, *lines = held[:end].decode("utf-8").split("\r\n")
        if not first.lstrip().startswith("WARC/"):
            raise ValueError(f"no WARC record begins with {first[:40]!r}")
        headers = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
        size = int(headers["content-length"])
        while len(held) < end + 8 + size:
            if not more():
                raise ValueError("a WARC record is cut off in its block")
        yield headers, bytes(held[end + 4 : end + 4 + size]), bytes(held[: end + 8 + size])
        del held[: end + 8 + size]


def inflate(stream) -> Iterator[bytes]:
    """A gzip file's content in pieces; one member or many."""
    inflater, ended = zlib.decompressobj(_GZIP), True
    while data := stream.read(_READ):
        while data:
            piece = inflater.decompress(data)
            ended, data = inflater.eof, inflater.unused_data
            if piece:
                yield piece
            if ended:
                inflater = zlib.decompressobj(_GZIP)
    if not ended:
        raise ValueError("the gzip stream is cut off")


class _Archive:
    """A file of records in one gzip stream, under a name of its own: what a lost or repeated task leaves is never read."""

    def __init__(self, folder: str, level: int):
        self.fs, at = _fs(folder)
        self.fs.create_dir(at, recursive=True)
        name = f"part-{uuid.uuid4().hex}.warc.gz"
        self.path, self.out = f"{folder}/{name}", self.fs.open_output_stream(f"{at}/{name}", compression=None)
        self.gzip, self.records, self.bytes = zlib.compressobj(level, zlib.DEFLATED, _GZIP), 0, 0
        self.put(record("warcinfo", f"urn:uuid:{uuid.uuid4()}", b"format: WARC File Format 1.1\r\n", Content_Type="application/warc-fields"))
        self.records = 0

    def put(self, data: bytes) -> None:
        self.records, self.bytes = self.records + 1, self.bytes + len(data)
        self.out.write(self.gzip.compress(data))

    def close(self) -> tuple[str, int]:
        self.out.write(self.gzip.flush())
        self.out.close()
        return self.path, self.records


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _write(batches: Iterator[pa.RecordBatch], folder: str, prefix: str, level: int) -> Iterator[pa.RecordBatch]:
    archive, done = None, []
    for batch in batches:
        ids, urls, payloads, first = batch.columns
        rows = zip(ids.to_pylist(), urls.to_pylist(), payloads.cast(pa.binary()).to_pylist(), first.to_pylist(), strict=True)
        for page, url, payload, refers in rows:
            payload = payload or b""
            head = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
            name = lambda i: f"{prefix}:{'none' if i is None else i}"
            common = {
                "WARC_Target_URI": None if url is None else " ".join(url.split()), "WARC_Payload_Digest": f"sha1:{base32_sha1(payload)}", "Content_Type": "application/http; msgtype=response"
            }
            if archive is None or archive.bytes > FILE_BYTES:
                done += [archive.close()] if archive else []
                archive = _Archive(folder, level)
            if refers is None:
                archive.put(record("response", name(page), head + payload, **common))
            else:
                profile = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
                archive.put(record("revisit", name(page), head, **common, WARC_Refers_To=f"<{name(refers)}>", WARC_Profile=profile))
    done += [archive.close()] if archive else []
    yield pa.RecordBatch.from_pydict({"path": pa.array([p for p, _ in done], pa.string()), "records": pa.array([n for _, n in done], pa.int64())})


def write_monolithic(pages: DataFrame, folder: str, min_bytes: int = 0, prefix: str = "urn:page", level: int = 1) -> DataFrame:
    """Write a record per row of pages (page_id, url, payload string) into archives of one gzip stream each.

    Of rows with equal payloads of at least min_bytes bytes the one with the largest page_id is a response, the others
    revisit it. Payloads that surely stand alone are not shuffled; one that very many pages share is looked up in a broadcast
    (see common.lookup), so its pages stay spread. Returns settled (path, records)."""
    source = pages.withColumn("digest", F.sha1(F.coalesce(F.col("payload"), F.lit("")).cast("binary")))
    big = source.where(F.coalesce(F.octet_length("payload"), F.lit(0)) >= min_bytes) if min_bytes > 0 else source
    groups = big.groupBy("digest").agg(F.count(F.lit(1)).alias("n"), F.max("page_id").alias("first_id")).where("n > 1")
    groups = settle(groups, "payloads")
    near, alone = sift(source, bit_filter(groups, F.xxhash64("digest")), F.xxhash64("digest"))
    placed = lookup(near, groups, ["digest"], "n", F.struct("page_id", "url")).unionByName(alone.withColumn("first_id", F.lit(None).cast("long")))
    enough = F.coalesce(F.octet_length("payload"), F.lit(0)) >= min_bytes
    refers = F.when(enough & ~F.col("first_id").eqNullSafe(F.col("page_id")), F.col("first_id"))
    rows = placed.select("page_id", "url", "payload", refers.alias("refers_to"))
    manifest = settle(rows.mapInArrow(partial(_write, folder=folder, prefix=prefix, level=level), "path string, records long"), "manifest")
    release(groups)
    return manifest


def normalise_file(path: str, folder: str, level: int = 6) -> tuple[str, str, int]:
    """Inflate path once and rewrite each record as a gzip member; (archive, index, records).

    The index has a JSON line for each record: archive, offset, length (of the member), type, id."""
    source, at = _fs(path)
    target, to = _fs(folder)
    target.create_dir(to, recursive=True)
    name = f"part-{uuid.uuid4().hex}"
    archive, index, offset, n = f"{folder}/{name}.warc.gz", f"{folder}/{name}.idx.json", 0, 0
    with source.open_input_stream(at, compression=None) as data, target.open_output_stream(f"{to}/{name}.warc.gz", compression=None) as out, target.open_output_stream(f"{to}/{name}.idx.json") as lines:
        for headers, _, whole in split_records(inflate(data)):
            packer = zlib.compressobj(level, zlib.DEFLATED, _GZIP)
            member = packer.compress(whole) + packer.flush()
            out.write(member)
            entry = {"archive": archive, "offset": offset, "length": len(member), "type": headers.get("warc-type"), "id": headers.get("warc-record-id")}
            lines.write(json.dumps(entry).encode() + b"\n")
            offset, n = offset + len(member), n + 1
    return archive, index, n


def _normalise(batches: Iterator[pa.RecordBatch], folder: str) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for path in batch.column(0).to_pylist():
            archive, index, n = normalise_file(path, folder)
            yield pa.RecordBatch.from_pydict({"archive": [archive], "index": [index], "records": [n]})


def normalise(manifest: DataFrame, folder: str) -> DataFrame:
    """One task per archive of manifest (path); settled (archive, index, records)."""
    n = max(1, manifest.count())
    return settle(manifest.select("path").repartition(n).mapInArrow(partial(_normalise, folder=folder), "archive string, index string, records long"), "normalised")


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    number = lambda x: None if x is None or x.rstrip(">").endswith(":none") else int(x.strip("<>").rpartition(":")[2])
    for batch in batches:
        for path, offset, length in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            source, at = _fs(path)
            rows: tuple[list, ...] = ([], [], [], [], [])
            with source.open_input_file(at) as f:
                data = f.read_at(length, offset)
            for headers, block, _ in split_records(inflate(pa.BufferReader(data))):
                if headers["warc-type"] == "warcinfo":
                    continue
                digest = headers["warc-payload-digest"].removeprefix("sha1:")
                head, _, payload = block.partition(b"\r\n\r\n")
                size = next(int(x.partition(b":")[2]) for x in head.split(b"\r\n") if x.lower().startswith(b"content-length:"))
                if headers["warc-type"] == "response" and (len(payload) != size or base32_sha1(payload) != digest):
                    raise ValueError(f"{path} at {offset}: payload of {headers['warc-record-id']} does not match its digest")
                for column, v in zip(rows, (number(headers["warc-record-id"]), size, digest, headers["warc-type"], number(headers.get("warc-refers-to"))), strict=True):
                    column.append(v)
            types = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(r, t) for r, t in zip(rows, types, strict=True)], names=["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"])


def stretches(spark: SparkSession, folder: str, size: int = STRETCH_BYTES) -> DataFrame:
    """(archive, offset, length): runs of whole members, from the sidecar indexes alone."""
    entries = spark.read.schema("archive string, offset long, length long").json(f"{folder}/*.idx.json")
    runs = entries.groupBy("archive", F.expr(f"offset DIV {size}").alias("run")).agg(F.min("offset").alias("offset"), F.max(F.col("offset") + F.col("length")).alias("end"))
    return runs.select("archive", "offset", (F.col("end") - F.col("offset")).alias("length"))


def read_archives(spark: SparkSession, folder: str) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) of each record but warcinfo; digests are verified."""
    schema = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"
    runs = settle(stretches(spark, folder), "stretches")
    return runs.repartition(max(1, runs.count())).mapInArrow(_read, schema)  # by bytes a run is little, by work it is a task


def round_trip(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """Archive pages (page_id, url, html; others are not read), normalise the archives, read them back by their indexes.

    Null html is an empty payload; a null page_id is kept, and revisits the largest id of its payload if there is one.
    Rows that share both page_id and payload have the same type. Empty table: empty result."""
    spark = pages.sparkSession
    folder = new_path(spark, "warc")
    source = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("payload"))
    manifest = write_monolithic(source, f"{folder}/whole", min_bytes)
    if manifest.isEmpty():
        return spark.createDataFrame([], "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")
    normalise(manifest, f"{folder}/members")
    return read_archives(spark, f"{folder}/members")


ORACLE = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b, sha1(encode(coalesce(html, ''))) AS h FROM pages),
g AS (SELECT h, max(page_id) AS first_id FROM p GROUP BY h)
SELECT page_id, octet_length(b)::BIGINT AS payload_bytes,
  array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    ((('0x' || substr(h, (i // 4 * 5 + 1)::INT, 5))::INT >> (15 - 5 * (i % 4))::INT) & 31) + 1, 1)), '') AS payload_digest,
  CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> first_id THEN first_id END AS refers_to
FROM p JOIN g USING (h)
"""
