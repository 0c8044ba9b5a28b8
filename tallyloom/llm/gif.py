"""GIF as a store of byte payloads: LZW, palettes, disposal, transparency, timed frames and their colour histograms."""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import settle, tidy
from .superminhash import chunks

#: A unit of payload is a square of SIDE x SIDE pixels; a frame is as wide and holds up to UNITS of them.
SIDE, UNITS = 24, 16
UNIT_BYTES = SIDE * SIDE
FILL = b"\xff"
DELAY = 10  # hundredths of a second
#: Index i has i as its red part, so that colours tell indices.
PALETTE = np.stack([np.arange(256), np.arange(256) * 5 % 256, 255 - np.arange(256)], 1).astype(np.uint8)


def _run(bits: int) -> int:
    """Codes between two clear codes of an encoder that clears as soon as a code of 13 bits would be next."""
    return 4094 - (1 << bits)


@cache
def _width_mask(bits: int, n: int) -> np.ndarray:
    """[n, 16]: which bits of a stream's first n codes are written. As codes widen by their number since the last clear code
    alone, this is the same for all streams: a clear code, then again and again a run of codes and a clear code."""
    number = np.concatenate([[1], np.arange(n - 1) % (_run(bits) + 1) + 1])
    width = np.clip(np.ceil(np.log2((1 << bits) + number + 1)), bits + 1, 12)
    return np.arange(16) < width[:, None]


def lzw_encode(data: bytes, bits: int = 8) -> bytes:
    """A GIF code stream: clear code first, codes of bits + 1 to 12 bits, a new table whenever 4096 codes are in use.

    The table is a tree: a code's node maps the next value to the code of both."""
    clear, run = 1 << bits, _run(bits)
    codes, it = [clear], iter(data)
    put, code = codes.append, next(it, None)
    while code is not None:
        nodes: list[dict[int, int]] = [{} for _ in range(clear + 2)]
        new, node, opening = nodes.append, nodes[code], None
        nxt, full = clear + 2, clear + 2 + run
        for b in it:
            if b in node:
                code = node[b]
                node = nodes[code]
                continue
            put(code)
            node[b] = nxt
            new({})
            code, node = b, nodes[b]
            nxt += 1
            if nxt == full:
                put(clear)
                opening = b
                break
        else:
            put(code)
        code = opening
    put(clear + 1)
    n = len(codes)
    each = np.unpackbits(np.array(codes, "<u2").view(np.uint8).reshape(-1, 2), axis=1, bitorder="little")
    return np.packbits(each[_width_mask(bits, -(-n // 4096) * 4096)[:n]], bitorder="little").tobytes()


def lzw_decode(data: bytes, bits: int, size: int) -> bytes:
    """The first size values of a code stream; ValueError if it holds fewer or a code that has no meaning yet.

    Codes of one width are unpacked together; only looking them up goes one by one."""
    clear, end = 1 << bits, (1 << bits) + 1
    first = [bytes([i]) for i in range(clear)] + [b"", b""]
    stream = np.unpackbits(np.frombuffer(data, np.uint8), bitorder="little")
    out, n, at, table, width, last = [], 0, 0, first[:], bits + 1, None
    while n < size:
        # So many codes have this width: until the table, which each but the first adds to, has no free place for it.
        room = (1 << width) - len(table) + (last is None) if len(table) < 4096 else 4096
        k = min(room, (len(stream) - at) // width)
        if k <= 0:
            raise ValueError("the code stream ends early")
        codes = (stream[at : at + k * width].reshape(k, width) @ (1 << np.arange(width))).astype(np.int64)
        marks = np.flatnonzero((codes == clear) | (codes == end))
        stop = int(marks[0]) if len(marks) else k
        listed, got = codes[:stop].tolist(), len(out)
        at += min(stop + 1, k) * width
        if listed and last is None:
            last = table[listed[0]] if listed[0] < clear else b""
            if not last:
                raise ValueError("a code has no meaning yet")
            out.append(last)
            del listed[0]
        add, put = table.append, out.append
        try:
            if len(table) >= 4096:
                out += map(table.__getitem__, listed)
                last = out[-1]
            else:
                for code in listed:
                    if code == len(table):
                        entry = last + last[:1]
                    else:
                        entry = table[code]
                    add(last + entry[:1])
                    put(entry)
                    last = entry
        except IndexError:
            raise ValueError("a code has no meaning yet") from None
        n += sum(map(len, out[got:]))
        if stop < k:
            if codes[stop] == end:
                break
            table, width, last = first[:], bits + 1, None
        elif len(table) == 1 << width and width < 12:
            width += 1
    if n < size:
        raise ValueError("the code stream ends early")
    return b"".join(out)[:size]


def _u16(*values: int) -> bytes:
    return b"".join(v.to_bytes(2, "little") for v in values)


def _blocks(data: bytes) -> bytes:
    return b"".join(bytes([len(data[i : i + 255])]) + data[i : i + 255] for i in range(0, len(data), 255)) + b"\0"


def encode(payload: bytes, delay: int = DELAY) -> bytes:
    """payload (a positive multiple of UNIT_BYTES) as an animated GIF: each frame covers its rows of the canvas."""
    step = UNIT_BYTES * UNITS
    parts = [payload[i : i + step] for i in range(0, len(payload), step)]
    out = [b"GIF89a", _u16(SIDE, len(parts[0]) // SIDE), b"\xf7\0\0", PALETTE.tobytes(), b"\x21\xff\x0bNETSCAPE2.0\x03\x01\0\0\0"]
    for p in parts:
        out += [b"\x21\xf9\x04\x04", _u16(delay), b"\0\0", b"\x2c", _u16(0, 0, SIDE, len(p) // SIDE), b"\0\x08", _blocks(lzw_encode(p))]
    return b"".join([*out, b"\x3b"])


@dataclass
class Frame:
    canvas: np.ndarray  # rgba after this frame is drawn, [height, width, 4]
    box: tuple[int, int, int, int]  # left, top, width, height of what it drew
    delay: int
    disposal: int

    def histogram(self) -> np.ndarray:
        """Pixels of the frame's box in each of 64 colours (2 bits of red, green and blue)."""
        x, y, w, h = self.box
        rgb = self.canvas[y : y + h, x : x + w, :3].reshape(-1, 3) >> 6
        return np.bincount((rgb[:, 0].astype(np.int64) << 4) | (rgb[:, 1] << 2) | rgb[:, 2], minlength=64)


class _Reader:
    def __init__(self, data: bytes):
        self.data, self.at = data, 0

    def take(self, n: int) -> bytes:
        if self.at + n > len(self.data):
            raise ValueError("the GIF ends early")
        self.at += n
        return self.data[self.at - n : self.at]

    def u16(self) -> int:
        return int.from_bytes(self.take(2), "little")

    def blocks(self) -> bytes:
        parts = []
        while n := self.take(1)[0]:
            parts.append(self.take(n))
        return b"".join(parts)

    def palette(self, flags: int) -> np.ndarray:
        return np.frombuffer(self.take(3 << (flags & 7) + 1), np.uint8).reshape(-1, 3)


def _rows(height: int, interlaced: bool) -> np.ndarray:
    if not interlaced:
        return np.arange(height)
    return np.concatenate([np.arange(a, height, b) for a, b in ((0, 8), (4, 8), (2, 4), (1, 2))])


def decode(data: bytes) -> Iterator[Frame]:
    """The frames of any GIF, drawn one on another by disposal and transparency; pixels nothing was drawn on have alpha 0."""
    r = _Reader(data)
    if r.take(6) not in (b"GIF87a", b"GIF89a"):
        raise ValueError("no GIF")
    width, height, flags, _, _ = r.u16(), r.u16(), r.take(1)[0], r.take(1), r.take(1)
    shared = r.palette(flags) if flags & 0x80 else None
    canvas = np.zeros((height, width, 4), np.uint8)
    delay, disposal, clear = 0, 0, None
    while (kind := r.take(1)) != b"\x3b":
        if kind == b"\x21":
            label, body = r.take(1), r.blocks()
            if label == b"\xf9" and len(body) >= 4:
                disposal, delay, clear = body[0] >> 2 & 7, body[1] | body[2] << 8, body[3] if body[0] & 1 else None
        elif kind == b"\x2c":
            x, y, w, h, own = r.u16(), r.u16(), r.u16(), r.u16(), r.take(1)[0]
            palette = r.palette(own) if own & 0x80 else shared
            if palette is None:
                raise ValueError("a frame has no palette")
            bits = r.take(1)[0]
            index = np.frombuffer(lzw_decode(r.blocks(), bits, w * h), np.uint8).reshape(h, w)
            if own & 0x40:
                straight = np.empty_like(index)
                straight[_rows(h, True)] = index
                index = straight
            before = canvas.copy() if disposal == 3 else None
            index = index[: max(0, height - y), : max(0, width - x)]
            box = (x, y, index.shape[1], index.shape[0])
            colours = np.zeros((256, 4), np.uint8)
            colours[: len(palette), :3], colours[:, 3] = palette, 255
            region, seen = canvas[y : y + box[3], x : x + box[2]], slice(None) if clear is None else index != clear
            region[seen] = colours[index][seen]
            yield Frame(canvas.copy(), box, delay, disposal)
            if disposal == 2:
                region[...] = 0
            elif disposal == 3:
                canvas = before
            delay, disposal, clear = 0, 0, None
        else:
            raise ValueError("an unknown block")


def payload_of(frames: list[Frame]) -> bytes:
    return b"".join(f.canvas[f.box[1] : f.box[1] + f.box[3], f.box[0] : f.box[0] + f.box[2], 0].tobytes() for f in frames)


def padded(text: bytes) -> bytes:
    return text + FILL * (max(1, -(-len(text) // UNIT_BYTES)) * UNIT_BYTES - len(text))


@tidy
def _store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = batch.column(1).cast(pa.binary()).to_pylist()
        for a, b in chunks(texts):
            part = [t or b"" for t in texts[a:b]]
            media = [encode(padded(t)) for t in part]
            yield pa.RecordBatch.from_arrays([batch.column(0)[a:b], pa.array([len(t) for t in part], pa.int64()), pa.array(media, pa.binary())], names=["doc_id", "n_bytes", "media"])


@tidy
def _load(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows: tuple[list, ...] = tuple([] for _ in range(9))
        for doc, n, media in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            frames = list(decode(media))
            payload = payload_of(frames)
            each = [f.histogram() for f in frames]
            colours = sum(each, np.zeros(64, np.int64))
            feature = f"frames={len(frames)};cs={sum(f.delay for f in frames)};rgb64=" + ",".join(f"{i}:{v}" for i, v in enumerate(colours.tolist()) if v)
            values = (
                doc, n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(media), hashlib.sha256(media).hexdigest(), feature, [f.delay for f in frames]
            )
            for column, v in zip(rows, values, strict=True):
                column.append(v)
        types = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.list_(pa.int32()))
        yield pa.RecordBatch.from_arrays([pa.array(r, t) for r, t in zip(rows, types, strict=True)], names=[x.split()[0] for x in _RESULT.split(", ")])


_RESULT = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, delays array<int>"


def store(docs: DataFrame) -> DataFrame:
    """Settled (doc_id, n_bytes, media): each row of docs (doc_id, text; others are not read) as a GIF; null text is empty."""
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return settle(source.mapInArrow(_store, "doc_id long, n_bytes long, media binary"), "media", compression="uncompressed")


def frames_table(media: DataFrame) -> DataFrame:
    """A row per timed frame of media (doc_id, media): frame, starts_cs, delay_cs, disposal, histogram of 64 colours.

    A null media has no frames, a null doc_id stays; repeated rows repeat; a file that is no GIF is an error. Empty in, empty out."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doc, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if data is None:
                    continue
                t, rows = 0, []
                for i, f in enumerate(decode(data)):
                    rows.append({"doc_id": doc, "frame": i, "starts_cs": t, "delay_cs": f.delay, "disposal": f.disposal, "histogram": f.histogram().tolist()})
                    t += f.delay
                schema = pa.schema([("doc_id", pa.int64()), ("frame", pa.int32()), ("starts_cs", pa.int64()), ("delay_cs", pa.int32()), ("disposal", pa.int32()), ("histogram", pa.list_(pa.int64()))])
                yield pa.RecordBatch.from_pylist(rows, schema)

    return media.select("doc_id", "media").mapInArrow(each, "doc_id long, frame int, starts_cs long, delay_cs int, disposal int, histogram array<long>")


def digests(docs: DataFrame) -> DataFrame:
    """Store docs and return what the stored GIFs hold: sizes and digests of the payload and the file, and features.

    Each row stands alone: repeated rows repeat, equal texts have equal values, null or empty text is one unit of FILL,
    a null doc_id is kept. Empty table: empty result."""
    return store(docs).mapInArrow(_load, _RESULT)
