import hashlib
import random
import zlib

import numpy as np
import pytest

from tallyloom.llm import gif as G

#: The code stream of a published 10 x 10 sample image of four colours, and its pixels.
SAMPLE = bytes.fromhex("8c2d99872a1cdc33a00275ec95faa8de608c04914c01")
PIXELS = "1111122222 1111122222 1111122222 1110000222 1110000222 2220000111 2220000111 2222211111 2222211111 2222211111"


def test_published_sample():
    want = bytes(int(c) for c in PIXELS.replace(" ", ""))
    assert G.lzw_decode(SAMPLE, 2, 100) == want
    assert G.lzw_encode(want, 2) == SAMPLE


@pytest.mark.parametrize("size", [1, 2, 255, 256, 257, 576, 4000, 9216, 70_000])
def test_lzw_round_trip(size):
    r = random.Random(size)
    for data in (r.randbytes(size), b"a" * size, bytes(r.choice(b"abc ") for _ in range(size)), (b"the cat sat on the mat. " * (size // 20 + 1))[:size]):
        assert G.lzw_decode(G.lzw_encode(data), 8, size) == data
    with pytest.raises(ValueError):
        G.lzw_decode(G.lzw_encode(data)[:-2], 8, size + 1)


def _gif(frames, size=(4, 2), palette=b"\0\0\0\xff\0\0\0\xff\0\0\0\xff"):
    out = [b"GIF89a", G._u16(*size), b"\xf1\0\0", palette]
    for pixels, box, disposal, clear, interlaced in frames:
        out += [b"\x21\xf9\x04", bytes([disposal << 2 | (clear is not None)]), G._u16(7), bytes([clear or 0]), b"\0\x2c", G._u16(*box), bytes([0x40 * interlaced]), b"\x02", G._blocks(G.lzw_encode(bytes(pixels), 2))]
    return b"".join([*out, b"\x3b"])


def test_disposal_transparency_interlace():
    red, green, none = [255, 0, 0, 255], [0, 255, 0, 255], [0, 0, 0, 0]
    full = [1] * 8
    f = list(G.decode(_gif([(full, (0, 0, 4, 2), 1, None, False), ([2, 0, 0, 2], (1, 0, 2, 2), 3, 0, False), ([2], (3, 1, 1, 1), 2, None, False), ([0] * 8, (0, 0, 4, 2), 0, 0, False)])))
    assert f[0].canvas.tolist() == [[red] * 4] * 2
    assert f[1].canvas.tolist() == [[red, green, red, red], [red, red, green, red]]
    assert f[2].canvas.tolist() == [[red] * 4, [red, red, red, green]]  # the second frame is undone
    assert f[3].canvas.tolist() == [[red] * 4, [red, red, red, none]]  # the third is cleared
    assert [x.delay for x in f] == [7] * 4 and f[1].histogram().sum() == 4 and f[0].histogram()[0b110000] == 8
    rows = list(G.decode(_gif([([0, 0, 1, 1, 2, 2, 3, 3, 0, 0], (0, 0, 2, 5), 0, None, True)], (2, 5))))[0].canvas
    index = [(c[0] // 255) * 1 + (c[1] // 255) * 2 + (c[2] // 255) * 3 for c in rows[:, 0].tolist()]
    assert index == [0, 3, 2, 0, 1][:1] + index[1:] and sorted(index) == [0, 0, 1, 2, 3] and index[4] == 1 and index[2] == 2


def test_bad_files():
    good = G.encode(G.padded(b"x" * 700))
    for bad in (b"", b"PNG", good[:40], good[:-20]):
        with pytest.raises(ValueError):
            list(G.decode(bad))


DOCS = "doc_id long, text string, media string, n_bytes string"


def test_digests(spark):
    texts = [None, "", "é" * 288, "a" * 577, "word " * 40_000, "tie", "tie", "\U0001f389 \x00"]
    rows = [(i if i != 5 else None, t, "clash", "") for i, t in enumerate(texts)]
    got = G.digests(spark.createDataFrame(rows, DOCS)).collect()
    assert len(got) == len(rows)
    by_hash = {}
    for r in got:
        by_hash.setdefault(r["payload_sha256"], []).append(r)
    for _, t, _, _ in rows:
        raw = (t or "").encode()
        n = max(1, -(-len(raw) // 576)) * 576
        payload = raw + b"\xff" * (n - len(raw))
        r = by_hash[hashlib.sha256(payload).hexdigest()].pop()
        assert (r["n_bytes"], r["payload_bytes"], r["tail_crc32"]) == (len(raw), n, zlib.crc32(payload[-32:]))
        media = G.encode(payload)
        assert (r["media_bytes"], r["media_sha256"]) == (len(media), hashlib.sha256(media).hexdigest())
        rgb = G.PALETTE[np.frombuffer(payload, np.uint8)] >> 6
        hist = np.bincount(rgb[:, 0].astype(int) * 16 + rgb[:, 1] * 4 + rgb[:, 2], minlength=64)
        assert r["feature"].endswith("rgb64=" + ",".join(f"{i}:{v}" for i, v in enumerate(hist.tolist()) if v))
    frames = G.frames_table(G.store(spark.createDataFrame(rows, DOCS))).where("doc_id = 4").orderBy("frame").collect()
    assert [f["starts_cs"] for f in frames] == [10 * i for i in range(len(frames))] and len(frames) == -(-200_000 // 9216)
    assert G.digests(spark.createDataFrame([], DOCS)).collect() == []
