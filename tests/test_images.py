"""PNG files of all kinds against a plain reader, the blank test, resizing against sums written out."""

import math
import random
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from datamill.operators import images


def chunk(kind, body):
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def png(w, h, depth, colour, lines, extra=b"", interlaced=0):
    return images.SIGNATURE + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, depth, colour, 0, 0, interlaced)) + extra + chunk(b"IDAT", zlib.compress(lines)) + chunk(b"IEND", b"")


def plain_unfiltered(rows, kinds):
    h, w, c = rows.shape
    out = np.zeros((h, w, c), int)
    for y in range(h):
        for x in range(w):
            for k in range(c):
                a, b, d = (out[y, x - 1, k] if x else 0), (out[y - 1, x, k] if y else 0), (out[y - 1, x - 1, k] if x and y else 0)
                p = a + b - d
                paeth = min((abs(p - a), 0, a), (abs(p - b), 1, b), (abs(p - d), 2, d))[2]
                out[y, x, k] = (int(rows[y, x, k]) + [0, a, b, (a + b) // 2, paeth][kinds[y]]) % 256
    return out.astype(np.uint8)


def test_filters():
    r = np.random.default_rng(3)
    for most in (2, 4):
        for _ in range(20):
            h, w, c = r.integers(1, 9), r.integers(1, 9), r.choice([1, 2, 3, 4])
            rows, kinds = r.integers(0, 256, (h, w, c)).astype(np.uint8), r.integers(0, most + 1, h)
            want = plain_unfiltered(rows, kinds)
            assert (images.unfiltered(rows, kinds) == want).all()
            assert (images.filtered(want, kinds) == rows).all()


@pytest.mark.parametrize("channels", [1, 2, 3, 4])
def test_round_trip(channels):
    r = np.random.default_rng(channels)
    pixels = r.integers(0, 256, (23, 17, channels)).astype(np.uint8)
    for kinds in (0, 1, 2, 3, 4, np.arange(23) % 5):
        assert (images.decoded(images.encoded(pixels, kinds)) == pixels).all()


def test_depths_palettes_and_alpha():
    for depth in (1, 2, 4):
        values = [random.Random(depth).randrange(1 << depth) for _ in range(5)]
        bits = "".join(f"{v:0{depth}b}" for v in values)
        line = b"\0" + int(bits.ljust(-(-len(bits) // 8) * 8, "0"), 2).to_bytes(-(-len(bits) // 8), "big")
        assert images.decoded(png(5, 1, depth, 0, line))[0, :, 0].tolist() == [v * 255 // ((1 << depth) - 1) for v in values]
        palette = bytes(range(3 * (1 << depth)))
        got = images.decoded(png(5, 1, depth, 3, line, chunk(b"PLTE", palette) + chunk(b"tRNS", b"\7")))
        assert got[0].tolist() == [[3 * v, 3 * v + 1, 3 * v + 2, 7 if v == 0 else 255] for v in values]
    assert images.decoded(png(2, 1, 16, 2, b"\0" + bytes(range(12))))[0].tolist() == [[0, 2, 4], [6, 8, 10]]


def test_errors():
    good = images.encoded(np.zeros((3, 3, 1), np.uint8))
    cases = {
        b"": "not a PNG file", b"GIF89a": "not a PNG file", good[:40]: "the file is cut off", images.SIGNATURE: "the file is cut off", images.SIGNATURE + chunk(b"IEND", b""): "no header", png(1, 1, 8, 5, b"\0\0"): "unknown colours", png(1, 1, 8, 0, b"\0\0", interlaced=1): "interlaced",
        png(6000, 6000, 8, 0, b""): "too many pixels", png(2, 2, 8, 0, b"\0\0"): "too few pixels", png(1, 1, 8, 0, b"\5\0"): "unknown filter", png(1, 1, 8, 3, b"\0\7", chunk(b"PLTE", b"abc")): "a colour that the palette doesn't have",
    }
    for data, error in cases.items():
        assert images.prepared(data, 10) == {"error": error}
    assert images.prepared(None, 10) is None and "error" in images.prepared(good[:41] + b"x" * 20, 10)


def plain_resized(line, new):
    old = len(line)
    scale, out = max(old / new, 1), []
    for i in range(new):
        middle = (i + 0.5) * old / new
        w = []
        for k in range(old):
            x = (k + 0.5 - middle) / scale
            w.append(0 if abs(x) >= 3 else 1 if x == 0 else math.sin(math.pi * x) / (math.pi * x) * math.sin(math.pi * x / 3) / (math.pi * x / 3))
        out.append(min(255, max(0, round(sum(a * b for a, b in zip(w, line)) / sum(w)))))
    return out


def test_resizing():
    r = np.random.default_rng(5)
    for h, w, nh, nw in ((10, 10, 5, 5), (7, 30, 3, 11), (4, 5, 8, 9), (1, 1, 1, 1), (50, 3, 7, 1)):
        pixels = r.integers(0, 256, (h, w, 3)).astype(np.uint8)
        lines = np.array([[plain_resized(pixels[y, :, c].tolist(), nw) if w != nw else pixels[y, :, c].tolist() for c in range(3)] for y in range(h)])
        want = np.array([[plain_resized(lines[:, c, x].tolist(), nh) if h != nh else lines[:, c, x].tolist() for c in range(3)] for x in range(nw)])
        assert np.abs(images.resized(pixels, nw, nh).astype(int) - want.transpose(2, 0, 1)).max() <= 1
    assert (images.resized(np.full((9, 9, 4), 77, np.uint8), 4, 2) == 77).all()
    assert images.new_size(100, 50, 640) == (100, 50) and images.new_size(1000, 333, 640) == (640, 213) and images.new_size(3000, 2, 64) == (64, 1)


def test_blank_and_white():
    page = np.full((40, 60, 4), 255, np.uint8)
    page[:, :, 3] = 0
    assert images.is_blank(page) and images.on_white(page).min() == 255
    page[20, 30, 1] = 249
    assert not images.is_blank(page)
    assert images.on_white(np.array([[[10, 20, 30, 128]]], np.uint8))[0, 0].tolist() == [132, 137, 142]
    assert images.on_white(np.array([[[9, 3]]], np.uint8))[0, 0].tolist() == [9, 9, 9]


def test_column(spark):
    page = np.random.default_rng(1).integers(0, 256, (30, 90, 4)).astype(np.uint8)
    df = spark.createDataFrame([(1, images.encoded(page, 4)), (2, b"no"), (3, None)], "i int, image binary")
    got = {r["i"]: r["p"] for r in df.select("i", images.prepare(F.col("image"), 45).alias("p")).collect()}
    assert (got[1]["width"], got[1]["height"], got[1]["new_width"], got[1]["new_height"], got[1]["blank"]) == (90, 30, 45, 15, False)
    assert images.decoded(bytes(got[1]["png"])).shape == (15, 45, 3)
    assert got[2]["error"] == "not a PNG file" and got[3] is None


def test_lines_that_refer_to_several_neighbours(monkeypatch):
    """Byte by byte and by diagonals they are the same, in images of any shape; a narrow one takes no work for each diagonal."""
    r = np.random.default_rng(8)
    for h, w in ((1, 1), (1, 9), (9, 1), (5, 8), (8, 5), (7, 7)):
        for c in (1, 2, 3, 4, 6, 8):
            rows, kinds = r.integers(0, 256, (h, w, c)).astype(np.uint8), r.integers(0, 5, h)
            want = plain_unfiltered(rows, kinds)
            assert (images.by_diagonals(rows, kinds) == want).all()
            assert (images.unfiltered(rows, kinds) == want).all() and (images.filtered(want, kinds) == rows).all()
    wide, tall = (r.integers(0, 256, shape).astype(np.uint8) for shape in ((200, 300, 3), (300, 200, 3)))
    for pixels in (wide, tall):
        assert (images.unfiltered(images.filtered(pixels, np.full(len(pixels), 4)), np.full(len(pixels), 4)) == pixels).all()
    rows, kinds, calls, plain = r.integers(0, 256, (400, 60, 1)).astype(np.uint8), np.arange(400) % 5, [], np.abs
    monkeypatch.setattr(np, "abs", lambda x: calls.append(1) or plain(x))
    images.unfiltered(rows, kinds)
    assert len(calls) < 400


def test_weights_within_reach(monkeypatch):
    """The windowed sinc is computed where it isn't zero, six old pixels times the scale for a new one, not for all pairs."""
    def everywhere(old, new):
        x = (np.arange(old)[None, :] + 0.5 - (np.arange(new)[:, None] + 0.5) * (old / new)) / max(old / new, 1.0)
        weights = np.where(np.abs(x) < 3, np.sinc(x) * np.sinc(x / 3), 0.0)
        return weights / weights.sum(axis=1, keepdims=True)

    for old, new in ((1, 1), (2, 1), (1, 5), (7, 3), (64, 63), (40, 9), (5, 40), (1999, 64)):
        assert (images.resampling(old, new) == everywhere(old, new)).all()
    sizes, plain = [], np.sinc
    monkeypatch.setattr(np, "sinc", lambda x: sizes.append(x.size) or plain(x))
    images.resampling(2000, 64)
    assert sum(sizes) < 2 * 7 * 2000
