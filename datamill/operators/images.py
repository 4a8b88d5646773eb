"""Images as PNG files in a binary column: pixels, the blank test, resizing, and writing them again.

PNG files of all colour types and depths are read (deflated scan lines, five kinds of filters), but
for interlaced ones. Sizes come from the header, and files of more than ``MOST_PIXELS`` are refused
before a pixel is unpacked. What can't be read is a row with its error. Nulls stay null.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

SIGNATURE = b"\x89PNG\r\n\x1a\n"
MOST_PIXELS = 30_000_000
#: A sampled channel that is at least so bright counts as white.
WHITE = 250
#: Channels of the colour types of a PNG file: grey, RGB, palette, grey and alpha, RGB and alpha.
CHANNELS = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}
LOBES = 3
#: Bytes of lines that refer to several neighbours, for each diagonal of an image, from which the diagonals are followed instead of the bytes.
BYTES_A_DIAGONAL = 80


def chunks_of(data: bytes):
    """(kind, body) of a file's chunks."""
    if data[: len(SIGNATURE)] != SIGNATURE:
        raise ValueError("not a PNG file")
    at, kind = len(SIGNATURE), b""
    while kind != b"IEND":
        head, at = data[at : at + 8], at + 8
        size, kind = struct.unpack(">I4s", head) if len(head) == 8 else (1, b"")
        body = data[at : at + size]
        if len(body) < size:
            raise ValueError("the file is cut off")
        yield kind, body
        at += size + 4


def summed(line: bytes, above: bytes, kind: int, pixel: int) -> bytes:
    """The bytes of a line that refers to several neighbours, one after another."""
    out = [0] * pixel
    if kind == 3:
        for k, (value, up) in enumerate(zip(line, above)):
            out.append((value + ((out[k] + up) >> 1)) & 255)
        return bytes(out[pixel:])
    for k, (value, up, corner) in enumerate(zip(line, above, bytes(pixel) + above)):
        left = out[k]
        to_left, to_up = up - corner, left - corner
        to_corner = abs(to_left + to_up)
        to_left, to_up = abs(to_left), abs(to_up)
        out.append((value + (left if to_left <= to_up and to_left <= to_corner else up if to_up <= to_corner else corner)) & 255)
    return bytes(out[pixel:])


def by_diagonals(rows: np.ndarray, kinds: np.ndarray) -> np.ndarray:
    """As ``unfiltered``, along the diagonals, on which no pixel refers to another."""
    h, w, pixel = rows.shape
    tall, n = h > w, min(h, w)
    # Diagonal t is line t + 2; a pixel's place there is one more than its number on the shorter side. What lies outside stays zero.
    given = np.zeros((h + w + 1, n + 1, pixel), np.uint8)
    down, across, deep = given.strides
    out = np.lib.stride_tricks.as_strided(given[2:, 1:], (h, w, pixel), (down, down + across, deep) if tall else (down + across, down, deep))
    out[:] = rows
    which = [(kinds[::-1] if tall else kinds)[:, None] == k for k in range(5)]
    for t in range(h + w - 1):
        a, b = max(0, t - max(h, w) + 1), min(n, t + 1)
        first = h - 1 - t if tall else 0
        left, up, corner = (x.astype(np.int16) for x in (given[t + 1, a + 1 : b + 1], given[t + 1, a:b], given[t, a:b]))
        if tall:
            left, up = up, left
        to_left, to_up = up - corner, left - corner
        to_corner = np.abs(to_left + to_up)
        to_left, to_up = np.abs(to_left), np.abs(to_up)
        guess = np.where((to_left <= to_up) & (to_left <= to_corner), left, np.where(to_up <= to_corner, up, corner))
        for k, other in ((3, (left + up) >> 1), (2, up), (1, left), (0, 0)):
            np.copyto(guess, other, where=which[k][first + a : first + b])
        given[t + 2, a + 1 : b + 1] += guess.astype(np.uint8)
    return out.copy()


def unfiltered(rows: np.ndarray, kinds: np.ndarray) -> np.ndarray:
    """Bytes of scan lines (height, pixels, bytes of a pixel) from filtered ones.

    Lines that refer to no or one neighbour are running sums, over many lines at once. Those that refer to
    several are followed byte by byte where they are few or short, else by the diagonals of the image.
    """
    h, w, pixel = rows.shape
    if kinds.max(initial=0) > 4:
        raise ValueError("unknown filter")
    several = kinds > 2
    if int(several.sum()) * w * pixel > BYTES_A_DIAGONAL * (w + h):
        return by_diagonals(rows, kinds)
    out = rows.copy()
    sub = kinds == 1
    out[sub] = np.cumsum(out[sub], axis=1, dtype=np.uint8)
    # Runs of lines of one kind, from the first that refers to the line above.
    starts = np.flatnonzero(np.diff(kinds, prepend=-1))
    for a, b in zip(starts.tolist(), [*starts[1:].tolist(), h]):
        if kinds[a] == 2:
            out[max(0, a - 1) : b] = np.cumsum(out[max(0, a - 1) : b], axis=0, dtype=np.uint8)
        elif kinds[a] > 2:
            for y in range(a, b):
                above = out[y - 1].tobytes() if y else bytes(w * pixel)
                out[y] = np.frombuffer(summed(out[y].tobytes(), above, int(kinds[y]), pixel), np.uint8).reshape(w, pixel)
    return out


def decoded(data: bytes) -> np.ndarray:
    """Pixels (height, width, channels) of 8 bits; palettes are RGB, or RGB and alpha where colours are transparent."""
    header, palette, alpha, body = None, None, None, []
    for kind, part in chunks_of(data):
        if kind == b"IHDR":
            header = struct.unpack(">IIBBBBB", part)
            w, h, depth, colour, _, _, interlaced = header
            if w * h > MOST_PIXELS:
                raise ValueError("too many pixels")
            if interlaced or colour not in CHANNELS or depth not in (1, 2, 4, 8, 16):
                raise ValueError("interlaced" if interlaced else "unknown colours")
        elif kind == b"PLTE":
            palette = np.frombuffer(part, np.uint8).reshape(-1, 3)
        elif kind == b"tRNS":
            alpha = np.frombuffer(part, np.uint8)
        elif kind == b"IDAT":
            body.append(part)
    if header is None:
        raise ValueError("no header")
    channels = CHANNELS[colour]
    pixel = max(1, channels * depth // 8)  # bytes that a filter looks back
    line = (w * channels * depth + 7) // 8
    raw = zlib.decompressobj().decompress(b"".join(body), h * (line + 1))
    if len(raw) < h * (line + 1):
        raise ValueError("too few pixels")
    raw = np.frombuffer(raw, np.uint8).reshape(h, line + 1)
    flat = unfiltered(raw[:, 1:].reshape(h, line // pixel, pixel), raw[:, 0].astype(np.int64)).reshape(h, line)
    if depth == 16:
        flat = flat[:, ::2]  # the upper bytes
    elif depth < 8:
        bits = np.unpackbits(flat, axis=1)[:, : w * depth].reshape(h, w, depth)
        flat = bits @ (1 << np.arange(depth - 1, -1, -1))
        flat = (flat if colour == 3 else flat * (255 // ((1 << depth) - 1))).astype(np.uint8)
    pixels = flat.reshape(h, w, channels)
    if colour != 3:
        return pixels
    if palette is None or int(pixels.max(initial=0)) >= len(palette):
        raise ValueError("a colour that the palette doesn't have")
    found = palette[pixels[:, :, 0]]
    if alpha is None:
        return found
    opaque = np.full(len(palette), 255, np.uint8)
    opaque[: len(alpha)] = alpha[: len(palette)]
    return np.dstack([found, opaque[pixels[:, :, 0]]])


def filtered(rows: np.ndarray, kinds: np.ndarray) -> np.ndarray:
    """Scan lines (height, pixels, bytes of a pixel) by the filter of each."""
    wide = np.zeros((rows.shape[0] + 1, rows.shape[1] + 1, rows.shape[2]), np.uint8)
    wide[1:, 1:] = rows
    out = rows.copy()
    for kind in np.unique(kinds):
        y = slice(None) if (kinds == kind).all() else kinds == kind
        if kind == 1:
            out[y] -= wide[1:, :-1][y]
        elif kind == 2:
            out[y] -= wide[:-1, 1:][y]
        elif kind > 2:
            left, up, corner = (part[y].astype(np.int16) for part in (wide[1:, :-1], wide[:-1, 1:], wide[:-1, :-1]))
            if kind == 3:
                out[y] -= ((left + up) >> 1).astype(np.uint8)
                continue
            to_left, to_up = up - corner, left - corner
            to_corner = np.abs(to_left + to_up)
            to_left, to_up = np.abs(to_left), np.abs(to_up)
            out[y] -= np.where((to_left <= to_up) & (to_left <= to_corner), left, np.where(to_up <= to_corner, up, corner)).astype(np.uint8)
    return out


def encoded(pixels: np.ndarray, kinds: np.ndarray | int = 1) -> bytes:
    """A PNG file of 8-bit pixels (height, width, channels); ``kinds``: the filter of each line."""
    h, w, channels = pixels.shape
    kinds = np.broadcast_to(np.asarray(kinds), (h,))
    lines = np.column_stack([kinds.astype(np.uint8), filtered(pixels, kinds).reshape(h, w * channels)])
    colour = {n: c for c, n in CHANNELS.items() if c != 3}[channels]
    chunk = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    return SIGNATURE + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, colour, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(lines.tobytes())) + chunk(b"IEND", b"")


def is_blank(pixels: np.ndarray) -> bool:
    """Are the middle and the two quarter points white? Transparency doesn't count."""
    h, w, channels = pixels.shape
    points = [(h // 2, w // 2), (h // 4, w // 4), (3 * h // 4, 3 * w // 4)]
    return all((pixels[y, x, : channels if channels % 2 else channels - 1] >= WHITE).all() for y, x in points)


def new_size(width: int, height: int, most: int) -> tuple[int, int]:
    """The size with the longer side cut to ``most``, at least one pixel each way."""
    longest = max(width, height)
    if longest <= most:
        return width, height
    scale = most / longest
    return max(1, int(width * scale)), max(1, int(height * scale))


def resampling(old: int, new: int) -> np.ndarray:
    """Weights (new, old) of a windowed sinc of three lobes, as wide as the scale asks for."""
    scale = max(old / new, 1.0)
    middle = (np.arange(new)[:, None] + 0.5) * (old / new)
    # Only so many places around the middle are within reach.
    reach = int(LOBES * scale) + 1
    at = np.floor(middle).astype(np.int64) + np.arange(-reach, reach + 1)
    x = (at + 0.5 - middle) / scale
    near = np.where((np.abs(x) < LOBES) & (at >= 0) & (at < old), np.sinc(x) * np.sinc(x / LOBES), 0.0)
    weights = np.zeros((new, old))
    line, place = np.nonzero(near)
    weights[line, at[line, place]] = near[line, place]
    return weights / weights.sum(axis=1, keepdims=True)


def resized(pixels: np.ndarray, width: int, height: int) -> np.ndarray:
    """Pixels of another size: lines first, then columns, each rounded to 8 bits."""
    out = pixels
    for axis, new in ((1, width), (0, height)):
        if out.shape[axis] != new:
            moved = np.moveaxis(out, axis, -1).astype(np.float64) @ resampling(out.shape[axis], new).T
            out = np.moveaxis(np.clip(np.rint(moved), 0, 255).astype(np.uint8), -1, axis)
    return out


def on_white(pixels: np.ndarray) -> np.ndarray:
    """RGB pixels: colours with alpha over white, grey as three equal channels."""
    h, w, channels = pixels.shape
    colours = pixels[:, :, : channels - 1 + channels % 2]
    colours = np.broadcast_to(colours, (h, w, 3)) if colours.shape[2] == 1 else colours
    if channels != 4:
        return np.ascontiguousarray(colours)
    share = pixels[:, :, 3:].astype(np.float64) / 255
    return np.rint(colours * share + 255 * (1 - share)).astype(np.uint8)


IMAGE = T.StructType([
    T.StructField("width", T.IntegerType()), T.StructField("height", T.IntegerType()), T.StructField("blank", T.BooleanType()),
    T.StructField("new_width", T.IntegerType()), T.StructField("new_height", T.IntegerType()), T.StructField("png", T.BinaryType()), T.StructField("error", T.StringType()),
])
IMAGE_ARROW = pa.struct([("width", pa.int32()), ("height", pa.int32()), ("blank", pa.bool_()), ("new_width", pa.int32()), ("new_height", pa.int32()), ("png", pa.binary()), ("error", pa.string())])


def prepared(data: bytes | None, most: int) -> dict | None:
    """An image's figures, and itself in RGB, no side longer than ``most``."""
    if data is None:
        return None
    try:
        pixels = decoded(data)
        h, w, _ = pixels.shape
        if not h or not w:
            raise ValueError("no pixels")
        width, height = new_size(w, h, most)
        small = on_white(resized(pixels, width, height))
        return {"width": w, "height": h, "blank": is_blank(pixels), "new_width": width, "new_height": height, "png": encoded(small)}
    except (ValueError, zlib.error, struct.error) as e:
        return {"error": str(e)}


def prepare(image: Column, most: int) -> Column:
    """struct(width, height, blank, new_width, new_height, png, error) of PNG files."""

    @F.arrow_udf(IMAGE)
    def run(column: pa.Array) -> pa.Array:
        return pa.array([prepared(x, most) for x in column.to_pylist()], IMAGE_ARROW)

    return run(image)
