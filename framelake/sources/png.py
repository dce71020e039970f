"""PNG images as arrays: 8 and 16 bits a channel, gray, colour, palette and alpha; no interlacing."""

from __future__ import annotations

import struct
import zlib

import numpy as np

SIGNATURE = b"\x89PNG\r\n\x1a\n"
#: Channels of each colour kind: gray, colour, palette, gray with alpha, colour with alpha.
CHANNELS = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}
NONE, SUB, UP, AVERAGE, PAETH = range(5)


def _chunks(data: bytes):
    at = len(SIGNATURE)
    while at + 12 <= len(data):
        (length,) = struct.unpack_from(">I", data, at)
        kind, body = data[at + 4 : at + 8], data[at + 8 : at + 8 + length]
        if len(body) != length or zlib.crc32(kind + body) != struct.unpack_from(">I", data, at + 8 + length)[0]:
            raise ValueError(f"damaged PNG chunk {kind!r}")
        yield kind, body
        at += 12 + length


def _unfiltered(kind: int, line: np.ndarray, above: np.ndarray, step: int) -> np.ndarray:
    """One line's bytes; ``step`` bytes back is the same channel of the pixel before."""
    if kind == NONE:
        return line
    if kind == UP:
        return line + above
    if kind == SUB:
        return np.cumsum(line.reshape(-1, step), axis=0, dtype=np.uint8).ravel()
    out, up = line.tolist(), above.tolist()
    for i in range(len(out)):
        left = out[i - step] if i >= step else 0
        if kind == AVERAGE:
            guess = (left + up[i]) // 2
        elif kind == PAETH:
            corner = up[i - step] if i >= step else 0
            far = (abs(up[i] - corner), abs(left - corner), abs(left + up[i] - 2 * corner))
            guess = (left, up[i], corner)[far.index(min(far))]
        else:
            raise ValueError(f"unknown PNG filter {kind}")
        out[i] = (out[i] + guess) & 255
    return np.array(out, dtype=np.uint8)


def read_png(data: bytes) -> np.ndarray:
    """h x w or h x w x channels, uint8 or uint16 as stored; palettes become colours."""
    if data[: len(SIGNATURE)] != SIGNATURE:
        raise ValueError("not a PNG file")
    header, palette, body = None, None, b""
    for kind, chunk in _chunks(data):
        if kind == b"IHDR":
            header = struct.unpack(">IIBBBBB", chunk)
        elif kind == b"PLTE":
            palette = np.frombuffer(chunk, np.uint8).reshape(-1, 3)
        elif kind == b"IDAT":
            body += chunk
    if header is None:
        raise ValueError("PNG without a header")
    w, h, bits, colour, _, _, interlaced = header
    if interlaced or bits not in (8, 16) or colour not in CHANNELS:
        raise ValueError(f"PNG of {bits} bits, colour kind {colour}, interlacing {interlaced} is not supported")
    channels, size = CHANNELS[colour], bits // 8
    lines = np.frombuffer(zlib.decompress(body), np.uint8)
    width = w * channels * size
    if len(lines) != h * (width + 1):
        raise ValueError("PNG data of the wrong length")
    lines = lines.reshape(h, width + 1)
    out, above = np.empty((h, width), np.uint8), np.zeros(width, np.uint8)
    for y in range(h):
        above = out[y] = _unfiltered(int(lines[y, 0]), lines[y, 1:], above, channels * size)
    values = out.view(">u2").astype(np.uint16) if size == 2 else out
    if palette is not None and colour == 3:
        return palette[values]
    return values.reshape(h, w) if channels == 1 else values.reshape(h, w, channels)


def write_png(image: np.ndarray) -> bytes:
    """PNG bytes of an h x w or h x w x channels array of uint8 or uint16, each line as it is or as its difference from the left or from above, whichever is smallest."""
    if image.dtype not in (np.uint8, np.uint16) or image.ndim not in (2, 3) or 0 in image.shape:
        raise ValueError(f"no PNG of {image.dtype} {image.shape}")
    h, w = image.shape[:2]
    channels = image.size // (h * w)
    colour = {1: 0, 2: 4, 3: 2, 4: 6}[channels]
    size = image.dtype.itemsize
    lines = np.ascontiguousarray(image, dtype=f">u{size}").reshape(h, -1).view(np.uint8)
    step = channels * size
    left, above = np.zeros_like(lines), np.zeros_like(lines)
    left[:, step:], above[1:] = lines[:, :-step], lines[:-1]
    ways = np.stack([lines, lines - left, lines - above])
    best = np.abs(ways.view(np.int8).astype(np.int64)).sum(axis=2).argmin(axis=0)
    body = np.empty((h, lines.shape[1] + 1), np.uint8)
    body[:, 0], body[:, 1:] = best, ways[best, np.arange(h)]
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    header = struct.pack(">IIBBBBB", w, h, 8 * size, colour, 0, 0, 0)
    return SIGNATURE + chunk(b"IHDR", header) + chunk(b"IDAT", zlib.compress(body.tobytes(), 6)) + chunk(b"IEND", b"")
