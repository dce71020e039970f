"""OpenEXR images by scanlines, uncompressed or with ZIP: their channels as arrays, and depth as benchmarks keep it in them."""

from __future__ import annotations

import struct
import zlib

import numpy as np

MAGIC = 20000630
#: Bits of the version that mark tiles, deep data and several parts.
NOT_PLAIN = 0x200 | 0x800 | 0x1000
KINDS = {0: "<u4", 1: "<f2", 2: "<f4"}
#: Scanlines in a block of each compression that is read: none, ZIP of one line, ZIP of 16.
BLOCK_LINES = {0: 1, 2: 1, 3: 16}


def _text(data: bytes, at: int) -> tuple[str, int]:
    end = data.index(b"\0", at)
    return data[at:end].decode("latin-1"), end + 1


def _header(data: bytes) -> tuple[dict[str, bytes], int]:
    magic, version = struct.unpack_from("<ii", data)
    if magic != MAGIC:
        raise ValueError("not an EXR file")
    if version & NOT_PLAIN:
        raise ValueError("EXR of tiles, deep data or several parts is not supported")
    at, found = 8, {}
    while data[at]:
        name, at = _text(data, at)
        _, at = _text(data, at)
        (size,) = struct.unpack_from("<i", data, at)
        found[name] = data[at + 4 : at + 4 + size]
        at += 4 + size
    return found, at + 1


def _channels(data: bytes) -> list[tuple[str, str]]:
    """(name, kind) of each channel, in the file's order, which is by name."""
    at, out = 0, []
    while data[at]:
        name, at = _text(data, at)
        kind, _, dx, dy = struct.unpack_from("<iiii", data, at)
        if (dx, dy) != (1, 1):
            raise ValueError(f"EXR channel {name} is subsampled, which is not supported")
        out.append((name, KINDS[kind]))
        at += 16
    return out


def _unzipped(block: bytes, size: int) -> bytes:
    """A block's bytes: differences summed up, then the two halves interleaved. One that would not shrink is stored as it is."""
    if len(block) == size:
        return block
    steps = np.frombuffer(zlib.decompress(block), np.uint8).astype(np.int64)
    steps[1:] -= 128
    flat = np.cumsum(steps).astype(np.uint8)
    out = np.empty(len(flat), np.uint8)
    half = (len(flat) + 1) // 2
    out[::2], out[1::2] = flat[:half], flat[half:]
    return out.tobytes()


def read_exr(data: bytes) -> dict[str, np.ndarray]:
    """Each channel's (h, w) values, by name."""
    header, at = _header(data)
    x0, y0, x1, y1 = struct.unpack("<iiii", header["dataWindow"])
    w, h = x1 - x0 + 1, y1 - y0 + 1
    compression = header["compression"][0]
    if compression not in BLOCK_LINES:
        raise ValueError(f"EXR compression {compression} is not supported")
    channels = _channels(header["channels"])
    line = sum(w * np.dtype(kind).itemsize for _, kind in channels)
    out = {name: np.empty((h, w), kind) for name, kind in channels}
    lines = BLOCK_LINES[compression]
    for offset in struct.unpack_from(f"<{-(-h // lines)}Q", data, at):
        y, size = struct.unpack_from("<ii", data, offset)
        rows = min(lines, y1 - y + 1)
        block = data[offset + 8 : offset + 8 + size]
        block = _unzipped(block, rows * line) if compression else block
        if len(block) != rows * line:
            raise ValueError("EXR block of the wrong length")
        place = 0
        for row in range(y - y0, y - y0 + rows):
            for name, kind in channels:
                out[name][row] = np.frombuffer(block, kind, w, place)
                place += w * np.dtype(kind).itemsize
    return out


def read_depth_exr(data: bytes) -> np.ndarray:
    """Depth of an EXR image: blue, which image libraries list first, or its only channel; infinite depth is 0."""
    channels = read_exr(data)
    name = "B" if "B" in channels else next(iter(channels))
    depth = channels[name].astype(np.float32)
    return np.where(np.isinf(depth), np.float32(0), depth)
