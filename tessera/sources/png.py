"""PNG files as arrays, with the depth they were stored in: Spark's image reader cuts samples to 8 bits, which breaks masks of 16."""

from __future__ import annotations

import struct
import zlib

import numpy as np

SIGNATURE = b"\x89PNG\r\n\x1a\n"
CHANNELS = {0: 1, 2: 3, 4: 2, 6: 4}  # by colour type; palettes (3) are left to Spark's reader
PLAIN = {b"IHDR", b"IDAT", b"IEND", b"tEXt", b"zTXt", b"iTXt", b"tIME", b"pHYs"}  # chunks that say nothing about colours


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def encoded(pixels: np.ndarray) -> bytes:
    """A PNG file of gray (rows x columns) or RGB pixels of 8 or 16 bits."""
    h, w = pixels.shape[:2]
    depth = 16 if pixels.dtype == np.uint16 else 8
    rows = np.ascontiguousarray(pixels.astype(">u2") if depth == 16 else pixels).view(np.uint8).reshape(h, -1)
    raw = np.concatenate([np.zeros((h, 1), np.uint8), rows], axis=1).tobytes()
    return SIGNATURE + _chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, depth, 2 if pixels.ndim == 3 else 0, 0, 0, 0)) + _chunk(b"IDAT", zlib.compress(raw, 1)) + _chunk(b"IEND", b"")


def _unfiltered(raw: np.ndarray, step: int) -> np.ndarray:
    """Bytes of rows whose first byte names the filter; ``step`` bytes make a pixel."""
    out = np.zeros((raw.shape[0] + 1, raw.shape[1] - 1 + step), np.uint8)  # a row of zeros above, a pixel of zeros on the left
    for y, row in enumerate(raw):
        kind, data, above, here = int(row[0]), row[1:], out[y], out[y + 1]
        if kind == 0:
            here[step:] = data
        elif kind == 1:
            here[step:] = np.cumsum(data.reshape(-1, step), axis=0, dtype=np.uint8).ravel()
        elif kind == 2:
            here[step:] = data + above[step:]
        elif kind in (3, 4):
            up = above.astype(int)
            for x in range(step, out.shape[1], step):  # each pixel needs the one before it
                a, b, c = here[x - step : x].astype(int), up[x : x + step], up[x - step : x]
                if kind == 3:
                    guess = (a + b) // 2
                else:
                    p, q, r = abs(b - c), abs(a - c), abs(a + b - 2 * c)
                    guess = np.where((p <= q) & (p <= r), a, np.where(q <= r, b, c))
                here[x : x + step] = (data[x - step : x] + guess) & 255
        else:
            raise ValueError(f"filter {kind}")
    return out[1:, step:]


def decoded(content: bytes) -> np.ndarray | None:
    """Samples of a file of 8 or 16 bits a sample, rows x columns (x channels, in BGR order), as they are stored; None for palettes, interlaced or damaged files."""
    if content[:8] != SIGNATURE:
        return None
    at, parts, head = 8, [], None
    try:
        while at + 8 <= len(content):
            (size,), kind = struct.unpack_from(">I", content, at), content[at + 4 : at + 8]
            data = content[at + 8 : at + 8 + size]
            if kind == b"IHDR":
                head = struct.unpack(">IIBBBBB", data)
            elif kind == b"IDAT":
                parts.append(data)
            at += 12 + size
        w, h, depth, colour, _, _, interlaced = head
        if depth not in (8, 16) or colour not in CHANNELS or interlaced:
            return None
        step = CHANNELS[colour] * depth // 8
        raw = np.frombuffer(zlib.decompress(b"".join(parts)), np.uint8).reshape(h, 1 + w * step)
        flat = np.ascontiguousarray(_unfiltered(raw, step))
        pixels = (flat.view(">u2").astype(np.uint16) if depth == 16 else flat).reshape(h, w, CHANNELS[colour])
    except (TypeError, ValueError, struct.error, zlib.error):
        return None
    if CHANNELS[colour] in (1, 2):
        return pixels[:, :, 0]
    return np.concatenate([pixels[:, :, 2::-1], pixels[:, :, 3:]], axis=2)


def depth(content: bytes) -> int:
    """Bits a sample, 0 where it is no PNG file."""
    return content[24] if content[:8] == SIGNATURE and len(content) > 24 else 0


def is_plain(content: bytes) -> bool:
    """A whole file of 8 bits a sample with PLAIN chunks alone: what ``decoded`` makes of it is what Spark's reader makes."""
    at, kind = 8, b""
    while depth(content) == 8 and at + 12 <= len(content) and kind != b"IEND":
        size, kind = int.from_bytes(content[at : at + 4], "big"), content[at + 4 : at + 8]
        if kind not in PLAIN or zlib.crc32(content[at + 4 : at + 8 + size]) != int.from_bytes(content[at + 8 + size : at + 12 + size], "big"):
            return False
        at += 12 + size
    return kind == b"IEND"
