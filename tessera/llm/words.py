"""Words of Arrow text columns as NumPy arrays: places, hashes and n-gram hashes, without a Python object for each word.

Texts are handled as UTF-8 bytes. A *word* is a maximal run of bytes that are word
bytes of a 256-entry table; white space is always ASCII here, so that runs of bytes
and runs of characters are the same. Hashes only choose buckets, orders and
candidates, or are 64 bits wide and well mixed where a set of n-grams stands for the
n-grams themselves.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

#: Bytes that are no word bytes under the class [^\x20\x09-\x0D].
SPACES = bytes([0x20, *range(0x09, 0x0E)])
LOWER_ASCII = np.arange(256, dtype=np.uint8)
LOWER_ASCII[65:91] += 32
#: Bytes of text for which arrays are held at once (a longer text is held whole).
CHUNK_BYTES = 1 << 20

_BASE = np.uint64(0x9E3779B97F4A7C15)
_BASE_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_NGRAM = np.uint64(0xD6E8FEB86659FD93)
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def word_table(others: bytes = SPACES) -> np.ndarray:
    """Class of each byte: 0 parts words, 1 is in words. Tables with more classes part words where the class changes."""
    found = np.ones(256, np.uint8)
    found[list(others)] = 0
    return found


WORD_BYTES = word_table()


def give_back() -> None:
    """Returns freed memory to the system; a worker that is kept between tasks would go on holding it."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # not every C library has it
    if trim is not None:
        trim(0)


def lean(f: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``f`` over batches, after which the worker gives its memory back."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from f(batches)
        give_back()

    return run


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string or binary column, and the offsets of its rows in them; null rows are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    if not len(column):
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None and data.size else np.empty(0, np.uint8)
    return raw, at - at[0]


def chunks(column: pa.Array, size: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of consecutive rows with about ``size`` bytes."""
    raw, at = text_bytes(column)
    first = 0
    while first < len(at) - 1:
        end = max(first + 1, int(np.searchsorted(at, at[first] + size, "right")) - 1)
        yield first, end, raw[at[first] : at[end]], at[first : end + 1] - at[first]
        first = end


def places(raw: np.ndarray, at: np.ndarray, table: np.ndarray = WORD_BYTES) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of each word, and for each row the index of its first word (with one more at the end)."""
    n = len(raw)
    if not n:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.zeros(len(at), np.int64)
    kind = table[raw]
    inside = kind != 0
    parted = np.empty(n + 1, bool)
    parted[0] = parted[n] = True
    np.not_equal(kind[1:], kind[:-1], out=parted[1:n])
    parted[at] = True
    begins, ends = inside & parted[:n], inside & parted[1:]
    start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    return start, end, np.searchsorted(start, at)


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        size = max(n, CHUNK_BYTES + 1)
        for k, base in enumerate((_BASE, _BASE_INVERSE)):
            full = np.full(size, base, np.uint64)
            full[0] = 1
            _powers[k] = np.multiply.accumulate(full)
    return _powers[0], _powers[1]


def word_hashes(raw: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word's bytes (polynomial by prefix sums, then mixed)."""
    if not len(start):
        return np.empty(0, np.uint64)
    if len(raw) > CHUNK_BYTES:  # hashes don't depend on places, so large inputs go in parts
        out, i = np.empty(len(start), np.uint64), 0
        while i < len(start):
            k = max(i + 1, int(np.searchsorted(end, start[i] + CHUNK_BYTES, "right")))
            a, z = start[i], end[k - 1]
            out[i:k] = _word_hashes(raw[a:z], start[i:k] - a, end[i:k] - a)
            i = k
        return out
    return _word_hashes(raw, start, end)


def _word_hashes(raw: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    up, down = _power(len(raw) + 1)
    sums = np.empty(len(raw) + 1, np.uint64)
    sums[0] = 0
    np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * up[: len(raw)], out=sums[1:])
    return mix((sums[end] - sums[start]) * down[start])


def ngram_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """Hash of each run of ``n`` consecutive word hashes; place i is the run that starts at word i."""
    if len(words) < n:
        return np.empty(0, np.uint64)
    m = len(words) - n + 1
    out = words[:m].copy()
    for k in range(1, n):
        out *= _NGRAM
        out += words[k : k + m]
    return mix(out)


def starts_within(first: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Places where an n-gram stands inside one row, in order, and how many each row has. ``first`` as from places()."""
    counts = np.maximum(np.diff(first) - (n - 1), 0)
    total = int(counts.sum())
    if not total:
        return np.empty(0, np.int64), counts
    begin = np.cumsum(counts) - counts
    return np.repeat(first[:-1] - begin, counts) + np.arange(total), counts
