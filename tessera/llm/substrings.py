"""Substring dedup: windows of words that occur earlier in the corpus are found by super-k-mer partitioning.

A window is ``width`` consecutive words of one document. Its minimiser is the smallest
hash of the ``MINIMISER_WORDS``-word n-grams inside it. Consecutive windows with the same
minimiser travel as one packed string (a super-k-mer) to the minimiser's bucket, so all
equal windows meet there; a bucket sorts its windows and compares the words of equal
ones, so hash values decide nothing.

Order of occurrences: smaller doc_id first (null ids last), then smaller hash of the text
(only where ids repeat), then earlier start. Rows that agree in doc_id and text are one
document: they don't repeat each other and get the same result.

Skew. Equal super-k-mers that meet in a task are settled there, and only the first is
sent, so a passage that a third of all rows share costs one string for each task. Windows
on the edges of such a passage differ from row to row but share minimisers; minimisers
that make up a large share of a sample are *hot*, and their windows travel one by one to
buckets chosen by the whole window. The choice of hot minimisers moves work only; it
can't change a result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm import words as W
from tessera.llm.common import bounded_batches, buckets

WIDTH = 20
MINIMISER_WORDS = 3
#: Packed bytes of text that a task collects before it sends them.
FLUSH_BYTES = 16 << 20
#: Input bytes for each bucket, by the plan's estimate.
BUCKET_BYTES = 3 << 18
#: One document in so many is looked at for hot minimisers; a minimiser is hot from this share of their super-k-mers.
SAMPLE = 16
HOT_SHARE = 1 / 4_000
HOT_LEAST = 48

_KEY = [("doc_id", np.int64), ("gone", np.uint8), ("h", np.int64), ("start", np.int32)]
_SPAN = [*_KEY, ("end", np.int32)]
SPANS = "doc_id long, h long, a int, b int"


def sliding_min(v: np.ndarray, n: int) -> np.ndarray:
    """Smallest of each run of n values, by doubling."""
    size = 1
    while size * 2 <= n:
        v = np.minimum(v[:-size], v[size:])
        size *= 2
    return np.minimum(v[: len(v) - (n - size)], v[n - size :]) if n > size else v


def single_spaced(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The texts with each run of white space after a word as one space."""
    inside = W.WORD_BYTES[raw].astype(bool)
    keep = inside.copy()
    keep[1:] |= inside[:-1]
    raw = np.where(inside, raw, np.uint8(0x20))
    return (raw, at) if keep.all() else (raw[keep], np.concatenate([[0], np.cumsum(keep)])[at])


def super_kmers(raw: np.ndarray, at: np.ndarray, width: int, hot: np.ndarray):
    """Places of the words, and of each super-k-mer the row, first word, end word, and the hash that chooses its bucket."""
    start, end, first = W.places(raw, at)
    where, counts = W.starts_within(first, width)
    if not len(where):
        none = np.empty(0, np.int64)
        return start, end, first, none, none, none, np.empty(0, np.uint64)
    n = min(MINIMISER_WORDS, width)
    hashed = W.word_hashes(raw, start, end)
    least = sliding_min(W.ngram_hashes(hashed, n), width - n + 1)[where]
    parted = np.ones(len(where), bool)
    parted[1:] = (least[1:] != least[:-1]) | (where[1:] != where[:-1] + 1)
    if len(hot):
        burning = hot[np.minimum(np.searchsorted(hot, least), len(hot) - 1)] == least
        if burning.any():
            parted |= burning
            parted[1:] |= burning[:-1]
            least = np.where(burning, W.ngram_hashes(hashed, width)[where], least)
    run = np.flatnonzero(parted)
    last = np.append(run[1:], len(where)) - 1
    rows = np.repeat(np.arange(len(counts)), counts)[run]
    return start, end, first, rows, where[run], where[last] + width, W.mix(least[run])


def hot_minimisers(docs: DataFrame, width: int) -> np.ndarray:
    """Minimisers of a large share of the super-k-mers of one document in SAMPLE; at most 1 / HOT_SHARE of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, seen = 0, {}
        for b in batches:
            for _, _, raw, at in W.chunks(b.column(0)):
                hashed, counts = np.unique(super_kmers(raw, at, width, np.empty(0, np.uint64))[-1], return_counts=True)
                total += int(counts.sum())
                for h, n in zip(hashed[counts > 1].view(np.int64).tolist(), counts[counts > 1].tolist(), strict=True):
                    seen[h] = seen.get(h, 0) + n
        seen[0] = seen.get(0, 0) + total  # 0 stands for all
        yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.int64()), pa.array(list(seen.values()), pa.int64())], ["h", "n"])

    counted = docs.where(F.pmod(F.xxhash64("text"), F.lit(SAMPLE)) == 0).select("text").mapInArrow(W.lean(run), "h long, n long").groupBy("h").agg(F.sum("n").alias("n"))
    most = counted.orderBy(F.desc("n"), "h").limit(int(1 / HOT_SHARE) + 1).collect()
    total = max((r["n"] for r in most if r["h"] == 0), default=0)
    return np.array([r["h"] for r in most if r["h"] and r["n"] >= max(HOT_LEAST, HOT_SHARE * total)], np.int64).view(np.uint64)


def _unmix(x: np.ndarray) -> np.ndarray:
    """Inverse of words.mix."""
    x = (x ^ (x >> np.uint64(31)) ^ (x >> np.uint64(62))) * np.uint64(pow(0x94D049BB133111EB, -1, 1 << 64))
    x = (x ^ (x >> np.uint64(27)) ^ (x >> np.uint64(54))) * np.uint64(pow(0xBF58476D1CE4E5B9, -1, 1 << 64))
    return x ^ (x >> np.uint64(30)) ^ (x >> np.uint64(60))


class _Sender:
    """Collects super-k-mers, keeps the first of equal ones and the spans of the others, and packs them by bucket."""

    def __init__(self, n_buckets: int):
        self.n_buckets = n_buckets
        self._clear()

    def _clear(self) -> None:
        self.first: dict[bytes, tuple] = {}
        self.place: dict[bytes, int] = {}
        self.spans: list[tuple] = []
        self.size = 0

    def add(self, ids: list, hs: list, raw: np.ndarray, at: np.ndarray, width: int, hot: np.ndarray) -> None:
        raw, at = single_spaced(raw, at)
        start, end, first, rows, a, z, hashed = super_kmers(raw, at, width, hot)
        data, first_seen, place, spans = raw.tobytes(), self.first, self.place, self.spans
        spots = (hashed % np.uint64(self.n_buckets)).tolist()
        offset = (a - first[rows]).tolist()
        for row, lo, hi, word, n, spot in zip(rows.tolist(), start[a].tolist(), end[z - 1].tolist(), offset, (z - a).tolist(), spots, strict=True):
            key, doc_id = data[lo:hi], ids[row]
            mine = (doc_id is None, doc_id or 0, hs[row], word, n)
            other = first_seen.setdefault(key, mine)
            if other is mine:
                place[key] = spot
                self.size += len(key)
            elif other != mine:
                if mine < other:
                    first_seen[key] = mine
                    mine = other
                spans.append(mine)

    def send(self) -> Iterator[pa.RecordBatch]:
        by_bucket: dict[int, list[bytes]] = {}
        for key, spot in self.place.items():
            by_bucket.setdefault(spot, []).append(key)
        spots, blobs = [], []
        for spot, keys in by_bucket.items():
            meta = np.array([(m[1], m[0], m[2], m[3]) for m in map(self.first.__getitem__, keys)], _KEY)
            columns = b"".join(np.ascontiguousarray(meta[n]).tobytes() for n, _ in _KEY)
            spots.append(spot)
            blobs.append(_packed(len(keys).to_bytes(4, "little") + columns + b"\n".join(keys)))
        if self.spans:
            meta = merged(np.array([(m[1], m[0], m[2], m[3], m[3] + m[4]) for m in self.spans], _SPAN))
            spots.append(int(meta["h"][0] + meta["doc_id"][0]) % self.n_buckets)
            blobs.append(_packed(b"\xff\xff\xff\xff" + meta.tobytes()))
        self._clear()
        for k in range(0, len(spots), 256):
            yield pa.RecordBatch.from_arrays([pa.array(spots[k : k + 256], pa.int32()), pa.array(blobs[k : k + 256], pa.binary())], ["bucket", "blob"])


def merged(spans: np.ndarray) -> np.ndarray:
    """Spans of each document united where they meet, in the order of documents and starts."""
    spans = spans[np.lexsort((spans["start"], spans["h"], spans["doc_id"], spans["gone"]))]
    same = np.ones(len(spans), bool)
    for name in ("doc_id", "gone", "h"):
        same[1:] &= spans[name][1:] == spans[name][:-1]
    document = np.cumsum(~same) << 33  # apart by more than any text has words
    reach = np.maximum.accumulate(spans["end"] + document)
    first = np.ones(len(spans), bool)
    first[1:] = spans["start"][1:] + document[1:] > reach[:-1]
    at = np.flatnonzero(first)
    out = spans[at].copy()
    out["end"] = (reach - document)[np.append(at[1:], len(spans)) - 1] if len(spans) else out["end"]
    return out


def _packed(raw: bytes) -> bytes:
    return len(raw).to_bytes(8, "little") + pa.Codec("zstd", compression_level=6).compress(raw, asbytes=True)


def _unpacked(blob: bytes) -> bytes:
    return pa.Codec("zstd").decompress(blob[8:], int.from_bytes(blob[:8], "little"), asbytes=True)


def repeats_in_bucket(blobs: list[bytes], width: int) -> list[np.ndarray]:
    """(doc_id, gone, h, a, b) of the word spans of windows that aren't the first of their kind."""
    metas, texts, out = [], [], []
    for blob in blobs:
        raw = _unpacked(blob)
        if raw[:4] == b"\xff\xff\xff\xff":
            meta = np.frombuffer(raw[4:], _SPAN)
            out.append(meta)
            continue
        n, at, meta = int.from_bytes(raw[:4], "little"), 4, None
        meta = np.empty(n, _KEY)
        for name, kind in _KEY:
            meta[name] = np.frombuffer(raw, kind, n, at)
            at += n * np.dtype(kind).itemsize
        metas.append(meta)
        texts += raw[at:].split(b"\n")
    if not metas:
        return out
    meta = np.concatenate(metas)
    order = np.lexsort((meta["start"], meta["h"], meta["doc_id"], meta["gone"]))
    meta, texts = meta[order], [texts[i] for i in order.tolist()]
    data = b"\n".join(texts)
    at = np.concatenate([[0], np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)) + 1)])
    at[-1] -= 1
    raw = np.frombuffer(data, np.uint8)
    start, end, first = W.places(raw, at)
    where, counts = W.starts_within(first, width)
    hashed = W.ngram_hashes(W.word_hashes(raw, start, end), width)[where]
    owner = np.repeat(np.arange(len(counts)), counts)
    word = meta["start"][owner] + (where - first[owner])
    # Windows stand in the order of their occurrences, so a stable sort puts the first of its kind first.
    by_hash = np.argsort(hashed, kind="stable")
    new = np.ones(len(by_hash), bool)
    new[1:] = hashed[by_hash[1:]] != hashed[by_hash[:-1]]
    if new.all():
        return out
    rep = np.empty(len(by_hash), np.int64)
    rep[by_hash] = by_hash[new][np.cumsum(new) - 1]
    later = np.flatnonzero(rep != np.arange(len(rep)))
    r = rep[later]
    # Where windows that follow each other repeat windows that follow each other, one comparison of bytes does.
    follows = np.zeros(len(later), bool)
    follows[1:] = (later[1:] == later[:-1] + 1) & (owner[later[1:]] == owner[later[:-1]]) & (r[1:] == r[:-1] + 1) & (owner[r[1:]] == owner[r[:-1]])
    begin = np.flatnonzero(~follows)
    stop = np.append(begin[1:], len(later)) - 1
    lo, hi = start[where[later[begin]]].tolist(), end[where[later[stop]] + width - 1].tolist()
    lo2, hi2 = start[where[r[begin]]].tolist(), end[where[r[stop]] + width - 1].tolist()
    same = [data[a:b] == data[c:d] for a, b, c, d in zip(lo, hi, lo2, hi2, strict=True)]
    if not all(same):
        rep = _first_by_words(data, start, end, where, width)
        later = np.flatnonzero(rep != np.arange(len(rep)))
        r = rep[later]
        begin = stop = np.arange(len(later))
    # The same occurrence again (rows that agree in doc_id and text) is no repeat.
    x, y = later[begin], r[begin]
    mine, other = meta[owner[x]], meta[owner[y]]
    own = (word[x] == word[y]) & (mine["doc_id"] == other["doc_id"]) & (mine["gone"] == other["gone"]) & (mine["h"] == other["h"])
    found = np.empty(int((~own).sum()), _SPAN)
    for name in ("doc_id", "gone", "h"):
        found[name] = mine[name][~own]
    found["start"], found["end"] = word[x][~own], word[later[stop]][~own] + width
    return [*out, found]


def _first_by_words(data: bytes, start: np.ndarray, end: np.ndarray, where: np.ndarray, width: int) -> np.ndarray:
    """First window with the same words, for the case that two unequal windows have equal hashes."""
    first: dict[bytes, int] = {}
    return np.array([first.setdefault(data[start[w] : end[w + width - 1]], i) for i, w in enumerate(where.tolist())])


def keyed(docs: DataFrame) -> DataFrame:
    """``docs`` with column __t_h: the text's hash if any doc_id repeats, else 0."""
    again = not docs.groupBy("doc_id").count().where("count > 1").isEmpty()
    return docs.withColumn("__t_h", F.xxhash64("text") if again else F.lit(0).cast("long"))


def repeated_spans(keyed_docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """Word spans [a, b) of the windows that occur earlier, as (doc_id, h, a, b); spans of a document may overlap."""
    docs = keyed_docs.select("doc_id", "__t_h", "text")
    n_buckets, hot = buckets(docs, BUCKET_BYTES), np.sort(_unmix(hot_minimisers(docs, width)))

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sender = _Sender(n_buckets)
        for b in batches:
            ids, hs = b.column(0).to_pylist(), b.column(1).to_pylist()
            for first, end, raw, at in W.chunks(b.column(2)):
                sender.add(ids[first:end], hs[first:end], raw, at, width, hot)
                if sender.size >= FLUSH_BYTES:
                    yield from sender.send()
        yield from sender.send()

    def settle(group: pa.Table) -> pa.Table:
        found = repeats_in_bucket(group["blob"].to_pylist(), width)
        meta = merged(np.concatenate(found)) if found else np.empty(0, _SPAN)
        W.give_back()
        return pa.table({"doc_id": pa.array(meta["doc_id"], pa.int64(), mask=meta["gone"] > 0), "h": pa.array(meta["h"]), "a": pa.array(meta["start"]), "b": pa.array(meta["end"])})

    return docs.mapInArrow(W.lean(send), "bucket int, blob binary").groupBy("bucket").applyInArrow(settle, SPANS)


def remove_repeats(docs: DataFrame, width: int = WIDTH, rejoin: bool = False, n_words: str | None = "n_words", n_removed: str | None = "n_removed") -> DataFrame:
    """``docs`` without the words that a window with an earlier occurrence covers.

    Windows are judged on the input, not on what is left. All rows and columns of ``docs``
    stay (names beginning with ``__t_`` are reserved); ``text`` becomes the kept words joined
    by single spaces where words go, or for all rows if ``rejoin``. A null text has no
    words and stays null (empty if ``rejoin``). ``n_words`` and ``n_removed`` name columns for the
    numbers of words, which replace columns of ``docs`` with these names; None leaves them out.
    """
    bounded_batches(docs.sparkSession)
    rows = keyed(docs)
    at = docs.columns.index("text")
    schema_packed = T.StructType([*(T.StructField(f.name, T.BinaryType()) if i == at else f for i, f in enumerate(docs.schema.fields)), T.StructField("__t_h", T.LongType())])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            packed = pa.array([None if x is None else _packed(x.encode()) for x in b.column(at).to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([packed if i == at else c for i, c in enumerate(b.columns)], names=schema_packed.names)

    spans = repeated_spans(rows, width).groupBy("doc_id", "h").agg(F.collect_list(F.struct("a", "b")).alias("__t_spans"))
    spans = spans.withColumnsRenamed({"doc_id": "__t_id", "h": "__t_h2"})
    packed = rows.mapInArrow(W.lean(pack), schema_packed)  # texts are shuffled once; packed ones take two thirds of the disk
    joined = packed.join(spans, packed["doc_id"].eqNullSafe(spans["__t_id"]) & (packed["__t_h"] == spans["__t_h2"]), "left").drop("__t_id", "__t_h2", "__t_h")
    counts = [(n, k) for k, n in enumerate((n_words, n_removed)) if n]
    kept = [f for f in docs.schema.fields if f.name not in dict(counts)]
    schema = T.StructType([*kept, *(T.StructField(n, T.LongType()) for n, _ in counts)])
    joined = joined.select(*(F.col(f"`{f.name}`") for f in kept), "__t_spans")
    at_kept = [f.name for f in kept].index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, numbers = _without_spans(b.column(at_kept), b.column(len(kept)), rejoin)
            columns = [pa.array(texts, pa.string()) if i == at_kept else b.column(i) for i in range(len(kept))]
            yield pa.RecordBatch.from_arrays([*columns, *(pa.array([x[k] for x in numbers], pa.int64()) for _, k in counts)], names=schema.names)

    return joined.mapInArrow(W.lean(run), schema)


def _without_spans(texts: pa.Array, spans: pa.Array, rejoin: bool) -> tuple[list[str | None], list[tuple[int, int]]]:
    out: list[str | None] = []
    numbers: list[tuple[int, int]] = []
    for blob, mine in zip(texts.to_pylist(), spans, strict=True):
        text = None if blob is None else _unpacked(blob)
        parts = text.split() if text else []
        removed = 0
        if mine.is_valid and len(mine.values):
            covered = np.zeros(len(parts) + 1, np.int64)
            pairs = mine.values
            np.add.at(covered, pairs.field(0).to_numpy(), 1)
            np.add.at(covered, pairs.field(1).to_numpy(), -1)
            keep = np.cumsum(covered)[:-1] == 0
            removed = int((~keep).sum())
        if removed:
            out.append(b" ".join([parts[i] for i in np.flatnonzero(keep)]).decode())
        else:
            out.append(b" ".join(parts).decode() if rejoin else None if text is None else text.decode())
        numbers.append((len(parts), removed))
    return out, numbers
