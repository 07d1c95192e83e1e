"""Exact top-k search by a bit-sliced index.

Rows are dealt into blocks by a hash of their id. A block keeps, for each component,
one bitmap over its rows for each bit of the component's offset from its minimum. A
query's scores over a block are a sum of these bitmaps: each bit of a query component
adds the component's slices at its weight, components with a negative factor add the
complements, and carry-save adders (bitwise operations on whole bitmaps) reduce the
bitmaps of each weight to one, which gives the slices of the scores. Selection goes from
the most significant slice down: rows that have the bit win over those that haven't, until
the rows that are left are equal in all slices; of these boundary rows the smallest ids
are taken. Scores are integers, so all of this is exact.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import written

BLOCK_ROWS = 32_768
#: Queries that meet a block in one task.
QUERIES_AT_ONCE = 1_024

_INDEX = "block int, n int, ids binary, bits binary, least binary, slices binary, query_ids binary, queries binary, dims int"


def _matrix(column: pa.Array) -> np.ndarray:
    """Rows of a list column, filled up with zeros to the longest."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    sizes = np.diff(column.offsets.to_numpy())
    out = np.zeros((len(column), int(sizes.max(initial=0))), np.float64)
    out[np.arange(out.shape[1]) < sizes[:, None]] = flat
    return out


def build_block(ids: np.ndarray, values: np.ndarray, is_query: np.ndarray) -> dict:
    """Index of a block: ids in ascending order, and the slices of each component's offset from its minimum."""
    order = np.lexsort((*values.T[::-1], ids))
    ids, values, is_query = ids[order], values[order], is_query[order]
    least = values.min(0)
    offset = values - least
    bits = np.array([int(x).bit_length() for x in offset.max(0)], np.uint8)
    n, words = len(ids), -(-len(ids) // 64)
    slices = np.zeros((int(bits.sum()), words * 8), np.uint8)
    at = 0
    for d, width in enumerate(bits.tolist()):
        for s in range(width):
            packed = np.packbits((offset[:, d] >> s & 1).astype(bool), bitorder="little")
            slices[at, : len(packed)] = packed
            at += 1
    return {"n": n, "ids": ids.astype("<i8").tobytes(), "bits": bits.tobytes(), "least": least.astype("<i8").tobytes(), "slices": slices.tobytes(), "query_ids": ids[is_query].astype("<i8").tobytes(), "queries": values[is_query].astype("<i8").tobytes(), "dims": values.shape[1]}


def add_up(weighted: list[list[np.ndarray]]) -> list[np.ndarray]:
    """Slices of the sum of bitmaps, where ``weighted[t]`` lists those of weight 2**t."""
    out, t = [], 0
    while t < len(weighted):
        column = weighted[t]
        if t + 1 == len(weighted) and len(column) > 1:
            weighted.append([])
        while len(column) > 2:
            a, b, c = column.pop(), column.pop(), column.pop()
            x = a ^ b
            column.insert(0, x ^ c)
            weighted[t + 1].append((a & b) | (x & c))
        if len(column) == 2:
            a, b = column
            column = [a ^ b]
            weighted[t + 1].append(a & b)
        out.append(column[0] if column else None)
        t += 1
    zero = next((np.zeros_like(x) for x in out if x is not None), None)
    return [zero if x is None else x for x in out]


class Block:
    def __init__(self, row: dict):
        self.n, self.ids = row["n"], np.frombuffer(row["ids"], "<i8")
        self.bits, self.least = np.frombuffer(row["bits"], np.uint8), np.frombuffer(row["least"], "<i8")
        self.words = -(-self.n // 64)
        self.slices = np.frombuffer(row["slices"], np.uint64).reshape(-1, self.words)
        self.begin = np.concatenate([[0], np.cumsum(self.bits, dtype=np.int64)])
        self.all = np.full(self.words, 2**64 - 1, np.uint64)
        if self.n % 64:
            self.all[-1] = np.uint64((1 << self.n % 64) - 1)
        self.complements = self.slices ^ self.all

    def top(self, query_id: int, query: np.ndarray, k: int) -> list[tuple[int, int]]:
        """(id, score) of the k best rows but those of the query's id, by score, then id."""
        constant, weighted = 0, [[]]
        for d, q in enumerate(query.tolist()):
            if q == 0 or d >= len(self.bits):
                continue
            constant += q * int(self.least[d])
            width, at = int(self.bits[d]), int(self.begin[d])
            table = self.slices
            if q < 0:
                constant += q * ((1 << width) - 1)
                q, table = -q, self.complements
            for j in range(q.bit_length()):
                if q >> j & 1:
                    while len(weighted) < j + width:
                        weighted.append([])
                    for s in range(width):
                        weighted[j + s].append(table[at + s])
        slices = [x for x in add_up(weighted) if x is not None]
        left, sure = self.all.copy(), np.zeros(self.words, np.uint64)
        own = np.arange(np.searchsorted(self.ids, query_id), np.searchsorted(self.ids, query_id, "right"))  # rows of the query's id
        np.bitwise_and.at(left, own // 64, ~(np.uint64(1) << (own % 64).astype(np.uint64)))
        need = k
        for s in reversed(slices):
            have = left & s
            count = int(np.bitwise_count(have).sum())
            if count >= need:
                left = have
            else:
                sure |= have
                left &= ~s
                need -= count
        rows = _rows(sure)
        if need > 0:  # the boundary: equal scores, smaller ids first
            rows = np.concatenate([rows, _rows(left)[:need]])
        score = np.zeros(len(rows), object)
        for t, s in enumerate(slices):
            score += ((s[rows // 64] >> (rows % 64).astype(np.uint64)) & np.uint64(1)).astype(object) * (1 << t)
        found = [(int(self.ids[r]), int(v) + constant) for r, v in zip(rows, score, strict=True)]
        return sorted(found, key=lambda x: (-x[1], x[0]))


def _rows(bitmap: np.ndarray) -> np.ndarray:
    spots = np.flatnonzero(bitmap)
    bits = np.unpackbits(bitmap[spots].view(np.uint8), bitorder="little").reshape(-1, 64)
    which, bit = np.nonzero(bits)
    return spots[which] * 64 + bit


def index(vectors: DataFrame, is_query: Column, id_column: str = "vec_id", vector: str = "embedding", scale: int = 64, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """The bit-sliced index of floor(scale * x) as a table in the shared folder, one row a block.

    Rows whose id or vector is null, or whose vector holds a null or non-finite component,
    take no part. Rows that share an id are rows of their own; none of them is an answer to
    another, and as queries they share one list of answers. A shorter
    vector counts as filled up with zeros. ``is_query`` marks the rows to search for.
    """
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double")) == float("inf")))
    rows = vectors.where(F.col(id_column).isNotNull() & F.col(vector).isNotNull()).where(~bad).select(F.col(id_column).cast("long").alias("id"), F.col(vector).alias("vector"), F.coalesce(is_query, F.lit(False)).alias("is_query"))
    blocks = max(1, math.ceil(rows.count() / block_rows))

    def build(group: pa.Table) -> pa.Table:
        values = np.floor(scale * _matrix(group["vector"].combine_chunks())).astype(np.int64)
        found = build_block(group["id"].to_numpy(), values, group["is_query"].to_numpy(zero_copy_only=False))
        return pa.Table.from_pylist([{"block": group["block"][0].as_py()} | found], schema=_SCHEMA)

    dealt = rows.withColumn("block", F.pmod(F.xxhash64("id", "vector"), F.lit(blocks)).cast("int"))
    return written(dealt.groupBy("block").applyInArrow(build, _INDEX), "bit-slices")


_SCHEMA = pa.schema([("block", pa.int32()), ("n", pa.int32()), ("ids", pa.binary()), ("bits", pa.binary()), ("least", pa.binary()), ("slices", pa.binary()), ("query_ids", pa.binary()), ("queries", pa.binary()), ("dims", pa.int32())])


def search(blocks: DataFrame, k: int = 20, queries_at_once: int = QUERIES_AT_ONCE) -> DataFrame:
    """query_id, rank, vec_id and score of each query's k best rows: every query meets every block.

    Queries are dealt into groups, and a copy of each block goes to each group, so tasks are
    bounded by a block and a group. A block returns k rows for a query; the best of them are
    ranked by a window that limits rows before the shuffle.
    """
    known = blocks.agg(F.max("block").alias("last"), (F.sum(F.octet_length("query_ids")) / 8).alias("queries")).first()
    last, n_queries = known["last"] or 0, known["queries"] or 0
    groups = max(1, math.ceil(n_queries / queries_at_once))
    tasks = 2 * (last + 1) * groups

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in b.to_pylist():
                ids = np.frombuffer(row["query_ids"], "<i8")
                size = row["dims"] * 8
                yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array([row["queries"][i * size : (i + 1) * size] for i in range(len(ids))], pa.binary())], ["query_id", "query"])

    queries = blocks.select("query_ids", "queries", "dims").mapInArrow(unpack, "query_id long, query binary")
    each = F.explode(F.sequence(F.lit(0), F.lit(last)))
    left = queries.withColumn("part", F.pmod(F.xxhash64("query_id"), F.lit(groups)).cast("int")).withColumn("place", each)
    right = blocks.drop("query_ids", "queries").withColumnRenamed("block", "place").withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))

    def run(asked: pa.Table, held: pa.Table) -> pa.Table:
        out: list[tuple] = []
        for row in held.to_pylist():
            block = Block(row)
            for q, raw in zip(asked["query_id"].to_pylist(), asked["query"].to_pylist(), strict=True):
                out += [(q, i, s) for i, s in block.top(q, np.frombuffer(raw, "<i8"), k)]
        return pa.table([pa.array([x[c] for x in out], pa.int64()) for c in range(3)], ["query_id", "vec_id", "score"])

    best = left.repartition(tasks, "place", "part").groupBy("place", "part").cogroup(right.repartition(tasks, "place", "part").groupBy("place", "part")).applyInArrow(run, "query_id long, vec_id long, score long")
    ranked = best.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")))
    return ranked.where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
