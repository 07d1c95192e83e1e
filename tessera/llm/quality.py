"""Quality classifier: hashed word n-gram logistic regression, trained by follow-the-regularised-leader updates
(FTRL-proximal) and scored as sparse dot products.

Words are runs of letters, digits and non-ASCII characters, and runs of ASCII
punctuation between them count as words too. Features are the hashes of all one-
to ``order``-word n-grams of the whole text, in lower case (A-Z), in a table of 2**bits
weights; longer n-grams that end with the word they began with share one feature. A feature's value is its share of the text's n-grams of that length.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm import words as W
from tessera.llm.common import bounded_batches

#: The model learns from this many labelled documents at most, those with the smallest hash of their id.
TRAINING_DOCUMENTS = 8_192
#: Texts of more bytes aren't learned from, which bounds what the driver gets (at most 2 features of 8 bytes a word). All texts are scored whole.
TRAINING_BYTES = 16_384
#: Three classes of bytes: space, punctuation and the rest.
CLASSES = W.word_table(bytes(range(33)) + b"\x7f")
CLASSES[[c for c in range(33, 127) if not chr(c).isalnum()]] = 2

#: Stands for every n-gram that ends with its first word.
AGAIN = np.uint64(0x5851F42D4C957F2D)

RESULT = "doc_id long, score double"


@dataclass(frozen=True)
class Settings:
    bits: int = 18
    order: int = 2
    alpha: float = 1.0
    beta: float = 1.0
    l1: float = 0.02
    l2: float = 0.02
    epochs: int = 3
    scale: float = 32.0


def places_of_features(raw: np.ndarray, at: np.ndarray, s: Settings) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each order the table places of its n-grams, and how many of them each row has."""
    raw = W.LOWER_ASCII[raw]
    start, end, first = W.places(raw, at, CLASSES)
    hashed = W.word_hashes(raw, start, end)
    for n in range(1, s.order + 1):
        grams = W.ngram_hashes(hashed, n)
        if n > 1 and len(grams):  # a word said again and again is one feature, whichever word it is
            grams = np.where(hashed[: len(grams)] == hashed[n - 1 :], AGAIN, grams)
        where, counts = W.starts_within(first, n)
        yield ((grams[where] + np.uint64(n)) >> np.uint64(64 - s.bits)).astype(np.int32), counts


def sums(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Sum of each row's values, which stand one row after the other."""
    total = np.concatenate([[0.0], np.cumsum(values)])
    end = np.cumsum(counts)
    return total[end] - total[end - counts]


def _features(batch: pa.RecordBatch, s: Settings) -> list[tuple[np.ndarray, np.ndarray]]:
    """Distinct places and values of each row."""
    rows: list[tuple[np.ndarray, np.ndarray]] = []
    for first, end, raw, at in W.chunks(batch.column("text")):
        parts = []
        for where, counts in places_of_features(raw, at, s):
            stop = np.cumsum(counts)
            parts.append([where[z - n : z] for z, n in zip(stop, counts, strict=True)])
        for row in range(end - first):
            mine = [p[row] for p in parts]
            value = [np.full(len(m), s.scale / max(len(m), 1)) for m in mine]
            spots, back = np.unique(np.concatenate(mine), return_inverse=True)
            rows.append((spots, np.bincount(back, np.concatenate(value), len(spots)).astype(np.float32)))
    return rows


def labelled(docs: DataFrame, labels: DataFrame, label: str, learns: Column, limit: int, most_bytes: int) -> DataFrame:
    """doc_id, text and label of the documents to learn from: a bounded choice by hashed id, at most ``limit`` rows.

    ``learns`` is a condition on doc_id. Null ids and labels take no part, nor do ids with
    both labels; repeated label rows count once, and of documents that share an id the smallest
    text. Texts of more than ``most_bytes`` aren't learned from. Only ids within the bound are broadcast.
    """
    chosen = (
        labels.select("doc_id", F.col(label).alias("label")).where(F.col("doc_id").isNotNull() & F.col("label").isNotNull() & learns)
        .groupBy("doc_id").agg(F.min("label").alias("label"), F.max("label").alias("other")).where("label = other")
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit).select("doc_id", "label")
    )
    bounded_batches(docs.sparkSession)
    rows = [tuple(r) for r in chosen.collect()]  # at most ``limit`` pairs of numbers
    small = docs.sparkSession.createDataFrame(rows, "doc_id long, label int")
    read = docs.select("doc_id", "text").where(F.octet_length("text") <= most_bytes).join(F.broadcast(small), "doc_id")
    return read.groupBy("doc_id", "label").agg(F.min("text").alias("text"))


def fit(docs: DataFrame, labels: DataFrame, label: str, learns: Column, s: Settings = Settings(), limit: int = TRAINING_DOCUMENTS) -> tuple[np.ndarray, float]:
    """Weights and bias. Without labelled documents all weights are 0, so that every score is 0.5.

    Features are made where the documents are read; the driver gets those of at most
    ``limit`` documents and makes the updates in an order fixed by the ids' hashes.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = _features(b, s)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("label"), pa.array([x.astype("<i4").tobytes() for x, _ in found], pa.binary()), pa.array([v.astype("<f4").tobytes() for _, v in found], pa.binary())], ["doc_id", "label", "spots", "value"])

    rows = labelled(docs, labels, label, learns, limit, TRAINING_BYTES).mapInArrow(W.lean(run), "doc_id long, label int, spots binary, value binary").toArrow().to_pylist()
    rows.sort(key=lambda r: (int(W.mix(np.array([r["doc_id"]], np.int64).view(np.uint64))[0]), r["spots"]))
    found = follow_the_leader([(np.frombuffer(r["spots"], "<i4"), np.frombuffer(r["value"], "<f4"), r["label"]) for r in rows], s)
    del rows
    W.give_back()
    return found


def follow_the_leader(rows: list[tuple[np.ndarray, np.ndarray, int]], s: Settings) -> tuple[np.ndarray, float]:
    """FTRL-proximal with per-coordinate rates; the bias is a coordinate without penalty."""
    size = 1 << s.bits
    z, n = np.zeros(size + 1), np.zeros(size + 1)

    def weights(at: np.ndarray) -> np.ndarray:
        l1 = np.where(at == size, 0.0, s.l1)
        l2 = np.where(at == size, 0.0, s.l2)
        return np.where(np.abs(z[at]) <= l1, 0.0, -(z[at] - np.sign(z[at]) * l1) / ((s.beta + np.sqrt(n[at])) / s.alpha + l2))

    for _ in range(s.epochs):
        for spots, value, y in rows:
            at, x = np.append(spots, size), np.append(value, 1.0)
            w = weights(at)
            p = 1 / (1 + np.exp(-np.clip(w @ x, -30, 30)))
            g = (p - y) * x
            sigma = (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / s.alpha
            z[at] += g - sigma * w
            n[at] += g * g
    w = weights(np.arange(size + 1))
    return w[:size].astype(np.float32), float(w[size])


def score(docs: DataFrame, weights: np.ndarray, bias: float, s: Settings = Settings()) -> DataFrame:
    """doc_id and score (0 to 1) of every row: the sigmoid of a sparse dot product over its whole text.

    Null and empty texts have no features and get the bias alone. Rows with a null
    doc_id and repeated rows stay; other columns are ignored.
    """
    shared = bounded_batches(docs.sparkSession).sparkContext.broadcast(weights)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = shared.value
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("doc_id").cast(pa.int64()), pa.array(scores(b.column("text"), w, bias, s), pa.float64())], ["doc_id", "score"])

    return docs.select("doc_id", "text").mapInArrow(W.lean(run), RESULT)


def scores(texts: pa.Array, w: np.ndarray, bias: float, s: Settings) -> np.ndarray:
    out = np.full(len(texts), bias)
    for first, end, raw, at in W.chunks(texts):
        for where, counts in places_of_features(raw, at, s):
            out[first:end] += s.scale * sums(w[where].astype(np.float64), counts) / np.maximum(counts, 1)
    return 1 / (1 + np.exp(-np.clip(out, -30, 30)))


def keep_good(docs: DataFrame, weights: np.ndarray, bias: float, threshold: float = 0.5, s: Settings = Settings()) -> DataFrame:
    """The rows of ``docs``, with all their columns, whose text scores at least ``threshold``; no shuffle."""
    shared, at = bounded_batches(docs.sparkSession).sparkContext.broadcast(weights), docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.filter(pa.array(scores(b.column(at), shared.value, bias, s) >= threshold))

    return docs.mapInArrow(W.lean(run), docs.schema)
