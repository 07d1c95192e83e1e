"""Language identification by words first: a known word is scored by its log frequency in each language; an
unknown word falls back to its character n-grams, the longest order of which any is known.

Words are runs of letters in lower case, n-grams include the word's edges. Words and n-grams are
known by 64-bit hashes. The tables hold all that the training documents hold; these are a number of documents of
each language, so a rare language is learned like a frequent one, and their size is bounded whatever the input.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm import words as W
from tessera.llm.common import bounded_batches

#: The tables are counted on this many documents of each language at most, those with the smallest hash of their id,
#: and on texts of at most so many bytes. All texts are predicted whole.
DOCUMENTS_EACH = 1_024
TRAINING_BYTES = 8_192
#: The sample's size is right to one part in so many.
STEPS = 24
#: Orders of character n-grams, in the order in which an unknown word falls back.
ORDERS = (5, 4, 3, 2, 1)
#: The text counts as this many words at most when its score becomes a probability: words of a text aren't independent.
CERTAIN_WORDS = 20.0
UNDEFINED = "und"

RESULT = "doc_id long, lang_pred string, score double"

_BEGIN, _END = 1, 2
_FACTOR = np.uint64(0x9E3779B97F4A7C15)


def letters(texts: pa.Array) -> pa.Array:
    """Texts in lower case in which a space stands for what is no letter; null texts are empty."""
    return pc.replace_substring_regex(pc.utf8_lower(texts.cast(pa.large_string()).fill_null("")), r"[^\pL]+", " ")


def characters(raw: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Code points of words, each between marks of its begin and end; and the words' offsets."""
    points = np.frombuffer(raw.tobytes().decode("utf-8", "surrogatepass").encode("utf-32-le", "surrogatepass"), "<u4")
    before = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])
    begin, size = before[start], before[end] - before[start]
    at = np.concatenate([[0], np.cumsum(size + 2)])
    out = np.full(at[-1], _BEGIN, np.uint64)
    out[at[1:] - 1] = _END
    inner = np.repeat(at[:-1] + 1 - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
    out[inner] = points[np.repeat(begin - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))]
    return out, at


def grams(points: np.ndarray, at: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each n-gram of the words, and the word that it stands in. N-grams of one character are without the marks."""
    owner = np.repeat(np.arange(len(at) - 1), np.diff(at))
    where = np.flatnonzero((points > _END) if n == 1 else (np.arange(len(points)) + n <= at[1:][owner]))
    found = points[where]
    for k in range(1, n):
        found = found * _FACTOR + points[where + k]
    return W.mix(found), owner[where]


@dataclass(frozen=True)
class Model:
    """Languages, the logs of their shares of the documents, and for order 0 (words) and the n-gram orders the hashes of
    all entries in order and a row of log frequencies for each."""

    langs: list[str]
    prior: np.ndarray
    keys: dict[int, np.ndarray]
    logs: dict[int, np.ndarray]

    def find(self, n: int, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of the entries, and whether each is known."""
        if not len(self.keys[n]):
            return np.zeros(len(hashes), np.int64), np.zeros(len(hashes), bool)
        spot = np.minimum(np.searchsorted(self.keys[n], hashes), len(self.keys[n]) - 1)
        return spot, self.keys[n][spot] == hashes


def fit(docs: DataFrame, learns: Column, each: int = DOCUMENTS_EACH) -> Model:
    """Learns from text and lang of at most ``each`` documents of a language that meet ``learns`` and have an id, a text and a lang.

    Of rows that share id and language the smallest text is read; a language all of whose texts are above TRAINING_BYTES learns from
    its shortest one. Counts are made where the
    documents are read and added up by Spark; the driver gets one row for each entry and language.
    """
    # Documents by the size of their hash in steps of 2 ** (1 / STEPS), the smallest hashes last.
    part = (F.pmod(F.xxhash64("doc_id"), F.lit(1 << 60)) + 1) / F.lit(float(1 << 60))
    known = docs.where(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & F.col("text").isNotNull() & learns).select("doc_id", "lang", "text", F.floor(-STEPS * F.log2(part)).alias("__step"))
    may = known.where(F.octet_length("text") <= TRAINING_BYTES)
    share = {r["lang"]: r["count"] for r in known.groupBy("lang").count().collect()}
    last = _thresholds(may.groupBy("lang", "__step").count().collect(), each)  # at most 60 * STEPS rows for each language
    if not share:
        return Model([], np.zeros(0), {}, {})
    bound = docs.sparkSession.createDataFrame(sorted(last.items()), "lang string, __last long")
    chosen = may.join(F.broadcast(bound), "lang").where("__step >= __last").groupBy("lang", "doc_id").agg(F.min("text").alias("text")).select("lang", "text")
    if long := sorted(share.keys() - last.keys()):  # languages without a text within the bound learn from their shortest one
        shortest = known.where(F.col("lang").isin(long)).groupBy("lang").agg(F.min(F.struct(F.octet_length("text").alias("size"), "text")).alias("one"))
        chosen = chosen.unionByName(shortest.select("lang", "one.text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            langs = np.array(b.column(0).to_pylist(), object)
            texts = letters(b.column(1))
            for lang in sorted(set(langs)):
                for _, _, raw, at in W.chunks(texts.filter(pa.array(langs == lang))):
                    start, end, _ = W.places(raw, at)
                    if not len(start):
                        continue
                    found, one, seen = np.unique(W.word_hashes(raw, start, end), return_index=True, return_counts=True)
                    yield _counted(lang, 0, found, seen)
                    points, ends = characters(raw, start[one], end[one])
                    for n in ORDERS:
                        h, owner = grams(points, ends, n)
                        entry, back = np.unique(h, return_inverse=True)
                        yield _counted(lang, n, entry, np.bincount(back, seen[owner], len(entry)).astype(np.int64))

    bounded_batches(docs.sparkSession)
    counted = chosen.mapInArrow(W.lean(run), "lang string, n int, entry long, seen long").groupBy("n", "entry", "lang").agg(F.sum("seen").alias("seen")).toArrow()
    langs = sorted(share)
    prior = np.array([share[x] for x in langs], float)
    n_of, entry, seen = counted["n"].to_numpy(), counted["entry"].to_numpy().view(np.uint64), counted["seen"].to_numpy()
    lang_of = pc.index_in(counted["lang"], pa.array(langs)).to_numpy()
    keys, logs = {}, {}
    for n in (0, *ORDERS):
        mine = n_of == n
        keys[n], spot = np.unique(entry[mine], return_inverse=True)
        table = np.zeros((len(keys[n]), len(langs)))
        table[spot, lang_of[mine]] = seen[mine]
        logs[n] = np.log((table + 0.1) / (table.sum(0) + 0.1 * (len(table) + 1))).astype(np.float32)
    return Model(langs, np.log(prior / prior.sum()), keys, logs)


def _thresholds(steps: list, each: int) -> dict[str, int]:
    """For each language the lowest step from which on there are ``each`` documents at most; the highest step is always taken."""
    out: dict[str, int] = {}
    seen: dict[str, int] = {}
    for lang, step, n in sorted(map(tuple, steps), key=lambda r: -r[1]):
        if seen.setdefault(lang, 0) == 0 or seen[lang] + n <= each:
            out[lang] = step
        else:
            n = each  # lower steps don't count any more
        seen[lang] += n
    return out


def _counted(lang: str, n: int, entries: np.ndarray, seen: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([lang] * len(seen), pa.string()), pa.array(np.full(len(seen), n, np.int32)), pa.array(entries.view(np.int64)), pa.array(seen.astype(np.int64))], ["lang", "n", "entry", "seen"])


def backoff(m: Model, raw: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """For each word the mean log frequency of the n-grams of the longest order of which any is known; 0 for all languages without any."""
    out = np.zeros((len(start), len(m.langs)))
    left = np.arange(len(start))
    points, at = characters(raw, start, end)
    for n in ORDERS:
        if not len(left):
            break
        h, owner = grams(points, at, n)
        spot, known = m.find(n, h)
        spot, owner = spot[known], owner[known]
        hits = np.bincount(owner, minlength=len(left))
        rows = m.logs[n][spot]
        sums = np.stack([np.bincount(owner, rows[:, k], len(left)) for k in range(len(m.langs))], 1)
        good = hits > 0
        out[left[good]] = sums[good] / hits[good, None]
        keep = np.repeat(~good, np.diff(at))
        points, at, left = points[keep], np.concatenate([[0], np.cumsum(np.diff(at)[~good])]), left[~good]
    return out


def languages(texts: pa.Array, m: Model) -> tuple[list[str], np.ndarray]:
    """Language and probability of each row."""
    names, found = [UNDEFINED] * len(texts), np.zeros(len(texts))
    if not m.langs:
        return names, found
    for row, _, raw, at in W.chunks(letters(texts)):
        start, end, first = W.places(raw, at)
        if not len(start):
            continue
        h, one, back = np.unique(W.word_hashes(raw, start, end), return_index=True, return_inverse=True)
        spot, known = m.find(0, h)
        value = np.zeros((len(h), len(m.langs)))
        value[known] = m.logs[0][spot[known]]
        unknown = one[~known]
        value[~known] = backoff(m, raw, start[unknown], end[unknown])
        size = np.diff(first)
        rows = np.flatnonzero(size)
        size = size[rows, None]
        total = np.stack([np.add.reduceat(value[back, k], first[rows]) for k in range(len(m.langs))], 1)
        total = total / size * np.minimum(size, CERTAIN_WORDS) + m.prior
        total = np.exp(total - total.max(1, keepdims=True))
        best = total.argmax(1)
        found[row + rows] = total[np.arange(len(rows)), best] / total.sum(1)
        for i, k in zip((row + rows).tolist(), best.tolist(), strict=True):
            names[i] = m.langs[k]
    return names, np.minimum(found, 1.0)


def predict(docs: DataFrame, m: Model) -> DataFrame:
    """doc_id, language and its probability for every row, by its whole text.

    Texts that are null or hold no letter, and any text if nothing was learned, give
    ``und`` and 0. Ties go to the language that sorts first. Rows with a null doc_id and
    repeated rows stay; other columns are ignored. No shuffle.
    """
    shared = bounded_batches(docs.sparkSession).sparkContext.broadcast(m)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            names, score = languages(b.column(1), shared.value)
            yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.int64()), pa.array(names, pa.string()), pa.array(score, pa.float64())], ["doc_id", "lang_pred", "score"])

    return docs.select("doc_id", "text").mapInArrow(W.lean(run), RESULT)
