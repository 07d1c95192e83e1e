"""Spelling variants: words that one inserted, deleted or replaced code point makes of each other, and the form each one stands for.

Pairs come from an even-partition pigeonhole join. A word of length l is indexed by its two halves; whatever a single edit
touches, it leaves one half whole. A word of equal length probes with its own halves at the same places, a word one longer
with its first part, and with its last part shifted by one. Where a half is shared by many words, what is left of the words
is halved by the same rule again, so large buckets are split by content. A pair that agrees in both halves counts in the
first, which makes pairs distinct without a shuffle, and each candidate is verified once.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import bounded_batches, written

#: Letters are A-Z, a-z and U+00C0 to U+00FF; of these only A-Z change case.
LETTERS = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 0xC0 else 32 for c in range(256))
OTHER = re.compile("[^A-Za-z\u00C0-\u00FF]")
#: Shortest words that are compared, and how often they occur at least.
LEAST_LENGTH, LEAST_COUNT = 5, 3
#: A form occurs at least so many times as often as the word.
LEAD = 2
#: Halves that more indexed words share are split once more.
SHARED = 64
#: Distinct words that a task gathers before it sends them, and bytes of text that are cut into words at once.
GATHERED, PIECE = 200_000, 1 << 20


def _pieces(text: str) -> Iterator[bytes]:
    """Lower-cased Latin-1 bytes of parts of about PIECE characters that cut no run of letters; what Latin-1 lacks is no letter."""
    at = 0
    while at < len(text):
        found = OTHER.search(text, at + PIECE)
        end = found.start() if found else len(text)
        yield text[at:end].encode("latin-1", "replace").translate(LETTERS)
        at = end


def word_counts(docs: DataFrame, slips: int | None = None, least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT) -> DataFrame:
    """(word, n) of the runs of letters of all whole texts (doc_id, text), of ``least_length`` code points and ``least_count`` occurrences or more.

    With ``slips`` a run whose checksum, crc32 of ``<doc_id>:<run>``, is divisible by it loses the code point at checksum modulo
    length: misspellings that any engine can repeat. Null texts hold no words, a null doc_id makes no slips, and repeated rows count again.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gathered: Counter = Counter()

        def sent() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array([w.decode("latin-1") for w in gathered], pa.string()), pa.array(list(gathered.values()), pa.int64())], names=["word", "n"])
            gathered.clear()
            return out

        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
                start = zlib.crc32(f"{doc_id}:".encode())
                found: Counter = Counter()
                for piece in _pieces(text.as_py() or ""):
                    found.update(piece.split())
                for word, n in found.items():
                    if len(word) < least_length:
                        continue
                    if slips and doc_id is not None:
                        h = zlib.crc32(word if word.isascii() else word.decode("latin-1").encode(), start)
                        if h % slips == 0:
                            word = word[: h % len(word)] + word[h % len(word) + 1 :]
                            if len(word) < least_length:
                                continue
                    gathered[word] += n
                if len(gathered) >= GATHERED:
                    yield sent()
        if gathered:
            yield sent()

    bounded_batches(docs.sparkSession)
    parts = docs.select("doc_id", "text").where("text IS NOT NULL").mapInArrow(run, "word string, n long")
    return parts.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_count)


def _halved(rows: DataFrame, skip: str) -> DataFrame:
    """Rows (word, n, longer, key, rest, skips) with ``rest`` halved: two rows each, whose key holds one half and whose rest is the other.

    Probes that are one longer (longer = 1) are cut as if they had the indexed length: the first part stands where the indexed
    one stands, the last part one place further. ``skip`` is null beside the first half, else the first half.
    """
    size = F.char_length("rest")
    half = F.floor((size - F.col("longer")) / 2).cast("int")
    tail = size - F.col("longer") - half  # length of the indexed last half
    side = lambda part, segment, rest, skipped: F.struct(F.concat("key", F.lit(f"|{part}|"), F.char_length(segment).cast("string"), F.lit(":"), segment).alias("key"), rest.alias("rest"), skipped.alias(skip))
    first, last = F.substring("rest", F.lit(1), half), F.substring("rest", size - tail + 1, tail)
    sides = F.array(side("1", first, F.substring("rest", half + 1, size), F.lit(None).cast("string")), side("2", last, F.substring("rest", F.lit(1), size - tail), first))
    kept = [c for c in rows.columns if c not in ("key", "rest")]
    return rows.select(*kept, F.inline(sides))


def near_words(words: DataFrame, shared: int = SHARED) -> DataFrame:
    """(word, n, near, near_n): both directions of every pair of distinct ``words`` (word, n) that one edit makes of each other."""
    length = F.char_length("word")
    row = lambda longer: words.select("word", "n", F.lit(longer).alias("longer"), (length - longer).cast("string").alias("key"), F.col("word").alias("rest"))
    index, probes = _halved(row(0), "skip1"), _halved(row(0).unionByName(row(1)), "skip1")
    hot = written(index.groupBy("key").count().where(F.col("count") > shared).select(F.col("key").alias("hot")), "shared-halves")

    def split(rows: DataFrame) -> DataFrame:
        marked = rows.join(hot, F.col("key") == F.col("hot"), "left")
        again = _halved(marked.where("hot IS NOT NULL").drop("hot"), "skip2")
        return marked.where("hot IS NULL").drop("hot").withColumn("skip2", F.lit(None).cast("string")).unionByName(again)

    a, b = split(index).alias("a"), split(probes).alias("b")
    fresh = lambda c: F.col(f"a.{c}").isNull() | (F.col(f"a.{c}") != F.col(f"b.{c}"))
    once = (F.col("b.longer") == 1) | (F.col("a.word") < F.col("b.word"))
    pairs = a.join(b, (F.col("a.key") == F.col("b.key")) & once & fresh("skip1") & fresh("skip2") & (F.levenshtein(F.col("a.rest"), F.col("b.rest"), 1) == 1))
    ways = [F.struct(F.col(f"{x}.word").alias("word"), F.col(f"{x}.n").alias("n"), F.col(f"{y}.word").alias("near"), F.col(f"{y}.n").alias("near_n")) for x, y in ("ab", "ba")]
    return pairs.select(F.inline(F.array(*ways)))


def _roots(forms: DataFrame) -> DataFrame:
    """(word, root) of a table (word, form) in which forms are followed to the last one; each round doubles the steps."""
    roots = written(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        ahead = roots.select(F.col("word").alias("root"), F.col("root").alias("next"))
        further = written(roots.join(ahead, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        if further.where("moved").isEmpty():
            return further.drop("moved")
        roots = further.drop("moved")


def variants(words: DataFrame, lead: int = LEAD, shared: int = SHARED) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of distinct ``words`` (word, n).

    ``n_near`` counts the words at one edit, ``form`` is the most frequent of them (ties: the smallest in code-point order) if it
    occurs at least ``lead`` times as often as the word, else null; ``root`` follows forms to the last, and is the word itself where
    there is none. Forms are strictly more frequent than their words, so no chain is circular. Empty tables give no rows.
    """
    words = written(words.select("word", "n"), "words")
    near = near_words(words, shared).groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("order"), F.col("near").alias("form"))).alias("top"))
    found = words.join(near, "word", "left").withColumn("led", -F.col("top.order") >= lead * F.col("n"))
    found = found.select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(F.col("led"), F.col("top.form")).alias("form"), F.when(F.col("led"), -F.col("top.order")).alias("form_n"))
    found = written(found, "forms")
    roots = _roots(found.where("form IS NOT NULL"))
    return found.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
