"""Benchmark decontamination with DataFrame functions only: SimHash of item-sized windows, multi-index Hamming
blocks, and the exact weighted similarity of word shingles.

Texts and items are lower-cased and cut into words (runs of letters and digits); shingles
are hashes of ``SHINGLE`` consecutive words. An item of fewer words is one shingle of all of
them. An item of L words is compared with windows of L words.

A window that shares no shingle with any item of its length has similarity 0 with all, so
windows are made only where a shingle stands that some item of the length has, and so that
it stands where it stands in that item. Shingles are first held against a Bloom filter of
the benchmark's, of fixed size, and what passes is joined exactly; nothing else of a text
leaves its task.

Each window and item gets a 64-bit SimHash, in which every occurrence of a shingle votes
with its weight (its number of occurrences). Fingerprints are cut into RADIUS + 1 blocks:
two within the radius agree in one block at least, so the join of windows and all items of
their length on (length, block, value) finds every pair within the radius; a pair that agrees
in several blocks is taken at the first. Pairs are then verified by the exact weighted Jaccard
similarity of their shingles: sum of the smaller counts over sum of the larger.

Equal windows are one row from the fingerprint on, whichever number of documents has them.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import written

SHINGLE = 5
SIMILARITY = 0.8
#: Two shingle sets of similarity 0.8 differ in 9.7 of 64 bits on average, with a deviation of 2.9.
RADIUS = 20
#: 64-bit words of the Bloom filter, whatever the benchmark: of other shingles it lets through 0.4 % beside
#: a benchmark of 64,000 shingles and 40 % beside a million. A power of two.
BLOOM_WORDS = 1 << 15

_EDGES = [64 * k // (RADIUS + 1) for k in range(RADIUS + 2)]


def _words(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def _shingles(words: Column, n: int) -> Column:
    """Hashes of the shingles of ``n`` words in order; empty with fewer words than a shingle has."""
    last = F.size(words) - n
    places = F.when(last >= 0, F.sequence(F.lit(0), last)).otherwise(F.array().cast("array<int>"))
    return F.transform(places, lambda i: F.xxhash64(*(F.get(words, i + k) for k in range(n))))


def _simhash(shingles: Column) -> Column:
    """64 majority votes of the shingles' bits; a tie counts as 0."""
    ones = lambda b: F.aggregate(shingles, F.lit(0), lambda n, h: n + F.call_function("shiftright", h, b).bitwiseAND(F.lit(1).cast("long")).cast("int"))
    return F.aggregate(F.sequence(F.lit(0), F.lit(63)), F.lit(0).cast("long"), lambda v, b: F.when(2 * ones(b) > F.size(shingles), v.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), b))).otherwise(v))


def _value(fingerprint: Column, block: int) -> Column:
    first, behind = _EDGES[block], _EDGES[block + 1]
    return F.shiftrightunsigned(fingerprint, first).bitwiseAND(F.lit((1 << (behind - first)) - 1).cast("long"))


def _blocks(fingerprint: Column) -> Column:
    """(block, value) of the RADIUS + 1 blocks of a fingerprint."""
    return F.array(*(F.struct(F.lit(k).alias("block"), _value(fingerprint, k).alias("value")) for k in range(RADIUS + 1)))


def _first_agreement(difference: Column) -> Column:
    """The first block in which two fingerprints of this difference agree."""
    found = F.lit(None).cast("int")
    for k in reversed(range(RADIUS + 1)):
        found = F.when(_value(difference, k) == 0, k).otherwise(found)
    return found


def _similarity(a: Column, b: Column) -> Column:
    """Weighted Jaccard similarity of two lists of shingles."""
    shared = F.array_intersect(a, b)
    count = lambda x, u: F.size(F.filter(x, lambda y: y == u))
    repeats = (F.size(F.array_distinct(a)) < F.size(a)) & (F.size(F.array_distinct(b)) < F.size(b))
    both = F.when(repeats, F.aggregate(shared, F.lit(0), lambda n, u: n + F.least(count(a, u), count(b, u)))).otherwise(F.size(shared))
    return both / (F.size(a) + F.size(b) - both)


def items_of(benchmark: DataFrame) -> DataFrame:
    """item_id, length in words, n (words of a shingle) and shingles. Items without words take no part."""
    # Inside a struct, which is never null itself, a null item_id equals a null item_id in joins.
    words = benchmark.select(F.struct("item_id").alias("item_id"), _words(F.col("text")).alias("words")).withColumns({"length": F.size("words"), "n": F.least(F.lit(SHINGLE), F.size("words"))})
    shingles = F.lit(None).cast("array<long>")
    for n in range(1, SHINGLE + 1):
        shingles = F.when(F.col("n") == n, _shingles(F.col("words"), n)).otherwise(shingles)
    return words.where("length > 0").select("item_id", "length", "n", shingles.alias("item_shingles"))


def _held(df: DataFrame, **columns: Column) -> DataFrame:
    """``df`` with columns that are computed once a row: nothing moves into or through the one-row generators,
    so no filter or lambda further up evaluates the expressions again for each of its elements."""
    for name, value in columns.items():
        df = df.select("*", F.explode(F.array(value)).alias(name))
    return df


def _probes(shingle: Column) -> list[tuple[Column, Column]]:
    """Word and bit of the two places of a shingle in the Bloom filter."""
    return [(F.shiftrightunsigned(shingle, low + 6).bitwiseAND(F.lit(BLOOM_WORDS - 1).cast("long")).cast("int"), F.shiftrightunsigned(shingle, low).bitwiseAND(F.lit(63).cast("long")).cast("int")) for low in (0, 32)]


def _bloom(shingles: DataFrame) -> Column:
    """The Bloom filter of a column ``shingle`` as a literal array of BLOOM_WORDS numbers."""
    places = F.explode(F.array(*(F.struct(word.alias("word"), F.call_function("shiftleft", F.lit(1).cast("long"), bit).alias("bits")) for word, bit in _probes(F.col("shingle")))))
    words = [0] * BLOOM_WORDS
    for word, bits in shingles.select(places.alias("p")).groupBy("p.word").agg(F.bit_or("p.bits")).collect():  # at most BLOOM_WORDS pairs
        words[word] = bits
    return F.from_json(F.lit(json.dumps(words)), "array<long>")


def _windows(docs: DataFrame, items: DataFrame, n: int) -> DataFrame:
    """doc_id, text_hash, length, first_word and shingles of the windows that share a shingle with an item of their length."""
    postings = items.select("length", F.posexplode("item_shingles").alias("item_at", "shingle")).distinct()
    bloom = _bloom(postings)
    rows = docs.where(F.col("text").isNotNull()).select("doc_id", "text", F.xxhash64("text").alias("text_hash"))
    rows = _held(rows, words=_words(F.col("text"))).select("doc_id", "text_hash", F.size("words").alias("n_words"), "words")
    rows = _held(rows, shingles=_shingles(F.col("words"), n)).drop("words")
    passes = lambda h: [F.call_function("shiftright", F.get(bloom, word), bit).bitwiseAND(F.lit(1).cast("long")) == 1 for word, bit in _probes(h)]
    marked = F.array_compact(F.transform("shingles", lambda h, i: F.when(passes(h)[0] & passes(h)[1], i)))
    found = written(_held(rows, places=marked).where(F.size("places") > 0), "passing").withColumn("doc_key", F.struct("doc_id", "text_hash"))
    at = found.select("doc_key", "n_words", F.explode("places").alias("at"), "shingles").select("doc_key", "n_words", "at", F.get("shingles", F.col("at")).alias("shingle"))
    begin = F.greatest(F.lit(0), F.least(F.col("at") - F.col("item_at"), F.col("n_words") - F.col("length")))
    begins = at.join(postings, "shingle").select("doc_key", "length", begin.alias("first_word")).groupBy("doc_key").agg(F.collect_set(F.struct("length", "first_word")).alias("begins"))
    texts = found.select("doc_key", "shingles").dropDuplicates(["doc_key"])
    return begins.join(texts, "doc_key").select("doc_key.*", F.explode("begins").alias("b"), "shingles").select(
        "doc_id", "text_hash", "b.length", "b.first_word", F.slice("shingles", F.col("b.first_word") + 1, F.col("b.length") - n + 1).alias("window"))


def _contaminated(docs: DataFrame, items: DataFrame, n: int, similarity: float) -> DataFrame:
    hits = written(_windows(docs, items, n).withColumn("window_key", F.xxhash64("window", F.size("window"))), "windows")
    windows = hits.groupBy("length", "window_key").agg(F.first("window").alias("window"))
    left = _held(windows, fingerprint=_simhash(F.col("window"))).withColumn("b", F.explode(_blocks(F.col("fingerprint")))).select("length", "window_key", "window", "fingerprint", "b.*")
    right = _held(items, item_fingerprint=_simhash(F.col("item_shingles"))).withColumn("b", F.explode(_blocks(F.col("item_fingerprint")))).select("item_id", "length", "item_shingles", "item_fingerprint", "b.*")
    differ = F.col("fingerprint").bitwiseXOR(F.col("item_fingerprint"))
    near = left.join(right, ["length", "block", "value"]).where((F.bit_count(differ) <= RADIUS) & (_first_agreement(differ) == F.col("block")))
    good = near.withColumn("similarity", _similarity(F.col("window"), F.col("item_shingles"))).where(F.col("similarity") >= similarity)
    good = good.groupBy("item_id", "length", "window_key").agg(F.max("similarity").alias("similarity"))
    best = F.max(F.struct("similarity", (-F.col("first_word")).alias("begin")))
    return hits.select("doc_id", "text_hash", "length", "first_word", "window_key").join(good, ["length", "window_key"]).groupBy("doc_id", "text_hash", "item_id").agg(best.alias("best")).select(
        "doc_id", "text_hash", "item_id.item_id", (-F.col("best.begin")).cast("long").alias("first_word"), F.col("best.similarity").alias("similarity"))


def contaminated(docs: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """doc_id, text_hash, item_id, first_word and similarity of the most similar window of each document and item
    that reach ``similarity``.

    Rows with null texts and items without words give nothing; a null doc_id or item_id is kept; rows that agree in doc_id and
    text give one result. first_word counts the words of the document from 0; of equally similar windows it is the first. Of items that
    share an id each is compared. An item of fewer words than a shingle is found where its words stand consecutively. Extra
    columns are ignored.
    """
    items = written(items_of(benchmark), "items")
    sizes = sorted(r["n"] for r in items.select("n").distinct().collect())  # at most SHINGLE numbers
    found = None
    for n in sizes or [SHINGLE]:
        mine = _contaminated(docs, items.where(F.col("n") == n).drop("n"), n, similarity)
        found = mine if found is None else found.union(mine)
    return found.groupBy("doc_id", "text_hash", "item_id").agg(F.max(F.struct("similarity", (-F.col("first_word")).alias("begin"))).alias("best")).select(
        "doc_id", "text_hash", "item_id", (-F.col("best.begin")).alias("first_word"), "best.similarity") if len(sizes) > 1 else found


def keep_clean(docs: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """The rows of ``docs``, with all their columns, in which no item is found."""
    found = contaminated(docs, benchmark, similarity).select(F.col("doc_id").alias("__t_id"), F.col("text_hash").alias("__t_h")).distinct()
    return docs.join(found, docs["doc_id"].eqNullSafe(F.col("__t_id")) & (F.xxhash64(docs["text"]) == F.col("__t_h")), "left_anti")
