"""Near duplicates among wide fingerprints: an index of bit blocks, kept as a bucketed table that later audits probe.

Two fingerprints within ``radius`` bits agree in one of ``radius + 1`` blocks, so equal blocks find all pairs. A 256-bit
fingerprint has blocks of 36 bits at radius 6, which chance hardly fills. A block that many fingerprints share (blank
regions) is refined: the other bits are cut into ``radius + 1`` blocks again, of which one must agree too.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators.duplicates import hamming
from tessera.tables import fresh_path

#: Blocks that more fingerprints share are refined.
SHARED = 256
#: Buckets of the kept table: a probe shuffles the probing rows alone into as many.
BUCKETS = 64


def grid_words(values: Column, width: int, height: int) -> Column:
    """Difference hash of a row-major grid as words of 64 bits: a bit is 1 where the right neighbour is larger, first bit highest. Bits that fill no word stay 0."""
    n = (width - 1) * height
    at = lambda i: F.floor(i / (width - 1)).cast("int") * width + i % (width - 1)
    bit = lambda v, i: F.when((i < n) & (F.get(v, at(i) + 1) > F.get(v, at(i))), F.lit(1)).otherwise(F.lit(0)).cast("long")
    word = lambda v, w: F.aggregate(F.sequence(F.lit(0), F.lit(63)), F.lit(0).cast("long"), lambda a, b: F.shiftleft(a, 1).bitwiseOR(bit(v, w * 64 + b)))
    words = lambda v: F.transform(F.sequence(F.lit(0), F.lit((n - 1) // 64)), lambda w: word(v, w))
    return F.get(F.transform(F.array(values), words), F.lit(0))  # values are computed once, and not again for each bit


def block_places(bits: int, n: int) -> list[range]:
    """``n`` runs of bit places that cover a fingerprint."""
    edges = [bits * k // n for k in range(n + 1)]
    return [range(a, z) for a, z in zip(edges, edges[1:], strict=False)]


def block_value(words: Column, places: list[int]) -> Column:
    """The bits at sorted ``places`` of 64-bit words (place 0 is the highest bit of word 0), as an array with a piece for each word."""
    pieces = []
    for w in sorted({p // 64 for p in places}):
        mask = sum(1 << (63 - p % 64) for p in places if p // 64 == w)
        pieces.append(F.get(words, F.lit(w)).bitwiseAND(F.lit(mask - (1 << 64) if mask >> 63 else mask).cast("long")))
    return F.array(*pieces)


@dataclass(frozen=True)
class Scheme:
    """How fingerprints of ``bits`` bits are cut for pairs within ``radius``."""

    bits: int = 256
    radius: int = 6

    def blocks(self) -> list[list[int]]:
        return [list(r) for r in block_places(self.bits, self.radius + 1)]

    def inner(self, block: int) -> list[list[int]]:
        """Blocks of the places outside ``block``."""
        mine = set(self.blocks()[block])
        rest = [p for p in range(self.bits) if p not in mine]
        return [[rest[i] for i in r] for r in block_places(len(rest), self.radius + 1)]

    def keys(self, words: Column) -> Column:
        """array of (block, key): one for each block; the key is a hash of block and bits, and pairs are verified."""
        return F.array(*(F.struct(F.lit(k).alias("block"), F.xxhash64(F.lit(k), block_value(words, places)).alias("key")) for k, places in enumerate(self.blocks())))

    def inner_keys(self, words: Column, block: Column, key: Column) -> Column:
        """array of (inner, key): refined keys of a row whose block is shared by many."""
        of = lambda k: F.array(*(F.struct(F.lit(j).alias("inner"), F.xxhash64(key, F.lit(j), block_value(words, places)).alias("key")) for j, places in enumerate(self.inner(k))))
        out = F.when(block == 0, of(0))
        for k in range(1, self.radius + 1):
            out = out.when(block == k, of(k))
        return out

    def first_common(self, a: Column, b: Column, block: Column, inner: Column) -> Column:
        """Whether block (and inner block, where not -1) is the first in which both agree, so that a pair counts in one block only."""
        agree = lambda blocks: F.array(*(block_value(a, p) == block_value(b, p) for p in blocks))
        outer = F.array_position(agree(self.blocks()), True) - 1 == block
        within = F.when(inner == -1, True)
        for k in range(self.radius + 1):
            within = within.when(block == k, F.array_position(agree(self.inner(k)), True) - 1 == inner)
        return outer & within


@dataclass(frozen=True)
class Index:
    """A kept index: ``table`` of (id, words, block, inner, key) bucketed by key, and ``hot``, the shared keys that were refined."""

    scheme: Scheme
    table: str
    hot: str
    buckets: int


def _rows(df: DataFrame, key: str, words: str) -> DataFrame:
    return df.where(F.col(words).isNotNull()).select(F.col(key).alias("id"), F.col(words).alias("words"))


def _keyed(rows: DataFrame, scheme: Scheme, hot: DataFrame) -> DataFrame:
    """(id, words, block, inner, key): plain blocks, and inner blocks of those whose key is ``hot``."""
    plain = rows.select("id", "words", F.inline(scheme.keys(F.col("words"))))
    marked = plain.join(hot.select(F.col("key").alias("__hot")), F.col("key") == F.col("__hot"), "left")
    cold = marked.where("__hot IS NULL").select("id", "words", "block", F.lit(-1).alias("inner"), "key")
    fine = marked.where("__hot IS NOT NULL").select("id", "words", "block", F.inline(scheme.inner_keys(F.col("words"), F.col("block"), F.col("key"))))
    return cold.unionByName(fine)


def build(df: DataFrame, key: str, words: str, name: str, scheme: Scheme = Scheme(), shared: int = SHARED, buckets: int = BUCKETS) -> Index:
    """Indexes fingerprints (``key``, array of 64-bit ``words``; nulls are left out) as a table ``name`` in the shared folder.

    Index distinct fingerprints, as representatives of classes are. The table is bucketed by block key, so a probe
    of any later audit moves its own rows only.
    """
    spark = df.sparkSession
    rows = _rows(df, key, words)
    counted = rows.select(F.inline(scheme.keys(F.col("words")))).groupBy("key").count().where(F.col("count") > shared)
    hot = fresh_path(spark, f"{name}-shared")
    counted.select("key").write.parquet(hot)
    keyed = _keyed(rows, scheme, spark.read.schema("key long").parquet(hot))
    keyed.repartition(buckets, "key").write.bucketBy(buckets, "key").sortBy("key").option("path", fresh_path(spark, name)).saveAsTable(name)
    return Index(scheme, name, hot, buckets)


def _within(a: DataFrame, b: DataFrame, scheme: Scheme, which: Column) -> DataFrame:
    """(id_1, id_2, distance) of keyed rows that share a key, are within the radius, and meet ``which``; each pair once."""
    x, y = a.alias("a"), b.alias("b")
    wa, wb = F.col("a.words"), F.col("b.words")
    same = (F.col("a.block") - F.col("b.block") == 0) & (F.col("a.inner") - F.col("b.inner") == 0)  # tested beside the key, which alone the tables are bucketed by
    found = x.join(y, (F.col("a.key") == F.col("b.key")) & same & which & (hamming(wa, wb) <= scheme.radius))
    first = scheme.first_common(wa, wb, F.col("a.block"), F.col("a.inner"))
    return found.where(first).select(F.col("a.id").alias("id_1"), F.col("b.id").alias("id_2"), hamming(wa, wb).alias("distance"))


def near_pairs(index: Index, spark: SparkSession) -> DataFrame:
    """All pairs of indexed fingerprints within the radius, the smaller id first: read bucket by bucket, without a shuffle."""
    kept = spark.table(index.table)
    return _within(kept, kept.hint("merge"), index.scheme, F.col("a.id") < F.col("b.id"))


def probe(index: Index, df: DataFrame, key: str, words: str) -> DataFrame:
    """(id_1 of ``df``, id_2 of the index, distance) of all pairs within the radius; only the rows of ``df`` are shuffled."""
    spark = df.sparkSession
    keyed = _keyed(_rows(df, key, words), index.scheme, spark.read.schema("key long").parquet(index.hot))
    return _within(keyed.repartition(index.buckets, "key"), spark.table(index.table).hint("merge"), index.scheme, F.lit(True))


def add(index: Index, df: DataFrame, key: str, words: str) -> None:
    """Appends fingerprints to a kept index. Its shared keys stay those of the build."""
    keyed = _keyed(_rows(df, key, words), index.scheme, df.sparkSession.read.schema("key long").parquet(index.hot))
    keyed.repartition(index.buckets, "key").write.bucketBy(index.buckets, "key").sortBy("key").mode("append").saveAsTable(index.table)


def candidates(index: Index, spark: SparkSession) -> DataFrame:
    """One row: fingerprints, all pairs, pairs that share a key in some block, and pairs within the radius."""
    kept = spark.table(index.table)
    sizes = kept.groupBy("block", "inner", "key").agg(F.count("*").alias("n")).agg(F.coalesce(F.sum(F.shiftright(F.col("n") * (F.col("n") - 1), 1)), F.lit(0)).alias("candidates"))
    n = kept.agg(F.count_distinct("id").alias("fingerprints"))
    near = near_pairs(index, spark).agg(F.count("*").alias("near"))
    one = n.crossJoin(F.broadcast(sizes)).crossJoin(F.broadcast(near))  # one row each
    return one.select("fingerprints", F.shiftright(F.col("fingerprints") * (F.col("fingerprints") - 1), 1).alias("pairs"), "candidates", "near")


__all__ = ["BUCKETS", "SHARED", "Index", "Scheme", "add", "build", "candidates", "grid_words", "near_pairs", "probe"]
