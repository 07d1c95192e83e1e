"""N-gram Jaccard join: documents link when the Jaccard similarity of their sets of word n-grams reaches a percentage.

1. *Sets.* Every text becomes the set of its distinct n-grams, as 64-bit hashes. Equal sets
   (128 bits of them) are one class; copies are settled here and only classes go on.
2. *Rare-first prefixes.* N-grams are ordered by how often they occur (those that are
   frequent anywhere are counted over all documents, the rest count as rare), ties by hash.
   A set of n has the prefix of its first n - ceil(t n) + 1 n-grams; two sets that reach
   t share one of their prefixes. Any common order gives whole results, so the counts
   affect speed only.
3. *First round.* Classes that share a prefix n-gram are put in order of size, and each meets the
   first and some preceding ones. Each class is compared with the few it meets most often; a
   group of copies with small changes is mostly connected by these, with a bounded number of
   comparisons for each member. A second round does the same among those not yet connected.
4. *Last round.* Classes that share a prefix n-gram but aren't yet connected are paired,
   each pair once, and pass the length, positional and suffix filters before they are
   compared. The suffix filter takes counts of the n-grams by hash range, whose differences
   bound the number of n-grams in only one of the two sets. Pairs inside a component aren't
   needed: they can't change it.

The comparison intersects whole sets. A document without words is linked with nothing.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm import words as W
from tessera.llm.common import HOT_PARTS, hot_keys, spread_join, written
from tessera.operators.components import components

#: A task reports n-grams that it saw this often, in as many n-grams as it holds at once.
FREQUENT_IN_TASK = 4
HELD_NGRAMS = 2 << 20
#: So many of the most frequent n-grams are ordered by their counts (a bound on what is broadcast, not on what is joined).
MOST_FREQUENT = 200_000
#: The group of an n-gram that occurs this often is dealt into SALT parts in the first round.
SALTED_FROM, SALT = 8_192, 64
#: The first round looks at one prefix n-gram in so many, takes the first and the preceding classes by size of
#: its group (NEIGHBOURS in all), and compares each class with the TRIED others it meets most often.
LOOKED_AT, NEIGHBOURS, TRIED = 4, 9, 16
#: Rounds of bounded comparisons before the last one, which pairs what is still apart: two from this similarity on. Below it prefixes are
#: longer, so more is apart and meets more often, and a third round costs less than it saves the last.
TWO_ROUNDS_FROM = 90
#: Hash ranges of the suffix filter.
RANGES = 64
#: Ids of candidates are broadcast up to this many, else joined by a shuffle.
BROADCAST_IDS = 500_000
#: Labels from here on stand for classes whose rows all have null ids.
NO_ID = 1 << 62


def shingles(texts: pa.Array, n: int) -> Iterator[list[np.ndarray]]:
    """For each chunk of rows the n-gram hashes of each row, in text order; fewer words make one n-gram, no words none."""
    for _, _, raw, at in W.chunks(texts):
        raw = W.LOWER_ASCII[raw]
        start, end, first = W.places(raw, at)
        hashed = W.word_hashes(raw, start, end)
        grams = W.ngram_hashes(hashed, n)
        rows = []
        for a, z in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
            if z - a >= n:
                rows.append(grams[a : z - n + 1])
            else:
                rows.append(W.ngram_hashes(hashed[a:z], z - a) ^ np.uint64(z - a) if z > a else np.empty(0, np.uint64))
        yield rows


def _name(u: np.ndarray) -> bytes:
    return hashlib.blake2b(u.tobytes(), digest_size=16).digest()


def sets(docs: DataFrame, n: int) -> DataFrame:
    """doc_id, text_hash, n (size), name (128 bits of the set) and counts by hash range of every row; and, as rows
    with ``gram`` and ``seen`` alone, the n-grams that are frequent in a task."""
    kinds = [("doc_id", pa.int64()), ("text_hash", pa.int64()), ("n", pa.int32()), ("name", pa.binary()), ("ranges", pa.binary()), ("gram", pa.int64()), ("seen", pa.int64())]

    def batch(rows: int, **columns: pa.Array) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([columns.get(c, pa.nulls(rows, k)) for c, k in kinds], names=[c for c, _ in kinds])

    def count(held: list[np.ndarray]) -> pa.RecordBatch:
        hashed, counts = np.unique(np.concatenate(held), return_counts=True)
        many = counts >= FREQUENT_IN_TASK
        return batch(int(many.sum()), gram=pa.array(hashed[many].view(np.int64)), seen=pa.array(counts[many].astype(np.int64)))

    def ranges(u: np.ndarray) -> bytes:
        return np.minimum(np.bincount((u >> np.uint64(58)).astype(np.int64), minlength=RANGES), 255).astype(np.uint8).tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for b in batches:
            k = 0
            for rows in shingles(b.column(1), n):
                found = [np.unique(g) for g in rows]
                part = slice(k, k + len(rows))
                yield batch(len(rows), doc_id=b.column(0)[part].cast(pa.int64()), text_hash=b.column(2)[part], n=pa.array([len(u) for u in found], pa.int32()), name=pa.array([_name(u) if len(u) else None for u in found], pa.binary()), ranges=pa.array([ranges(u) if len(u) else None for u in found], pa.binary()))
                k += len(rows)
                held += found
                size += sum(map(len, found))
                if size >= HELD_NGRAMS:
                    yield count(held)
                    held, size = [], 0
        if held:
            yield count(held)

    return docs.select("doc_id", "text", "text_hash").mapInArrow(W.lean(run), "doc_id long, text_hash long, n int, name binary, ranges binary, gram long, seen long")


def frequent(found: DataFrame) -> tuple[np.ndarray, np.ndarray, int]:
    """Hashes of the most frequent n-grams, sorted, the rank of each by count (rarest first), and the first rank of large groups."""
    counted = found.where("gram IS NOT NULL").groupBy("gram").agg(F.sum("seen").alias("seen")).orderBy(F.desc("seen"), "gram").limit(MOST_FREQUENT).toArrow()
    hashed, counts = counted["gram"].to_numpy().view(np.uint64), counted["seen"].to_numpy()
    rank = np.empty(len(hashed), np.int64)
    rank[np.lexsort((hashed, counts))] = np.arange(len(hashed))
    order = np.argsort(hashed)
    W.give_back()
    return hashed[order], rank[order], int((counts < SALTED_FROM).sum())


def prefix_of(u: np.ndarray, percent: int, known: np.ndarray, rank: np.ndarray, large: int) -> tuple[np.ndarray, int]:
    """The first n-grams of a sorted set in the common order, and how many of them have no large group."""
    length = len(u) - -(-percent * len(u) // 100) + 1
    if not len(known):
        return u[:length], length
    at = np.minimum(np.searchsorted(known, u), len(known) - 1)
    often = known[at] == u
    rare = u[~often][:length]
    ranks = rank[at[often]]
    order = np.argsort(ranks, kind="stable")[: length - len(rare)]
    return np.concatenate([rare, u[often][order]]), len(rare) + int((ranks[order] < large).sum())


def prefixes(docs: DataFrame, n: int, percent: int, order: tuple[np.ndarray, np.ndarray, int]) -> DataFrame:
    """doc_id, text_hash, prefix and the number of n-grams in it that have no large group, of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            k = 0
            for rows in shingles(b.column(1), n):
                part = slice(k, k + len(rows))
                found = [prefix_of(np.unique(g), percent, *shared.value) if len(g) else (g, 0) for g in rows]
                ends = np.concatenate([[0], np.cumsum([len(p) for p, _ in found])])
                lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate([p for p, _ in found]).view(np.int64), pa.int64()))
                yield pa.RecordBatch.from_arrays([b.column(0)[part].cast(pa.int64()), b.column(2)[part], lists, pa.array([r for _, r in found], pa.int32())], ["doc_id", "text_hash", "prefix", "rare"])
                k += len(rows)

    return docs.select("doc_id", "text", "text_hash").mapInArrow(W.lean(run), "doc_id long, text_hash long, prefix array<long>, rare int")


def _with_neighbours(tokens: DataFrame, order: list) -> DataFrame:
    """Column ``near``: the first node and the preceding ones of each n-gram's group in the order; and the next one."""
    group = Window.partitionBy("token", "salt").orderBy(*order)
    near = F.array(F.first("node").over(group), *(F.lag("node", k).over(group) for k in range(1, NEIGHBOURS)))
    return tokens.withColumns({"near": near, "next": F.lead("node").over(group)} | ({"roots": F.array(F.first("root").over(group), *(F.lag("root", k).over(group) for k in range(1, NEIGHBOURS)))} if "root" in tokens.columns else {}))


def _most_met(met: DataFrame, across: bool = False) -> DataFrame:
    """Pairs (x, y) of each node and the TRIED others that it meets most often; only those of other components if ``across``."""
    if across:
        some = met.select("node", "root", F.explode(F.arrays_zip("near", "roots")).alias("o")).where("root <> o.roots").select("node", F.col("o.near").alias("other"))
    else:
        some = met.select("node", F.explode(F.array_distinct("near")).alias("other")).where("node <> other")
    common = some.groupBy("node", "other").agg(F.count("*").alias("common"))
    best = common.groupBy("node").agg(F.slice(F.sort_array(F.collect_list(F.struct("common", "other")), False), 1, TRIED).alias("best")).select("node", F.explode("best.other").alias("other"))
    return best.select(F.least("node", "other").alias("x"), F.greatest("node", "other").alias("y")).distinct()


def _still_open(shared: DataFrame, roots: DataFrame) -> DataFrame:
    """Rows of n-grams that lie in more than one component, with column ``root``."""
    rooted = shared.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    mixed = rooted.groupBy("token").agg(F.min("root").alias("a"), F.max("root").alias("b")).where("a <> b").select("token")
    return written(rooted.join(_bounded(mixed, "mixed"), "token"), "open")


def _joined(roots: DataFrame, links: DataFrame) -> DataFrame:
    """Roots after more links: the components of the old roots, so edges inside one component don't come again."""
    root_of = lambda c: roots.select(F.col("node").alias(c), F.col("root").alias(f"root_{c}"))
    between = links.join(root_of("x"), "x", "left").join(root_of("y"), "y", "left").select(F.coalesce("root_x", "x").alias("u"), F.coalesce("root_y", "y").alias("v"))
    tops = written(components(between), "components").select(F.col("node").alias("root"), F.col("root").alias("top"))
    lone = tops.join(roots.select(F.col("node").alias("root")), "root", "left_anti").select(F.col("root").alias("node"), F.col("top").alias("root"))
    return _bounded(roots.join(tops, "root", "left").select("node", F.coalesce("top", "root").alias("root")).unionByName(lone), "components")


def _bounded(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a written table, broadcast if it has few rows."""
    df = written(df, name)
    return F.broadcast(df) if df.count() <= BROADCAST_IDS else df


def _likely(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """Pairs (x, y) that pass the length and suffix filters."""
    side = lambda c: classes.select(F.col("node").alias(c), F.col("n").alias(f"n_{c}"), F.col("ranges").alias(f"r_{c}"))
    both = pairs.join(side("x"), "x").join(side("y"), "y").select("x", "y", "n_x", "n_y", "r_x", "r_y")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            size = b.column(2).to_numpy().astype(np.int64) + b.column(3).to_numpy()
            a, z = (np.frombuffer(b"".join(b.column(k).to_pylist()), np.uint8).reshape(-1, RANGES).astype(np.int16) for k in (4, 5))
            least = -(-percent * size // (100 + percent))
            yield b.filter(pa.array(np.abs(a - z).sum(1) <= size - 2 * least)).select([0, 1])

    return both.mapInArrow(W.lean(run), "x long, y long")


def _linked(pairs: DataFrame, docs: DataFrame, classes: DataFrame, n: int, percent: int) -> DataFrame:
    """Pairs whose whole sets reach the similarity. Texts of their documents are read again and travel packed."""
    pairs = written(pairs, "pairs")
    nodes = pairs.select(F.col("x").alias("node")).union(pairs.select("y")).distinct()
    wanted = _bounded(nodes.join(classes.select("node", F.col("doc_id").alias("__t_id"), F.col("text_hash").alias("__t_h")), "node"), "candidates")
    rows = docs.join(wanted, docs["doc_id"].eqNullSafe(F.col("__t_id")) & (F.col("text_hash") == F.col("__t_h"))).select("node", "text")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([_packed(t.as_py()) for t in b.column(1)], pa.binary())], ["node", "packed"])

    whole = written(rows.mapInArrow(W.lean(pack), "node long, packed binary").dropDuplicates(["node"]), "texts")
    side = lambda c: whole.select(F.col("node").alias(c), F.col("packed").alias(f"t_{c}"))
    both = pairs.join(side("x"), "x").join(side("y"), "y").select("x", "y", "t_x", "t_y")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(0, b.num_rows, 256):
                part = b.slice(k, 256)
                texts = dict(zip(part.column(0).to_pylist() + part.column(1).to_pylist(), [*part.column(2), *part.column(3)], strict=True))
                found = dict(zip(texts, (np.unique(g) for rows in shingles(pa.array([_unpacked(t.as_py()) for t in texts.values()], pa.large_string()), n) for g in rows), strict=True))
                keep = []
                for x, y in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    a, z = found[x], found[y]
                    union = len(np.union1d(a, z))
                    keep.append(100 * (len(a) + len(z) - union) >= percent * union)
                yield part.filter(pa.array(keep, pa.bool_())).select([0, 1])

    return written(both.mapInArrow(W.lean(compare), "x long, y long"), "links")


def _packed(text: str) -> bytes:
    raw = text.encode()
    return len(raw).to_bytes(8, "little") + pa.Codec("zstd", compression_level=3).compress(raw, asbytes=True)


def _unpacked(blob: bytes) -> str:
    return pa.Codec("zstd").decompress(blob[8:], int.from_bytes(blob[:8], "little"), asbytes=True).decode()


def jaccard_join(docs: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles (set size) and component_id of every row of ``docs``.

    component_id is the smallest non-null doc_id that links reach, the row's own included
    (null if there is none). Null and empty texts have empty sets and are linked with
    nothing. Rows are nodes: rows with the same doc_id are linked only if their texts
    are. Repeated rows give repeated results; other columns are ignored. Ids are below 2**62.
    """
    rows = grouped(docs, n, percent)
    component = F.when(F.col("n") == 0, F.col("doc_id")).when(F.col("component") < NO_ID, F.col("component"))
    return rows.select("doc_id", F.col("n").cast("long").alias("n_shingles"), component.alias("component_id"))


def keep_one(docs: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """``docs`` with all its columns and one row of each group of linked documents: that with the smallest doc_id
    (null ids last), then text hash.

    Rows without words stay, as they are linked with nothing. Rows that agree in doc_id and
    text are one document, so one of them stays.
    """
    rows = grouped(docs, n, percent).where("n > 0").withColumn("key", F.struct(F.coalesce("doc_id", F.lit(NO_ID)), "text_hash"))
    rows = written(rows.select("doc_id", "text_hash", "root", "key"), "rooted")
    first = written(rows.groupBy("root").agg(F.min("key").alias("first"), F.count("*").alias("copies")), "roots")
    rooted = spread_join(rows, first, "root", hot_keys(first, "root", rows.count()), [F.col("doc_id"), F.col("text_hash")])
    drop = written(rooted.where("key <> first").select(F.col("doc_id").alias("__t_id"), F.col("text_hash").alias("__t_h")).distinct(), "dropped")
    few = drop.count() <= BROADCAST_IDS
    left = docs.join(F.broadcast(drop) if few else drop, docs["doc_id"].eqNullSafe(F.col("__t_id")) & (F.xxhash64(docs["text"]) == F.col("__t_h")), "left_anti")
    if docs.groupBy("doc_id").count().where("count > 1").isEmpty():
        return left
    empty = F.coalesce(F.trim(F.translate("text", "\t\n\x0b\f\r", "     ")), F.lit("")) == ""
    return left.where(~empty).dropDuplicates(["doc_id", "text"]).unionByName(left.where(empty))


def grouped(docs: DataFrame, n: int, percent: int) -> DataFrame:
    """doc_id, text_hash, n, root (of the component) and component (its smallest label) of every row.

    root and component are null for rows without words.
    """
    docs = docs.select("doc_id", "text", F.xxhash64("text").alias("text_hash"))
    found = written(sets(docs, n), "sets")
    rows = found.where("n IS NOT NULL").select("doc_id", "text_hash", "n", "name", "ranges")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash")).alias("first")
    classes = rows.where("n > 0").groupBy("name").agg(first, F.first("n").alias("n"), F.first("ranges").alias("ranges"), F.count("*").alias("copies")).select("name", "first.doc_id", "first.text_hash", "n", "ranges", "copies")
    classes = written(classes.withColumn("number", F.monotonically_increasing_id()).withColumn("label", F.coalesce("doc_id", F.lit(NO_ID) + F.pmod(F.xxhash64("name"), F.lit(NO_ID - 1)))), "classes")
    # Ids are good node numbers (small ones lead) unless classes share one.
    plain = classes.groupBy("label").count().where("count > 1").isEmpty()
    classes = classes.withColumn("node", F.col("label" if plain else "number"))
    key = classes.select(F.col("doc_id").alias("__t_id"), F.col("text_hash").alias("__t_h"), "node", "n")
    prefix = prefixes(docs, n, percent, frequent(found)).join(key, F.col("doc_id").eqNullSafe(F.col("__t_id")) & (F.col("text_hash") == F.col("__t_h")))
    tokens = prefix.select("node", "n", "rare", F.posexplode("prefix").alias("pos", "token"))
    # Large groups are salted, anew for each n-gram; the last round sees them whole.
    salt = F.when(F.col("pos") >= F.col("rare"), F.pmod(F.xxhash64("node", "token"), F.lit(SALT)) + 1).otherwise(0).cast("int")
    tokens = tokens.select("token", salt.alias("salt"), "node", "n", "pos")
    met = _with_neighbours(tokens, [F.col("n"), F.col("node")])
    shared = written(met.where("salt > 0 OR next IS NOT NULL OR near[0] <> node"), "tokens")
    pairs = _most_met(shared.where(F.pmod("token", F.lit(LOOKED_AT)) == 0))
    links = _linked(_likely(pairs, classes, percent), docs, classes, n, percent)
    roots = _bounded(components(links.select(F.col("x").alias("u"), F.col("y").alias("v"))), "components")
    # More rounds: the same with neighbours at random, among n-grams that still lie in two components. Each leaves fewer to the last.
    open_ = _still_open(shared.drop("near", "next"), roots)
    for k in range(1 if percent >= TWO_ROUNDS_FROM else 2):
        if open_.isEmpty():
            break
        some = open_.where(F.pmod("token", F.lit(LOOKED_AT)) == k % LOOKED_AT)
        hot = F.broadcast(hot_keys(some.groupBy("token").agg(F.count("*").alias("copies")), "token", some.count()).withColumn("hot", F.lit(True)))
        some = some.join(hot, "token", "left").withColumn("salt", F.when(F.col("hot"), F.pmod(F.xxhash64("token", "node", F.lit(k)), F.lit(HOT_PARTS)).cast("int") + 1).otherwise(F.col("salt"))).drop("hot")
        met = _with_neighbours(some, [F.xxhash64("node", "token", F.lit(k))])
        more = _linked(_likely(_most_met(met, across=True), classes, percent), docs, classes, n, percent)
        roots = _joined(roots, more)
        open_ = _still_open(open_.drop("root"), roots)
    # Last round: all pairs across components that share an n-gram and pass the filters.
    # Sizes that reach the similarity lie in the same step of a scale or in neighbouring ones (steps are a little wider than
    # the ratio, so rounding can't part them).
    step = F.floor(F.log("n") / (1.001 * math.log(100 / percent))).cast("int") if percent < 100 else F.col("n")
    open_ = open_.withColumn("step", step)
    x, y = (open_.select("token", "step", *(F.col(c).alias(f"{c}_{s}") for c in ("node", "n", "pos", "root"))) for s in "xy")
    y = y.withColumn("step", F.explode(F.array(*(F.col("step") + k for k in (-1, 0, 1)))))
    least = f"ceil({percent} * (n_x + n_y) / {100 + percent}D)"
    fits = f"100 * least(n_x, n_y) >= {percent} * greatest(n_x, n_y)"
    cross = x.join(y, ["token", "step"]).where("root_x < root_y").where(fits).where(f"least(n_x - pos_x, n_y - pos_y) >= {least}").select(F.col("node_x").alias("x"), F.col("node_y").alias("y")).distinct()
    roots = _joined(roots, _linked(_likely(cross, classes, percent), docs, classes, n, percent))
    labelled = roots.join(classes.select("node", "label", "name"), "node")
    labelled = written(labelled.select("name", "root", "label"), "labelled")
    smallest = written(labelled.groupBy("root").agg(F.min("label").alias("component"), F.count("*").alias("copies")), "smallest")
    named = spread_join(labelled, smallest, "root", hot_keys(smallest, "root", labelled.count()), [F.col("name")]).select("name", "root", "component")
    settled = classes.select("name", "node", "label").join(named, "name", "left").select("name", F.coalesce("root", "node").alias("root"), F.coalesce("component", "label").alias("component"))
    hot = hot_keys(classes, "name", found.count())
    return spread_join(rows.select("doc_id", "text_hash", "n", "name"), settled, "name", hot, [F.col("doc_id"), F.col("text_hash")], "left").drop("name")
