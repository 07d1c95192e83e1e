"""Duplicates as classes: a representative and its members stand for the pairs, whose numbers follow by arithmetic.

A class of n equal records has n (n - 1) / 2 pairs; the audit keeps one row a class and one row a member instead.
Near duplicates are looked for between representatives alone, and every such pair stands for all pairs of both classes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.scalars import UNASSIGNED
from tessera.operators.duplicates import EXACT, LEAKS, leaks
from tessera.tables import written

#: Columns of the counters of pairs (see ``pair_counters``).
COUNTERS = ("pairs", "cross_split_pairs", *(f"leakage_{a}_{b}" for a, b in LEAKS))


def classes(records: DataFrame, key: str, digest: str, split: str, carry: list[str]) -> DataFrame:
    """One row for each digest that isn't null: ``digest``, ``representative`` (the least key), ``n``, ``by_split`` and the representative's ``carry``.

    ``by_split`` counts members by lower-cased split, null splits as unassigned. Members are counted before the shuffle, so a
    class with a third of all records sends one row a split and task.
    """
    named = F.coalesce(F.lower(F.col(split)), F.lit(UNASSIGNED))
    first = F.min(F.struct(F.col(key).alias("representative"), *(F.col(c) for c in carry)))
    parts = records.where(F.col(digest).isNotNull()).groupBy(F.col(digest).alias("digest"), named.alias("__split")).agg(F.count("*").alias("__n"), first.alias("__first"))
    whole = parts.groupBy("digest").agg(F.min("__first").alias("__first"), F.sum("__n").alias("n"), F.map_from_entries(F.collect_list(F.struct("__split", "__n"))).alias("by_split"))
    return whole.select("digest", "__first.representative", "n", "by_split", *(F.col(f"__first.{c}").alias(c) for c in carry))


def membership(records: DataFrame, found: DataFrame, key: str, digest: str, carry: list[str]) -> DataFrame:
    """(key, carry..., representative) of every record with a digest; records of one class share the representative.

    A join of many rows with one for each digest, which the adaptive skew join splits where a class is large.
    """
    return records.where(F.col(digest).isNotNull()).join(found.select(F.col("digest").alias("__d"), "representative"), F.col(digest) == F.col("__d")).select(key, *carry, "representative")


def star_edges(members: DataFrame, found: DataFrame, key: str, carry: list[str]) -> DataFrame:
    """An edge from the representative to each other member: ``<c>_1`` of the representative, ``<c>_2`` of the member. n - 1 edges for a class of n."""
    ones = found.where("n > 1").select(F.col("representative").alias(f"{key}_1"), *(F.col(c).alias(f"{c}_1") for c in carry))
    others = members.where(F.col(key) != F.col("representative")).select(F.col("representative").alias("__r"), F.col(key).alias(f"{key}_2"), *(F.col(c).alias(f"{c}_2") for c in carry))
    ends = [f"{c}_{k}" for c in [key, *carry] for k in (1, 2)]
    return others.join(ones, F.col("__r") == F.col(f"{key}_1")).select(*ends, F.lit(EXACT).alias("duplicate_type"))


def pairs_of(members: DataFrame, wanted: DataFrame, key: str) -> DataFrame:
    """Pairs on demand: (``<key>_1``, ``<key>_2``), the smaller first, of the ``wanted`` keys with all other members of their classes.

    The result has as many rows as the asked records have copies; no other class is expanded.
    """
    asked = members.join(wanted.select(F.col(key).alias("__k")).distinct(), F.col(key) == F.col("__k"), "left_semi").select(F.col(key).alias("__a"), F.col("representative").alias("__r"))
    both = asked.join(members.select(F.col(key).alias("__b"), F.col("representative")), F.col("__r") == F.col("representative")).where("__a <> __b")
    return both.select(F.least("__a", "__b").alias(f"{key}_1"), F.greatest("__a", "__b").alias(f"{key}_2")).distinct()


def _of(by_split: Column, name: str) -> Column:
    """Members of a split; ``validation`` counts as ``val``."""
    at = lambda s: F.coalesce(F.try_element_at(by_split, F.lit(s)), F.lit(0))
    return at("val") + at("validation") if name == "val" else at(name)


def _assigned(by_split: Column) -> Column:
    return F.map_filter(by_split, lambda s, n: s != UNASSIGNED)


def _sum(counts: Column) -> Column:
    return F.aggregate(counts, F.lit(0).cast("long"), lambda a, x: a + x)


def _within(n: Column) -> Column:
    """Pairs among n records; an exact integer."""
    return F.shiftright(n * (n - 1), 1)


def exact_counters(found: DataFrame) -> DataFrame:
    """COUNTERS of all pairs inside classes, in one row: by sizes, never by pairs."""
    held = _assigned(F.col("by_split"))
    cross = _within(_sum(F.map_values(held))) - _sum(F.transform(F.map_values(held), _within))
    values = [_within(F.col("n")), cross, *(_of(F.col("by_split"), a) * _of(F.col("by_split"), b) for a, b in LEAKS)]
    return found.agg(*(F.coalesce(F.sum(v), F.lit(0)).cast("long").alias(name) for name, v in zip(COUNTERS, values, strict=True)))


def near_counters(pairs: DataFrame) -> DataFrame:
    """COUNTERS of all record pairs for which pairs of classes (n_1, by_split_1, n_2, by_split_2) stand, in one row."""
    a, b = F.col("by_split_1"), F.col("by_split_2")
    same = F.aggregate(F.map_entries(_assigned(a)), F.lit(0).cast("long"), lambda t, e: t + e["value"] * F.coalesce(F.try_element_at(b, e["key"]), F.lit(0)))
    cross = _sum(F.map_values(_assigned(a))) * _sum(F.map_values(_assigned(b))) - same
    values = [F.col("n_1") * F.col("n_2"), cross, *(_of(a, x) * _of(b, y) + _of(a, y) * _of(b, x) for x, y in LEAKS)]
    return pairs.agg(*(F.coalesce(F.sum(v), F.lit(0)).cast("long").alias(name) for name, v in zip(COUNTERS, values, strict=True)))


def pair_counters(exact: DataFrame, near: DataFrame) -> DataFrame:
    """COUNTERS of exact and near pairs together, in one row."""
    return exact.unionByName(near).agg(*(F.sum(c).alias(c) for c in COUNTERS))


def near_class_pairs(pairs: DataFrame, found: DataFrame, carry: list[str]) -> DataFrame:
    """Pairs of representatives (representative_1, representative_2, distance) with ``n``, ``by_split`` and ``carry`` of both classes."""
    out = pairs
    for k in (1, 2):
        side = found.select(F.col("representative").alias(f"representative_{k}"), *(F.col(c).alias(f"{c}_{k}") for c in ["n", "by_split", *carry]))
        out = out.join(side, f"representative_{k}")
    return out.withColumn("leakage_flag", leaks(F.col("split_1"), F.col("split_2"))) if "split" in carry else out


def audited(records: DataFrame, key: str, digest: str, split: str, carry: list[str]) -> tuple[DataFrame, DataFrame]:
    """(classes, membership), both written, as the audit's own tables."""
    found = written(classes(records, key, digest, split, carry), "classes")
    return found, written(membership(records, found, key, digest, carry), "membership")
