"""Document fingerprints by closed syncmers, in DataFrame functions only.

A text is cut into tokens of up to four characters that never cross white space. Of the runs of K tokens those are anchors whose
least inner run of S tokens, by hash, stands first or last in them: closed syncmers. Whether a run is an anchor depends on nothing
but the run, so what two texts share gives both the same anchors wherever it stands. A fingerprint holds the anchors of the
least hashes with their places. Two fingerprints are compared among the least hashes of both; an anchor counts as shared if it stands
at the same place, or is shifted as far as another shared anchor is, so chance matches don't add up.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import buckets

#: Tokens of a run, tokens of an inner run, and anchors of a fingerprint.
K, S, ANCHORS = 6, 2, 64
TOKEN = r"\S{1,4}"
#: An anchor is one long: 35 bits of its hash above 28 bits of its place.
PLACE_BITS = 28
LAST_PLACE = (1 << PLACE_BITS) - 1
LEAST = -(1 << 63)
#: Bytes of input that one bucket of consecutive documents holds, and the most buckets: the driver holds one key a bucket.
BUCKET_BYTES, MOST_BUCKETS = 8 << 20, 1 << 14


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, which is computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _closed(h: Column, i: Column) -> Column:
    """The inner hashes h[i .. i + K - S] have their least at an edge."""
    at = [F.get(h, i + c) for c in range(K - S + 1)]
    edge = lambda one, others: [one <= x for x in others]
    both = []
    for tests in (edge(at[0], at[1:]), edge(at[-1], at[-2::-1])):
        all_of = tests[0]
        for x in tests[1:]:
            all_of = all_of & x
        both.append(all_of)
    return both[0] | both[1]


def _least_of_each_hash(anchors: Column, most: int) -> Column:
    """The first ``most`` distinct hashes of sorted anchors, each with its first place."""
    hash_of = lambda x: F.shiftright(x, PLACE_BITS)
    return _let(anchors, lambda a: F.slice(F.filter(a, lambda x, i: (i == 0) | (hash_of(x) != hash_of(F.get(a, i - 1)))), 1, most))


def fingerprint(text: Column, most: int = ANCHORS) -> Column:
    """array<bigint> of the anchors of a whole text, ``most`` at most, by hash; null and empty texts, and white space alone, have none.

    The start of a text counts as K - 1 empty tokens, and each run that begins with S of them is an anchor, so
    short texts have anchors too. The work and memory of a row grow with its text.
    """
    none = F.array().cast("array<bigint>")
    tokens = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(TOKEN), F.lit(0))
    inner = lambda t: F.concat(F.array_repeat(F.lit(LEAST).cast("bigint"), K - S), F.transform(t, lambda x, i: F.xxhash64(F.get(t, i - 1), x)))
    packed = lambda h, i: F.shiftleft(F.shiftrightunsigned(F.xxhash64(*(F.get(h, i + c) for c in range(0, K, S))), PLACE_BITS + 1), PLACE_BITS).bitwiseOR(F.least(i, F.lit(LAST_PLACE)).cast("bigint"))
    places = lambda h: F.sequence(F.lit(0), F.size(h) - (K - S + 1))
    anchors = lambda h: F.sort_array(F.transform(F.filter(places(h), lambda i: _closed(h, i)), lambda i: packed(h, i)))
    found = lambda t: F.when(F.size(t) > 0, _least_of_each_hash(_let(inner(t), anchors), most)).otherwise(none)
    return _let(tokens, found)


def as_text(anchors: Column) -> Column:
    """A fingerprint as a string: 16 hexadecimal digits an anchor."""
    return F.array_join(F.transform(anchors, lambda x: F.lpad(F.lower(F.hex(x)), 16, "0")), "")


def likeness(a: Column, b: Column, most: int = ANCHORS) -> Column:
    """0 to 1: twice the share of common anchors over one more than it, as if whole sets of anchors were compared (Dice). Two empty fingerprints are alike."""
    hashes = lambda x: F.transform(x, lambda y: F.shiftright(y, PLACE_BITS))
    places = lambda x: F.transform(x, lambda y: y.bitwiseAND(F.lit(LAST_PLACE).cast("bigint")))
    at = lambda x: F.map_from_arrays(hashes(x), places(x))

    def shifts(common: Column) -> Column:
        ours, theirs = at(a), at(b)
        moved = lambda p, q: F.transform(common, lambda c: F.struct(c.alias("hash"), (F.element_at(p, c) - F.element_at(q, c)).alias("by")))
        return _let(ours, lambda p: _let(theirs, lambda q: moved(p, q)))

    in_place = lambda found: F.filter(found, lambda x: (x["by"] == 0) | (F.size(F.filter(found, lambda y: y["by"] == x["by"])) > 1))
    shared = lambda common: F.transform(_let(shifts(common), in_place), lambda x: x["hash"])
    least = F.slice(F.sort_array(F.array_union(hashes(a), hashes(b))), 1, most)
    share = lambda common: F.when(F.size(common) == 0, F.lit(0.0)).otherwise(_let(least, lambda u: F.size(F.array_intersect(u, shared(common))) / F.size(u)))
    dice = _let(_let(F.array_intersect(hashes(a), hashes(b)), share), lambda j: 2 * j / (1 + j))
    return F.when((F.size(a) == 0) & (F.size(b) == 0), F.lit(1.0)).otherwise(dice)


def _order(doc_id: Column, text: Column) -> Column:
    """Strings that sort as documents by descending doc_id, null ids last, equal ids by a hash of their texts."""
    digits = lambda x: F.lpad(F.hex(x.bitwiseXOR(F.lit(LEAST).cast("bigint"))), 16, "0")
    number = F.bitwise_not(F.coalesce(doc_id.cast("bigint"), F.lit(0).cast("bigint")))
    return F.concat(F.when(doc_id.isNull(), "1").otherwise("0"), digits(number), digits(F.xxhash64(text)))


def _at_or_before(keys: Column, n: int, key: Column) -> Column:
    """How many of the ``n`` sorted ``keys`` are at or before ``key``, by halving."""
    steps = F.array(*(F.lit(1 << s) for s in reversed(range(max(1, n.bit_length())))))
    further = lambda at, step: F.when((at + step <= n) & (F.get(keys, at + step - 1) <= key), at + step).otherwise(at)
    return F.aggregate(steps, F.lit(0), further)


def with_next(rows: DataFrame, carry: list[str]) -> DataFrame:
    """``rows`` (doc_id, text, ...) with ``next_<c>`` of each column in ``carry``: its value in the next document, by descending doc_id; after the last comes the first.

    Documents are dealt by ranges of that order into buckets, whose first keys the driver holds. The first document of a bucket
    is sent to the end of the bucket before it as well, and the very first one to the end of the last, so every document
    meets its next one in one shuffle, without a window over all rows. Rows of one id and text count as repeated documents.
    """
    keys = rows.select(_order(F.col("doc_id"), F.col("text")).alias("__order"))
    n = min(buckets(rows, BUCKET_BYTES), MOST_BUCKETS)
    firsts = sorted(r["first"] for r in keys.repartitionByRange(n, "__order").groupBy(F.spark_partition_id()).agg(F.min("__order").alias("first")).collect())
    if not firsts:
        return rows.select("*", *(F.col(c).alias(f"next_{c}") for c in carry))
    listed = F.split(F.lit(",".join(firsts)), ",")
    dealt = rows.withColumn("__order", _order(F.col("doc_id"), F.col("text"))).withColumn("__bucket", _at_or_before(listed, len(firsts), F.col("__order")))
    first = F.get(listed, F.col("__bucket") - 1) == F.col("__order")
    before = F.when(F.col("__bucket") > 1, F.col("__bucket") - 1).otherwise(F.lit(len(firsts)))
    place = lambda bucket, guest: F.struct(bucket.alias("__at"), F.lit(guest).alias("__guest"))
    dealt = dealt.select("*", F.inline(F.when(first, F.array(place(F.col("__bucket"), False), place(before, True))).otherwise(F.array(place(F.col("__bucket"), False)))))
    order = Window.partitionBy("__at").orderBy("__guest", "__order", "text")
    following = dealt.select("*", *(F.lead(c).over(order).alias(f"next_{c}") for c in carry)).where("NOT __guest")
    return following.drop("__order", "__bucket", "__at", "__guest")


def edited_fingerprints(docs: DataFrame) -> DataFrame:
    """Fingerprints of documents (doc_id, text) and of their edited texts, and how alike both are, and the next document's.

    The edited text has the last third of the code points, rounded down, replaced by the first as many (or all) of the next
    document (see ``with_next``). Null texts count as empty; other columns are not read. An empty table gives no rows.
    """
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.withColumn("anchors", fingerprint(F.col("text")))
    met = with_next(rows, ["text", "anchors"]).withColumn("n_chars", F.char_length("text").cast("long"))
    third = F.expr("cast(n_chars div 3 AS int)")
    met = met.withColumn("edited", F.concat(F.substring("text", F.lit(1), F.col("n_chars").cast("int") - third), F.substring("next_text", F.lit(1), third)))
    met = met.select("doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), "anchors", "next_anchors", F.explode(F.array(fingerprint(F.col("edited")))).alias("edited_anchors"))
    return met.select(
        "doc_id", "n_chars", "edited_sha256", as_text(F.col("anchors")).alias("fingerprint"), as_text(F.col("edited_anchors")).alias("edited_fingerprint"),
        likeness(F.col("anchors"), F.col("edited_anchors")).alias("near_edited"), likeness(F.col("anchors"), F.col("next_anchors")).alias("near_next"))
