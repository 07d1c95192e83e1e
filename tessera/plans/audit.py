"""Queries of discovery, profiling, duplicates, groups and splits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import scalars as S
from tessera.operators import duplicates, groups, profile, splits
from tessera.plans.registry import SPLIT, query, rounded, split_by_id
from tessera.tables import table, written


def _documents(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents").select("doc_id", F.md5("text").alias("digest"), "lang", "source", "n_chars", split_by_id().alias("split"))


_DOCS = f"d AS (SELECT doc_id, md5(text) AS digest, lang, source, n_chars, {SPLIT} AS split FROM documents)"
_PAIRS = f"{_DOCS}, p AS (SELECT a.doc_id AS doc_id_1, b.doc_id AS doc_id_2, a.split AS split_1, b.split AS split_2, a.lang AS lang_1, b.lang AS lang_2 FROM d a JOIN d b ON a.digest = b.digest AND a.doc_id < b.doc_id)"


@query(f"WITH {_PAIRS} SELECT *, 'exact_md5' AS duplicate_type, 0.0::DOUBLE AS metric_value, split_1 <> split_2 AS leakage_flag FROM p")
def exact_duplicate_pairs(spark, folder):
    pairs = duplicates.exact_pairs(_documents(spark, folder), "doc_id", "digest", ["split", "lang"])
    return pairs.withColumns({"metric_value": F.lit(0.0), "leakage_flag": duplicates.leaks(F.col("split_1"), F.col("split_2"))})


@query(f"""WITH {_PAIRS} SELECT count(*) AS exact_pairs, count_if(split_1 <> split_2) AS cross_split_pairs,
    count_if((split_1, split_2) IN (('train', 'val'), ('val', 'train'))) AS leakage_train_val,
    count_if((split_1, split_2) IN (('train', 'test'), ('test', 'train'))) AS leakage_train_test,
    count_if((split_1, split_2) IN (('val', 'test'), ('test', 'val'))) AS leakage_val_test FROM p""")
def leakage_pair_counts(spark, folder):
    return duplicates.pair_counts(_documents(spark, folder), "digest", "split")


@query(f"""WITH {_PAIRS} SELECT count(*) AS pairs, count_if(split_1 <> split_2) AS cross_split_pairs,
    count_if((split_1, split_2) IN (('train', 'val'), ('val', 'train'))) AS leakage_train_val,
    count_if((split_1, split_2) IN (('train', 'test'), ('test', 'train'))) AS leakage_train_test,
    count_if((split_1, split_2) IN (('val', 'test'), ('test', 'val'))) AS leakage_val_test FROM p""")
def leakage_counts_of_pairs(spark, folder):
    return duplicates.leak_counts(duplicates.exact_pairs(_documents(spark, folder), "doc_id", "digest", ["split", "lang"]), "split_1", "split_2")


_BITS = " + ".join(f"(CASE WHEN embedding[{r * 8 + c + 2}] > embedding[{r * 8 + c + 1}] THEN {1 << (55 - (r * 7 + c))}::BIGINT ELSE 0 END)" for r in range(8) for c in range(7))
_HASHED = f"h AS (SELECT vec_id, {_BITS} AS h FROM embeddings)"
_NEAR = f"WITH {_HASHED} SELECT a.vec_id AS vec_id_1, b.vec_id AS vec_id_2, bit_count(xor(a.h, b.h))::INTEGER AS distance FROM h a JOIN h b ON a.vec_id < b.vec_id WHERE bit_count(xor(a.h, b.h)) <= 12"


def _hashed(spark, folder):
    return table(spark, folder, "embeddings").select("vec_id", "label", duplicates.grid_hash(F.col("embedding"), 8, 8).alias("words"))


@query(f"WITH {_HASHED} SELECT vec_id, h AS hash FROM h")
def difference_hash(spark, folder):
    return _hashed(spark, folder).select("vec_id", F.get("words", F.lit(0)).alias("hash"))


@query(_NEAR)
def near_duplicate_exhaustive(spark, folder):
    return duplicates.near_pairs(_hashed(spark, folder), "vec_id", "words", 12, [56], mode="exhaustive")


@query(_NEAR)
def near_duplicate_multi_index(spark, folder):
    return duplicates.near_pairs(_hashed(spark, folder), "vec_id", "words", 12, [56], mode="exact")


_CHUNKS = ", ".join(f"({k}, (h >> {42 - 14 * k}) & 16383)" for k in range(4))


@query(f"""WITH {_HASHED}, c AS (SELECT vec_id, h, c.k, c.v FROM h, LATERAL (VALUES {_CHUNKS}) c(k, v)),
    s AS (SELECT k, v FROM c GROUP BY k, v HAVING count(*) < 100), u AS (SELECT c.* FROM c JOIN s USING (k, v))
    SELECT DISTINCT a.vec_id AS vec_id_1, b.vec_id AS vec_id_2, bit_count(xor(a.h, b.h))::INTEGER AS distance
    FROM u a JOIN u b ON a.k = b.k AND a.v = b.v AND a.vec_id < b.vec_id WHERE bit_count(xor(a.h, b.h)) <= 12""")
def near_duplicate_bucketed(spark, folder):
    return duplicates.near_pairs(_hashed(spark, folder), "vec_id", "words", 12, [56], mode="bucketed", n_chunks=4, most_in_bucket=100)


@query(f"""WITH {_HASHED}, e AS (SELECT vec_id, label, h FROM h JOIN embeddings USING (vec_id))
    SELECT a.vec_id AS vec_id_1, b.vec_id AS vec_id_2, bit_count(xor(a.h, b.h))::INTEGER AS distance FROM e a JOIN e b ON a.vec_id < b.vec_id
    WHERE bit_count(xor(a.h, b.h)) <= 12 AND a.label <> b.label""")
def near_pairs_not_yet_paired(spark, folder):
    rows = _hashed(spark, folder).where("label IS NOT NULL")
    return duplicates.not_paired_by(duplicates.near_pairs(rows, "vec_id", "words", 12, [56]), rows, "vec_id", "label")


# ---- groups ----

_EDGES = "e AS (SELECT doc_id AS v, min(doc_id) OVER (PARTITION BY digest) AS u FROM d)"
_GROUPS = f"""{_DOCS}, r AS (SELECT doc_id, lang, source, split, min(doc_id) OVER (PARTITION BY digest) AS root FROM d WHERE digest IS NOT NULL UNION ALL SELECT doc_id, lang, source, split, doc_id FROM d WHERE digest IS NULL),
    n AS (SELECT root, count(*) AS size, row_number() OVER (ORDER BY count(*) DESC, min(doc_id)) AS k FROM r GROUP BY root),
    g AS (SELECT r.*, 'grp_' || lpad(k::VARCHAR, 5, '0') AS duplicate_group_id, size FROM r JOIN n USING (root))"""


def _edges(docs: DataFrame) -> DataFrame:
    """Star edges of exact duplicates: each record to the first of its digest, one row a record."""
    first = docs.where("digest IS NOT NULL").groupBy("digest").agg(F.min("doc_id").alias("u"), F.count("*").alias("n")).where("n > 1")
    return docs.join(first, "digest").where("doc_id <> u").select("u", F.col("doc_id").alias("v"))


def _grouped(spark, folder):
    docs = _documents(spark, folder)
    return docs.join(groups.group_ids(docs, "doc_id", _edges(docs), "u", "v"), "doc_id")


@query(f"WITH {_GROUPS} SELECT doc_id, duplicate_group_id FROM g")
def duplicate_groups(spark, folder):
    return _grouped(spark, folder).select("doc_id", "duplicate_group_id")


@query(f"WITH {_GROUPS} SELECT duplicate_group_id, count(DISTINCT split) AS n_splits, string_agg(DISTINCT split, ',' ORDER BY split) AS splits FROM g GROUP BY 1 HAVING count(DISTINCT split) > 1")
def zero_leakage_check(spark, folder):
    return groups.leaking_groups(_grouped(spark, folder), "duplicate_group_id", "split")


@query("SELECT doc_id, count(DISTINCT role) AS n_splits, string_agg(DISTINCT role, ',' ORDER BY role) AS splits FROM (SELECT conv_id AS doc_id, role FROM conversations) GROUP BY 1 HAVING count(DISTINCT role) > 1")
def split_uniqueness(spark, folder):
    turns = table(spark, folder, "conversations").select(F.col("conv_id").alias("doc_id"), "role")
    return groups.leaking_groups(turns, "doc_id", "role")


@query(f"""WITH {_GROUPS}, x AS (SELECT duplicate_group_id, count(*) AS n, count(DISTINCT split) AS s FROM g GROUP BY 1)
    SELECT sum(n)::BIGINT AS records, count(*) AS groups, count_if(n > 1) AS multi_groups, count_if(n = 1) AS singletons, count_if(s > 1) AS crossing_groups, max(n) AS largest FROM x""")
def group_report(spark, folder):
    return groups.group_report(_grouped(spark, folder), "duplicate_group_id", "split")


@query(f"""WITH {_GROUPS}, l AS (SELECT duplicate_group_id, lang, row_number() OVER (PARTITION BY duplicate_group_id ORDER BY count(*) DESC, lang) AS k FROM g WHERE lang IS NOT NULL GROUP BY 1, 2),
    s AS (SELECT duplicate_group_id, source, row_number() OVER (PARTITION BY duplicate_group_id ORDER BY count(*) DESC, source) AS k FROM g WHERE source IS NOT NULL GROUP BY 1, 2),
    x AS (SELECT duplicate_group_id, count(*) AS n, bool_and(lang = 'en') AS is_healthy FROM g GROUP BY 1)
    SELECT x.duplicate_group_id, n, l.lang AS disease, s.source AS host, is_healthy FROM x LEFT JOIN l ON l.duplicate_group_id = x.duplicate_group_id AND l.k = 1 LEFT JOIN s ON s.duplicate_group_id = x.duplicate_group_id AND s.k = 1""")
def group_modes(spark, folder):
    return groups.group_profile(_grouped(spark, folder), "duplicate_group_id", "lang", "source", F.col("lang") == "en")


@query(f"WITH {_DOCS}, {_EDGES}, a AS (SELECT doc_id FROM d WHERE lang = 'en') SELECT count(*) AS edges FROM e WHERE u <> v AND u IN (SELECT doc_id FROM a) AND v IN (SELECT doc_id FROM a)")
def edges_between_active(spark, folder):
    docs = _documents(spark, folder)
    return duplicates.with_ends(_edges(docs), docs.where("lang = 'en'"), "u", "v", "doc_id").agg(F.count("*").alias("edges"))


# ---- splits ----


def _split_groups(grouped):
    return grouped.groupBy("duplicate_group_id").agg(F.count("*").alias("n"), F.mode("lang", True).alias("lang"), F.mode("source", True).alias("source"))


@query(f"""WITH RECURSIVE {_GROUPS}, l AS (SELECT duplicate_group_id, lang, row_number() OVER (PARTITION BY duplicate_group_id ORDER BY count(*) DESC, lang) AS k FROM g WHERE lang IS NOT NULL GROUP BY 1, 2),
    s AS (SELECT duplicate_group_id, source, row_number() OVER (PARTITION BY duplicate_group_id ORDER BY count(*) DESC, source) AS k FROM g WHERE source IS NOT NULL GROUP BY 1, 2),
    x AS (SELECT duplicate_group_id AS g, count(*) AS n FROM g GROUP BY 1),
    o AS (SELECT x.g, x.n, row_number() OVER (ORDER BY concat_ws('___', s.source, l.lang), md5(x.g || ':42'), x.g) AS i FROM x LEFT JOIN l ON l.duplicate_group_id = x.g AND l.k = 1 LEFT JOIN s ON s.duplicate_group_id = x.g AND s.k = 1),
    w AS (SELECT round_even(sum(n) * 0.7::DOUBLE, 0)::BIGINT AS t, round_even(sum(n) * 0.15::DOUBLE, 0)::BIGINT AS v, sum(n)::BIGINT AS total FROM o),
    y AS (SELECT t, v, total - t - v AS e FROM w),
    f(i, a, b, c, pick, n) AS (SELECT 0::BIGINT, 0::BIGINT, 0::BIGINT, 0::BIGINT, NULL::VARCHAR, 0::BIGINT UNION ALL
        SELECT i + 1, a + CASE WHEN p = 'train' THEN m ELSE 0 END, b + CASE WHEN p = 'val' THEN m ELSE 0 END, c + CASE WHEN p = 'test' THEN m ELSE 0 END, p, m FROM (
            SELECT f.i, a, b, c, o.n AS m, CASE WHEN x1 >= x2 AND x1 >= x3 THEN 'train' WHEN x2 >= x3 THEN 'val' ELSE 'test' END AS p FROM (
                SELECT f.*, (t - a)::DOUBLE / greatest(1, t) AS x1, (v - b)::DOUBLE / greatest(1, v) AS x2, (e - c)::DOUBLE / greatest(1, e) AS x3 FROM f, y) f JOIN o ON o.i = f.i + 1))
    SELECT pick AS benchmark_split, sum(n)::BIGINT AS n, count(*) AS groups FROM f WHERE pick IS NOT NULL GROUP BY 1""")
def greedy_split(spark, folder):
    """A sequential fold over groups."""
    grouped = written(_grouped(spark, folder), "grouped")
    found = _split_groups(grouped)
    ordered = found.withColumn("stratum", splits.stratum(F.col("source"), F.col("lang"), F.lit(False)))
    rows = splits.assigned(grouped, splits.greedy_splits(ordered, "duplicate_group_id", "n", "stratum"), "duplicate_group_id")
    return rows.groupBy("benchmark_split").agg(F.count("*").alias("n"), F.count_distinct("duplicate_group_id").alias("groups"))


@query(f"""WITH {_DOCS}, m AS (SELECT doc_id, 'train' AS s FROM d WHERE split = 'train' UNION ALL SELECT doc_id, 'val' FROM d WHERE split = 'val')
    SELECT d.doc_id, coalesce(m.s, 'train') AS benchmark_split FROM d LEFT JOIN m USING (doc_id)""")
def assigned_split(spark, folder):
    docs = _documents(spark, folder)
    known = docs.where("split <> 'test'").select("doc_id", F.col("split").alias("benchmark_split"))
    return splits.assigned(docs, known, "doc_id").select("doc_id", "benchmark_split")


@query(f"""WITH {_DOCS} SELECT d.doc_id, CASE WHEN n_chars < 100 THEN 'Corrupt or unreadable image: too short' WHEN lang LIKE '%en%' OR quality = 1 THEN NULL
    WHEN lang NOT IN ('de', 'fr') THEN 'Class ''' || lang || ''' not in selected benchmark subset' WHEN quality IS NULL THEN 'Anomalous/empty mask for diseased sample: Zero lesion pixels' END AS reason
    FROM d LEFT JOIN labels USING (doc_id)""")
def exclusion_policy(spark, folder):
    rows = _documents(spark, folder).join(table(spark, folder, "labels").select("doc_id", "quality"), "doc_id", "left")
    healthy = F.lower("lang").contains("en") | F.coalesce(F.col("quality") == 1, F.lit(False))
    return rows.select("doc_id", splits.exclusion_reason(F.col("n_chars") >= 100, F.lit("too short"), F.col("lang"), healthy, ["de", "fr"], True, F.col("quality").isNotNull(), F.lit(None).cast("string"), F.lit(1)).alias("reason"))


@query("""WITH n AS (SELECT *, quality = 1 AS h FROM labels), k AS (SELECT count_if(NOT h) AS d FROM n),
    r AS (SELECT doc_id, h, row_number() OVER (PARTITION BY h ORDER BY md5(doc_id::VARCHAR || ':42'), doc_id) AS i FROM n)
    SELECT doc_id, h AS is_healthy, h AND i > (SELECT round_even(d * 0.2::DOUBLE / (1 - 0.2::DOUBLE), 0) FROM k) AS capped FROM r""")
def healthy_cap(spark, folder):
    rows = table(spark, folder, "labels").select("doc_id", (F.col("quality") == 1).alias("is_healthy"))
    return splits.healthy_cap(rows, "doc_id", "is_healthy", 0.2)


@query("SELECT doc_id FROM labels WHERE quality = 1 ORDER BY md5(doc_id::VARCHAR || ':42'), doc_id LIMIT 50")
def random_sample(spark, folder):
    from tessera.operators.selection import sample

    return sample(table(spark, folder, "labels").where("quality = 1").select("doc_id"), "doc_id", 50)


# ---- profiles ----


@query("SELECT lang, count(*) AS n, round(100.0 * count(*) / sum(count(*)) OVER (), 2) AS percentage FROM documents GROUP BY lang")
def value_counts_pct(spark, folder):
    return profile.value_counts(table(spark, folder, "documents"), "lang").withColumns(rounded("percentage", digits=2))


@query("SELECT toxic, count(*) AS n FROM labels WHERE toxic IS NOT NULL GROUP BY toxic")
def present_value_counts(spark, folder):
    return profile.present_counts(table(spark, folder, "labels"), "toxic")


@query("SELECT CASE WHEN grouping(c_mktsegment) = 1 THEN 'Total' ELSE c_mktsegment END AS c_mktsegment, CASE WHEN grouping(n_name) = 1 THEN 'Total' ELSE n_name END AS n_name, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_mktsegment IS NOT NULL AND n_name IS NOT NULL GROUP BY CUBE (c_mktsegment, n_name)")
def crosstab_margins(spark, folder):
    rows = table(spark, folder, "customer").join(table(spark, folder, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return profile.cross_table(rows, "c_mktsegment", "n_name")


@query(f"WITH {_DOCS} SELECT lang, count_if(split = 'train') AS train, count_if(split = 'val') AS val, count_if(split = 'test') AS test, count(*) AS total FROM d GROUP BY lang")
def class_by_split_pivot(spark, folder):
    return profile.pivot_counts(_documents(spark, folder), "lang", "split", list(S.SPLITS))


def _profile_sql(name: str, expr: str, source: str) -> str:
    return f"""SELECT '{name}' AS "column", count(x) AS n, round(min(x), 4) AS min, round(max(x), 4) AS max, round(avg(x), 4) AS mean, round(median(x), 4) AS median,
        round(CASE WHEN count(x) = 1 THEN 0 ELSE stddev_samp(x) END, 4) AS std, round(quantile_cont(x, 0.25), 4) AS p25, round(quantile_cont(x, 0.75), 4) AS p75 FROM (SELECT {expr} AS x FROM {source})"""


_PROFILE_COLUMNS = ("min", "max", "mean", "median", "std", "p25", "p75")


@query(" UNION ALL ".join(_profile_sql(c, c, "lineitem") for c in ("l_quantity", "l_discount", "l_tax")))
def numeric_profile(spark, folder):
    return profile.profile(table(spark, folder, "lineitem"), {c: F.col(c) for c in ("l_quantity", "l_discount", "l_tax")}).withColumns(rounded(*_PROFILE_COLUMNS, digits=4))


@query(" UNION ALL ".join((_profile_sql("size", "p_size", "part"), _profile_sql("aspect", "p_size::DOUBLE / nullif(p_partkey % 7, 0)", "part"))))
def derived_profiles(spark, folder):
    return profile.profile(table(spark, folder, "part"), {"size": F.col("p_size"), "aspect": profile.aspect(F.col("p_size"), F.col("p_partkey") % 7)}).withColumns(rounded(*_PROFILE_COLUMNS, digits=4))


@query("SELECT p_size || 'x' || (p_partkey % 5) AS value, count(*) AS n FROM part GROUP BY 1 ORDER BY n DESC, value LIMIT 10")
def top_resolutions(spark, folder):
    return profile.top_values(table(spark, folder, "part"), F.concat_ws("x", "p_size", F.col("p_partkey") % 5), 10)


@query("SELECT user_id, count(*) AS n FROM events GROUP BY 1 ORDER BY n DESC, user_id LIMIT 25")
def topk_categories(spark, folder):
    return profile.top_values(table(spark, folder, "events"), F.col("user_id"), 25, "user_id")


@query("SELECT o_orderpriority, count(o_totalprice) AS n, round(avg(o_totalprice), 4) AS mean, round(stddev_samp(o_totalprice), 4) AS std, min(o_totalprice) AS min, round(quantile_cont(o_totalprice, 0.25), 4) AS p25, round(median(o_totalprice), 4) AS p50, round(quantile_cont(o_totalprice, 0.75), 4) AS p75, max(o_totalprice) AS max FROM orders WHERE o_orderpriority IS NOT NULL GROUP BY 1")
def describe_by_group(spark, folder):
    return profile.describe_by(table(spark, folder, "orders"), "o_orderpriority", "o_totalprice").withColumns(rounded("mean", "std", "p25", "p50", "p75", digits=4))


@query("SELECT 'p_brand' AS key, count(DISTINCT p_brand) AS n_distinct, string_agg(DISTINCT p_brand, ',' ORDER BY p_brand) AS values FROM part UNION ALL SELECT 'p_type', count(DISTINCT p_type), string_agg(DISTINCT p_type, ',' ORDER BY p_type) FROM part")
def distinct_summary(spark, folder):
    return profile.distinct_summary(table(spark, folder, "part"), ["p_brand", "p_type"])


_LABELLED = f"{_DOCS}, x AS (SELECT d.*, quality, toxic, quality IS NOT NULL AS valid, coalesce(toxic = 0, false) AS masked, n_chars / 20000.0::DOUBLE AS ratio FROM d LEFT JOIN labels USING (doc_id))"
_CONDITIONAL = """count(*) AS total, count_if(valid) AS valid_images, count_if(masked) AS valid_masks, count_if(split = 'train') AS train_count, count_if(split = 'val') AS val_count, count_if(split = 'test') AS test_count,
    coalesce(median(CASE WHEN masked THEN ratio::DOUBLE END), 0) AS median_ratio, coalesce(avg(CASE WHEN masked THEN ratio::DOUBLE END), 0) AS mean_ratio, coalesce(min(CASE WHEN masked THEN ratio::DOUBLE END), 0) AS min_ratio, coalesce(max(CASE WHEN masked THEN ratio::DOUBLE END), 0) AS max_ratio"""
_RATIOS = ("median_ratio", "mean_ratio", "min_ratio", "max_ratio")


def _conditional(spark, folder):
    rows = _documents(spark, folder).join(table(spark, folder, "labels"), "doc_id", "left").withColumn("ratio", F.col("n_chars") / 20000.0)
    return profile.conditional_profile(rows, ["source", "lang"], F.col("quality").isNotNull(), F.coalesce(F.col("toxic") == 0, F.lit(False)), "ratio", "split", S.SPLITS)


@query(f"WITH {_LABELLED}, c AS (SELECT source, lang, {_CONDITIONAL} FROM x WHERE source IS NOT NULL AND lang IS NOT NULL GROUP BY ALL) SELECT * REPLACE ({', '.join(f'round({c}, 6) AS {c}' for c in _RATIOS)}) FROM c")
def per_group_conditional(spark, folder):
    return _conditional(spark, folder).withColumns(rounded(*_RATIOS))


#: Least rows and masks of each tier.
TIERS = (("Strong", 100, 80), ("Usable", 40, 30), ("Limited", 15, 10))


@query(f"""WITH {_LABELLED}, c AS (SELECT source, lang, {_CONDITIONAL} FROM x WHERE source IS NOT NULL AND lang IS NOT NULL GROUP BY ALL)
    SELECT source, lang, total, valid_masks, CASE WHEN total >= 100 AND valid_masks >= 80 THEN 'Strong' WHEN total >= 40 AND valid_masks >= 30 THEN 'Usable' WHEN total >= 15 AND valid_masks >= 10 THEN 'Limited' ELSE 'Insufficient' END AS tier,
    CASE WHEN total >= 15 AND valid_masks >= 10 THEN '' ELSE concat_ws(', ', CASE WHEN total < 15 THEN 'rows ' || total || ' < 15' END, CASE WHEN valid_masks < 10 THEN 'masks ' || valid_masks || ' < 10' END) END AS rationale FROM c""")
def feasibility_tiers(spark, folder):
    tiers = profile.feasibility(_conditional(spark, folder), TIERS)
    return tiers.orderBy("tier_rank", F.desc("total"), F.desc("valid_masks"), "source", "lang").select("source", "lang", "total", "valid_masks", "tier", "rationale")


@query(f"WITH {_DOCS}, c AS (SELECT lang, count_if(split = 'train') AS n FROM d WHERE lang IS NOT NULL GROUP BY lang) SELECT lang, n, round(CASE WHEN n = 0 THEN 0 ELSE greatest(0, least(10, sum(n) OVER () / (count(*) OVER () * n))) END, 6) AS weight FROM c")
def class_weights(spark, folder):
    return profile.class_weights(_documents(spark, folder), "lang", F.col("split") == "train").withColumns(rounded("weight"))


@query("""WITH e AS (SELECT min(l_extendedprice) AS lo, max(l_extendedprice) AS hi FROM lineitem)
    SELECT least(floor((l_extendedprice - lo) * 30 / (hi - lo)), 29)::INTEGER AS bin, count(*) AS n, min(l_extendedprice) AS least, max(l_extendedprice) AS most FROM lineitem, e GROUP BY 1""")
def histogram(spark, folder):
    return profile.histogram(table(spark, folder, "lineitem"), "l_extendedprice", 30)


@query("""WITH q AS (SELECT o_orderstatus AS s, quantile_cont(o_totalprice, 0.25) AS q1, median(o_totalprice) AS q2, quantile_cont(o_totalprice, 0.75) AS q3 FROM orders GROUP BY 1),
    i AS (SELECT o.*, q.*, o_totalprice BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1) AS inside FROM orders o JOIN q ON o_orderstatus = s)
    SELECT o_orderstatus, round(any_value(q1), 4) AS q1, round(any_value(q2), 4) AS q2, round(any_value(q3), 4) AS q3, min(CASE WHEN inside THEN o_totalprice END) AS low, max(CASE WHEN inside THEN o_totalprice END) AS high, count_if(NOT inside) AS outliers FROM i GROUP BY 1""")
def box_plot(spark, folder):
    return profile.box_plot(table(spark, folder, "orders"), "o_orderstatus", "o_totalprice").withColumns(rounded("q1", "q2", "q3", digits=4))


@query("SELECT 'counts' AS category, 'parts' AS name, count(*)::VARCHAR AS value FROM part UNION ALL SELECT 'counts', 'brands', count(DISTINCT p_brand)::VARCHAR FROM part UNION ALL SELECT 'sizes', 'largest', max(p_size)::VARCHAR FROM part")
def flat_metric_table(spark, folder):
    row = table(spark, folder, "part").agg(F.count("*").alias("parts"), F.count_distinct("p_brand").alias("brands"), F.max("p_size").alias("largest"))
    return profile.flat_metrics(row, {"counts": ["parts", "brands"], "sizes": ["largest"]})
