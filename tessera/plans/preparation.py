"""Queries of discovery, readers, lookups, manifests and sinks, on driver tables as files and records.

Readers and sinks are queried as round trips: a table is written in the format to the shared
folder, read back by the reader, and held against the table itself.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import scalars as S
from tessera.operators import duplicates, splits, standardize, validate
from tessera.plans import flows
from tessera.plans.registry import query
from tessera.sources import discovery, sinks
from tessera.tables import fresh_path, table


def _chosen(by, *values) -> Column:
    """The value at the place ``by``; places count from 0."""
    return F.element_at(F.array(*(F.lit(v) for v in values)), (by + 1).cast("int"))


# ---- predicates ----


@query("""WITH f AS (SELECT doc_id, ['train', 'Training', 'VAL', 'valid', 'validation', 'test', 'TESTING', 'trainer', 'holdout'][doc_id % 9 + 1] AS folder FROM documents)
    SELECT doc_id, CASE WHEN lower(folder) IN ('train', 'training') THEN 'train' WHEN lower(folder) IN ('val', 'valid', 'validation') THEN 'val' WHEN lower(folder) IN ('test', 'testing') THEN 'test' END AS split FROM f""")
def folder_splits(spark, folder):
    names = ("train", "Training", "VAL", "valid", "validation", "test", "TESTING", "trainer", "holdout")
    return table(spark, folder, "documents").select("doc_id", S.split_of_folder(_chosen(F.col("doc_id") % 9, *names)).alias("split"))


@query("""WITH d AS (SELECT doc_id, ['Healthy leaf', ' NORMAL', 'abnormal', 'rust', NULL][doc_id % 5 + 1] AS disease, n_chars % 3 AS affected, CASE WHEN doc_id % 11 <> 0 THEN doc_id % 7 = 0 END AS flag FROM documents)
    SELECT doc_id, lower(disease) LIKE '%healthy%' OR lower(disease) LIKE '%normal%' AS by_name, lower(disease) LIKE '%healthy%' OR affected = 0 AS by_record, coalesce(flag, false) OR affected = 0 AS by_sample FROM d""")
def healthy_rules(spark, folder):
    """The three rules for healthy records: by name, by name or mask, by flag or mask."""
    disease, affected = _chosen(F.col("doc_id") % 5, "Healthy leaf", " NORMAL", "abnormal", "rust", None), F.col("n_chars") % 3
    flag = F.when(F.col("doc_id") % 11 != 0, F.col("doc_id") % 7 == 0)
    rules = {"by_name": S.looks_healthy(disease), "by_record": S.healthy_record(disease, affected), "by_sample": S.healthy_sample(flag, affected)}
    return table(spark, folder, "documents").select("doc_id", *(c.alias(n) for n, c in rules.items()))


@query("""SELECT doc_id, array_to_string(list_filter(string_split(string_split(text, chr(10))[1], ' '), lambda w: contains(lower(w), 'an') OR contains(lower(w), 'er') OR contains(lower(w), 'ion')), ' ') AS names FROM documents""")
def keyword_columns(spark, folder):
    """Names in a header that hold a keyword; the header is a text's first line."""
    header = F.split(F.get(F.split("text", "\n"), F.lit(0)), " ")
    return table(spark, folder, "documents").select("doc_id", F.array_join(standardize.names_like(header, ("an", "er", "ion")), " ").alias("names"))


@query("""WITH e AS (SELECT event_id, ['', 'Zero-byte file', NULL][event_id % 3 + 1] AS image_error, CASE WHEN event_id % 4 = 0 THEN '' END AS mask_error, CASE WHEN event_id % 5 = 0 THEN 'extreme_aspect_ratio' END AS unusual_image_flag, CASE WHEN event_id % 8 = 0 THEN 'note' END AS ratio_discrepancy_note FROM events)
    SELECT event_id AS sample_id, 'i' || event_id AS image_path, 'm' AS mask_path, image_error, mask_error, unusual_image_flag, ratio_discrepancy_note FROM e
    WHERE coalesce(nullif(image_error, ''), nullif(mask_error, ''), nullif(unusual_image_flag, ''), nullif(ratio_discrepancy_note, '')) IS NOT NULL""")
def validation_errors(spark, folder):
    """Records with an issue; an empty note is none."""
    e = F.col("event_id")
    return validate.errors(table(spark, folder, "events").select(
        e.alias("sample_id"), F.concat(F.lit("i"), e).alias("image_path"), F.lit("m").alias("mask_path"), _chosen(e % 3, "", "Zero-byte file", None).alias("image_error"),
        F.when(e % 4 == 0, "").alias("mask_error"), F.when(e % 5 == 0, validate.EXTREME_ASPECT).alias("unusual_image_flag"), F.when(e % 8 == 0, "note").alias("ratio_discrepancy_note")))


@query("""WITH e AS (SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber % 3 = 0 THEN 'exact' ELSE 'near' END AS kind, (l_quantity::BIGINT % 10)::DOUBLE AS metric_value, CASE WHEN l_linenumber % 3 <> 0 THEN round(l_discount::DOUBLE * 10, 4) END AS ssim FROM lineitem)
    SELECT l_orderkey, l_linenumber, kind FROM e WHERE kind = 'exact' OR (metric_value <= 6 AND ssim >= 0.5)""")
def confirmed_pairs(spark, folder):
    """Exact pairs, and near ones within the distance that are similar enough."""
    near = F.col("l_linenumber") % 3 != 0
    edges = table(spark, folder, "lineitem").select(
        "l_orderkey", "l_linenumber", F.when(near, duplicates.NEAR).otherwise(duplicates.EXACT).alias("duplicate_type"), (F.col("l_quantity").cast("long") % 10).cast("double").alias("metric_value"),
        F.when(near, F.round(F.col("l_discount").cast("double") * 10, 4)).alias("ssim"))
    return duplicates.confirmed(edges, 6, 0.5).select("l_orderkey", "l_linenumber", F.when(F.col("duplicate_type") == duplicates.EXACT, "exact").otherwise("near").alias("kind"))


# ---- files, lookups and layouts ----

_FILE_NAMES = ("README.md", "meta.CSV", "coco_instances.json", "info.json", "split_1.txt", "images/a.JPG", "masks/a.png", "x/a_seg.png", "notes.txt", "labels/a.tif", "maskless/b.webp", "x/license.png")


@query(f"""WITH p AS (SELECT page_id, lower('v' || page_id || '/' || {list(_FILE_NAMES)}[page_id % {len(_FILE_NAMES)} + 1]) AS path FROM pages), n AS (SELECT *, regexp_extract(path, '[^/]*$') AS name FROM p)
    SELECT page_id, CASE WHEN regexp_matches(name, 'readme|license|citation') THEN 'doc' WHEN regexp_matches(name, '\\.(csv|tsv)$') THEN 'metadata'
        WHEN name LIKE '%.json' THEN CASE WHEN regexp_matches(name, 'annotation|coco') THEN 'annotation' ELSE 'metadata' END WHEN name LIKE '%split%' AND name LIKE '%.txt' THEN 'metadata'
        WHEN regexp_matches(name, '\\.(jpg|jpeg|png|bmp|tif|tiff|webp)$') THEN CASE WHEN regexp_matches(path, '(^|/)(masks?|annotations?|labels?|ground_truth|gt|segmentations?)/') OR regexp_matches(name, 'mask|_seg') THEN 'mask' ELSE 'image' END END AS kind FROM n""")
def file_classes(spark, folder):
    path = F.concat(F.lit("root/v"), F.col("page_id"), F.lit("/"), _chosen(F.col("page_id") % len(_FILE_NAMES), *_FILE_NAMES))
    return table(spark, folder, "pages").select("page_id", discovery.file_class(path, "root").alias("kind"))


@query("""WITH f AS (SELECT 'r/meta_' || page_id || '.csv' AS path, strlen(html) AS length, 0 AS rank FROM pages UNION ALL SELECT 'r/t' || page_id || '.tsv', strlen(url), 1 FROM pages UNION ALL SELECT 'r/labels' || page_id || '.json', strlen(html), 2 FROM pages)
    SELECT row_number() OVER (ORDER BY rank, coalesce(length, -1) DESC, path) - 1 AS place, path FROM f""")
def metadata_order(spark, folder):
    """The order in which metadata files are tried; the files are named after pages, and as long as these."""
    pages, files = table(spark, folder, "pages"), None
    for head, tail, of in (("r/meta_", ".csv", "html"), ("r/t", ".tsv", "url"), ("r/labels", ".json", "html")):
        part = pages.select(F.concat(F.lit(head), "page_id", F.lit(tail)).alias("path"), F.coalesce(F.octet_length(of), F.lit(-1)).alias("length"), F.lit("metadata").alias("kind"))
        files = part if files is None else files.unionByName(part)
    return discovery.metadata_places(files)


@query("""WITH f AS (SELECT 'root/a/p' || page_id || '.jpg' AS path, 'image' AS kind FROM pages WHERE page_id % 3 = 0 UNION ALL SELECT 'root/b/p' || page_id || '.jpg', 'image' FROM pages WHERE page_id % 6 = 0 UNION ALL SELECT 'root/sub/q' || page_id || '.jpg', 'mask' FROM pages WHERE page_id % 3 = 1),
    r AS (SELECT page_id, ['old/p' || page_id || '.jpg', 'sub/q' || page_id || '.jpg', NULL][page_id % 3 + 1] AS written FROM pages),
    n AS (SELECT regexp_extract(path, '[^/]*$') AS name, max(path) AS path FROM f WHERE kind = 'image' GROUP BY ALL)
    SELECT page_id, coalesce((SELECT n.path FROM n WHERE n.name = regexp_extract(r.written, '[^/]*$')), (SELECT max(f.path) FROM f WHERE f.path = 'root/' || r.written)) AS image_path FROM r""")
def path_lookup(spark, folder):
    """Paths of records among files: by base name, the largest of several, or by existence below the root."""
    key, pages = F.col("page_id"), table(spark, folder, "pages").select("page_id")
    named = lambda head: F.concat(F.lit(head), key, F.lit(".jpg"))
    files = None
    for head, kind, of, left in (("root/a/p", "image", 3, 0), ("root/b/p", "image", 6, 0), ("root/sub/q", "mask", 3, 1)):
        part = pages.where(key % of == left).select(named(head).alias("path"), F.lit(kind).alias("kind"))
        files = part if files is None else files.unionByName(part)
    records = pages.select("page_id", F.when(key % 3 == 0, named("old/p")).when(key % 3 == 1, named("sub/q")).alias("image_path"))
    return standardize.with_paths(records, files, "image_path", "image", "root")


@query("""SELECT printf('sample_%06d', doc_id) AS sample_id, 'root/' || ['Training/Apple___black_rot/image_', 'val/TOMATO_leaf_mold/b', 'other/c', 'Grape_x/Testing/d'][doc_id % 4 + 1] || doc_id || '.jpg' AS image_path,
    CASE WHEN doc_id % 8 = 0 THEN 'root/masks/mask_' || doc_id || '.png' WHEN doc_id % 4 = 1 THEN 'root/masks/b' || doc_id || '_seg.png' END AS mask_path,
    ['Apple', 'Tomato', 'Unknown', 'Grape'][doc_id % 4 + 1] AS host, ['black rot', 'Leaf mold', 'Unknown', 'X'][doc_id % 4 + 1] AS disease, ['train', 'val', 'unassigned', 'test'][doc_id % 4 + 1] AS split, doc_id AS original_index FROM documents""")
def layout_records(spark, folder):
    """Records from the names of folders, with masks by stem."""
    key, docs = F.col("doc_id"), table(spark, folder, "documents").select("doc_id")
    heads = ("root/Training/Apple___black_rot/image_", "root/val/TOMATO_leaf_mold/b", "root/other/c", "root/Grape_x/Testing/d")
    images = docs.select("doc_id", F.concat(_chosen(key % 4, *heads), key, F.lit(".jpg")).alias("path"))
    masks = docs.where((key % 8 == 0) | (key % 4 == 1)).select(F.when(key % 8 == 0, F.concat(F.lit("root/masks/mask_"), key, F.lit(".png"))).otherwise(F.concat(F.lit("root/masks/b"), key, F.lit("_seg.png"))).alias("path"))
    found = standardize.from_layout(images, masks, "root", "doc_id")
    return found.select("sample_id", "image_path", "mask_path", "host", "disease", "split", "original_index")


# ---- manifests ----


@query("""SELECT o_orderkey, coalesce(s.split, 'train') AS benchmark_split, CASE WHEN o_totalprice < 50000 THEN 'healthy_control' ELSE o_orderstatus || '___' || 'n' || (o_custkey % 7) END AS stratum
    FROM orders LEFT JOIN (SELECT c_custkey, CASE WHEN c_nationkey % 2 = 0 THEN 'val' ELSE 'test' END AS split FROM customer WHERE c_custkey % 10 <> 0) s ON o_custkey = c_custkey""")
def split_assignment(spark, folder):
    """Records with the split of their group and their stratum."""
    chosen = table(spark, folder, "customer").where("c_custkey % 10 <> 0").select(F.col("c_custkey").alias("o_custkey"), F.when(F.col("c_nationkey") % 2 == 0, "val").otherwise("test").alias("benchmark_split"))
    rows = splits.assigned(table(spark, folder, "orders"), chosen, "o_custkey")
    return rows.select("o_orderkey", "benchmark_split", splits.stratum(F.col("o_orderstatus"), F.concat(F.lit("n"), F.col("o_custkey") % 7), F.col("o_totalprice") < 50000).alias("stratum"))


@query("""SELECT event_type, a AS train, b AS val, n - a - b AS test FROM (SELECT event_type, count(*) AS n, round_even(count(*) * 0.7::DOUBLE, 0)::BIGINT AS a, round_even(count(*) * 0.15::DOUBLE, 0)::BIGINT AS b FROM events GROUP BY event_type)""")
def split_targets(spark, folder):
    """Rows wanted of each split, for each type of event."""
    counted = table(spark, folder, "events").groupBy("event_type").agg(F.count("*").alias("n"))
    return counted.select("event_type", *(c.alias(k) for k, c in splits.targets_of(F.col("n"), 0.7, 0.15).items()))


_MANIFEST = """m AS (SELECT p_partkey AS image_id, 'images/' || p_partkey || '.jpg' AS image_relpath, 'annotations/' || p_partkey || '.png' AS mask_relpath, p_brand AS host, p_type AS disease, CASE WHEN p_size % 7 = 0 THEN p_brand || ' healthy' ELSE 'Class ' || (p_partkey % 10) END AS display_class,
    'train' AS original_split, CASE WHEN p_partkey % 5 = 0 THEN 'test' ELSE 'train' END AS benchmark_split, p_partkey % 50 AS duplicate_group_id, p_size / 50.0::DOUBLE AS mask_area_ratio, p_size % 7 = 0 AS is_healthy FROM part)"""


def _manifest(spark, folder) -> DataFrame:
    key, healthy = F.col("p_partkey"), F.col("p_size") % 7 == 0
    return table(spark, folder, "part").select(
        key.alias("image_id"), F.concat(F.lit("/data/images/"), key, F.lit(".jpg")).alias("image_path"), F.concat(F.lit("C:\\data\\annotations\\"), key, F.lit(".png")).alias("mask_path"), F.col("p_brand").alias("host"), F.col("p_type").alias("disease"),
        F.when(healthy, F.concat("p_brand", F.lit(" healthy"))).otherwise(F.concat(F.lit("Class "), key % 10)).alias("display_class"), F.lit("train").alias("original_split"), F.when(key % 5 == 0, "test").otherwise("train").alias("benchmark_split"),
        (key % 50).alias("duplicate_group_id"), (F.col("p_size") / F.lit(50.0)).alias("mask_area_ratio"), healthy.alias("is_healthy"))


@query(f"WITH {_MANIFEST} SELECT * EXCLUDE (is_healthy), dense_rank() OVER (ORDER BY display_class) - 1 AS class_index FROM m WHERE NOT is_healthy")
def classification_records(spark, folder):
    return flows.classification_manifest(_manifest(spark, folder))[0]


@query(f"WITH {_MANIFEST} SELECT * FROM m WHERE mask_area_ratio BETWEEN 0 AND 1")
def severity_records(spark, folder):
    return flows.severity_manifest(_manifest(spark, folder))


# ---- readers and sinks, as round trips ----


@query("SELECT c_custkey, c_name, c_acctbal, 'a;\"' || c_mktsegment || E'\\n' AS note FROM customer")
def csv_metadata(spark, folder):
    """A table with semicolons, and with quoted separators, quotes and line ends in its cells."""
    path = fresh_path(spark, "customers") + ".csv"
    rows = table(spark, folder, "customer").select("c_custkey", "c_name", "c_acctbal", F.concat(F.lit('a;"'), "c_mktsegment", F.lit("\n")).alias("note"))
    rows.write.csv(path, header=True, sep=";", escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
    return discovery.read_metadata(spark, path).select(F.col("c_custkey").cast("long").alias("c_custkey"), "c_name", F.col("c_acctbal").cast("double").alias("c_acctbal"), "note")


def _as_json(spark, folder, lists: dict[str, DataFrame]) -> str:
    """One JSON object of lists; the tables are nation and region, which don't grow."""
    one = None
    for name, rows in lists.items():
        part = rows.agg(F.collect_list(F.struct(*rows.columns)).alias(name))
        one = part if one is None else one.crossJoin(part)
    path = fresh_path(spark, "lists") + ".json"
    one.select(F.to_json(F.struct("*")).alias("value")).coalesce(1).write.text(path)
    return path


@query("SELECT n_nationkey, n_name, n_regionkey::BIGINT AS n_regionkey FROM nation")
def json_metadata(spark, folder):
    """The first known list of a JSON object, as rows."""
    path = _as_json(spark, folder, {"samples": table(spark, folder, "nation").select("n_nationkey", "n_name", "n_regionkey"), "others": table(spark, folder, "region").select("r_name")})
    return discovery.read_metadata(spark, path).select("n_nationkey", "n_name", "n_regionkey")


@query("SELECT r_regionkey::BIGINT AS category_id, r_name AS name, (SELECT count(*) FROM nation WHERE n_regionkey = r_regionkey AND n_regionkey <> 2) AS annotations FROM region")
def coco_category_counts(spark, folder):
    categories = table(spark, folder, "region").select(F.col("r_regionkey").alias("id"), F.col("r_name").alias("name"))
    annotations = table(spark, folder, "nation").where("n_regionkey <> 2").select(F.col("n_nationkey").alias("id"), F.col("n_regionkey").alias("category_id"))
    return discovery.coco_categories(spark, _as_json(spark, folder, {"categories": categories, "annotations": annotations}))


@query("SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders")
def manifest_rows(spark, folder):
    """A CSV manifest read by an explicit schema that has fewer columns than the file."""
    path = fresh_path(spark, "manifest")
    sinks.write_report({"orders": table(spark, folder, "orders").select("o_orderstatus", "o_custkey", "o_orderkey", "o_totalprice")}, path, "csv")
    return discovery.read_manifest(spark, f"{path}/orders", "o_orderkey bigint, o_orderstatus string, o_totalprice double")


@query("""SELECT 'e' || event_id AS image, CASE WHEN bad THEN 'error' ELSE 'ok' END AS status, CASE WHEN bad THEN 'failed, "so"' END AS error, CASE WHEN NOT bad THEN event_type END AS predicted_class,
    CASE WHEN NOT bad THEN value END AS confidence, CASE WHEN NOT bad THEN 'second' END AS top2_class, CASE WHEN NOT bad THEN value / 2 END AS top2_confidence, CASE WHEN NOT bad THEN value - value / 2 END AS confidence_margin,
    CASE WHEN NOT bad THEN value / 8 END AS normalized_entropy, CASE WHEN NOT bad THEN value / 4 END AS lesion_burden, CASE WHEN NOT bad THEN value * 25 END AS burden_percent, CASE WHEN NOT bad THEN event_id % 3 END AS warning_count
    FROM (SELECT event_id, event_type, CAST(value AS DOUBLE) AS value, event_id % 10 = 0 AS bad FROM events)""")
def batch_predictions_csv(spark, folder):
    """The twelve columns of a batch's predictions, written and read back; failed rows have a message alone."""
    e, good, value = F.col("event_id"), F.col("event_id") % 10 != 0, F.col("value").cast("double")
    numbers = {"confidence": value, "top2_confidence": value / 2, "confidence_margin": value - value / 2, "normalized_entropy": value / 8, "lesion_burden": value / 4, "burden_percent": value * 25}
    given = {"image": F.concat(F.lit("e"), e), "status": F.when(good, "ok").otherwise("error"), "error": F.when(~good, 'failed, "so"')}
    given |= {n: F.when(good, c) for n, c in {"predicted_class": F.col("event_type"), "top2_class": F.lit("second"), "warning_count": e % 3, **numbers}.items()}
    rows = table(spark, folder, "events").select(*(given[n].alias(n) for n in sinks.PREDICTION_COLUMNS))
    read = spark.read.csv(sinks.write_batch_predictions(rows, fresh_path(spark, "batch")), header=True)
    kinds = {"warning_count": "long"} | dict.fromkeys(numbers, "double")
    return read.select(*(F.col(n).cast(kinds.get(n, "string")).alias(n) for n in sinks.PREDICTION_COLUMNS))


@query("""SELECT '{' || string_agg('"' || event_type || '":' || i, ',' ORDER BY i) || '}' AS value FROM (SELECT event_type, row_number() OVER (ORDER BY event_type) - 1 AS i FROM (SELECT DISTINCT event_type FROM events WHERE event_type IS NOT NULL))""")
def class_map_file(spark, folder):
    return spark.read.text(sinks.write_class_map(table(spark, folder, "events"), "event_type", fresh_path(spark, "classes")))


@query("""SELECT '{"documents":' || count(*) || ',"sources":' || count(DISTINCT source) || ',"version":null}' AS value FROM documents""")
def summary_file(spark, folder):
    """A summary of one row as a JSON object that keeps its nulls."""
    summary = table(spark, folder, "documents").agg(F.count("*").alias("documents"), F.countDistinct("source").alias("sources")).withColumn("version", F.lit(None).cast("string"))
    return spark.read.text(sinks.write_summary(summary, fresh_path(spark, "summary"), "summary.json"))
