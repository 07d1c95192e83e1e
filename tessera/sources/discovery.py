"""Finding and reading a dataset: file scan and classes, metadata tables of several formats, ranking, and records."""

from __future__ import annotations

import json
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.scalars import base_name
from tessera.operators import standardize
from tessera.operators.selection import numbered

# Fixed values.
IMAGE_SUFFIXES = (".jpg", ".jpeg", ".png", ".bmp", ".webp", ".tif", ".tiff")
MASK_FOLDERS = ("mask", "masks", "annotation", "annotations", "label", "labels", "ground_truth", "gt", "segmentation", "segmentations")
DOC_NAMES = ("readme", "license", "citation")
METADATA_NAMES = ("meta", "dataset", "labels", "plantseg")
JSON_LISTS = ("images", "annotations", "samples", "data", "records")
MISSING, BY_METADATA, BY_LAYOUT, EMPTY = "missing_directory", "metadata_driven", "directory_hierarchy", "empty_or_unrecognized"


def file_class(path: Column, root: str) -> Column:
    """doc, metadata, annotation, mask, image, or null for other files; the first rule that holds decides."""
    relative = F.lower(F.substring(path, F.lit(len(root.rstrip("/")) + 2), F.length(path)))
    name = F.lower(base_name(path))
    suffix = F.regexp_extract(name, r"(?<=.)(\.[^.]*)$", 1)
    folders = F.slice(F.split(relative, "/"), 1, F.size(F.split(relative, "/")) - 1)
    any_of = lambda words: F.lit(False) if not words else name.rlike("|".join(words))
    is_mask = F.arrays_overlap(folders, F.array(*(F.lit(x) for x in MASK_FOLDERS))) | any_of(("mask", "_seg"))
    return (
        F.when(any_of(DOC_NAMES), "doc").when(suffix.isin(".csv", ".tsv"), "metadata").when(suffix == ".json", F.when(any_of(("annotation", "coco")), "annotation").otherwise("metadata"))
        .when(name.contains("split") & (suffix == ".txt"), "metadata").when(suffix.isin(*IMAGE_SUFFIXES), F.when(is_mask, "mask").otherwise("image"))
    )


def files(spark: SparkSession, root: str) -> DataFrame:
    """path, length and kind of every file below ``root``; contents are never read here."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select("path", "length")
    at = qualified(spark, root)
    return found.select("path", "length", file_class(F.col("path"), at).alias("kind"))


def qualified(spark: SparkSession, root: str) -> str:
    """``root`` as the scan writes it into paths."""
    p = spark._jvm.org.apache.hadoop.fs.Path(root)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(p).toString().rstrip("/")


def exists(spark: SparkSession, root: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(root)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def metadata_places(found: DataFrame) -> DataFrame:
    """(place, path) of metadata files in the order in which they are tried: tables with a telling name, other tables, the rest; larger first."""
    name = F.lower(base_name(F.col("path")))
    tabular = name.rlike(r"\.(csv|tsv)$")
    rank = F.when(tabular & name.rlike("|".join(METADATA_NAMES)), 0).when(tabular, 1).otherwise(2)
    rows = found.where("kind = 'metadata'").select("path", "length", rank.alias("rank"))
    return numbered(rows, [F.col("rank").asc(), F.col("length").desc(), F.col("path").asc()], "place").select("place", "path")


def ranked_metadata(found: DataFrame) -> list[str]:
    """Metadata files in the order of ``metadata_places``. The list goes to the driver: it has a row for each metadata file, not for each record."""
    return [r["path"] for r in metadata_places(found).orderBy("place").collect()]


def read_metadata(spark: SparkSession, path: str) -> DataFrame | None:
    """A CSV, TSV, text or JSON file as a table of strings (JSON: as inferred) with column ``__ordinal``; None if it isn't one.

    CSV is split at commas, or at what its first line shows if it has no comma.
    """
    lower = path.lower()
    try:
        if lower.endswith(".json"):
            raw = read_json(spark, path)
        else:
            first = next((r[0] for r in spark.read.text(path).limit(1).collect()), "")
            raw = spark.read.csv(path, header=True, sep=separator(first, lower.endswith(".tsv")), multiLine=True, escape='"')
        if raw is None or not raw.columns:
            return None
    except Exception as e:  # noqa: BLE001  (a file that is no table is skipped, as the caller tries the next one)
        spark.sparkContext._jvm.org.apache.logging.log4j.LogManager.getLogger("tessera").warn(f"{path} is no table: {e}")
        return None
    return raw.withColumn("__ordinal", F.monotonically_increasing_id())


def separator(line: str, tabs: bool) -> str:
    if tabs:
        return "\t"
    return "," if "," in line else max(";\t|", key=line.count) if any(c in line for c in ";\t|") else ","


def read_json(spark: SparkSession, path: str) -> DataFrame | None:
    """Rows of a JSON file: a list's elements, the first known list of an object, or the object itself."""
    raw = spark.read.option("multiLine", "true").json(path)
    if "_corrupt_record" in raw.columns:
        return None
    for name in JSON_LISTS:
        kind = next((f.dataType for f in raw.schema.fields if f.name == name), None)
        if kind is not None and kind.typeName() == "array" and kind.elementType.typeName() == "struct":
            return raw.select(F.inline(name))
    return raw


def coco_categories(spark: SparkSession, path: str) -> DataFrame:
    """Categories of an annotation file with the number of annotations of each."""
    raw = spark.read.option("multiLine", "true").json(path)
    named = raw.select(F.inline("categories")).select(F.col("id").alias("category_id"), F.col("name"))
    used = raw.select(F.inline("annotations")).groupBy("category_id").agg(F.count("*").alias("annotations"))
    return named.join(used, "category_id", "left").select("category_id", "name", F.coalesce("annotations", F.lit(0)).alias("annotations"))


@dataclass
class Discovery:
    """Records with how they were found; ``counts`` by file class."""

    root: str
    structure: str
    records: DataFrame
    metadata: list[str] = field(default_factory=list)
    counts: dict[str, int] = field(default_factory=dict)


def discover(spark: SparkSession, root: str) -> Discovery:
    """Records of the first metadata file that is a table with rows, else of the folders' names."""
    empty = spark.createDataFrame([], standardize.RECORD)
    if not exists(spark, root):
        return Discovery(root, MISSING, empty)
    found = files(spark, root).where("kind IS NOT NULL")
    counts = {r["kind"]: r["n"] for r in found.groupBy("kind").agg(F.count("*").alias("n")).collect()}
    at, ranked = qualified(spark, root), ranked_metadata(found)
    for path in ranked:
        raw = read_metadata(spark, path)
        if raw is not None and not raw.isEmpty() and {"image", "id"} & set(standardize.resolved([c for c in raw.columns if c != "__ordinal"])):
            records = standardize.standardized(raw, "__ordinal")
            for column, kind in (("image_path", "image"), ("mask_path", "mask")):
                records = standardize.with_paths(records, found.select("path", "kind"), column, kind, at)
            return Discovery(root, BY_METADATA, records.select(standardize.RECORD.names), ranked, counts)
    if counts.get("image"):
        images = numbered(found.where("kind = 'image'").select("path"), [F.col("path").asc()], "__ordinal")
        return Discovery(root, BY_LAYOUT, standardize.from_layout(images, found.where("kind = 'mask'").select("path"), at, "__ordinal").select(standardize.RECORD.names), ranked, counts)
    return Discovery(root, EMPTY, empty, ranked, counts)


def flat_images(spark: SparkSession, folder: str, suffixes: tuple[str, ...] = (".jpg", ".jpeg", ".png", ".bmp")) -> DataFrame:
    """Images of one folder, not of folders below it, by name."""
    found = spark.read.format("binaryFile").load(folder).select("path", "length")
    return found.where(F.lower("path").rlike("(" + "|".join(s.replace(".", r"\.") for s in suffixes) + ")$")).orderBy("path")


def read_manifest(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A CSV manifest by an explicit schema; raises where the header lacks a column of it."""
    wanted = [c.strip().split()[0] for c in schema.split(",")]
    header = spark.read.csv(path, header=True).columns
    if missing := [c for c in wanted if c not in header]:
        raise ValueError(f"{path} lacks columns: {', '.join(missing)}")
    raw = spark.read.csv(path, header=True)
    kinds = dict(c.strip().split() for c in schema.split(","))
    return raw.select(*(F.col(c).try_cast(kinds[c]).alias(c) for c in wanted))


def setting(given: object, config: dict, key: str, default: object) -> object:
    """A given value, else the configured one, else the default."""
    return given if given is not None else config.get(key, default) if config.get(key) is not None else default


def read_config(path: str) -> dict:
    """A small configuration file of the driver, JSON or YAML (YAML where its reader is installed)."""
    with open(path, encoding="utf-8") as f:
        text = f.read()
    if path.endswith(".json"):
        return json.loads(text)
    import yaml

    return yaml.safe_load(text) or {}
