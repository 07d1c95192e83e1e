"""Metadata tables of any layout as records of one schema: synonyms of column names, defaults, parsed values, path lookup."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions import scalars as S

# Synonyms in order of preference, by normalised column name.
SYNONYMS = {
    "image": ("name", "image_path", "img_path", "image", "img", "image_name", "filename", "file_name", "filepath", "path"),
    "mask": ("label_file", "mask_path", "mask", "mask_name", "segmentation_path", "seg_path", "ground_truth", "gt_path", "label_path"),
    "id": ("sample_id", "image_id", "img_id", "id", "index", "sample"),
    "host": ("plant", "host", "species", "crop", "host_plant", "plant_species", "crop_type"),
    "disease": ("disease", "disease_case", "label", "category", "class", "diagnosis", "pathology", "disease_name"),
    "split": ("split", "partition", "dataset_split", "subset", "set", "fold"),
    "source": ("url", "source", "dataset", "origin", "database", "source_dataset"),
    "ratio": ("mask_ratio", "affected_ratio", "severity", "ratio", "affected_area_ratio", "mask_area_ratio"),
    "resolution": ("resolution", "dimensions", "size", "image_resolution"),
    "width": ("width", "image_width", "w"),
    "height": ("height", "image_height", "h"),
    "license": ("license", "licence"),
}
UNKNOWN, DEFAULT_SOURCE = "Unknown", "PlantSeg"

RECORD = T.StructType([
    *(T.StructField(n, T.StringType()) for n in ("sample_id", "image_path", "mask_path", "host", "disease", "split", "source", "license")),
    T.StructField("meta_mask_ratio", T.DoubleType()), T.StructField("meta_width", T.IntegerType()), T.StructField("meta_height", T.IntegerType()), T.StructField("original_index", T.LongType()),
])


def normalised(name: str) -> str:
    return re.sub(r"[ \-.]", "_", name.strip().lower())


def resolved(columns: list[str]) -> dict[str, str]:
    """The column that each role takes: the first synonym that is there. Of columns with one normalised name the last counts."""
    by_name = {normalised(c): c for c in columns}
    return {role: by_name[n] for role, names in SYNONYMS.items() if (n := next((x for x in names if x in by_name), None))}


def columns_like(columns: list[str], keywords: tuple[str, ...]) -> list[str]:
    """Columns whose lower-case name holds one of the keywords."""
    return [c for c in columns if any(k in c.lower() for k in keywords)]


def names_like(names: Column, words: tuple[str, ...]) -> Column:
    """Those of an array of names that hold one of the lower-case ``words``, whatever their case."""
    return F.filter(names, lambda n: F.lower(n).rlike("|".join(map(re.escape, words))))



def standardized(raw: DataFrame, ordinal: str, default_source: str = DEFAULT_SOURCE) -> DataFrame:
    """Records with paths as written; ``with_paths`` looks them up among files."""
    roles = resolved([c for c in raw.columns if c != ordinal])
    get = lambda role: F.col(f"`{roles[role]}`") if role in roles else F.lit(None).cast("string")
    text = lambda role: F.nullif(F.trim(get(role).cast("string")), F.lit(""))
    w, h = S.resolution(get("resolution").cast("string"))
    width, height = get("width").try_cast("int"), get("height").try_cast("int")
    parsed = (width.isNull() | height.isNull()) & w.isNotNull()
    return raw.select(
        S.sample_id(get("id"), text("image"), F.col(ordinal)).alias("sample_id"), text("image").alias("image_path"), text("mask").alias("mask_path"),
        S.filled(get("host"), UNKNOWN).alias("host"), S.filled(get("disease"), UNKNOWN).alias("disease"), S.split_normalised(get("split")).alias("split"),
        S.filled(get("source"), default_source).alias("source"), S.filled(get("license"), UNKNOWN).alias("license"), get("ratio").try_cast("double").alias("meta_mask_ratio"),
        F.when(parsed, w).otherwise(width).alias("meta_width"), F.when(parsed, h).otherwise(height).alias("meta_height"), F.col(ordinal).cast("long").alias("original_index"))


def with_paths(records: DataFrame, files: DataFrame, column: str, kind: str, root: str) -> DataFrame:
    """``column`` as a path among ``files`` (path, kind): by base name, else by existence below ``root``, else null.

    Of files with one base name the largest path counts, so the result doesn't depend on the scan's order.
    """
    named = files.where(F.col("kind") == kind).groupBy(S.base_name(F.col("path")).alias("__name")).agg(F.max("path").alias("__by_name"))
    below = files.select(F.col("path").alias("__path")).distinct()
    found = records.join(named, S.base_name(F.col(column)) == F.col("__name"), "left").join(below, F.concat(F.lit(root.rstrip("/") + "/"), F.col(column)) == F.col("__path"), "left")
    return found.withColumn(column, F.coalesce("__by_name", "__path")).drop("__name", "__by_name", "__path")


def from_layout(images: DataFrame, masks: DataFrame, root: str, ordinal: str, default_source: str = DEFAULT_SOURCE) -> DataFrame:
    """Records from folder names where there is no table: splits, ``Host___Disease`` and ``Host_rest`` folders, masks by stem.

    Later folders win, but ``Host_rest`` counts only while no host is known.
    """
    relative = F.substring(F.col("path"), F.lit(len(root.rstrip("/")) + 2), F.length("path"))
    parts = F.slice(F.split(relative, "/"), 1, F.size(F.split(relative, "/")) - 1)
    start = F.struct(F.lit(S.UNASSIGNED).alias("split"), F.lit(UNKNOWN).alias("host"), F.lit(UNKNOWN).alias("disease"))

    def step(state: Column, part: Column) -> Column:
        split, spaced = S.split_of_folder(part), lambda x: F.trim(F.replace(x, F.lit("_"), F.lit(" ")))
        triple, single = part.contains("___"), part.contains("_") & (state["host"] == UNKNOWN)
        at = F.instr(part, "___")
        rest = F.substring(part, F.instr(part, "_") + 1, F.length(part))
        host = F.when(split.isNotNull(), state["host"]).when(triple, spaced(F.substring(part, F.lit(1), at - 1))).when(single, S.capitalised(F.element_at(F.split(part, "_"), 1))).otherwise(state["host"])
        disease = F.when(split.isNotNull(), state["disease"]).when(triple, spaced(F.substring(part, at + 3, F.length(part)))).when(single, S.capitalised(F.replace(rest, F.lit("_"), F.lit(" ")))).otherwise(state["disease"])
        return F.struct(F.coalesce(split, state["split"]).alias("split"), host.alias("host"), disease.alias("disease"))

    stem = F.lower(S.stem(F.col("path")))
    keys = F.when(stem.rlike("_(mask|seg)$"), F.array(stem, F.regexp_replace(stem, "_[^_]*$", ""))).otherwise(F.array(stem))
    by_stem = masks.select("path", F.explode(keys).alias("key")).groupBy("key").agg(F.max("path").alias("mask"))
    one, two = (by_stem.select(F.col("key").alias(f"key_{k}"), F.col("mask").alias(f"mask_{k}")) for k in (1, 2))
    found = images.select(F.col(ordinal).cast("long").alias("original_index"), "path", stem.alias("stem"), F.aggregate(parts, start, step).alias("at"))
    found = found.join(one, F.col("stem") == F.col("key_1"), "left").join(two, F.replace("stem", F.lit("image"), F.lit("mask")) == F.col("key_2"), "left")
    return found.select(
        F.format_string("sample_%06d", F.col("original_index")).alias("sample_id"), F.col("path").alias("image_path"), F.coalesce("mask_1", "mask_2").alias("mask_path"), "at.host", "at.disease", "at.split",
        F.lit(default_source).alias("source"), F.lit(UNKNOWN).alias("license"), F.lit(None).cast("double").alias("meta_mask_ratio"), F.lit(None).cast("int").alias("meta_width"), F.lit(None).cast("int").alias("meta_height"), "original_index")
