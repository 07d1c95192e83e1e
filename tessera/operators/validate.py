"""Validation of images and masks: predicates on narrow facts, which are taken where the files are read."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Limits, flags, and texts of errors.
MOST_ASPECT, LEAST_SIDE, RATIO_TOLERANCE = 5.0, 32, 0.05
EXTREME_ASPECT, VERY_SMALL = "extreme_aspect_ratio", "very_small_resolution"
NO_PATH, NO_FILE, EMPTY_FILE, UNREADABLE = "Missing image path in record", "File does not exist: ", "Zero-byte file", "Image decoding error"
NO_MASK, EMPTY_MASK, UNREADABLE_MASK = "Mask file does not exist: ", "Zero-byte mask file", "Failed to decode mask array"
OTHER_SIZE = "Dimension mismatch: mask is %dx%d, image is %dx%d"


def unusual(width: Column, height: Column, most_aspect: float = MOST_ASPECT, least_side: int = LEAST_SIDE) -> Column:
    """Flag of an image's shape, null if it is usual; the aspect is checked first. A side of 0 has an infinite aspect."""
    w, h = width.cast("double"), height.cast("double")
    aspect = F.coalesce(F.greatest(F.try_divide(w, h), F.try_divide(h, w)), F.lit(float("inf")))
    aspect = F.when((w > 0) & (h > 0), aspect).otherwise(F.lit(float("inf")))
    return F.when(width.isNull() | height.isNull(), None).when(aspect > most_aspect, EXTREME_ASPECT).when(F.least(w, h) < least_side, VERY_SMALL)


def discrepancy_note(computed: Column, stated: Column, tolerance: float = RATIO_TOLERANCE) -> Column:
    d = F.abs(computed - stated)
    return F.when(~F.isnan(stated) & (d > tolerance), F.format_string("Calculated ratio (%.4f) differs from metadata (%.4f) by %.4f", computed, stated, d))


def has_issue(*notes: Column) -> Column:
    """Any note that isn't null or empty."""
    return F.coalesce(*(F.nullif(n, F.lit("")) for n in notes)).isNotNull()


def validated(records: DataFrame, facts: DataFrame, components: bool = True, tolerance: float = RATIO_TOLERANCE, limit: int | None = None) -> DataFrame:
    """Records with facts about image and mask.

    ``records``: F2 records. ``facts``: the narrow rows of ``sources.pixels.facts``; both files of a record are
    joined by path, and all rules are predicates on them. Codes tell missing, corrupt and
    mismatching files apart without reading error texts. Regions are 0 where ``components`` is off.
    """
    rows = records if limit is None else records.orderBy("original_index").limit(limit)
    names = ("path", "length", "width", "height", "channels", "convention", "affected", "components")
    side = lambda k: facts.select(*(F.col(c).alias(f"__{k}_{c}") for c in names))
    rows = rows.join(side("i"), F.col("image_path") == F.col("__i_path"), "left").join(side("m"), F.col("mask_path") == F.col("__m_path"), "left")
    text, whole, real, no = F.lit(None).cast("string"), F.lit(0).cast("long"), F.lit(0.0), F.lit(False)

    shown = F.col("__i_width").isNotNull()
    code = F.when(F.col("image_path").isNull(), "corrupt").when(F.col("__i_path").isNull(), "missing").when(~shown, "corrupt")
    error = F.when(F.col("image_path").isNull(), NO_PATH).when(F.col("__i_path").isNull(), F.concat(F.lit(NO_FILE), "image_path")).when(F.col("__i_length") == 0, EMPTY_FILE).when(~shown, UNREADABLE)
    rows = rows.withColumns({"image_code": code, "image_error": error, "is_valid_image": shown, "width": F.col("__i_width"), "height": F.col("__i_height"), "channels": F.col("__i_channels")})
    rows = rows.withColumn("unusual_image_flag", unusual(F.col("width"), F.col("height")))

    w, h, mw, mh = (F.col(c) for c in ("width", "height", "__m_width", "__m_height"))
    sizes = F.format_string(OTHER_SIZE, mw, mh, w, h)
    none = lambda name, code, error: (no, name, whole, real, F.lit(0), code, error)
    cases = [
        (F.col("mask_path").isNull(), none(text, text, text)), (F.col("__m_path").isNull(), none(text, F.lit("missing"), F.concat(F.lit(NO_MASK), "mask_path"))),
        (F.col("__m_length") == 0, none(text, F.lit("corrupt"), F.lit(EMPTY_MASK))), (mw.isNull(), none(text, F.lit("corrupt"), F.lit(UNREADABLE_MASK))),
        (shown & ((mw != w) | (mh != h)), none(F.lit("dimension_mismatch"), F.lit("dimensions"), sizes)),
    ]
    regions = F.col("__m_components") if components else F.lit(0)
    good = (F.lit(True), F.col("__m_convention"), F.col("__m_affected"), F.col("__m_affected") / (mw.cast("double") * mh), regions, text, text)
    for i, name in enumerate(("is_valid_mask", "mask_convention", "affected_pixels", "affected_area_ratio", "num_lesion_components", "mask_code", "mask_error")):
        value = F.when(cases[0][0], cases[0][1][i])
        for condition, values in cases[1:]:
            value = value.when(condition, values[i])
        rows = rows.withColumn(name, value.otherwise(good[i]))
    rows = rows.drop(*(f"__{k}_{c}" for k in "im" for c in names))
    return rows.withColumn("ratio_discrepancy_note", F.when(F.col("is_valid_mask"), discrepancy_note(F.col("affected_area_ratio"), F.col("meta_mask_ratio"), tolerance)))


def errors(rows: DataFrame) -> DataFrame:
    """Rows with an issue, and what it is."""
    notes = ("image_error", "mask_error", "unusual_image_flag", "ratio_discrepancy_note")
    return rows.where(has_issue(*(F.col(n) for n in notes))).select("sample_id", "image_path", "mask_path", *notes)


def counters(rows: DataFrame) -> DataFrame:
    """One row of counts, by codes: missing and corrupt images and masks, mismatches, empty masks, discrepancies."""
    image, mask = F.col("image_code"), F.col("mask_code")
    has_mask, good = F.col("mask_path").isNotNull(), F.col("mask_path").isNotNull() & F.col("mask_code").isNull()
    return rows.agg(
        F.count("*").alias("total_records"), F.count_if(image.isNull()).alias("valid_images"), F.count_if(image == "missing").alias("missing_images"), F.count_if(image == "corrupt").alias("corrupt_images"),
        F.count_if(image.isNull() & F.col("unusual_image_flag").isNotNull()).alias("unusual_images"), F.count_if(has_mask).alias("total_masks"), F.count_if(good).alias("valid_masks"), F.count_if(has_mask & (mask == "missing")).alias("missing_masks"),
        F.count_if(has_mask & (mask == "dimensions")).alias("dim_mismatch_masks"), F.count_if(has_mask & (mask == "corrupt")).alias("corrupt_masks"), F.count_if(good & (F.col("affected_pixels") == 0)).alias("empty_masks"),
        F.count_if(good & F.col("ratio_discrepancy_note").isNotNull()).alias("ratio_discrepancies"))
