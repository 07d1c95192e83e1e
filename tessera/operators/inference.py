"""Results of a classifier and a segmenter as rows: top classes, certainty, burden, warnings, and nested JSON."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import scalars as S
from tessera.operators import scoring
from tessera.operators.quantiles import Quantile, median, summary

# Fixed value: pixels of the grid on which masks are measured.
GRID = (512, 512)


def results(rows: DataFrame, probabilities: str, lesion_pixels: str, classes: list[str], threshold: float | None = None, total_pixels: int = GRID[0] * GRID[1]) -> DataFrame:
    """``rows`` with predicted class, confidence, second class, margin, normalised entropy, burden and warnings.

    Rows without probabilities are errors: their results are null and their status says so.
    """
    top = S.top_k(F.col(probabilities), 2)
    names = F.array(*(F.lit(c) for c in classes))
    first, second = F.get("__top", F.lit(0)), F.get("__top", F.lit(1))
    burden = F.col(lesion_pixels).cast("double") / F.lit(float(total_pixels))
    good = F.col(probabilities).isNotNull()
    found = rows.withColumn("__top", top).withColumns({
        "status": F.when(good, "ok").otherwise("error"), "predicted_class": F.get(names, first["index"]), "class_index": first["index"], "confidence": first["value"], "top2_class": F.get(names, second["index"]), "top2_confidence": second["value"],
        "confidence_margin": first["value"] - second["value"], "normalized_entropy": F.when(good, S.normalised_entropy(F.col(probabilities))), "lesion_burden": F.when(good, burden), "burden_percent": F.when(good, F.round(burden * 100, 4)),
    })
    return found.withColumn("warnings", F.when(good, scoring.warnings(F.col("confidence"), threshold))).withColumn("warning_count", F.when(good, F.size("warnings"))).drop("__top")


def nested(image: str, total_pixels: int = GRID[0] * GRID[1], threshold: float = 0.5, regression: Column | None = None, classes: list[str] | None = None) -> Column:
    """JSON of a row of results(): the parts of a published result, with direct regression only where there is one."""
    entry = lambda name, index, value: F.struct(F.col(name).alias("class_name"), index.alias("class_index"), F.col(value).alias("confidence"))
    second = F.array_position(F.array(*(F.lit(c) for c in classes or [])), F.col("top2_class")).cast("int") - 1 if classes else F.lit(None).cast("int")
    parts = {
        "image": F.struct(F.col(image).alias("path")),
        "classification": F.struct("predicted_class", "class_index", "confidence", F.array(entry("predicted_class", F.col("class_index"), "confidence"), entry("top2_class", second, "top2_confidence")).alias("top2"), F.col("confidence_margin").alias("top1_top2_margin"), "normalized_entropy"),
        "segmentation": F.struct(F.lit(threshold).alias("threshold"), F.round(F.col("lesion_burden") * total_pixels).cast("long").alias("lesion_pixels"), F.lit(total_pixels).alias("total_pixels"), F.col("lesion_burden").alias("image_relative_lesion_burden"), "burden_percent", F.array(*(F.lit(x) for x in GRID)).alias("measurement_grid")),
        "system": F.struct(F.lit(False).alias("healthy_detection_supported"), F.lit(None).cast("boolean").alias("input_within_supported_scope"), F.array(*(F.lit(c) for c in classes or [])).alias("supported_classes"), "warnings"),
    }
    direct = F.when(regression.isNotNull(), F.struct(regression.alias("direct_regression_burden"), F.col("lesion_burden").alias("segmentation_burden"), F.round(F.abs(regression - F.col("lesion_burden")), 6).alias("absolute_disagreement"))) if regression is not None else None
    return scoring.to_json(parts, {"direct_regression": direct} if direct is not None else {})


def execution_statistics(frames: DataFrame, latency: str = "latency_ms", confidence: str = "confidence", burden: str = "burden_percent") -> DataFrame:
    """One row: frames, effective frames a second, latencies, and statistics of confidence and burden (population deviation); 0 without frames."""
    spread = {"mean": F.avg, "std": F.stddev_pop, "min": F.min, "max": F.max}
    latencies = {"mean": F.avg, "median": median, "p95": lambda c: Quantile(c, 0.95), "min": F.min, "max": F.max}
    of = {c: {f"{c}_{k}": f(v) for k, f in kinds.items()} for c, kinds in ((latency, latencies), (confidence, spread), (burden, spread)) for v in [F.col(c).cast("double")]}
    digits = {latency: 2, confidence: 4, burden: 4}
    seconds = F.sum(F.col(latency).cast("double")) / 1000
    rate = F.coalesce(F.round(F.try_divide(F.count("*").cast("double"), seconds), 2), F.lit(0.0))
    found = summary(frames, [], {"frames": F.count("*"), "frames_per_second": rate} | {k: v for named in of.values() for k, v in named.items()})
    return found.withColumns({k: F.coalesce(F.round(k, digits[c]), F.lit(0.0)) for c, named in of.items() for k in named})
