"""Metrics of classification, masks and regression as aggregations over rows of predictions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.scalars import clipped, ratio
from tessera.operators.quantiles import Quantile, median, summary
from tessera.tables import written

# Fixed value.
EPSILON = 1e-7


# ---- classification ----


def confusion(rows: DataFrame, truth: str, predicted: str, classes: list) -> DataFrame:
    """Dense counts of (truth, predicted) in the order of ``classes``, zeros included. Rows outside the classes are left out."""
    spark = rows.sparkSession
    grid = spark.createDataFrame([(i, j, a, b) for i, a in enumerate(classes) for j, b in enumerate(classes)], f"i int, j int, truth {_kind(rows, truth)}, predicted {_kind(rows, predicted)}")
    counts = rows.groupBy(F.col(truth).alias("truth"), F.col(predicted).alias("predicted")).agg(F.count("*").alias("n"))
    return grid.join(counts, ["truth", "predicted"], "left").select("i", "j", "truth", "predicted", F.coalesce("n", F.lit(0)).alias("n"))


def _kind(df: DataFrame, name: str) -> str:
    return df.schema[name].dataType.simpleString()


def class_metrics(rows: DataFrame, truth: str, predicted: str) -> DataFrame:
    """Per class present in truth or prediction: support, precision, recall and F1; undefined ratios are 0."""
    both = rows.select(F.explode(F.array(F.struct(F.col(truth).alias("c"), F.lit(1).alias("t"), F.lit(0).alias("p"), (F.col(truth) == F.col(predicted)).cast("int").alias("tp")), F.struct(F.col(predicted).alias("c"), F.lit(0).alias("t"), F.lit(1).alias("p"), F.lit(0).alias("tp")))).alias("x")).select("x.*")
    counts = both.groupBy("c").agg(F.sum("t").alias("support"), F.sum("p").alias("n_predicted"), F.sum("tp").alias("tp"))
    precision, recall = ratio(F.col("tp"), F.col("n_predicted"), 0.0), ratio(F.col("tp"), F.col("support"), 0.0)
    return counts.select(F.col("c").alias("class"), "support", precision.alias("precision"), recall.alias("recall"), ratio(2 * F.col("tp"), F.col("support") + F.col("n_predicted"), 0.0).alias("f1"))


def summary_metrics(rows: DataFrame, truth: str, predicted: str) -> DataFrame:
    """Accuracy, balanced accuracy, macro and weighted averages over the classes present in truth or prediction."""
    by = class_metrics(rows, truth, predicted)
    weighted = ratio(F.sum(F.col("f1") * F.col("support")), F.sum("support"), 0.0)
    right = ratio(F.sum(F.col("recall") * F.col("support")), F.sum("support"), 0.0)
    return by.agg(F.sum("support").alias("n"), right.alias("accuracy"), F.avg("recall").alias("balanced_accuracy"), F.avg("precision").alias("macro_precision"), F.avg("recall").alias("macro_recall"), F.avg("f1").alias("macro_f1"), weighted.alias("weighted_f1"))


def top_k_accuracy(rows: DataFrame, truth: Column, indices: Column) -> DataFrame:
    """Share of rows whose true index is among the given ones."""
    return rows.agg(F.avg(F.array_contains(indices, truth).cast("double")).alias("top_k_accuracy"))


# ---- masks ----


def overlap(truth: Column, predicted: Column) -> Column:
    """tp, fp, fn and tn of two arrays of 0 and 1."""
    def add(n, p):  # noqa: ANN001, ANN202
        t, q = p["t"], p["p"]
        return F.struct((n["tp"] + t * q).alias("tp"), (n["fp"] + (1 - t) * q).alias("fp"), (n["fn"] + t * (1 - q)).alias("fn"), (n["tn"] + (1 - t) * (1 - q)).alias("tn"))

    zero = F.struct(*(F.lit(0).cast("long").alias(c) for c in ("tp", "fp", "fn", "tn")))
    return F.aggregate(F.zip_with(truth, predicted, lambda t, p: F.struct(t.cast("long").alias("t"), p.cast("long").alias("p"))), zero, add)


def mask_metrics(tp: Column, fp: Column, fn: Column, tn: Column) -> dict[str, Column]:
    """Sample metrics. With an empty truth an empty prediction is perfect, any other has Dice, IoU and precision 0 and recall 1."""
    truth, predicted, total = tp + fn, tp + fp, tp + fp + fn + tn
    empty = truth == 0
    smooth = lambda a, b: (a + EPSILON) / (b + EPSILON)
    special = lambda value, other: F.when(empty, F.when(predicted == 0, 1.0).otherwise(other)).otherwise(value)
    return {
        "dice": special(smooth(2.0 * tp, (predicted + truth).cast("double")), 0.0), "iou": special(smooth(tp.cast("double"), (tp + fp + fn).cast("double")), 0.0),
        "precision": special(smooth(tp.cast("double"), predicted.cast("double")), 0.0), "recall": special(smooth(tp.cast("double"), truth.cast("double")), 1.0),
        "pixel_accuracy": ratio(tp + tn, total), "gt_lesion_ratio": ratio(truth, total), "pred_lesion_ratio": ratio(predicted, total),
        "false_positive_area_ratio": ratio(F.when(empty, predicted).otherwise(fp), total),
    }


def batch_scores(tp: Column, fp: Column, fn: Column) -> dict[str, Column]:
    """Dice and IoU with smoothing alone: 1 where both masks are empty."""
    smooth = lambda a, b: (a + EPSILON) / (b + EPSILON)
    return {"batch_dice": smooth(2.0 * tp, (2 * tp + fp + fn).cast("double")), "batch_iou": smooth(tp.cast("double"), (tp + fp + fn).cast("double"))}


def mask_metrics_by(rows: DataFrame, key: str, ordinal: str, first: list[str]) -> DataFrame:
    """Means and medians of sample metrics by class; columns in ``first`` come from the row with the smallest ordinal."""
    named = {"n_samples": F.count("*")} | {c: F.min_by(c, ordinal) for c in first}
    for m in ("dice", "iou"):
        named |= {f"mean_{m}": F.avg(m), f"median_{m}": median(F.col(m))}
    named |= {"mean_precision": F.avg("precision"), "mean_recall": F.avg("recall"), "mean_gt_lesion_area": F.avg("gt_lesion_ratio"), "mean_pred_lesion_area": F.avg("pred_lesion_ratio")}
    return summary(rows, [key], named)


def mask_summary(rows: DataFrame, healthy: str = "is_healthy") -> DataFrame:
    """One row: all, diseased and healthy samples. Without samples means are 0 and the rate of clean healthy samples is 1."""
    h, d = F.col(healthy), ~F.col(healthy)
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    when = lambda cond, c: F.when(cond, F.col(c))
    named = {"total_samples": F.count("*"), "diseased_samples": F.count_if(d), "healthy_samples": F.count_if(h)}
    for m in ("dice", "iou"):
        named |= {f"mean_{m}": zero(F.avg(m)), f"median_{m}": median(F.col(m), 0.0)}
    named |= {f"mean_{m}": zero(F.avg(m)) for m in ("precision", "recall", "pixel_accuracy")}
    for m in ("dice", "iou"):
        named |= {f"diseased_mean_{m}": zero(F.avg(when(d, m))), f"diseased_median_{m}": median(when(d, m), 0.0)}
    named |= {"healthy_mean_fp_area": zero(F.avg(when(h, "false_positive_area_ratio"))), "healthy_max_fp_area": zero(F.max(when(h, "false_positive_area_ratio")))}
    named["perfect_clean_rate"] = F.coalesce(F.avg(F.when(h, (F.col("pred_lesion_ratio") == 0).cast("double"))), F.lit(1.0))
    return summary(rows, [], named)


def burden(pixels: Column, total: int = 512 * 512) -> Column:
    return pixels.cast("double") / F.lit(float(total))


# ---- regression ----


def correlation(x: Column, y: Column) -> Column:
    """Pearson's correlation; null where either side is constant (``corr`` raises there under ANSI arithmetic)."""
    return F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y))


def regression(truth: Column, predicted: Column) -> dict[str, Column | Quantile]:
    """MAE, MSE, RMSE, R² (1 - residual over total squares), Pearson, bias, and the midpoint and lower medians of absolute errors."""
    t, p = truth.cast("double"), predicted.cast("double")
    e = p - t
    return {
        "n": F.count(e), "mae": F.avg(F.abs(e)), "mse": F.avg(e * e), "rmse": F.sqrt(F.avg(e * e)), "r2": 1 - F.try_divide(F.sum(e * e), F.var_pop(t) * F.count(e)),
        "pearson": correlation(p, t), "bias": F.avg(e), "median_ae": (middle := median(F.abs(e))), "median_ae_lower": Quantile(middle.value, 0.5, lower=True),
    }


def regression_metrics(rows: DataFrame, truth: str, predicted: str, by: str | None = None) -> DataFrame:
    """All regression metrics, of all rows or by group."""
    return summary(rows, [by] if by else [], regression(F.col(truth), F.col(predicted)))


def _placed(pairs: DataFrame, value: str, name: str) -> DataFrame:
    """Column ``name``: the average rank of ``value``, where each of the distinct rows stands for ``c`` records.

    Rows are dealt by ranges of the value and a hash of the row, so a value that most rows share is spread over many parts.
    A part ranks its own values; only its first and last value can reach into other parts, and these two, with
    their counts, are put together in a table of two rows a part. Nothing is joined on the value but that.
    """
    tie = F.xxhash64(*pairs.columns)
    dealt = written(pairs.withColumn("__tie", tie).repartitionByRange(value, "__tie").withColumn("__part", F.spark_partition_id()).drop("__tie"), "ranks")
    inside = Window.partitionBy("__part").orderBy(value)
    own = F.sum("c").over(Window.partitionBy("__part", value))
    upto = F.sum("c").over(inside.rangeBetween(Window.unboundedPreceding, Window.currentRow))
    placed = dealt.withColumns({"__own": own, "__upto": upto})
    sides = placed.groupBy("__part").agg(F.sum("c").alias("__size"), F.min(F.struct(value, "__upto", "__own")).alias("__low"), F.max(F.struct(value, "__upto", "__own")).alias("__high"))
    before = F.coalesce(F.sum("__size").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # a row a part
    sides = written(sides.withColumn("__before", before), "sides")
    ends = sides.select("__before", F.explode(F.array_distinct(F.array("__low", "__high"))).alias("e")).select(F.col(f"e.{value}").alias("__v"), (F.col("__before") + F.col("e.__upto") - F.col("e.__own")).alias("__start"), F.col("e.__own").alias("__n"))
    ends = ends.groupBy("__v").agg(F.min("__start").alias("__start"), F.sum("__n").alias("__n"))
    known = placed.join(F.broadcast(sides.select("__part", "__before")), "__part").join(F.broadcast(ends), F.col(value) == F.col("__v"), "left")
    start = F.coalesce("__start", F.col("__before") + F.col("__upto") - F.col("__own"))
    return known.withColumn(name, start + (F.coalesce("__n", "__own") + 1) / 2).select(*pairs.columns, name)


def spearman(rows: DataFrame, truth: str, predicted: str) -> DataFrame:
    """Correlation of average ranks; null for a constant side. Records with a null on either side take no part.

    Equal records are counted first, and ranks come from positions (see ``_placed``). Ranks are taken about their
    mean, which is known, so sums of squares lose no digits.
    """
    pairs = rows.where(F.col(truth).isNotNull() & F.col(predicted).isNotNull()).groupBy(F.col(truth).alias("t"), F.col(predicted).alias("p")).agg(F.count("*").alias("c"))
    first = _placed(pairs, "t", "rt").groupBy("p", "rt").agg(F.sum("c").alias("c"))
    ranked = written(_placed(first, "p", "rp"), "ranked")
    middle = ranked.agg(((F.sum("c") + 1) / 2).alias("m"))
    x, y, c = F.col("rt") - F.col("m"), F.col("rp") - F.col("m"), F.col("c")
    return ranked.crossJoin(F.broadcast(middle)).agg(F.try_divide(F.sum(c * x * y), F.sqrt(F.sum(c * x * x)) * F.sqrt(F.sum(c * y * y))).alias("spearman"))


def constant_baseline(rows: DataFrame, truth: str, learns: Column, kind: str = "mean") -> DataFrame:
    """Rows to test with column ``baseline``: mean or median of the rows to learn from."""
    known = F.col(truth).cast("double")
    value = rows.where(learns).agg(F.avg(known).alias("baseline")) if kind == "mean" else summary(rows.where(learns), [], {"baseline": median(known)})
    return rows.where(~learns).crossJoin(F.broadcast(value))


def clipped_errors(truth: Column, raw: Column) -> dict[str, Column]:
    """Raw and clipped predictions and their errors."""
    c = clipped(raw)
    return {"raw_prediction": raw, "clipped_prediction": c, "true_value": truth, "raw_error": raw - truth, "raw_absolute_error": F.abs(raw - truth), "clipped_error": c - truth, "clipped_absolute_error": F.abs(c - truth)}


def out_of_range(raw: Column) -> dict[str, Column]:
    below, above = F.count_if(raw < 0), F.count_if(raw > 1)
    return {"below_0": below, "above_1": above, "out_of_range": below + above, "out_of_range_rate": F.try_divide((below + above).cast("double"), F.count(raw))}


def associations(rows: DataFrame, confidence: str, correct: str, error: str, predicted: str) -> DataFrame:
    """How confidence, correctness and errors of several tasks go together."""
    right = F.col(correct).cast("double")
    return rows.agg(
        F.count("*").alias("n"), F.count_if(F.col(correct)).alias("correct_n"), F.count_if(~F.col(correct)).alias("wrong_n"),
        F.avg(F.when(F.col(correct), F.col(error))).alias("mean_error_when_correct"), F.avg(F.when(~F.col(correct), F.col(error))).alias("mean_error_when_wrong"),
        correlation(F.col(confidence), right).alias("confidence_vs_correct"), correlation(F.col(confidence), F.col(error)).alias("confidence_vs_error"), correlation(F.col(confidence), F.col(predicted)).alias("confidence_vs_predicted"))


def latency_summary(rows: DataFrame, value: str) -> DataFrame:
    """Mean, median, 95th percentile, minimum, maximum and population deviation."""
    v = F.col(value).cast("double")
    return summary(rows, [], {"n": F.count(v), "mean": F.avg(v), "median": median(v), "p95": Quantile(v, 0.95), "min": F.min(v), "max": F.max(v), "std": F.stddev_pop(v)})


def epoch_means(rows: DataFrame, epoch: str, batch: str, values: list[str]) -> DataFrame:
    """Unweighted mean over batches of the batches' means."""
    by_batch = rows.groupBy(epoch, batch).agg(*(F.avg(v).alias(v) for v in values))
    return by_batch.groupBy(epoch).agg(F.count("*").alias("batches"), *(F.avg(v).alias(f"mean_{v}") for v in values))


def difference(rows: DataFrame, a: str, b: str) -> DataFrame:
    """Mean and largest absolute difference, and the number of rows compared."""
    d = F.abs(F.col(a) - F.col(b))
    return rows.agg(F.count(d).alias("compared"), F.avg(d).alias("mean_difference"), F.max(d).alias("max_difference"))
