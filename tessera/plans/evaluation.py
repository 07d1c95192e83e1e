"""Queries of standardising, validation, metrics, selection and scoring."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions import scalars as S
from tessera.operators import inference, metrics, profile, scoring, selection, standardize, validate
from tessera.plans.registry import SPLIT, query, rounded, rounded_doubles, split_by_id
from tessera.tables import table

# ---- classification ----

_BOTH = "b AS (SELECT quality AS t, toxic AS p FROM labels WHERE quality IS NOT NULL AND toxic IS NOT NULL)"
_CLASSES = f"""{_BOTH}, k AS (SELECT t AS class FROM b UNION SELECT p FROM b),
    m AS (SELECT class, (SELECT count(*) FROM b WHERE t = class) AS support, (SELECT count(*) FROM b WHERE p = class) AS n_predicted, (SELECT count(*) FROM b WHERE t = class AND p = class) AS tp FROM k),
    c AS (SELECT class, support, CASE WHEN n_predicted = 0 THEN 0 ELSE tp::DOUBLE / n_predicted END AS precision, CASE WHEN support = 0 THEN 0 ELSE tp::DOUBLE / support END AS recall, 2.0::DOUBLE * tp / (support + n_predicted) AS f1 FROM m)"""


def _both(spark, folder) -> DataFrame:
    return table(spark, folder, "labels").select(F.col("quality").alias("t"), F.col("toxic").alias("p")).dropna()


@query(f"WITH {_BOTH}, g AS (SELECT a.x AS truth, b.x AS predicted FROM (VALUES (0), (1)) a(x), (VALUES (0), (1)) b(x)) SELECT truth AS i, predicted AS j, truth, predicted, (SELECT count(*) FROM b WHERE t = truth AND p = predicted) AS n FROM g")
def confusion_matrix(spark, folder):
    return metrics.confusion(_both(spark, folder), "t", "p", [0, 1])


@query(f"WITH {_CLASSES} SELECT class, support, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1 FROM c")
def per_class_prf(spark, folder):
    return metrics.class_metrics(_both(spark, folder), "t", "p").withColumns(rounded("precision", "recall", "f1"))


@query(f"""WITH {_CLASSES} SELECT sum(support)::BIGINT AS n, round(sum(recall * support) / sum(support), 6) AS accuracy, round(avg(recall), 6) AS balanced_accuracy, round(avg(precision), 6) AS macro_precision,
    round(avg(recall), 6) AS macro_recall, round(avg(f1), 6) AS macro_f1, round(sum(f1 * support) / sum(support), 6) AS weighted_f1 FROM c""")
def macro_metrics(spark, folder):
    return metrics.summary_metrics(_both(spark, folder), "t", "p").withColumns(rounded("accuracy", "balanced_accuracy", "macro_precision", "macro_recall", "macro_f1", "weighted_f1"))


_SOFTMAX = """s AS (SELECT vec_id, label, i, exp(embedding[i]::DOUBLE - m) AS e FROM (SELECT *, list_max(embedding[1:10])::DOUBLE AS m FROM embeddings), range(1, 11) r(i)),
    p AS (SELECT vec_id, label, i - 1 AS i, e / sum(e) OVER (PARTITION BY vec_id) AS p FROM s), k AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY p DESC, i) AS r FROM p)"""


def _probabilities(spark, folder) -> DataFrame:
    return table(spark, folder, "embeddings").select("vec_id", "label", S.softmax(F.slice("embedding", 1, 10)).alias("p"))


@query(f"""WITH {_SOFTMAX} SELECT vec_id, max(CASE WHEN r = 1 THEN i END)::INTEGER AS top1, max(CASE WHEN r = 2 THEN i END)::INTEGER AS top2, round(max(CASE WHEN r = 1 THEN p END), 6) AS confidence,
    round(max(CASE WHEN r = 1 THEN p END) - max(CASE WHEN r = 2 THEN p END), 6) AS margin, round(-sum(greatest(p, 1e-10) * ln(greatest(p, 1e-10))) / ln(10), 6) AS normalised_entropy FROM k GROUP BY vec_id""")
def topk_margin_entropy(spark, folder):
    top = _probabilities(spark, folder).withColumn("top", S.top_k(F.col("p"), 2))
    first, second = F.get("top", F.lit(0)), F.get("top", F.lit(1))
    return top.select("vec_id", first["index"].alias("top1"), second["index"].alias("top2"), F.round(first["value"], 6).alias("confidence"), F.round(first["value"] - second["value"], 6).alias("margin"), F.round(S.normalised_entropy(F.col("p")), 6).alias("normalised_entropy"))


@query(f"WITH {_SOFTMAX}, h AS (SELECT vec_id, max((i = label AND r <= 2)::INTEGER) AS hit FROM k GROUP BY vec_id) SELECT round(avg(hit), 6) AS top_k_accuracy FROM h")
def top2_accuracy(spark, folder):
    top = _probabilities(spark, folder).select("label", F.transform(S.top_k(F.col("p"), 2), lambda x: x["index"]).alias("indices"))
    return metrics.top_k_accuracy(top, F.col("label"), F.col("indices")).withColumns(rounded("top_k_accuracy"))


@query(f"""WITH {_SOFTMAX}, b AS (SELECT vec_id, max(CASE WHEN r = 1 THEN p END) AS c FROM k GROUP BY vec_id)
    SELECT vec_id, CASE WHEN c < 0.14 THEN 'confidence ' || printf('%.4f', c) || ' is below the threshold 0.1400' ELSE '' END AS warning FROM b""")
def abstention_warnings(spark, folder):
    best = _probabilities(spark, folder).select("vec_id", F.array_max("p").alias("confidence"))
    return best.select("vec_id", F.concat_ws(";", scoring.warnings(F.col("confidence"), 0.14)).alias("warning"))


@query(f"""WITH {_SOFTMAX}, t AS (SELECT vec_id, any_value(label) AS label, max(CASE WHEN r = 1 THEN i END) AS a, max(CASE WHEN r = 1 THEN p END) AS c, max(CASE WHEN r = 2 THEN i END) AS b, max(CASE WHEN r = 2 THEN p END) AS d, -sum(greatest(p, 1e-10) * ln(greatest(p, 1e-10))) / ln(10) AS h FROM k GROUP BY vec_id), u AS (SELECT *, vec_id % 9 > 0 AS ok FROM t)
    SELECT vec_id, CASE WHEN ok THEN 'ok' ELSE 'error' END AS status, CASE WHEN ok THEN 'class ' || a END AS predicted_class, CASE WHEN ok THEN round(c, 6) END AS confidence, CASE WHEN ok THEN 'class ' || b END AS top2_class, CASE WHEN ok THEN round(d, 6) END AS top2_confidence,
    CASE WHEN ok THEN round(c - d, 6) END AS confidence_margin, CASE WHEN ok THEN round(h, 6) END AS normalized_entropy, CASE WHEN ok THEN round(vec_id / 262144.0::DOUBLE, 9) END AS lesion_burden, CASE WHEN ok THEN (c < 0.14)::INTEGER END AS warning_count FROM u""")
def batch_prediction_rows(spark, folder):
    rows = _probabilities(spark, folder).withColumn("p", F.when(F.col("vec_id") % 9 > 0, F.col("p"))).withColumn("pixels", F.col("vec_id"))
    found = inference.results(rows, "p", "pixels", [f"class {i}" for i in range(10)], 0.14)
    digits = {"confidence": 6, "top2_confidence": 6, "confidence_margin": 6, "normalized_entropy": 6, "lesion_burden": 9}
    return found.select("vec_id", "status", "predicted_class", F.round("confidence", 6).alias("confidence"), "top2_class", *(F.round(c, d).alias(c) for c, d in digits.items() if c != "confidence"), "warning_count")


# ---- masks: the signs of two vectors are truth and prediction ----

_MASKS = """v AS (SELECT a.vec_id, a.label, list_transform(a.embedding, lambda x: (x > 0)::INTEGER) AS t, list_transform(b.embedding, lambda x: (x > 0.05)::INTEGER) AS p FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1),
    z AS (SELECT vec_id, label, CASE WHEN vec_id % 10 = 0 THEN list_transform(t, lambda x: 0) ELSE t END AS t, CASE WHEN vec_id % 20 = 0 THEN list_transform(p, lambda x: 0) ELSE p END AS p FROM v),
    n AS (SELECT vec_id, label, list_sum(list_transform(list_zip(t, p), lambda x: x[1] * x[2]))::BIGINT AS tp, list_sum(list_transform(list_zip(t, p), lambda x: (1 - x[1]) * x[2]))::BIGINT AS fp,
        list_sum(list_transform(list_zip(t, p), lambda x: x[1] * (1 - x[2])))::BIGINT AS fn, list_sum(list_transform(list_zip(t, p), lambda x: (1 - x[1]) * (1 - x[2])))::BIGINT AS tn FROM z),
    m AS (SELECT *, tp + fn = 0 AS is_healthy, CASE WHEN tp + fn = 0 THEN CASE WHEN fp = 0 THEN 1 ELSE 0 END ELSE (2.0::DOUBLE * tp + 1e-7) / (2 * tp + fp + fn + 1e-7) END AS dice,
        CASE WHEN tp + fn = 0 THEN CASE WHEN fp = 0 THEN 1 ELSE 0 END ELSE (tp + 1e-7) / (tp + fp + fn + 1e-7) END AS iou, CASE WHEN tp + fn = 0 THEN CASE WHEN fp = 0 THEN 1 ELSE 0 END ELSE (tp + 1e-7) / (tp + fp + 1e-7) END AS precision,
        CASE WHEN tp + fn = 0 THEN 1 ELSE (tp + 1e-7) / (tp + fn + 1e-7) END AS recall, (tp + tn) / 64.0::DOUBLE AS pixel_accuracy, (tp + fn) / 64.0::DOUBLE AS gt_lesion_ratio, (tp + fp) / 64.0::DOUBLE AS pred_lesion_ratio, fp / 64.0::DOUBLE AS false_positive_area_ratio FROM n)"""
_MASK_NAMES = ("dice", "iou", "precision", "recall", "pixel_accuracy", "gt_lesion_ratio", "pred_lesion_ratio", "false_positive_area_ratio")


def _overlaps(spark, folder) -> DataFrame:
    a = table(spark, folder, "embeddings")
    b = a.select((F.col("vec_id") - 1).alias("vec_id"), F.transform("embedding", lambda x: (x.cast("double") > 0.05).cast("int")).alias("p"))
    pairs = a.select("vec_id", "label", F.transform("embedding", lambda x: (x > 0).cast("int")).alias("t")).join(b, "vec_id")
    none = lambda c, k: F.when(F.col("vec_id") % k == 0, F.transform(c, lambda x: F.lit(0))).otherwise(F.col(c))
    return pairs.select("vec_id", "label", metrics.overlap(none("t", 10), none("p", 20)).alias("o")).select("vec_id", "label", "o.*")


def _masks(spark, folder) -> DataFrame:
    rows = _overlaps(spark, folder)
    named = metrics.mask_metrics(*(F.col(c) for c in ("tp", "fp", "fn", "tn")))
    return rows.withColumns(named | {"is_healthy": S.healthy_sample(F.lit(None).cast("boolean"), F.col("tp") + F.col("fn"))})


@query(f"WITH {_MASKS} SELECT vec_id, label, tp, fp, fn, tn, is_healthy, {', '.join(f'round({c}, 6) AS {c}' for c in _MASK_NAMES)} FROM m")
def mask_metrics(spark, folder):
    return _masks(spark, folder).withColumns(rounded(*_MASK_NAMES))


_BY_CLASS = {"mean_dice": "avg(dice)", "median_dice": "median(dice)", "mean_iou": "avg(iou)", "median_iou": "median(iou)", "mean_precision": "avg(precision)", "mean_recall": "avg(recall)", "mean_gt_lesion_area": "avg(gt_lesion_ratio)", "mean_pred_lesion_area": "avg(pred_lesion_ratio)"}


@query(f"WITH {_MASKS} SELECT label, count(*) AS n_samples, min(vec_id) AS first_id, {', '.join(f'round({e}, 4) AS {n}' for n, e in _BY_CLASS.items())} FROM m GROUP BY label")
def mask_metrics_by_class(spark, folder):
    rows = _masks(spark, folder).withColumn("first_id", F.col("vec_id"))
    by = metrics.mask_metrics_by(rows, "label", "vec_id", ["first_id"])
    return by.withColumns(rounded(*_BY_CLASS, digits=4)).orderBy(F.desc("mean_dice"), F.desc("n_samples"), "label")


_SUMMARY = ", ".join([*(f"round({k}({m}), 6) AS {'mean' if k == 'avg' else 'median'}_{m}" for m in ("dice", "iou") for k in ("avg", "median")), *(f"round(avg({m}), 6) AS mean_{m}" for m in ("precision", "recall", "pixel_accuracy")), *(f"round({k}({m}) FILTER (NOT is_healthy), 6) AS diseased_{'mean' if k == 'avg' else 'median'}_{m}" for m in ("dice", "iou") for k in ("avg", "median"))])


@query(f"""WITH {_MASKS} SELECT count(*) AS total_samples, count_if(NOT is_healthy) AS diseased_samples, count_if(is_healthy) AS healthy_samples, {_SUMMARY},
    round(avg(false_positive_area_ratio) FILTER (is_healthy), 6) AS healthy_mean_fp_area, round(max(false_positive_area_ratio) FILTER (is_healthy), 6) AS healthy_max_fp_area, round(avg((pred_lesion_ratio = 0)::INTEGER) FILTER (is_healthy), 6) AS perfect_clean_rate FROM m""")
def mask_summary(spark, folder):
    one = metrics.mask_summary(_masks(spark, folder))
    return one.withColumns(rounded(*(c for c in one.columns if not c.endswith("_samples"))))


@query(f"WITH {_MASKS} SELECT vec_id, round((2.0::DOUBLE * tp + 1e-7) / (2 * tp + fp + fn + 1e-7), 6) AS batch_dice, round((tp + 1e-7) / (tp + fp + fn + 1e-7), 6) AS batch_iou, round((tp + fp) / 262144.0::DOUBLE, 9) AS burden, round((tp + fp) / 262144.0::DOUBLE * 100, 4) AS burden_percent FROM m")
def batch_scores_and_burden(spark, folder):
    rows = _overlaps(spark, folder)
    named = metrics.batch_scores(F.col("tp"), F.col("fp"), F.col("fn"))
    share = metrics.burden(F.col("tp") + F.col("fp"))
    return rows.select("vec_id", *(F.round(c, 6).alias(n) for n, c in named.items()), F.round(share, 9).alias("burden"), F.round(share * 100, 4).alias("burden_percent"))


# ---- regression ----

_PRICES = "r AS (SELECT l_orderkey, l_linenumber, l_returnflag AS class, l_quantity * p_retailprice / 100000 AS truth, l_extendedprice / 100000 AS predicted FROM lineitem JOIN part ON l_partkey = p_partkey)"
_ERRORS = f"{_PRICES}, e AS (SELECT *, predicted - truth AS d FROM r)"
_REGRESSION = """count(*) AS n, round(avg(abs(d)), 6) AS mae, round(avg(d * d), 6) AS mse, round(sqrt(avg(d * d)), 6) AS rmse, round(1 - sum(d * d) / (var_pop(truth) * count(*)), 6) AS r2, round(corr(predicted, truth), 6) AS pearson,
    round(avg(d), 6) AS bias, round(median(abs(d)), 6) AS median_ae, round(quantile_disc(abs(d), 0.5), 6) AS median_ae_lower"""
_REGRESSION_NAMES = ("mae", "mse", "rmse", "r2", "pearson", "bias", "median_ae", "median_ae_lower")


def _prices(spark, folder) -> DataFrame:
    rows = table(spark, folder, "lineitem").join(table(spark, folder, "part").select("p_partkey", "p_retailprice"), F.col("l_partkey") == F.col("p_partkey"))
    return rows.select("l_orderkey", "l_linenumber", F.col("l_returnflag").alias("class"), (F.col("l_quantity") * F.col("p_retailprice") / 100000).alias("truth"), (F.col("l_extendedprice") / 100000).alias("predicted"))


@query(f"WITH {_ERRORS} SELECT {_REGRESSION} FROM e")
def regression_metrics(spark, folder):
    return metrics.regression_metrics(_prices(spark, folder), "truth", "predicted").withColumns(rounded_doubles(*_REGRESSION_NAMES))


@query(f"WITH {_ERRORS} SELECT class, {_REGRESSION} FROM e GROUP BY class")
def regression_by_class(spark, folder):
    return metrics.regression_metrics(_prices(spark, folder), "truth", "predicted", "class").withColumns(rounded_doubles(*_REGRESSION_NAMES))


@query(f"WITH {_PRICES}, k AS (SELECT rank() OVER (ORDER BY truth) + (count(*) OVER (PARTITION BY truth) - 1) / 2.0 AS a, rank() OVER (ORDER BY predicted) + (count(*) OVER (PARTITION BY predicted) - 1) / 2.0 AS b FROM r) SELECT round(corr(a, b), 6) AS spearman FROM k")
def spearman_correlation(spark, folder):
    return metrics.spearman(_prices(spark, folder), "truth", "predicted").withColumns(rounded("spearman"))


def _baseline_sql(kind: str) -> str:
    f = "avg" if kind == "mean" else "median"
    return f"""WITH {_PRICES}, b AS (SELECT {f}(truth) AS baseline FROM r WHERE l_orderkey % 10 < 7), e AS (SELECT truth, baseline - truth AS d FROM r, b WHERE l_orderkey % 10 >= 7)
        SELECT '{kind}' AS kind, count(*) AS n, round(avg(abs(d)), 6) AS mae, round(avg(d * d), 6) AS mse, round(sqrt(avg(d * d)), 6) AS rmse, round(1 - sum(d * d) / (var_pop(truth) * count(*)), 6) AS r2, NULL::DOUBLE AS pearson, round(avg(d), 6) AS bias, round(median(abs(d)), 6) AS median_ae FROM e"""


@query(f"({_baseline_sql('mean')}) UNION ALL ({_baseline_sql('median')})")
def constant_baseline(spark, folder):
    rows, learns = _prices(spark, folder), F.col("l_orderkey") % 10 < 7
    found = [metrics.regression_metrics(metrics.constant_baseline(rows, "truth", learns, kind), "truth", "baseline").drop("median_ae_lower").withColumn("kind", F.lit(kind)) for kind in ("mean", "median")]
    return found[0].unionByName(found[1]).withColumns(rounded_doubles(*(c for c in _REGRESSION_NAMES if c != "median_ae_lower")))


@query(f"""WITH {_PRICES}, c AS (SELECT *, predicted * 3 - 0.5 AS raw FROM r), x AS (SELECT *, greatest(0, least(1, raw)) AS c FROM c)
    SELECT l_orderkey, l_linenumber, raw AS raw_prediction, c AS clipped_prediction, truth AS true_value, raw - truth AS raw_error, abs(raw - truth) AS raw_absolute_error, c - truth AS clipped_error, abs(c - truth) AS clipped_absolute_error FROM x""")
def raw_and_clipped_errors(spark, folder):
    named = metrics.clipped_errors(F.col("truth"), F.col("predicted") * 3 - 0.5)
    return _prices(spark, folder).select("l_orderkey", "l_linenumber", *(c.alias(n) for n, c in named.items()))


@query(f"WITH {_PRICES}, c AS (SELECT predicted * 3 - 0.5 AS raw FROM r) SELECT count_if(raw < 0) AS below_0, count_if(raw > 1) AS above_1, count_if(raw < 0 OR raw > 1) AS out_of_range, round(count_if(raw < 0 OR raw > 1) / count(*), 6) AS out_of_range_rate FROM c")
def out_of_range_counts(spark, folder):
    return _prices(spark, folder).agg(*(c.alias(n) for n, c in metrics.out_of_range(F.col("predicted") * 3 - 0.5).items())).withColumns(rounded("out_of_range_rate"))


@query("""WITH x AS (SELECT vec_id, label, list_sum(list_transform(embedding, lambda v: (v > 0.05)::INTEGER)) / 64.0::DOUBLE AS strict, list_sum(list_transform(embedding, lambda v: (v >= 0.05)::INTEGER)) / 64.0::DOUBLE AS loose, list_sum(list_transform(embedding, lambda v: (v > 0)::INTEGER)) / 64.0::DOUBLE AS truth FROM embeddings)
    SELECT vec_id, round(strict, 6) AS predicted_burden, round(truth, 6) AS true_burden, round(strict - truth, 6) AS signed_error, round(abs(strict - truth), 6) AS absolute_error, round(abs(strict - loose), 6) AS disagreement FROM x""")
def burden_errors(spark, folder):
    share = lambda test: F.aggregate("embedding", F.lit(0), lambda n, x: n + test(x.cast("double")).cast("int")) / F.lit(64.0)
    rows = table(spark, folder, "embeddings").select("vec_id", share(lambda x: x > 0.05).alias("strict"), share(lambda x: x >= 0.05).alias("loose"), share(lambda x: x > 0).alias("truth"))
    return rows.select("vec_id", F.round("strict", 6).alias("predicted_burden"), F.round("truth", 6).alias("true_burden"), F.round(F.col("strict") - F.col("truth"), 6).alias("signed_error"), F.round(F.abs(F.col("strict") - F.col("truth")), 6).alias("absolute_error"), F.round(F.abs(F.col("strict") - F.col("loose")), 6).alias("disagreement"))


@query(f"""WITH {_ERRORS}, c AS (SELECT *, abs(d) AS ae, l_linenumber % 3 <> 0 AS correct, 1 / (1 + abs(d)) AS confidence FROM e)
    SELECT count(*) AS n, count_if(correct) AS correct_n, count_if(NOT correct) AS wrong_n, round(avg(ae) FILTER (correct), 6) AS mean_error_when_correct, round(avg(ae) FILTER (NOT correct), 6) AS mean_error_when_wrong,
    round(corr(confidence, correct::INTEGER), 6) AS confidence_vs_correct, round(corr(confidence, ae), 6) AS confidence_vs_error, round(corr(confidence, predicted), 6) AS confidence_vs_predicted FROM c""")
def cross_task_associations(spark, folder):
    error = F.abs(F.col("predicted") - F.col("truth"))
    rows = _prices(spark, folder).withColumns({"ae": error, "correct": F.col("l_linenumber") % 3 != 0, "confidence": 1 / (1 + error)})
    return metrics.associations(rows, "confidence", "correct", "ae", "predicted").withColumns(rounded("mean_error_when_correct", "mean_error_when_wrong", "confidence_vs_correct", "confidence_vs_error", "confidence_vs_predicted"))


@query(f"WITH {_PRICES} SELECT count(*) AS compared, round(avg(abs(truth - predicted)), 6) AS mean_difference, round(max(abs(truth - predicted)), 6) AS max_difference FROM r")
def verification_difference(spark, folder):
    return metrics.difference(_prices(spark, folder), "truth", "predicted").withColumns(rounded("mean_difference", "max_difference"))


# ---- frames and histories ----


@query("SELECT count(value) AS n, round(avg(value), 6) AS mean, round(median(value), 6) AS median, round(quantile_cont(value, 0.95), 6) AS p95, min(value) AS min, max(value) AS max, round(stddev_pop(value), 6) AS std FROM events")
def latency_summary(spark, folder):
    return metrics.latency_summary(table(spark, folder, "events"), "value").withColumns(rounded("mean", "median", "p95", "std"))


@query("SELECT event_id, user_id FROM events WHERE event_id % 12 = 0 AND event_id < 7500")
def frame_stride(spark, folder):
    return selection.stride(table(spark, folder, "events"), "event_id", 30.0, 2.5, 250.0).select("event_id", "user_id")


@query("SELECT event_id, user_id, last_value(CASE WHEN event_id % 5 = 0 THEN value END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS held FROM events")
def hold_last(spark, folder):
    rows = table(spark, folder, "events").withColumn("sampled", F.when(F.col("event_id") % 5 == 0, F.col("value")))
    return selection.held(rows, "user_id", ["ts", "event_id"], "sampled", "held").select("event_id", "user_id", "held")


@query("""WITH p AS (SELECT event_id, user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS position, count(*) OVER (PARTITION BY user_id) AS n FROM events)
    SELECT event_id, user_id, position, share::DOUBLE AS share FROM p, (VALUES (0.2), (0.5), (0.8)) s(share) WHERE position = floor(n * share::DOUBLE)""")
def key_frames(spark, folder):
    return selection.key_frames(table(spark, folder, "events"), "user_id", ["ts", "event_id"]).select("event_id", "user_id", "position", F.col("share").cast("double").alias("share"))


@query("""WITH w AS (SELECT user_id, event_id, ts, value, row_number() OVER o AS step, max(value) OVER (o ROWS UNBOUNDED PRECEDING) AS best, max(value) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM events WINDOW o AS (PARTITION BY user_id ORDER BY ts, event_id)),
    i AS (SELECT *, before IS NULL OR value > before AS improved FROM w), s AS (SELECT *, step - max(CASE WHEN improved THEN step END) OVER (PARTITION BY user_id ORDER BY step ROWS UNBOUNDED PRECEDING) AS waited FROM i)
    SELECT user_id, event_id, step, best, improved, waited, max((waited >= 7)::INTEGER) OVER (PARTITION BY user_id ORDER BY step ROWS UNBOUNDED PRECEDING) = 1 AS stopped FROM s""")
def running_best(spark, folder):
    return selection.running_best(table(spark, folder, "events"), "user_id", ["ts", "event_id"], "value", 7).select("user_id", "event_id", "step", "best", "improved", "waited", "stopped")


@query("WITH b AS (SELECT l_returnflag, l_linenumber, avg(l_discount) AS l_discount, avg(l_tax) AS l_tax FROM lineitem GROUP BY 1, 2) SELECT l_returnflag, count(*) AS batches, round(avg(l_discount), 6) AS mean_l_discount, round(avg(l_tax), 6) AS mean_l_tax FROM b GROUP BY 1")
def epoch_means(spark, folder):
    return metrics.epoch_means(table(spark, folder, "lineitem"), "l_returnflag", "l_linenumber", ["l_discount", "l_tax"]).withColumns(rounded("mean_l_discount", "mean_l_tax"))


# ---- selection ----


@query("""WITH p AS (SELECT o_orderkey, o_totalprice, row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) - 1 AS position, count(*) OVER () AS n FROM orders)
    SELECT o_orderkey, o_totalprice, position, CASE WHEN position < 6 THEN 'best' WHEN position >= n // 2 - 3 AND position < n // 2 + 3 THEN 'middle' ELSE 'worst' END AS pick FROM p WHERE position < 6 OR position >= n - 6 OR (position >= n // 2 - 3 AND position < n // 2 + 3)""")
def best_mid_worst(spark, folder):
    return selection.best_middle_worst(table(spark, folder, "orders").select("o_orderkey", "o_totalprice"), "o_totalprice", "o_orderkey")


_PICKED = """p AS (SELECT o_orderkey, o_custkey, o_totalprice, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice, o_orderkey) - 1 AS position, count(*) OVER (PARTITION BY o_custkey) AS size FROM orders),
    k AS (SELECT o_orderkey, o_custkey, position, CASE WHEN position = 0 THEN 'small' WHEN position = size // 2 THEN 'middle' WHEN position = size - 1 THEN 'large' END AS pick FROM p)"""


@query(f"WITH {_PICKED} SELECT * FROM k WHERE pick IS NOT NULL")
def small_mid_large_per_group(spark, folder):
    return selection.small_middle_large(table(spark, folder, "orders"), "o_custkey", "o_totalprice", "o_orderkey").select("o_orderkey", "o_custkey", "position", "pick")


@query("WITH a AS (SELECT o_orderkey FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 100), b AS (SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT o_orderkey FROM a) ORDER BY o_orderkey LIMIT 200) SELECT * FROM a UNION ALL SELECT * FROM b")
def padded_sample(spark, folder):
    orders = table(spark, folder, "orders")
    picked = orders.orderBy(F.desc("o_totalprice"), "o_orderkey").limit(100).select("o_orderkey")
    return selection.padded(picked, orders.select("o_orderkey"), "o_orderkey", 300)


@query("SELECT c_custkey AS key FROM customer EXCEPT SELECT o_custkey FROM orders")
def set_difference(spark, folder):
    return selection.missing_keys(table(spark, folder, "customer").select(F.col("c_custkey").alias("key")), table(spark, folder, "orders").select(F.col("o_custkey").alias("key")), ["key"])


@query("SELECT doc_id AS key FROM documents EXCEPT SELECT doc_id FROM labels")
def set_difference_of_documents(spark, folder):
    return selection.missing_keys(table(spark, folder, "documents").select(F.col("doc_id").alias("key")), table(spark, folder, "labels").select(F.col("doc_id").alias("key")), ["key"])


@query("SELECT doc_id, 'quality' AS kind FROM labels WHERE quality = 1 UNION ALL SELECT doc_id, 'toxic' FROM labels WHERE toxic = 1")
def row_append(spark, folder):
    rows = table(spark, folder, "labels")
    return rows.where("quality = 1").select("doc_id", F.lit("quality").alias("kind")).unionByName(rows.where("toxic = 1").select("doc_id", F.lit("toxic").alias("kind")))


@query("SELECT o_custkey, o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS r FROM orders) WHERE r = 1")
def distinct_first(spark, folder):
    return selection.first_occurrences(table(spark, folder, "orders").select("o_custkey", "o_orderkey", "o_totalprice"), ["o_custkey"], "o_orderkey")


@query("SELECT event_id, ts::VARCHAR AS ts FROM events ORDER BY event_id LIMIT 100")
def head_limit(spark, folder):
    return table(spark, folder, "events").orderBy("event_id").limit(100).select("event_id", F.col("ts").cast("string").alias("ts"))


# ---- standardising and validation ----


@query(f"SELECT doc_id, CASE WHEN s LIKE '%train%' THEN 'train' WHEN s LIKE '%val%' THEN 'val' WHEN s LIKE '%test%' THEN 'test' ELSE s END AS split FROM (SELECT doc_id, CASE WHEN doc_id % 23 = 0 THEN 'unassigned' ELSE lower(trim(CASE doc_id % 5 WHEN 0 THEN ' Training' WHEN 1 THEN 'invalid ' WHEN 2 THEN 'LATEST' WHEN 3 THEN 'Fold_' || (doc_id % 3) ELSE 'test' END)) END AS s FROM documents)")
def split_normalise(spark, folder):
    m = F.col("doc_id") % 5
    raw = F.when(F.col("doc_id") % 23 == 0, F.lit(None).cast("string")).otherwise(F.when(m == 0, " Training").when(m == 1, "invalid ").when(m == 2, "LATEST").when(m == 3, F.concat(F.lit("Fold_"), F.col("doc_id") % 3)).otherwise("test"))
    return table(spark, folder, "documents").select("doc_id", S.split_normalised(raw).alias("split"))


@query("SELECT page_id, CASE WHEN page_id % 4 = 0 THEN NULL ELSE (page_id * 3)::INTEGER END AS w, CASE WHEN page_id % 4 = 0 THEN NULL ELSE (page_id + 1)::INTEGER END AS h FROM pages")
def resolution_parse(spark, folder):
    text = F.when(F.col("page_id") % 4 == 0, F.lit("unknown x y")).otherwise(F.concat_ws(" X ", (F.col("page_id") * 3).cast("string"), (F.col("page_id") + 1).cast("string")))
    w, h = S.resolution(text)
    return table(spark, folder, "pages").select("page_id", w.alias("w"), h.alias("h"))


_PATHS = "SELECT page_id, CASE WHEN page_id % 7 = 0 THEN 'root/annotations/a/' || page_id || '.png' ELSE 'root/images/x/images/' || page_id || '.jpg' END AS path FROM pages"


@query(f"WITH p AS ({_PATHS}) SELECT page_id, CASE WHEN path LIKE '%images/%' THEN regexp_extract(path, 'images/.*$') ELSE regexp_extract(path, 'annotations/.*$') END AS path FROM p")
def relpath_first(spark, folder):
    return _paths(spark, folder).select("page_id", S.relative_to_first_marker(F.col("path")).alias("path"))


@query(f"WITH p AS ({_PATHS}) SELECT page_id, CASE WHEN page_id % 11 = 0 THEN '' ELSE 'images/' || list_last(string_split(path, 'images/')) END AS path FROM p")
def relpath_last(spark, folder):
    return _paths(spark, folder).select("page_id", S.relative_to_last_marker(F.when(F.col("page_id") % 11 != 0, F.col("path"))).alias("path"))


def _paths(spark, folder) -> DataFrame:
    p = F.col("page_id").cast("string")
    return table(spark, folder, "pages").select("page_id", F.when(F.col("page_id") % 7 == 0, F.concat(F.lit("root\\annotations\\a\\"), p, F.lit(".png"))).otherwise(F.concat(F.lit("root/images/x/images/"), p, F.lit(".jpg"))).alias("path"))


@query("""SELECT page_id, CASE WHEN page_id % 3 = 0 THEN page_id || '_' || regexp_replace(list_last(string_split(url, '/')), '(.)\\.[^.]*$', '\\1') WHEN page_id % 3 = 1 THEN regexp_replace(list_last(string_split(url, '/')), '(.)\\.[^.]*$', '\\1') ELSE printf('sample_%06d', page_id) END AS sample_id FROM pages""")
def sample_ids(spark, folder):
    k = F.col("page_id") % 3
    return table(spark, folder, "pages").select("page_id", S.sample_id(F.when(k == 0, F.col("page_id")), F.when(k != 2, F.col("url")), F.col("page_id")).alias("sample_id"))


@query("SELECT c_custkey::VARCHAR || '_' || c_name AS sample_id, c_name AS image_path, trim(c_mktsegment) AS host, CASE WHEN c_custkey % 9 = 0 THEN 'Unknown' ELSE 'n' || c_nationkey END AS disease, 'train' AS split, 'survey' AS source, 'Unknown' AS license, round(c_acctbal, 2) AS meta_mask_ratio, c_custkey::INTEGER AS meta_width, (c_custkey + 1)::INTEGER AS meta_height FROM customer")
def standardised_records(spark, folder):
    """Synonyms of column names, defaults and parsed resolutions, on customers as metadata."""
    raw = table(spark, folder, "customer").select(F.col("c_custkey").alias("Image ID"), F.col("c_name").alias("file-name"), F.concat(F.lit(" "), F.col("c_mktsegment"), F.lit(" ")).alias("Plant"), F.when(F.col("c_custkey") % 9 != 0, F.concat(F.lit("n"), F.col("c_nationkey"))).alias("Label"), F.lit("Training").alias("fold"), F.lit("survey").alias("Origin"), F.col("c_acctbal").alias("Severity"), F.concat_ws("x", "c_custkey", F.col("c_custkey") + 1).alias("Resolution"), F.col("c_custkey").alias("__ordinal"))
    found = standardize.standardized(raw, "__ordinal")
    return found.select("sample_id", "image_path", "host", "disease", "split", "source", "license", F.round("meta_mask_ratio", 2).alias("meta_mask_ratio"), "meta_width", "meta_height")


@query("""WITH v AS (SELECT event_id, CASE WHEN event_id % 10 = 0 THEN 'missing' WHEN event_id % 10 = 1 THEN 'corrupt' END AS image_code, CASE WHEN event_id % 7 = 0 THEN 'missing' WHEN event_id % 7 = 1 THEN 'dimensions' WHEN event_id % 7 = 2 THEN 'corrupt' END AS mask_code, event_id % 11 = 0 AS unusual, event_id % 3 AS px, event_id % 13 = 0 AS diff FROM events)
    SELECT count(*) AS total_records, count_if(image_code IS NULL) AS valid_images, count_if(image_code = 'missing') AS missing_images, count_if(image_code = 'corrupt') AS corrupt_images, count_if(image_code IS NULL AND unusual) AS unusual_images,
    count(*) AS total_masks, count_if(mask_code IS NULL) AS valid_masks, count_if(mask_code = 'missing') AS missing_masks, count_if(mask_code = 'dimensions') AS dim_mismatch_masks, count_if(mask_code = 'corrupt') AS corrupt_masks, count_if(mask_code IS NULL AND px = 0) AS empty_masks, count_if(mask_code IS NULL AND diff) AS ratio_discrepancies FROM v""")
def validation_counters(spark, folder):
    e = F.col("event_id")
    rows = table(spark, folder, "events").select(
        F.when(e % 10 == 0, "missing").when(e % 10 == 1, "corrupt").alias("image_code"), F.when(e % 7 == 0, "missing").when(e % 7 == 1, "dimensions").when(e % 7 == 2, "corrupt").alias("mask_code"), F.lit("m").alias("mask_path"),
        F.when(e % 11 == 0, "flag").alias("unusual_image_flag"), (e % 3).alias("affected_pixels"), F.when(e % 13 == 0, "note").alias("ratio_discrepancy_note"))
    return validate.counters(rows)


@query("""WITH r AS (SELECT l_orderkey, l_linenumber, l_discount * 10 AS calc, l_tax * 10 AS meta FROM lineitem)
    SELECT l_orderkey, l_linenumber, printf('Calculated ratio (%.4f) differs from metadata (%.4f) by %.4f', calc, meta, abs(calc - meta)) AS note FROM r WHERE abs(calc - meta) > 0.05""")
def ratio_discrepancies(spark, folder):
    rows = table(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", validate.discrepancy_note(F.col("l_discount") * 10, F.col("l_tax") * 10, 0.05).alias("note"))
    return rows.where("note IS NOT NULL")


@query("""WITH v AS (SELECT p_partkey, p_size * 10 AS w, (p_partkey % 60) * 10 AS h FROM part)
    SELECT p_partkey, CASE WHEN w > 0 AND h > 0 AND greatest(w / h, h / w) > 5 THEN 'extreme_aspect_ratio' WHEN w = 0 OR h = 0 THEN 'extreme_aspect_ratio' WHEN least(w, h) < 32 THEN 'very_small_resolution' END AS flag FROM v""")
def unusual_image_flags(spark, folder):
    return table(spark, folder, "part").select("p_partkey", validate.unusual(F.col("p_size") * 10, (F.col("p_partkey") % 60) * 10).alias("flag"))


@query("SELECT event_id, CASE WHEN props IS NULL OR event_id % 50 = 0 THEN 'error' ELSE 'ok' END AS status, CASE WHEN props IS NULL OR event_id % 50 = 0 THEN NULL ELSE length(props) END AS value FROM events")
def batch_error_isolation(spark, folder):
    """A scorer that fails on some rows: each failure is a row of its own, the others go on."""
    rows = table(spark, folder, "events").select("event_id", F.when(F.col("event_id") % 50 != 0, F.col("props")).alias("props"))
    return scoring.scored(rows, "props", lambda: len, "int").select("event_id", "status", F.col("result").alias("value"))


@query("""SELECT vec_id, '{"image":{"path":"v' || vec_id || '"},"system":{"input_within_supported_scope":null},"direct":' || CASE WHEN vec_id % 2 = 0 THEN '{"burden":' || label || '}' ELSE 'null' END || '}' AS json FROM embeddings WHERE vec_id % 2 = 0
    UNION ALL SELECT vec_id, '{"image":{"path":"v' || vec_id || '"},"system":{"input_within_supported_scope":null}}' FROM embeddings WHERE vec_id % 2 = 1""")
def result_json(spark, folder):
    parts = {"image": F.struct(F.concat(F.lit("v"), F.col("vec_id")).alias("path")), "system": F.struct(F.lit(None).cast("boolean").alias("input_within_supported_scope"))}
    return table(spark, folder, "embeddings").select("vec_id", scoring.to_json(parts, {"direct": F.when(F.col("vec_id") % 2 == 0, F.struct(F.col("label").alias("burden")))}).alias("json"))


@query(f"""WITH d AS (SELECT n_chars::DOUBLE AS v, lang, {SPLIT} AS split FROM documents), t AS (SELECT v FROM d WHERE split = 'train')
    SELECT count(*) AS total_samples, count_if(split = 'train') AS train_samples, count_if(split = 'val') AS val_samples, count_if(split = 'test') AS test_samples, count_if(lang = 'en') AS healthy_samples,
    round((SELECT avg(v) FROM t), 4) AS target_train_mean, (SELECT quantile_cont(v, 0.5) FROM t) AS target_train_median, round((SELECT stddev_samp(v) FROM t), 4) AS target_train_std,
    (SELECT min(v) FROM t) AS target_train_min, (SELECT max(v) FROM t) AS target_train_max, (SELECT quantile_cont(v, 0.25) FROM t) AS target_train_q25, (SELECT quantile_cont(v, 0.75) FROM t) AS target_train_q75 FROM d""")
def target_statistics(spark, folder):
    rows = table(spark, folder, "documents").withColumn("split", split_by_id())
    return profile.target_statistics(rows, "n_chars", "split", F.col("lang") == "en").withColumns(rounded("target_train_mean", "target_train_std", digits=4))


@query(f"""WITH d AS (SELECT n_chars::DOUBLE AS v, lang, source, {SPLIT} AS split FROM documents)
    SELECT count(*) AS total, count_if(split = 'train') AS train, count_if(split = 'val') AS val, count_if(split = 'test') AS test, count_if(lang <> 'en') AS diseased, count_if(lang = 'en') AS healthy, count(DISTINCT source) AS classes,
    round(avg(v) FILTER (lang <> 'en'), 4) AS mean_value, quantile_cont(v, 0.5) FILTER (lang <> 'en') AS median_value,
    round(100.0::DOUBLE * count_if(split = 'train') / count(*), 2) AS train_percent, round(100.0::DOUBLE * count_if(split = 'val') / count(*), 2) AS val_percent, round(100.0::DOUBLE * count_if(split = 'test') / count(*), 2) AS test_percent FROM d""")
def manifest_summary(spark, folder):
    rows = table(spark, folder, "documents").withColumn("split", split_by_id())
    return profile.manifest_summary(rows, "split", "source", F.col("lang") == "en", "n_chars").withColumns(rounded("mean_value", digits=4))


@query("SELECT '{' || string_agg('\"' || lang || '\":' || n, ',' ORDER BY lang) || '}' AS frequencies FROM (SELECT lang, count(*) AS n FROM documents WHERE lang IS NOT NULL GROUP BY lang)")
def class_frequency_map(spark, folder):
    return profile.frequency_map(table(spark, folder, "documents"), "lang").select(F.to_json("frequencies").alias("frequencies"))


@query("""SELECT count(*) AS frames, round(count(*)::DOUBLE / (sum(l_extendedprice::DOUBLE) / 1000), 2) AS frames_per_second,
    round(avg(l_extendedprice::DOUBLE), 2) AS latency_ms_mean, round(quantile_cont(l_extendedprice::DOUBLE, 0.5), 2) AS latency_ms_median, round(quantile_cont(l_extendedprice::DOUBLE, 0.95), 2) AS latency_ms_p95,
    round(min(l_extendedprice::DOUBLE), 2) AS latency_ms_min, round(max(l_extendedprice::DOUBLE), 2) AS latency_ms_max,
    round(avg(l_discount::DOUBLE), 4) AS confidence_mean, round(stddev_pop(l_discount::DOUBLE), 4) AS confidence_std, round(min(l_discount::DOUBLE), 4) AS confidence_min, round(max(l_discount::DOUBLE), 4) AS confidence_max,
    round(avg(l_tax::DOUBLE), 4) AS burden_percent_mean, round(stddev_pop(l_tax::DOUBLE), 4) AS burden_percent_std, round(min(l_tax::DOUBLE), 4) AS burden_percent_min, round(max(l_tax::DOUBLE), 4) AS burden_percent_max FROM lineitem""")
def execution_statistics(spark, folder):
    rows = table(spark, folder, "lineitem").select(F.col("l_extendedprice").alias("latency_ms"), F.col("l_discount").alias("confidence"), F.col("l_tax").alias("burden_percent"))
    return inference.execution_statistics(rows)
