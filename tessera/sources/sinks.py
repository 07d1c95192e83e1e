"""Writing reports and results: one folder a table, through Spark's writers."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def write_report(tables: dict[str, DataFrame], folder: str, form: str = "parquet") -> list[str]:
    """Each table below ``folder``; nested columns become JSON where the form is CSV. Returns the paths."""
    paths = []
    for name, df in tables.items():
        path = f"{folder.rstrip('/')}/{name}"
        if form == "csv":
            flat = [F.to_json(f.name).alias(f.name) if isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType)) else F.col(f.name) for f in df.schema.fields]
            df.select(*flat).write.mode("overwrite").csv(path, header=True)
        else:
            df.write.mode("overwrite").format(form).save(path)
        paths.append(path)
    return paths


def write_predictions(results: DataFrame, folder: str) -> None:
    """All rows as a table, and the JSON of the successes. The rows are written once and read back for the second output."""
    table = f"{folder.rstrip('/')}/predictions"
    results.write.mode("overwrite").parquet(table)
    results.sparkSession.read.parquet(table).where("status = 'ok'").drop("status", "error").write.mode("overwrite").json(f"{folder.rstrip('/')}/results")


# Columns of a batch's predictions.
PREDICTION_COLUMNS = ["image", "status", "error", "predicted_class", "confidence", "top2_class", "top2_confidence", "confidence_margin", "normalized_entropy", "lesion_burden", "burden_percent", "warning_count"]


def write_summary(summary: DataFrame, folder: str, name: str) -> str:
    """A table of one row as one JSON object, nulls included. Returns the path."""
    path = f"{folder.rstrip('/')}/{name}"
    summary.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("value")).coalesce(1).write.mode("overwrite").text(path)
    return path


def write_class_map(classes: DataFrame, name: str, folder: str) -> str:
    """``class_to_idx``: the distinct values of a column in order with indices from 0, as one JSON object. Classes are few."""
    values = classes.select(name).where(F.col(name).isNotNull()).distinct().agg(F.array_sort(F.collect_list(name)).alias("names"))
    entries = F.map_from_entries(F.transform("names", lambda x, i: F.struct(x, i)))
    path = f"{folder.rstrip('/')}/class_to_idx"
    values.select(F.to_json(entries).alias("value")).coalesce(1).write.mode("overwrite").text(path)
    return path


def write_described(by_class: DataFrame, by_split: DataFrame, folder: str) -> list[str]:
    """The two tables of a target's statistics, as CSV with a header."""
    return write_report({"target_by_class": by_class, "target_by_split": by_split}, folder, "csv")


def write_batch_predictions(results: DataFrame, folder: str) -> str:
    """The rows' twelve prediction columns as CSV; those of errors are empty."""
    path = f"{folder.rstrip('/')}/predictions.csv"
    results.select(*PREDICTION_COLUMNS).write.mode("overwrite").csv(path, header=True, nullValue="")
    return path


def write_telemetry(frames: DataFrame, statistics: DataFrame, checkpoints: dict, folder: str) -> list[str]:
    """Frame rows as CSV, execution statistics as JSON, and metadata of the models as JSON."""
    paths = write_report({"per_sampled_frame_predictions": frames}, folder, "csv")
    metadata = frames.sparkSession.createDataFrame([(json.dumps(checkpoints, sort_keys=True),)], "value string")
    metadata.coalesce(1).write.mode("overwrite").text(f"{folder.rstrip('/')}/model_checkpoint_metadata")
    return [*paths, write_summary(statistics, folder, "inference_execution_summary"), f"{folder.rstrip('/')}/model_checkpoint_metadata"]
