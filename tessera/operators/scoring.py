"""Models as batched scoring functions: loaded once a worker, one result column, and an error row for each failure."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def scored(df: DataFrame, column: str, load: Callable[[], Callable], result: str) -> DataFrame:
    """``df`` with result, status (ok or error) and error of ``load()`` applied to each value.

    ``load`` runs once in each task; a value on which the model raises gives an error row and
    the batch goes on. One Arrow function returns all three columns, so nothing is scored twice.
    """
    kind = f"result {result}, status string, error string"

    @F.pandas_udf(kind)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        model = load()
        for part in batches:
            found = []
            for value in part:
                try:
                    found.append((model(value), "ok", None))
                except Exception as e:  # noqa: BLE001  (whatever a model raises is that row's error)
                    found.append((None, "error", f"{type(e).__name__}: {e}"))
            yield pd.DataFrame({"result": pd.Series([x[0] for x in found], dtype=object), "status": [x[1] for x in found], "error": pd.Series([x[2] for x in found], dtype=object)})

    return df.withColumn("__scored", run(F.col(column))).select("*", "__scored.*").drop("__scored")


def batch_scored(df: DataFrame, columns: list[str], load: Callable[[], Callable], result: str, batch_size: int = 256, shapes: list[list[int]] | None = None) -> Column:
    """Column of a vectorised model (NumPy arrays in, array out), by Spark's batch prediction function. Array columns need the ``shapes`` of their rows."""
    from pyspark.ml.functions import predict_batch_udf

    return predict_batch_udf(load, return_type=T._parse_datatype_string(result), batch_size=batch_size, input_tensor_shapes=shapes)(*columns)


def warnings(confidence: Column, threshold: float | None) -> Column:
    """Warnings of a prediction: one if the confidence is below the threshold, none without a threshold."""
    none = F.array().cast("array<string>")
    if threshold is None:
        return none
    return F.when(confidence < threshold, F.array(F.format_string(f"confidence %.4f is below the threshold {threshold:.4f}", confidence))).otherwise(none)


def to_json(parts: dict[str, Column], optional: dict[str, Column]) -> Column:
    """JSON of a nested result: explicit nulls inside, but optional parts only where they aren't null."""
    keep = {"ignoreNullFields": "false"}
    text = F.to_json(F.struct(*(c.alias(n) for n, c in parts.items())), keep)
    for name, column in optional.items():
        more = F.to_json(F.struct(column.alias(name)), keep)
        text = F.when(column.isNull(), text).otherwise(F.concat(F.substring(text, F.lit(1), F.length(text) - 1), F.lit(","), F.substring(more, F.lit(2), F.length(more))))
    return text


def class_map_errors(names: dict[str, int], classes: int) -> list[str]:
    """What is wrong with a map of class names to indices: its size, or indices that aren't 0 to classes - 1."""
    found = []
    if len(names) != classes:
        found.append(f"{len(names)} classes, {classes} expected")
    if sorted(names.values()) != list(range(len(names))):
        found.append("indices are not exactly 0 to " + str(len(names) - 1))
    return found


def key_difference(model: list[str], stored: list[str]) -> tuple[list[str], list[str]]:
    """Keys of a model that a checkpoint lacks (an error), and keys that only the checkpoint has (a warning)."""
    return sorted(set(model) - set(stored)), sorted(set(stored) - set(model))
