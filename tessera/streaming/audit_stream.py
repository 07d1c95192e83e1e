"""A streaming front end for the batch operators: an addition of ours, the reference has no streams.

New files of records go through the same batch functions by ``foreachBatch``; windowed
counts with a watermark summarise event tables as they grow.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def watch(spark: SparkSession, folder: str, schema: str, audit: Callable[[DataFrame], DataFrame], sink: str, checkpoint: str) -> StreamingQuery:
    """Runs ``audit`` on each micro-batch of new Parquet files and writes its rows below ``sink``.

    A batch overwrites the folder of its own number, so a batch that is run again leaves the same rows.
    """

    def each(batch: DataFrame, number: int) -> None:
        audit(batch).write.mode("overwrite").parquet(f"{sink.rstrip('/')}/batch={number}")

    return spark.readStream.schema(schema).parquet(folder).writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_counts(events: DataFrame, ts: str = "ts", key: str = "event_type", value: str = "value", window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Count and sum by window and key; events later than ``late`` are left out when streaming. The same function runs on batches."""
    return events.withWatermark(ts, late).groupBy(F.window(ts, window).alias("w"), key).agg(F.count("*").alias("n"), F.sum(value).alias("total")).select(F.col("w.start").alias("start"), key, "n", "total")
