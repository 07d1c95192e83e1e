"""Reading driver tables, and tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


#: Bytes of an Arrow batch between JVM and Python: rows differ in length by a factor of thousands, so a number of rows bounds nothing.
ARROW_BATCH = "4m"


def bounded_batches(spark: SparkSession) -> SparkSession:
    """Has the session cut Arrow batches by bytes. Python operators call it before they are planned."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", ARROW_BATCH)
    return spark


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as the cluster names it in ``spark.checkpoint.dir``.

    Only where the setting is absent in a local session (tests) a temporary folder is made,
    once a session; a cluster without the setting is an error, as its machines share no such folder.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("tessera.checkpoint.dir", None)
    if not found:
        if not spark.conf.get("spark.master", "local").startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="tessera-")
        spark.conf.set("tessera.checkpoint.dir", found)
    return found.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table in the shared folder: later reads do not recompute it and survive lost executors."""
    spark, path = bounded_batches(df.sparkSession), fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def dealt(df: DataFrame, key: str, each: int) -> DataFrame:
    """``df`` dealt by a hash of ``key`` into parts of about ``each`` rows, at least one a core: for work that goes by rows, which parts of equal bytes would leave to few tasks."""
    return df.repartition(max(df.sparkSession.sparkContext.defaultParallelism, -(-df.count() // each)), key)
