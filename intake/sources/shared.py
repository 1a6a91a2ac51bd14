"""The folder that the driver and all executors share, for what a job cuts its lineage with."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """`spark.checkpoint.dir`. Only a local session may leave it unset and gets a folder of its own."""
    context = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not found:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors reach")
        context.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="spark-"))
        found = context.getCheckpointDir()
    return found if ":/" in found else "file://" + os.path.abspath(found)


def new_folder(spark: SparkSession, name: str) -> str:
    """A fresh, empty place in the shared folder; nothing is created yet."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def checkpointed(df: DataFrame) -> DataFrame:
    """`df` written to the shared folder once and read from there: as Parquet, a fraction of a checkpoint's plain rows, of which later steps read
    the columns that they need."""
    path = new_folder(df.sparkSession, "rows")
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def dealt_by(df: DataFrame, *keys: str) -> Iterator[DataFrame]:
    """`df` written to the shared folder once, in buckets by these columns: joins and groupings by them read it as often as they like and shuffle none of
    its rows. Rows that are dealt by the columns already are not shuffled for it either. The catalog knows the table inside only; its files stay."""
    spark, folder = df.sparkSession, new_folder(df.sparkSession, "dealt")
    name = folder.rpartition("/")[2].replace("-", "_")
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    df.repartition(tasks, *keys).write.option("compression", "zstd").option("path", folder).bucketBy(tasks, *keys).saveAsTable(name, format="parquet")
    try:
        yield spark.table(name)
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {name}")
