"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import ctypes
import os
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from functools import wraps

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Arrow's own pool keeps what it has freed; with the system's, a worker falls back after a large batch, and executors stay small.
pa.set_memory_pool(pa.system_memory_pool())

#: The bytes that separate words in every operator here; `bytes.split()` without an argument splits at just these.
ASCII_SPACE = b"\x20\x09\x0a\x0b\x0c\x0d"

_LIBC = ctypes.CDLL(None)


def tidy(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """`run`, after which the worker hands freed memory back to the system, where its C library can. Workers wait for their next task, and a heap
    that has grown on one task would stay with them."""

    def tidied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            trim_heap()

    return tidied


def trim_heap() -> None:
    if trim := getattr(_LIBC, "malloc_trim", None):
        trim(0)


#: Rows with texts are long: counted by thousands of rows, a batch of them is tens of MB, held in the executor and in its worker at once.
_BATCHES = {"spark.sql.execution.arrow.maxBytesPerBatch": str(4 << 20), "spark.sql.parquet.columnarReaderBatchSize": "512"}


def in_small_batches(stage: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """`stage` (session first), for whose session batches of rows are bounded by 4 MB from then on, unless the user has set their size. Results are
    formed after the call, so the setting stays. It changes no row of them."""

    @wraps(stage)
    def bounded(spark: SparkSession, *args, **how) -> DataFrame:
        for key, value in _BATCHES.items():
            spark.conf.set(key, spark.conf.get(key, value))
        return stage(spark, *args, **how)

    return bounded


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: `spark.checkpoint.dir`. Only a local session may leave it unset and gets one of its own."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors reach")
        found = "file://" + tempfile.mkdtemp(prefix="spark-")
        spark.sparkContext.setCheckpointDir(found)
        found = spark.sparkContext.getCheckpointDir()
    return found if "://" in found or found.startswith("file:") else "file://" + os.path.abspath(found)


def new_folder(spark: SparkSession, name: str) -> str:
    """A fresh, empty place in the shared folder; nothing is created yet."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """Spark removes the shuffle files of queries that run inside: for those whose result is written or collected, and not read again."""
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(_CLEANUP, before)


def stored(df: DataFrame, name: str) -> DataFrame:
    """`df` written as Parquet to the shared folder and read again: cuts the lineage and survives the loss of executors.

    The shuffle files behind it are not needed any more then, and Spark removes them.
    """
    spark = df.sparkSession
    path = new_folder(spark, name)
    with shuffles_removed(spark):
        df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def spread_join(rows: DataFrame, table: DataFrame, key: str, how: str = "inner", counts: DataFrame | None = None, total: int | None = None, share: int = 1000, salts: int = 64) -> DataFrame:
    """`rows` joined with `table` on `key`, whatever share of the rows one key holds. how: inner or left.

    Keys with more than 1/`share` of the rows (at most `share` of them, so their list is broadcast) are dealt over `salts` tasks, and the
    table's rows of those keys go to each of them. counts (key, _n) and total: the rows of each key and of all, where they are known.
    Give stored tables: they are read twice.
    """
    least = max((rows.count() if total is None else total) // share, 10_000)
    counts = rows.groupBy(key).agg(F.count(F.lit(1)).alias("_n")) if counts is None else counts
    hot = counts.where(F.col("_n") > least).select(key, F.lit(True).alias("_hot"))
    salt = F.when(F.col("_hot"), F.pmod(F.xxhash64(*rows.columns), F.lit(salts)).cast("int")).otherwise(0)
    copies = F.when(F.col("_hot"), F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))
    left = rows.join(F.broadcast(hot), key, "left").withColumn("_salt", salt).drop("_hot")
    right = table.join(F.broadcast(hot), key, "left").withColumn("_salt", F.explode(copies)).drop("_hot")
    return left.join(right, [key, "_salt"], how).drop("_salt")


def text_bytes(docs: DataFrame, text: str = "text") -> DataFrame:
    """doc_id and the text as UTF-8 bytes (null stays null)."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text).cast("binary").alias("text"))
