"""Incremental intake: landed files are read as a stream, each micro-batch is written once, an error holds the cursor.

The checkpoint is the cursor. A batch with a bad row writes its good rows and its bad rows, and then raises, so that it is not committed
and comes again; the ledger's rows of one batch of one stream are replaced as a whole and earlier ones are never written twice, so a replay
changes nothing. With `on_error='quarantine'` bad rows are put aside and the cursor moves on.

The ledger is partitioned by a hash of the key, then by the stream (the id that its checkpoint keeps) and the batch: a new checkpoint counts
its batches from 0 again and is another stream. A micro-batch looks its keys up in the partitions that they fall in, not in all of it.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator, Sequence
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from ..operators.ledger import first_of_key, insert_if_absent

BUCKETS = 64


class BatchHeld(RuntimeError):
    """A micro-batch had errors; its good rows are written, its cursor is not."""


def dedup_stream(df: DataFrame, keys: Sequence[str], within: str | None = None, event_time: str | None = None) -> DataFrame:
    """First row of each key. With `within` (such as '10 minutes') and the event time, rows later than that are dropped, and a key is
    forgotten that long after its row, so the state follows the rate of the stream, not its age. Without, every key is kept for ever."""
    if (within is None) != (event_time is None):
        raise ValueError("within and event_time go together")
    return df.withWatermark(event_time, within).dropDuplicatesWithinWatermark(list(keys)) if within else df.dropDuplicates(list(keys))


@contextmanager
def state_on_disk(spark: SparkSession) -> Iterator[None]:
    """Streams that start inside keep their state in RocksDB, on the executors' disks and in the checkpoint, not on the heap."""
    name, store = "spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
    before = spark.conf.get(name, None)
    spark.conf.set(name, store)
    try:
        yield
    finally:
        spark.conf.set(name, before) if before else spark.conf.unset(name)


def stream_id(spark: SparkSession, checkpoint: str) -> str:
    """The id that a stream keeps in its checkpoint through all its restarts."""
    return json.loads(spark.read.text(f"{checkpoint}/metadata").first()[0])["id"]


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def read_parts(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """What an intake wrote to its ledger or its dead letters, which is nothing before its first row."""
    if not _exists(spark, path):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(path).select(*schema.names)


def _with(schema: T.StructType, **more: T.DataType) -> T.StructType:
    return T.StructType([*(T.StructField(f.name, f.dataType) for f in schema), *(T.StructField(n, t) for n, t in more.items())])


def append_once(df: DataFrame, path: str, keys: Sequence[str], batch_id: int, order: Sequence[str], buckets: int = BUCKETS, stream: str = "") -> None:
    """The first row of each key that no other batch wrote, under its bucket and this batch's partition; a replay replaces that partition."""
    spark = df.sparkSession
    new = first_of_key(df, keys, order).withColumn("bucket", F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int"))
    if _exists(spark, path):
        touched = [r["bucket"] for r in new.select("bucket").distinct().collect()]  # at most `buckets` numbers
        own = (F.col("stream") == stream) & (F.col("batch_id") == batch_id)
        known = read_parts(spark, path, _with(df.schema, bucket=T.IntegerType(), stream=T.StringType(), batch_id=T.LongType())).where(F.col("bucket").isin(touched) & ~own)
        new = insert_if_absent(known, new, [*keys, "bucket"], order)[0]
    dealt = new.withColumn("stream", F.lit(stream)).withColumn("batch_id", F.lit(batch_id)).repartition("bucket")
    dealt.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket", "stream", "batch_id").parquet(path)


def process_batch(df: DataFrame, batch_id: int, ledger: str, dead: str, keys: Sequence[str], order: Sequence[str], check: str, on_error: str = "hold", buckets: int = BUCKETS, stream: str = "") -> None:
    """Writes rows that pass `check` (SQL) to the ledger and the others to the dead letters; then holds the batch, or not."""
    if on_error not in ("hold", "quarantine"):
        raise ValueError(on_error)
    good = F.coalesce(F.expr(check), F.lit(False))
    append_once(df.where(good), ledger, keys, batch_id, order, buckets, stream)
    bad = df.where(~good).withColumn("stream", F.lit(stream)).withColumn("batch_id", F.lit(batch_id))
    bad.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("stream", "batch_id").parquet(dead)
    if on_error == "hold" and not bad.isEmpty():
        raise BatchHeld(f"batch {batch_id} has rows that fail: {check}")


def start_intake(
    spark: SparkSession, landed: str, schema: T.StructType | str, checkpoint: str, ledger: str, dead: str, keys: Sequence[str],
    check: str, order: Sequence[str] = ("id",), on_error: str = "hold", transform: Callable[[DataFrame], DataFrame] | None = None, buckets: int = BUCKETS,
) -> StreamingQuery:
    """All that landed since the last run, as one query that ends when it has caught up. Keys that came before fall out at the ledger, so the
    stream itself keeps no state; `transform` may add some."""
    stream = spark.readStream.schema(schema).parquet(landed)
    stream = transform(stream) if transform else stream

    def each(df: DataFrame, batch_id: int) -> None:
        process_batch(df, batch_id, ledger, dead, keys, order, check, on_error, buckets, stream_id(spark, checkpoint))

    return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
