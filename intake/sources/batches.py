"""Which messages a run takes: the first snapshot, what came after a cursor, and what became of it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read_tables(spark, path: str, schemas: dict[str, T.StructType | str]) -> dict[str, DataFrame]:
    """The named tables under `path`, with the columns of their schemas only."""
    out = {}
    for name, schema in schemas.items():
        fields = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
        out[name] = spark.read.schema(fields).parquet(f"{path}/{name}.parquet")
    return out


def initial_batch(messages: DataFrame, as_of: Column, days: int = 30, limit: int = 100) -> DataFrame:
    """message_id of the newest messages of the last `days` days, at most `limit`: the first run's batch."""
    recent = messages.where((F.trim("message_id") != "") & (F.col("received") >= as_of - F.make_dt_interval(F.lit(days))))
    once = recent.groupBy("message_id").agg(F.max("received").alias("received"))
    return once.orderBy(F.desc("received"), "message_id").limit(limit).select("message_id")


def distinct_ids(history: DataFrame) -> DataFrame:
    return history.where(F.trim("message_id") != "").select("message_id").distinct()


def incremental_batch(history: DataFrame, cursor: int) -> tuple[DataFrame, DataFrame]:
    """(message_id of messages added after the cursor, one row with the new cursor). Cursors compare as numbers."""
    after = history.where(F.col("history_id") > cursor)
    return distinct_ids(after.where("record_type = 'messageAdded'")), after.agg(F.max("history_id").alias("cursor"))


def select_batch(messages: DataFrame, history: DataFrame, cursor: int | None, as_of: Column, days: int = 30, limit: int = 100) -> DataFrame:
    """message_id, mode: 'initial' without a cursor, 'incremental' with one, 'fallback' (the first run's batch again) where history
    does not reach back to it. The oldest history id is one number; the branch is taken on the driver."""
    if cursor is None:
        return initial_batch(messages, as_of, days, limit).withColumn("mode", F.lit("initial"))
    oldest = history.agg(F.min("history_id")).first()[0]
    if oldest is not None and cursor < oldest:
        return backfill(messages, as_of, days, limit)
    return incremental_batch(history, cursor)[0].withColumn("mode", F.lit("incremental"))


def backfill(messages: DataFrame, as_of: Column, days: int = 30, limit: int = 100) -> DataFrame:
    """The bounded batch after a cursor expired; what was stored before falls out at the insert."""
    return initial_batch(messages, as_of, days, limit).withColumn("mode", F.lit("fallback"))


def part_bytes(parts: DataFrame, payloads: DataFrame) -> DataFrame:
    """`data` (base64url) of each part: fetched by its attachment id where it has one, else inline."""
    fetched = payloads.select("message_id", "attachment_id", F.col("data").alias("_fetched"))
    met = parts.join(fetched, ["message_id", "attachment_id"], "left")
    located = F.coalesce(F.trim("attachment_id"), F.lit("")) != ""
    return met.withColumn("data", F.when(located, F.col("_fetched")).otherwise(F.col("inline_data"))).drop("_fetched")


def split_missing(ids: DataFrame, messages: DataFrame) -> DataFrame:
    """message_id, found: messages that vanished meanwhile are counted, not errors."""
    there = messages.select("message_id").distinct().withColumn("_there", F.lit(True))
    return ids.join(there, "message_id", "left").select("message_id", F.col("_there").isNotNull().alias("found"))


OUTCOMES = ("invoice", "review", "discarded", "existing", "error", "missing")


def run_metrics(outcomes: DataFrame) -> DataFrame:
    """Counters of each run over outcomes: run_id, message, outcome (one of OUTCOMES), and, where they are there, is_new (the message was
    stored by this run), n_containers, n_entries, fallback. Analysed are parts that were decoded: neither errors nor missing ones.
    An existing document counts as found and analysed, and as existing. One aggregation, whatever the number of runs."""
    of = lambda k: F.count_if(F.col("outcome") == k)
    optional = lambda name, default: F.coalesce(F.col(name), default) if name in outcomes.columns else default
    return outcomes.groupBy("run_id").agg(
        F.count_distinct("message").alias("found"),
        F.count_distinct(F.when(optional("is_new", F.lit(False)), F.col("message"))).alias("new_messages"),
        F.count_if(~F.col("outcome").isin("error", "missing")).alias("analysed"),
        F.sum(optional("n_containers", F.lit(0)).cast("long")).alias("containers"),
        F.sum(optional("n_entries", F.lit(0)).cast("long")).alias("entries"),
        of("invoice").alias("invoices"), of("review").alias("reviews"), of("discarded").alias("discarded"),
        of("existing").alias("existing"), of("error").alias("errors"), of("missing").alias("missing"),
        F.bool_or(optional("fallback", F.lit(False))).alias("fallback"),
    )


def all_candidates(direct: DataFrame, entries: DataFrame, containers: DataFrame) -> DataFrame:
    """Direct documents, container entries, and containers that could not be read, in one table."""
    return direct.unionByName(entries, allowMissingColumns=True).unionByName(containers, allowMissingColumns=True)
