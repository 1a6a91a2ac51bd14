"""One run of an account's mailbox: what came since its cursor, or the bounded first batch again where there is no cursor or it expired.

    run = Sync(spark, root, account_id, messages, analyse)
    run.sync(landed_history, schema, as_of)

A run without a usable cursor takes the newest messages of the last days as one batch, sets the cursor to the end of the history that is
there, and opens a new checkpoint behind it; from then on the history is a stream, one micro-batch after the other. Each batch writes
its documents to the ledger (a keyed table, rows once only), its outcomes, and its counters, and commits the cursor last and only with
0 errors. A batch with errors is held: its good documents are stored, the cursor stays, and the next run meets the same batch again.

Counters are observed while the outcomes are written; no row is read a second time for them.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.keyed_table import KeyedTable
from ..operators.ledger import advance_cursor, exists_flag
from ..sources.batches import distinct_ids, initial_batch, split_missing
from ..sources.shared import checkpointed
from .intake_stream import BatchHeld, stream_id

ACCOUNTS = "id long, last_history_id string, last_query timestamp_ntz, checkpoint string"
KEPT = ("invoice", "review")


def counters(outcomes: DataFrame) -> list[Column]:
    """`batches.run_metrics` of one run as aggregates without DISTINCT. outcomes: message_id, outcome, first_of_message, first_new."""
    of = lambda k: F.count_if(F.col("outcome") == k)
    optional = lambda name: F.coalesce(F.col(name), F.lit(0)) if name in outcomes.columns else F.lit(0)
    return [
        F.count_if("first_of_message").alias("found"), F.count_if("first_new").alias("new_messages"), F.count_if(~F.col("outcome").isin("error", "missing")).alias("analysed"),
        F.coalesce(F.sum(optional("n_containers").cast("long")), F.lit(0)).alias("containers"), F.coalesce(F.sum(optional("n_entries").cast("long")), F.lit(0)).alias("entries"),
        of("invoice").alias("invoices"), of("review").alias("reviews"), of("discarded").alias("discarded"), of("existing").alias("existing"), of("error").alias("errors"), of("missing").alias("missing"),
    ]


@dataclass
class Sync:
    """messages: message_id, received and what `analyse` needs. analyse(messages) gives candidates: id, message_id, part_id, origin_hash, outcome
    (invoice, review, discarded or error) and columns of the ledger."""

    spark: SparkSession
    root: str
    account_id: int
    messages: DataFrame
    analyse: Callable[[DataFrame], DataFrame]
    ledger_schema: str
    days: int = 30
    limit: int = 100
    buckets: int = 64
    files_per_batch: int = 1
    runs: list[dict] = field(default_factory=list)

    @property
    def accounts(self) -> KeyedTable:
        return KeyedTable.open(self.spark, f"{self.root}/accounts", ACCOUNTS, ["id"], 1)

    @property
    def ledger(self) -> KeyedTable:
        return KeyedTable.open(self.spark, f"{self.root}/ledger", self.ledger_schema, ["message_id", "part_id", "origin_hash"], self.buckets)

    def account(self) -> tuple[int | None, str | None]:
        """The committed cursor and the checkpoint that goes on from it."""
        row = self.accounts.read().where(F.col("id") == self.account_id).first()
        return (None, None) if row is None or row["last_history_id"] is None else (int(row["last_history_id"]), row["checkpoint"])

    def _commit(self, errors: int, cursor: int | None, as_of: Column, checkpoint: str | None = None) -> None:
        """Cursor and checkpoint of the account; nothing with errors."""
        run = self.spark.createDataFrame([(self.account_id, self.account_id, errors, None if cursor is None else str(cursor), checkpoint)], "id long, account_id long, errors int, cursor string, checkpoint string")

        def change(old: DataFrame, new: DataFrame) -> DataFrame:
            known = old.unionByName(new.select("id").join(old.select("id"), "id", "left_anti"), allowMissingColumns=True)
            done = advance_cursor(known, new, as_of)
            opened = new.where("errors = 0").select("id", F.col("checkpoint").alias("_opened"))
            return done.join(opened, "id", "left").withColumn("checkpoint", F.coalesce("_opened", "checkpoint")).drop("_opened")

        self.accounts.rewrite(run, change)

    def _store(self, ids: DataFrame, run_id: str, mode: str) -> int:
        """Documents of these messages to the ledger, their outcomes, and the run's counters. Gives the number of errors."""
        ids = checkpointed(ids)
        found = checkpointed(self.messages.join(ids, "message_id", "left_semi"))  # all messages are met once; the batch's are few
        seen = split_missing(ids, found)
        candidates = self.analyse(found).withColumns({"run_id": F.lit(run_id), "mode": F.lit(mode)})
        candidates = checkpointed(candidates)
        table, keys = self.ledger, list(self.ledger.keys)
        kept = candidates.where(F.col("outcome").isin(*KEPT))
        old = table.rows_of(table.touched(kept))
        place = F.row_number().over(Window.partitionBy(*keys, F.col("outcome").isin(*KEPT)).orderBy("id"))
        flagged = exists_flag(old, candidates, keys).withColumn("present", F.col("outcome").isin(*KEPT) & (F.col("present") | (place > 1)))
        outcome = F.when(F.col("present"), "existing").otherwise(F.col("outcome"))
        rows = seen.join(flagged.withColumn("outcome", outcome), "message_id", "left").withColumn("outcome", F.when(~F.col("found"), "missing").otherwise(F.col("outcome")))
        stored = F.coalesce(F.col("outcome").isin(*KEPT), F.lit(False))
        nth = lambda *by: F.row_number().over(Window.partitionBy("message_id", *by).orderBy("id"))
        rows = rows.withColumns({"first_of_message": nth() == 1, "first_new": stored & (nth(stored) == 1)}).drop("found", "present")
        observed = Observation(f"run {run_id} {uuid.uuid4().hex}")
        rows.observe(observed, *counters(rows)).write.mode("overwrite").parquet(f"{self.root}/outcomes/run={run_id}")
        table.insert(kept, ["id"])
        found = {**observed.get, "run_id": run_id, "mode": mode, "fallback": mode == "fallback"}
        self.spark.createDataFrame([found], self.metrics_schema()).coalesce(1).write.mode("overwrite").parquet(f"{self.root}/metrics/run={run_id}")
        self.runs.append(found)
        return found["errors"]

    @staticmethod
    def metrics_schema() -> T.StructType:
        names = ("found", "new_messages", "analysed", "containers", "entries", "invoices", "reviews", "discarded", "existing", "errors", "missing")
        return T.StructType([T.StructField("run_id", T.StringType()), T.StructField("mode", T.StringType()), *(T.StructField(n, T.LongType()) for n in names), T.StructField("fallback", T.BooleanType())])

    def metrics(self) -> DataFrame:
        """One row for each run and micro-batch; a batch that came again has the counters of its last turn."""
        return self.spark.read.schema(self.metrics_schema()).parquet(f"{self.root}/metrics/*")

    def outcomes(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.root}/outcomes/*")

    def sync(self, history: str, schema: T.StructType | str, as_of: Column, on_error: str = "hold") -> str:
        """One run over the history that landed under `history`; gives the way it was taken: initial, fallback or incremental.

        Raises BatchHeld after a batch with errors; with on_error='quarantine' errors stay in the outcomes and the cursor moves on.
        """
        cursor, checkpoint = self.account()
        landed = self.spark.read.schema(schema).parquet(history)
        oldest, newest = landed.agg(F.min("history_id"), F.max("history_id")).first()
        mode = "initial" if cursor is None else "fallback" if cursor and oldest is not None and cursor < oldest else "incremental"  # 0: before all history
        if mode != "incremental":
            cursor, checkpoint = newest if newest is not None else cursor or 0, f"{self.root}/checkpoints/{uuid.uuid4().hex}"
            errors = self._store(initial_batch(self.messages, as_of, self.days, self.limit), f"{mode}-{cursor}", mode)
            if errors and on_error == "hold":
                raise BatchHeld(f"the {mode} batch has {errors} errors")
            self._commit(0, cursor, as_of, checkpoint)
        start = cursor

        def each(df: DataFrame, batch_id: int) -> None:
            new = checkpointed(df.where(F.col("history_id") > start))
            last = new.agg(F.max("history_id")).first()[0]
            if last is None:
                return
            run_id = f"{stream_id(self.spark, checkpoint)}-{batch_id:08d}"
            errors = self._store(distinct_ids(new.where("record_type = 'messageAdded'")), run_id, "incremental")
            if errors and on_error == "hold":
                raise BatchHeld(f"batch {batch_id} has {errors} errors")
            self._commit(0, max(last, self.account()[0] or 0), as_of)

        stream = self.spark.readStream.schema(schema).option("maxFilesPerTrigger", self.files_per_batch).parquet(history)
        stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
        return mode
