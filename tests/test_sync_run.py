"""A mailbox's runs: a held batch, an expired cursor, counters that equal run_metrics of the same outcomes."""

import datetime

import pytest
from pyspark.sql import functions as F

from intake.sources.batches import run_metrics
from intake.streaming.sync_run import Sync

HISTORY = "history_id long, record_type string, message_id string"
LEDGER = "id long, message_id string, part_id string, origin_hash string, mode string"


def table(spark):
    day = lambda d: datetime.datetime(2024, 1, 1) + datetime.timedelta(days=d)
    return spark.createDataFrame([(f"m{i}", day(i)) for i in range(40)], "message_id string, received timestamp_ntz")


def analyse(bad=()):
    def run(messages):
        parts = F.explode(F.array(*(F.struct(F.lit(k).alias("part_id"), F.lit(o).alias("outcome")) for k, o in (("1", "invoice"), ("2", "review"), ("3", "discarded")))))
        number = F.substring("message_id", 2, 9).cast("long")
        rows = messages.select("message_id", number.alias("_n"), parts.alias("p")).select((F.col("_n") * 10 + F.col("p.part_id").cast("long")).alias("id"), "message_id", "p.part_id", F.md5("message_id").alias("origin_hash"), "p.outcome")
        return rows.withColumn("outcome", F.when(F.col("message_id").isin(*bad) & (F.col("part_id") == "2"), "error").otherwise(F.col("outcome")))

    return run


def land(spark, root, folder, *rows):
    spark.createDataFrame([(h, "messageAdded", m) for h, m in rows], HISTORY).coalesce(1).write.mode("append").parquet(f"{root}/{folder}")


def run(spark, root, folder="h", day=20, bad=(), **how):
    sync = Sync(spark, root, 7, table(spark).where(F.col("received") <= F.lit(f"2024-01-{day:02d}").cast("timestamp_ntz")), analyse(bad), LEDGER, days=3, buckets=2)
    mode = sync.sync(f"{root}/{folder}", HISTORY, F.lit(f"2024-01-{day:02d} 00:00:00").cast("timestamp_ntz"), **how)
    return sync, mode


def stored(sync):
    rows = [(r.message_id, r.part_id) for r in sync.ledger.read().collect()]
    assert len(rows) == len(set(rows))
    return sorted({m for m, _ in rows}, key=lambda m: int(m[1:]))


def same_as_run_metrics(sync):
    want = {r.run_id: r for r in run_metrics(sync.outcomes().select(F.coalesce("run_id", F.lit("none")).alias("run_id"), F.col("message_id").alias("message"), "outcome", F.col("first_new").alias("is_new")).where("run_id <> 'none'")).collect()}
    for r in sync.metrics().collect():
        if r.run_id in want and not r.missing:
            assert all(r[c] == want[r.run_id][c] for c in ("found", "new_messages", "analysed", "containers", "entries", "invoices", "reviews", "discarded", "existing", "errors"))
    return want


def test_runs_with_an_expiring_cursor(spark, tmp_path):
    root = f"file://{tmp_path}"
    land(spark, root, "h", (5, "m1"), (9, "m2"))
    sync, mode = run(spark, root)
    assert mode == "initial" and sync.account()[0] == 9 and stored(sync) == ["m16", "m17", "m18", "m19"]
    first = sync.account()[1]
    land(spark, root, "h", (10, "m3"), (11, "m19"), (12, " "))
    land(spark, root, "h", (13, "m99"), (14, "m4"))
    sync, mode = run(spark, root)
    assert mode == "incremental" and sync.account() == (14, first) and stored(sync) == ["m3", "m4", "m16", "m17", "m18", "m19"]
    assert len(sync.runs) == 2 and sum(r["existing"] for r in sync.runs) == 2 and sum(r["missing"] for r in sync.runs) == 1
    assert run(spark, root)[0].runs == []
    land(spark, root, "later", (50, "m20"))
    sync, mode = run(spark, root, "later", 25)
    assert mode == "fallback" and sync.account()[0] == 50 and sync.account()[1] != first
    assert stored(sync) == ["m3", "m4", "m16", "m17", "m18", "m19", "m21", "m22", "m23", "m24"]
    land(spark, root, "later", (51, "m20"), (52, "m3"))
    sync, mode = run(spark, root, "later", 25)
    assert mode == "incremental" and stored(sync)[6] == "m20" and sync.account()[0] == 52
    assert len(same_as_run_metrics(sync)) == 5 and sync.metrics().count() == 5
    assert [r.fallback for r in sync.metrics().where("mode = 'fallback'").collect()] == [True]


def test_a_batch_with_errors_holds_the_cursor(spark, tmp_path):
    root = f"file://{tmp_path}"
    land(spark, root, "h", (1, "m1"))
    with pytest.raises(Exception, match="errors"):
        run(spark, root, bad=["m18"])
    sync, _ = run(spark, root)
    assert sync.account()[0] == 1 and sync.runs[0]["existing"] == 7
    land(spark, root, "h", (2, "m2"), (3, "m3"))
    for _ in range(2):
        with pytest.raises(Exception, match="errors"):
            run(spark, root, bad=["m3"])
        assert sync.account()[0] == 1 and stored(sync)[:2] == ["m2", "m3"]
    assert sync.ledger.read().where("message_id = 'm3'").count() == 1
    done, _ = run(spark, root, bad=["m3"], on_error="quarantine")
    assert done.account()[0] == 3 and done.runs[0]["errors"] == 1
    land(spark, root, "h", (4, "m3"))
    done, _ = run(spark, root)
    assert done.ledger.read().where("message_id = 'm3'").count() == 2 and done.account()[0] == 4
    same_as_run_metrics(done)


def test_no_history_and_no_message(spark, tmp_path):
    root = f"file://{tmp_path}"
    spark.createDataFrame([], HISTORY).write.parquet(f"{root}/h")
    sync, mode = run(spark, root, day=1)
    assert mode == "initial" and sync.account()[0] == 0 and stored(sync) == ["m0"]
    land(spark, root, "h", (1, "m5"))
    sync, mode = run(spark, root)
    assert mode == "incremental" and "m5" in stored(sync)
