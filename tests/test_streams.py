"""Intake streams across checkpoints, first batches without a good row, and bounded state."""

import datetime

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from intake.streaming import intake_stream as S

ROW = "id int, k string, ok boolean"
DDL = T.StructType([T.StructField("id", T.IntegerType()), T.StructField("k", T.StringType()), T.StructField("ok", T.BooleanType())])


def land(spark, folder, *rows):
    spark.createDataFrame(list(rows), ROW).coalesce(1).write.mode("append").parquet(folder)


def run(spark, root, landed="landed", checkpoint="ck", on_error="hold"):
    q = S.start_intake(spark, f"{root}/{landed}", ROW, f"{root}/{checkpoint}", f"{root}/ledger", f"{root}/dead", ["k"], "ok", on_error=on_error, buckets=2)
    q.awaitTermination()


def ids(spark, path):
    return sorted(r.id for r in S.read_parts(spark, path, DDL).collect())


def test_two_checkpoints_into_one_ledger(spark, tmp_path):
    root = f"file://{tmp_path}"
    land(spark, f"{root}/landed", (1, "a", True), (2, "b", True))
    run(spark, root)
    land(spark, f"{root}/landed2", (3, "c", True), (4, "a", True), (5, "x", False))
    run(spark, root, "landed2", "ck2", "quarantine")
    assert ids(spark, f"{root}/ledger") == [1, 2, 3]
    land(spark, f"{root}/landed3", (6, "y", False), (7, "d", True))
    run(spark, root, "landed3", "ck3", "quarantine")
    assert ids(spark, f"{root}/ledger") == [1, 2, 3, 7] and ids(spark, f"{root}/dead") == [5, 6]


@pytest.mark.parametrize("on_error", ["hold", "quarantine"])
def test_first_batch_without_a_good_row(spark, tmp_path, on_error):
    root = f"file://{tmp_path}"
    land(spark, f"{root}/landed", (1, "a", False), (2, "b", None))
    if on_error == "hold":
        with pytest.raises(Exception, match="fail"):
            run(spark, root)
        assert ids(spark, f"{root}/ledger") == [] and ids(spark, f"{root}/dead") == [1, 2]
    run(spark, root, on_error="quarantine")
    land(spark, f"{root}/landed", (3, "a", True))
    run(spark, root, on_error=on_error)
    assert ids(spark, f"{root}/ledger") == [3] and ids(spark, f"{root}/dead") == [1, 2]


def test_no_bad_row_at_all(spark, tmp_path):
    root = f"file://{tmp_path}"
    assert ids(spark, f"{root}/dead") == []
    land(spark, f"{root}/landed", (1, "a", True))
    run(spark, root)
    assert ids(spark, f"{root}/dead") == [] and ids(spark, f"{root}/ledger") == [1]


def test_state_falls_after_expiry_and_late_rows_are_counted(spark, tmp_path):
    root, at = f"file://{tmp_path}", lambda m: datetime.datetime(2024, 1, 1) + datetime.timedelta(minutes=m)
    schema = "k string, t timestamp"
    batches = [[("a", 0), ("b", 1)], [("a", 5), ("c", 40)], [("d", 41), ("b", 2)], [("a", 100), ("e", 101)]]
    sizes, late, out = [], 0, None
    with S.state_on_disk(spark):
        for rows in batches:
            spark.createDataFrame([(k, at(m)) for k, m in rows], schema).coalesce(1).write.mode("append").parquet(f"{root}/in")
            stream = S.dedup_stream(spark.readStream.schema(schema).parquet(f"{root}/in"), ["k"], "10 minutes", "t")
            q = stream.writeStream.format("parquet").option("path", f"{root}/out").option("checkpointLocation", f"{root}/ck").trigger(availableNow=True).start()
            q.awaitTermination()
            last = [p for p in q.recentProgress if p["stateOperators"]]
            sizes.append(last[-1]["stateOperators"][0]["numRowsTotal"])
            late += sum(p["stateOperators"][0]["numRowsDroppedByWatermark"] for p in last)
            out = spark.read.parquet(f"{root}/out")
    assert sorted((r.k, r.t.hour * 60 + r.t.minute) for r in out.collect()) == [("a", 0), ("a", 100), ("b", 1), ("c", 40), ("d", 41), ("e", 101)]
    assert late == 1 and sizes[-1] <= 4 and sizes[1] > 0
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass").endswith("HDFSBackedStateStoreProvider")


def test_within_needs_an_event_time(spark):
    with pytest.raises(ValueError, match="together"):
        S.dedup_stream(spark.range(1).withColumn("t", F.current_timestamp()), ["id"], within="1 minute")
