import os

import pytest
from pyspark.sql import functions as F

from intake.operators.keyed_table import Conflict, KeyedTable

SCHEMA = "k long, part string, v string, n int"


def opened(spark, path, buckets=8):
    return KeyedTable.open(spark, f"file://{path}/t", SCHEMA, ["k", "part"], buckets)


def rows(spark, *data):
    return spark.createDataFrame(list(data), SCHEMA)


def held(table):
    return sorted((tuple(r) for r in table.read().collect()), key=str)


def test_merges_equal_the_plain_upsert(spark, tmp_path):
    table = opened(spark, tmp_path)
    assert held(table) == [] and table.version == 0
    table = table.merge(rows(spark, (1, "a", "x", 1), (2, None, "y", 2), (None, None, "z", 3)), update=["v"])
    table = table.merge(rows(spark, (2, None, None, None), (3, "c", "w", 9), (None, None, "zz", None)), update=["v"], coalesce=["n"])
    assert held(KeyedTable.open(spark, table.path)) == sorted([(1, "a", "x", 1), (2, None, None, 2), (None, None, "zz", 3), (3, "c", "w", 9)], key=str)
    assert table.version == 2


def test_untouched_buckets_keep_their_files(spark, tmp_path):
    table = opened(spark, tmp_path)
    table = table.merge(spark.range(100).select(F.col("id").alias("k"), F.lit("p").alias("part"), F.lit("v").alias("v"), F.lit(0).alias("n")))
    batch = rows(spark, (7, "p", "new", 1))
    touched = table.touched(batch)
    after = table.merge(batch, update=["v"])
    assert len(touched) == 1 and len(table.manifest.files) > 4
    for b, files in table.manifest.files.items():
        assert (after.manifest.files[b] == files) == (b not in touched)
    assert after.rows_of(touched).count() == table.rows_of(touched).count() and after.read().where("v = 'new'").count() == 1
    added = [f for files in after.manifest.files.values() for f in files if f not in [x for y in table.manifest.files.values() for x in y]]
    assert len(added) == 1


def test_insert_adds_files_and_is_idempotent(spark, tmp_path):
    table = opened(spark, tmp_path)
    batch = rows(spark, (1, "a", "x", 1), (1, "a", "y", 0), (2, None, "z", 5))
    one, existing = table.insert(batch, ["n"])
    assert held(one) == [(1, "a", "y", 0), (2, None, "z", 5)] and existing.count() == 0
    two, existing = one.insert(batch, ["n"])
    assert two.version == one.version and existing.count() == 3
    three, _ = one.insert(rows(spark, (1, "b", "q", 1), (2, None, "no", 1)), ["n"])
    assert held(three) == [(1, "a", "y", 0), (1, "b", "q", 1), (2, None, "z", 5)]
    assert all(f in [x for y in three.manifest.files.values() for x in y] for files in one.manifest.files.values() for f in files)


def test_second_writer_is_refused(spark, tmp_path):
    start = opened(spark, tmp_path).merge(rows(spark, (1, "a", "x", 1)))
    mine, theirs = KeyedTable.open(spark, start.path), KeyedTable.open(spark, start.path)
    mine.merge(rows(spark, (1, "a", "mine", 1)), update=["v"])
    with pytest.raises(Conflict):
        theirs.merge(rows(spark, (1, "a", "theirs", 1)), update=["v"])
    assert held(KeyedTable.open(spark, start.path)) == [(1, "a", "mine", 1)]
    assert held(start) == [(1, "a", "x", 1)]  # readers keep their version
    newest = KeyedTable.open(spark, start.path)
    assert newest.vacuum() == 2 and held(newest) == [(1, "a", "mine", 1)]


def test_a_task_that_dies_leaves_the_old_version(spark, tmp_path):
    start = opened(spark, tmp_path).merge(rows(spark, (1, "a", "x", 1), (2, "b", "y", 2)))

    def dies(old, new):
        return old.withColumn("v", F.when(F.col("k") == 2, F.raise_error(F.lit("lost"))).otherwise(F.lit("half")))

    with pytest.raises(Exception, match="lost"):
        start.rewrite(rows(spark, (1, "a", "q", 1), (2, "b", "q", 1)), dies)
    now = KeyedTable.open(spark, start.path)
    assert now.version == start.version and held(now) == [(1, "a", "x", 1), (2, "b", "y", 2)]
    assert held(now.merge(rows(spark, (1, "a", "after", 1)), update=["v"]))[0] == (1, "a", "after", 1)


def test_rows_that_go_empty_their_bucket(spark, tmp_path):
    start = opened(spark, tmp_path).merge(rows(spark, (1, "a", "x", 1), (2, "b", "y", 2)))
    after = start.rewrite(rows(spark, (1, "a", "x", 1)), lambda old, new: old.where("k <> 1"))
    assert held(after) == [(2, "b", "y", 2)]


def test_two_rows_of_one_key(spark, tmp_path):
    table, batch = opened(spark, tmp_path), rows(spark, (1, "a", "x", 2), (1, "a", "y", 1))
    with pytest.raises(ValueError, match="order"):
        table.merge(batch, update=["v"])
    assert held(table.merge(batch, update=["v"], order=["n"])) == [(1, "a", "y", 1)]
    assert table.merge(batch.limit(0)) is table
    assert not [n for n in os.listdir(tmp_path / "t" / "manifest") if n.endswith(".draft")]


def test_opening_what_is_not_there(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        KeyedTable.open(spark, f"file://{tmp_path}/none")
