"""Steps whose cost grew faster than their input: what they give, and how."""

import io
import time
import zipfile

from pyspark.sql import functions as F

from intake.functions import text
from intake.operators import containers, ledger


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_expand_zip_in_batches(spark):
    """Entries of many small archives come in batches, not one by one."""
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for i in range(200):
            z.writestr(f"{i}.txt", "x" * i)
    files = spark.range(50).select(F.concat("id", F.lit(".zip")).alias("name"), F.lit(out.getvalue()).alias("content")).coalesce(1).localCheckpoint()
    containers.expand_zip(files.limit(1)).collect()
    began = time.time()
    got = containers.expand_zip(files).agg(F.count("*"), F.sum(F.length("content")), F.countDistinct("name"), F.count("failure")).first()
    assert tuple(got) == (10_000, 50 * 199 * 100, 50, 0)
    assert time.time() - began < 10


def test_useful_texts_without_lists(spark):
    """The searches agree with counts of all matches, which make a list of every letter."""
    texts = ["", None, "a" * 30, "a" * 29, "ab " * 15, "ab " * 4 + "1" * 30, "ab " * 5 + "1" * 20, "ñandú ab1 x y z ab ab ab" + "9" * 12, "1" * 30, "\U0001d538" * 30, "ab \n" * 10, "٣" * 15 + "אב " * 8, "Ⅷ" * 30, "a b c d e " * 9, "x1" * 15, "-" * 100_000 + "ab-" * 10]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    whole = F.coalesce("t", F.lit(""))
    count = lambda p: F.regexp_count(whole, F.lit(p))
    want = (count(r"[\p{L}\p{Nd}]") >= 30) & (count(r"\p{L}") >= 15) & (count(r"\p{L}[\p{L}\p{N}]{1,}") >= 5)
    rows = df.select("t", text.useful_ocr_text(F.col("t")).alias("ocr"), want.alias("ocr_want"), text.useful_page_text(F.col("t")).alias("page"), (count(r"[\p{L}\p{N}]") >= 30).alias("page_want")).collect()
    assert [(r.ocr, r.page) for r in rows] == [(r.ocr_want, r.page_want) for r in rows]
    assert {r.ocr for r in rows} == {r.page for r in rows} == {True, False}
    assert "regexp_extract_all" not in plan(df.select(text.useful_ocr_text(F.col("t")))) and "regexp_count" not in plan(df.select(text.useful_ocr_text(F.col("t"))))


def test_collisions_of_one_path(spark):
    """A path that all rows share is not sorted in one task; NULLs are a path and a hash."""
    rows = [("a.x", f"{i:08d}zz") for i in range(5)] * 2 + [(None, "h1"), (None, None), ("b", None), ("b", "h2"), ("b", "h2")]
    made = ledger.resolve_path_collisions(spark.createDataFrame(rows, "path string, hash string"))
    want = [("a.x", "00000000zz")] + [(f"a_{i:08d}.x", f"{i:08d}zz") for i in range(1, 5)] + [(None, "h1"), (None, None), ("b", None), ("b_h2", "h2")]
    assert sorted(map(str, map(tuple, made.collect()))) == sorted(map(str, want))
    assert "Window" not in plan(made)


def test_tidy_paths_are_not_walked(spark):
    """Only paths with an empty part, a dot part or a backslash are resolved; what the walk gives is what the short way gives."""
    keys = ["A/b.pdf", "a/./B.pdf", "x/../a//c.pdf", "..\\up.pdf", "/a", "a/", "", ".", "..", "a..b/c.", "../..", "a/..b", "...", "É/x", "a\\b"]
    df = spark.createDataFrame([(k,) for k in keys], "k string")
    k = F.col("k")
    for row in df.select("k", containers.normal_path(k).alias("short"), containers._resolved(k).alias("walked"), containers._leaves(k).alias("leaves"), (containers._levels(k) < 0).alias("below")).collect():
        assert (row.short, row.leaves) == (row.walked, row.below), row.k


def entries(spark, roots):
    rows = spark.range(roots).select(F.col("id").alias("root_id"), F.explode(F.sequence(F.lit(1), F.lit(6))).alias("ordinal"))
    key = F.element_at(F.array(*map(F.lit, ("A/b.pdf", "a/./B.pdf", "x/../a//c.pdf", "..\\up.pdf", "a/b/../c2.pdf", "..x/a.pdf"))), F.col("ordinal"))
    return rows.withColumns({
        "entry_key": key, "entry_bytes": F.lit(10).cast("long"), "is_directory": F.lit(False), "is_encrypted": F.lit(False), "link_target": F.lit(None).cast("string"),
        "container_id": F.col("root_id"), "child_id": F.lit(None).cast("long"), "root_name": F.lit("r"),
    })


def test_trees_in_tasks_of_bounded_size(spark, monkeypatch):
    """The number of tasks follows the entries, and the result does not follow the number of tasks."""
    trees = entries(spark, 50)
    want = sorted(map(str, containers.apply_nested_policy(trees).collect()))
    assert containers.tasks_by_root(trees, 20)(trees).rdd.getNumPartitions() == 15
    assert containers.tasks_by_root(trees)(trees) is trees
    tasks_by_root = containers.tasks_by_root
    monkeypatch.setattr(containers, "tasks_by_root", lambda e: tasks_by_root(e, 20))
    dealt = containers.apply_nested_policy(trees)
    assert "RepartitionByExpression [root_id" in plan(dealt)
    assert sorted(map(str, dealt.collect())) == want and len(want) == 50


def test_store_finds_first_paths_once(spark, tmp_path, monkeypatch):
    """A write ranks the batch's paths for its rows only, not again for its days and their counts."""
    day = "timestamp_ntz'2024-05-06 00:00:00'"
    batch = spark.range(40).selectExpr("id", "concat('p', id % 10) AS path", "'FACTURA' AS classification", f"{day} AS received")
    ranked = []
    first = ledger.first_of_key
    monkeypatch.setattr(ledger, "first_of_key", lambda *a: first(*a).where(F.udf(lambda x: True, "boolean").asNondeterministic()("id")))
    plans = ranked.append
    write = ledger.stored_on_days
    monkeypatch.setattr(ledger, "stored_on_days", lambda stored, given: (plans(plan(given)), write(stored, given))[1])
    root = f"{tmp_path}/store"
    for b in (batch.where("id < 25 AND path < 'p5'"), batch):
        ledger.write_documents(b, root, ["id"])
    got = spark.read.parquet(root).select("id", "path").collect()
    assert sorted((r.path, r.id) for r in got) == [(f"p{i}", i) for i in range(10)]
    assert ranked and all("Window" not in p for p in ranked)


def test_detail_counts_before_it_joins(spark, monkeypatch):
    """Attachments and documents become one row a message before anything meets them, and tasks that meet them follow the number of messages."""
    from intake.operators import reports
    from intake.plans.registry import QUERIES

    plain = QUERIES["message_detail"](spark, "/root/testdata/sf0.001")
    assert "LeftSemi" not in plan(plain)
    want = sorted(map(str, plain.collect()))
    monkeypatch.setattr(reports, "ROWS_A_TASK", 100)
    dealt = QUERIES["message_detail"](spark, "/root/testdata/sf0.001")
    assert plan(dealt).count("RepartitionByExpression") == 3
    assert sorted(map(str, dealt.collect())) == want


def test_rows_of_a_message_are_shuffled_once(spark):
    """What is grouped by message lies as the numbering of its rows dealt it, and hashes are not formed before that."""
    from intake.sources.bindings import domain_table

    for name, key in (("attachments", "message"), ("ledger", "message"), ("container_entries", "root_id")):
        table = domain_table(spark, "/root/testdata/sf0.001", name)
        made = table.groupBy(key).agg(F.collect_list(F.struct(*table.columns)))
        assert made._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1, name
        assert "sha2" not in plan(table).partition("Window")[2], name


def test_dealt_rows_stay(spark):
    """A join with a dealt table shuffles the other side only, though the other side is as large; the table leaves the catalog, its rows stay."""
    from intake.sources.shared import dealt_by

    before = {t.name for t in spark.catalog.listTables()}
    with dealt_by(spark.range(100).selectExpr("id % 7 AS k", "id"), "k") as dealt:
        met = spark.range(5).withColumnRenamed("id", "k").hint("merge").join(dealt, "k")
        assert met._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
        assert met.count() == 72 and dealt.count() == 100
    assert {t.name for t in spark.catalog.listTables()} == before


def test_an_insert_forms_its_rows_once(spark, tmp_path):
    """New rows are written without a look before whether there are any; where there are none the version stays."""
    from intake.operators.keyed_table import KeyedTable

    calls = spark.sparkContext.accumulator(0)
    table = KeyedTable.open(spark, f"file://{tmp_path}/t", "k long, v string", ["k"], 1)
    batch = spark.range(3).selectExpr("id AS k", "'x' AS v")
    again = F.udf(lambda v: (calls.add(1), v)[1]).asNondeterministic()
    table, _ = table.insert(batch.withColumn("v", again("v")), ["v"])
    assert table.version == 1 and table.read().count() == 3 and calls.value == 3
    same, existing = table.insert(batch, ["v"])
    assert same.version == 1 and existing.count() == 3
    assert KeyedTable.open(spark, f"file://{tmp_path}/t").version == 1


def test_trees_are_read_once(spark, monkeypatch):
    """One pass over trees of four levels, whatever their number of nodes: only what was found in them is stored, and the recursion begins below them."""
    from intake.operators import mime

    leaf = '{"filename":"a.pdf","body":{"attachmentId":"X"}}'
    trees = [("flat", f'{{"parts":[{leaf},{{"filename":"x","parts":[{leaf},{leaf}]}}]}}', ["0.0", "0.1.0", "0.1.1"]), ("deep", '{"parts":[' * 9 + leaf + "]}" * 9, ["0" + ".0" * 9]), ("root", leaf, ["0"]), ("odd", '{"parts":{"filename":"a"}}', []), ("null", '{"parts":[null,1]}', [])]
    raw = spark.createDataFrame([t[:2] for t in trees], "id string, p string").select("id", F.try_parse_json("p").alias("payload"))
    stored, checkpointed = [], mime.checkpointed
    monkeypatch.setattr(mime, "checkpointed", lambda df: (stored.append(checkpointed(df)), stored[-1])[1])
    for f, passes in ((mime.flatten_parts, [5, 1, 1]), (mime.flatten_parts_recursive, [5])):
        stored.clear()
        made = f(raw)
        assert sorted((r.message_id, r.part_id) for r in made.collect()) == sorted((n, p) for n, _, ps in trees for p in ps)
        assert [df.count() for df in stored] == passes
