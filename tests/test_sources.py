"""Payload files, the relational source, the partitioned store and keys without case."""

import base64
import hashlib
import os

import duckdb
from pyspark.sql import functions as F

from intake.operators import ledger, reports
from intake.sources import payload_files, relational
from intake.sources.bindings import domain_sql, domain_table

SF = "/root/testdata/sf0.001"


def b64url(data):
    return base64.urlsafe_b64encode(data).decode().rstrip("=")


def test_payload_files(spark, tmp_path):
    root = f"file://{tmp_path}/payloads"
    rows = [("a/../b", b"one"), ("ñ:1", b"\x00\xff" * 30), ("empty", b""), ("twice", b"a"), ("twice", b"b"), (None, b"x"), ("no bytes", None)]
    assert payload_files.write_payloads(spark.createDataFrame(rows, "locator string, content binary"), root) == 4
    parts = [(1, "a/../b", "ignored"), (2, "ñ:1", None), (3, "empty", None), (4, "twice", None), (5, "no bytes", None), (6, None, b64url(b"in\xfb")), (7, "  ", "!!"), (8, None, " "), (9, "a/../b", None), (10, None, None)]
    df = spark.createDataFrame(parts, "id long, attachment_id string, inline_data string").withColumns({"content": F.lit(1), "folder": F.lit("mine"), "length": F.lit(2)})
    made = payload_files.part_content(df, payload_files.file_payloads(spark, root, 50))
    got = {r.id: (r.content if r.content is None else bytes(r.content), r.failure) for r in made.collect()}
    assert got == {
        1: (b"one", None), 2: (None, "too_large"), 3: (b"", None), 4: (b"b", None), 5: (None, "missing"), 6: (b"in\xfb", None), 7: (None, "not_base64url"), 8: (None, "missing"), 9: (b"one", None), 10: (None, "missing"),
    }
    assert {"folder", "length"} <= set(made.columns) and {r.folder for r in made.collect()} == {"mine"}
    # written again, the same files
    payload_files.write_payloads(spark.createDataFrame(rows, "locator string, content binary"), root)
    names = [f for _, _, fs in os.walk(tmp_path) for f in fs if not f.endswith(".crc")]
    assert len(names) == 4 and f"{hashlib.sha256(b'empty').hexdigest()}.empty" in names
    assert f"{hashlib.sha256(b'twice').hexdigest()}.bin" in names


def test_payload_files_are_pruned(spark, tmp_path):
    root = f"file://{tmp_path}/payloads"
    payload_files.write_payloads(spark.createDataFrame([(str(i), b"x" * i) for i in range(40)], "locator string, content binary"), root)
    held = payload_files.file_payloads(spark, root, 20)
    one = held.where(F.col("folder") == payload_files.folder_of(payload_files.file_name(F.lit("7"))))
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert "LessThanOrEqual(length,20)" in plan and "PartitionFilters: [isnotnull(folder" in plan
    assert one.where(F.col("name") == payload_files.file_name(F.lit("7"))).select("length").collect()[0][0] == 7
    # what is too large is listed, its bytes are not a column of the scan
    assert held.where("failure = 'too_large'").count() == 19
    listed = held.where("failure = 'too_large'")._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<path:string,length:bigint>" in listed


def test_relational_tables(spark):
    url = "jdbc:derby:memory:intake;create=true"
    texts = {name: ", ".join(f"{c.split()[0]} VARCHAR(300)" for c in ddl.split(", ") if c.endswith("string")) for name, ddl in relational.TABLES.items()}
    for name in relational.TABLES:
        # Derby takes no NULL for a text that Spark's writer announces as a CLOB: they are set behind
        strings = [c.split()[0] for c in texts[name].split(", ")]
        marked = {c: F.when(F.col(c).isNull(), "(null)").when(F.col(c).isNotNull(), F.col(c)) for c in strings}
        domain_table(spark, SF, name).withColumns(marked).write.jdbc(url, name, mode="overwrite", properties={"createTableColumnTypes": texts[name]})
        link = spark._jvm.java.sql.DriverManager.getConnection(url)
        for c in strings:
            link.createStatement().executeUpdate(f"UPDATE {name} SET \"{c}\" = NULL WHERE \"{c}\" = '(null)'")
        link.close()
    tables = relational.read_relational(spark, url, slices=4)
    con = duckdb.connect()
    for t in ("customer", "orders", "lineitem"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    for name, ddl in relational.TABLES.items():
        df, columns = tables[name], [c.split()[0] for c in ddl.split(", ")]
        assert [f"{f.name} {f.dataType.simpleString()}" for f in df.schema] == ddl.split(", ")
        assert df.rdd.getNumPartitions() == 4
        want = con.execute(f"SELECT {', '.join(columns)} FROM ({domain_sql(name, spark=False)})").fetchall()
        assert sorted(str(tuple(r)) for r in df.collect()) == sorted(map(str, want))
    some = tables["attachments"].where("message = 34 AND state = 'Error'").select("id")
    plan = some._jdf.queryExecution().executedPlan().toString()
    assert "*EqualTo(message,34)" in plan and "*EqualTo(state,Error)" in plan and "size_bytes" not in plan


def test_an_empty_relational_table(spark):
    url = "jdbc:derby:memory:bare;create=true"
    domain_table(spark, SF, "accounts").limit(0).write.jdbc(url, "accounts", mode="overwrite", properties={"createTableColumnTypes": "email VARCHAR(300), last_history_id VARCHAR(300)"})
    read = relational.read_relational(spark, url, {"accounts": relational.TABLES["accounts"]})["accounts"]
    assert read.collect() == [] and read.columns == ["id", "email", "active", "has_token", "last_history_id"]


def test_the_store_opens_the_days_of_the_batch_only(spark, tmp_path):
    root = f"file://{tmp_path}/store"
    rows = [(i, f"p{i}", "FACTURA" if i % 2 else "REVISAR", f"2024-03-{i:02d} 01:02:03") for i in range(1, 21)]
    docs = spark.createDataFrame(rows, "id long, path string, classification string, r string").withColumn("received", F.col("r").cast("timestamp_ntz")).drop("r")
    ledger.write_documents(docs, root, ["id"])
    late = docs.where("id <= 2").unionByName(docs.where("id = 3").withColumn("path", F.lit("new"))).unionByName(docs.where("id = 4").withColumn("classification", F.lit("DESCARTAR")).withColumn("path", F.lit("gone")))
    seen = ledger.stored_on_days(spark.read.schema(ledger.with_day(docs).schema).parquet(root), ledger.with_day(late))
    assert "dynamicpruning" in seen._jdf.queryExecution().optimizedPlan().toString()
    assert sorted(r.id for r in seen.collect()) == [1, 2, 3]
    ledger.write_documents(late.withColumn("id", F.col("id") + 100), root, ["id"])
    stored = spark.read.schema(ledger.with_day(docs).schema).parquet(root)
    assert sorted((r.id, r.path) for r in stored.where("id > 100").collect()) == [(103, "new")] and stored.count() == 21


def test_emails_without_case(spark):
    accounts = spark.createDataFrame([(1, "Ana@X.com", True), (2, None, True), (3, "b@x.com", False)], "id long, email string, has_token boolean")
    assert [r.id for r in reports.account_by_email(accounts, "ANA@x.COM", ignore_case=True).collect()] == [1]
    assert reports.account_by_email(accounts, "ANA@x.COM").count() == 0
    changes = spark.createDataFrame([("ANA@X.COM", 9), ("c@x.com", 4), (None, 8)], "email string, id long")
    got = ledger.upsert(ledger.ignoring_case(accounts, "email"), ledger.ignoring_case(changes, "email"), ["email"], update=["id"])
    assert sorted(((r.id, r.email, r.has_token) for r in got.collect())) == [(3, "b@x.com", False), (4, "c@x.com", None), (8, None, True), (9, "Ana@X.com", True)]
