"""Queries over runs: merges into a keyed table, a mailbox's runs with an expiring cursor, dedup with a bounded state."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import ledger as L
from ..operators import quality as Q
from ..operators.keyed_table import KeyedTable
from ..sources import payload_files as P
from ..sources.bindings import domain_table, with_domain
from ..sources.shared import checkpointed, dealt_by, new_folder
from ..streaming.intake_stream import dedup_stream, state_on_disk
from ..streaming.sync_run import Sync
from .define import ORACLES, QUERIES
from .tables import _CANON


def merged_attachments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three writes to a keyed table, each read back by the next: downloads, then what is pending (size kept), then errors (path cleared)."""
    ranked = checkpointed(Q.consolidate_parts(domain_table(spark, sf_dir, "attachments"))[0].where("part_id IS NOT NULL").select("message", "part_id", "state", "path", "size_bytes"))
    path, schema = f"{new_folder(spark, 'merged')}/attachments", "message long, part_id string, state string, path string, size_bytes long"
    table = KeyedTable.open(spark, path, schema, ["message", "part_id"], 16)
    table, _ = table.insert(ranked.where("state = 'Descargado'"), ["size_bytes"])
    later = checkpointed(ranked.where("state <> 'Error'").select("message", "part_id", F.lower("state").alias("state"), F.lit(None).cast("string").alias("path"), (F.col("size_bytes") + 1).alias("size_bytes")))
    table = KeyedTable.open(spark, path).merge(later, update=["state"], coalesce=["path"])
    failed = checkpointed(ranked.where("state = 'Error' OR size_bytes % 2 = 0").select("message", "part_id", F.lit("failed").alias("state"), F.lit(None).cast("string").alias("path"), F.lit(None).cast("long").alias("size_bytes")))
    return KeyedTable.open(spark, path).merge(failed, update=["path", "state"]).read()


MERGED_SQL = f"""
    WITH c AS (SELECT message, part_id, state, path, size_bytes FROM ({_CANON}) WHERE part_id IS NOT NULL),
    a AS (SELECT * FROM c WHERE state = 'Descargado'),
    b AS (SELECT message, part_id, lower(state) AS state, size_bytes + 1 AS size_bytes FROM c WHERE state <> 'Error'),
    ab AS (SELECT coalesce(b.message, a.message) AS message, coalesce(b.part_id, a.part_id) AS part_id, coalesce(b.state, a.state) AS state, a.path, coalesce(a.size_bytes, b.size_bytes) AS size_bytes
        FROM a FULL JOIN b ON a.message = b.message AND a.part_id = b.part_id),
    f AS (SELECT message, part_id FROM c WHERE state = 'Error' OR size_bytes % 2 = 0)
    SELECT coalesce(ab.message, f.message) AS message, coalesce(ab.part_id, f.part_id) AS part_id, CASE WHEN f.message IS NULL THEN ab.state ELSE 'failed' END AS state,
        CASE WHEN f.message IS NULL THEN ab.path END AS path, ab.size_bytes FROM ab FULL JOIN f ON ab.message = f.message AND ab.part_id = f.part_id"""

_EVENTS = "SELECT event_id AS history_id, CASE WHEN event_type = 'error' THEN 'messageDeleted' ELSE 'messageAdded' END AS record_type, concat('m', CAST(2 * event_id AS STRING)) AS message_id FROM {events}"
_FIRST, _SECOND = "1997-03-01 00:00:00", "1998-06-01 00:00:00"


def sync_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events as history in six arrivals. The first run has no cursor, the second streams two arrivals, the fourth arrival is lost with its
    part of the history, so the cursor is expired at the fifth, and the sixth is streamed under the new checkpoint."""
    root = new_folder(spark, "sync")
    history = spark.sql(_EVENTS, events=spark.read.parquet(f"{sf_dir}/events.parquet"))
    last = history.agg(F.max("history_id")).first()[0]
    # the rows of an arrival are one file, in the folder that a run reads
    history = checkpointed(history.withColumn("arrival", F.floor(6 * F.col("history_id") / (last + 1)).cast("int")))
    land = lambda k, folder: history.where(F.col("arrival") == k).drop("arrival").coalesce(1).write.mode("append").parquet(f"{root}/{folder}")
    messages, documents = (domain_table(spark, sf_dir, name) for name in ("messages", "ledger"))
    messages = messages.select("message_id", "received", "id")
    kinds = documents.select("id", "message", "part_id", "origin_hash", F.when(F.col("classification") == "FACTURA", "invoice").when(F.col("confidence") > 80, "discarded").otherwise("review").alias("outcome"))

    schema = "history_id long, record_type string, message_id string"
    ledger = "id long, message_id string, part_id string, origin_hash string, mode string"
    until = lambda as_of: messages.where(F.col("received") <= F.lit(as_of).cast("timestamp_ntz"))

    # every batch looks its messages up in all documents, which stay where they are: only the batch's messages are shuffled
    with dealt_by(kinds, "message") as dealt:

        def analyse(batch: DataFrame) -> DataFrame:
            return batch.select("message_id", F.col("id").alias("message")).join(dealt, "message")

        def run(folder: str, as_of: str, known: DataFrame = messages) -> Sync:
            sync = Sync(spark, root, 1, known, analyse, ledger, buckets=8)
            sync.sync(f"{root}/{folder}", schema, F.lit(as_of).cast("timestamp_ntz"))
            return sync

        land(0, "old")
        run("old", _FIRST, until(_FIRST))
        land(1, "old")
        land(2, "old")
        run("old", _FIRST)
        land(4, "new")
        run("new", _SECOND, until(_SECOND))
        land(5, "new")
        sync = run("new", _SECOND)
    stored = sync.ledger.read().select(F.lit("document").alias("kind"), "mode", "id", F.lit(1).cast("long").alias("n"))
    cursor = sync.accounts.read().select(F.lit("cursor").alias("kind"), F.lit(None).cast("string").alias("mode"), "id", F.col("last_history_id").cast("long").alias("n"))
    counted = sync.metrics().groupBy("mode").agg(*(F.sum(c).alias(c) for c in ("found", "new_messages", "discarded", "existing", "missing")))
    kinds_ = counted.unpivot("mode", ["found", "new_messages", "discarded", "existing", "missing"], "kind", "n").select("kind", "mode", F.lit(None).cast("long").alias("id"), "n")
    return stored.unionByName(cursor).unionByName(kinds_)


_BATCH = "(SELECT {k} AS run, '{mode}' AS mode, message_id FROM (SELECT DISTINCT message_id, received FROM messages WHERE received <= TIMESTAMP '{at}' AND received >= TIMESTAMP '{at}' - INTERVAL 30 DAY) ORDER BY received DESC, message_id LIMIT 100)"
SYNC_SQL = f"""
    WITH h AS (SELECT history_id, message_id, record_type, CAST(floor(6 * history_id / ((SELECT max(event_id) FROM events) + 1)) AS INT) AS arrival FROM ({_EVENTS.format(events="events")})),
    s AS (SELECT 2 + arrival AS run, 'incremental' AS mode, message_id FROM h WHERE record_type = 'messageAdded' AND arrival IN (1, 2, 5)
        UNION ALL SELECT * FROM {_BATCH.format(k=1, mode="initial", at=_FIRST)} UNION ALL SELECT * FROM {_BATCH.format(k=6, mode="fallback", at=_SECOND)}),
    d AS (SELECT s.run, s.mode, s.message_id, l.id, l.part_id, l.origin_hash, CASE WHEN l.classification = 'FACTURA' THEN 'invoice' WHEN l.confidence > 80 THEN 'discarded' ELSE 'review' END AS outcome
        FROM s JOIN messages m ON m.message_id = s.message_id JOIN ledger l ON l.message = m.id),
    k AS (SELECT *, row_number() OVER (PARTITION BY message_id, part_id, origin_hash ORDER BY run, id) AS place FROM d WHERE outcome <> 'discarded')
    SELECT 'document' AS kind, mode, id, CAST(1 AS BIGINT) AS n FROM k WHERE place = 1
    UNION ALL SELECT 'cursor', NULL, 1, max(history_id) FROM h
    UNION ALL SELECT 'found', mode, NULL, count(*) FROM s GROUP BY mode
    UNION ALL SELECT 'new_messages', mode, NULL, count(DISTINCT CASE WHEN place = 1 THEN (run, message_id) END) FROM s LEFT JOIN k USING (run, mode, message_id) GROUP BY mode
    UNION ALL SELECT 'discarded', mode, NULL, count(*) FILTER (outcome = 'discarded') FROM s LEFT JOIN d USING (run, mode, message_id) GROUP BY mode
    UNION ALL SELECT 'existing', mode, NULL, count(*) FILTER (place > 1) FROM s LEFT JOIN k USING (run, mode, message_id) GROUP BY mode
    UNION ALL SELECT 'missing', mode, NULL, count(*) FILTER (m.message_id IS NULL) FROM s LEFT JOIN (SELECT DISTINCT message_id FROM messages) m ON m.message_id = s.message_id GROUP BY mode"""

_WITHIN = 6  # hours
#: Each event is delivered once, twice within the time that keys are kept, twice beyond it, or once more when it is late.
_DELIVERIES = """
    SELECT event_id, ts AS delivered, ts AS landed FROM {events}
    UNION ALL SELECT event_id, ts + INTERVAL 2 HOUR, ts + INTERVAL 2 HOUR FROM {events} WHERE event_id % 4 = 1
    UNION ALL SELECT event_id, ts + INTERVAL 90 HOUR, ts + INTERVAL 90 HOUR FROM {events} WHERE event_id % 4 = 2
    UNION ALL SELECT event_id + 1000000000, ts - INTERVAL 200 HOUR, ts FROM {events} WHERE event_id % 4 = 3"""
_DAYS = 5


def recent_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Deliveries of events as a stream in event-time order, a file for each five days: each event passes once, unless it comes again after its key
    was forgotten, and late ones are dropped. Keys are kept for six hours."""
    root, schema = new_folder(spark, "recent"), "event_id long, delivered timestamp"
    rows = spark.sql(_DELIVERIES, events=spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", F.col("ts").cast("timestamp").alias("ts")))
    start = rows.agg(F.date_trunc("day", F.min("landed"))).first()[0]
    rows = checkpointed(rows.withColumn("batch", F.floor((F.unix_timestamp("landed") - F.unix_timestamp(F.lit(start))) / (86400 * _DAYS)).cast("int")).drop("landed"))
    for batch in sorted(r[0] for r in rows.select("batch").distinct().collect()):  # a number for every five days
        rows.where(F.col("batch") == batch).drop("batch").repartition(2).write.mode("append").parquet(f"{root}/landed")
        stream = dedup_stream(spark.readStream.schema(schema).parquet(f"{root}/landed"), ["event_id"], f"{_WITHIN} hours", "delivered")
        with state_on_disk(spark):
            stream.writeStream.format("parquet").option("path", f"{root}/out").option("checkpointLocation", f"{root}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(schema).parquet(f"{root}/out").groupBy("event_id").agg(F.count(F.lit(1)).alias("n"))


RECENT_SQL = f"""
    WITH r AS ({_DELIVERIES.format(events="events")}),
    b AS (SELECT *, CAST(floor((epoch(landed) - epoch(date_trunc('day', (SELECT min(landed) FROM r)))) / {86400 * _DAYS}) AS INT) AS batch FROM r),
    w AS (SELECT batch, max(max(delivered)) OVER (ORDER BY batch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) - INTERVAL {_WITHIN} HOUR AS mark FROM b GROUP BY batch),
    live AS (SELECT b.event_id, b.delivered, b.batch, w.mark FROM b JOIN w ON w.batch = b.batch WHERE w.mark IS NULL OR delivered > w.mark),
    f AS (SELECT *, min(batch) OVER (PARTITION BY event_id) AS first_batch, min(delivered) OVER (PARTITION BY event_id) AS first_at FROM live)
    SELECT event_id, count(DISTINCT CASE WHEN batch = first_batch THEN -1 WHEN first_at + INTERVAL {_WITHIN} HOUR <= mark THEN batch END) AS n FROM f GROUP BY event_id"""



def document_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two writes to a store of documents: first parts 1 to 3 of the messages, then all parts; what is there stays. Messages are dated by the
    first of their month: the tables hold seven documents a day, which as files of their own would measure the file system only."""
    root = f"{new_folder(spark, 'store')}/documents"
    messages = domain_table(spark, sf_dir, "messages").select(F.col("id").alias("message"), "message_id", F.date_trunc("month", "received").cast("timestamp_ntz").alias("received"))
    placed = checkpointed(L.document_paths(domain_table(spark, sf_dir, "ledger").join(messages, "message")).select("id", "path", "classification", "part_id", "received"))
    for batch in (placed.where("part_id <= '3'"), placed):
        L.write_documents(batch, root, ["id"])
    return spark.read.schema(L.with_day(placed).schema).parquet(root).select("id", "path", "classification", "y", "m", "d")


_PATH = """CASE WHEN l.classification = 'FACTURA' THEN 'invoices' ELSE 'review' END || '/' || strftime(m.received, '%Y/%m/%d') || '/' || m.message_id || '/'
    || regexp_replace(l.name, '\\.pdf$', '') || '_' || substr(l.origin_hash, 1, 12) || '.pdf'"""
STORE_SQL = f"""
    SELECT id, path, classification, y, m, d FROM (SELECT *, row_number() OVER (PARTITION BY path ORDER BY CASE WHEN part_id <= '3' THEN 0 ELSE 1 END, id) AS place FROM (
        SELECT l.id, {_PATH} AS path, l.classification, l.part_id, strftime(m.received, '%Y') AS y, strftime(m.received, '%m') AS m, strftime(m.received, '%d') AS d
        FROM ledger l JOIN (SELECT id, message_id, date_trunc('month', received) AS received FROM messages) m ON m.id = l.message)) WHERE place = 1"""

_LONGEST = 6000


def payload_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as payloads: written as files but for every seventh, read back by locator within a limit; every tenth page is inline."""
    root = f"{new_folder(spark, 'payloads')}/files"
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", F.encode("html", "utf-8").alias("content"))
    locator = F.concat(F.lit("page/"), F.col("page_id").cast("string"))
    inline = F.translate(F.base64("content"), "+/\r\n=", "-_")
    P.write_payloads(pages.where("page_id % 7 <> 0").select(locator.alias("locator"), "content"), root)
    held = F.col("page_id") % 10 == 0
    parts = pages.select("page_id", F.when(held, " ").otherwise(locator).alias("attachment_id"), F.when(held, inline).alias("inline_data"))
    made = P.part_content(parts, P.file_payloads(spark, root, _LONGEST))
    return made.select("page_id", F.octet_length("content").cast("long").alias("n_bytes"), F.sha2("content", 256).alias("hash"), "failure")


PAYLOAD_SQL = f"""
    SELECT page_id, CASE WHEN failure IS NULL THEN CAST(n AS BIGINT) END AS n_bytes, CASE WHEN failure IS NULL THEN sha256(html) END AS hash, failure FROM (
        SELECT page_id, html, octet_length(encode(html)) AS n, CASE WHEN html IS NULL OR (page_id % 10 = 0 AND html = '') THEN 'missing' WHEN page_id % 10 = 0 THEN NULL
            WHEN page_id % 7 = 0 THEN 'missing' WHEN octet_length(encode(html)) > {_LONGEST} THEN 'too_large' END AS failure FROM pages)"""

_CHANGES = "SELECT CASE WHEN id % 3 = 0 THEN upper(email) ELSE concat(lower(email), '.new') END AS email, id, CASE WHEN id % 2 = 0 THEN 'h' END AS last_history_id FROM {accounts} WHERE id % 3 <> 1"


def upsert_any_case(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accounts after changes whose e-mail addresses are spelt in another case, or new."""
    accounts = domain_table(spark, sf_dir, "accounts").select("email", "id", "last_history_id")
    changes = spark.sql(_CHANGES, accounts=accounts)
    met = L.upsert(L.ignoring_case(accounts, "email"), L.ignoring_case(changes, "email"), ["email"], coalesce=["last_history_id"])
    return met.select(F.col("email").cast("string").alias("email"), "id", "last_history_id")


ANY_CASE_SQL = f"""
    WITH s AS ({_CHANGES.format(accounts="accounts")})
    SELECT coalesce(a.email, s.email) AS email, coalesce(a.id, s.id) AS id, coalesce(s.last_history_id, a.last_history_id) AS last_history_id
    FROM accounts a FULL JOIN s ON lower(a.email) = lower(s.email)"""

QUERIES |= {
    "merged_attachments": merged_attachments, "sync_run": sync_run, "recent_events": recent_events,
    "document_store": document_store, "payload_files": payload_files, "upsert_any_case": upsert_any_case,
}
ORACLES |= {
    "merged_attachments": with_domain(MERGED_SQL), "sync_run": with_domain(SYNC_SQL.replace("AS STRING", "AS VARCHAR")), "recent_events": RECENT_SQL,
    "document_store": with_domain(STORE_SQL), "payload_files": PAYLOAD_SQL, "upsert_any_case": with_domain(ANY_CASE_SQL),
}
