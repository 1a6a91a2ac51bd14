"""Queries over message trees, archives, page content, and the intake stream."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.errors import StreamingQueryException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import files, qr
from ..operators import classify as C
from ..operators import containers as K
from ..operators import mime as M
from ..operators import ocr as O
from ..sources import batches as B
from ..sources.shared import new_folder
from ..streaming.intake_stream import dedup_stream, read_parts, start_intake
from .define import ORACLES, QUERIES, query


def raw_messages(attachments: DataFrame) -> DataFrame:
    """id, payload: a tree for each message, its parts in the order of their ids. Most have two levels; where the first part
    has no id of its own, the parts lie below 24 more."""
    part = F.struct(
        F.col("part_id").alias("partId"), F.concat(F.lit("f"), F.col("id").cast("string"), F.lit(".pdf")).alias("filename"), F.lit("application/pdf").alias("mimeType"),
        F.struct(F.when(F.col("state") != "Error", F.concat(F.lit("A"), F.col("id").cast("string"))).alias("attachmentId"), F.col("size_bytes").alias("size")).alias("body"),
    )
    grouped = attachments.groupBy("message").agg(F.sort_array(F.collect_list(F.struct("id", part.alias("part")))).alias("all"))
    inner = F.to_json(F.struct(F.lit("").alias("filename"), F.transform("all", lambda x: x["part"]).alias("parts")))
    levels = F.when(F.col("all")[0]["part"]["partId"].isNull(), 25).otherwise(1)
    payload = F.concat(F.repeat(F.lit('{"filename":"","parts":['), levels), inner, F.repeat(F.lit("]}"), levels))
    return grouped.select(F.concat(F.lit("m"), F.col("message").cast("string")).alias("id"), F.parse_json(payload).alias("payload"))


_PARTS = """SELECT 'm' || message AS message_id, coalesce(part_id, '0' || repeat('.0', CASE WHEN first_id IS NULL THEN 25 ELSE 1 END) || '.' || k) AS part_id, 'f' || id || '.pdf' AS file_name,
    'application/pdf' AS mime_type, 'A' || id AS attachment_id, CAST(NULL AS VARCHAR) AS inline_data, CAST(size_bytes AS INTEGER) AS declared_size
    FROM (SELECT *, row_number() OVER w - 1 AS k, first_value(part_id) OVER w AS first_id FROM attachments WINDOW w AS (PARTITION BY message ORDER BY id)) WHERE state <> 'Error'"""


@query("flatten_parts", _PARTS)
def flatten_parts(t):
    return M.flatten_parts(raw_messages(t("attachments")))


@query("flatten_parts_recursive", _PARTS)
def flatten_parts_recursive(t):
    return M.flatten_parts_recursive(raw_messages(t("attachments")))


@query("map_messages", "SELECT message_id, received, CASE WHEN id % 5 = 0 THEN 'Remitente no disponible' ELSE sender END AS sender, subject, snippet FROM messages")
def map_messages(t):
    header = lambda name, value: F.struct(F.lit(name).alias("name"), value.alias("value"))
    sender = F.when(F.col("id") % 5 == 0, " ").otherwise(F.col("sender"))
    raw = t("messages").select(F.col("message_id").alias("id"), F.lit("t").alias("thread_id"), F.unix_millis(F.col("received").cast("timestamp")).alias("internal_date"), "snippet",
        F.array(header("X-Other", F.lit("x")), header("FROM", sender), header("subject", F.col("subject")), header("Subject", F.lit("second"))).alias("headers"))
    return M.map_messages(raw, F.lit("1990-01-01 00:00:00")).select("message_id", "received", "sender", "subject", "snippet")


@query("attachment_parts", "SELECT id, path IS NOT NULL AND state <> 'Pendiente' AS kept FROM attachments")
def attachment_parts(t):
    parts = t("attachments").select("id", F.coalesce("path", F.lit(" ")).alias("file_name"), F.when(F.col("state") == "Descargado", "a").alias("attachment_id"), F.when(F.col("state") == "Error", "b").alias("inline_data"))
    return parts.select("id", M.is_attachment_part(parts).alias("kept"))


@query("part_bytes", "SELECT id, CASE WHEN state = 'Descargado' THEN CASE WHEN hash IS NOT NULL THEN 'far' || id END ELSE 'inline' END AS data FROM attachments")
def part_bytes(t):
    rows = t("attachments")
    located = F.when(F.col("state") == "Descargado", F.col("id").cast("string"))
    parts = rows.select("id", F.col("message").alias("message_id"), located.alias("attachment_id"), F.lit("inline").alias("inline_data"))
    payloads = rows.where("hash IS NOT NULL").select(F.col("message").alias("message_id"), F.col("id").cast("string").alias("attachment_id"), F.concat(F.lit("far"), F.col("id").cast("string")).alias("data"))
    return B.part_bytes(parts, payloads).select("id", "data")


def _zipped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 500):
            names, packed = [], []
            for doc_id, body in zip(*(batch.slice(at, 500).column(c).to_pylist() for c in ("doc_id", "text"))):
                out = io.BytesIO()
                with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
                    z.writestr("dir/", "")
                    z.writestr(f"dir/{doc_id}.txt", body)
                names.append(f"{doc_id}.zip")
                packed.append(out.getvalue())
            yield pa.RecordBatch.from_arrays([pa.array(names), pa.array(packed, pa.binary())], names=["name", "content"])


@query("expand_zip", """SELECT doc_id || '.zip' AS name, CAST(2 AS INTEGER) AS ordinal, 'dir/' || doc_id || '.txt' AS entry_key, octet_length(encode(text)) AS entry_bytes, sha256(text) AS hash FROM documents""")
def expand_zip(t):
    packed = t("doc_source").select("doc_id", "text").mapInArrow(_zipped, "name string, content binary")
    entries = K.expand_zip(packed).where("NOT is_directory AND failure IS NULL")
    return entries.select("name", "ordinal", "entry_key", "entry_bytes", files.sha256_hex(F.col("content")).alias("hash"))


#: Behind each text: an octal letter, a kept digit, named escapes, an odd hexadecimal operand and one that Windows-1252 reads otherwise.
_TAIL = "\\351\\7\\t\\q) Tj <4 869> <80E94> ET"


@query("page_text", """SELECT doc_id, string_agg(text || 'é7' || chr(9) || '\\q Hi €é@ ', '' ORDER BY page, text) AS text FROM (SELECT doc_id, page, regexp_replace(text, '[^\\x00-\\xFF]', '?', 'g') AS text FROM ocr_pages) GROUP BY doc_id""")
def page_text(t):
    """Texts as literal operands in one byte a character; other characters are beyond such pages."""
    plain = F.regexp_replace(F.regexp_replace("text", r"[^\x00-\xFF]", "?"), r"([()\\])", r"\\$1")
    content = F.encode(F.concat(F.lit("BT ("), plain, F.lit(_TAIL)), "ISO-8859-1")
    return O.assemble_page_text(t("ocr_pages").select("doc_id", "page", content.alias("content"))).select("doc_id", "text")


@query("page_selected", "SELECT image, page <= 19 OR page = n_pages AS selected, CASE WHEN page IN (1, 6, 11, 19) THEN 'invoice' WHEN page IN (2, 3, 4, 7, 8, 9, 12, 13, 15, 20, 21) THEN 'other' END AS kind FROM qr_readings")
def page_selected(t):
    return t("qr_readings").select("image", qr.page_selected(F.col("page"), F.col("n_pages")).alias("selected"), C.qr_type_class(F.col("page")).alias("kind"))


@query("all_candidates", "SELECT id, 'direct' AS origin FROM ledger WHERE origin = 'DIRECTO' UNION ALL SELECT id, 'entry' FROM ledger WHERE origin = 'ZIP' UNION ALL SELECT message, 'container' FROM ledger GROUP BY message HAVING count(*) > 3")
def all_candidates(t):
    rows = t("ledger")
    of = lambda origin, label: rows.where(F.col("origin") == origin).select("id", F.lit(label).alias("origin"))
    large = rows.groupBy("message").count().where("count > 3").select(F.col("message").alias("id"), F.lit("container").alias("origin"))
    return B.all_candidates(of("DIRECTO", "direct"), of("ZIP", "entry"), large)


@query("backfill", "SELECT message_id, 'fallback' AS mode FROM (SELECT DISTINCT message_id, received FROM messages WHERE received >= TIMESTAMP '1998-08-02' - INTERVAL 5 DAY) ORDER BY received DESC, message_id LIMIT 100")
def backfill(t):
    return B.backfill(t("messages"), F.lit("1998-08-02 00:00:00").cast("timestamp_ntz"), days=5)


def stream_intake(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events as a stream into a ledger of first sightings and a table of dead letters. The first run meets bad rows and holds its cursor;
    the second replays the same batch, puts them aside and moves on."""
    root = new_folder(spark, "intake")
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    trim = lambda s: dedup_stream(s.select(F.col("event_id").alias("id"), "user_id", "event_type"), ["id"])
    held = 0
    for on_error in ("hold", "quarantine"):
        run = start_intake(
            spark, f"{sf_dir}/events*.parquet", schema, f"{root}/checkpoint", f"{root}/ledger", f"{root}/dead", ["user_id", "event_type"],
            "event_type <> 'error'", on_error=on_error, transform=trim, buckets=8,
        )
        try:
            run.awaitTermination()
        except StreamingQueryException:
            held += 1
    if held > 1:
        raise RuntimeError("the second run was to put bad rows aside")
    rows = T.StructType.fromDDL("id long, user_id long, event_type string")
    kept, dead = (read_parts(spark, f"{root}/{part}", rows).withColumn("dead", F.lit(part == "dead")) for part in ("ledger", "dead"))
    return kept.unionByName(dead)


QUERIES["stream_intake"] = stream_intake
ORACLES["stream_intake"] = """
    SELECT min(event_id) AS id, user_id, event_type, false AS dead FROM events WHERE event_type <> 'error' GROUP BY user_id, event_type
    UNION ALL SELECT event_id, user_id, event_type, true FROM events WHERE event_type = 'error'"""
