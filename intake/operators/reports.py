"""Reports over messages, attachments and the document ledger."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.display import blank_to_null, message_state, presence_flag, with_display_defaults


def document_counts(ledger: DataFrame) -> DataFrame:
    """message, n_documents."""
    return ledger.groupBy("message").agg(F.count(F.lit(1)).alias("n_documents"))


def attachment_summary(attachments: DataFrame) -> DataFrame:
    """message, n_attachments, has_error, has_download (0/1)."""
    flag = lambda state: F.max(F.when(F.col("state") == state, 1).otherwise(0))
    return attachments.groupBy("message").agg(F.count(F.lit(1)).alias("n_attachments"), flag("Error").alias("has_error"), flag("Descargado").alias("has_download"))


#: What one task of a report sorts.
ROWS_A_TASK = 200_000


def in_tasks(df: DataFrame, key: str, rows: int, rows_a_task: int | None = None) -> DataFrame:
    """`df` dealt by its key to as many tasks as `rows` ask for, so that what a task holds does not grow with the input; as it is where the
    session's own number of tasks is enough."""
    n = -(-rows // (rows_a_task or ROWS_A_TASK))
    return df.repartition(n, key) if n > int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) else df


def inbox(messages: DataFrame, accounts: DataFrame, ledger: DataFrame, attachments: DataFrame, ordered: bool = True) -> DataFrame:
    """One row a message with its account, its number of documents (or, without any, of attachments) and its state, newest first.

    Counts are formed before they are joined, so each side meets the messages once, one row a message.
    """
    # all three sides are dealt: Spark would bring one that is back to the session's number of tasks to meet those that are not
    rows = messages.count()
    met = in_tasks(messages.join(accounts.select(F.col("id").alias("account_id"), "email"), "account_id"), "id", rows)
    met = met.join(in_tasks(document_counts(ledger), "message", rows), met["id"] == F.col("message"), "left").drop("message")
    met = met.join(in_tasks(attachment_summary(attachments), "message", rows), met["id"] == F.col("message"), "left").drop("message")
    documents = F.coalesce("n_documents", F.lit(0))
    items = F.when(documents > 0, documents).otherwise(F.coalesce("n_attachments", F.lit(0)))
    state = message_state(documents, F.col("has_error"), F.col("has_download"))
    out = with_display_defaults(met).select("id", "message_id", "received", "sender", "subject", "snippet", "email", items.alias("n_items"), state.alias("state"))
    return out.orderBy(F.desc("received"), F.desc("id")) if ordered else out


def dashboard(accounts: DataFrame, messages: DataFrame, attachments: DataFrame) -> DataFrame:
    """One row: active accounts, messages, downloaded attachments. Each side is one row before they meet."""
    active = accounts.agg(F.count_if("active").alias("active_accounts"))
    return active.crossJoin(messages.agg(F.count(F.lit(1)).alias("messages"))).crossJoin(attachments.agg(F.count("downloaded").alias("downloads")))


def class_counts(ledger: DataFrame) -> DataFrame:
    """One row: invoices and reviews, 0 where there are none."""
    return ledger.agg(F.count_if(F.col("classification") == "FACTURA").alias("invoices"), F.count_if(F.col("classification") == "REVISAR").alias("reviews"))


def list_documents(ledger: DataFrame, messages: DataFrame, classification: str | None = None) -> DataFrame:
    """Documents with their messages, last classified first. No filter for a NULL or blank class: decided here, so it is pushed down."""
    if classification and classification.strip():
        ledger = ledger.where(F.col("classification") == classification)
    sides = ledger.alias("d").join(with_display_defaults(messages).alias("m"), F.col("d.message") == F.col("m.id"))
    ordered = sides.orderBy(F.desc("d.classified"), F.desc("d.id"))
    return ordered.select("d.id", "m.received", "m.sender", "m.subject", "d.name", "d.classification", "d.confidence", "d.origin")


def message_documents(ledger: DataFrame, message: int | str) -> DataFrame:
    return lookup(ledger, "message", message).orderBy("id")


def message_attachments(attachments: DataFrame, message: int | str) -> DataFrame:
    return lookup(attachments, "message", message).orderBy("id")


def message_items(ledger: DataFrame, attachments: DataFrame) -> DataFrame:
    """A message's documents if it has any, else its attachments: message, kind, id, part_id, label."""
    documents = ledger.select("message", F.lit("document").alias("kind"), "id", "part_id", F.col("classification").alias("label"))
    rest = attachments.join(ledger.select("message").distinct(), "message", "left_anti")
    return documents.unionByName(rest.select("message", F.lit("attachment").alias("kind"), "id", "part_id", F.col("state").alias("label")))


def lookup(df: DataFrame, key: str, value: int | str) -> DataFrame:
    """Rows of one id. What is no whole number above 0 finds nothing."""
    try:
        number = int(str(value).strip())
    except ValueError:
        number = 0
    return df.where(F.col(key) == number) if number > 0 else df.where(F.lit(False))


def account_by_email(accounts: DataFrame, email: str, ignore_case: bool = False) -> DataFrame:
    stored = F.collate(F.col("email"), "UTF8_LCASE") if ignore_case else F.col("email")
    return accounts.where(stored == email).withColumn("has_token", presence_flag(F.when(F.col("has_token"), 1)))


def active_account(accounts: DataFrame) -> DataFrame:
    return accounts.where("active").orderBy("id").limit(1)


def primary_account(accounts: DataFrame) -> DataFrame:
    return accounts.orderBy(F.desc("active"), "id").limit(1)


def stored_part_path(attachments: DataFrame) -> DataFrame:
    """message, part_id, path: of the first downloaded row with a path."""
    there = attachments.where((F.col("state") == "Descargado") & blank_to_null(F.col("path")).isNotNull() & F.col("part_id").isNotNull())
    return there.groupBy("message", "part_id").agg(F.min_by("path", "id").alias("path"))
