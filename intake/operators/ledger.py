"""Idempotent writes as DataFrame transforms: what a table looks like after an insert-if-absent, an upsert, a cursor commit."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.files import date_path, file_ext, file_stem, safe_extension, safe_segment

LEDGER_KEY = ("message", "part_id", "origin_hash")


def _known(target: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The keys of `target` as `_k0`, `_k1`, ..., once each."""
    return target.select(*(F.col(k).alias(f"_k{i}") for i, k in enumerate(keys))).distinct()


def _same_key(source: DataFrame, keys: Sequence[str]) -> Column:
    """A NULL in a key equals a NULL: a row that was written once is found again."""
    return reduce(and_, (source[k].eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)))


def exists_flag(target: DataFrame, source: DataFrame, keys: Sequence[str]) -> DataFrame:
    """`source` with `present`: whether its key is in `target`. NULLs in keys are equal."""
    known = _known(target, keys).withColumn("_there", F.lit(True))
    return source.join(known, _same_key(source, keys), "left").withColumn("present", F.col("_there").isNotNull()).select(*source.columns, "present")


def first_of_key(source: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """One row a key: the first by `order`."""
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return source.withColumn("_place", place).where("_place = 1").drop("_place")


def insert_if_absent(target: DataFrame, source: DataFrame, keys: Sequence[str] = LEDGER_KEY, order: Sequence[str] = ("id",)) -> tuple[DataFrame, DataFrame]:
    """(new, existing): rows to append, first of each key of the batch, and rows of `source` whose key is there already. NULLs in keys are equal."""
    known, same = _known(target, keys), _same_key(source, keys)
    return first_of_key(source.join(known, same, "left_anti"), keys, order), source.join(known, same, "left_semi")


def natural_key(keys: Sequence[str]) -> Column:
    """A text that is one key's only: each part with its length before it, `-` for NULL."""
    texts = (F.col(k).cast("string") for k in keys)
    return F.concat(*(F.coalesce(F.concat(F.length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts))


def ensure_keys(target: DataFrame, source: DataFrame, keys: Sequence[str], key_id: str = "key_id") -> DataFrame:
    """Get or create: each key of `source` with `key_id`, a hash of the key (no global counter), and `created`."""
    asked = exists_flag(target, source.select(*keys).distinct(), keys)
    return asked.select(*keys, F.sha2(natural_key(keys), 256).alias(key_id), (~F.col("present")).alias("created"))


def messages_to_store(messages: DataFrame, candidates: DataFrame) -> DataFrame:
    """Only messages of which some part gave a candidate that is kept."""
    return messages.join(candidates.select(F.col("message").alias("id")).distinct(), "id", "left_semi")


def upsert(target: DataFrame, source: DataFrame, keys: Sequence[str], update: Sequence[str] = (), coalesce: Sequence[str] = (), set_to: Mapping[str, Column] | None = None) -> DataFrame:
    """`target` after the rows of `source` (one a key): `update` columns take the new value even if it is NULL, `coalesce` columns keep
    the old one then, `set_to` columns get an expression where the source has a row; other columns stay. New keys are inserted."""
    set_to = dict(set_to or {})
    t = target.alias("t").withColumn("_old", F.lit(True))
    s = source.alias("s").withColumn("_new", F.lit(True))
    met = t.join(s, [F.col(f"t.{k}").eqNullSafe(F.col(f"s.{k}")) for k in keys], "full_outer")
    touched = F.col("_new").isNotNull()

    def value(c: str) -> Column:
        new = F.col(f"s.{c}") if c in source.columns else F.lit(None).cast(target.schema[c].dataType)
        old = F.col(f"t.{c}")
        if c in keys:  # keys may be equal in another spelling: the stored one stays
            return F.when(F.col("_old").isNull(), new).otherwise(old)
        if c in set_to:
            return F.when(touched, set_to[c]).otherwise(old)
        if c in update:
            return F.when(touched, new).otherwise(old)
        if c in coalesce:
            return F.coalesce(new, old)
        return F.when(F.col("_old").isNull(), new).otherwise(old)

    return met.select(*(value(c).cast(target.schema[c].dataType).alias(c) for c in target.columns))


def ignoring_case(df: DataFrame, *columns: str) -> DataFrame:
    """`df` with these texts compared without regard to case, in every join, grouping and filter behind; they keep their spelling."""
    return df.withColumns({c: F.collate(F.col(c), "UTF8_LCASE") for c in columns})


def initial_cursor(processed: DataFrame) -> DataFrame:
    """One row: the history id of the first message, by `ordinal`, that was processed; NULL if none was."""
    return processed.agg(F.min_by("history_id", F.when(F.col("succeeded"), F.col("ordinal"))).alias("cursor"))


def advance_cursor(accounts: DataFrame, run: DataFrame, as_of: Column) -> DataFrame:
    """Accounts with `last_history_id` and `last_query` set where a run (account_id, errors, cursor) ended without errors. Blank cursors are NULL."""
    done = run.where("errors = 0").select(F.col("account_id").alias("_account"), F.nullif(F.col("cursor"), F.lit("")).alias("_cursor"), F.lit(True).alias("_done"))
    met = accounts.join(done, accounts["id"] == done["_account"], "left")
    set_ = lambda new, old: F.when(F.col("_done"), new).otherwise(old)
    last = F.col("last_query") if "last_query" in accounts.columns else F.lit(None).cast("timestamp_ntz")
    kept = [c for c in accounts.columns if c not in ("last_history_id", "last_query")]
    return met.select(*kept, set_(F.col("_cursor"), F.col("last_history_id")).alias("last_history_id"), set_(as_of, last).alias("last_query"))


def retain(classified: DataFrame) -> DataFrame:
    """Discarded documents are counted elsewhere and never stored."""
    return classified.where("classification <> 'DESCARTAR'")


def document_paths(ledger: DataFrame, roots: Mapping[str, str] | None = None) -> DataFrame:
    """`path` of each document: root by class, date, message, and the stem with twelve digits of the origin's hash."""
    roots = roots or {"FACTURA": "invoices"}
    root = F.when(F.col("classification") == "FACTURA", roots["FACTURA"]).otherwise(roots.get("REVISAR", "review"))
    stem = safe_segment(file_stem(F.col("name")))
    stem = F.when(F.trim(stem) == "", "documento").otherwise(stem)
    name = F.concat(stem, F.lit("_"), F.substring("origin_hash", 1, 12), safe_extension(file_ext(F.col("name"))))
    return ledger.withColumn("path", F.concat_ws("/", root, date_path(F.col("received"), F.col("message_id")), name))


#: What a store of documents is partitioned by.
DAY = ("classification", "y", "m", "d")
ROWS_A_TASK = 1_000_000


def with_day(documents: DataFrame) -> DataFrame:
    return documents.withColumns({"y": F.date_format("received", "yyyy"), "m": F.date_format("received", "MM"), "d": F.date_format("received", "dd")})


def stored_on_days(stored: DataFrame, batch: DataFrame) -> DataFrame:
    """Rows of the store in the partitions (class and day) that the batch has rows in; the others are not opened. The days of a batch are
    few, whatever its rows: at most two for each day of mail."""
    days = retain(batch).select(*DAY).distinct()
    return stored.join(F.broadcast(days), list(DAY), "left_semi")


def write_documents(documents: DataFrame, root: str, order: Sequence[str] = ("origin_hash", "name")) -> None:
    """New paths only, partitioned by class and day; a path that is there stays as it is, and of a batch's rows of one path the first by `order` is
    written. Discarded documents are not. A path holds its class and day, so only the batch's own partitions are searched."""
    spark = documents.sparkSession
    documents = with_day(documents)
    # rows of one path are of one class and day, so days and counts are those of all rows: no need to find the first of each path for them
    given = retain(documents)
    fresh = retain(first_of_key(documents, ["path"], order))
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(root)
    if jvm_path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(jvm_path):
        stored = spark.read.schema(fresh.schema).parquet(root)
        fresh = fresh.join(stored_on_days(stored, given).select("path"), "path", "left_anti")
    # a day's rows lie in one task, or in as many as the batch's rows ask for; the days are few and their counts small enough to broadcast
    counts = given.groupBy(*DAY).agg(F.ceil(F.count(F.lit(1)) / ROWS_A_TASK).alias("_tasks"))
    dealt = fresh.join(F.broadcast(counts), list(DAY)).withColumn("_task", F.pmod(F.xxhash64("path"), F.col("_tasks")))
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt.repartition(tasks, *DAY, "_task").drop("_tasks", "_task").write.mode("append").partitionBy(*DAY).parquet(root)


def resolve_path_collisions(df: DataFrame) -> DataFrame:
    """One row for each (path, hash); the first hash keeps the path, others get the hash's first eight digits before the extension."""
    once = df.dropDuplicates(["path", "hash"])
    # met by path and hash, not by a window over the path: of one path there may be a hash for every row. NULL is a path, and the first hash
    first = once.groupBy("path").agg(F.min(F.struct("hash")).alias("_h")).select(F.col("path").alias("_p"), F.col("_h.hash").alias("_h"), F.lit(True).alias("_first"))
    moved = F.concat(F.regexp_extract("path", r"(?s)^(.*?)(\.[^./]*)?$", 1), F.lit("_"), F.substring("hash", 1, 8), F.regexp_extract("path", r"(?s)^(.*?)(\.[^./]*)?$", 2))
    met = once.join(first, once["path"].eqNullSafe(F.col("_p")) & once["hash"].eqNullSafe(F.col("_h")), "left")
    return met.withColumn("path", F.when(F.col("_first").isNull(), moved).otherwise(F.col("path"))).select(*df.columns)
