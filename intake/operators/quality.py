"""Data quality: canonical rows among duplicates, and the checks that the tables' constraints stand for."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

CLASSES = ("FACTURA", "REVISAR")
ORIGINS = ("DIRECTO", "ZIP")


def rank_canonical(attachments: DataFrame) -> DataFrame:
    """Rows with a part id, ranked within (message, part): whole downloads, other downloads, the rest; then by id."""
    whole = (F.col("state") == "Descargado") & F.col("path").isNotNull() & F.col("hash").isNotNull()
    quality = F.when(whole, 0).when(F.col("state") == "Descargado", 1).otherwise(2)
    order = Window.partitionBy("message", "part_id").orderBy(quality, "id")
    return attachments.where("part_id IS NOT NULL").withColumn("canonical_order", F.row_number().over(order))


def duplicate_groups(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys that occur more than once: n_rows, n_surplus, in key order."""
    counted = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_rows")).where("n_rows > 1")
    return counted.withColumn("n_surplus", F.col("n_rows") - 1).orderBy(*keys)


def consolidate_parts(attachments: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """kept (first of each part, and all rows without a part id), removed, and orphans (removed rows that leave a stored path)."""
    ranked = rank_canonical(attachments)
    kept = ranked.where("canonical_order = 1").drop("canonical_order").unionByName(attachments.where("part_id IS NULL"))
    removed = ranked.where("canonical_order > 1").drop("canonical_order")
    return kept, removed, removed.where("path IS NOT NULL")


def check_values(df: DataFrame, rules: Mapping[str, Column | str]) -> DataFrame:
    """Rows that break a rule, once for each, with its name as `rule`. NULL passes, as in a table constraint."""
    checks = F.array(*(F.struct(F.lit(n).alias("rule"), (F.expr(r) if isinstance(r, str) else r).alias("ok")) for n, r in rules.items()))
    broken = F.filter(checks, lambda x: ~x["ok"])
    return df.withColumn("_broken", F.explode(broken)).withColumn("rule", F.col("_broken.rule")).drop("_broken")


LEDGER_RULES = {
    "confidence": "confidence BETWEEN 0 AND 100",
    "classification": f"classification IN {CLASSES}",
    "origin": f"origin IN {ORIGINS}",
}
ATTACHMENT_RULES = {"size": "size_bytes >= 0"}


def check_unique(df: DataFrame, keys: Sequence[str], where: str | None = None) -> DataFrame:
    """Keys that occur more than once among the rows that `where` picks."""
    return duplicate_groups(df.where(where) if where else df, keys)


def check_foreign_key(child: DataFrame, parent: DataFrame, column: str, key: str) -> DataFrame:
    """Rows whose (non-null) `column` has no `key` in the parent."""
    keys = parent.select(F.col(key).alias("_key")).distinct()
    return child.where(F.col(column).isNotNull()).join(keys, child[column] == F.col("_key"), "left_anti")


def check_lengths(df: DataFrame, longest: Mapping[str, int], required: Sequence[str] = ()) -> DataFrame:
    """Rows with a text longer than allowed or a required NULL, with the rule's name."""
    rules = {f"{c} longer than {n}": F.length(c) <= n for c, n in longest.items()} | {f"{c} missing": F.col(c).isNotNull() for c in required}
    return check_values(df, rules)


def apply_defaults(df: DataFrame, defaults: Mapping[str, Column]) -> DataFrame:
    """NULLs replaced by a column's default; `as_of` moments are passed as literals, so results can be repeated."""
    return df.withColumns({c: F.coalesce(F.col(c), d) for c, d in defaults.items()})


def ensure_columns(df: DataFrame, schema: T.StructType | str) -> DataFrame:
    """Columns of `schema` that are missing are added as NULL; those that are there stay as they are."""
    fields = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    return df.withColumns({f.name: F.lit(None).cast(f.dataType) for f in fields if f.name not in df.columns})
