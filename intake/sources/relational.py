"""The four tables of the engine in a relational database, read in slices with typed columns."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Columns and types of the tables; every column but the first may be NULL.
TABLES = {
    "accounts": "id bigint, email string, active boolean, has_token boolean, last_history_id string",
    "messages": "id bigint, account_id bigint, message_id string, received timestamp_ntz, sender string, subject string, snippet string",
    "attachments": "id bigint, message bigint, part_id string, size_bytes bigint, path string, hash string, downloaded timestamp_ntz, state string",
    "ledger": "id bigint, message bigint, part_id string, origin string, origin_hash string, name string, classification string, confidence smallint, classified timestamp_ntz",
}


def read_relational(spark: SparkSession, url: str, tables: Mapping[str, str] = TABLES, slices: int = 8, slice_by: str = "id", options: Mapping[str, str] | None = None) -> dict[str, DataFrame]:
    """The named tables through JDBC, each with the columns and types of its schema only, in `slices` ranges of the number `slice_by`, which are
    read by as many tasks. The ranges are laid between the least and the greatest number, which the database finds; filters and columns that a query
    needs go to the database with each range, those on texts as well: the types are the reader's own, not casts behind it, which would keep such
    filters here. An empty table is one range."""
    out = {}
    for name, ddl in tables.items():
        fields = T.StructType.fromDDL(ddl)
        reader = spark.read.format("jdbc").option("url", url).option("dbtable", name).option("customSchema", ddl).option("preferTimestampNTZ", "true").options(**(options or {}))
        low, high = reader.load().agg(F.min(slice_by), F.max(slice_by)).first()
        if low is not None and high > low:
            reader = reader.option("partitionColumn", slice_by).option("lowerBound", low).option("upperBound", high + 1).option("numPartitions", slices)
        found = reader.load()
        out[name] = found.select(*(F.col(f.name) if found.schema[f.name].dataType == f.dataType else F.col(f.name).cast(f.dataType).alias(f.name) for f in fields))
    return out
