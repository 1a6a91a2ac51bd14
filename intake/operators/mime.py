"""Messages: headers, the tree of parts, and the rows that reports need."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.shared import checkpointed

#: Fixed values.
NO_SENDER = "Remitente no disponible"


def header_value(headers: Column, name: str) -> Column:
    """The first header of a name, in any case; NULL if there is none."""
    return F.try_element_at(F.filter(headers, lambda h: F.lower(h["name"]) == name.lower()), F.lit(1))["value"]


def map_messages(raw: DataFrame, as_of: Column) -> DataFrame:
    """raw: id, thread_id, internal_date (ms), snippet, headers. A missing or impossible date is the processing time."""
    moment = F.when(F.col("internal_date") > 0, F.timestamp_millis("internal_date").cast("timestamp_ntz")).otherwise(as_of.cast("timestamp_ntz"))
    sender = header_value(F.col("headers"), "From")
    return raw.select(
        F.col("id").alias("message_id"), "thread_id", moment.alias("received"), F.when(F.coalesce(F.trim(sender), F.lit("")) != "", sender).otherwise(NO_SENDER).alias("sender"),
        header_value(F.col("headers"), "Subject").alias("subject"), "snippet",
    )


def is_attachment_part(df: DataFrame) -> Column:
    """A file name, and an attachment id or inline data."""
    there = lambda c: F.coalesce(F.trim(df[c]), F.lit("")) != ""
    return there("file_name") & (there("attachment_id") | there("inline_data"))


_FIELDS = {"file_name": "$.filename", "mime_type": "$.mimeType", "attachment_id": "$.body.attachmentId", "inline_data": "$.body.data"}


def _fields(v: Column) -> dict[str, Column]:
    return {k: F.try_variant_get(v, p, "string") for k, p in _FIELDS.items()} | {"declared_size": F.try_variant_get(v, "$.body.size", "int")}


PARTS = ("message_id", "part_id", "file_name", "mime_type", "attachment_id", "inline_data", "declared_size")


def _part_id(v: Column, path: Column) -> Column:
    own = F.try_variant_get(v, "$.partId", "string")
    return F.when(F.coalesce(F.trim(own), F.lit("")) != "", own).otherwise(path)


class TooDeep(RuntimeError):
    """A tree of parts has more levels than allowed."""


def _descend(nodes: DataFrame, levels: int) -> tuple[DataFrame, DataFrame]:
    """nodes: message_id, part, path. (attachment parts of these nodes and of what lies below them, nodes that lie `levels` levels below).

    One pass: a node that is met becomes itself and its parts, and its parts are met at the next level. What is found is stored in one table,
    so nothing above runs again, and only nodes that lie deeper keep their tree there.
    """
    rows = nodes.select("message_id", "part", "path", F.lit(True).alias("open"))
    for _ in range(levels):
        parts = F.coalesce(F.when(F.col("open"), F.try_variant_get("part", "$.parts", "array<variant>")), F.array().cast("array<variant>"))
        met = rows.select("message_id", "path", F.posexplode(F.array_prepend(parts, F.col("part"))).alias("_i", "_p"))
        path = F.when(F.col("_i") == 0, F.col("path")).otherwise(F.concat("path", F.lit("."), (F.col("_i") - 1).cast("string")))
        rows = met.select("message_id", F.col("_p").alias("part"), path.alias("path"), (F.col("_i") > 0).alias("open"))
    rows = rows.select("message_id", _part_id(F.col("part"), F.col("path")).alias("part_id"), *(c.alias(k) for k, c in _fields(F.col("part")).items()), "path", "open", F.when(F.col("open"), F.col("part")).alias("part"))
    rows = checkpointed(rows.where(F.col("open") | is_attachment_part(rows)))
    return rows.where("NOT open").select(*PARTS), rows.where("open").select("message_id", "part", "path")


def _trees(raw: DataFrame) -> DataFrame:
    return raw.select(F.col("id").alias("message_id"), F.col("payload").alias("part"), F.lit("0").alias("path"))


def flatten_parts(raw: DataFrame, max_depth: int = 1000, levels: int = 4) -> DataFrame:
    """raw: id, payload (variant). The attachment parts of each message's tree, however deep; a part without an id of its own has
    its path, `0.i.j`. `levels` levels in one pass, so no number of rows is too large.

    What a pass finds, and the nodes below it, are checkpointed (`spark.checkpoint.dir`) until nothing is left: whatever made `raw` runs once,
    and no level needs a shuffle. Trees beyond `max_depth` raise TooDeep; nothing is dropped.
    """
    level, out = _trees(raw), []
    for depth in range(0, max_depth + 1, levels):
        found, level = _descend(level, min(levels, max_depth + 1 - depth))
        out.append(found)
        if level.isEmpty():
            return reduce(DataFrame.unionByName, out)
    raise TooDeep(f"parts lie more than {max_depth} levels deep")


def flatten_parts_recursive(raw: DataFrame, levels: int = 4) -> DataFrame:
    """The same with a recursive query, which shuffles all it has found at each level; so it begins `levels` levels below the root, where most trees
    have ended. Spark bounds its depth (100 levels from there, beyond which it raises). LIMIT ALL lifts its bound on rows."""
    above, deeper = _descend(_trees(raw), levels)
    found = raw.sparkSession.sql(
        """
        WITH RECURSIVE tree(message_id, part, path) AS (
          SELECT message_id, part, path FROM {deeper}
          UNION ALL
          SELECT t.message_id, e.value, concat(t.path, '.', CAST(e.pos AS STRING)) FROM tree t, LATERAL variant_explode(try_variant_get(t.part, '$.parts', 'variant')) e
        ) SELECT * FROM tree LIMIT ALL""",
        deeper=deeper,
    )
    rows = found.select("message_id", _part_id(F.col("part"), F.col("path")).alias("part_id"), *(c.alias(k) for k, c in _fields(F.col("part")).items()))
    return above.unionByName(rows.where(is_attachment_part(rows)).select(*PARTS))
