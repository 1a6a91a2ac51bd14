"""Payloads of message parts that lie in files, one a locator, and are read through Spark's `binaryFile` source.

A file is named by the SHA-256 of its locator, so that any text can be a locator, and lies in the folder of the name's first two digits, a
partition of the source. Files are moved to their names when they are whole: a task that is lost and run again leaves the same files.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import base64url_strict

MAX_BYTES = 52_428_800
FILES = "path string, modificationTime timestamp, length long, content binary, folder string"


def file_name(locator: Column) -> Column:
    return F.sha2(locator, 256)


def folder_of(name: Column) -> Column:
    # a letter before the digits: no folder reads as a number
    return F.concat(F.lit("f"), F.substring(name, 1, 2))


def write_payloads(payloads: DataFrame, root: str) -> int:
    """A file under `root` for each row of (locator, content); rows with a NULL give none. Spark
    leaves files without a byte out, so an empty content is a file of one byte that is named so. A locator's file is replaced, and of several rows of
    one locator the greatest content stays. Gives the number of files."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs
        from pyspark import TaskContext

        store, base = fs.FileSystem.from_uri(root)
        attempt, n = TaskContext.get().taskAttemptId(), 0
        for batch in batches:
            for folder, name, content in zip(*(batch.column(c) for c in ("folder", "name", "content"))):
                place = f"{base}/folder={folder}"
                store.create_dir(place, recursive=True)
                body = content.as_py()
                kind, other = ("bin", "empty") if body else ("empty", "bin")
                with store.open_output_stream(f"{place}/.{name}-{attempt}") as out:
                    out.write(body or b"0")
                store.move(f"{place}/.{name}-{attempt}", f"{place}/{name}.{kind}")
                if store.get_file_info(f"{place}/{name}.{other}").type != fs.FileType.NotFound:
                    store.delete_file(f"{place}/{name}.{other}")
                n += 1
        yield pa.RecordBatch.from_pydict({"n": [n]})

    once = payloads.where("locator IS NOT NULL AND content IS NOT NULL").groupBy("locator").agg(F.max("content").alias("content"))
    named = once.select(file_name(F.col("locator")).alias("name"), "content").select(folder_of(F.col("name")).alias("folder"), "name", "content")
    return named.mapInArrow(write, "n long").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]


def file_payloads(spark: SparkSession, root: str, max_bytes: int = MAX_BYTES) -> DataFrame:
    """folder, name, length, content, failure of each file. The length is tested by the source, so a file that is too large is listed and
    not opened: its content is NULL and its failure 'too_large'."""
    files = spark.read.format("binaryFile").schema(FILES).option("pathGlobFilter", "*.{bin,empty}").load(root)
    name, empty = F.regexp_extract("path", r"([0-9a-f]{64})\.(bin|empty)$", 1).alias("name"), F.col("path").endswith(".empty")
    length, content = F.when(empty, F.lit(0).cast("long")).otherwise(F.col("length")), F.when(empty, F.lit(b"")).otherwise(F.col("content"))
    read = files.where(F.col("length") <= max_bytes).select("folder", name, length.alias("length"), content.alias("content"), F.lit(None).cast("string").alias("failure"))
    listed = files.where(F.col("length") > max_bytes).select("folder", name, "length", F.lit(None).cast("binary").alias("content"), F.lit("too_large").alias("failure"))
    return read.unionByName(listed)


def part_content(parts: DataFrame, files: DataFrame) -> DataFrame:
    """`parts` with `content`, the bytes of each: its file's where `attachment_id` is not blank, else `inline_data` decoded; and `failure`, why
    there are none: 'missing' (no such file, or nothing inline), 'too_large', 'not_base64url'. No part is lost, whatever its file is like."""
    located = F.coalesce(F.trim("attachment_id"), F.lit("")) != ""
    asked = parts.withColumn("_name", F.when(located, file_name(F.col("attachment_id")))).withColumn("_folder", folder_of(F.col("_name")))
    held = files.select(F.col("folder").alias("_folder"), F.col("name").alias("_name"), F.col("content").alias("_bytes"), F.col("failure").alias("_why"), F.lit(True).alias("_there"))
    met = asked.join(held, ["_folder", "_name"], "left")
    inline = base64url_strict(F.col("inline_data"))
    blank = F.coalesce(F.trim("inline_data"), F.lit("")) == ""
    failure = (
        F.when(located, F.when(F.col("_there").isNull(), "missing").otherwise(F.col("_why")))
        .when(blank, "missing").when(inline.isNull(), "not_base64url")
    )
    made = met.select(*(F.col(f"`{c}`") for c in parts.columns if c not in ("content", "failure")), F.when(located, F.col("_bytes")).otherwise(inline).alias("content"), failure.alias("failure"))
    return made
