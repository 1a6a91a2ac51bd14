"""Container policy: which entries of an archive are accepted, and when a whole container is refused.

A container fails at its first violation: too many entries or bytes for its tree, an entry too large, encrypted, a link, a blank, rooted
or drive path, one that leaves the container, two entries at one path (letters of either case), a chain too long. A failed container
loses its entries and becomes one review row. One level is decided by window functions; nested trees, which share one budget in reading
order, by window functions over the places of their entries in that order.
"""

from __future__ import annotations

import io
import zipfile
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce
from operator import or_

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Limits:
    entries: int = 200
    entry_bytes: int = 52_428_800
    total_bytes: int = 262_144_000
    depth: int = 2
    chain: int = 2000
    read_bytes: int = 81_920


LIMITS = Limits()
#: First failing check of an entry, in this order.
FAILURES = ("entries", "unsupported", "path", "traversal", "collision", "entry_bytes", "total_bytes", "chain")


#: What one task sorts, several times over.
ROWS_A_TASK = 250_000


def tasks_by_root(entries: DataFrame, rows: int = ROWS_A_TASK) -> Callable[[DataFrame], DataFrame]:
    """Deals rows by their root to as many tasks as these entries ask for, so that what a task holds does not grow with the input. Where the
    session's own number of tasks is enough, rows stay as they are. A root stays in one task."""
    n = -(-entries.count() // rows)
    return lambda df: df.repartition(n, "root_id") if n > int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) else df


def container_chain(parent: Column, key: Column) -> Column:
    return F.concat_ws("!/", parent, key)


def _levels(key: Column) -> Column:
    """How deep a path is after each of its parts; below 0 it has left its container."""
    parts = F.filter(F.split(F.translate(key, "\\", "/"), "/"), lambda x: (x != "") & (x != "."))
    steps = F.transform(parts, lambda x: F.when(x == "..", -1).otherwise(1))
    seen = F.transform(steps, lambda x, i: F.aggregate(F.slice(steps, 1, i + 1), F.lit(0), lambda a, b: a + b))
    return F.coalesce(F.array_min(seen), F.lit(1))


#: Paths with an empty part, `.`, `..` or a backslash; the others are their own normal form.
_UNTIDY = r"(^|/)\.{0,2}(/|$)|\\"


def _leaves(key: Column) -> Column:
    """The path leaves its container. Only one with `..` can, so others are not walked."""
    return F.contains(key, F.lit("..")) & (_levels(key) < 0)


def normal_path(key: Column) -> Column:
    """The path inside the container in lower case, `.` and empty parts dropped and `..` resolved."""
    return F.when(key.rlike(_UNTIDY), _resolved(key)).otherwise(F.lower(key))


def _resolved(key: Column) -> Column:
    parts = F.filter(F.split(F.translate(F.lower(key), "\\", "/"), "/"), lambda x: (x != "") & (x != "."))
    stack = F.aggregate(parts, F.array().cast("array<string>"), lambda a, x: F.when(x == "..", F.slice(a, 1, F.greatest(F.size(a) - 1, F.lit(0)))).otherwise(F.array_append(a, x)))
    return F.array_join(stack, "/")


def with_running_budget(entries: DataFrame) -> DataFrame:
    """`n_seen` and `bytes_seen` of each tree up to each entry, in reading order; directories count as entries, without bytes."""
    so_far = Window.partitionBy("root_id").orderBy("ordinal").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    own = F.when(F.col("is_directory"), 0).otherwise(F.col("entry_bytes"))
    return entries.withColumns({"n_seen": F.count(F.lit(1)).over(so_far), "bytes_seen": F.sum(own).over(so_far)})


def with_path_collision(entries: DataFrame) -> DataFrame:
    """`collides`: another file entry of the container has the same path before."""
    place = F.row_number().over(Window.partitionBy("root_id", "_path").orderBy("ordinal"))
    keyed = entries.withColumn("_path", F.when(F.col("is_directory"), F.concat(F.lit("/dir/"), F.col("ordinal").cast("string"))).otherwise(normal_path(F.col("entry_key"))))
    return keyed.withColumn("collides", ~F.col("is_directory") & (place > 1)).drop("_path")


def with_failure(entries: DataFrame, limits: Limits = LIMITS) -> DataFrame:
    """`failure`: the first check that an entry does not pass, NULL if it passes all. The chain of an entry begins with `root_name`, the
    container's own name or chain, where the entries have that column."""
    e = with_path_collision(with_running_budget(entries))
    root = F.coalesce("root_name", F.lit("")) if "root_name" in entries.columns else F.lit("")
    file, key = ~F.col("is_directory"), F.coalesce("entry_key", F.lit(""))
    linked = F.coalesce(F.col("link_target"), F.lit("")) != ""
    # an entry is read block by block: the limit that an earlier block crosses counts, and in one block the entry's own
    left = limits.total_bytes - (F.col("bytes_seen") - F.col("entry_bytes"))
    entry_first = F.lit(limits.entry_bytes // limits.read_bytes) <= F.floor(left / F.lit(limits.read_bytes))
    failure = (
        F.when(F.col("n_seen") > limits.entries, "entries")
        .when(file & (F.col("is_encrypted") | linked), "unsupported")
        .when(file & ((F.trim(key) == "") | key.rlike(r"^[/\\]") | F.contains(key, F.lit(":"))), "path")
        .when(file & _leaves(key), "traversal")
        .when(F.col("collides"), "collision")
        .when(file & (F.col("entry_bytes") > limits.entry_bytes) & entry_first, "entry_bytes")
        .when(file & (F.col("bytes_seen") > limits.total_bytes), "total_bytes")
        .when(file & (F.length(container_chain(root, key)) > limits.chain), "chain")
    )
    return e.withColumn("failure", failure)


def first_violation(entries: DataFrame, limits: Limits = LIMITS) -> DataFrame:
    """`failed_at`: the ordinal of the container's first failing entry; what follows is not looked at."""
    return with_failure(entries, limits).withColumn("failed_at", F.min(F.when(F.col("failure").isNotNull(), F.col("ordinal"))).over(Window.partitionBy("root_id")))


def apply_container_policy(entries: DataFrame, limits: Limits = LIMITS) -> tuple[DataFrame, DataFrame]:
    """One level: (accepted entries, refused containers with the failure)."""
    judged = first_violation(entries, limits)
    accepted = judged.where("failed_at IS NULL AND NOT is_directory").select(*entries.columns)
    refused = judged.where("ordinal = failed_at").select("root_id", "ordinal", "failure")
    return accepted, refused


def container_rollup(entries: DataFrame, limits: Limits = LIMITS) -> DataFrame:
    """root_id, n_analysed (0 if the container failed), failed."""
    judged = first_violation(entries, limits)
    ok = F.col("failed_at").isNull()
    return judged.groupBy("root_id").agg(F.count_if(ok & ~F.col("is_directory")).alias("n_analysed"), F.bool_or(~ok).alias("failed"))


def _own_checks(entries: DataFrame, limits: Limits) -> DataFrame:
    """`_static`: the first check an entry fails whatever the tree has spent; `_cost`: the bytes read of it, up to the block that crosses the
    limit of an entry; `_stop`: the place of its container's first entry of that kind."""
    inside = Window.partitionBy("root_id", "_in")
    same = Window.partitionBy("root_id", "_in", "_path").orderBy("_place")
    key, size = F.col("entry_key"), F.col("entry_bytes")
    before = (
        F.when(F.col("is_directory"), None)
        .when(F.col("is_encrypted") | (F.col("link_target") != ""), "unsupported")
        .when(key.rlike(r"(?U)^\s*$") | key.rlike(r"^[/\\]") | F.contains(key, F.lit(":")), "path")
        .when(_leaves(key), "traversal")
        .when(F.row_number().over(same) > 1, "collision")
    )
    crossing = (limits.entry_bytes // limits.read_bytes + 1) * limits.read_bytes
    passed = ~F.col("is_directory") & F.col("_before").isNull()
    checked = entries.withColumn("_path", F.when(F.col("is_directory"), F.concat(F.lit("/"), F.col("_place").cast("string"))).otherwise(normal_path(key))).withColumn("_before", before)
    checked = checked.withColumns({
        "_own": container_chain(F.col("_chain"), key),
        "_cost": F.when(passed, F.when(size > limits.entry_bytes, F.least(size, F.lit(crossing))).otherwise(size)).otherwise(0),
    })
    after = F.when(size > limits.entry_bytes, "entry_bytes").when(F.length("_own") > limits.chain, "chain")
    checked = checked.withColumn("_static", F.coalesce("_before", F.when(passed, after)))
    return checked.withColumn("_stop", F.min(F.when(F.col("_static").isNotNull(), F.col("_place"))).over(inside))


def _read_trees(entries: DataFrame, limits: Limits, deal: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Entries down to `limits.depth` that no check of their own, or of an archive around them, keeps from being read. `_at` is the place in
    reading order: the entry's number in each container from the root on, which sorts an archive before what lies in it."""
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    place = F.row_number().over(Window.partitionBy("root_id", "container_id").orderBy("ordinal", "entry_key", "child_id"))
    rows = deal(entries.select(
        "root_id", "container_id", "ordinal", text("entry_key").alias("entry_key"), F.coalesce(F.col("entry_bytes").cast("long"), F.lit(0)).alias("entry_bytes"), text("link_target").alias("link_target"),
        *(F.coalesce(F.col(c), F.lit(False)).alias(c) for c in ("is_directory", "is_encrypted")), "child_id", text("root_name").alias("root_name"),
    )).withColumn("_place", place).where(F.col("_place") <= limits.entries + 1)
    level = rows.where("container_id = root_id").withColumns({
        "_in": F.array().cast("array<int>"), "_chain": F.col("root_name"), "_in_ordinal": F.lit(0), "_in_key": F.col("root_name"),
    })
    levels = []
    for depth in range(1, limits.depth + 1):
        read = _own_checks(level.drop("root_name"), limits).where("_stop IS NULL OR _place <= _stop").withColumn("_at", F.array_append("_in", F.col("_place")))
        levels.append(read)
        if depth < limits.depth:
            archives = read.where("child_id IS NOT NULL AND _static IS NULL AND NOT is_directory").select(
                "root_id", F.col("child_id").alias("container_id"), F.col("_at").alias("_in"), F.col("_own").alias("_chain"), F.col("ordinal").alias("_in_ordinal"), F.col("entry_key").alias("_in_key"))
            level = deal(rows.join(archives, ["root_id", "container_id"]))
    return deal(reduce(DataFrame.unionByName, levels))


def apply_nested_policy(entries: DataFrame, limits: Limits = LIMITS) -> DataFrame:
    """Trees of containers: entries with container_id, child_id (the container that an entry is, else NULL) and the root's `root_name`; the
    root's own entries have its root_id as container_id. Gives accepted entries and one row with the failure for each refused container.

    The tree has one budget, spent in reading order and never given back. What fails by itself is known without it. Sums over the rest are
    right up to the first entry that finds the budget spent; its container ends there, the sums are formed again, and the next such entry
    lies in a container around it. So there are at most `limits.depth` rounds. A tree keeps `limits.entries + 1` entries of a container.
    NULL keys are blank, NULL sizes 0, NULL flags false; of entries with one ordinal the lesser key is read first.
    """
    tree = Window.partitionBy("root_id")
    so_far = tree.orderBy("_at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    read = _read_trees(entries, limits, tasks_by_root(entries))
    full = F.col("n_seen") > limits.entries
    spent = (F.col("_cost") > 0) | (~F.col("is_directory") & F.col("_before").isNull())
    over = full | (spent & (F.col("bytes_seen") > limits.total_bytes))
    container = lambda path: F.slice(path, 1, F.size(path) - 1)
    read = read.withColumn("_ended", F.lit(False))
    for _ in range(limits.depth):
        read = read.withColumns({"n_seen": F.count(F.lit(1)).over(so_far), "bytes_seen": F.sum("_cost").over(so_far)})
        read = read.withColumn("_first", F.min(F.when(over & ~F.col("_ended"), F.col("_at"))).over(tree))
        first, at = F.col("_first"), F.col("_at")
        within = F.slice(at, 1, F.size(first) - 1) == container(first)
        read = read.where(first.isNull() | ~within | (at <= first)).withColumn("_ended", F.col("_ended") | F.coalesce(at == first, F.lit(False)))
    read = read.withColumns({"n_seen": F.count(F.lit(1)).over(so_far), "bytes_seen": F.sum("_cost").over(so_far)})
    # a large entry in a budget nearly spent: the limit that an earlier block crosses counts
    left = limits.total_bytes - (F.col("bytes_seen") - F.col("_cost"))
    taken = F.least(F.col("entry_bytes"), (F.floor(F.least(left, F.lit(limits.entry_bytes)) / F.lit(limits.read_bytes)) + 1) * limits.read_bytes)
    failure = (
        F.when(full, "entries").when(F.col("_before").isNotNull(), F.col("_before")).when(F.col("is_directory"), None)
        .when(F.col("entry_bytes") > limits.entry_bytes, F.when(taken > limits.entry_bytes, "entry_bytes").otherwise("total_bytes"))
        .when(F.col("bytes_seen") > limits.total_bytes, "total_bytes").otherwise(F.col("_static"))
    )
    judged = read.withColumn("failure", failure)
    failed, deep = F.col("failure").isNotNull(), F.size("_at")
    around = [F.max(failed & (deep == j + 1)).over(Window.partitionBy("root_id", F.slice("_at", 1, j))) for j in range(limits.depth)]
    judged = judged.withColumns({f"_refused{j}": w for j, w in enumerate(around)})
    #: a container around the entry's own one was refused
    outer = reduce(or_, (F.col(f"_refused{j}") & (deep > j + 1) for j in range(limits.depth)), F.lit(False))
    lost = outer | reduce(or_, (F.col(f"_refused{j}") & (deep == j + 1) for j in range(limits.depth)))
    too_deep = F.col("child_id").isNotNull() & (deep == limits.depth)
    kept = ~lost & ~F.col("is_directory") & (F.col("child_id").isNull() | too_deep)
    pick = lambda refused, below, own: F.when(failed, refused).when(too_deep, below).otherwise(own)
    return judged.where((failed & ~outer) | kept).select(
        "root_id",
        pick(F.col("container_id"), F.col("child_id"), F.col("container_id")).cast("long").alias("container_id"),
        F.when(failed, F.col("_in_ordinal")).otherwise(F.col("ordinal")).cast("int").alias("ordinal"),
        F.when(failed, F.col("_in_key")).otherwise(F.col("entry_key")).alias("entry_key"),
        F.when(failed, F.col("_chain")).otherwise(F.col("_own")).alias("chain"),
        F.when(failed | too_deep, "refused").otherwise("accepted").alias("outcome"),
        pick(F.col("failure"), F.lit("depth"), F.lit(None)).alias("failure"),
    )


EXPANDED = "name string, ordinal int, entry_key string, entry_bytes long, is_directory boolean, is_encrypted boolean, content binary, failure string"
_ENTRY = pa.schema({"name": pa.string(), "ordinal": pa.int32(), "entry_key": pa.string(), "entry_bytes": pa.int64(), "is_directory": pa.bool_(), "is_encrypted": pa.bool_(), "content": pa.binary(), "failure": pa.string()})
#: A batch of entries goes on when it holds so many, or bytes of content.
BATCH_ROWS, BATCH_BYTES = 2000, 8 << 20


def _entries(name: str | None, data: bytes | None, limits: Limits) -> Iterator[tuple]:
    """The entries of one file as rows of `EXPANDED`, up to the first failure."""
    total = 0
    try:
        with zipfile.ZipFile(io.BytesIO(data or b"")) as z:
            for i, info in enumerate(z.infolist()):
                locked, body, failure = bool(info.flag_bits & 1), None, None
                if i >= limits.entries:
                    failure = "entries"
                elif not locked and not info.is_dir():
                    room = min(limits.entry_bytes, limits.total_bytes - total)
                    with z.open(info) as stream:
                        body = stream.read(room + 1)
                    if len(body) > room:
                        body, failure = None, "entry_bytes" if room == limits.entry_bytes else "total_bytes"
                    else:
                        total += len(body)
                yield name, i + 1, info.filename, info.file_size, info.is_dir(), locked, body, failure
                if failure:
                    break
    except (zipfile.BadZipFile, NotImplementedError, RuntimeError, EOFError, OSError) as e:
        yield name, None, None, None, None, None, None, f"unreadable: {type(e).__name__}"


def expand_zip(files: DataFrame, name: str = "name", content: str = "content", limits: Limits = LIMITS) -> DataFrame:
    """One row for each entry of each ZIP file, read within the limits; what is no readable ZIP gives one row with the failure."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, held = [], 0
        for batch in batches:
            for file, data in zip(batch.column("name"), batch.column("content")):
                for row in _entries(file.as_py(), data.as_py(), limits):
                    rows.append(row)
                    held += len(row[6] or b"")
                    if len(rows) >= BATCH_ROWS or held >= BATCH_BYTES:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), _ENTRY.types)], schema=_ENTRY)
                        rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), _ENTRY.types)], schema=_ENTRY)

    return files.select(F.col(name).alias("name"), F.col(content).alias("content")).mapInArrow(run, EXPANDED)
