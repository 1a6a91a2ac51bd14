"""Shortest-pack-first packing over the length histogram.

Documents are encoded and cut in pieces of at most `size` ids. The histogram of piece lengths has at most `size` rows, whatever the
input, so it is packed on the driver: lengths go longest first, each into the emptiest pattern that has room, and patterns carry
counts instead of sequences. The patterns then say for each length which ranks go to which sequence and offset, and pieces meet
them by their rank among pieces of their length. Ranks are counted in salted buckets, so a length that a third of all pieces
share is not ranked by one task.

Every sequence is padded to `size`; a sequence is left unpadded only where it ends at a power of two, which needs no marks here:
offsets are gapless from 0 and padding is what follows the last piece.

Edge cases: a null or empty text is one piece that holds the end id; a null doc_id is packed like any other; repeated rows are
packed once each; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import stored, text_bytes, tidy
from .encode import END, encoder, vocabulary_path

#: Pre-tokens in the encoder's cache, of which there are two at most; it stays with the worker.
HELD = 100_000
PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


def pieces(docs: DataFrame, size: int = 4096, tokenizer: str | None = None) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens of each cut; ids end with the end id."""
    path = tokenizer or vocabulary_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, end = encoder(path, HELD), np.array([END], "<u4")
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text")):
                ids = np.r_[enc.ids(text.as_py()).astype("<u4"), end]
                for at in range(0, len(ids), size):
                    cut = ids[at : at + size]
                    rows.append((doc_id, at, len(cut), zlib.crc32(cut.tobytes()), len(ids)))
            columns = zip(*rows) if rows else [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    return text_bytes(docs).mapInArrow(tidy(run), PIECE)


Pattern = tuple[tuple[int, int], ...]  # (length, times), longest first


def shortest_pack_first(histogram: dict[int, int], size: int) -> list[tuple[Pattern, int]]:
    """histogram: length -> count. Patterns with the number of sequences that follow each."""
    by_room: list[list[tuple[Pattern, int]]] = [[] for _ in range(size + 1)]
    some = np.zeros(size + 1, bool)

    def put(room: int, pattern: Pattern, count: int) -> None:
        if count:
            by_room[room].append((pattern, count))
            some[room] = True

    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        while left:
            free = np.flatnonzero(some[length:])
            if not len(free):  # new sequences; each is the only one with room until it has none for this length
                fit = size // length
                whole, rest = divmod(left, fit)
                put(size - fit * length, ((length, fit),), whole)
                put(size - rest * length, ((length, rest),), min(rest, 1))
                break
            room = int(free[-1]) + length
            pattern, count = by_room[room].pop()
            some[room] = bool(by_room[room])
            take = min(count, left)
            last, times = pattern[-1]
            longer = (*pattern[:-1], (last, times + 1)) if last == length else (*pattern, (length, 1))
            put(room, pattern, count - take)
            put(room - length, longer, take)
            left -= take
    return [x for of_room in by_room for x in of_room]


def assignments(patterns: list[tuple[Pattern, int]]) -> list[tuple[int, int, int, int, int]]:
    """(length, first rank, end rank, sequence of the first rank, offset): ranks of a length in the order of the patterns."""
    used: dict[int, int] = {}
    out, sequence = [], 0
    for pattern, count in patterns:
        at = 0
        for length, times in pattern:
            for _ in range(times):
                first = used.get(length, 0)
                used[length] = first + count
                out.append((length, first, first + count, sequence, at))
                at += length
        sequence += count
    return out


def in_blocks(rows: list[tuple[int, int, int, int, int]]) -> tuple[list[tuple], dict[int, int]]:
    """The assignments with a block of ranks before them, and how many ranks of each length make a block: as many as an assignment has on
    average, so a piece meets about two assignments of its length, and there are at most twice as many rows."""
    ends: dict[int, int] = {}
    times: dict[int, int] = {}
    for length, _, last, _, _ in rows:
        ends[length] = max(ends.get(length, 0), last)
        times[length] = times.get(length, 0) + 1
    width = {length: -(-ends[length] // times[length]) for length in ends}
    return [(length, block, *rest) for length, *rest in rows for block in range(rest[0] // width[length], (rest[1] - 1) // width[length] + 1)], width


def _table(spark: SparkSession, rows: list[tuple], *names: str) -> DataFrame:
    """Rows of whole numbers, handed over in Arrow's form: as Python objects they would ask for workers of their own to be read."""
    return spark.createDataFrame(pa.table([pa.array(c, pa.int64()) for c in zip(*rows)], names=list(names)))


def pack(docs: DataFrame, size: int = 4096, tokenizer: str | None = None, bucket_rows: int = 200_000) -> DataFrame:
    """All pieces with sequence_id and offset."""
    spark = docs.sparkSession
    cut = stored(pieces(docs, size, tokenizer), "pieces")
    histogram = {r["length"]: r["n"] for r in cut.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    rows, width = in_blocks(assignments(shortest_pack_first(histogram, size)))
    slots = _table(spark, rows or [(0, 0, 0, 0, 0, 0)], "length", "block", "first", "last", "sequence", "offset")
    widths = _table(spark, list(width.items()) or [(0, 1)], "length", "width")  # at most `size` rows
    buckets = max(64, -(-max(histogram.values(), default=0) // bucket_rows))
    salted = cut.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), F.lit(buckets)))
    ranked = salted.withColumn("r", F.row_number().over(Window.partitionBy("length", "bucket").orderBy("doc_id", "start", "ids_crc32")) - 1)
    before = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    counts = salted.groupBy("length", "bucket").agg(F.count(F.lit(1)).alias("n"))
    counts = counts.select("length", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    ranked = ranked.join(counts, ["length", "bucket"]).withColumn("rank", F.col("base") + F.col("r"))
    ranked = ranked.join(F.broadcast(widths), "length").withColumn("block", F.floor(F.col("rank") / F.col("width"))).alias("p")
    if len(rows) <= 500_000:  # 48 bytes each; the number of patterns depends on `size`, not on the input
        slots = F.broadcast(slots)
    slots = slots.alias("s")
    met = ranked.join(slots, (F.col("p.length") == F.col("s.length")) & (F.col("p.block") == F.col("s.block")) & (F.col("rank") >= F.col("first")) & (F.col("rank") < F.col("last")))
    sequence = (F.col("sequence") + F.col("rank") - F.col("first")).alias("sequence_id")
    return met.select("doc_id", "start", F.col("p.length").alias("length"), "ids_crc32", "doc_tokens", sequence, "offset")
