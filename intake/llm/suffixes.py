"""Removal of repeated byte strings by prefix doubling with Spark's sorts.

A byte goes if a string of `length` bytes that covers it also starts earlier: in a document with a smaller doc_id, or earlier in the
same one. Matches never cross documents, and all strings are judged on the input.

Prefix doubling ranks positions by a short prefix and ranks pairs of (rank, what follows at the next offset) again and again, until a
rank is unique or the prefix long enough. Here sorts by Spark rank at 32, 66, 93 and 100 bytes; what has a unique rank is never looked
at again:

1. `SEED` bytes, at sampled positions. Each string of `length` bytes chooses the least of the names in it (the leftmost of equals);
   equal strings choose the same one, so no repeat is lost, and neighbouring strings mostly share theirs. A row is a position, the run of
   strings that chose it, and a name of all bytes that these may cover (`around`).
2. and 3. The strings of a run are cut in parts by their distance from the sample, in two and then in eights: what all strings of a part
   share grows to two thirds of `length`, and then to all but seven bytes.
4. Whole strings, ranked by their bytes themselves. All but the first of a rank are repeats.

In rounds 1 to 3 rows that agree in rank and in all bytes around them with an earlier row (two names of 64 bits) are repeats as a whole; first
ones go on while their rank also stands in other surroundings. Names only decide what needs no further round; single strings are
equal only if their bytes are.

Skew: the rows of a batch are combined before each sort, so a passage that many documents hold reaches a task once a batch. A rank that
already has `HOT` surroundings in one batch is known to go on: its rows are dealt by rank and surroundings, and only one of them a batch
goes where other batches look for that rank. So a task gets less than `HOT` rows a batch of any one rank, however many documents share it.

Edge cases: a null text is empty; texts under `length` bytes lose nothing; rows with one doc_id are ordered by a hash of their text, rows
equal in both are one document given twice; null doc_ids come first; an empty table gives an empty result; very long texts are read in
blocks; other columns, whatever their names, are kept only by `drop_repeats`.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cache, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stored, tidy

SEED = 32
HOT = 4
BLOCK = 1 << 17
_ODD = np.uint64(0x9E3779B97F4A7C15)
_STEP = np.uint64(0xD6E8FEB86659FD93)
_FAR = np.uint64(0xC2B2AE3D27D4EB4F)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ x >> np.uint64(32)) * _STEP
    return x ^ x >> np.uint64(29)


@cache
def _powers(n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A number for each byte, and the powers of an odd number and of its inverse modulo 2**64."""
    letters = _mix(_mix((np.arange(256, dtype=np.uint64) + np.uint64(1)) * _ODD) + _FAR)
    up, down = np.full(n, _FAR), np.full(n, np.uint64(pow(int(_FAR), -1, 1 << 64)))
    up[0] = down[0] = 1
    return letters, np.multiply.accumulate(up), np.multiply.accumulate(down)


class Names:
    """Names (64-bit hashes) of any strings of some bytes, from sums over prefixes."""

    def __init__(self, data: np.ndarray):
        letters, up, down = _powers(1 << max(len(data), 1 << 10).bit_length())
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(letters[data] * up[: len(data)], out=self.sums[1:])
        self.down = down[: len(data) + 1]

    def all_of(self, size: int) -> np.ndarray:
        """A name for each string of `size` bytes."""
        n = max(len(self.sums) - size, 0)
        return _mix((self.sums[size : size + n] - self.sums[:n]) * self.down[:n])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return _mix((self.sums[end] - self.sums[start]) * self.down[start] + (end - start).astype(np.uint64) * _ODD)


def _window_least(x: np.ndarray, width: int) -> np.ndarray:
    """Index of the least of each `width` neighbours. The index stands in the low bits, as many in any block, so equal names give the leftmost."""
    low = np.uint64(20)
    if len(x) >> 20:
        raise ValueError("blocks are shorter than a million bytes")
    least = (x >> low << low) | np.arange(len(x), dtype=np.uint64)
    have = 1
    while have < width:
        step = min(have, width - have)
        least = np.minimum(least[:-step], least[step:])
        have += step
    return (least & ((np.uint64(1) << low) - np.uint64(1))).astype(np.int64)


@dataclass
class Batch:
    """The texts of an Arrow batch as one run of bytes. `rank`: the place of each document in the order of doc_id (nulls first) and h."""

    data: np.ndarray
    edges: np.ndarray
    ids: np.ndarray
    known: np.ndarray
    h: np.ndarray
    rank: np.ndarray

    @classmethod
    def read(cls, batch: pa.RecordBatch) -> Batch:
        data, edges = flat(batch.column("text"))
        ids, h = batch.column("doc_id"), batch.column("h").to_numpy(zero_copy_only=False)
        known, ids = ids.is_valid().to_numpy(zero_copy_only=False), ids.fill_null(0).to_numpy(zero_copy_only=False)
        order = np.lexsort((h, ids, known))
        new = np.ones(len(order), np.int64)
        if len(order):
            key = np.c_[known, ids, h][order]
            new[1:] = (key[1:] != key[:-1]).any(axis=1)
        rank = np.empty(len(order), np.int64)
        rank[order] = np.cumsum(new)
        return cls(data, edges, ids, known, h, rank)

    def doc_of(self, at: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.edges, at, "right") - 1


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a binary column behind each other, and where each value begins (and the last one ends)."""
    kind = np.int64 if pa.types.is_large_binary(column.type) else np.int32
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    edges = np.frombuffer(column.buffers()[1], kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    held = column.buffers()[2]
    data = np.frombuffer(held, np.uint8) if held is not None and held.size else np.zeros(0, np.uint8)
    return data[edges[0] : edges[-1]], edges - edges[0]


def samples(batch: Batch, length: int, block: int = BLOCK) -> tuple[np.ndarray, ...]:
    """name, surroundings' name, place, first and last string (by start) of each sample; places count from the batch's first byte."""
    reach, found = length - SEED, []
    n = len(batch.data)
    for begin in range(0, n, block):
        # strings that start in the block, and those that the runs of these may reach into; each run counts where it begins
        low, high = max(begin - length, 0), min(begin + block + length, n)
        names = Names(batch.data[max(low - reach, 0) : min(high + length + reach, n)])
        shift = max(low - reach, 0)
        seeds = names.all_of(SEED)[low - shift : high + length - SEED - shift]
        starts = np.arange(low, min(high, low + max(len(seeds) - reach, 0)))
        if not len(starts):
            continue
        at = _window_least(seeds, reach + 1)[: len(starts)] + low
        doc = batch.doc_of(starts)
        whole = starts + length <= batch.edges[doc + 1]
        at, starts, doc = at[whole], starts[whole], doc[whole]
        if not len(starts):
            continue
        cut = np.flatnonzero(np.r_[True, (at[1:] != at[:-1]) | (doc[1:] != doc[:-1])])
        at, first, last, doc = at[cut], starts[cut], starts[np.r_[cut[1:], len(starts)] - 1], doc[cut]
        own = (first >= begin) & (first < begin + block)
        at, first, last, doc = at[own], first[own], last[own], doc[own]
        # surroundings: the bytes that the strings may cover at most, as seen from the sample, clipped at the text's ends;
        # two samples with equal ones choose the same strings
        left, right = np.maximum(at - reach, batch.edges[doc]), np.minimum(at + length, batch.edges[doc + 1])
        around = _mix(names.of(left - shift, right - shift) + (at - left).astype(np.uint64) * _FAR)
        found.append((seeds[at - low], around, at, first, last, doc))
    return tuple(map(np.concatenate, zip(*found))) if found else (np.zeros(0, np.uint64), np.zeros(0, np.uint64), *[np.zeros(0, np.int64)] * 4)


def parts(batch: Batch, length: int, width: int, at: np.ndarray, first: np.ndarray, last: np.ndarray, doc: np.ndarray, block: int = BLOCK) -> tuple[np.ndarray, ...]:
    """Samples cut in parts of at most `width` strings, by the strings' places before the sample; so all strings of a part share
    `length + 1 - width` bytes at a fixed place.

    The arguments are sorted by `at`. Name of what a part's strings share, of all that they cover, at, first, last, document.
    """
    found = []
    for begin, end in _stretches(at, first, last, length, block):
        a, f0, t0, d = at[begin:end], first[begin:end], last[begin:end], doc[begin:end]
        low, high = max(int(f0.min()) - length, 0), min(int(t0.max()) + 2 * length, len(batch.data))
        names = Names(batch.data[low:high])
        near, far = (a - t0) // width, (a - f0) // width
        count = far - near + 1
        row = np.repeat(np.arange(len(a)), count)
        k = near[row] + np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
        b = a[row]
        f, t = np.maximum(f0[row], b - (k + 1) * width + 1), np.minimum(t0[row], b - k * width)
        shared = names.of(b - k * width - low, b - (k + 1) * width + 1 + length - low) + k.astype(np.uint64) * _ODD
        place = ((b - f) * length + (b - t)).astype(np.uint64) * _FAR
        found.append((shared, _mix(names.of(f - low, t + length - low) + place), b, f, t, d[row]))
    return tuple(map(np.concatenate, zip(*found))) if found else (np.zeros(0, np.uint64), np.zeros(0, np.uint64), *[np.zeros(0, np.int64)] * 4)


def _stretches(at: np.ndarray, first: np.ndarray, last: np.ndarray, length: int, block: int) -> Iterator[tuple[int, int]]:
    """Ranges of samples that lie close together: text between them is not named, and no stretch is longer than a block."""
    if not len(at):
        return
    gap = np.flatnonzero((np.diff(at) > 8 * length) | (np.diff(at // block) != 0)) + 1
    yield from zip(np.r_[0, gap].tolist(), np.r_[gap, len(at)].tolist())


#: key deals the rows; kind: 0 a row, 1 the repeat of an earlier row of its batch, 2 a row of a hot name, 3 a hot name's envoy
ROW = "key long, kind byte, around long, doc_id long, h int, place long"
_KINDS = [pa.int64(), pa.int8(), pa.int64(), pa.int64(), pa.int32(), pa.int64()]


def _place(first: np.ndarray, last: np.ndarray, at: np.ndarray, length: int) -> np.ndarray:
    """first, last and sample in one number; the sample lies at or behind the first string's start."""
    return (first * length + (last - first)) * length + (at - first)


def _columns(length: int) -> list[Column]:
    first, rest, at = f"place DIV {length * length}", f"place DIV {length} % {length}", f"place % {length}"
    return [F.expr(first).alias("first"), F.expr(f"{first} + {rest}").alias("last"), F.expr(f"{first} + {at}").alias("at")]


def emit(batch: Batch, name: np.ndarray, around: np.ndarray, at: np.ndarray, first: np.ndarray, last: np.ndarray, doc: np.ndarray, length: int) -> pa.RecordBatch:
    """The rows of one batch: repeats of an earlier row are marked and get a key of chance, rows of hot names are dealt by their surroundings too."""
    kind, key = np.zeros(len(name), np.int8), name.copy()
    order = np.argsort(name, kind="stable")
    same = name[order][1:] == name[order][:-1]
    several = order[np.r_[False, same] | np.r_[same, False]] if len(order) else order
    base = batch.edges[doc]
    envoys = np.zeros(0, np.int64)
    if len(several):
        several = several[np.lexsort((first[several] - base[several], batch.rank[doc[several]], around[several], name[several]))]
        new_name = np.r_[True, name[several][1:] != name[several][:-1]]
        fresh = new_name | np.r_[True, around[several][1:] != around[several][:-1]]
        head = several[np.maximum.accumulate(np.where(fresh, np.arange(len(several)), 0))]
        again = (batch.rank[doc[head]] != batch.rank[doc[several]]) | (first[head] - base[head] != first[several] - base[several])
        kind[several[again]] = 1
        group = np.cumsum(new_name) - 1
        hot = np.bincount(group, fresh)[group] >= HOT
        kind[several[hot & ~again]] = 2
        envoys = several[hot & new_name]
        spread = around * _FAR + ((batch.ids[doc] + first).astype(np.uint64) * _ODD) * (kind == 1)
        key[kind > 0] = _mix(name + spread)[kind > 0]
    rows = np.r_[np.arange(len(name)), envoys]
    kind = np.r_[kind, np.full(len(envoys), 3, np.int8)]
    key = np.r_[key, name[envoys]]
    d = doc[rows]
    place = _place(first - base, last - base, at - base, length)[rows]
    columns = [key.view(np.int64), kind, around.view(np.int64)[rows], (batch.ids[d], ~batch.known[d]), batch.h[d], place]
    arrays = [pa.array(c[0], k, mask=c[1]) if isinstance(c, tuple) else pa.array(c, k) for c, k in zip(columns, _KINDS)]
    return pa.RecordBatch.from_arrays(arrays, names=[c.split()[0] for c in ROW.split(", ")])


def _data(text: Column) -> Column:
    return F.coalesce(text.cast("binary"), F.lit("").cast("binary"))


def keyed(docs: DataFrame) -> DataFrame:
    """doc_id, text (bytes), h (a hash of the text that tells rows of one doc_id apart)."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), _data(F.col("text")).alias("text")).withColumn("h", F.hash("text"))


def sample_rows(docs: DataFrame, length: int, block: int = BLOCK) -> DataFrame:
    """Round 1: the samples of all texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for got in batches:
            batch = Batch.read(got)
            yield emit(batch, *samples(batch, length, block), length)

    return docs.select("doc_id", "h", "text").mapInArrow(tidy(run), ROW)


def rank(rows: DataFrame, length: int) -> DataFrame:
    """Sorts rows by rank and surroundings: doc_id, h, repeat, first, last, at of those that repeat an earlier row, and of first ones to be told apart further."""
    order = [F.col("doc_id").asc_nulls_first(), F.col("h"), F.col("place")]
    dealt = rows.repartition("key").sortWithinPartitions("key", F.col("kind") == 3, "around", *order)
    group = Window.partitionBy("key")
    mixed = (F.max("kind").over(group) >= 2) | (F.min("around").over(group) != F.max("around").over(group))
    placed = F.rank().over(Window.partitionBy("key", F.col("kind") == 3, "around").orderBy(*order))
    ranked = dealt.withColumn("mixed", mixed).withColumn("nth", placed).where("kind <> 3")
    again = (F.col("kind") == 1) | (F.col("nth") > 1)
    return ranked.where(again | F.col("mixed")).select("doc_id", "h", again.alias("repeat"), *_columns(length))


def runs_of(batch: pa.RecordBatch, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The structs of the list column `runs` as rows of numbers counted from the batch's first byte, and the document of each."""
    column = batch.column("runs")
    sizes = np.diff(column.offsets.to_numpy())
    flat_rows = column.flatten()
    doc = np.repeat(np.arange(len(column)), sizes)
    rows = [flat_rows.field(i).to_numpy(zero_copy_only=False).astype(np.int64) + edges[doc] for i in range(flat_rows.type.num_fields)]
    return np.c_[tuple(rows)] if rows else np.zeros((0, 2), np.int64), doc


def part_rows(docs: DataFrame, cut: DataFrame, length: int, width: int, block: int = BLOCK) -> DataFrame:
    """Rounds 2 and 3: the parts of the samples in `cut` (doc_id, h, runs: array of first, last, at)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for got in batches:
            batch = Batch.read(got)
            rows, doc = runs_of(got, batch.edges)
            order = np.lexsort((rows[:, 0], rows[:, 2]))
            rows, doc = rows[order], doc[order]
            yield emit(batch, *parts(batch, length, width, rows[:, 2], rows[:, 0], rows[:, 1], doc, block), length)

    return _met(docs, cut).select("doc_id", "h", "text", "runs").mapInArrow(tidy(run), ROW)


STRING = "string binary, again boolean, doc_id long, h int, first long"


def string_rows(docs: DataFrame, cut: DataFrame, length: int) -> DataFrame:
    """Round 4: the single strings of the runs in `cut` with their bytes; those equal to an earlier one of the batch are marked and carry none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for got in batches:
            batch = Batch.read(got)
            rows, doc = runs_of(got, batch.edges)
            size = rows[:, 1] - rows[:, 0] + 1
            start = np.repeat(rows[:, 0], size) + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
            doc = np.repeat(doc, size)
            string = np.lib.stride_tricks.sliding_window_view(batch.data, length)[start] if len(start) else np.zeros((0, length), np.uint8)
            string = np.ascontiguousarray(string).view(np.dtype((np.void, length))).ravel()
            begin = start - batch.edges[doc]
            order = np.lexsort((begin, batch.rank[doc]))
            _, lead, which = np.unique(string[order], return_index=True, return_inverse=True)
            head = order[lead][which]  # the first of the equal ones, in document order
            again = np.empty(len(start), bool)
            again[order] = (batch.rank[doc[head]] != batch.rank[doc[order]]) | (begin[head] != begin[order])
            kept = string[~again]
            ends = np.cumsum(np.where(again, 0, length))
            held = pa.Array.from_buffers(pa.binary(), len(start), [None, pa.py_buffer(np.r_[0, ends].astype(np.int32)), pa.py_buffer(kept.tobytes())])
            arrays = [held, pa.array(again), pa.array(batch.ids[doc], pa.int64(), mask=~batch.known[doc]), pa.array(batch.h[doc], pa.int32()), pa.array(begin, pa.int64())]
            yield pa.RecordBatch.from_arrays(arrays, names=[c.split()[0] for c in STRING.split(", ")])

    return _met(docs, cut).select("doc_id", "h", "text", "runs").mapInArrow(tidy(run), STRING)


def _met(docs: DataFrame, runs: DataFrame) -> DataFrame:
    named = runs.select(F.col("doc_id").alias("d"), F.col("h").alias("g"), "runs")
    return docs.join(named, docs["doc_id"].eqNullSafe(named["d"]) & (docs["h"] == named["g"])).drop("d", "g")


def _grouped(df: DataFrame, *columns: str) -> DataFrame:
    return df.groupBy("doc_id", "h").agg(F.collect_set(F.struct(*(F.col(c).cast("int").alias(c) for c in columns))).alias("runs"))


def repeated_strings(docs: DataFrame, length: int = 100, block: int = BLOCK) -> DataFrame:
    """doc_id, h, runs (array of first, last): starts of all strings that also start earlier. docs: doc_id, h, text (bytes)."""
    if length < SEED + 2:
        raise ValueError("strings this short are not sampled")
    left = stored(rank(sample_rows(docs, length, block), length), "samples")
    repeats = [left]
    for width in ((length - SEED) // 2 + 1, 8):
        left = stored(rank(part_rows(docs, _grouped(left.where("NOT repeat"), "first", "last", "at"), length, width, block), length), "parts")
        repeats.append(left)
    strings = string_rows(docs, _grouped(left.where("NOT repeat"), "first", "last"), length)
    # marked ones carry no bytes and are dealt by their document
    place = F.rank().over(Window.partitionBy("string", F.when(F.col("again"), F.hash("doc_id", "first"))).orderBy(F.col("doc_id").asc_nulls_first(), "h", "first"))
    third = strings.withColumn("nth", place).where("again OR nth > 1").select("doc_id", "h", "first", F.col("first").alias("last"))
    found = reduce(DataFrame.unionByName, [*(r.where("repeat").select("doc_id", "h", "first", "last") for r in repeats), third])
    return stored(_grouped(found, "first", "last"), "repeats")


def removed(edges: np.ndarray, rows: np.ndarray, doc: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the maximal removed runs of bytes, and their documents. rows: first, last from the batch's first byte."""
    if not len(rows):
        return (np.zeros(0, np.int64),) * 3
    order = np.lexsort((rows[:, 1], rows[:, 0]))
    start, end, doc = rows[order, 0], np.maximum.accumulate(rows[order, 1] + length), doc[order]
    fresh = np.r_[True, (start[1:] > end[:-1]) | (doc[1:] != doc[:-1])]
    return start[fresh], end[np.r_[np.flatnonzero(fresh)[1:] - 1, len(start) - 1]], doc[fresh]


def _without(data: bytes, gone: list[tuple[int, int]]) -> bytes:
    at, parts = 0, []
    for a, b in gone:
        parts.append(data[at:a])
        at = b
    return b"".join([*parts, data[at:]])


def _at_characters(data: bytes, gone: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The runs without characters that they cover in part only."""
    out = []
    for a, b in gone:
        while a < b and data[a] & 0xC0 == 0x80:
            a += 1
        while b < len(data) and a < b and data[b] & 0xC0 == 0x80:
            b -= 1
        if a < b:
            out.append((a, b))
    return out


def _cut(length: int, kind: pa.DataType, make: Callable) -> Callable:
    """make(data, gone) for each text; `gone` are the removed runs of bytes."""

    def run(text: pa.Array, runs: pa.Array) -> pa.Array:
        _, edges = flat(text)
        rows, doc = runs_of(pa.RecordBatch.from_arrays([runs], names=["runs"]), edges)
        start, end, doc = removed(edges, rows, doc, length)
        bounds = np.searchsorted(doc, np.arange(len(text) + 1))
        out = []
        for i in range(len(text)):
            gone = [(int(a), int(b)) for a, b in zip(start[bounds[i] : bounds[i + 1]] - edges[i], end[bounds[i] : bounds[i + 1]] - edges[i])]
            out.append(make(text[i].as_py(), gone))
        return pa.array(out, kind)

    return run


def with_repeats(docs: DataFrame, length: int = 100, block: int = BLOCK) -> DataFrame:
    """row (all columns of `docs`), data (the text's bytes), runs (starts of its strings that also start earlier, empty if there are none)."""
    each = keyed(docs)
    runs = repeated_strings(each, length, block).select(F.col("doc_id").alias("d"), F.col("h").alias("g"), "runs")
    packed = docs.select(F.struct(*(docs[c] for c in docs.columns)).alias("row"))
    packed = packed.select("row", F.col("row.doc_id").cast("long").alias("id"), _data(F.col("row.text")).alias("data")).withColumn("h", F.hash("data"))
    met = packed.join(runs, packed["id"].eqNullSafe(runs["d"]) & (packed["h"] == runs["g"]), "left")
    none = F.array().cast("array<struct<first:int,last:int>>")
    return met.select("row", "id", "data", F.coalesce("runs", none).alias("runs"))


DIGEST = pa.struct([("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string())])


def report(docs: DataFrame, length: int = 100, block: int = BLOCK) -> DataFrame:
    """What goes of each document: doc_id, n_bytes, n_removed, n_spans, kept_sha256."""

    def digest(data: bytes, gone: list[tuple[int, int]]) -> dict:
        kept = _without(data, gone)
        return {"n_removed": len(data) - len(kept), "n_spans": len(gone), "kept_sha256": hashlib.sha256(kept).hexdigest()}

    measure = F.arrow_udf(_cut(length, DIGEST, digest), "n_removed long, n_spans long, kept_sha256 string")
    cut = with_repeats(docs.select("doc_id", "text"), length, block).withColumn("d", measure("data", "runs"))
    return cut.select(F.col("id").alias("doc_id"), F.octet_length("data").cast("long").alias("n_bytes"), "d.n_removed", "d.n_spans", "d.kept_sha256")


def drop_repeats(docs: DataFrame, length: int = 100, block: int = BLOCK) -> DataFrame:
    """The documents with repeated strings taken out of `text` (whole characters only) and n_chars counted anew, other columns as they are.

    Documents of which nothing is left stay, with an empty text; a null text stays null.
    """

    def rest(data: bytes, gone: list[tuple[int, int]]) -> str:
        return _without(data, _at_characters(data, gone)).decode("utf-8", "replace")

    # not to be repeated: what filters the new texts would cut them a second time, in a second worker beside the first
    left = F.arrow_udf(_cut(length, pa.string(), rest), "string").asNondeterministic()
    cut = with_repeats(docs, length, block).select("row", F.when(F.col("row.text").isNotNull(), left("data", "runs")).alias("left"))
    new = {"text": F.col("left")}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.coalesce(F.length("left").cast(docs.schema["n_chars"].dataType), F.col("row.n_chars"))
    return cut.select(*(new.get(c, F.col("row").getField(c)).alias(c) for c in docs.columns))
