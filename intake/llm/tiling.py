"""Benchmark decontamination by greedy string tiling.

Texts and benchmark items are sequences of words (A-Z lower-cased, ASCII marks as spaces). Seeds are runs of `seed` words that stand in
both, found by a Karp-Rabin hash that runs over the words. Seeds that continue each other on one diagonal join to matches; the longest
match that is still free is marked as a tile, again and again, and what a tile leaves of other matches stays in the race while it has
`seed` words. Tiles do not overlap in text or item, in any order, so a passage is found whatever the order of its parts. A document is
contaminated by an item whose words are covered to `coverage` or more. Hashes only fetch pairs and places: tiles are made of equal words.

Both sides are tables. The seeds of the benchmark are a stored table, and a bitmap of their hashes (`filter_bits` bits at most, whatever the
benchmark's size) lets each text hand on only seeds that may be in it; Spark joins these with the table, counts the hits of each pair of
document and item, and pairs with enough of them meet with both texts and are tiled. Documents are read once for their seeds and once
more for their tiles, however large the benchmark is.

An item covered enough shares at least k = coverage * words / seed of its places with the document, so the (k - 1) / 2 seeds of it that
most other items hold too need not fetch anything, and the rest must hit k - (k - 1) / 2 times: that keeps common phrases from pairing
everything with everything and loses no pair. Seeds that very many documents hold are dealt over several tasks.

Edge cases: null or empty texts, and items of fewer than `seed` words, match nothing; ties between equally long matches go to the first in the
item, then in the text; very long texts are read whole; repeated rows are judged once each; a null item_id or doc_id is carried; empty
tables give empty results; other columns, whatever their names, are ignored by `contaminations` and kept by `decontaminate`.
"""

from __future__ import annotations

import heapq
import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import spread_join, stored, text_bytes, tidy

_PLAIN = bytes(c if c >= 128 or chr(c).isalnum() else 32 for c in range(256)).lower()
_BASE = np.uint64(0x9E3779B97F4A7C15)
_SPREAD = np.uint64(0xD6E8FEB86659FD93)


def words_of(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(_PLAIN).split()


def running_hash(words: np.ndarray, width: int) -> np.ndarray:
    """Karp-Rabin hash modulo 2**64 of each run of `width` words, its bits mixed."""
    n = max(0, len(words) - width + 1)
    h = np.zeros(n, np.uint64)
    for k in range(width):
        h = h * _BASE + words[k : k + n]
    h = (h ^ h >> np.uint64(32)) * _SPREAD
    return h ^ h >> np.uint64(29)


def seeds_of(text: bytes | None, seed: int) -> tuple[np.ndarray, int]:
    """The hash of each run of `seed` words, and the number of words."""
    words = words_of(text)
    return running_hash(np.fromiter(map(zlib.crc32, words), np.uint64, len(words)) + np.uint64(1), seed), len(words)


def greedy_tiles(pairs: np.ndarray, seed: int, n_item: int, n_text: int) -> list[tuple[int, int, int]]:
    """pairs: rows (item position, text position) of equal seeds. Tiles (item position, text position, words), longest first."""
    i, j = pairs[:, 0], pairs[:, 1]
    order = np.lexsort((i, j - i))
    i, j = i[order], j[order]
    begin = np.flatnonzero(np.r_[True, (np.diff(j - i) != 0) | (np.diff(i) != 1)])
    size = np.diff(np.r_[begin, len(i)]) + seed - 1
    heap = [(-int(n), int(a), int(b)) for n, a, b in zip(size, i[begin], j[begin])]
    heapq.heapify(heap)
    item, text, tiles = np.zeros(n_item, bool), np.zeros(n_text, bool), []
    while heap:
        n, a, b = heapq.heappop(heap)
        taken = item[a : a - n] | text[b : b - n]
        if not taken.any():
            item[a : a - n] = text[b : b - n] = True
            tiles.append((a, b, -n))
            continue
        edge = np.flatnonzero(np.diff(np.r_[True, taken, True].astype(np.int8)))
        for lo, hi in edge.reshape(-1, 2).tolist():
            if hi - lo >= seed:
                heapq.heappush(heap, (lo - hi, a + lo, b + lo))
    return tiles


def tile(text: bytes, items: list[tuple[int, bytes]], seed: int, coverage: float) -> Iterator[tuple]:
    """number, coverage, tiles, longest tile for each item (number, text) that is covered enough. Words are compared as such."""
    numbers: dict[bytes, int] = {}
    owned = [(k, np.array([numbers.setdefault(w, len(numbers)) for w in words_of(body)], np.int64)) for k, body in items]
    known = numbers.get
    words = np.array([known(w, -1) for w in words_of(text)], np.int64)
    plain = (words[seed - 1 :] >= 0) if len(words) >= seed else np.zeros(0, bool)
    for k in range(seed - 1):
        plain = plain & (words[k : k + len(plain)] >= 0)
    at = np.flatnonzero(plain)  # runs of words that some item holds
    h = running_hash((words + 2).astype(np.uint64), seed)[at]
    order = np.argsort(h, kind="stable")
    at, h = at[order], h[order]
    for k, item in owned:
        n = len(item)
        own = running_hash((item + 2).astype(np.uint64), seed)
        lo = np.searchsorted(h, own, "left")
        count = np.searchsorted(h, own, "right") - lo
        if (np.convolve(count > 0, np.ones(seed))[:n] > 0).sum() < coverage * n:
            continue  # not even all seeds together cover enough
        i = np.repeat(np.arange(len(own)), count)
        j = at[np.repeat(lo, count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)]
        steps = np.arange(seed)
        same = (item[i[:, None] + steps] == words[j[:, None] + steps]).all(axis=1)
        tiles = greedy_tiles(np.c_[i[same], j[same]], seed, n, len(words)) if same.any() else []
        covered = sum(t[2] for t in tiles) / n
        if tiles and covered >= coverage:
            yield k, covered, len(tiles), max(t[2] for t in tiles)


def benchmark_seeds(items: DataFrame, seed: int, coverage: float) -> DataFrame:
    """number, seed, need: the seeds of each item that fetch, and how many hits a pair needs. items: number, text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [(k, *seeds_of(t, seed)) for k, t in zip(batch.column("number").to_pylist(), batch.column("text").to_pylist())]
            sizes = [len(h) for _, h, _ in found]
            hits = [max(1, math.ceil(coverage * n / seed - 1e-9)) for _, _, n in found]
            column = lambda x: pa.array(np.repeat(np.array(x, np.int64), sizes))
            seeds = np.concatenate([h for _, h, _ in found]).view(np.int64) if found else np.zeros(0, np.int64)
            place = np.concatenate([np.arange(s) for s in sizes]) if found else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([column([k for k, _, _ in found]), pa.array(seeds), pa.array(place), column(hits)], names=["number", "seed", "place", "hits"])

    rows = stored(items.mapInArrow(tidy(run), "number long, seed long, place long, hits long"), "benchmark-seeds")
    held = rows.groupBy("seed").agg(F.count(F.lit(1)).alias("n"))
    common = F.row_number().over(Window.partitionBy("number").orderBy(F.desc("n"), "place"))
    left_out = F.floor((F.col("hits") - 1) / 2)
    ranked = rows.join(held, "seed").withColumn("common", common).where(F.col("common") > left_out)
    return stored(ranked.select("number", "seed", (F.col("hits") - left_out).alias("need")), "fetching-seeds")


def seed_bitmap(seeds: DataFrame, filter_bits: int) -> tuple[np.ndarray, int]:
    """A bitmap with about 16 bits a seed, at most 2**filter_bits in all, and how many leading bits of a hash it takes."""
    bits = min(max(10, (16 * seeds.count()).bit_length()), filter_bits)
    at = F.shiftrightunsigned("seed", 64 - bits)
    mask = F.expr(f"shiftleft(1L, CAST(shiftrightunsigned(seed, {64 - bits}) & 63 AS INT))")
    rows = seeds.groupBy(F.shiftright(at, 6).cast("int").alias("word")).agg(F.bit_or(mask).alias("mask")).toArrow()  # 2**(filter_bits - 6) rows at most
    words = np.zeros(1 << max(bits - 6, 0), np.uint64)
    words[rows.column("word").to_numpy()] = rows.column("mask").to_numpy().view(np.uint64)
    return words, bits


def document_seeds(docs: DataFrame, bitmap: np.ndarray, bits: int, seed: int) -> DataFrame:
    """doc_id, h, seed: the distinct seeds of each document that the bitmap knows. docs: doc_id, h, text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, sizes = [], []
            for text in batch.column("text"):
                h, _ = seeds_of(text.as_py(), seed)
                at = h >> np.uint64(64 - bits)
                known = bitmap[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63)) & np.uint64(1)
                rows.append(np.unique(h[known.astype(bool)]))
                sizes.append(len(rows[-1]))
            which = pa.array(np.repeat(np.arange(len(sizes)), sizes))
            seeds = pa.array(np.concatenate(rows).view(np.int64) if rows else np.zeros(0, np.int64))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(which), batch.column("h").take(which), seeds], names=["doc_id", "h", "seed"])

    return docs.mapInArrow(tidy(run), "doc_id long, h long, seed long")


FOUND = "doc_id long, h long, number long, coverage double, n_tiles long, longest_tile long"


def tiled_pairs(docs: DataFrame, items: DataFrame, seed: int, coverage: float, filter_bits: int) -> DataFrame:
    """FOUND, one row for each contaminated pair of a row of `docs` (doc_id, h, text) and a row of `items` (number, text)."""
    fetching = benchmark_seeds(items, seed, coverage)
    hits = stored(document_seeds(docs, *seed_bitmap(fetching, filter_bits), seed).distinct(), "document-seeds")
    met = spread_join(hits, fetching, "seed").groupBy("doc_id", "h", "number").agg(F.count(F.lit(1)).alias("n"), F.first("need").alias("need"))
    pairs = stored(met.where("n >= need").select(F.col("doc_id").alias("d"), F.col("h").alias("g"), "number"), "met")
    # an item that very many documents quote is dealt over tasks; a document meets its items in up to 16 rows, so that no row holds all of them
    dealt = spread_join(pairs, items.withColumnRenamed("text", "item"), "number").groupBy("d", "g", F.pmod("number", F.lit(16)).alias("part")).agg(F.collect_list(F.struct("number", "item")).alias("items"))
    both = docs.join(stored(dealt, "pairs"), docs["doc_id"].eqNullSafe(F.col("d")) & (docs["h"] == F.col("g")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc_id, h, text, own in zip(*(batch.column(c) for c in ("doc_id", "h", "text", "items"))):
                asked = [(x["number"], x["item"]) for x in own.as_py()]
                rows += [(doc_id.as_py(), h.as_py(), *m) for m in tile(text.as_py(), asked, seed, coverage)]
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64()]
            columns = list(zip(*rows)) if rows else [()] * len(kinds)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=[c.split()[0] for c in FOUND.split(", ")])

    return both.select("doc_id", "h", "text", "items").mapInArrow(tidy(run), FOUND)


def _sides(docs: DataFrame, benchmark: DataFrame) -> tuple[DataFrame, DataFrame]:
    items = benchmark.where("text IS NOT NULL").select("item_id", F.col("text").cast("binary").alias("text"), F.monotonically_increasing_id().alias("number"))
    return text_bytes(docs).where("text IS NOT NULL").withColumn("h", F.xxhash64("text")), stored(items, "benchmark")


def contaminations(docs: DataFrame, benchmark: DataFrame, seed: int = 5, coverage: float = 0.6, filter_bits: int = 27) -> DataFrame:
    """doc_id, item_id, coverage (share of the item's words), n_tiles, longest_tile of each contaminated pair."""
    texts, items = _sides(docs, benchmark)
    found = stored(tiled_pairs(texts, items.select("number", "text"), seed, coverage, filter_bits), "tiled")
    return spread_join(found, items.select("number", "item_id"), "number").select("doc_id", "item_id", "coverage", "n_tiles", "longest_tile")


def decontaminate(docs: DataFrame, benchmark: DataFrame, seed: int = 5, coverage: float = 0.6, filter_bits: int = 27) -> DataFrame:
    """The documents that no item contaminates, with all their columns."""
    texts, items = _sides(docs, benchmark)
    gone = stored(tiled_pairs(texts, items.select("number", "text"), seed, coverage, filter_bits).select("doc_id", "h").distinct(), "contaminated")
    packed = docs.select(F.struct(*(docs[c] for c in docs.columns)).alias("row"))
    packed = packed.select("row", F.col("row.doc_id").cast("long").alias("id"), F.xxhash64(F.col("row.text").cast("binary")).alias("g"))
    kept = packed.join(gone, packed["id"].eqNullSafe(gone["doc_id"]) & (packed["g"] == gone["h"]), "left_anti")
    return kept.select(*(F.col("row").getField(c).alias(c) for c in docs.columns))
