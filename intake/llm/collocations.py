"""Phrase collocations by Apriori levels: candidates in broadcast double-array tries, counted by walking all text positions at once.

1. Spark counts the words of each language. Words with `least` occurrences get a number, others break a text (no frequent phrase holds them).
2. Texts become runs of numbers, -1 between pieces, packed in blocks without doc_id: all that later passes read.
3. For each length: positions where two frequent phrases of one word less overlap are Apriori-safe. A 64-bit hash of the longer phrase is
   counted in the tasks and summed by Spark; hashes below `least` go, which loses nothing, as a collision can only add.
   What the others stand for is fetched from one block each, built into a double-array trie and broadcast; numpy advances the states of
   all positions of a block, level by level, counts accepting states, and the tasks' counts, in ranges of states, are added up. They
   decide. A hash whose phrases do not add up to its sum hides another phrase, and is fetched again from all blocks.
4. Cuts, scores and containment are joins over the frequent phrases.

Dictionaries and tries hold at most `shard` words or phrases. Where there are more, each further shard is one more pass over the blocks, so
what is broadcast or collected at once never grows with the data; the number of passes does, with the number of frequent phrases.
Counts are of all texts, whole; nothing is sampled.

Edge cases: a null text is empty, a null lang is `und`; pieces without words count nothing; rows that repeat count again, whatever their
doc_id, and other columns are ignored; a language without candidates has no row; an empty table gives an empty result. Scores are
compared after flooring, and ties go to the smaller cut, then phrases are ordered by a, then by their UTF-8 bytes.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from functools import reduce
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import shuffles_removed, stored
from .trie import Trie, build, match

UNKNOWN = "und"
#: A-Z lower-cased; what separates pieces becomes a line feed. After that only spaces and tabs are left for bytes.split().
_TABLE = bytes(10 if c in b".,;:!?\x0a\x0b\x0c\x0d" else c + 32 if 65 <= c <= 90 else c for c in range(256))
_BLOCK = 1 << 18  # numbers in a block
_HELD = 1 << 21  # counts that a task holds before it hands them on
_RANGE = 4096  # counts that tasks hand on in one row
_MIX = np.uint64(0x9E3779B97F4A7C15)


def pieces(text: bytes | None) -> Iterator[list[bytes]]:
    return map(bytes.split, (text or b"").translate(_TABLE).split(b"\n"))


def count_words(docs: DataFrame) -> DataFrame:
    """lang, word (bytes), n of every word; docs: lang, text (bytes)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[str, Counter] = {}

        def out() -> pa.RecordBatch:
            langs = [lang for lang, words in found.items() for _ in words]
            return pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array([w for c in found.values() for w in c], pa.binary()), pa.array([n for c in found.values() for n in c.values()], pa.int64())], names=["lang", "word", "n"])

        for batch in batches:
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text")):
                words = found.setdefault(lang, Counter())
                for piece in pieces(text.as_py()):
                    words.update(piece)
            if sum(map(len, found.values())) > _HELD // 4:
                yield out()
                found.clear()
        yield out()

    return docs.mapInArrow(run, "lang string, word binary, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))


def number_words(frequent: DataFrame) -> DataFrame:
    """code: a number from 0 on for each row, roughly by falling n. Rows are numbered in groups of like counts, cut by a hash."""
    group = (F.lit(64) - F.floor(F.log2("n"))) * 64 + F.pmod(F.xxhash64("lang", "word"), F.lit(64))
    rows = stored(frequent.withColumn("_g", group.cast("int")), "words")
    sizes = sorted((r["_g"], r["count"]) for r in rows.groupBy("_g").count().collect())  # at most 64 * 64
    starts = rows.sparkSession.createDataFrame([(g, sum(n for _, n in sizes[:i])) for i, (g, _) in enumerate(sizes)], "_g int, _start long")
    place = F.row_number().over(Window.partitionBy("_g").orderBy("lang", "word"))
    return rows.withColumn("_p", place).join(F.broadcast(starts), "_g").select("lang", "word", "n", (F.col("_start") + F.col("_p") - 1).cast("int").alias("code"))


def _packed(x: np.ndarray) -> np.ndarray:
    """Without words that stand alone between -1, and one -1 only between the others."""
    for _ in range(2):
        before, after = np.r_[-1, x[:-1]], np.r_[x[1:], -1]
        x = np.where((before < 0) & (after < 0), -1, x)
        x = x[(x >= 0) | (np.r_[-1, x[:-1]] >= 0)]
    return x


def _arrays(batch: pa.RecordBatch, name: str, kind: type) -> Iterator[np.ndarray | None]:
    for value in batch.column(name):
        held = value.as_buffer()
        yield None if held is None else np.frombuffer(held, kind)


def encode(docs: DataFrame, words: DataFrame, n_words: int, shard: int) -> DataFrame:
    """block, codes: little-endian 32-bit numbers of the texts' words, -1 for others and between pieces, and a number for each block of them."""
    rows, shards = docs.withColumn("ids", F.lit(None).cast("binary")), max(1, -(-n_words // shard))
    for s in range(shards):
        held = words.where(F.col("code").between(s * shard, (s + 1) * shard - 1)).select("lang", "word", "code").toArrow()
        codes: dict[str, dict[bytes, int]] = {}
        for lang, word, code in zip(*(held.column(c).to_pylist() for c in ("lang", "word", "code"))):
            codes.setdefault(lang, {})[word] = code
        sent = docs.sparkSession.sparkContext.broadcast(codes)  # `shard` words

        def run(batches: Iterator[pa.RecordBatch], sent=sent, last: bool = s == shards - 1) -> Iterator[pa.RecordBatch]:
            block: list[np.ndarray] = []
            number = count(TaskContext.get().partitionId() << 32)
            as_blocks = lambda: pa.RecordBatch.from_arrays([pa.array([next(number)]), pa.array([_packed(np.concatenate(block)).astype("<i4").tobytes()], pa.binary())], names=["block", "codes"])
            for batch in batches:
                found = []
                for lang, text, known in zip(batch.column("lang").to_pylist(), batch.column("text"), _arrays(batch, "ids", np.dtype("<i4"))):
                    get, ids = sent.value.get(lang, {}).get, []
                    for piece in pieces(text.as_py()):
                        ids += [get(w, -1) for w in piece]
                        ids.append(-1)
                    x = np.array(ids, np.int32)
                    found.append(x if known is None else np.where(known >= 0, known, x))
                    if last:
                        block.append(found.pop())
                        if sum(map(len, block)) >= _BLOCK:
                            yield as_blocks()
                            block.clear()
                if not last:
                    yield pa.RecordBatch.from_arrays([batch.column("lang"), batch.column("text"), pa.array([x.astype("<i4").tobytes() for x in found], pa.binary())], names=["lang", "text", "ids"])
            if block:
                yield as_blocks()

        rows = stored(rows.mapInArrow(run, "block long, codes binary" if s == shards - 1 else "lang string, text binary, ids binary"), "codes")
        sent.destroy()
    return rows.withColumn("alive", F.lit(None).cast("binary"))


def hashes(x: np.ndarray, at: np.ndarray, length: int, bits: int = 64) -> np.ndarray:
    h = np.full(len(at), length, np.uint64)
    for j in range(length):
        h = (h ^ x[at + j].astype(np.uint64)) * _MIX
        h ^= h >> np.uint64(29)
    return (h >> np.uint64(64 - bits)).view(np.int64)


def _starts(x: np.ndarray, length: int) -> np.ndarray:
    """Positions of `length` frequent words in a row."""
    if len(x) < length:
        return np.zeros(0, np.int64)
    ok = x >= 0
    return np.flatnonzero(reduce(np.logical_and, (ok[j : len(x) - length + 1 + j] for j in range(length))))


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, np.ndarray, np.ndarray | None]]:
    for batch in batches:
        yield from zip(batch.column("block").to_pylist(), _arrays(batch, "codes", np.dtype("<i4")), _arrays(batch, "alive", np.uint8))


def _marked(x: np.ndarray, known: np.ndarray | None, trie: Trie, length: int) -> np.ndarray:
    out = np.zeros(len(x), np.uint8) if known is None else known.copy()
    out[match(trie, x, length)[0]] = 1
    return out


def mark(rows: DataFrame, sent, length: int) -> DataFrame:
    """`alive` set where a phrase of the trie begins."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, x, known in _blocks(batches):
            columns = [pa.array([b]), pa.array([x.tobytes()], pa.binary()), pa.array([_marked(x, known, sent.value, length).tobytes()], pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["block", "codes", "alive"])

    return rows.mapInArrow(run, "block long, codes binary, alive binary")


def likely(rows: DataFrame, sent, length: int, least: int, bits: int) -> DataFrame:
    """h, n, block: hashes of Apriori-safe phrases of this length that may reach `least`, their sums, and the first block that holds each.
    sent: the trie of the last shard of phrases one word shorter (those of the others are marked in `alive`), None for pairs of words."""

    def merged(held: list) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        h, n, b = (np.concatenate(part) for part in zip(*held))
        order = np.lexsort((b, h))
        h, n, b = h[order], n[order], b[order]
        first = np.flatnonzero(np.r_[True, h[1:] != h[:-1]])[: len(h)]
        return h[first], np.add.reduceat(n, first) if len(h) else n, b[first]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list = []
        out = lambda *columns: pa.RecordBatch.from_arrays(list(map(pa.array, columns)), names=["h", "n", "block"])
        for b, x, known in _blocks(batches):
            at = _starts(x, length)
            if sent is not None:
                alive = _marked(x, known, sent.value, length - 1)
                at = at[(alive[at] & alive[at + 1]) == 1]
            h, n = np.unique(hashes(x, at, length, bits), return_counts=True)
            held.append((h, n, np.full(len(h), b)))
            if sum(len(h) for h, _, _ in held) > _HELD:
                held = [merged(held)]
                if len(held[0][0]) > _HELD // 2:
                    yield out(*held.pop())
        if held:
            yield out(*merged(held))

    summed = rows.mapInArrow(run, "h long, n long, block long").groupBy("h").agg(F.sum("n").alias("n"), F.min("block").alias("block"))
    return summed.where(F.col("n") >= least)


def phrases_of(rows: DataFrame, wanted: np.ndarray, block: np.ndarray | None, length: int, bits: int) -> DataFrame:
    """codes: the different phrases whose hash is among `wanted`, each looked for in its block only, or in all."""
    order = np.argsort(wanted, kind="stable") if block is None else np.lexsort((wanted, block))
    sent = rows.sparkSession.sparkContext.broadcast((wanted[order], None if block is None else block[order]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sorted_, where = sent.value
        for b, x, _ in _blocks(batches):
            own = sorted_ if where is None else sorted_[np.searchsorted(where, b) : np.searchsorted(where, b, "right")]
            if len(own):
                at = _starts(x, length)
                h = hashes(x, at, length, bits)
                at = at[own[np.minimum(np.searchsorted(own, h), len(own) - 1)] == h]
                yield _phrase_rows(np.unique(x[at[:, None] + np.arange(length)], axis=0))

    return rows.mapInArrow(run, "codes array<int>").distinct()


def _phrase_rows(x: np.ndarray, **more: np.ndarray) -> pa.RecordBatch:
    codes = pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, x.shape[1], dtype=np.int32)), pa.array(x.ravel().astype(np.int32)))
    return pa.RecordBatch.from_arrays([codes, *map(pa.array, more.values())], names=["codes", *more])


def _matrix(phrases: DataFrame, length: int) -> np.ndarray:
    """A bounded shard of phrases, a row each."""
    with shuffles_removed(phrases.sparkSession):
        return phrases.select("codes").toArrow().column("codes").combine_chunks().flatten().to_numpy().reshape(-1, length)


def count_phrases(rows: DataFrame, found: np.ndarray, length: int, bits: int) -> DataFrame:
    """codes, h, n: occurrences of each phrase of `found`, by the accepting states of their trie."""
    context = rows.sparkSession.sparkContext
    sent, named = context.broadcast((build(found), len(found))), context.broadcast(found)

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie, size = sent.value
        n = np.zeros(-(-size // _RANGE) * _RANGE, np.int64)
        for _, x, _ in _blocks(batches):
            n += np.bincount(match(trie, x, length)[1], minlength=len(n))
        for part, counts in enumerate(n.reshape(-1, _RANGE)):
            if counts.any():
                yield pa.RecordBatch.from_arrays([pa.array([part]), pa.array([counts.astype("<i8").tobytes()], pa.binary())], names=["part", "counts"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for part, counts in zip(batch.column("part").to_pylist(), _arrays(batch, "counts", np.dtype("<i8"))):
                sums[part] = sums.get(part, 0) + counts
        for part, n in sums.items():
            x = named.value[part * _RANGE : (part + 1) * _RANGE]
            h = hashes(x.ravel(), np.arange(0, x.size, length), length, bits)
            yield _phrase_rows(x, h=h, n=n[: len(x)])

    return rows.mapInArrow(walk, "part long, counts binary").repartition("part").mapInArrow(add, "codes array<int>, h long, n long")


def count_likely(rows: DataFrame, part: DataFrame, length: int, least: int, bits: int) -> DataFrame | None:
    """codes, n of the frequent phrases behind one shard of hashes."""
    held = part.toArrow()
    wanted, block = held.column("h").to_numpy(), held.column("block").to_numpy()
    if not len(wanted):
        return None
    found = _matrix(phrases_of(rows, wanted, block, length, bits), length)
    counted = stored(count_phrases(rows, found, length, bits), "phrases")
    sums = counted.groupBy("h").agg(F.sum("n").alias("_found"))
    hidden = part.join(sums, "h", "left").where(~F.col("n").eqNullSafe(F.col("_found"))).select("h").toArrow().column("h").to_numpy()  # two phrases of one hash
    if len(hidden):
        again = _matrix(phrases_of(rows, hidden, None, length, bits), length)
        known = set(map(bytes, np.ascontiguousarray(found)))
        again = again[[bytes(p) not in known for p in np.ascontiguousarray(again)]]
        if len(again):
            counted = counted.union(stored(count_phrases(rows, again, length, bits), "phrases"))
    return counted.where(F.col("n") >= least).select("codes", "n")


def _shards(table: DataFrame, column: str, rows: int, shard: int) -> Iterator[DataFrame]:
    """The table in parts of about `shard` rows, by a hash."""
    parts = max(1, -(-rows // shard))
    for s in range(parts):
        yield table.where(F.pmod(F.xxhash64(column), F.lit(parts)) == s)


def frequent_phrases(rows: DataFrame, least: int, longest: int, shard: int, bits: int) -> list[DataFrame]:
    """codes, n of all phrases of 2, 3, ... words with at least `least` occurrences; rows: blocks of codes."""
    out: list[DataFrame] = []
    spark, before, n_before = rows.sparkSession, None, 0
    for length in range(2, longest + 1):
        sent, marked = None, rows
        if before is not None:
            for part in _shards(before, "codes", n_before, shard):
                if sent is not None:  # one more shard: what the last one marks is kept
                    marked = stored(mark(marked, sent, length - 1), "marked")
                sent = spark.sparkContext.broadcast(build(_matrix(part, length - 1)))
        hashed = stored(likely(marked, sent, length, least, bits), "likely")
        parts = (count_likely(rows, part, length, least, bits) for part in _shards(hashed, "h", hashed.count(), shard))
        counted = [part for part in parts if part is not None]
        if not counted:
            break
        before = reduce(DataFrame.union, counted)
        n_before = before.count()
        if not n_before:
            break
        out.append(before)
    return out


def _scored(phrases: DataFrame, counts: DataFrame, totals: DataFrame) -> DataFrame:
    """Each phrase with the counts of its lowest cut. phrases: codes, a, lang; counts: codes, n, all frequent words and phrases."""
    cuts = phrases.select("*", F.explode(F.sequence(F.lit(1), F.size("codes") - 1)).alias("k"))
    cuts = cuts.withColumn("_l", F.slice("codes", F.lit(1), F.col("k"))).withColumn("_r", F.slice("codes", F.col("k") + 1, F.size("codes") - F.col("k")))
    side = lambda name: counts.select(F.col("codes").alias(f"_{name}"), F.col("n").alias(name))
    cuts = cuts.join(side("l"), "_l").join(side("r"), "_r").join(totals, "lang")
    wide = lambda c: F.col(c).cast("decimal(19,0)")
    whole = (wide("a") * wide("n")).cast("decimal(38,0)") * F.lit(1000).cast("decimal(4,0)")
    cuts = cuts.withColumn("_top", whole.cast("decimal(38,0)")).withColumn("_under", (wide("l") * wide("r")).cast("decimal(38,0)")).withColumn("score", F.expr("_top div _under"))
    best = cuts.groupBy("codes").agg(F.min(F.struct("score", "k", "l", "r")).alias("b"), F.first("a").alias("a"), F.first("lang").alias("lang"), F.first("n").alias("n"))
    return best.select("codes", "lang", "a", "n", "b.l", "b.r", "b.score")


def _uncovered(phrases: DataFrame, covered: int) -> DataFrame:
    """Without phrases inside a longer one that has at least `covered` percent of their occurrences."""
    spans = F.flatten(F.transform(F.sequence(F.lit(2), F.size("codes") - 1), lambda k: F.transform(F.sequence(F.lit(1), F.size("codes") - k + 1), lambda i: F.slice("codes", i, k))))
    inside = phrases.where(F.size("codes") > 2).select(F.explode(spans).alias("codes"), F.col("n").alias("_longer")).groupBy("codes").agg(F.max("_longer").alias("_longer"))
    met = phrases.join(inside, "codes", "left")
    return met.where(F.coalesce(F.col("_longer") * 100 < F.col("n") * covered, F.lit(True))).drop("_longer")


def collocations(docs: DataFrame, least: int = 100, longest: int = 5, covered: int = 100, top: int = 2000, shard: int = 1 << 18, bits: int = 64) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the best phrases of each language. bits: of the hashes by which candidates are found."""
    spark: SparkSession = docs.sparkSession
    texts = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit(UNKNOWN)).alias("lang"), F.col("text").cast("binary").alias("text"))
    counted = stored(count_words(texts), "counts")
    totals = counted.groupBy("lang").agg(F.sum("n").alias("n"))
    words = stored(number_words(counted.where(F.col("n") >= least)), "numbered")
    found = frequent_phrases(encode(texts, words, words.count(), shard), least, longest, shard, bits)
    if not found:
        return spark.createDataFrame([], "lang string, rank long, phrase string, a long, l long, r long, n long, score long")
    phrases = reduce(DataFrame.union, found)
    counts = phrases.union(words.select(F.array("code").alias("codes"), "n"))
    spelled = _uncovered(phrases, covered).select("codes", F.col("n").alias("a"), F.posexplode("codes").alias("at", "code")).join(words.select("code", "lang", "word"), "code")
    spelled = spelled.groupBy("codes").agg(F.first("a").alias("a"), F.first("lang").alias("lang"), F.array_sort(F.collect_list(F.struct("at", "word"))).alias("words"))
    scored = _scored(spelled.select("codes", "a", "lang"), counts, totals).join(spelled.select("codes", "words"), "codes")
    text = F.array_join(F.transform("words", lambda w: w["word"].cast("string")), " ")
    named = scored.select("lang", text.alias("phrase"), "a", "l", "r", "n", "score")
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase"))
    return named.withColumn("rank", place.cast("long")).where(F.col("rank") <= top).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
