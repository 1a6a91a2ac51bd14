"""SimHash near-duplicates found with pivot distance tables.

Every document gets a 64-bit fingerprint and, with it, a row of the pivot table: its Hamming distances to a fixed set of reference
fingerprints, a byte each. By the triangle inequality the largest difference between two rows is a lower bound for the distance of
the two fingerprints, so most pairs fall by comparing rows; the survivors are verified by exclusive or. Rows are computed once and carried.

A pivot table alone cannot be joined on without comparing everything with everything, so pairs meet in bands first: of `blocks`
bit blocks at least `blocks - max_distance` agree in any pair within `max_distance`, and each choice of that many blocks is one
join key. That loses no pair. The fingerprints of a band of more than `bucket` meet in narrower bands: their remaining bits are cut in
`max_distance + 1` parts, of which one agrees. What is larger still is cut in chunks, and every two chunks meet in a task of their own.
Inside a band a task joins what is linked and hands on a spanning star for each group, not all its pairs.

Fingerprints, bands and components that very many rows share are dealt over several tasks (`spread_join`).

Edge cases: a null or empty text, or one of white space, has fingerprint zero and is linked like any other; repeated rows of a
doc_id give repeated result rows; rows with a null doc_id keep their fingerprint, link nothing and get a null component;
an empty table gives an empty result; very long texts are read whole; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import spread_join, stored, text_bytes, tidy
from .components import connected_components

SEED = 42
PIVOTS = 16
_LANES = np.uint64(0x0101010101010101)


def majority(h: np.ndarray) -> int:
    """The bits that are set in over half of the hashes."""
    n = len(h)
    full = np.zeros(-(-n // 255) * 255, np.uint64)
    full[:n] = h
    full = full.reshape(-1, 255)
    value = 0
    for j in range(8):  # bit j of each of the eight bytes at once; 255 rows fit a byte's count
        lanes = ((full >> np.uint64(j)) & _LANES).sum(axis=1)
        counts = lanes.view(np.uint8).reshape(-1, 8).sum(axis=0, dtype=np.int64)
        for byte in np.flatnonzero(2 * counts > n):
            value |= 1 << (8 * int(byte) + j)
    return value


def fingerprint(text: bytes | None, width: int = 3) -> int:
    """SimHash of the `width`-word shingles of `text`, A-Z lower-cased; each occurrence of a shingle votes."""
    words = (text or b"").lower().split()
    if not words:
        return 0
    if len(words) < width:
        shingles = [b" ".join(words)]
    else:
        shingles = map(b" ".join, zip(*(words[i:] for i in range(width))))
    digest = xxhash.xxh64_intdigest
    return majority(np.fromiter((digest(s, SEED) for s in shingles), np.uint64, max(1, len(words) - width + 1)))


def reference_fingerprints(count: int) -> np.ndarray:
    """`count` fixed pivots: hashes of their numbers."""
    return np.array([xxhash.xxh64_intdigest(b"pivot %d" % i, SEED) for i in range(count)], np.uint64)


def pivot_rows(fp: np.ndarray, pivots: np.ndarray) -> pa.Array:
    """A byte for each pivot: the distance of each fingerprint."""
    table = np.bitwise_count(fp[:, None] ^ pivots[None, :]).astype(np.uint8)
    edges = np.arange(len(fp) + 1, dtype=np.int32) * len(pivots)
    return pa.Array.from_buffers(pa.binary(), len(fp), [None, pa.py_buffer(edges), pa.py_buffer(table.tobytes())])


def fingerprints(docs: DataFrame, width: int = 3, pivots: int = PIVOTS) -> DataFrame:
    """doc_id, fp (the fingerprint's 64 bits as a signed long), far (its row of the pivot table)."""
    points = reference_fingerprints(pivots)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = np.array([fingerprint(t.as_py(), width) for t in batch.column("text")], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(fp.view(np.int64)), pivot_rows(fp, points)], names=["doc_id", "fp", "far"])

    return text_bytes(docs).mapInArrow(run, "doc_id long, fp long, far binary")


def with_pivot_rows(nodes: DataFrame, pivots: int = PIVOTS) -> DataFrame:
    """node, fp, far of nodes (node, fp)."""
    points = reference_fingerprints(pivots)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = batch.column("fp")
            yield pa.RecordBatch.from_arrays([batch.column("node"), fp, pivot_rows(fp.to_numpy().view(np.uint64), points)], names=["node", "fp", "far"])

    return nodes.select("node", "fp").mapInArrow(run, "node long, fp long, far binary")


def _masks(blocks: int, distance: int) -> list[int]:
    edge = [64 * i // blocks for i in range(blocks + 1)]
    block = [((1 << edge[i + 1]) - 1) ^ ((1 << edge[i]) - 1) for i in range(blocks)]
    return [sum(c) for c in combinations(block, blocks - distance)]


def _rest(mask: int, parts: int) -> list[int]:
    """The bits outside of `mask` in so many parts."""
    bits = [1 << i for i in range(64) if not mask >> i & 1]
    return [sum(bits[len(bits) * i // parts : len(bits) * (i + 1) // parts]) for i in range(parts)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def groups_of(keys: np.ndarray) -> np.ndarray:
    """A number for each run of equal rows."""
    return np.r_[0, np.cumsum((keys[1:] != keys[:-1]).any(axis=1))] if len(keys) else np.zeros(0, int)


def linked(fp: np.ndarray, group: np.ndarray, table: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs (member, lowest member it is joined with) inside runs of equal `group`; rows are sorted by group, then by pivot 0."""
    label = np.arange(len(fp))
    found_a, found_b = [], []
    base = np.arange(len(fp))
    shift = 1
    while len(base):
        base = base[base + shift < len(fp)]
        a, b = base, base + shift
        near = (group[a] == group[b]) & (table[b, 0] - table[a, 0] <= distance)  # sorted by this coordinate: the rest lie farther yet
        base = a = a[near]
        b = a + shift
        close = np.abs(table[a] - table[b]).max(axis=1, initial=0) <= distance
        a, b = a[close], b[close]
        true = np.bitwise_count(fp[a] ^ fp[b]) <= distance
        found_a.append(a[true])
        found_b.append(b[true])
        shift += 1
    if not found_a:
        return label[:0], label[:0]
    a, b = np.concatenate(found_a), np.concatenate(found_b)
    while True:  # the lowest label spreads along links
        low = np.minimum(label[a], label[b])
        after = label.copy()
        np.minimum.at(after, a, low)
        np.minimum.at(after, b, low)
        after = after[after]
        if (after == label).all():
            break
        label = after
    member = np.flatnonzero(label != np.arange(len(fp)))
    return member, label[member]


CHUNK = ["band", "chunk_a", "chunk_b"]


def whole_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Tables that begin and end with a whole chunk pair. The rows are sorted by CHUNK."""
    rest: pa.Table | None = None
    for batch in batches:
        table = pa.Table.from_batches([batch])
        table = table if rest is None else pa.concat_tables([rest, table])
        if not len(table):
            continue
        keys = np.c_[tuple(table.column(c).to_numpy() for c in CHUNK)]
        open_from = int((keys == keys[-1]).all(axis=1).argmax())
        if open_from:
            yield table.slice(0, open_from)
        rest = table.slice(open_from)
    if rest is not None:
        yield rest


def band_links(bands: DataFrame, distance: int) -> DataFrame:
    """bands: CHUNK, fp, far, node. Links (u, v) that join what is within `distance` in each band."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in whole_groups(batches):
            group = groups_of(np.c_[tuple(rows.column(c).to_numpy() for c in CHUNK)])
            fp, node, table = rows.column("fp").to_numpy().view(np.uint64), rows.column("node").to_numpy(), pivot_table(rows.column("far"))
            order = np.lexsort((fp, table[:, 0], group))
            member, low = linked(fp[order], group[order], table[order], distance)
            yield pa.RecordBatch.from_arrays([pa.array(node[order][member]), pa.array(node[order][low])], names=["u", "v"])

    return bands.repartition(*CHUNK).sortWithinPartitions(*CHUNK).select(*CHUNK, "fp", "far", "node").mapInArrow(run, "u long, v long")


def pivot_table(far: pa.ChunkedArray) -> np.ndarray:
    held = b"".join(far.to_pylist())
    return np.frombuffer(held, np.uint8).reshape(len(far), -1).astype(np.int8)


def in_chunks(met: DataFrame, chunks: Column, node: str = "node") -> DataFrame:
    """Rows of a band dealt over its chunks: each to every pair that its own chunk is part of."""
    met = met.withColumn("chunks", chunks.cast("int"))
    met = met.withColumn("own", F.pmod(F.xxhash64(node), F.col("chunks")).cast("int"))
    met = met.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    return met.withColumns({"chunk_a": F.least("own", "other"), "chunk_b": F.greatest("own", "other")}).drop("chunks", "own", "other", "n")


def _sized(keyed: DataFrame, name: str) -> DataFrame:
    """The rows of bands of two or more, with the band's size `n`."""
    sizes = stored(keyed.groupBy("band").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), name)
    return spread_join(keyed, sizes, "band", counts=sizes.select("band", F.col("n").alias("_n")))


def similar_groups(nodes: DataFrame, distance: int = 3, blocks: int = 6, bucket: int = 4096) -> DataFrame:
    """nodes: node, fp and, where it is known, far, with distinct fp. node, component for every node that has a partner within `distance` bits.

    blocks: 6 gives 20 bands of about 32 bits, so a band of unrelated fingerprints stays small up to billions of them.
    """
    nodes = nodes if "far" in nodes.columns else with_pivot_rows(nodes)
    masks = _masks(blocks, distance)
    choice = F.array(*(F.struct(F.lit(i).alias("i"), F.lit(_signed(m)).alias("m")) for i, m in enumerate(masks)))
    keyed = nodes.withColumn("mask", F.explode(choice)).select("node", "fp", "far", F.col("mask.i").alias("i"), F.xxhash64(F.col("mask.i"), F.col("fp").bitwiseAND(F.col("mask.m"))).alias("band"))
    met = _sized(keyed, "bands")
    small = met.where(F.col("n") <= bucket).select("band", F.lit(0).alias("chunk_a"), F.lit(0).alias("chunk_b"), "fp", "far", "node")
    parts = F.array(*(F.array(*(F.lit(_signed(p)) for p in _rest(m, distance + 1))) for m in masks))
    large = met.where(F.col("n") > bucket).select("node", "fp", "far", "band", F.posexplode(F.element_at(parts, F.col("i") + 1)).alias("j", "m"))
    large = large.select("node", "fp", "far", F.xxhash64("band", "j", F.col("fp").bitwiseAND(F.col("m"))).alias("band"))
    large = in_chunks(_sized(large, "narrow-bands"), F.ceil(F.col("n") / F.lit(bucket)))
    return connected_components(band_links(small.unionByName(large.select(small.columns)), distance))


def near_duplicates(docs: DataFrame, distance: int = 3, width: int = 3, **how) -> DataFrame:
    """Every row of `docs` (doc_id, text) with its fingerprint and component.

    Returns doc_id, fp (long), fingerprint (16 hex digits), component_id (the smallest doc_id that links of `distance` or fewer
    bits reach, itself included).
    """
    each = stored(fingerprints(docs, width), "fingerprints")
    nodes = stored(each.where("doc_id IS NOT NULL").groupBy("fp").agg(F.min("doc_id").alias("node"), F.first("far").alias("far"), F.count(F.lit(1)).alias("n")), "nodes")
    groups = similar_groups(nodes.select("node", "fp", "far"), distance, **how)
    named = nodes.join(groups, "node", "left").select("fp", F.coalesce("component", "node").alias("component_id"))
    hexed = F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint")
    joined = spread_join(each.select("doc_id", "fp"), named, "fp", "left", counts=nodes.select("fp", F.col("n").alias("_n")))
    return joined.select("doc_id", "fp", hexed, F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id"))


_ODD = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9))


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ x >> np.uint64(32)) * _ODD[1]
    return x ^ x >> np.uint64(29)


def shingle_hashes(text: bytes | None, width: int) -> np.ndarray:
    """64-bit hashes of the `width`-word shingles, A-Z lower-cased, repeats included; of the whole text if it is shorter, none of an empty one."""
    words = (text or b"").lower().split()
    digest = xxhash.xxh64_intdigest
    h = np.fromiter((digest(w) for w in words), np.uint64, len(words))
    width = min(width, len(words))
    out = np.zeros(len(words) - width + 1 if width else 0, np.uint64)
    for k in range(width):
        out = _mix(out * _ODD[0] + h[k : k + len(out)])
    return out


def least_hashes(distinct: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """A key for each band: the least values of `rows` hash functions over the shingles."""
    if not len(distinct):
        return np.zeros(bands, np.uint64)
    factors = _mix(np.arange(1, bands * rows + 1, dtype=np.uint64) * _ODD[0]) | np.uint64(1)
    least = np.full(bands * rows, np.uint64(2**64 - 1))
    for at in range(0, len(distinct), 4096):
        least = np.minimum(least, (distinct[at : at + 4096, None] * factors[None, :]).min(axis=0))
    key = np.arange(bands, dtype=np.uint64)
    for r in range(rows):
        key = _mix(key * _ODD[0] + least[r::rows])
    return key


SKETCH = "doc_id long, h long, fp long, far binary, size long, keys array<long>"


def sketches(docs: DataFrame, width: int, bands: int, rows: int, pivots: int = PIVOTS) -> DataFrame:
    """Of each text: a hash of its words, its fingerprint with its pivot row, its number of distinct shingles, and its band keys."""
    points = reference_fingerprints(pivots)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            fp, whole, sizes, keys = np.zeros(n, np.uint64), np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros((n, bands), np.uint64)
            for i, text in enumerate(batch.column("text")):
                data = text.as_py() or b""
                h = shingle_hashes(data, width)
                fp[i] = majority(h) if len(h) else 0
                distinct = np.unique(h)
                whole[i] = words_hash(data)
                sizes[i], keys[i] = len(distinct), least_hashes(distinct, bands, rows)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * bands), pa.array(keys.ravel().view(np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(whole), pa.array(fp.view(np.int64)), pivot_rows(fp, points), pa.array(sizes), lists], names=["doc_id", "h", "fp", "far", "size", "keys"])

    return text_bytes(docs).mapInArrow(tidy(run), SKETCH)


def words_hash(data: bytes) -> int:
    """A hash of a text's words, A-Z lower-cased."""
    return int(np.uint64(xxhash.xxh64_intdigest(b" ".join(data.lower().split()))).view(np.int64))


def shingle_sets(texts: DataFrame, width: int) -> DataFrame:
    """texts: doc_id, text. The id with the hash of the words and the sorted distinct shingle hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data = [t.as_py() or b"" for t in batch.column("text")]
            held = [np.unique(shingle_hashes(x, width)).tobytes() for x in data]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([words_hash(x) for x in data], pa.int64()), pa.array(held, pa.binary())], names=["doc", "h", "shingles"])

    return texts.select("doc_id", "text").mapInArrow(tidy(run), "doc long, h long, shingles binary")


def set_links(node: np.ndarray, fp: np.ndarray, table: np.ndarray, sets: Callable[[int], np.ndarray], size: np.ndarray, similarity: float, radius: int) -> Iterator[tuple[int, int]]:
    """Links of one group that join all pairs of at least that Jaccard similarity. Pairs fall by pivot rows, fingerprints and sizes first;
    pairs that earlier links join are not looked at again."""
    label = np.arange(len(node))
    for i in range(len(node) - 1):
        j = np.flatnonzero((label[i + 1 :] != label[i]) & (np.minimum(size[i], size[i + 1 :]) >= similarity * np.maximum(size[i], size[i + 1 :]))) + i + 1
        j = j[np.abs(table[j] - table[i]).max(axis=1, initial=0) <= radius]
        j = j[np.bitwise_count(fp[j] ^ fp[i]) <= radius]
        for k in j.tolist():
            if label[k] == label[i]:
                continue
            a, b = sets(i), sets(k)
            both = len(np.intersect1d(a, b, assume_unique=True))
            if both >= similarity * (len(a) + len(b) - both) - 1e-9:
                yield int(node[i]), int(node[k])
                label[label == label[k]] = label[i]


def text_links(rows: DataFrame, similarity: float, radius: int) -> DataFrame:
    """rows: CHUNK, node, fp, far, shingles. Links (u, v)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for got in whole_groups(batches):
            group = groups_of(np.c_[tuple(got.column(c).to_numpy() for c in CHUNK)])
            node, fp, table = got.column("node").to_numpy(), got.column("fp").to_numpy().view(np.uint64), pivot_table(got.column("far"))
            held = got.column("shingles")
            size = np.array([len(x.as_py()) // 8 for x in held])
            links = []
            for at in np.split(np.arange(len(group)), np.flatnonzero(np.diff(group)) + 1):
                begin = int(at[0])
                links += set_links(node[at], fp[at], table[at], lambda i: np.frombuffer(held[begin + i].as_py(), np.uint64), size[at], similarity, radius)
            u, v = zip(*links) if links else ((), ())
            yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], names=["u", "v"])

    return rows.repartition(*CHUNK).sortWithinPartitions(*CHUNK, "node").select(*CHUNK, "node", "fp", "far", "shingles").mapInArrow(tidy(run), "u long, v long")


def near_texts(docs: DataFrame, similarity: float = 0.8, width: int = 5, bands: int = 12, rows: int = 3, radius: int = 26, bucket: int = 4096, bucket_bytes: int = 32 << 20) -> DataFrame:
    """doc_id, h, fp, component_id of every row: the smallest doc_id that links of texts reach whose sets of `width`-word shingles have a
    Jaccard similarity of `similarity` or more.

    At 0.8 the fingerprints of two texts differ in 10 bits on average, too many for bands of their bits. So texts meet in `bands` keys of
    `rows` least hashes of their shingles (a pair at just 0.8 is missed once in five thousand), pivot rows and fingerprints beyond
    `radius` bits (five standard deviations) discard pairs, and the exact similarity decides. Bands with the same members are looked at
    once. Texts of the same words are one node, whatever their doc_ids, and a doc_id with several texts has several nodes. A band of more than `bucket` texts, or shingles of `bucket_bytes`, is cut in chunks.
    """
    each = stored(sketches(docs, width, bands, rows), "sketches")
    key = F.concat(F.hex("h"), F.lit("-"), F.hex("fp")).alias("key")
    one = lambda *names: [F.first(c).alias(c) for c in names]  # noqa: E731  equal in all rows of a key
    nodes = each.where("doc_id IS NOT NULL").groupBy(key).agg(F.min("doc_id").alias("doc"), *one("h", "fp", "far", "size", "keys"), F.count(F.lit(1)).alias("n")).withColumn("node", F.xxhash64("h", "fp"))
    nodes = stored(nodes, "nodes")
    keyed = nodes.select("node", "size", F.explode("keys").alias("band"))
    sizes = keyed.groupBy("band").agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("node")).alias("members"), F.sum("size").alias("total")).where("n > 1")
    sizes = stored(sizes.groupBy("n", "members").agg(F.min("band").alias("band"), F.max("total").alias("total")), "bands")
    met = spread_join(keyed, sizes.select("band", "n", "total"), "band", counts=sizes.select("band", F.col("n").alias("_n")))
    chunks = F.greatest(F.ceil(F.col("n") / F.lit(bucket)), F.ceil(8 * F.col("total") / F.lit(bucket_bytes)))
    dealt = stored(in_chunks(met, chunks).select(*CHUNK, "node"), "members")
    asked = dealt.select("node").distinct().join(nodes.select("node", "doc", "h", "fp", "far"), "node")
    texts = text_bytes(docs).join(asked.select(F.col("doc").alias("doc_id")).distinct(), "doc_id", "left_semi")
    texts = texts.withColumns({"_a": F.xxhash64("text"), "_b": F.hash("text")}).dropDuplicates(["doc_id", "_a", "_b"])
    sets = shingle_sets(texts, width).dropDuplicates(["doc", "h"])
    whole = stored(asked.join(sets, ["doc", "h"]), "shingles")
    groups = connected_components(text_links(spread_join(dealt, whole, "node"), similarity, radius))
    named = stored(nodes.join(groups, "node", "left").select("key", "doc", F.coalesce("component", "node").alias("_group")), "named")
    named = spread_join(named, named.groupBy("_group").agg(F.min("doc").alias("component_id")), "_group").select("key", "component_id")
    joined = spread_join(each.select("doc_id", "h", "fp", key), named, "key", "left", counts=nodes.select("key", F.col("n").alias("_n")))
    return joined.select("doc_id", "h", "fp", F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id"))


def keep_one(docs: DataFrame, similarity: float = 0.8, width: int = 5, **how) -> DataFrame:
    """One document of each group of near-duplicate texts: the one with the smallest doc_id, once.

    Repeats of a row are dropped. Rows of one doc_id with different texts are no repeats, and each goes or stays with its own text's group;
    rows with a null doc_id are kept.
    """
    groups = stored(near_texts(docs, similarity, width, **how), "near-texts")
    named = groups.where("doc_id IS NOT NULL").select(F.col("doc_id").alias("id"), F.col("h").alias("words"), "component_id")
    again = named.groupBy("id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("id")
    text = F.col("text").cast("binary")
    packed = docs.select(F.col("doc_id").cast("long").alias("id"), F.xxhash64(text).alias("text_hash"), text.alias("data"), F.struct(*(docs[c] for c in docs.columns)).alias("row"))
    once = packed.select("id", "row").join(named.where("component_id <> id").select("id").unionByName(again).distinct(), "id", "left_anti")

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held = [words_hash(t.as_py() or b"") for t in batch.column("data")]
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("text_hash"), pa.array(held, pa.int64())], names=["id", "text_hash", "words"])

    # ids with several rows: each row by the group of its own text
    several = packed.join(again, "id", "left_semi").dropDuplicates(["id", "text_hash"])
    hashed = several.select("id", "text_hash", "data").mapInArrow(tidy(words), "id long, text_hash long, words long")
    gone = hashed.join(named.where("component_id <> id").select("id", "words").distinct(), ["id", "words"]).select("id", "text_hash")
    several = several.join(gone, ["id", "text_hash"], "left_anti").select("id", "row")
    return once.unionByName(several).select(*(F.col("row").getField(c).alias(c) for c in docs.columns))
