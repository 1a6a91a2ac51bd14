"""Language by the nearest centroid: TF-IDF vectors of letter n-grams, several centroids a language, cosine, rejection by distance.

A text is lower-cased letter by letter, all else becomes a space (runs of it one), and its runs of one to three characters are hashed into
2**bits buckets. A bucket weighs (1 + ln count) * idf, vectors have length one. Each language has `clusters` centroids, found by spherical
k-means over its own sample: seeds are its rows of least hash, tasks assign rows and add up vectors, Spark sums them, and only the
centroids, of bounded size, reach the driver. A text gets the language of the centroid with the largest cosine, which is its score.

`rejected` says that the text is farther from every centroid than `spread` standard deviations, `slack` at least, beyond the mean distance of
sampled texts of about its length (by powers of two; a length without 20 such texts takes the next one below, the shortest known otherwise).

The sample is bounded: the `languages` labels with most rows, and of each about `per_language` rows and `language_bytes` bytes of text, chosen by
a hash with a share of the counts. Only rows whose crc32 of the doc_id as text does not leave 2 at division by 4 teach, by text and lang alone.
Every text is judged whole, in blocks, so memory stays bounded.

Edge cases: a null text, or one without a letter, is `und` with score 0 and not rejected; where nothing can be learned so is every text. Null labels and null
doc_ids teach nothing; a null doc_id is judged and not held out. Ties go to the label that comes first. Repeated rows are judged one by
one; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import shuffles_removed, stored

UNKNOWN = "und"
_BLOCK = 1 << 20
_A, _B, _C = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))
_CLASSES = 24


@cache
def _letters() -> np.ndarray:
    """The lower-case letter of each code point, 32 for what is no letter."""
    lower = (ord(c) if len(c) == 1 else ord(chr(i)) for i, c in enumerate(map(str.lower, map(chr, range(0x110000)))))
    out = np.fromiter(lower, np.uint32, 0x110000)
    out[~np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)] = 32
    return out


def counts(text: str | None, bits: int) -> tuple[np.ndarray, int]:
    """How often each bucket's n-grams stand in the text, and its number of letters."""
    total, n_letters, last = np.zeros(1 << bits, np.int64), 0, np.full(1, 32, np.uint32)
    shift = np.uint64(64 - bits)
    for at in range(0, len(text or ""), _BLOCK):
        x = _letters()[np.frombuffer(text[at : at + _BLOCK].encode("utf-32-le", "surrogatepass"), np.uint32)]
        n_letters += int((x != 32).sum())
        x = np.concatenate([last, x, [32]] if at + _BLOCK >= len(text) else [last, x]).astype(np.uint64)
        x = x[np.r_[True, (x[1:] != 32) | (x[:-1] != 32)]]
        fresh = 0 if at == 0 else min(2, len(last))  # runs that end in what the block before ended with were counted there
        one, two = x[fresh:], x[max(fresh - 1, 0) :]
        pair, three = two[:-1] * _B + two[1:], x[:-2] * _C + x[1:-1] * _B + x[2:]
        one = one[one != 32]
        for order, h in enumerate((one, pair, three)):
            h = (h + np.uint64(order + 1)) * _A
            total += np.bincount(((h ^ h >> np.uint64(29)) * _B >> shift).astype(np.int64), minlength=1 << bits)
        last = x[-2:].astype(np.uint32)
    return total, n_letters


def _vector(n: np.ndarray, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Buckets and weights of a text's vector of length one."""
    at = np.flatnonzero(n)
    w = (1 + np.log(n[at])) * idf[at]
    return at, w / max(np.linalg.norm(w), 1e-300)


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


@dataclass
class Model:
    labels: list[str]  # of each centroid
    centroids: np.ndarray  # a row each, of length one
    idf: np.ndarray
    limits: np.ndarray  # the farthest that texts of each class of length may be
    bits: int

    def nearest(self, text: str | None) -> tuple[str, float, bool]:
        n, letters = counts(text, self.bits)
        if not letters or not self.labels:
            return UNKNOWN, 0.0, False
        at, w = _vector(n, self.idf)
        near = self.centroids[:, at] @ w
        best = int(near.argmax())
        score = float(min(max(near[best], 0.0), 1.0))
        return self.labels[best], score, bool(1 - score > self.limits[_length_class(letters)])


def _length_class(letters: int) -> int:
    return min(int(letters).bit_length(), _CLASSES - 1)


def labelled_sample(docs: DataFrame, languages: int, per_language: int, language_bytes: int) -> tuple[DataFrame, list[str]]:
    """(label, text, turn) of the bounded sample, label being a number, and the names of the labels."""
    rows = docs.where("doc_id IS NOT NULL AND lang IS NOT NULL AND text IS NOT NULL").where(~held_out(F.col("doc_id"))).select("lang", "text", F.xxhash64("doc_id", "text").alias("turn"))
    rows = rows.where(F.col("lang") != UNKNOWN)
    size = rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("text").cast("long")).alias("bytes"))
    top = size.orderBy(F.desc("n"), "lang").limit(languages).collect()
    names = sorted(r["lang"] for r in top)
    share = {r["lang"]: min(1.0, per_language / r["n"], language_bytes / max(1, r["bytes"])) for r in top}
    chosen = docs.sparkSession.createDataFrame([(name, k, int(share[name] * (1 << 20))) for k, name in enumerate(names)], "lang string, label int, below int")
    met = rows.join(F.broadcast(chosen), "lang").where(F.pmod("turn", F.lit(1 << 20)) < F.col("below"))  # at most `languages` rows
    return met.select("label", "text", "turn"), names


def train(
    docs: DataFrame, languages: int = 128, per_language: int = 2000, language_bytes: int = 8 << 20, bits: int = 13, clusters: int = 3, rounds: int = 6, spread: float = 4.0, slack: float = 0.05
) -> Model:
    """The model of a bounded sample of the labelled rows that are not held out."""
    spark = docs.sparkSession
    sample, names = labelled_sample(docs, languages, per_language, language_bytes)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = {"label": pa.int32(), "turn": pa.int64(), "letters": pa.int64(), "at": pa.list_(pa.int32()), "n": pa.list_(pa.int32())}
        for batch in batches:
            found: list[list] = [[] for _ in kinds]
            for label, text, turn in zip(*(batch.column(c).to_pylist() for c in ("label", "text", "turn"))):
                n, letters = counts(text, bits)
                if letters:
                    at = np.flatnonzero(n)
                    for held, value in zip(found, (label, turn, letters, at.astype(np.int32), n[at].astype(np.int32))):
                        held.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(found, kinds.values())], names=list(kinds))

    rows = stored(sample.mapInArrow(count, "label int, turn long, letters long, at array<int>, n array<int>"), "ngrams")

    def holders(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = np.bincount(batch.column("at").flatten().to_numpy(), minlength=1 << bits)
            yield pa.RecordBatch.from_arrays([pa.array(np.flatnonzero(n)), pa.array(n[n > 0])], names=["at", "n"])

    with shuffles_removed(spark):
        held = rows.select("at").mapInArrow(holders, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).toArrow()  # 2**bits rows at most
        seeded = rows.withColumn("_place", F.row_number().over(Window.partitionBy("label").orderBy("turn", "letters"))).where(F.col("_place") <= clusters)
        seeds = seeded.orderBy("label", "_place").select("label", "at", "n").toArrow()  # `clusters` rows a label
    df = np.zeros(1 << bits)
    df[held.column("at").to_numpy()] = held.column("n").to_numpy()
    idf = np.log((1 + rows.count()) / (1 + df)) + 1
    owner = seeds.column("label").to_numpy()
    centroids = np.zeros((len(owner), 1 << bits))
    for k, (at, n) in enumerate(zip(seeds.column("at"), seeds.column("n"))):
        full = np.zeros(1 << bits, np.int64)
        full[at.values.to_numpy()] = n.values.to_numpy()
        where, w = _vector(full, idf)
        centroids[k, where] = w

    def assigned(batches: Iterator[pa.RecordBatch], model: tuple) -> Iterator[tuple[int, float, int, np.ndarray, np.ndarray]]:
        own, middle = model
        for batch in batches:
            for label, letters, at, n in zip(*(batch.column(c) for c in ("label", "letters", "at", "n"))):
                where, n = at.values.to_numpy(), n.values.to_numpy()
                w = (1 + np.log(n)) * idf[where]
                w /= np.linalg.norm(w)
                mine = np.flatnonzero(own == label.as_py())
                near = middle[mine][:, where] @ w
                yield int(mine[near.argmax()]), float(near.max()), letters.as_py(), where, w

    for _ in range(rounds):
        sent = spark.sparkContext.broadcast((owner, centroids))  # languages * clusters * 2**bits numbers at most

        def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sums: dict[int, np.ndarray] = {}
            for k, _, _, where, w in assigned(batches, sent.value):
                sums.setdefault(k, np.zeros(1 << bits))[where] += w
            for k, s in sums.items():
                at = np.flatnonzero(s)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), k, np.int32)), pa.array(at.astype(np.int32)), pa.array(s[at])], names=["k", "at", "s"])

        with shuffles_removed(spark):
            moved = rows.mapInArrow(add, "k int, at int, s double").groupBy("k", "at").agg(F.sum("s").alias("s")).toArrow()
        sent.destroy()
        new = np.zeros_like(centroids)
        new[moved.column("k").to_numpy(), moved.column("at").to_numpy()] = moved.column("s").to_numpy()
        length = np.linalg.norm(new, axis=1, keepdims=True)
        centroids = np.where(length > 0, new / np.maximum(length, 1e-300), centroids)  # one that lost all its rows stays

    sent = spark.sparkContext.broadcast((owner, centroids))

    def distances(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = [(_length_class(letters), 1 - near) for _, near, letters, _, _ in assigned(batches, sent.value)]
        yield pa.RecordBatch.from_arrays([pa.array([c for c, _ in found], pa.int32()), pa.array([d for _, d in found], pa.float64())], names=["c", "d"])

    with shuffles_removed(spark):
        far = rows.mapInArrow(distances, "c int, d double").groupBy("c").agg(F.count(F.lit(1)).alias("n"), (F.avg("d") + F.greatest(spread * F.coalesce(F.stddev("d"), F.lit(0.0)), F.lit(slack))).alias("limit")).orderBy("c").collect()
    sent.destroy()
    known = {r["c"]: r["limit"] for r in far if r["n"] >= 20} or {r["c"]: 1.0 for r in far}
    limits = np.ones(_CLASSES)
    for c in range(_CLASSES):
        below = [k for k in known if k <= c]
        limits[c] = known[max(below) if below else min(known)] if known else 1.0
    return Model([names[k] for k in owner], centroids.astype(np.float32), idf, limits, bits)


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, lang_pred, score, rejected of every document."""
    sent = docs.sparkSession.sparkContext.broadcast(model)  # bounded by the model's parameters

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [sent.value.nearest(text.as_py()) for text in batch.column("text")]
            columns = [batch.column("doc_id"), *(pa.array([f[i] for f in found], k) for i, k in enumerate((pa.string(), pa.float64(), pa.bool_())))]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "lang_pred", "score", "rejected"])

    judged = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, lang_pred string, score double, rejected boolean")
    return judged.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "rejected")


def identify(docs: DataFrame, **how) -> DataFrame:
    return predict(docs, train(docs, **how))


def keep_language(docs: DataFrame, model: Model, languages: list[str]) -> DataFrame:
    """The documents that are in one of the languages and not rejected, all columns."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("boolean")
    def fits(texts):
        return texts.map(lambda t: (lambda found: found[0] in languages and not found[2])(sent.value.nearest(t)))

    return docs.where(fits(F.col("text")))
