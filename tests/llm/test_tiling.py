import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from intake.llm import tiling
from intake.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"


def words_of(text):
    data = (text or "").encode().translate(tiling._PLAIN)
    return data.split()


def plain_tiles(item, text, seed):
    """The textbook rounds: find the longest free match by trying all pairs, mark it, repeat."""
    marked_i, marked_t, tiles = [False] * len(item), [False] * len(text), []
    while True:
        best = (0, 0, 0)
        for i in range(len(item)):
            for t in range(len(text)):
                n = 0
                while i + n < len(item) and t + n < len(text) and item[i + n] == text[t + n] and not marked_i[i + n] and not marked_t[t + n]:
                    n += 1
                if n > best[0]:
                    best = (n, i, t)
        n, i, t = best
        if n < seed:
            return tiles
        tiles.append((i, t, n))
        for k in range(n):
            marked_i[i + k] = marked_t[t + k] = True


def plain(docs, items, seed, coverage):
    out = []
    for d, text in docs:
        for k, item in items:
            iw = words_of(item)
            tiles = plain_tiles(iw, words_of(text), seed)
            covered = sum(t[2] for t in tiles)
            if tiles and covered / len(iw) >= coverage:
                out.append((d, k, round(covered / len(iw), 9), len(tiles), max(t[2] for t in tiles)))
    return sorted(map(str, out))


def made(rng):
    vocabulary = [f"w{i}" for i in range(12)] + ["É", "x.y", "The"]
    items = [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.choice([2, 4, 10, 30])))) for i in range(12)] + [(50, None), (51, ""), (None, "the null item has six words"), (52, "a a a a a a a a")]
    docs = [(0, None), (1, ""), (2, "a " * 50), (None, "The NULL item, has six... words")]
    for d in range(3, 40):
        parts = []
        for _ in range(rng.choice([1, 3])):
            w = (items[rng.randrange(12)][1]).split()
            cut = rng.randrange(len(w))
            parts += rng.choice([w, w[cut:] + w[:cut], w[:cut] + ["zz"] + w[cut:]])
            parts += [rng.choice(vocabulary) for _ in range(rng.choice([0, 5]))]
        docs.append((d, " ".join(parts).upper() if d % 5 == 0 else ", ".join(parts)))
    return docs, items


@pytest.mark.parametrize("filter_bits", [27, 3])
def test_same_as_brute_force(spark, filter_bits):
    docs, items = made(random.Random(9))
    frame = spark.createDataFrame([(d, t, "x") for d, t in docs], "doc_id long, text string, item_id string").repartition(3)
    bench = spark.createDataFrame([(k, t, 1.0) for k, t in items], "item_id long, text string, coverage double")
    got = tiling.contaminations(frame, bench, seed=3, coverage=0.5, filter_bits=filter_bits).collect()
    assert sorted(str((r.doc_id, r.item_id, round(r.coverage, 9), r.n_tiles, r.longest_tile)) for r in got) == plain(docs, items, 3, 0.5)
    bad = {r.doc_id for r in got}
    clean = tiling.decontaminate(frame, bench, seed=3, coverage=0.5, filter_bits=filter_bits)
    assert clean.columns == frame.columns
    assert sorted(str(r.doc_id) for r in clean.collect()) == sorted(str(d) for d, _ in docs if d not in bad)


def test_reordered_passages(spark):
    item = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen"
    w = item.split()
    docs = spark.createDataFrame([(1, "intro " + " ".join(w[7:] + ["between"] + w[:7]) + " end"), (2, " ".join(w[:8])), (3, " ".join(reversed(w)))], "doc_id long, text string")
    bench = spark.createDataFrame([(7, item)], "item_id long, text string")
    assert [tuple(r) for r in tiling.contaminations(docs, bench).collect()] == [(1, 7, 1.0, 2, 7)]
    assert tiling.contaminations(docs.limit(0), bench).collect() == [] == tiling.contaminations(docs, bench.limit(0)).collect()
    assert tiling.decontaminate(docs, bench.limit(0)).count() == 3


def test_a_very_long_text_and_a_seed_of_all_items(spark):
    rng = random.Random(12)
    common = "which of the following is"
    items = [(k, f"{common} " + " ".join(rng.choices("abcdefghij", k=1)[0] + str(rng.randrange(400)) for _ in range(14))) for k in range(40)]
    filler = [f"z{rng.randrange(1000)}" for _ in range(220_000)]
    filler[100_000:100_000] = items[3][1].split()[9:]
    filler[180_000:180_000] = items[3][1].split()[:9] + ["x"] + items[7][1].split()[:6]
    docs = [(1, " ".join(filler)), (2, common), (3, f"{common} " * 300), (4, items[5][1] + " " + items[6][1])] + [(i, f"{common} {i}") for i in range(5, 200)]
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    got = tiling.contaminations(frame, spark.createDataFrame(items, "item_id long, text string")).collect()
    assert len(docs[0][1]) > 1_000_000
    assert sorted((r.doc_id, r.item_id, r.coverage, r.n_tiles) for r in got) == [(1, 3, 1.0, 2), (4, 5, 1.0, 1), (4, 6, 1.0, 1)]


def test_words_are_compared_as_such(monkeypatch):
    """Equal hashes of unequal words make no tile."""
    item, text = b"a b c d e f g h", b"a b c d e f g h"
    assert [m[1] for m in tiling.tile(text, [(1, item)], 3, 0.6)] == [1.0]
    monkeypatch.setattr(tiling, "running_hash", lambda words, width: np.zeros(max(0, len(words) - width + 1), np.uint64))
    assert [m[1] for m in tiling.tile(text, [(1, item)], 3, 0.6)] == [1.0]
    assert list(tiling.tile(b"a c e g b d f h a a", [(1, item)], 3, 0.6)) == []


def test_names_of_other_columns_do_not_matter(spark):
    names = ["d", "g", "h", "id", "row", "number", "items", "item", "n", "need", "seed", "item_id"]
    docs = spark.createDataFrame([(1, "one two three four five six", *([7] * len(names))), (2, "other", *([8] * len(names)))], "doc_id long, text string, " + ", ".join(f"{n} long" for n in names))
    bench = spark.createDataFrame([(5, "One two, three four five", 3)], "item_id long, text string, number long")
    kept = tiling.decontaminate(docs, bench)
    assert kept.columns == docs.columns and [tuple(r) for r in kept.collect()] == [(2, "other", *([8] * len(names)))]
    assert [tuple(r)[:3] for r in tiling.contaminations(docs, bench).collect()] == [(1, 5, 1.0)]


def test_query_finds_all_whole_passages(spark):
    got = {(r.doc_id, r.item_id) for r in QUERIES["op3_string_tiling"](spark, "/root/testdata/sf0.1").collect()}
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("doc_id", "text")
    items = spark.read.parquet("/root/testdata/sf0.1/benchmark.parquet").select("item_id", F.col("text").alias("item"))
    held = docs.join(F.broadcast(items), F.expr("contains(text, item)")).select("doc_id", "item_id").collect()
    assert held and {tuple(r) for r in held} <= got
    assert len({d for d, _ in got}) < 400


def test_an_item_that_very_many_documents_quote(spark):
    """More pairs than one task takes of an item: they are dealt over tasks, and none is lost."""
    item = "one item that every document here quotes as a whole"
    docs = spark.range(10_500).selectExpr("id AS doc_id", f"concat('d', id, ' begins ', '{item}') AS text")
    benchmark = spark.createDataFrame([(1, item), (2, "another item that nobody here quotes in any form at all")], "item_id long, text string")
    found = tiling.contaminations(docs, benchmark).groupBy("item_id").agg(F.countDistinct("doc_id"), F.count("*"), F.min("coverage")).collect()
    assert [tuple(r) for r in found] == [(1, 10_500, 10_500, 1.0)]
