import random

import pytest
import xxhash
from pyspark.sql import functions as F

from intake.llm import simhash

SCHEMA = "doc_id long, text string, lang string, component_id string, fp string"


def brute(rows):
    def fp(text):
        words = (text or "").encode().lower().split()
        grams = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
        counts = [0] * 64
        for g in grams:
            h = xxhash.xxh64_intdigest(g, 42)
            for j in range(64):
                counts[j] += h >> j & 1
        return sum(1 << j for j in range(64) if 2 * counts[j] > len(grams))

    fps = {d: fp(t) for d, t in rows}
    parent = {d: d for d in fps}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(fps)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            if (fps[a] ^ fps[b]).bit_count() <= 3:
                ra, rb = sorted((find(a), find(b)))
                parent[rb] = ra
    return {d: (f"{fps[d]:016x}", find(d)) for d in ids}


def texts():
    rng = random.Random(4)
    words = ["the", "Of", "and", "IN", "é", "zwölf", "x", "y,", "idiot", " q"] + [f"w{i}" for i in range(60)]
    out = [None, "", "  \n\t ", "one", "ONE", "one two", "a b c", "A  b\tc", "the " * 5000]
    for _ in range(25):
        base = [rng.choice(words) for _ in range(rng.choice([3, 40, 300]))]
        for _ in range(rng.choice([1, 3, 9])):
            copy = list(base)
            for _ in range(rng.choice([0, 0, 1, 3])):
                copy[rng.randrange(len(copy))] = rng.choice(words)
            out.append(" ".join(copy))
    return out


@pytest.mark.parametrize("bucket", [4096, 3])
def test_same_as_brute_force(spark, bucket):
    rows = [(i * 7 % 1009, t) for i, t in enumerate(texts())]
    docs = spark.createDataFrame([(d, t, "xx", "clash", "clash") for d, t in rows], SCHEMA).repartition(3)
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.near_duplicates(docs, bucket=bucket).collect()}
    assert got == brute(rows)


def test_dense_ball_of_fingerprints(spark):
    rng = random.Random(1)
    fps = {0}
    while len(fps) < 400:
        fps.add(rng.choice(sorted(fps)) ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)))
    fps |= {rng.getrandbits(63) for _ in range(50)}
    nodes = spark.createDataFrame([(i, simhash._signed(f)) for i, f in enumerate(sorted(fps))], "node long, fp long")
    got = {r.node: r.component for r in simhash.similar_groups(nodes, bucket=50).collect()}
    fs = sorted(fps)
    seen = {}
    for i in range(len(fs)):
        if i in seen:
            continue
        todo, seen[i] = [i], i
        while todo:
            a = todo.pop()
            for b in range(len(fs)):
                if b not in seen and (fs[a] ^ fs[b]).bit_count() <= 3:
                    seen[b] = i
                    todo.append(b)
    assert {n: c for n, c in seen.items()} == {n: got.get(n, n) for n in range(len(fs))}


def test_empty_null_and_repeated_rows(spark):
    assert simhash.near_duplicates(spark.createDataFrame([], SCHEMA)).collect() == []
    docs = spark.createDataFrame([(5, "a b c d", *"xyz"), (5, "a b c d", *"xyz"), (None, "a b c d", *"xyz"), (9, "A b c d", *"xyz")], SCHEMA)
    got = sorted((r.doc_id is None, r.doc_id or 0, r.component_id) for r in simhash.near_duplicates(docs).collect())
    assert got == [(False, 5, 5), (False, 5, 5), (False, 9, 5), (True, 0, None)]
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id or 0 for r in kept.collect()) == [0, 5]  # repeats of a row go too


def test_two_texts_of_one_doc_id(spark):
    """Each text of an id has its own links, and goes or stays by them."""
    rng = random.Random(5)
    one, two, three = ([f"w{rng.randrange(400)}" for _ in range(90)] for _ in range(3))
    near = lambda words: " ".join(words[:-1] + ["other"])
    rows = [(5, " ".join(one)), (5, " ".join(two)), (7, near(one)), (9, near(two)), (3, near(three)), (6, " ".join(three)), (6, "quite another text of its own"), (6, "quite another text of its own")]
    docs = spark.createDataFrame([(d, t, *"xyz") for d, t in rows], SCHEMA).repartition(3)
    got = sorted((r.doc_id, r.component_id) for r in simhash.near_texts(docs).collect())
    assert got == [(3, 3), (5, 5), (5, 5), (6, 3), (6, 6), (6, 6), (7, 5), (9, 5)]
    kept = sorted((r.doc_id, r.text) for r in simhash.keep_one(docs).collect())
    assert kept == sorted([(3, near(three)), (5, " ".join(one)), (5, " ".join(two)), (6, "quite another text of its own")])


def test_recall_at_the_threshold(spark):
    """Pairs of texts of a five-word similarity between 0.8 and 0.85, where bands of least hashes miss most."""
    rng = random.Random(8)
    rows, pairs = [], 0
    for g in range(400):
        base = [f"w{rng.randrange(5000)}" for _ in range(180)]
        copy = list(base)
        for at in (20, 60, 100):
            copy[at] = f"x{rng.randrange(5000)}"  # three words, up to fifteen of 176 shingles each way
        a, b = ({tuple(w[k : k + 5]) for k in range(176)} for w in (base, copy))
        if 0.8 <= len(a & b) / len(a | b) < 0.85:
            rows += [(2 * g, " ".join(base)), (2 * g + 1, " ".join(copy))]
            pairs += 1
    docs = spark.createDataFrame([(d, t, *"xyz") for d, t in rows], SCHEMA)
    found = sum(r.component_id != r.doc_id for r in simhash.near_texts(docs).collect())
    print("recall", found, "of", pairs)
    assert pairs > 300 and found >= 0.995 * pairs


def test_query_covers_all_documents(spark):
    from intake.llm.queries import QUERIES

    sf = "/root/testdata/sf0.001"
    got = QUERIES["op1_simhash_pivots"](spark, sf).collect()
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").where(F.lit(True)).collect()
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in got} == brute([(r.doc_id, r.text) for r in docs])


def test_very_many_rows_of_one_fingerprint(spark):
    """A third of all rows and more: the hot fingerprint is dealt over tasks, and every row keeps its result."""
    hot = spark.range(100_000).selectExpr("id AS doc_id", "'the same page again' AS text")
    rest = spark.range(100_000, 100_300).selectExpr("id AS doc_id", "concat('w', id, ' x', id * 7, ' y', id * 13, ' z', id) AS text")
    asked = {"spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}  # tables this small would not be dealt at all
    before = {k: spark.conf.get(k) for k in asked}
    try:
        for k, v in asked.items():
            spark.conf.set(k, v)
        got = simhash.near_duplicates(hot.unionByName(rest))
        assert got.count() == 100_300 and got.where("component_id = 0").count() == 100_000
        sizes = got.rdd.mapPartitions(lambda rows: [sum(1 for _ in rows)]).collect()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert sum(sizes) == 100_300 and max(sizes) < 60_000


def test_large_bands_are_narrowed(spark):
    """Fingerprints that agree in half of their bits: all of them meet in one band."""
    rng = random.Random(6)
    fps = sorted({rng.getrandbits(32) for _ in range(300)} | {1 << 40 | k for k in range(8)})
    nodes = spark.createDataFrame([(i, f) for i, f in enumerate(fps)], "node long, fp long")
    got = {r.node: r.component for r in simhash.similar_groups(nodes, bucket=40).collect()}
    first = {i: i for i in range(len(fps))}
    for _ in range(20):
        for i, a in enumerate(fps):
            for j in range(i):
                if (a ^ fps[j]).bit_count() <= 3:
                    first[i] = first[j] = min(first[i], first[j])
    assert {i: got.get(i, i) for i in first} == first and len(got) > 5
