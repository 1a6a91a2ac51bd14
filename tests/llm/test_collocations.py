import re
from collections import Counter

import numpy as np
import pytest

from intake.llm import collocations as C
from intake.llm.queries import OP12_SQL, QUERIES
from intake.llm.trie import build, match

from .oracle import same_as_sql

LOWER = {c: c + 32 for c in range(65, 91)}


def plain(rows, least, longest=5, covered=100, top=2000):
    """The definition, over dictionaries."""
    f, n = Counter(), Counter()
    for lang, text in rows:
        for piece in re.split(r"[.,;:!?\x0a-\x0d]", (text or "").translate(LOWER)):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang or "und"] += len(words)
            f.update((lang or "und", tuple(words[i : i + k])) for k in range(1, longest + 1) for i in range(len(words) - k + 1))
    found = {g: a for g, a in f.items() if len(g[1]) > 1 and a >= least}
    longer = Counter()
    for (lang, g), a in found.items():
        for k in range(2, len(g)):
            for i in range(len(g) - k + 1):
                longer[lang, g[i : i + k]] = max(longer[lang, g[i : i + k]], a)
    out = []
    for (lang, g), a in found.items():
        if longer[lang, g] * 100 >= a * covered:
            continue
        score, _, l, r = min((1000 * a * n[lang] // (f[lang, g[:k]] * f[lang, g[k:]]), k, f[lang, g[:k]], f[lang, g[k:]]) for k in range(1, len(g)))
        out.append((lang, " ".join(g), a, l, r, n[lang], score))
    ranked = []
    for lang in {o[0] for o in out}:
        mine = sorted((o for o in out if o[0] == lang), key=lambda o: (-o[6], -o[2], o[1].encode()))[:top]
        ranked += [(lang, i + 1, *o[1:]) for i, o in enumerate(mine)]
    return sorted(ranked)


def table(spark, rows):
    return spark.createDataFrame([(i % 3, t, lang, 1, "x") for i, (lang, t) in enumerate(rows)], "doc_id int, text string, lang string, n int, word string")


def random_rows(seed, n=60):
    rng = np.random.default_rng(seed)
    words = [f"w{i}" for i in range(12)] + ["É", "Ab", "x y", "字", "a\x00b"]
    ends = [" ", " ", " ", "  ", "\t", ", ", ".", "\n", "; ", "\x0b", "! "]
    text = lambda: "".join(words[min(int(rng.exponential(3)), len(words) - 1)] + ends[rng.integers(len(ends))] for _ in range(rng.integers(0, 60)))
    return [(("en", "fr", None, "und")[rng.integers(4)], text()) for _ in range(n)]


@pytest.mark.parametrize(("least", "shard"), [(3, 1 << 18), (5, 7), (2, 50)])
def test_equals_definition(spark, monkeypatch, least, shard):
    monkeypatch.setattr(C, "_BLOCK", 500)
    monkeypatch.setattr(C, "_HELD", 400)
    rows = random_rows(least) + [("en", None), ("en", ""), (None, " ... "), ("fr", "only"), ("en", "A b " * 400)]
    got = sorted(tuple(r) for r in C.collocations(table(spark, rows), least=least, shard=shard, top=40).collect())
    assert got == plain(rows, least, top=40) and got


def test_hashes_that_collide(spark, monkeypatch):
    monkeypatch.setattr(C, "_BLOCK", 300)
    rows = random_rows(4)
    got = sorted(tuple(r) for r in C.collocations(table(spark, rows), least=4, bits=5).collect())
    assert got == plain(rows, 4) and got


def test_covered_share_and_length(spark):
    rows = random_rows(9)
    got = sorted(tuple(r) for r in C.collocations(table(spark, rows), least=3, longest=3, covered=60).collect())
    assert got == plain(rows, 3, 3, 60) and got


def test_nothing_to_find(spark):
    for rows in ([("en", "a b c")], [("en", None)], [("en", "a. b. " * 50)]):
        assert C.collocations(table(spark, rows), least=10).collect() == []
    assert C.collocations(table(spark, [("en", "a")]).where("doc_id < 0"), least=1).collect() == []


def test_products_beyond_64_bits(spark):
    phrases = spark.createDataFrame([([0, 1], 3_000_000_000, "en")], "codes array<int>, a long, lang string")
    counts = spark.createDataFrame([([0], 4_000_000_000), ([1], 5_000_000_001)], "codes array<int>, n long")
    totals = spark.createDataFrame([("en", 9_000_000_000_000)], "lang string, n long")
    assert C._scored(phrases, counts, totals).first()["score"] == 1000 * 3_000_000_000 * 9_000_000_000_000 // (4_000_000_000 * 5_000_000_001)


@pytest.mark.parametrize(("m", "k", "high"), [(0, 2, 1), (1, 1, 1), (300, 2, 20), (5000, 3, 70_000), (3000, 2, 2**31 - 1), (256, 1, 256)])
def test_trie_finds_every_phrase(m, k, high):
    rng = np.random.default_rng(m)
    phrases = np.unique(rng.integers(0, high, (m, k)), axis=0).astype(np.int32)
    rng.shuffle(phrases)
    trie = build(phrases)
    x = np.r_[phrases.ravel(), -1, rng.integers(-1, min(high, 300), 2000)].astype(np.int32)
    at, which = match(trie, x, k)
    place = {tuple(p): i for i, p in enumerate(phrases.tolist())}
    want = {i: place[t] for i in range(len(x) - k + 1) if (t := tuple(x[i : i + k].tolist())) in place}
    assert dict(zip(at.tolist(), which.tolist())) == want


def test_query_equals_sql(spark):
    same_as_sql(spark, QUERIES["op12_trie_collocations"], OP12_SQL, "/root/testdata/sf0.01")
