import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from intake.llm import langid as L
from intake.llm.queries import QUERIES

SF = "/root/testdata/sf0.01"


def plain_counts(text):
    """Runs of one to three characters of the lower-cased text, other characters as one space, one space at each end."""
    s = "".join(c.lower() if c.isalpha() and len(c.lower()) == 1 else c if c.isalpha() else " " for c in text)
    s = " " + " ".join(s.split()) + " " if s.strip() else " "
    runs = [s[i : i + n] for n in (2, 3) for i in range(len(s) - n + 1)] + [c for c in s if c != " "]
    return Counter(runs), sum(c != " " for c in s)


@pytest.mark.parametrize("block", [3, 7, 1 << 20])
def test_counts_equal_plain_runs(monkeypatch, block):
    monkeypatch.setattr(L, "_BLOCK", block)
    for text in ("Abc abd, ABC! 123 é ß x", "a", "  a  ", "aa" * 20 + " b", "日本語 のテキスト", "İI"):
        n, letters = L.counts(text, 20)
        want, n_letters = plain_counts(text)
        assert letters == n_letters and sorted(n[n > 0].tolist()) == sorted(want.values()), text
    assert L.counts(None, 5)[1] == 0 and L.counts("", 5)[0].sum() == 0


def test_held_out_accuracy(spark):
    got = {r.doc_id: r for r in QUERIES["op13_nearest_centroid"](spark, SF).collect()}
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    assert sorted(got) == sorted(r.doc_id for r in docs)
    hits = Counter()
    for r in docs:
        g = got[r.doc_id]
        assert g.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= g.score <= 1
        assert (g.lang_pred == "und") == (not any(c.isalpha() for c in r.text or ""))
        if g.held_out and g.lang_pred != "und":
            hits[g.lang_pred == r.lang] += 1
    print("held out", hits)
    assert hits[True] / sum(hits.values()) > 0.95
    assert sum(r.rejected for r in got.values()) < 0.05 * len(got)


def test_held_out_labels_teach_nothing(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    turned = docs.withColumn("lang", F.when(L.held_out(F.col("doc_id")), "xx").otherwise(F.col("lang")))
    one, two = L.train(docs), L.train(turned.repartition(3))
    assert one.labels == two.labels and np.allclose(one.centroids, two.centroids, atol=1e-6)


def test_centroids_equal_plain_k_means(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    model = L.train(docs, bits=10, clusters=2, rounds=2)
    rows = [(r.lang, L.counts(r.text, 10), r.turn) for r in docs.select("lang", "text", F.xxhash64("doc_id", "text").alias("turn"), L.held_out(F.col("doc_id")).alias("out")).collect() if r.lang and r.text and not r.out]
    rows = [(lang, n, turn, letters) for lang, (n, letters), turn in rows if letters]
    idf = np.log((1 + len(rows)) / (1 + sum((n > 0).astype(float) for _, n, _, _ in rows))) + 1

    def vector(n):
        w = np.where(n > 0, (1 + np.log(np.maximum(n, 1))) * idf, 0)
        return w / np.linalg.norm(w)

    want = []
    for lang in sorted({r[0] for r in rows}):
        mine = sorted((r for r in rows if r[0] == lang), key=lambda r: (r[2], r[3]))
        middle = [vector(r[1]) for r in mine[:2]]
        for _ in range(2):
            near = [int(np.argmax([m @ vector(r[1]) for m in middle])) for r in mine]
            sums = [sum((vector(r[1]) for r, k in zip(mine, near) if k == c), np.zeros(1 << 10)) for c in range(len(middle))]
            middle = [s / np.linalg.norm(s) if s.any() else m for s, m in zip(sums, middle)]
        want += middle
    assert np.allclose(model.centroids, np.array(want), atol=1e-5) and np.allclose(model.idf, idf)


def test_odd_rows(spark):
    en, fr = "the cat and the dog are there with others " * 4, "le chat et le chien sont dans la maison avec eux " * 4
    rows = [(i, (en, fr)[i % 2], ("en", "fr")[i % 2]) for i in range(40)]
    rows += [(50, None, "en"), (51, "", "fr"), (52, "123 !!", "en"), (None, fr, "fr"), (54, en, None), (0, en, "en"), (55, "the " * 300_000, None), (56, "字字字 字字 " * 50, None)]
    df = spark.createDataFrame([(*r, "s", 1.0, True) for r in rows], "doc_id long, text string, lang string, source string, score double, rejected boolean")
    got = L.identify(df).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got}
    assert [by[k].lang_pred for k in (50, 51, 52, None, 54, 55)] == ["und", "und", "und", "fr", "en", "en"]
    assert by[50].score == 0 and not by[50].rejected and by[56].rejected and not by[54].rejected
    assert sum(r.doc_id == 0 for r in got) == 2
    assert L.identify(df.where("doc_id < 0")).collect() == []
    assert {r.lang_pred for r in L.identify(df.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}
    model = L.train(df)
    kept = L.keep_language(df, model, ["fr"])
    assert kept.columns == df.columns and {r.lang for r in kept.collect()} == {"fr"}
