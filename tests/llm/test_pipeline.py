"""run() against a chain of brute-force stages, and the shape of each stage."""

import random
import zlib
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline
from intake.llm import quality, tiling
from intake.llm.encode import vocabulary_path

from .test_suffixes import plain as plain_repeats
from .test_tiling import plain_tiles, words_of

SF = "/root/testdata/sf0.001"


def similar_groups(rows):
    """The smallest id that links of five-word shingles at a Jaccard similarity of 0.8 reach, over all pairs."""

    def shingles(text):
        w = text.encode().lower().split()
        return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))}

    sets = {d: shingles(t) for d, t in rows.items()}
    first = {d: d for d in sets}
    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            if first[a] != first[b] and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]):
                low, high = sorted((first[a], first[b]))
                first = {d: low if f == high else f for d, f in first.items()}
    return first


def test_near_copies_go(spark):
    """Texts of five-word similarity 0.8 to 0.98, which three bits of a fingerprint do not link."""
    rng = random.Random(2)
    rows, near = {}, 0
    for g in range(40):
        base = [f"w{rng.randrange(500)}" for _ in range(rng.choice([60, 120, 400]))]
        for k in range(4):
            copy = list(base)
            for _ in range(rng.choice([0, 1, 2, 3, 6])):
                copy[rng.randrange(len(copy))] = f"x{rng.randrange(500)}"
            rows[g * 10 + k] = " ".join(copy)
    docs = spark.createDataFrame([(d, t, "en", "s", len(t)) for d, t in rows.items()], "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    first = similar_groups(rows)
    got = {r.doc_id for r in corpus_pipeline.near_dedup(spark, docs, SF).collect()}
    assert got == {d for d in rows if first[d] == d} and 40 < len(got) < 130


def odd_rows():
    text = " ".join(f"word{i}" for i in range(30))
    long = " ".join(f"w{i}" for i in range(180_000))
    return [
        (1, text, "en", "s", 9, "a"), (1, text, "en", "s", 9, "a"), (2, text, "en", "s", 9, "b"), (3, None, None, None, None, None), (4, "", "en", "s", 0, "c"), (5, " \n", "en", "s", 2, "c"),
        (None, text + " and more of it", "en", "s", 1, "d"), (6, long, "xx", "s", 1, "e"), (7, "short text", "en", "s", 1, "f"),
    ]


def test_each_stage_on_odd_rows(spark):
    """Nulls, empty and very long texts, ties, repeats, and columns whose names the operators use."""
    docs = spark.createDataFrame(odd_rows(), "doc_id long, text string, lang string, source string, n_chars long, row string").withColumn("component_id", F.lit(0)).withColumn("h", F.lit("h"))
    left = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns, name
        left[name] = sorted(str(r.doc_id) for r in out.collect())
    assert left["quality rules"] == ["1", "1", "2", "6", "None"]
    assert left["SimHash near-dedup"] == ["1", "3", "6", "7", "None"]  # 4 and 5 are as empty as 3, 2 is 1 again
    assert left["suffix-array dedup"] == ["6", "None"]  # the null id comes first; texts of fewer than ten words go
    assert left["benchmark decontamination"] == ["1", "1", "2", "3", "4", "5", "6", "7", "None"]
    packed = corpus_pipeline.packing(spark, docs, SF).collect()
    assert {str(r.doc_id) for r in packed} == {str(r[0]) for r in odd_rows()} and sum(r.start == 0 for r in packed) == len(odd_rows())


def test_run_equals_brute_force(spark):
    from tokenizers import Tokenizer

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = {r.doc_id for r in quality.judge(docs).where("kept").collect()}  # tested on its own
    rows = {r.doc_id: r.text for r in docs.collect() if r.doc_id in kept}
    first = similar_groups(rows)
    rows = {d: t for d, t in rows.items() if first[d] == d}
    masks = plain_repeats([(d, t.encode()) for d, t in rows.items()], 100)
    cut = {}
    for d, t in rows.items():
        at, out = 0, []
        for c in t:
            size = len(c.encode())
            if not all(masks[d][at : at + size]):
                out.append(c)
            at += size
        if len("".join(out).encode().split()) >= 10:
            cut[d] = "".join(out)
    items = [words_of(r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    grams = [{tuple(i[k : k + 5]) for k in range(len(i) - 4)} for i in items]

    def clean(text):
        w = words_of(text)
        own = {tuple(w[k : k + 5]) for k in range(len(w) - 4)}
        return not any(g & own and sum(t[2] for t in plain_tiles(i, w, 5)) >= 0.6 * len(i) for i, g in zip(items, grams))

    tokenizer = Tokenizer.from_file(vocabulary_path())
    want = Counter()
    for d, t in cut.items():
        if clean(t):
            ids = np.array([*tokenizer.encode(t, add_special_tokens=False).ids, 2], "<u4")
            for at in range(0, len(ids), 4096):
                piece = ids[at : at + 4096]
                want[d, at, len(piece), zlib.crc32(piece.tobytes()), len(ids)] += 1
    got = corpus_pipeline.run(spark, SF).collect()
    assert Counter((r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens) for r in got) == want
    assert 0 < len({k[0] for k in want}) < len(kept)


def test_stages_keep_the_columns(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    empty = docs.limit(0)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, SF).columns == docs.columns, name
        assert stage(spark, empty, SF).collect() == [], name
    assert corpus_pipeline.STAGES[-1][1](spark, empty, SF).collect() == []
    assert [n for n, _ in corpus_pipeline.STAGES][0] == "quality rules" and tiling


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_stages_take_texts_in_batches_of_bounded_bytes(spark):
    """Ten thousand rows of any length made a batch, up to 64 MB in an executor, its worker and the way back."""
    session = spark.newSession()
    corpus_pipeline.quality_rules(session, session.createDataFrame(odd_rows(), "doc_id long, text string, lang string, source string, n_chars long, extra string"), SF)
    long = session.range(0, 3000, 1, 1).select(F.col("id").alias("doc_id"), F.repeat(F.lit("word "), 2000).alias("text"))

    def sizes(batches):
        import pyarrow as pa

        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows]), pa.array([batch.nbytes])], names=["n", "size"])

    got = long.mapInArrow(sizes, "n long, size long").collect()
    assert sum(r.n for r in got) == 3000 and max(r.size for r in got) < 6 << 20
    assert all(hasattr(stage, "__wrapped__") for _, stage in corpus_pipeline.STAGES)


def test_a_batch_size_of_the_user_stays(spark):
    session = spark.newSession()
    session.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "9m")
    corpus_pipeline.quality_rules(session, session.createDataFrame(odd_rows(), "doc_id long, text string, lang string, source string, n_chars long, extra string"), SF)
    assert session.conf.get("spark.sql.execution.arrow.maxBytesPerBatch") == "9m"


def test_texts_are_cut_once(spark):
    """The filter of the new texts cut them a second time, in a second worker of each task."""
    passage = " ".join(f"p{i}" for i in range(60))
    docs = spark.createDataFrame([(k, f"{passage} " * (k > 0) + f"own {k} " * 20, 0) for k in range(4)], "doc_id long, text string, n_chars long")
    cut = corpus_pipeline.suffix_dedup(spark, docs, SF)
    assert plan_of(cut).count("ArrowEvalPython") == 1
    assert all(r.n_chars == len(r.text) for r in cut.collect())


def test_packing_reads_no_rows_from_python_objects(spark):
    docs = spark.createDataFrame([(k, "some words " * (k + 1)) for k in range(9)], "doc_id long, text string")
    plan = plan_of(corpus_pipeline.packing(spark, docs, SF))
    assert "ExistingRDD" not in plan and "LocalTableScan" in plan


def test_corpus_counts_of_many_small_flushes(spark):
    docs = spark.createDataFrame([(k, f"a b c{k % 3} " * 30, "en") for k in range(40)], "doc_id long, text string, lang string").repartition(2)
    columns = quality._columns(docs)
    total = lambda df: sorted(map(tuple, df.groupBy("lang", "kind", "item").agg(F.sum("n")).collect()))
    assert total(quality.corpus_counts(columns, 50, held=1)) == total(quality.corpus_counts(columns, 50))
    assert quality.corpus_counts(columns, 50).where("kind = 'w'").count() <= 2 * 5
