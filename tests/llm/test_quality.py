"""Base counts by a plain count, distances by their definition, and verdicts."""

import math
import random
import re
from collections import Counter

import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from intake.llm import quality
from intake.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"
SPACE = "\x20\x09\x0a\x0b\x0c\x0d"


def plain_base(text):
    text = text or ""
    words = re.findall(rf"[^{SPACE}]+", text)
    grams = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    covered = {j for i in range(len(words) - 4) if grams[tuple(words[i : i + 5])] > 1 for j in range(i, i + 5)}
    lines = [x for x in text.split("\n") if x.strip(SPACE)]
    dup = sum(x in lines[:i] for i, x in enumerate(lines))
    failed = len(words) < 10 or 100 * len(covered) > 20 * len(words)
    return len(words), sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"), dup, len(covered), failed


def plain_distance(counts, reference):
    n, m = sum(counts.values()), sum(reference.values())
    d = 0.0
    for k in counts.keys() | reference.keys():
        p, q = counts.get(k, 0) / n, reference.get(k, 0) / m
        d += sum(x * math.log2(2 * x / (p + q)) / 2 for x in (p, q) if x)
    return math.sqrt(max(d, 0))


def kind(c):
    o = ord(c)
    if o > 127:
        return 8
    if c in SPACE:
        return 4 if c == "\n" else 3
    return 0 if c.islower() else 1 if c.isupper() else 2 if c.isdigit() else 5 if c in ".,;:!?'\"()-" else 6 if 32 < o < 127 else 7


TEXTS = [None, "", " \n\x0b", "a b c d e f g h i j", "x " * 40, "a b c d e\na b c d e\n\n \na b c d e", "é ü #*$%&|<> a\x85b c", "l1\nl1\r\nl1\n", "one two three four five six one two three four five", "é" * 3000]


def test_base_counts(spark):
    rng = random.Random(2)
    texts = TEXTS + ["".join(rng.choice(["a ", "b ", "é ", "\n", "# ", "c\t"]) for _ in range(rng.choice([5, 30, 200]))) for _ in range(60)]
    docs = spark.createDataFrame([(i, t, None if i % 3 else "xx", "k") for i, t in enumerate(texts)], "doc_id long, text string, lang string, kept string").repartition(3)
    got = {r.doc_id: r for r in quality.judge(docs).collect()}
    for i, t in enumerate(texts):
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == plain_base(t), t
        assert not (r.base_failed and r.kept)
    assert quality.judge(docs.limit(0)).collect() == []
    assert quality.keep_good(docs).columns == docs.columns


@pytest.fixture(scope="module")
def judged(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    return docs.collect(), {r.doc_id: r for r in quality.judge(docs).collect()}


def test_distances(judged):
    rows, got = judged
    words, classes = {}, {}
    for r in rows:
        own = r.text.encode().lower().split()
        if len(own) >= 50:
            for key in (r.lang, ""):
                words.setdefault(key, Counter()).update(own)
                classes.setdefault(key, Counter()).update(map(kind, r.text))
    references = {}
    for key, counts in words.items():
        total = sum(counts.values())
        if total >= 2000:
            common = {w: n for w, n in counts.items() if n >= total * 0.001}
            references[key] = common | {None: total - sum(common.values())}
    judged_rows = 0
    for r in rows:
        own = Counter(r.text.encode().lower().split())
        if sum(own.values()) < 50:
            assert got[r.doc_id].class_distance is None and got[r.doc_id].word_distance is None
            continue
        judged_rows += 1

        def both(key):
            seen = Counter()
            for w, n in own.items():
                seen[w if w in references[key] else None] += n
            return plain_distance(Counter(map(kind, r.text)), classes[key]), plain_distance(seen, references[key])

        want = both(r.lang if r.lang in references else "")
        if want[1] > 0.5:
            want = min(map(both, references), key=lambda x: x[::-1])
        assert (got[r.doc_id].class_distance, got[r.doc_id].word_distance) == pytest.approx(want, abs=1e-9)
        assert got[r.doc_id].kept == (not got[r.doc_id].base_failed and want[0] <= 0.3 and want[1] <= 0.5)
    assert judged_rows > 100


def test_query_and_clean_documents(spark, judged):
    rows, _ = judged
    got = {r.doc_id: r for r in QUERIES["op2_divergence_rules"](spark, SF).collect()}
    assert got.keys() == {r.doc_id for r in rows}
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    good = [d for d, q in labels.items() if q == 1 and d in got and not got[d].base_failed]
    assert len(good) > 50 and all(got[d].kept for d in good)
    symbols = [r.doc_id for r in rows if r.text.count("#") + r.text.count("%") > 40 and got[r.doc_id].n_words >= 50]
    assert symbols and not any(got[d].kept for d in symbols)


def test_keeping_follows_the_verdicts(spark, judged):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = quality.keep_good(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(d for d, r in judged[1].items() if r.kept)
    text = "a b c d e f g h i j k"
    odd = spark.createDataFrame([(None, text, "en"), (4, text, None), (4, "short", "en"), (5, None, "en")], "doc_id long, text string, lang string")
    assert sorted(str(r.doc_id) for r in quality.keep_good(odd).collect()) == ["4", "None"]


@pytest.mark.parametrize("sf", [SF, "/root/testdata/sf0.01"])
def test_same_as_sql(spark, sf):
    from intake.llm.queries import ORACLES

    from .oracle import same_as_sql

    same_as_sql(spark, QUERIES["op2_divergence_rules"], ORACLES["op2_divergence_rules"], sf)


def test_every_language_has_its_reference(spark, tmp_path):
    from intake.llm.queries import ORACLES

    from .oracle import TABLES, same_as_sql

    for t in TABLES:  # the views of the SQL need the others too
        if t != "documents":
            (tmp_path / f"{t}.parquet").symlink_to(f"{SF}/{t}.parquet")
    rng = random.Random(6)
    langs = ["en"] * 120 + [f"l{i:02}" for i in range(70)] * 2
    rows = [(i, " ".join(f"{lang}{rng.randrange(rng.choice([40] * 19 + [10**6]))}" for _ in range(1050)), lang) for i, lang in enumerate(langs)]
    pq.write_table(pa.table(dict(zip(("doc_id", "text", "lang"), zip(*rows)))), tmp_path / "documents.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    assert quality.references(docs).words.keys() == {"", *langs}
    assert all(r.kept for r in quality.judge(docs).collect())
    same_as_sql(spark, QUERIES["op2_divergence_rules"], ORACLES["op2_divergence_rules"], str(tmp_path))
