import hashlib
import random

import pytest

from intake.llm import suffixes
from intake.llm.queries import ORACLES, QUERIES

from .oracle import same_as_sql


def plain(rows, length):
    """rows: doc_id, bytes with distinct ids, or equal rows. The removed mask of each."""
    seen, masks = set(), {}
    for doc_id, data in sorted(set(rows), key=lambda r: (r[0] is not None, r[0] or 0)):
        mask = [False] * len(data)
        for p in range(len(data) - length + 1):
            s = data[p : p + length]
            if s in seen:
                mask[p : p + length] = [True] * length
            seen.add(s)
        masks[doc_id] = mask
    return masks


def spans(mask):
    return sum(m and (i == 0 or not mask[i - 1]) for i, m in enumerate(mask))


def corpus(rng, letters):
    passage = "".join(rng.choice(letters) for _ in range(900))
    rows = [None, "", "short", "a" * 99, "a" * 100, "a" * 400, passage, passage, passage[:100], passage[100:199], "ab" * 300]
    for _ in range(40):
        parts = []
        for _ in range(rng.choice([1, 2, 5])):
            a = rng.randrange(800)
            parts.append(rng.choice([passage[a : a + rng.choice([50, 99, 100, 101, 167, 168, 169, 300])], "".join(rng.choice(letters) for _ in range(rng.choice([1, 60, 250])))]))
        rows.append("".join(parts))
    for r in list(rows[11:25]):
        cut = rng.randrange(len(r))
        rows.append(r[:cut] + rng.choice(letters) + r[cut:])
    return rows


def check(spark, rows, schema="doc_id long, text string, runs string", tasks=4, **how):
    docs = spark.createDataFrame(rows, schema).repartition(tasks)
    want = plain([(r[0], (r[1] or "").encode()) for r in rows], 100)
    got = suffixes.report(docs, **how).collect()
    assert len(got) == len(rows)
    data = {r[0]: (r[1] or "").encode() for r in rows}
    for r in got:
        mask = want[r.doc_id]
        kept = bytes(b for b, m in zip(data[r.doc_id], mask) if not m)
        assert (r.n_bytes, r.n_removed, r.n_spans) == (len(mask), sum(mask), spans(mask)), (r.doc_id, data[r.doc_id])
        assert r.kept_sha256 == hashlib.sha256(kept).hexdigest()
    return docs


@pytest.mark.parametrize("letters", ["abcdefghij é\n", "ab"])
@pytest.mark.parametrize("block", [suffixes.BLOCK, 64])
def test_same_as_brute_force(spark, letters, block):
    rng = random.Random(len(letters) + block)
    rows = [((i * 11) % 101, t, "x") for i, t in enumerate(corpus(rng, letters))]
    rows += [(None, rows[20][1], "x"), (rows[12][0], rows[12][1], "x")]
    docs = check(spark, rows, block=block)
    assert suffixes.report(docs.limit(0)).collect() == []


def test_a_passage_that_very_many_documents_share(spark):
    """Its edges are hot: every document goes on differently."""
    rng = random.Random(8)
    passage = "".join(rng.choice("abcdefgh ") for _ in range(260))
    own = lambda: "".join(rng.choice("abcdefgh ") for _ in range(rng.randrange(150)))
    rows = [(i, own() + passage[rng.choice([0, 0, 3]) : rng.choice([260, 260, 255])] + own(), "x") for i in range(400)]
    check(spark, rows, tasks=12)


def test_a_text_beyond_a_megabyte(spark):
    rng = random.Random(3)
    long = "".join(rng.choices("abcdefgh ", k=1_300_000))
    inner = long[600_000:600_400]
    rows = [(1, long, "x"), (2, "start" + inner + "end", "x"), (3, long[1_299_800:] + long[131_000:131_200], "x"), (4, long[:1_100_000] + "!" + inner, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, h string").repartition(2)
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans) for r in suffixes.report(docs).collect()}
    assert got == {1: (1_300_000, 0, 0), 2: (408, 400, 1), 3: (400, 400, 1), 4: (1_100_401, 1_100_400, 2)}


def samples_of(texts, **how):
    import pyarrow as pa

    n = len(texts)
    got = pa.RecordBatch.from_arrays([pa.array(range(n), pa.int64()), pa.array([0] * n, pa.int32()), pa.array(texts, pa.binary())], names=["doc_id", "h", "text"])
    name, around, _, first, last, doc = suffixes.samples(suffixes.Batch.read(got), 100, **how)
    return set(zip(name.tolist(), around.tolist(), first.tolist(), last.tolist(), doc.tolist()))


@pytest.mark.parametrize("block", [64, 256, 1000])
def test_block_borders_choose_the_same(block):
    rng = random.Random(5)
    texts = ["".join(rng.choice("abcd ") for _ in range(n)).encode() for n in (3000, 0, 99, 100, 731, 40)]
    whole = samples_of(texts)
    assert samples_of(texts, block=block) == whole
    covered = sorted(i for *_, first, last, _ in whole for i in range(first, last + 1))
    assert len(covered) == len(set(covered)) == sum(max(len(t) - 99, 0) for t in texts)


def test_drop_repeats_keeps_whole_characters(spark):
    rng = random.Random(1)
    passage = "".join(chr(0xE0 + rng.randrange(30)) for _ in range(200))
    rows = [(1, "x" + passage + "y", "s", 202, 5), (2, "zz" + passage[1:150] + "w", None, 152, 6), (3, None, "s", None, 7), (4, "plain", "s", 5, 8), (None, "x" + passage + "y", "s", 202, 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, n_chars long, h long")
    got = {r.h: r for r in suffixes.drop_repeats(docs).collect()}
    assert suffixes.drop_repeats(docs).columns == docs.columns and len(got) == 5
    assert got[9].text == rows[4][1] and got[5].text == "" and got[7].text is None and got[7].n_chars is None
    assert got[6].text == "zzw" and got[6].n_chars == 3 and got[8].text == "plain"


def test_names_of_other_columns_do_not_matter(spark):
    text = "some words that repeat " * 20
    names = ["d", "g", "h", "id", "row", "data", "runs", "left", "__d", "__g", "__h", "__data", "__runs", "__new", "first", "key", "kind"]
    docs = spark.createDataFrame([(i, text, *([i] * len(names))) for i in range(2)], "doc_id long, text string, " + ", ".join(f"{n} long" for n in names))
    got = {r.doc_id: r for r in suffixes.drop_repeats(docs).collect()}
    assert got[1].text == "" and len(got[0].text) < 200 and all(got[1][n] == 1 for n in names)
    assert suffixes.drop_repeats(docs).columns == docs.columns and suffixes.report(docs).count() == 2


def test_same_as_sql(spark):
    same_as_sql(spark, QUERIES["op8_prefix_doubling"], ORACLES["op8_prefix_doubling"])
