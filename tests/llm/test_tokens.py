"""Encoding, binary records, edit-aware counts and packing, against the tokenizer itself."""

import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from intake.llm import editcount, packing, records
from intake.llm.common import new_folder
from intake.llm.encode import WordEncoder, vocabulary_path
from intake.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"
ODD = [None, "", " ", "it's I'LL <|endoftext|> don't", "Ünï 5 ﬁ ǅ İ straße ΟΔΟΣ", "a\x1cb \x85c\xa0d", "日本語 テスト é", "xªy º µ 12,300.50!!", "\x00 \x7f", "word " * 9000]


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(vocabulary_path())


def ids_of(tokenizer, text):
    return [*tokenizer.encode(text or "", add_special_tokens=False).ids, 2]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def odd_docs(spark):
    rows = [(i * 37 % 101, t, "x", 1.5) for i, t in enumerate(ODD)] + [(None, "no id", "x", None), (3, "same", "x", None), (3, "same", "x", None), (3, "other", None, None)]
    return spark.createDataFrame(rows, "doc_id long, text string, start string, n_tokens double").repartition(3)


def test_encoder_is_the_tokenizer(tokenizer):
    enc = WordEncoder(vocabulary_path(), 20)
    for text in ODD:
        assert np.frombuffer(enc.encode((text or "").encode()), "<u2").tolist() == ids_of(tokenizer, text)[:-1], text


def expected_records(tokenizer, rows):
    out, start = [], 0
    for doc_id, text in rows:
        ids = ids_of(tokenizer, text)
        out.append((doc_id, start, len(ids), crc(ids)))
        start += len(ids)
    return out


def test_records_round_trip(spark, tokenizer):
    docs = odd_docs(spark)
    got = [tuple(r) for r in records.round_trip(docs).orderBy("start").collect()]
    assert [r[0] for r in got] == sorted((r.doc_id for r in docs.collect()), key=lambda x: (x is not None, x))
    texts = {}
    for r in docs.collect():
        ids = ids_of(tokenizer, r.text)
        texts.setdefault(r.doc_id, []).append((len(ids), crc(ids)))
    assert {k: sorted((g[2], g[3]) for g in got if g[0] == k) for k in texts} == {k: sorted(v) for k, v in texts.items()}
    assert [r[1] for r in got] == [sum(x[2] for x in got[:i]) for i in range(len(got))]
    assert records.round_trip(docs.limit(0)).collect() == []


def test_shuffled_reads_and_damage(spark, tokenizer):
    docs = odd_docs(spark)
    root = new_folder(spark, "records")
    shards = records.write_records(docs, root, shard_bytes=200)
    index = records.read_index(shards, root)
    assert index.count() == docs.count() and shards.count() > 2
    wanted = index.where("doc_id = 37")
    got = records.read_shuffled(wanted, root, seed=5).collect()
    assert [r.ids for r in got] == [ids_of(tokenizer, ODD[1])]
    everything = records.read_shuffled(index, root, seed=9)
    assert sorted(map(str, ((r.doc_id, r.ids) for r in everything.collect()))) == sorted(str((r.doc_id, ids_of(tokenizer, r.text))) for r in docs.collect())
    name = root.removeprefix("file:").replace("//", "") + "/" + shards.first()["shard"] + ".rec"
    data = bytearray(open(name, "rb").read())
    data[-6] ^= 1
    open(name, "wb").write(data)
    with pytest.raises(Exception, match="damaged"):
        records.read_records(shards, root).collect()


def test_records_query(spark, tokenizer):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").collect()]
    got = QUERIES["op4_binary_records"](spark, SF).orderBy("start").collect()
    assert [(r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in got] == expected_records(tokenizer, rows)


def check_packing(rows, tokenizer, got, size):
    left = {}
    for doc_id, text in rows:
        left.setdefault(doc_id, []).append(ids_of(tokenizer, text))
    by_sequence = {}
    for r in got:
        assert 0 < r.length <= size
        by_sequence.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in by_sequence.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= size
    assert sorted(by_sequence) == list(range(len(by_sequence)))
    seen = sorted((str(r.doc_id), r.start, r.length, r.ids_crc32, r.doc_tokens) for r in got)
    want = sorted((str(d), at, len(ids[at : at + size]), crc(ids[at : at + size]), len(ids)) for d, all_ids in left.items() for ids in all_ids for at in range(0, len(ids), size))
    assert seen == want
    return len(by_sequence)


def test_packing(spark, tokenizer):
    docs = odd_docs(spark)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    check_packing(rows, tokenizer, packing.pack(docs, size=64, bucket_rows=10).collect(), 64)
    assert packing.pack(docs.limit(0)).collect() == []


def test_packing_query(spark, tokenizer):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    got = QUERIES["op10_shortest_pack_first"](spark, SF).collect()
    n = check_packing(rows, tokenizer, got, 4096)
    total = sum(r.length for r in got)
    assert n <= -(-total // 4096) * 1.03 + 1


def test_patterns_place_every_length_once():
    rng = random.Random(3)
    for size in (1, 7, 64):
        histogram = {n: rng.choice([1, 2, 50, 10**6]) for n in rng.sample(range(1, size + 1), min(size, 20))}
        patterns = packing.shortest_pack_first(histogram, size)
        placed = {}
        for pattern, count in patterns:
            assert count > 0 and sum(a * b for a, b in pattern) <= size
            for length, times in pattern:
                placed[length] = placed.get(length, 0) + times * count
        assert placed == histogram
    assert packing.shortest_pack_first({}, 9) == []


def apply_plainly(text, edits):
    out, free = [], 0
    n = len(text)
    for at, gone, new in sorted(set(edits)):
        stop = min(at + gone, n)
        at = min(max(at, free), n)
        out += [text[free:at], new]
        free = max(stop, at)
    return "".join(out) + text[free:]


def test_edits_equal_whole_encoding(spark, tokenizer):
    rng = random.Random(8)
    bits = ["the", " ", "\n", "é", "straße", " of ", "x", "<|endoftext|>", ",", "  \t", "word word", "日本", ""]
    rows, edits = [], []
    for d in range(60):
        rows.append((d, "".join(rng.choice(bits) for _ in range(rng.choice([0, 1, 30, 400]))), "e"))
        for _ in range(rng.choice([0, 1, 3, 12])):
            n = len(rows[-1][1])
            edits.append((d, rng.choice([0, n, n + 5, rng.randrange(n + 1)]), rng.choice([0, 0, 1, 4, 60]), rng.choice(["", " ", "ab", " new word ", "w " * 80])))
    docs = spark.createDataFrame([*rows, (None, "a b", "e"), (900, None, "e")], "doc_id long, text string, edits string")
    edit_rows = spark.createDataFrame([*edits, (None, 0, 1, "z"), (777, 0, 1, "z"), (900, None, None, None)], "doc_id long, position long, n_deleted long, inserted string")
    got = editcount.apply_edits(editcount.build_trees(docs, leaf=3), edit_rows, leaf=3).collect()
    assert len(got) == 62
    texts = dict((r[0], r[1]) for r in rows) | {None: "a b", 900: ""}
    for r in got:
        want = apply_plainly(texts[r.doc_id], [e[1:] for e in edits if e[0] == r.doc_id])
        assert (r.text or b"").decode() == want
        assert r.n_tokens_before == len(ids_of(tokenizer, texts[r.doc_id])) - 1
        assert r.n_tokens == len(ids_of(tokenizer, want)) - 1 == r.tree[1]
        again = editcount.SegmentTree.build(want.encode(), WordEncoder(vocabulary_path()), 3)
        assert again.total == r.n_tokens
        ends = [*r.starts[1:], len(want.encode())]
        half = len(r.tree) // 2
        for k, (a, b) in enumerate(zip(r.starts, ends)):
            assert r.tree[half + k] == len(ids_of(tokenizer, want.encode()[a:b].decode())) - 1
    assert editcount.apply_edits(editcount.build_trees(docs.limit(0)), edit_rows).collect() == []
    assert editcount.apply_edits(editcount.build_trees(docs), edit_rows.limit(0)).where("n_tokens <> n_tokens_before").collect() == []


def test_edit_query(spark, tokenizer):
    from intake.llm.queries import document_edits

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    edits = {}
    for e in document_edits(docs).collect():
        edits.setdefault(e.doc_id, []).append((e.position, e.n_deleted, e.inserted))
    texts = {r.doc_id: r.text for r in docs.collect()}
    got = {r.doc_id: r for r in QUERIES["op5_edit_counts"](spark, SF).collect()}
    assert got.keys() == texts.keys()
    for d, text in texts.items():
        want = apply_plainly(text, edits[d])
        assert (got[d].n_tokens_before, got[d].n_tokens, got[d].n_bytes) == (len(ids_of(tokenizer, text)) - 1, len(ids_of(tokenizer, want)) - 1, len(want.encode()))
    whole = [r for r in got.values() if r.n_bytes > 6000]
    assert sum(r.n_bytes_encoded for r in whole) < 0.4 * sum(r.n_bytes for r in whole)


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_other_tokenizers_give_their_own_ids(spark, name):
    from tokenizers import Tokenizer

    from intake.llm.encode import words_stand_alone

    path = vocabulary_path(name)
    own = Tokenizer.from_file(path)
    assert words_stand_alone(path) == (name == "word_bpe_49k.json")
    docs = odd_docs(spark)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    got = records.round_trip(docs, path).collect()
    assert sorted(map(str, ((r.doc_id, r.n_tokens, r.ids_crc32) for r in got))) == sorted(str((d, len(ids_of(own, t)), crc(ids_of(own, t)))) for d, t in rows)
    check_packing(rows, own, packing.pack(docs, size=64, tokenizer=path).collect(), 64)
    if name != "word_bpe_49k.json":
        with pytest.raises(ValueError, match="independently"):
            editcount.build_trees(docs, tokenizer=path)


def test_the_index_leads_to_the_records(spark, tokenizer):
    docs = odd_docs(spark)
    root = new_folder(spark, "records")
    shards = records.write_records(docs, root, shard_bytes=300)
    index = records.read_index(shards, root)
    some = index.where("doc_id > 30")
    got = records.read_indexed(some, root, block_bytes=100).collect()
    assert sorted(r.doc_id for r in got) == sorted(r.doc_id for r in docs.where("doc_id > 30").collect())
    with pytest.raises(Exception, match="names another record"):
        records.read_indexed(some.withColumn("n_tokens", F.col("n_tokens") + 1), root).collect()


def test_slots_of_many_pieces():
    rng = random.Random(4)
    rows = packing.assignments(packing.shortest_pack_first({n: rng.choice([1, 5, 1000]) for n in range(1, 65)}, 64))
    blocks, width = packing.in_blocks(rows)
    assert len(blocks) <= 2 * len(rows) + 64
    found = {}
    for length, block, first, last, *_ in blocks:
        for r in range(max(first, block * width[length]), min(last, (block + 1) * width[length])):
            found[length, r] = found.get((length, r), 0) + 1
    assert set(found.values()) == {1} and len(found) == sum(last - first for _, first, last, _, _ in rows)
