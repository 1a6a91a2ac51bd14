"""Quality rules: base counts of each text, and its divergence from the reference of its language.

The references come from the corpus: for each language a histogram of character classes and one of common words (those that make up
at least `share` of the language's words, so at most 1 / share of them), both summed over all texts long enough. A document is
compared with its language by the Jensen-Shannon distance (base 2, 0 to 1) of both histograms, or with the closest language where
its words do not fit the one of its label. Texts of fewer than `min_words` words are not judged by divergence: they say too little.
Every language of `min_reference` words or more has a reference of its own; the others, and null, share the one of all texts.

Edge cases: a null, empty or blank text has no words and fails the base rules; equal rows get equal results; an empty table gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored, tidy

SYMBOLS = b"#*$%&|<>"
CLASSES = ("lower", "upper", "digit", "space", "line end", "point", "symbol", "control", "beyond ASCII")
_POOLED = ""


def _class_table() -> np.ndarray:
    table = np.full(256, len(CLASSES), np.uint8)  # bytes that continue a character count for nothing
    table[0xC0:] = 8
    table[:128] = 7
    table[0x21:0x7F] = 6
    for chars, k in ((range(0x61, 0x7B), 0), (range(0x41, 0x5B), 1), (range(0x30, 0x3A), 2), (b" \t\r\x0b\x0c", 3), (b"\n", 4), (b".,;:!?'\"()-", 5)):
        table[list(chars)] = k
    return table


_TABLE = _class_table()
_MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD], np.uint64)


@dataclass
class References:
    """Shares of character classes and of common words (the rest last) by language."""

    classes: dict[str, np.ndarray] = field(default_factory=dict)
    words: dict[str, tuple[dict[bytes, int], np.ndarray]] = field(default_factory=dict)


def class_counts(text: bytes) -> np.ndarray:
    return np.bincount(_TABLE[np.frombuffer(text, np.uint8)], minlength=len(CLASSES) + 1)[: len(CLASSES)]


def repeated_words(words: list[bytes], width: int = 5) -> int:
    """How many words lie in a `width`-word window that occurs twice or more."""
    n = len(words) - width + 1
    if n < 2:
        return 0
    h = np.fromiter(map(hash, words), np.int64, len(words)).view(np.uint64)
    h = (h ^ h >> np.uint64(32)) * _MIX[0]
    g = np.zeros(n, np.uint64)
    for k in range(width):
        g = (g ^ g >> np.uint64(29)) * _MIX[k] + h[k : k + n]
    s = np.sort(g)
    twice = s[1:][s[1:] == s[:-1]]
    if not len(twice):
        return 0
    hit = np.isin(g, twice)
    covered = np.zeros(len(words), bool)
    for k in range(width):
        covered[k : k + n] |= hit
    return int(covered.sum())


def base_counts(text: bytes, words: list[bytes]) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    lines = [x for x in text.split(b"\n") if x.strip()]
    chars = sum(map(len, words))
    if not text.isascii():
        chars -= int((np.frombuffer(text, np.uint8) & 0xC0 == 0x80).sum())
    symbols = len(text) - len(text.translate(None, SYMBOLS))
    return len(words), chars, symbols, len(lines) - len(set(lines)), repeated_words(words)


def jensen_shannon(counts: np.ndarray, reference: np.ndarray) -> float:
    """Distance of two histograms, by their shares; 0 if one is empty."""
    if not counts.sum() or not reference.sum():
        return 0.0
    p, q = counts / counts.sum(), reference / reference.sum()
    m = (p + q) / 2
    with np.errstate(divide="ignore", invalid="ignore"):
        d = np.where(p > 0, p * np.log2(p / m), 0).sum() / 2 + np.where(q > 0, q * np.log2(q / m), 0).sum() / 2
    return float(np.sqrt(min(1.0, max(0.0, d))))


def _columns(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"), F.coalesce(F.col("lang").cast("string"), F.lit(_POOLED)).alias("lang"))


def corpus_counts(docs: DataFrame, min_words: int, held: int = 200_000) -> DataFrame:
    """lang, kind ('c': class number, 'w': word), item, n: summed over batches of rows already, until they have `held` different words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words: dict[str, Counter] = {}
        classes: dict[str, np.ndarray] = {}
        for batch in batches:
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text")):
                text = text.as_py() or b""
                own = text.lower().split()
                if len(own) < min_words:
                    continue
                words.setdefault(lang, Counter()).update(own)
                classes[lang] = classes.get(lang, 0) + class_counts(text)
            if sum(map(len, words.values())) >= held:
                yield from _summed(words, classes)
                words, classes = {}, {}
        yield from _summed(words, classes)

    def _summed(words, classes):
        for lang, own in words.items():
            rows = [("c", b"%d" % i, int(n)) for i, n in enumerate(classes[lang])]
            kinds, items, ns = zip(*rows)
            yield _batch(lang, kinds, items, ns)
            yield _batch(lang, ["w"] * len(own), list(own.keys()), list(own.values()))

    def _batch(lang, kinds, items, ns):
        return pa.RecordBatch.from_arrays([pa.array([lang] * len(kinds)), pa.array(kinds, pa.string()), pa.array(items, pa.binary()), pa.array(ns, pa.int64())], names=["lang", "kind", "item", "n"])

    return docs.mapInArrow(tidy(run), "lang string, kind string, item binary, n long")


def references(docs: DataFrame, min_words: int = 50, share: float = 0.001, min_reference: int = 2000) -> References:
    """What a language looks like. At most 1 / share words of each come to the driver."""
    raw = corpus_counts(_columns(docs), min_words)
    counted = stored(raw.groupBy("lang", "kind", "item").agg(F.sum("n").alias("n")), "corpus-counts")
    rolled = counted.groupBy("kind", "item").agg(F.sum("n").alias("n")).select(F.lit(_POOLED).alias("lang"), "kind", "item", "n")
    both = counted.where(F.col("lang") != _POOLED).unionByName(rolled)
    totals = both.where("kind = 'w'").groupBy("lang").agg(F.sum("n").alias("total")).where(F.col("total") >= min_reference)
    common = both.join(F.broadcast(totals), "lang").where((F.col("kind") == "c") | (F.col("n") >= F.col("total") * share))
    found = References()
    for r in common.orderBy("lang", "kind", "item").collect():
        if r["kind"] == "c":
            found.classes.setdefault(r["lang"], np.zeros(len(CLASSES)))[int(r["item"])] = r["n"]
        else:
            index, counts = found.words.setdefault(r["lang"], ({}, [r["total"]]))
            index[bytes(r["item"])] = len(index)
            counts.insert(-1, r["n"])
            counts[-1] -= r["n"]
    found.words = {k: (index, np.array(counts, float)) for k, (index, counts) in found.words.items()}
    return found


SCORED = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, class_distance double, word_distance double"


def distances(seen: Counter, classes: np.ndarray, known: References, key: str) -> tuple[float, float]:
    """Of a text's character classes and words from the references of one language."""
    index, reference = known.words[key]
    counts = np.zeros(len(reference))
    for w, k in index.items():
        counts[k] = seen.get(w, 0)
    counts[-1] = sum(seen.values()) - counts.sum()
    return jensen_shannon(classes, known.classes[key]), jensen_shannon(counts, reference)


def _measure(text: bytes | None, lang: str | None, known: References, min_words: int, most_word: float) -> tuple:
    """The base counts and both distances of one text."""
    text = text or b""
    words = text.split()
    of_class = of_word = None
    key = lang if lang in known.words else _POOLED
    if len(words) >= min_words and key in known.words:
        seen, classes = Counter(text.lower().split()), class_counts(text)
        of_class, of_word = distances(seen, classes, known, key)
        if of_word > most_word:  # the label may be wrong: the closest language counts
            of_class, of_word = min((distances(seen, classes, known, k) for k in known.words), key=lambda x: x[::-1])
    return *base_counts(text, words), of_class, of_word


def measure(docs: DataFrame, known: References, min_words: int = 50, most_word: float = 0.5) -> DataFrame:
    """Base counts and both distances (null where they are not judged).

    A text farther than `most_word` from the language of its label is measured against the closest one.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = zip(batch.column("doc_id").to_pylist(), batch.column("text"), batch.column("lang").to_pylist())
            rows = [(doc_id, *_measure(text.as_py(), lang, known, min_words, most_word)) for doc_id, text, lang in own]
            columns = list(zip(*rows)) if rows else [()] * 8
            names = [c.split()[0] for c in SCORED.split(", ")]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64() if i < 6 else pa.float64()) for i, c in enumerate(columns)], names=names)

    return _columns(docs).mapInArrow(run, SCORED)


def judge(docs: DataFrame, min_words: int = 50, most_class: float = 0.3, most_word: float = 0.5, known: References | None = None) -> DataFrame:
    """Base counts, base_failed, the distances, and kept."""
    known = known or references(docs, min_words)
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    fits = (F.coalesce("class_distance", F.lit(0.0)) <= most_class) & (F.coalesce("word_distance", F.lit(0.0)) <= most_word)
    return measure(docs, known, min_words, most_word).withColumn("base_failed", failed).withColumn("kept", ~failed & fits)


def keep_long(docs: DataFrame, least: int = 10) -> DataFrame:
    """The rows with `least` words or more, the base rule that a text may fail after parts of it were cut out. A null text has none."""
    return docs.where(F.regexp_count(F.coalesce("text", F.lit("")), F.lit("[^\\x20\\x09-\\x0D]+")) >= least)


def keep_good(docs: DataFrame, min_words: int = 50, most_class: float = 0.3, most_word: float = 0.5, known: References | None = None) -> DataFrame:
    """The rows that the same rules keep, with all their columns and without a shuffle of texts."""
    known = known or references(docs, min_words)

    def keeps(text: str | None, lang: str | None) -> bool:
        n_words, _, _, _, repeated, of_class, of_word = _measure(text and text.encode(), lang, known, min_words, most_word)
        return n_words >= 10 and 100 * repeated <= 20 * n_words and (of_class or 0) <= most_class and (of_word or 0) <= most_word

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = [keeps(t.as_py(), lang.as_py()) for t, lang in zip(batch.column("text"), batch.column("lang"))]
            yield batch.filter(pa.array(good, pa.bool_()))

    return docs.mapInArrow(tidy(run), docs.schema)
