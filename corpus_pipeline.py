"""Documents to packed training sequences: five operators of `intake.llm` in a row.

All stages take texts of any length whole, keep columns that they do not know, and give an empty table for an empty one. A null text has no
words and goes with the first stage. Rows that share a doc_id are judged one by one by the first stage, the third and the last; the second drops
repeats of a row; the fourth drops rows that hold a benchmark item. Rows with a null doc_id are kept by every stage that keeps their text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from intake.llm.common import in_small_batches, read_table, stored
from intake.llm.packing import pack
from intake.llm.quality import keep_good, keep_long
from intake.llm.simhash import keep_one
from intake.llm.suffixes import drop_repeats
from intake.llm.tiling import decontaminate


@in_small_batches
def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base rules, or diverge from every language's reference, go. Null and blank texts have too few words."""
    return keep_good(docs)


@in_small_batches
def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of texts whose five-word shingles have a similarity of 0.8 or more, or that such texts link, the smallest doc_id stays,
    once if its row is repeated. Texts of fewer than five words are one shingle; texts without a word are equal."""
    return keep_one(docs)


@in_small_batches
def suffix_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Strings of 100 bytes that also start earlier (a smaller doc_id, null first; ties by a hash of the text) are cut out of the texts, n_chars
    is counted anew, and what has fewer than 10 words then goes, as in the first stage."""
    return keep_long(drop_repeats(docs))


@in_small_batches
def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go. Items of fewer than five words, null texts and null items match nothing."""
    return decontaminate(docs, read_table(spark, sf_dir, "benchmark"))


@in_small_batches
def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents, placed in sequences of 4096 ids. A text without a token is one piece with its end id; repeated rows are
    packed once each."""
    return pack(docs)


STAGES = [
    ("quality rules", quality_rules),
    ("SimHash near-dedup", near_dedup),
    ("suffix-array dedup", suffix_dedup),
    ("benchmark decontamination", decontamination),
    ("packing", packing),
]

#: Fingerprints and token ids are beyond SQL; tests/llm/test_pipeline.py holds run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in a row. What a stage kept is stored, as the next one reads it several times."""
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
