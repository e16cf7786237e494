"""The corpus pipeline: quality rules, MinHash near-dedup, personal data, source mixing, pieces.

Every stage works on all its predecessor kept; its result is written as Parquet and read again as
the next one's input. ``run`` applies the stages to ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from subsight.llm import minhash, mixing, pii, quality, unigram
from subsight.llm.common import read, ship, write_and_read


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 8: failing lines are removed, documents that lose too much go."""
    return quality.clean(docs)


def minhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 4: one document of each class of near-duplicates stays."""
    ship(spark)
    return minhash.deduplicate(docs)


def private_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 5: personal data and the words that disclose it are masked in the texts."""
    ship(spark)
    return pii.sanitise(docs)


def mixing_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 7: each source's documents are repeated or left out to meet its budget."""
    return mixing.repeat(docs)


def sentencepiece(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 9: the pieces of every text, and whether they decode to it."""
    ship(spark)
    return unigram.pieces(docs, unigram.default_model())


STAGES = [
    ("quality rules", quality_rules),
    ("minhash near-dedup", minhash_near_dedup),
    ("private data", private_data),
    ("mixing sources", mixing_sources),
    ("sentencepiece", sentencepiece),
]

# SQL can't express every stage (hash-random keys, BagMinHash, Viterbi); see tests/llm for the brute-force check.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = write_and_read(stage(spark, docs, sf_dir), "stage-" + name.replace(" ", "-"))
    return docs
