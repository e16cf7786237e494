"""The registered queries of this package and their SQL."""

from __future__ import annotations

import importlib
from typing import Callable

from pyspark.sql import DataFrame, SparkSession

# module, query; a module's ORACLE_SQL is its query's SQL, where SQL can express it
_QUERIES = (
    ("tokenfile", "op1_token_output"), ("unigram", "op2_token_counts"), ("neighbours", "op3_embedding_dedup"), ("minhash", "op4_minhash"), ("pii", "op5_private_data"), ("lm", "op6_lm_scoring"), ("unigram", "op9_sentencepiece"),
    ("quality", "op8_quality_rules"), ("mixing", "op7_mixing"), ("chat", "op10_chat_formatting"),
    ("centroids", "op11_centroid_clustering"), ("negatives", "op12_hard_negatives"), ("passages", "op13_substring_dedup"),
)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {q: getattr(importlib.import_module(f"{__package__}.{m}"), q) for m, q in _QUERIES}


def oracle_sql() -> dict[str, str]:
    found = {q: getattr(importlib.import_module(f"{__package__}.{m}"), "ORACLE_SQL", None) for m, q in _QUERIES}
    return {q: sql for q, sql in found.items() if sql}
