"""Queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import bm25, bpe, conversations, jaccard, mixing, periodic, ppm, pu_quality, quality_rules, sharding, simhash, token_counts, toxicity

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_ngram_jaccard": jaccard.op1_ngram_jaccard,
    "op2_token_counts": token_counts.op2_token_counts,
    "op3_toxicity": toxicity.op3_toxicity,
    "op4_byte_bpe": bpe.op4_byte_bpe,
    "op5_sharding": sharding.op5_sharding,
    "op6_quality_rules": quality_rules.op6_quality_rules,
    "op7_ppm": ppm.op7_ppm,
    "op8_bm25": bm25.op8_bm25,
    "op9_mixing": mixing.op9_mixing,
    "op10_pu_quality": pu_quality.op10_pu_quality,
    "op11_periodic_runs": periodic.op11_periodic_runs,
    "op12_simhash": simhash.op12_simhash,
    "op13_conversation_trie": conversations.op13_conversation_trie,
}
ORACLE_SQL: dict[str, str] = {
    "op1_ngram_jaccard": jaccard.OP1_SQL,
    "op6_quality_rules": quality_rules.OP6_SQL,
    "op9_mixing": mixing.OP9_SQL,
    "op13_conversation_trie": conversations.OP13_SQL,
}
