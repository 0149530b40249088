"""Queries and oracle SQL of the training-data operators."""

from __future__ import annotations

import corpus_pipeline
from barline.llm import classifier, language, mixing, pieces, pii, quality_rules, simhash, suffix_dedup, token_count, weighted_sampling

QUERIES = {
    "pipeline": corpus_pipeline.run,
    "op1_pii_pseudonyms": pii.query,
    "op2_quality_rules": quality_rules.query,
    "op3_quality_classifier": classifier.query,
    "op4_weighted_sampling": weighted_sampling.query,
    "op5_token_counts": token_count.query,
    "op6_source_mixing": mixing.query,
    "op7_suffix_dedup": suffix_dedup.query,
    "op8_sentencepiece": pieces.query,
    "op9_simhash_dedup": simhash.query,
    "op10_language_id": language.query,
}
SQL = {
    "op2_quality_rules": quality_rules.SQL,
    "op6_source_mixing": mixing.SQL,
}
