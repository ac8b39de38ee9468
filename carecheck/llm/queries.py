"""Registered queries of this subpackage: each applies one operator with its
production parameters to its whole table, ``(spark, sf_dir) -> DataFrame``."""

from __future__ import annotations

from carecheck.llm import (exact_dedup, jaccard_join, language_id, line_dedup, lm_trie, merkle, mixing, pii, piece_tokens, quality,
                           resample, secrets, sharding)


def _t(spark, d, name):
    return spark.read.parquet(f"{d}/{name}.parquet")


def piece_model() -> str:
    """The tokenizer's model file: a parameter of the operator, found by the installed package."""
    import public_tokenizers
    return public_tokenizers.path("piece_bpe_32k.model")


def op1_pii(spark, d):
    return pii.pii(_t(spark, d, "documents"))


def op2_sentencepiece(spark, d):
    return piece_tokens.round_trip(_t(spark, d, "documents"), piece_model())


def op3_ngram_jaccard(spark, d):
    return jaccard_join.jaccard_join(_t(spark, d, "documents"))


def op4_mixing(spark, d):
    return mixing.mixing(_t(spark, d, "documents"), _t(spark, d, "labels"))


def op5_secrets(spark, d):
    return secrets.secrets(_t(spark, d, "documents"))


def op6_language_id(spark, d):
    return language_id.language_id(_t(spark, d, "documents"))


def op7_lm_scoring(spark, d):
    return lm_trie.lm_scores(_t(spark, d, "documents"))


def op8_quality(spark, d):
    return quality.quality(_t(spark, d, "documents"))


def op9_line_dedup(spark, d):
    return line_dedup.line_dedup(_t(spark, d, "documents"))


def op10_exact_dedup(spark, d):
    return exact_dedup.exact_dedup(_t(spark, d, "documents"))


def op11_importance_resampling(spark, d):
    return resample.resample(_t(spark, d, "documents"), _t(spark, d, "benchmark"))


def op12_merkle_manifest(spark, d):
    return merkle.proofs(_t(spark, d, "documents"))


def op13_sharding(spark, d):
    return sharding.sharded(_t(spark, d, "documents"))


QUERIES = {f.__name__: f for f in (op1_pii, op2_sentencepiece, op3_ngram_jaccard, op4_mixing, op5_secrets,
                                   op6_language_id, op7_lm_scoring, op8_quality, op9_line_dedup, op10_exact_dedup, op11_importance_resampling,
                                   op12_merkle_manifest, op13_sharding)}
ORACLES = {"op4_mixing": mixing.ORACLE, "op8_quality": quality.ORACLE, "op10_exact_dedup": exact_dedup.ORACLE,
           "op11_importance_resampling": resample.ORACLE, "op12_merkle_manifest": merkle.ORACLE}
