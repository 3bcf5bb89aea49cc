"""The queries of the training-data operators, and SQL for those that SQL can express."""

from __future__ import annotations

from kinmatch.llm import (
    alignment,
    bpe_dropout,
    clustering,
    exact_topk,
    license_scan,
    lm_bloom,
    mixing,
    preference,
    quality_gam,
    quality_rules,
    simhash,
    suffix_dedup,
    toxicity,
)
from kinmatch.llm.common import read_table


def op1_preference_format(spark, sf_dir):
    return preference.preference_pairs(read_table(spark, sf_dir, "conversations"))


def op2_simhash_vptree(spark, sf_dir):
    return simhash.near_duplicates(read_table(spark, sf_dir, "documents"))


def op3_quality_gam(spark, sf_dir):
    return quality_gam.quality_scores(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op4_lm_bloom(spark, sf_dir):
    return lm_bloom.lm_scores(read_table(spark, sf_dir, "documents"))


def op5_segment_topk(spark, sf_dir):
    return exact_topk.nearest(read_table(spark, sf_dir, "embeddings"))


def op6_poisson_mixing(spark, sf_dir):
    return mixing.mixture(read_table(spark, sf_dir, "documents"))


def op7_toxicity_chain(spark, sf_dir):
    return toxicity.toxicity_scores(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op8_bpe_dropout(spark, sf_dir):
    return bpe_dropout.segmentations(read_table(spark, sf_dir, "documents"))


def op9_license_scan(spark, sf_dir):
    return license_scan.license_scan(read_table(spark, sf_dir, "documents"))


def op10_quality_rules(spark, sf_dir):
    return quality_rules.quality_rules(read_table(spark, sf_dir, "documents"))


def op11_centroid_drift(spark, sf_dir):
    return clustering.clustering(read_table(spark, sf_dir, "embeddings"))


def op12_suffix_dedup(spark, sf_dir):
    return suffix_dedup.suffix_dedup(read_table(spark, sf_dir, "documents"))


def op13_token_alignment(spark, sf_dir):
    return alignment.aligned(read_table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_preference_format": op1_preference_format,
    "op2_simhash_vptree": op2_simhash_vptree,
    "op3_quality_gam": op3_quality_gam,
    "op4_lm_bloom": op4_lm_bloom,
    "op5_segment_topk": op5_segment_topk,
    "op6_poisson_mixing": op6_poisson_mixing,
    "op7_toxicity_chain": op7_toxicity_chain,
    "op8_bpe_dropout": op8_bpe_dropout,
    "op9_license_scan": op9_license_scan,
    "op10_quality_rules": op10_quality_rules,
    "op11_centroid_drift": op11_centroid_drift,
    "op12_suffix_dedup": op12_suffix_dedup,
    "op13_token_alignment": op13_token_alignment,
}

ORACLES = {
    "op1_preference_format": preference.ORACLE,
    "op5_segment_topk": exact_topk.ORACLE,
    "op6_poisson_mixing": mixing.ORACLE,
    "op10_quality_rules": quality_rules.ORACLE,
    "op11_centroid_drift": clustering.ORACLE,
}
