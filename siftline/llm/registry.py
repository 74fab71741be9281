"""Queries and SQL of the operators of this subpackage."""

from __future__ import annotations

from . import bag_minhash, decontamination, kneser_ney, language_id, license_scan, quality_rules, sentencepiece_sampling, suffix_dedup, toxicity, url_filter

QUERIES = {
    "op1_kneser_ney": kneser_ney.op1_kneser_ney,
    "op2_url_filter": url_filter.op2_url_filter,
    "op3_language_id": language_id.op3_language_id,
    "op4_license_scan": license_scan.op4_license_scan,
    "op5_suffix_dedup": suffix_dedup.op5_suffix_dedup,
    "op6_sentencepiece": sentencepiece_sampling.op6_sentencepiece,
    "op7_decontamination": decontamination.op7_decontamination,
    "op8_toxicity": toxicity.op8_toxicity,
    "op9_bag_minhash": bag_minhash.op9_bag_minhash,
    "op10_quality_rules": quality_rules.op10_quality_rules,
}

ORACLE_SQL = {
    "op2_url_filter": url_filter.ORACLE_SQL,
    "op4_license_scan": license_scan.ORACLE_SQL,
    "op10_quality_rules": quality_rules.ORACLE_SQL,
}
