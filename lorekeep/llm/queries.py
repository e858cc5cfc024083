"""Queries over the given tables, one for each operator of this subpackage, and their SQL where it can express them.

Without SQL: the two classifiers (held-out accuracy), the decontamination (brute force), BPE (the tokenizers library) and the secret scan (brute force)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import bpe, chat_format, decontaminate, license_scan, near_dedup, prefix_trie, quality_model, quality_rules, resample, secrets, substring_dedup, toxicity, warc

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_toxicity": toxicity.query,
    "op2_substring_dedup": substring_dedup.query,
    "op3_decontamination": decontaminate.query,
    "op4_bpe": bpe.query,
    "op5_chat_format": chat_format.query,
    "op6_near_dedup": near_dedup.query,
    "op7_secret_scan": secrets.query,
    "op8_license_scan": license_scan.query,
    "op9_quality_classifier": quality_model.query,
    "op10_quality_rules": quality_rules.query,
    "op11_prefix_trie": prefix_trie.query,
    "op12_resample": resample.query,
    "op13_warc": warc.query,
}

ORACLE_SQL: dict[str, str] = {
    "op2_substring_dedup": substring_dedup.SQL,
    "op5_chat_format": chat_format.SQL,
    "op6_near_dedup": near_dedup.SQL,
    "op8_license_scan": license_scan.SQL,
    "op10_quality_rules": quality_rules.SQL,
    "op11_prefix_trie": prefix_trie.SQL,
    "op12_resample": resample.SQL,
    "op13_warc": warc.SQL,
}
