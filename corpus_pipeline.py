"""The corpus pipeline: quality rules, near-duplicates, benchmark decontamination, secrets, BPE.

Each stage takes and returns rows with the columns of `documents`; the last one returns the encoded documents. Every stage is a table in
the shared folder before the next one reads it, so a lost executor costs the tasks of one stage at most; tables are removed when nothing reads them any more, and only the result's stays.

Rows whose doc_id is null pass the stages that judge by id (near-duplicates, decontamination); the quality rules judge them as any row, and
their secrets are cut out. Repeated rows of one id share its verdict."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lorekeep.llm import bpe, decontaminate, near_dedup, quality_rules, secrets
from lorekeep.llm.common import cut, discard, scratch, table

#: The stages before the last are not SQL: they hold hashed candidates and edit distances; tests compare with brute force.
ORACLE_SQL = None


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules keep. The verdict is a column beside the row: no join."""
    return quality_rules.apply_rules(docs, keep_row=True).where("kept").select("_row.*")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays, the one with the smallest id; of repeated rows of that id, all."""
    gone = near_dedup.near_duplicates(docs).where("not kept").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item, within the edits allowed, go."""
    gone = decontaminate.find_leaks(docs, table(spark, sf_dir, "benchmark")).where("contaminated").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(docs.columns)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are cut out of the texts and n_chars follows; no document goes."""
    return secrets.redact_secrets(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe.encode_decode(docs, with_ids=True)


STAGES = [("quality rules", quality), ("near-duplicates", near_duplicates), ("benchmark decontamination", decontamination), ("secret scan", secret_scan), ("BPE", encode)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, last = table(spark, sf_dir, "documents"), []
    for name, stage in STAGES:
        with scratch() as used:
            docs = cut(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        discard(*last, *used[:-1])  # a stage that is written needs neither its input nor the tables on the way
        last = used[-1:]
    return docs
