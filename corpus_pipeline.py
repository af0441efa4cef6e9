"""From raw documents to token ids: the corpus stages in order.

Each stage works on all rows its predecessor kept and is written before the next one reads it, so a
lost executor repeats a stage at most. All but the last return the columns of ``documents``:

toxicity          documents that score 0.5 or more go
exact dedup       of equal texts (A-Z lower-cased) the largest doc_id stays
near dedup        of documents linked by 80 % of their five-word shingles the smallest doc_id stays
decontamination   documents that hold ten consecutive words of a benchmark item, or a whole shorter item, go
tokens            doc_id, token ids, their number and the digests of ids and decoded text
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from chorale.llm import bpe_chunks, decontaminate, grace_dedup, occurrence_join, toxic_kernel
from chorale.llm.registry import table
from chorale.session import settled


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxic_kernel.without_toxic(docs, table(spark, sf_dir, "labels"))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return grace_dedup.deduplicated(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return occurrence_join.representatives(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.decontaminated(docs, table(spark, sf_dir, "benchmark"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe_chunks.digests(bpe_chunks.encoded(docs), "ids")


STAGES = [
    ("toxicity", toxicity),
    ("exact dedup", exact_dedup),
    ("near dedup", near_dedup),
    ("decontamination", decontamination),
    ("tokens", tokens),
]
#: Toxicity and token ids can't be expressed in SQL; tests/llm compares the rows with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = settled(stage(spark, docs, sf_dir), "stage-" + name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
