"""A training-text pipeline over `documents`; part of subpackage llm.

Stages: documents scored toxic go; one document of each near-duplicate group stays; documents that hold a benchmark item go; sources are
mixed to target weights; what is left becomes token-id files, read back as one row for each document.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from cuefold.llm import decontaminate, mixing, similar, token_output, toxicity
from cuefold.llm.common import drop_staged, staged, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.accepted(docs, table(spark, sf_dir, "labels"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return similar.keep_one(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.clean_documents(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed_documents(docs)


def write_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return token_output.encoded(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("mixing", mix_sources),
    ("token_output", write_tokens),
]

#: The classifier, the fingerprints and the tokenizer have no SQL form; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`: each one's rows are written as Parquet in the shared folder and read again as the next one's."""
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), name)
        if before is not None:
            drop_staged(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
