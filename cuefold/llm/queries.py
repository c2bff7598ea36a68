"""The registered queries of this subpackage: each operator on its whole table, with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cuefold.llm import alignment, decontaminate, exact_dedup, line_dedup, mixing, quality, secret_scan, sharding, simhash, spelling, token_output, toxicity, warc
from cuefold.llm.common import OWN, table


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    own = {"copy": "copy", "copies": "copies", "order": "shuffle_key"}
    return mixing.mix(docs).select("doc_id", "source", *[F.col(f"{OWN}{k}").alias(v) for k, v in own.items()], F.octet_length("text").alias("text_bytes"))


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.secrets(table(spark, sf_dir, "documents"))


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archived(table(spark, sf_dir, "pages"))


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_duplicates(table(spark, sf_dir, "documents"))


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(table(spark, sf_dir, "documents"), 24)


def op10_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_output.encoded(table(spark, sf_dir, "documents"))


def op11_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.line_report(table(spark, sf_dir, "documents"))


def op12_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(table(spark, sf_dir, "documents"))


def op13_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.aligned(table(spark, sf_dir, "documents"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_simhash, op2_mixing, op3_decontamination, op4_quality, op5_toxicity, op6_secrets, op7_warc, op8_exact_dedup, op9_sharding,
        op10_token_output, op11_line_dedup, op12_spelling, op13_alignment,
    )
}
ORACLE_SQL = {
    "op2_mixing": mixing.ORACLE, "op7_warc": warc.ORACLE, "op8_exact_dedup": exact_dedup.ORACLE, "op11_line_dedup": line_dedup.ORACLE,
    "op12_spelling": spelling.ORACLE,
}
