"""The registered queries of the operators: thin, over whole tables, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import decontamination, near_duplicates as near, quality, secrets as secret_scans
from .common import table
from .html_text import extract
from .near_duplicates import near_duplicates
from .packing import best_fit_packing
from .pii import personal_data
from .secrets import secrets
from .sharding import shard
from .token_output import token_output
from .toxicity import toxicity

Query = Callable[[SparkSession, str], DataFrame]


def op1_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets(table(spark, sf_dir, "documents"))


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return best_fit_packing(table(spark, sf_dir, "documents"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal_data(table(spark, sf_dir, "documents"))


def op5_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.contained_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op6_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(table(spark, sf_dir, "documents")).drop("failed_rule")


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard(table(spark, sf_dir, "documents"))


def op9_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), width=2).drop("row_no")


def op10_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_output(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (
        op1_secret_scans,
        op2_best_fit_packing,
        op3_toxicity,
        op4_pii,
        op5_benchmark_decontamination,
        op6_html_extraction,
        op7_quality_rules,
        op8_sharding,
        op9_minhash_near_dedup,
        op10_token_output,
    )
}
SQL: dict[str, str] = {
    "op1_secret_scans": secret_scans.SQL,
    "op5_benchmark_decontamination": decontamination.SQL,
    "op7_quality_rules": quality.SQL,
    "op9_minhash_near_dedup": near.SQL,
}
