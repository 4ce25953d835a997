"""All registered queries and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import evidence_queries, payload_queries, record_queries, source_queries, stream_queries, wire_queries  # noqa: F401
from .registry import QUERIES, SQL


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return QUERIES["gates_block"](spark, sf_dir)


__all__ = ["QUERIES", "SQL", "flagship"]
