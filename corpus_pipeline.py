"""From raw documents to packed training sequences: five stages, each written as Parquet and read by the next."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.llm.bitmap import without
from ledgerloom.llm.common import releasing, removed, shared_dir, stored, table
from ledgerloom.llm.decontamination import without_contaminated
from ledgerloom.llm.near_duplicates import near_duplicates
from ledgerloom.llm.packing import best_fit_packing
from ledgerloom.llm.pii import without_personal_data
from ledgerloom.llm.toxicity import without_toxic

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity operator doesn't reject."""
    return without_toxic(docs.select(*COLUMNS), table(spark, sf_dir, "labels"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates (five words, 0.8) the document of the smallest doc_id; of rows that share this
    doc_id the least one. Rows without doc_id stay."""
    docs = docs.select(*COLUMNS)
    found = stored(near_duplicates(docs).where(F.col("doc_id").isNotNull()).select("doc_id", "kept"), "decisions")
    left = without(docs, found.where(~F.col("kept")), "doc_id")
    repeated = stored(found.where("kept").groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select("doc_id"), "repeated")
    if not repeated.limit(1).count():
        return left
    others = without(left, repeated, "doc_id")
    same = left.join(repeated, "doc_id", "left_semi").select(F.struct(*COLUMNS).alias("row"))
    return others.unionByName(same.groupBy("row.doc_id").agg(F.min("row").alias("row")).select("row.*"))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain no benchmark item (five words, 0.8)."""
    return without_contaminated(docs.select(*COLUMNS), table(spark, sf_dir, "benchmark"))


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data masked by its kind."""
    return without_personal_data(docs.select(*COLUMNS))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of at most 4096 tokens."""
    return best_fit_packing(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("minhash_near_dedup", drop_near_duplicates),
    ("benchmark_decontamination", drop_contaminated),
    ("pii", mask_personal_data),
    ("best_fit_packing", pack_sequences),
]

#: A trained classifier, a trained field and a tokenizer can't be put into SQL; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows. A stage's own tables, and what the stage before it wrote, go once its output is written."""
    docs, before = table(spark, sf_dir, "documents"), None
    place = f"{shared_dir(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    for k, (name, stage) in enumerate(STAGES):
        out = f"{place}/{k}-{name}"
        with releasing(spark):
            stage(spark, docs, sf_dir).write.parquet(out)
        if before is not None:
            removed(spark, before)
        docs, before = spark.read.parquet(out), out
    return docs
