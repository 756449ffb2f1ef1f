"""From raw documents to packed windows, one written table per stage.

Each stage takes (spark, docs, sf_dir), works on all that its predecessor kept and
returns the columns of documents; the last returns packed pieces. docs is read
from Parquet, so a stage may read it more than once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evidra.llm import decontaminate, packing, pii, quality, simhash
from evidra.llm.common import documents, kept, remove


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier keeps."""
    return quality.good_documents(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates."""
    return simhash.without_duplicates(docs)


def unseen(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no item of the benchmark."""
    return decontaminate.without_items(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def masked(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data in their texts replaced; n_chars counts the new text."""
    out = pii.redact(docs)
    return out.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text")).cast(docs.schema["n_chars"].dataType))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token ids in windows of 2,048."""
    return packing.pack(docs)


STAGES = [("quality classifier", good), ("SimHash near-dedup", distinct), ("benchmark decontamination", unseen), ("PII", masked), ("packing", packed)]

#: No SQL: a fitted model, token ids and packing can't be expressed in it.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = documents(spark, sf_dir), None
    for _, stage in STAGES[:-1]:
        docs = kept(stage(spark, docs, sf_dir))
        if before is not None:
            remove(before)  # its successor is written
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
