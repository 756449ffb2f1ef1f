"""The queries of the dealt operators, each over whole tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, packing, pii, quality, quality_rules, sharding, simhash, spelling, sql, sstable, substrings, token_counts, url_filter, whitening
from .common import documents


def op1_shard_minimax(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(documents(spark, sf_dir), shards=24)


def op2_sstable_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = sstable.write_shards(documents(spark, sf_dir), end_id=2)
    return sstable.read_shards(manifest).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op3_quality_bayes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op4_decontaminate_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.search(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op5_line_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge(documents(spark, sf_dir))


def op6_token_attribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.attribute(documents(spark, sf_dir), field_cols=("lang", "source"), rule="most")


def op7_simhash_golay(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(documents(spark, sf_dir))


def op8_pack_differencing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack(documents(spark, sf_dir), end_id=1)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op9_pii_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(pii.find(documents(spark, sf_dir)))


def op10_url_markov(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def op11_passages_automata(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.without_passages(documents(spark, sf_dir), digest=True).select("doc_id", "n_words", "n_removed", "kept_sha256")


def op12_whiten_triangle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op13_spelling_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(documents(spark, sf_dir))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_shard_minimax, op2_sstable_tokens, op3_quality_bayes, op4_decontaminate_minhash, op5_line_frequency, op6_token_attribution, op7_simhash_golay, op8_pack_differencing, op9_pii_spans, op10_url_markov, op11_passages_automata, op12_whiten_triangle, op13_spelling_trie)}


def oracle_sql() -> dict[str, str]:
    """Only what SQL can express: no CRC-32, token ids, XXH64, fitted models, eigenvectors or match positions there."""
    return {"op4_decontaminate_minhash": sql.DECONTAMINATE, "op5_line_frequency": sql.LINES, "op10_url_markov": sql.URLS, "op11_passages_automata": sql.PASSAGES}
