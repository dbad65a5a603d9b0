"""The queries of the training-data operators, and the SQL of those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, divergence, exact, lines, mixing, neardup, sharding, store, suffix, tokens, toxicity, vectors, warc, whitening


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_fuzzy_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.fuzzy_lines(_table(spark, sf_dir, "documents"))


def op2_warc_reassembly(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(_table(spark, sf_dir, "pages"))


def op3_token_rollups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.maintained(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"), store.scratch_path(spark, "tokens"))


def op4_toxic_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    scored = toxicity.score(docs, toxicity.train(docs, _table(spark, sf_dir, "labels")))
    return scored.select("doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), "score", "predicted", F.size("passages").cast("long").alias("n_passages"))


def op5_minhash_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(_table(spark, sf_dir, "documents"), words=2)


def op6_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix.without_repeats(_table(spark, sf_dir, "documents"))


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.matches(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op9_chunk_recipes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.exact_duplicates(_table(spark, sf_dir, "documents"))


def op10_uniform_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sharding.shard(_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op11_vector_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.near_vectors(_table(spark, sf_dir, "embeddings"))


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.divergence(_table(spark, sf_dir, "documents"))


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whitened(_table(spark, sf_dir, "embeddings"))


QUERIES = {f.__name__: f for f in (op1_fuzzy_lines, op2_warc_reassembly, op3_token_rollups, op4_toxic_segments, op5_minhash_neardup, op6_source_mixing, op7_suffix_dedup, op8_decontamination, op9_chunk_recipes, op10_uniform_shards, op11_vector_neardup, op12_source_divergence, op13_whitening)}

ORACLES = {
    "op12_source_divergence": divergence.ORACLE,
    "op9_chunk_recipes": """
        WITH n AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]+', '', 'g') AS norm, length(coalesce(text, '')) AS points FROM documents),
        r AS (SELECT *, row_number() OVER (PARTITION BY norm ORDER BY points DESC, doc_id) AS k, count(*) OVER (PARTITION BY norm) AS group_size FROM n)
        SELECT r.doc_id, b.doc_id AS keep_id, r.group_size, r.k = 1 AS kept, sha256(r.norm) AS text_sha256
        FROM r JOIN r b ON r.norm = b.norm AND b.k = 1""",
}
