"""Keyed state tables: incremental reading and upserts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def unprocessed(sources: DataFrame, state: DataFrame, full: bool = False) -> DataFrame:
    """Sources whose (path, hash) isn't in the state; all of them on a full run."""
    return sources if full else sources.join(state.select("path", "hash").distinct(), ["path", "hash"], "left_anti")


def upsert(old: DataFrame, new: DataFrame, key: str, coalesced: list[str] = (), kept: list[str] = (), order: str | None = None) -> DataFrame:
    """``old`` with the rows of ``new`` put in by key. Columns of ``coalesced`` keep the old value where the
    new one is null, those of ``kept`` where there was one; all others are overwritten. Of several new
    rows for a key the last by ``order`` counts. Columns that ``new`` lacks are left alone."""
    columns = [c for c in new.columns if c not in (key, order)]
    if order:
        new = new.groupBy(key).agg(F.max_by(F.struct(*columns), F.col(order)).alias("r")).select(key, "r.*")
    fresh = new.select(F.col(key).alias("__key"), *(F.col(c).alias(f"__{c}") for c in columns))
    joined = old.join(fresh, F.col(key) == F.col("__key"), "full_outer")
    there = F.col("__key").isNotNull()

    def value(c: str):
        if c == key:
            return F.coalesce(F.col(key), F.col("__key")).alias(c)
        if c not in columns:
            return F.col(c)
        if c in coalesced:
            return F.coalesce(F.col(f"__{c}"), F.col(c)).alias(c)
        if c in kept:
            return F.coalesce(F.col(c), F.col(f"__{c}")).alias(c)
        return F.when(there, F.col(f"__{c}")).otherwise(F.col(c)).alias(c)

    return joined.select(*map(value, old.columns))


#: Columns of each layer that keep the old value where a new row has none.
KEPT_IF_NULL = {"sessions": ["category", "topic", "project", "content"], "articles": ["category", "content", "note_path"], "pdfs": ["category", "content", "note_path"]}


def put(layer: str, old: DataFrame, new: DataFrame, order: str | None = None) -> DataFrame:
    """``upsert`` by path under the layer's rule."""
    return upsert(old, new, "path", coalesced=KEPT_IF_NULL[layer], order=order)


def store_vectors(rows: DataFrame, vectors: DataFrame, key: str) -> DataFrame:
    """``rows`` (key, embedding, ...) with the vectors (key, embedding) put in; of several for a key the largest
    counts, one without a row is left out. Null vectors change nothing."""
    new = vectors.filter("embedding is not null").groupBy(F.col(key).alias("__key")).agg(F.max("embedding").alias("__new"))
    return rows.join(new, F.col(key) == F.col("__key"), "left").withColumn("embedding", F.coalesce("__new", "embedding")).drop("__key", "__new")


def publish(df: DataFrame, root: str, version: str, buckets: int = 16, key: str = "path") -> str:
    """Write a new version of a state table beside the old ones, split by a hash of the key."""
    path = f"{root}/version={version}"
    df.withColumn("bucket", F.pmod(F.xxhash64(key), F.lit(buckets))).write.mode("overwrite").partitionBy("bucket").parquet(path)
    return path
