"""Structured Streaming jobs, and stages that call a function given by the user in batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.state import unprocessed, upsert
from .state import Buckets, batches


def weekly_cost(records: DataFrame, late: str = "2 days") -> DataFrame:
    """Cost by ISO week, stage and provider. On a stream, a week is given out once the watermark has passed
    its end, and later rows are dropped; on a table every week is given out."""
    week = F.window("ts", "7 days", "7 days", "4 days")
    sums = records.withWatermark("ts", late).groupBy(week.alias("week"), "stage", "provider").agg(F.count("*").alias("calls"), F.sum("input_tokens").alias("input_tokens"), F.sum("output_tokens").alias("output_tokens"))
    return sums.select(F.col("week.start").alias("week_start"), "stage", "provider", "calls", "input_tokens", "output_tokens")


def once_each(deliveries: DataFrame, late: str = "2 days") -> DataFrame:
    """Deliveries (path, hash, ts) without those that repeat within the watermark."""
    return deliveries.withWatermark("ts", late).dropDuplicatesWithinWatermark(["path", "hash"])


def isolated(rows: DataFrame, call: Callable[[pd.Series], list], column: str, result: str, kind: str) -> DataFrame:
    """``rows`` with ``result`` (of type ``kind``) and ``error``. A batch that fails is tried row by row, so
    that one bad row costs only itself. Null or blank input is skipped: no result, no error."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out, error = pd.Series([None] * len(batch), dtype=object), pd.Series([None] * len(batch), dtype=object)
            asked = [i for i, v in enumerate(batch[column]) if isinstance(v, str) and v.strip()]
            try:
                for i, value in zip(asked, call(batch[column].iloc[asked]), strict=True):
                    out[i] = value
            except Exception:
                for i in asked:
                    try:
                        out[i] = call(batch[column].iloc[[i]])[0]
                    except Exception as e:
                        error[i] = f"{type(e).__name__}: {e}"
            yield batch.assign(**{result: out.to_numpy(), "error": error.to_numpy()})

    kept = rows.drop(result, "error")
    return kept.mapInPandas(run, f"{kept.schema.toDDL()}, `{result}` {kind}, error string" if kept.columns else f"`{result}` {kind}, error string")


def embedded(backlog: DataFrame, embed: Callable[[pd.Series], list], column: str = "content") -> DataFrame:
    """Backlog rows with their vector, or the error that kept them from it."""
    return isolated(backlog, embed, column, "embedding", "array<double>")


def inferred(requests: DataFrame, answer: Callable[[pd.Series], list], column: str = "prompt") -> DataFrame:
    """Request rows with the model's reply, or the error."""
    return isolated(requests, answer, column, "reply", "string")


def recorded(answered: DataFrame, stage: str, model: str, provider: str, column: str = "prompt") -> DataFrame:
    """Answered requests with a ``cost`` record (stage, model, provider, tokens estimated from the texts); null for
    those that failed."""
    tokens = lambda c: F.ceil(F.length(c) / 4).cast("long")
    record = F.struct(F.lit(stage).alias("stage"), F.lit(model).alias("model"), F.lit(provider).alias("provider"), tokens(column).alias("input_tokens"), tokens("reply").alias("output_tokens"), F.lit("estimated").alias("token_source"))
    return answered.withColumn("cost", F.when(F.col("reply").isNotNull() & F.col("error").isNull(), record))


def keep_sessions(files: DataFrame, distil: Callable[[DataFrame], DataFrame], schema: str, root: str, checkpoint: str, buckets: int = 256) -> StreamingQuery:
    """New files (path, hash, ...) of a stream are distilled and put into the state by path (see ``state.Buckets``; of several
    rows for a path within a batch the greatest hash counts). Only the buckets of a batch's paths are read and written. Files
    whose path and hash are known are left out."""
    state = Buckets(root, schema, count=buckets)

    def put(old: DataFrame, batch: DataFrame) -> DataFrame:
        rest = [c for c in batch.columns if c != "path"]
        fresh = unprocessed(batch.groupBy("path").agg(F.max_by(F.struct(*rest), F.col("hash")).alias("r")).select("path", "r.*"), old)
        return upsert(old, distil(fresh).select(*old.columns), "path")

    return files.writeStream.foreachBatch(lambda batch, number: state.apply(batch, number, put)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def heal_backlog(rows: DataFrame, embed: Callable[[pd.Series], list], root: str, checkpoint: str) -> StreamingQuery:
    """Each batch's rows (path, content) without a vector get one; rows that fail keep their error and are tried
    again with every later batch until they succeed or a newer row takes their place. ``root/batch=n`` holds what a batch
    has tried, ``root/open/batch=n`` the failures that are open after it, which is all that later batches read. A batch
    that is run again replaces its own."""

    def step(batch: DataFrame, number: int) -> None:
        spark, todo = batch.sparkSession, batch.filter("embedding is null and trim(content) <> ''").select("path", "content")
        past = [n for n in batches(spark, f"{root}/open") if n < number]
        if past:
            last = spark.read.schema("path string, content string").parquet(f"{root}/open/batch={past[-1]}")
            todo = todo.unionByName(last.join(batch.select("path"), "path", "left_anti"))
        embedded(todo, embed).select("path", "content", "embedding", "error").write.mode("overwrite").parquet(f"{root}/batch={number}")
        tried = spark.read.schema("path string, content string, error string").parquet(f"{root}/batch={number}")
        tried.filter("error is not null").select("path", "content").write.mode("overwrite").parquet(f"{root}/open/batch={number}")

    return rows.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
