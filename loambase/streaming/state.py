"""A keyed state table that streams keep up to date bucket by bucket.

``root/data/batch=n`` holds the buckets that batch n has changed, ``root/commits/batch=n`` which batch's folder holds each
bucket since then. A batch reads and writes the buckets of its keys alone, and counts once its commit is written; one
that runs again starts from the commit before it and writes the same once more.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def batches(spark: SparkSession, folder: str) -> list[int]:
    """Numbers of the finished ``batch=n`` folders, in order."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    store = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not store.exists(path):
        return []
    names = [x.getPath().getName() for x in store.listStatus(path)]
    done = [n for n in names if n.startswith("batch=") and store.exists(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{folder}/{n}/_SUCCESS"))]
    return sorted(int(n.removeprefix("batch=")) for n in done)


@dataclass(frozen=True)
class Buckets:
    """schema: of the rows, without the bucket; key: a column of it."""

    root: str
    schema: str
    key: str = "path"
    count: int = 256

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64(self.key), F.lit(self.count)).cast("int")

    def _placed(self, spark: SparkSession, before: int | None) -> dict[int, int]:
        """Which batch holds each bucket, after the last commit (of a batch under ``before``)."""
        done = [n for n in batches(spark, f"{self.root}/commits") if before is None or n < before]
        if not done:
            return {}
        return {r["bucket"]: r["batch"] for r in spark.read.schema("bucket int, batch long").parquet(f"{self.root}/commits/batch={done[-1]}").collect()}

    def _rows(self, spark: SparkSession, placed: dict[int, int]) -> DataFrame:
        if not placed:
            return spark.createDataFrame([], self.schema)
        paths = [f"{self.root}/data/batch={n}/bucket={b}" for b, n in sorted(placed.items())]
        return spark.read.schema(self.schema).parquet(*paths)

    def current(self, spark: SparkSession) -> DataFrame:
        """The state after the last commit."""
        return self._rows(spark, self._placed(spark, None))

    def apply(self, rows: DataFrame, number: int, change: Callable[[DataFrame, DataFrame], DataFrame]) -> None:
        """Batch ``number``: ``change(old, rows)`` gives the new rows of the buckets that ``rows`` touch, from the old
        ones of these buckets."""
        spark = rows.sparkSession
        placed = self._placed(spark, number)
        touched = sorted(r[0] for r in rows.select(self.bucket()).distinct().collect())
        if not touched:
            return
        old = self._rows(spark, {b: placed[b] for b in touched if b in placed})
        new = change(old, rows).withColumn("bucket", self.bucket())
        new.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.root}/data/batch={number}")
        # A bucket whose rows have all gone has no folder.
        there = {r[0] for r in spark.read.parquet(f"{self.root}/data/batch={number}").select("bucket").distinct().collect()}
        after = {b: n for b, n in placed.items() if b not in touched} | {b: number for b in there}
        spark.createDataFrame(sorted(after.items()), "bucket int, batch long").coalesce(1).write.mode("overwrite").parquet(f"{self.root}/commits/batch={number}")
