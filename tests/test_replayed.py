"""A replayed table is one batch, however many files it has, and no file holds all of it."""

from pyspark.sql import functions as F

from loambase.plans.files_and_streams import _replayed


def test_replayed(spark, tmp_path):
    seen = []
    parts = [spark.range(0, 1000, 1, 6), spark.range(1000, 1010, 1, 3)]

    def take(batch, number):
        seen.append((number, batch.count(), batch.select(F.input_file_name()).distinct().count()))

    _replayed(spark, parts, lambda stream: stream.writeStream.foreachBatch(take).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start())
    assert seen == [(0, 1000, 6), (1, 10, 3)]
