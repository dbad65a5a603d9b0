"""Amounts are rounded by their exact binary value, as the SQL's printf does."""

from pyspark.sql import functions as F

from loambase.functions import text as T


def test_fixed(spark):
    values = [0.4735, 0.0625, 0.1875, 1.125, 2.375, 0.03125, 0.00625, 0.0005, 1234567.125, 0.9995, 0.99951, 0.0, 1.0] + [round(i * 0.0005, 6) for i in range(1, 2000)] + [round(i * 0.005, 6) for i in range(1, 4000)]
    values += [i / 10000 + 0.00005 for i in range(200)]
    rows = spark.createDataFrame([(v,) for v in values], "v double").select("v", *(T.fixed(F.col("v"), d).alias(f"d{d}") for d in (2, 3, 4))).collect()
    assert [(r.v, r.d2, r.d3, r.d4) for r in rows] == [(v, f"{v:.2f}", f"{v:.3f}", f"{v:.4f}") for v in values]


def test_usd(spark):
    values = [-1.0, 0.0, 0.00625, 0.4735, 0.0625, 1.125, None]
    rows = spark.createDataFrame([(v,) for v in values], "v double").select(T.usd(F.col("v")).alias("label")).collect()
    assert [r.label for r in rows] == ["$0", "$0", "$0.0063", "$0.473", "$0.062", "$1.12", None]
