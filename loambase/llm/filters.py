"""A filter for keys: 64-bit words of flags, made and tested with SQL functions, sized by the number of keys.

It lets through every key it was made from and few others (one in sixteen or less up to 2^22 keys; with
more keys it lets through more, never less). Joins behind it are right at any size.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: At most so many words are broadcast: 16 MB.
MOST_WORDS = 1 << 20


@dataclass
class KeyFilter:
    rows: DataFrame
    words: int


def _bit(key: Column, words: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(64 * words))


def key_filter(keys: DataFrame, column: str) -> KeyFilter:
    """Counts ``keys`` (give a table, not a plan that is costly to run again)."""
    words = min(MOST_WORDS, 1 + keys.count() // 4)
    bit = keys.select(_bit(F.col(column), words).alias("__bit"))
    flag = F.expr("shiftleft(1L, cast(__bit % 64 as int))")
    return KeyFilter(bit.groupBy(F.floor(F.col("__bit") / 64).alias("__word")).agg(F.bit_or(flag).alias("__flags")), words)


def flagged(df: DataFrame, column: str, keys: KeyFilter, flag: str = "__maybe") -> DataFrame:
    """``df`` with a boolean: whether the filter lets the key through."""
    named = df.withColumn("__bit", _bit(F.col(column), keys.words)).withColumn("__word_of", F.floor(F.col("__bit") / 64))
    joined = named.join(F.broadcast(keys.rows), F.col("__word_of") == F.col("__word"), "left")
    there = F.expr("coalesce(shiftrightunsigned(__flags, cast(__bit % 64 as int)) % 2 <> 0, false)")
    return joined.withColumn(flag, there).drop("__bit", "__word_of", "__word", "__flags")


def passing(df: DataFrame, column: str, keys: KeyFilter) -> DataFrame:
    return flagged(df, column, keys).filter("__maybe").drop("__maybe")
