"""Mixing sources to target weights.

Every document gets a hash-random key; within a source the documents stand in key order, and
prefix sums of their sizes tell which of them a source's budget takes. The order is split at fixed
bounds of the key into runs of about ``run_rows`` documents (the keys are uniform, so no sample is
needed), summed, and added up over runs: no window holds a whole source.

A null text has size 0; a null source is a source of its own, last in order. Rows that share doc_id,
size and source are alike and stand next to each other. A source without words has target 0. An
empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .store import materialize

WEIGHTS = (3, 1, 2)
_WORD = "[^\\x20\\x09-\\x0D]+"


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text.cast("string"), F.lit(_WORD)), F.lit(0)).cast("long")


def targets(totals: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = 1.5, most: float = 2.0) -> DataFrame:
    """source, source_size, n_docs, target from one row per source.

    The sources' shares follow the weights, repeated in order of source; a share stops at ``most``
    times its source's size and the excess goes to the others by weight, until none is above. That
    is one level for all sources that don't stop: sorted by size over weight, those below it stop.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    weighed = totals.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights))) + 1).cast("int")).cast("double"))
    every, up, before = Window.partitionBy(F.lit(0)), Window.orderBy(F.col("source_size") / F.col("weight"), F.col("source").asc_nulls_last()), Window.orderBy(F.col("source_size") / F.col("weight"), F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    cap = most * F.col("source_size")
    leveled = (
        weighed.withColumn("all", share * F.sum("source_size").over(every))
        .withColumn("stopped", F.coalesce(F.sum(cap).over(before), F.lit(0.0)))
        .withColumn("open", F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
        .withColumn("level", (F.col("all") - F.col("stopped")) / F.col("open"))
        .withColumn("stops", cap <= F.col("level") * F.col("weight"))
        .withColumn("first_open", F.min(F.when(~F.col("stops"), F.struct(F.row_number().over(up).alias("n"), "level"))).over(every)["level"])
    )
    return leveled.select("source", "source_size", "n_docs", F.when(F.col("stops") | F.col("first_open").isNull(), cap).otherwise(F.least(cap, F.col("first_open") * F.col("weight"))).alias("target"))


def mix(docs: DataFrame, seed: int = 17, run_rows: int = 20_000, **how) -> DataFrame:
    """doc_id, size, source, source_size, target, epochs (whole passes over the source), taken.

    ``taken`` is the size once per whole pass, and once more up to where the rest of the budget
    ends, so that a source's sum is its target rounded down."""
    sized = docs.select(F.col("doc_id").cast("long"), F.col("source").cast("string"), words(F.col("text")).alias("size"))
    sized = materialize(sized.withColumn("key", F.xxhash64("doc_id", "size", F.lit(seed))), "sized")
    totals = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_docs"))
    plan = targets(totals, **how).withColumn("budget", F.floor("target").cast("long"))
    plan = plan.withColumn("epochs", F.when(F.col("source_size") > 0, F.floor(F.col("budget") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")).withColumn("rest", F.col("budget") - F.col("epochs") * F.col("source_size"))
    # The plan has a row per source, far smaller than the documents; both joins can split a hot source.
    same = F.col("s.source").eqNullSafe(F.col("p.source"))
    runs = F.greatest(F.lit(1), F.ceil(F.col("n_docs") / run_rows))
    placed = sized.alias("s").join(plan.alias("p"), same).select("s.*", "source_size", "target", "epochs", "rest", F.floor((F.col("key") / (2.0**64) + 0.5) * runs).cast("long").alias("run"))
    sums = placed.groupBy("source", "run").agg(F.sum("size").alias("run_size"))
    starts = sums.withColumn("start", F.coalesce(F.sum("run_size").over(Window.partitionBy("source").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    inside = F.coalesce(F.sum("size").over(Window.partitionBy("source", "run").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    summed = placed.withColumn("inside", inside)
    cut = summed.alias("a").join(starts.alias("b"), F.col("a.source").eqNullSafe(F.col("b.source")) & (F.col("a.run") == F.col("b.run"))).select("a.*", "start")
    more = F.greatest(F.lit(0), F.least(F.col("size"), F.col("rest") - F.col("start") - F.col("inside")))
    return cut.select("doc_id", "size", "source", "source_size", "target", "epochs", more.cast("long").alias("part"), (F.col("epochs") * F.col("size") + more).cast("long").alias("taken"))


def materialised(docs: DataFrame, **how) -> DataFrame:
    """The mixture as rows of ``docs``: a document once per whole pass and once more where at least
    half of it lies within the rest of the budget; texts aren't cut."""
    times = F.max(F.col("epochs") + F.when((2 * F.col("part") >= F.col("size")) & (F.col("part") > 0), 1).otherwise(0)).cast("int")
    taken = mix(docs, **how).groupBy("doc_id").agg(times.alias("times"))
    wide = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.col("doc_id").cast("long").alias("id"))
    joined = wide.join(taken, F.col("id").eqNullSafe(F.col("doc_id"))).filter("times > 0")
    return joined.select("row", F.explode(F.array_repeat(F.lit(0), F.col("times")))).select("row.*")
