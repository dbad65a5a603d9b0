"""Cost records: prices, reports, distributions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import scrub
from ..sources.scratch import materialize
from .ranks import values_at

#: Posted prices in USD per million tokens, in table order.
PRICES = [
    ("anthropic", "claude-haiku-4-5-20251001", 1.0, 5.0),
    ("anthropic", "claude-sonnet-4-6", 3.0, 15.0),
    ("kie", "claude-haiku-4-5-20251001", 0.28, 1.4),
    ("kie", "claude-sonnet-4-6", 0.84, 4.2),
]
HIGH_TIER = 0.9


def prices(spark: SparkSession, tier: str = "standard", overrides: list[tuple[str, str, float | None, float | None]] = ()) -> DataFrame:
    """The price table; the high tier lowers the second provider's, overrides come after it."""
    rows = []
    for n, (provider, model, put, out) in enumerate(PRICES):
        if tier == "high" and provider == "kie":
            put, out = put * HIGH_TIER, out * HIGH_TIER
        mine = [o for o in overrides if o[0] == provider]
        exact = [o for o in mine if o[1] == model] or [o for o in mine if o[1].startswith(model) or model.startswith(o[1])]
        if exact:
            put, out = (new if new is not None else old for new, old in zip(exact[0][2:], (put, out), strict=True))
        rows.append((n, provider, model, float(put), float(out)))
    return spark.createDataFrame(rows, "place int, p_provider string, p_model string, input_price double, output_price double")


def priced(records: DataFrame, table: DataFrame) -> DataFrame:
    """Adds usd. A model has the price of its name, or else of the first name that begins with it or
    that it begins with; an unknown one costs nothing. Only the distinct models meet the price table."""
    models = records.select("provider", "model").distinct()
    match = (F.col("provider") == F.col("p_provider")) & (F.col("p_model").startswith(F.col("model")) | F.col("model").startswith(F.col("p_model")))
    best = models.join(F.broadcast(table), match).groupBy("provider", "model").agg(F.min_by(F.struct("input_price", "output_price"), F.struct((F.col("p_model") != F.col("model")).alias("other"), "place")).alias("price"))
    usd = F.col("input_tokens") / 1e6 * F.col("price.input_price") + F.col("output_tokens") / 1e6 * F.col("price.output_price")
    return records.join(F.broadcast(best), ["provider", "model"], "left").withColumn("usd", F.coalesce(usd, F.lit(0.0))).drop("price")


def report(calls: DataFrame) -> DataFrame:
    """Per session, or stage where there is none: sums, calls, first project."""
    key = F.coalesce("session", "stage").alias("key")
    first = F.min_by("project", F.when(F.col("project").isNotNull(), F.struct("ts", "event_id")))
    return calls.groupBy(key).agg(F.sum("usd").alias("usd"), F.count("*").alias("calls"), F.sum("input_tokens").alias("input_tokens"), F.sum("output_tokens").alias("output_tokens"), first.alias("project"))


def distribution(sessions: DataFrame) -> DataFrame:
    """Total, sessions, exact median, nearest-rank p90."""
    held = materialize(sessions.select("usd", "calls"), "sessions")
    n = held.filter("usd is not null").count()
    # The two middle values and the one that nine in ten don't exceed.
    low, high, most = values_at(held, "usd", [(n - 1) // 2, n // 2, -(-9 * n // 10) - 1]) if n else (None,) * 3
    median = F.lit((low + high) / 2 if n else None).cast("double")
    return held.agg(F.round(F.sum("usd"), 6).alias("total"), F.count("*").alias("sessions"), F.sum("calls").alias("records"), F.round(median, 6).alias("median"), F.round(F.lit(most).cast("double"), 6).alias("p90"))


def within(records: DataFrame, now: str, seconds: float) -> DataFrame:
    """Records since ``seconds`` before ``now``; those without a time stay."""
    start = F.timestamp_add("SECOND", F.lit(-int(seconds)), F.lit(now).cast("timestamp"))
    return records.filter(F.col("ts").isNull() | (F.col("ts") >= start))


def latest(records: DataFrame, keys: list[str]) -> DataFrame:
    """The last record of each key."""
    return records.groupBy(*keys).agg(F.max_by(F.struct("event_id", "model", "input_tokens"), F.struct("ts", "event_id")).alias("r")).select(*keys, "r.*")


def top(sessions: DataFrame, n: int) -> DataFrame:
    return sessions.orderBy(F.desc("usd"), "key").limit(n)


def windows(records: DataFrame) -> DataFrame:
    """Tokens and calls per ISO week, stage and provider; also for streams with a watermark."""
    return records.groupBy(F.window("ts", "7 days", "7 days", "4 days").alias("w"), "stage", "provider").agg(F.count("*").alias("calls"), F.sum("input_tokens").alias("input_tokens")).select(F.date_format("w.start", "yyyy-MM-dd").alias("week"), "stage", "provider", "calls", "input_tokens")


def call(characters: Column, output_tokens: int, price: str = "price") -> Column:
    """USD of a call with so many characters of input, three to a token."""
    return F.ceil(characters / 3) / 1e6 * F.col(f"{price}.input_price") + output_tokens / 1e6 * F.col(f"{price}.output_price")


def estimated(sessions: DataFrame, table: DataFrame, classify: str, distil: str, provider: str) -> DataFrame:
    """sessions (raw_summary, transcript, ...) with usd: what classifying and distilling them would cost, secrets
    redacted first. Unknown models cost nothing."""
    both = table.filter(F.col("p_provider") == provider).agg(*(F.coalesce(F.first(F.when(F.col("p_model") == m, F.struct("input_price", "output_price")), True), F.struct(F.lit(0.0).alias("input_price"), F.lit(0.0).alias("output_price"))).alias(n) for m, n in ((classify, "one"), (distil, "two"))))
    usd = call(F.length(scrub(F.col("raw_summary"))), 350, "one") + call(F.length(scrub(F.col("transcript"))), 4500, "two")
    return sessions.join(F.broadcast(both)).withColumn("usd", usd).drop("one", "two")


def preview(sessions: DataFrame, table: DataFrame, classify: str, distil: str, provider: str) -> DataFrame:
    """sessions, filtered_out, usd: the cost of sessions not yet processed (passes, raw_summary, transcript). Those
    that don't pass the gate are counted apart and cost nothing."""
    each = estimated(sessions, table, classify, distil, provider)
    return each.agg(F.count_if("passes").alias("sessions"), F.count_if(~F.col("passes")).alias("filtered_out"), F.round(F.coalesce(F.sum(F.when(F.col("passes"), F.col("usd"))), F.lit(0.0)), 6).alias("usd"))


def collateral(targets: DataFrame, calls: DataFrame) -> DataFrame:
    """targets (session, ...) with ``paid``: whether a distilling call of the session has cost anything."""
    paid = calls.filter((F.col("stage") == "distill") & F.col("session").isNotNull() & (F.col("usd") > 0)).select("session", F.lit(True).alias("paid")).distinct()
    return targets.join(paid, "session", "left").withColumn("paid", F.coalesce("paid", F.lit(False)))
