"""ISO weeks, months and what falls into them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import kebab
from .notes import category_counts, distilled

UNITS = {"s": 1, "m": 60, "h": 3600, "d": 86400, "w": 604800}


def parse_duration(text: str) -> float:
    """Seconds of '7d', '24h', '1.5w' or a bare number of days."""
    import re

    m = re.fullmatch(r"\s*(\d+(?:\.\d+)?)\s*([smhdw]?)\s*", text)
    if not m:
        raise ValueError(f"not a duration: {text!r}")
    return float(m[1]) * UNITS[m[2] or "d"]


def week_slug(ts: Column) -> Column:
    return F.format_string("week-%d-W%02d", F.extract(F.lit("YEAROFWEEK"), ts).cast("int"), F.weekofyear(ts))


def month_slug(ts: Column) -> Column:
    return F.date_format(ts, "'month-'yyyy-MM")


def period_range(now: str, unit: str = "WEEK", offset: int = 0) -> tuple[Column, Column]:
    """Start and end (not included) of the period ``offset`` before that of ``now``, as timestamps."""
    start = F.timestamp_add(unit, F.lit(-offset), F.date_trunc(unit, F.lit(now).cast("timestamp")))
    return start, F.timestamp_add(unit, F.lit(1), start)


def period_label(start: Column, unit: str = "WEEK") -> Column:
    """A period's name with its first and last day, from its start."""
    last = F.date_sub(F.to_date(F.timestamp_add(unit, F.lit(1), start)), 1)
    name = F.regexp_replace(week_slug(start) if unit == "WEEK" else month_slug(start), "^(week|month)-", "")
    return F.concat(name, F.lit(" ("), F.date_format(start, "yyyy-MM-dd"), F.lit(" to "), F.date_format(last, "yyyy-MM-dd"), F.lit(")"))


def in_period(notes: DataFrame, start: str, end: str) -> DataFrame:
    """start <= started_at < end; missing dates drop."""
    return notes.filter((F.col("started_at") >= F.lit(start).cast("timestamp")) & (F.col("started_at") < F.lit(end).cast("timestamp")))


def rollup(notes: DataFrame, unit: str = "WEEK") -> DataFrame:
    start = F.date_trunc(unit, "started_at")
    slug = week_slug(F.col("started_at")) if unit == "WEEK" else month_slug(F.col("started_at"))
    return distilled(notes).filter("started_at is not null").groupBy(slug.alias("period"), F.date_format(start, "yyyy-MM-dd").alias("start")).agg(F.count("*").alias("n"), *category_counts())


def summary_request(notes: DataFrame) -> DataFrame:
    """One request text per project: its notes by category, a line each."""
    line = F.concat(F.lit("- "), "topic", F.lit(": "), F.substring("content", 1, 200))
    rows = distilled(notes).withColumn("slug", kebab(F.col("project"))).filter("slug <> ''")
    by = rows.groupBy("slug", "category").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("path", line.alias("line")))), lambda x: x["line"]), "\n").alias("lines"))
    wide = by.groupBy("slug").pivot("category", ["pattern", "gotcha", "decision", "tool"]).agg(F.first("lines"))
    part = lambda c: F.concat(F.lit(f"{c}s:\n"), F.coalesce(c, F.lit("(none)")))
    return wide.select("slug", F.concat_ws("\n\n", *(part(c) for c in ("pattern", "gotcha", "decision", "tool"))).alias("request"))


def triggers(notes: DataFrame, least: int = 3) -> DataFrame:
    return distilled(notes).groupBy(kebab(F.col("project")).alias("slug")).agg(F.count("*").alias("n"), F.min_by("project", "path").alias("name")).filter((F.col("n") >= least) & (F.col("slug") != ""))
