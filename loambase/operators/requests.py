"""Requests to a model as columns: one text per row, to be answered by ``streaming.jobs.inferred``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import body, preview, scrub

#: How much of a text a request holds, in characters.
HEAD, LEAD, MOST = 400, 3000, 24_000


def _lines(*parts: str | Column) -> Column:
    return F.concat_ws("\n", *(F.lit(p) if isinstance(p, str) else p for p in parts))


def _labelled(label: str, value: Column, missing: str = "unknown") -> Column:
    return F.concat(F.lit(f"{label}: "), F.coalesce(value.cast("string"), F.lit(missing)))


def classify(summary: Column, project: Column) -> Column:
    return _lines("Classify this session. Answer as JSON: category (pattern, gotcha, decision or tool), topic, themes, project, confidence.", _labelled("Project", project), "", scrub(summary))


def distil(transcript: Column, project: Column, category: Column, started: Column) -> Column:
    return _lines("Write down what of this session others can use again, in markdown from '## Summary' on.", _labelled("Project", project), _labelled("Category", category), _labelled("Date", started), "", scrub(transcript))


def article(title: Column, url: Column, text: Column, lead_only: bool) -> Column:
    """To classify an article by its lead, or to distil it."""
    ask = "Classify this article. Answer as JSON: category (concept, technique, reference or opinion), confidence." if lead_only else "Distil this article in your own words, in markdown from '## Summary' on."
    return _lines(ask, _labelled("Title", title), F.when(url.isNotNull(), F.concat(F.lit("Source: "), url)), "", F.substring(scrub(text), 1, LEAD if lead_only else MOST))


def pdf(title: Column, text: Column) -> Column:
    return _lines("Distil this document in your own words, in markdown from '## Summary' on. Name its kind: paper, reference, notes or other.", _labelled("Title", title), "", F.substring(scrub(text), 1, MOST))


def _note(name: str, side: str, full: bool) -> Column:
    head = F.concat(F.lit(f"Note {name} (topic: "), f"{side}.topic", F.concat(F.lit(", date: "), F.coalesce(F.date_format(f"{side}.started_at", "yyyy-MM-dd"), F.lit("?")), F.lit(", confidence: "), F.format_string("%.2f", f"{side}.confidence")) if full else F.lit(""), F.lit("):"))
    return _lines(head, F.substring(f"{side}.content", 1, HEAD) if full else preview(F.col(f"{side}.content")))


def pairs(found: DataFrame, notes: DataFrame, duplicates: bool = True) -> DataFrame:
    """(a, b, request) for pairs (a, b) of notes (id, topic, started_at, confidence, content)."""
    ask = "Do these two notes teach the same? Answer as JSON: isDuplicate, confidence, reason, keepWhich (A, B or merge)." if duplicates else "Do these two notes contradict each other? Answer as JSON: contradicts, reason."
    joined = found.select("a", "b").join(notes.alias("x"), F.col("a") == F.col("x.id")).join(notes.alias("y"), F.col("b") == F.col("y.id"))
    return joined.select("a", "b", F.concat_ws("\n\n", F.lit(ask), _note("A", "x", duplicates), _note("B", "y", duplicates)).alias("request"))


def merge(found: DataFrame, notes: DataFrame) -> DataFrame:
    """(winner, loser, request) for pairs (winner, loser) whose bodies are to become one."""
    joined = found.select("winner", "loser").join(notes.alias("x"), F.col("winner") == F.col("x.id")).join(notes.alias("y"), F.col("loser") == F.col("y.id"))
    return joined.select("winner", "loser", F.concat_ws("\n\n", F.lit("Make one note of these two, with all that either has. Answer with its markdown body alone."), body(F.col("x.content")), body(F.col("y.content"))).alias("request"))


def compose(sources: DataFrame) -> DataFrame:
    """(query, request) from the sources of a topic (query, topic, rank, title, content)."""
    part = F.concat(F.lit("### "), "title", F.lit("\n"), F.trim(body(F.col("content"))))
    listed = F.array_sort(F.collect_list(F.struct("rank", part.alias("part"))))
    rows = sources.groupBy("query", "topic").agg(F.array_join(F.transform(listed, lambda p: p["part"]), "\n\n---\n\n").alias("parts"))
    return rows.select("query", _lines("Write a page on this topic from the notes below. Begin with 'TITLE: ' and 'CONFIDENCE: ' lines.", _labelled("Topic", F.col("topic")), "", F.col("parts")).alias("request"))
