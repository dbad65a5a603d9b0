"""Pages and reviews: gates, look-ups, decisions, changelogs, spliced blocks; bounded skill results."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import body, kebab, preview, set_frontmatter, token_estimate
from .notes import filled

CHANGELOG = "## Changelog"
SKILL_LIMIT = 1000


def usable_sources(rows: DataFrame) -> DataFrame:
    """Articles or documents that were distilled: not skipped, no error, with content."""
    return rows.filter(~F.coalesce("skipped", F.lit(False)) & ~filled("error") & filled("content"))


def recent_articles(rows: DataFrame, since: str | None = None, category: str | None = None, limit: int = 10) -> DataFrame:
    """The newest articles by date of publication, or else of distillation; rows without a date come last."""
    when = F.coalesce(F.expr("try_to_timestamp(coalesce(published, distilled_at))"), F.lit(0).cast("timestamp"))
    rows = usable_sources(rows).withColumn("at", when)
    rows = rows.filter(F.col("category") == category) if category else rows
    rows = rows.filter(F.col("at") >= F.lit(since).cast("timestamp")) if since else rows
    return rows.orderBy(F.desc("at"), "path").limit(min(max(limit, 1), 20)).select("title", "category", "url", "author", "published", "confidence", preview(F.col("content")).alias("summary"))


def look_up(requests: DataFrame, pages: DataFrame) -> DataFrame:
    """requests (name) with the page of their slug (slug, content): found, or a hint how to make it."""
    asked = requests.withColumn("slug", kebab(F.col("name")))
    joined = asked.join(pages.select("slug", "content"), "slug", "left")
    return joined.withColumn("hint", F.when(F.col("content").isNull(), F.concat(F.lit("not generated yet: "), "slug")))


def compose_sources(hits: DataFrame) -> DataFrame:
    """Search hits (query_id, rank, rel_path, title, content, score) that aren't topic pages, per query as one
    text for a request."""
    topic = (F.split("rel_path", "/")[0] == "topics") | F.col("content").rlike(r"^---\n(?:[^\n]*\n)*?type:\s*topic")
    line = F.concat(F.lit("### "), "title", F.lit(" ("), F.format_string("%.4f", "score"), F.lit(")\n\n"), F.trim(body(F.col("content"))))
    parts = F.array_sort(F.collect_list(F.struct("rank", line.alias("line"))))
    return hits.filter(~topic).groupBy("query_id").agg(F.count("*").alias("n"), F.array_join(F.transform(parts, lambda p: p["line"]), "\n\n---\n\n").alias("sources"))


def apply_reviews(notes: DataFrame, decisions: DataFrame, day: str) -> DataFrame:
    """notes (rel_path, content) under decisions (rel_path, decision): approved ones are marked verified,
    rejected ones are dated and move to ``.rejected/``; of several decisions on a note, reject counts."""
    last = decisions.groupBy("rel_path").agg(F.max("decision").alias("decision"))
    now, text = F.lit(day), F.col("content")
    joined = notes.join(last, "rel_path", "left")
    content = F.when(F.col("decision") == "approve", set_frontmatter(text, [("verified", F.lit("true")), ("reviewed_at", now)])).when(F.col("decision") == "reject", set_frontmatter(text, [("rejected_at", now)])).otherwise(text)
    where = F.when(F.col("decision") == "reject", F.concat(F.lit(".rejected/"), F.element_at(F.split("rel_path", "/"), -1))).otherwise(F.col("rel_path"))
    return joined.withColumn("content", content).withColumn("rel_path", where)


def changelog(page: Column) -> Column:
    """The entries under a page's changelog heading, newest first; none without the heading."""
    rest = F.when(F.instr(page, CHANGELOG) > 0, F.substring(page, F.instr(page, CHANGELOG) + F.lit(len(CHANGELOG)), F.length(page)))
    return F.filter(F.split(F.coalesce(rest, F.lit("")), "\n"), lambda x: F.trim(x) != "")


def with_changelog(fresh: DataFrame, pages: DataFrame) -> DataFrame:
    """fresh (slug, body, entry) as pages whose changelog has the new entry before those of the page kept so far."""
    old = pages.select("slug", changelog(F.col("content")).alias("old"))
    entries = F.concat(F.array("entry"), F.coalesce("old", F.array().cast("array<string>")))
    text = F.concat("body", F.lit(f"\n\n---\n{CHANGELOG}\n\n"), F.array_join(entries, "\n"), F.lit("\n"))
    return fresh.join(old, "slug", "left").select("slug", text.alias("content"))


def splice(text: Column, block: Column, start: str, end: str) -> Column:
    """``text`` with what stands from the first ``start`` to the first ``end`` replaced by ``block``; appended if
    one of them is missing."""
    head = F.substring(text, F.lit(1), F.instr(text, start) - 1)
    tail = F.substring(text, F.instr(text, end) + F.lit(len(end)), F.length(text))
    gap = F.when(text.endswith("\n"), "\n").otherwise("\n\n")
    return F.when((F.instr(text, start) > 0) & (F.instr(text, end) > 0), F.concat(head, block, tail)).otherwise(F.concat(text, gap, block, F.lit("\n")))


def bounded_skills(blocks: DataFrame) -> DataFrame:
    """Blocks (path, line, kind, tool, is_error, content) with a column ``loaded``: what stands for the long
    result that directly follows a skill's call; null for all others."""
    w = Window.partitionBy("path").orderBy("line")
    call = F.lag(F.when((F.col("kind") == "tool_use") & (F.col("tool") == "Skill"), F.coalesce("content", F.lit("")))).over(w)
    rows = blocks.withColumn("__call", call)
    name = F.coalesce(*(F.get_json_object("__call", f"$.{k}") for k in ("skill", "command", "name")), F.lit("skill"))
    long = F.col("__call").isNotNull() & (F.col("kind") == "tool_result") & ~F.col("is_error") & (F.length("content") > SKILL_LIMIT)
    return rows.withColumn("loaded", F.when(long, F.concat(F.lit("[tool_result: Skill] [Skill "), name, F.lit(" loaded]")))).drop("__call")


#: A skill's call with the result that directly follows it, in a rendered transcript; errors have another header.
SKILL_CALL, SKILL_HEAD, SKILL_END = "[tool_use: Skill] ", "\n\n[tool_result: Skill]\n", "\n[/tool_result]"
SKILL_PAIR = r"\[tool_use: Skill\] .+\n\n\[tool_result: Skill\]\n(?s:.*?)\n\[/tool_result\]"


def _held(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is worked out once, however often it is used."""
    return F.get(F.transform(F.array(value), use), 0)


def stripped_skills(text: Column) -> Column:
    """Struct of text and stripped: a rendered transcript whose skill results of over ``SKILL_LIMIT`` characters are replaced by
    the skill's name, and how many are. The text is taken apart at the pairs and put together again; it is searched twice, and
    a pair not at all: a call has no line ends, so the pair's first header ends it."""
    at = lambda m: F.instr(m, SKILL_HEAD)
    long = lambda m: F.length(m) - at(m) - (len(SKILL_HEAD + SKILL_END) - 1) > SKILL_LIMIT

    def named(m: Column) -> Column:
        call = F.substring(m, F.lit(len(SKILL_CALL) + 1), at(m) - len(SKILL_CALL) - 1)
        field = lambda v, k: F.when(F.schema_of_variant(F.try_variant_get(v, f"$.{k}", "variant")) == "STRING", F.try_variant_get(v, f"$.{k}", "string"))
        name = _held(F.try_parse_json(call), lambda v: F.coalesce(*(field(v, k) for k in ("skill", "command", "name")), F.lit("skill")))
        return F.concat(F.lit(SKILL_CALL), call, F.lit("\n\n[tool_result: Skill] [Skill "), name, F.lit(" loaded]"))

    def joined(found: Column) -> Column:
        whole = F.array_join(F.zip_with(F.split(text, SKILL_PAIR, -1), found, lambda a, m: F.concat(a, F.coalesce(F.when(long(m), named(m)).otherwise(m), F.lit("")))), "")
        return F.struct(whole.alias("text"), F.size(F.filter(found, long)).cast("long").alias("stripped"))

    return _held(F.regexp_extract_all(text, F.lit(SKILL_PAIR), F.lit(0)), joined)


def savings(before: Column, after: Column) -> Column:
    """Struct of the estimated tokens of a text before and after filtering, and those saved."""
    one, two = token_estimate(before), token_estimate(after)
    return F.struct(one.alias("original_tokens"), two.alias("filtered_tokens"), F.greatest(F.lit(0).cast("long"), one - two).alias("tokens_saved"))
