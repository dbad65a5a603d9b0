"""Gates, scores, statistics and windows over notes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.replies import strip_related
from ..functions.text import kebab, note_slug, preview

CATEGORIES = ["pattern", "gotcha", "decision", "tool"]
#: Fixed value: words that mark a session worth keeping.
SIGNAL = r"(?i)\b(error|fixed|bug|learned|gotcha|workaround|fixed it|root cause)\b"


def filled(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit("")) != ""


def distilled(notes: DataFrame) -> DataFrame:
    gate = ~F.col("skipped") & ~filled("error") & filled("content") & filled("category") & filled("topic") & ~F.coalesce("archived", F.lit(False))
    return notes.filter(gate).withColumn("project", F.coalesce("project", F.lit(""))).withColumn("confidence", F.coalesce("confidence", F.lit(0.0)))


def usable(notes: DataFrame) -> DataFrame:
    """Rows neither skipped nor failed, with content: the weaker gate of articles, PDFs and statistics."""
    return notes.filter(~F.col("skipped") & ~filled("error") & filled("content"))


def backlog(layers: dict[str, DataFrame]) -> DataFrame:
    """Rows of each layer that still need a vector: (layer, id). Sessions also need topic and category
    and must not be archived; articles and PDFs need a note."""
    parts = []
    for layer, rows in layers.items():
        todo = rows.filter(filled("content") & ~F.coalesce("embedded", F.lit(False)))
        if layer != "topics":
            todo = todo.filter(~F.col("skipped") & ~filled("error"))
        if layer == "sessions":
            todo = todo.filter(filled("topic") & filled("category") & ~F.coalesce("archived", F.lit(False)))
        elif layer in ("articles", "pdfs"):
            todo = todo.filter(filled("note_path"))
        parts.append(todo.select(F.lit(layer).alias("layer"), F.col("id").cast("string")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def reconcile_targets(notes: DataFrame) -> DataFrame:
    return notes.filter(~F.col("skipped") & ~filled("content"))


def signal_score(sessions: DataFrame, threshold: float = 0.4) -> DataFrame:
    """Adds score (two decimals), passes (by the unrounded score) and reasons."""
    parts = [
        (F.col("line_count") > 50, 0.3, "lineCount>50 (+0.3)"),
        (F.col("tool_calls") > 5, 0.3, "toolCalls>5 (+0.3)"),
        (F.size("files") > 2, 0.2, "files>2 (+0.2)"),
        (F.col("assistant_text").rlike(SIGNAL) | F.col("user_text").rlike(SIGNAL), 0.2, "signal-word (+0.2)"),
    ]
    score = F.lit(0.0)
    for test, worth, _ in parts:
        score = score + F.when(test, worth).otherwise(0.0)
    reasons = F.array_compact(F.array(*(F.when(test, F.lit(why)) for test, _, why in parts)))
    return sessions.withColumns({"score": F.floor(score * 100 + 0.5) / 100, "passes": score >= threshold, "reasons": reasons})


def category_counts() -> list[Column]:
    return [F.count_if(F.col("category") == c).alias(f"{c}s") for c in CATEGORIES]


def knowledge_stats(notes: DataFrame) -> DataFrame:
    c = F.coalesce("confidence", F.lit(0.0))
    return usable(notes).agg(F.count("*").alias("total"), F.round(F.avg(c), 6).alias("avg_confidence"), F.count_if(c >= 0.8).alias("high"), F.count_if(c < 0.5).alias("low"), *category_counts(), F.date_format(F.min("started_at"), "yyyy-MM-dd").alias("oldest"), F.date_format(F.max("started_at"), "yyyy-MM-dd").alias("newest"))


def project_stats(notes: DataFrame) -> DataFrame:
    return usable(notes).groupBy(F.coalesce("project", F.lit("unknown")).alias("project")).agg(F.count("*").alias("total"), *category_counts(), F.round(F.avg(F.coalesce("confidence", F.lit(0.0))), 6).alias("avg_confidence"), F.date_format(F.max("started_at"), "yyyy-MM-dd").alias("last_seen"))


def knowledge_gaps(stats: DataFrame) -> DataFrame:
    """A row per project and gap: no gotchas, no decisions, mean confidence (two decimals) under 0.65."""
    mean = F.floor(F.col("avg_confidence") * 100 + 0.5) / 100
    gaps = F.array_compact(F.array(F.when(F.col("gotchas") == 0, F.lit("no gotchas")), F.when(F.col("decisions") == 0, F.lit("no decisions")), F.when(mean < 0.65, F.lit("low confidence"))))
    return stats.select("project", "total", F.explode(gaps).alias("gap"))


def category_share(notes: DataFrame) -> DataFrame:
    counts = usable(notes).filter(F.col("category").isin(CATEGORIES)).groupBy("category").agg(F.count("*").alias("n"))
    every = Window.partitionBy(F.lit(0))
    return counts.select("category", "n", F.floor(100 * F.col("n") / F.sum("n").over(every) + 0.5).cast("long").alias("percent"), F.floor(16 * F.col("n") / F.max("n").over(every) + 0.5).cast("long").alias("bar"))


def processing_stats(notes: DataFrame) -> DataFrame:
    return notes.agg(F.count("*").alias("total"), F.count_if("skipped").alias("skipped"), F.count_if(filled("error")).alias("errored"), F.date_format(F.max("started_at"), "yyyy-MM-dd").alias("last")).withColumn("distilled", F.col("total") - F.col("skipped") - F.col("errored"))


def top_per_category(notes: DataFrame, n: int = 5) -> DataFrame:
    """The most confident notes of each category, in all and per project; ties by path. The row number
    is cut before the shuffle by Spark's window group limit."""
    rows = distilled(notes).select("project", "category", "topic", "confidence", "path")
    scoped = rows.withColumn("scope", F.lit("")).unionByName(rows.withColumn("scope", F.col("project")))
    rank = F.row_number().over(Window.partitionBy("scope", "category").orderBy(F.desc("confidence"), "path"))
    return scoped.withColumn("rank", rank).filter(F.col("rank") <= n).withColumn("slug", F.concat("category", F.lit("/"), kebab(F.col("topic"))))


def knowledge_block(top: DataFrame) -> DataFrame:
    """One text per scope: categories in order, an entry per line."""
    order = F.array_position(F.array(*map(F.lit, CATEGORIES)), F.col("category"))
    line = F.concat(F.lit("- "), "slug", F.lit(" (conf "), F.format_string("%.2f", "confidence"), F.lit(") — "), "topic")
    head = F.when(F.col("rank") == 1, F.concat(F.lit("### "), F.initcap("category"), F.lit("s\n"))).otherwise("")
    lines = F.array_sort(F.collect_list(F.struct(order.alias("o"), "rank", F.concat(head, line).alias("line"))))
    return top.groupBy("scope").agg(F.array_join(F.transform(lines, lambda x: x["line"]), "\n").alias("block"))


def block_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """(scope, slug, status) between two sets of entries; of equal slugs the one listed last counts."""
    def last(df: DataFrame, name: str) -> DataFrame:
        return df.groupBy("scope", "slug").agg(F.max_by("confidence", F.col("rank")).alias(name))

    joined = last(old, "was").join(last(new, "now"), ["scope", "slug"], "full_outer")
    status = F.when(F.col("was").isNull(), "added").when(F.col("now").isNull(), "removed").when(F.abs(F.round(F.col("was"), 2) - F.col("now")) > 0.05, "upgraded").otherwise("unchanged")
    return joined.select("scope", "slug", status.alias("status"))


def recent(notes: DataFrame, now: str, since_days: int | None, category: str | None = None, verified: bool = False, limit: int = 20, project: str | None = None) -> DataFrame:
    """The newest notes that pass the filters, 1 to 20 of them; undated ones pass without ``since_days`` only, and
    come last."""
    rows = distilled(notes)
    for test in (
        F.col("started_at") >= F.timestamp_add("DAY", F.lit(-since_days), F.lit(now).cast("timestamp")) if since_days is not None else None,
        F.col("category") == category if category else None,
        kebab(F.col("project")) == kebab(F.lit(project)) if project else None,
        F.col("verified") if verified else None,
    ):
        rows = rows if test is None else rows.filter(test)
    return rows.orderBy(F.desc_nulls_last("started_at"), "path").limit(min(max(limit, 1), 20)).select("path", "category", F.date_format("started_at", "yyyy-MM-dd").alias("date"), preview(F.col("content")).alias("summary"))


def review_queue(notes: DataFrame, everything: bool = False, project: str | None = None, limit: int = 50) -> DataFrame:
    rows = distilled(notes) if everything else distilled(notes).filter("not verified")
    rows = rows.filter(kebab(F.col("project")) == project) if project else rows
    return rows.withColumn("date", F.date_format("started_at", "yyyy-MM-dd")).orderBy(F.desc("date"), "path").limit(limit).select("path", "project", "category", "date", "confidence")


def index_table(notes: DataFrame, articles: DataFrame) -> DataFrame:
    one = distilled(notes).select(F.lit("session").alias("kind"), "path", "topic", F.date_format("started_at", "yyyy-MM-dd").alias("date"))
    two = articles.select(F.lit("article").alias("kind"), "path", F.col("title").alias("topic"), F.col("date"))
    rows = one.unionByName(two)
    return rows.select("kind", "path", "date", F.concat(F.lit("| "), "date", F.lit(" | "), "kind", F.lit(" | "), "topic", F.lit(" |")).alias("row")).orderBy(F.desc("date"), "path")


def index_page(notes: DataFrame, articles: DataFrame, topics: DataFrame) -> DataFrame:
    """(kind, rel_path, date, row): the index's rows for session notes, articles (title, author, category, note_path, published,
    distilled_at) that have a note, and topic pages (id, title, updated_at, created_at), newest first. The place of a
    session's note follows from its topic and id."""
    day = lambda *c: F.substring(F.coalesce(*(F.col(x).cast("string") for x in c), F.lit("")), 1, 10)
    one = distilled(notes).select(F.lit("session").alias("kind"), note_path(F.col("topic"), F.col("session_id"), F.col("category")).alias("rel_path"), day("started_at").alias("date"), "topic", "category", "project")
    two = articles.filter(filled("note_path")).select(F.lit("article").alias("kind"), F.col("note_path").alias("rel_path"), day("published", "distilled_at").alias("date"), F.col("title").alias("topic"), "category", F.coalesce("author", F.lit("web")).alias("project"))
    three = topics.select(F.lit("topic").alias("kind"), F.concat(F.lit("topics/"), "id", F.lit(".md")).alias("rel_path"), day("updated_at", "created_at").alias("date"), F.col("title").alias("topic"), F.lit("topic").alias("category"), F.lit("topics").alias("project"))
    rows = one.unionByName(two).unionByName(three)
    link = F.concat(F.lit("[["), F.regexp_replace("rel_path", "\\.md$", ""), F.lit("|"), "topic", F.lit("]]"))
    text = F.concat(F.lit("| "), F.concat_ws(" | ", "date", "topic", "category", "project", link), F.lit(" |"))
    return rows.select("kind", "rel_path", "date", text.alias("row")).orderBy(F.desc("date"), "rel_path")


def run_summary(sources: DataFrame, state: DataFrame, results: DataFrame, least: float = 0.6) -> DataFrame:
    """One row of what a run did: sources (path, hash) scanned, those already processed, and of the results (path, skipped, error,
    confidence) of the others how many were filtered, failed, of low confidence, and distilled."""
    known = state.select("path", "hash").distinct().withColumn("known", F.lit(True))
    status = F.when(F.col("skipped"), "filtered").when(filled("error"), "errored").when(F.coalesce("confidence", F.lit(0.0)) <= least, "low").otherwise("distilled")
    rows = sources.select("path", "hash").join(known, ["path", "hash"], "left").join(results.select("path", status.alias("status")), "path", "left")
    fresh = F.col("known").isNull()
    return rows.agg(F.count("*").alias("scanned"), F.count_if(~fresh).alias("already_processed"), *(F.count_if(fresh & (F.col("status") == k)).alias(name) for k, name in (("filtered", "skipped_by_filter"), ("distilled", "distilled"), ("low", "low_confidence"), ("errored", "errored"))))


def quoted(c: Column) -> Column:
    return F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('\\"')), F.lit('"'))


#: Fields that a review leaves in a note, in order.
REVIEW_FIELDS = ["verified", "reviewed_at", "rejected_at"]


def preserved(content: Column) -> Column:
    """Struct of review (the review fields' lines, in order) and themes (the lines of the themes block; none
    without items) of a note's text; empty for a new note."""
    lines = F.split(F.regexp_extract(F.coalesce(content, F.lit("")), r"^---\n([\s\S]*?)\n---", 1), "\n")
    key = lambda x: F.trim(F.substring_index(x, ":", 1))
    first = lambda k: F.get(F.filter(lines, lambda x: (F.instr(x, ":") > 0) & (key(x) == k)), 0)
    review = F.array_compact(F.array(*(F.trim(first(k)) for k in REVIEW_FIELDS)))
    block = F.regexp_extract(F.coalesce(content, F.lit("")), r"^---\n(?:(?!---(?:\n|$))[^\n]*\n)*?themes:[^\S\n]*\n((?:[^\S\n]+-[^\S\n][^\n]*\n)+)", 1)
    items = F.filter(F.split(block, "\n"), lambda x: x != "")
    themes = F.when(block != "", F.concat(F.array(F.lit("themes:")), items)).otherwise(F.array().cast("array<string>"))
    return F.struct(review.alias("review"), themes.alias("themes"))


def with_preserved(notes: DataFrame, before: DataFrame) -> DataFrame:
    """notes (rel_path, themes: array, ...) with review and theme_lines: fresh themes count, else those of the
    version before (rel_path, content); review fields are always those of the version before."""
    old = before.select("rel_path", preserved(F.col("content")).alias("__old"))
    fresh = F.concat(F.array(F.lit("themes:")), F.transform("themes", lambda t: F.concat(F.lit("  - "), quoted(t))))
    none = F.array().cast("array<string>")
    joined = notes.join(old, "rel_path", "left")
    return joined.withColumns({"review": F.coalesce("__old.review", none), "theme_lines": F.when(F.size("themes") > 0, fresh).otherwise(F.coalesce("__old.themes", none))}).drop("__old")


def note_path(topic: Column, session: Column, category: Column) -> Column:
    return F.concat(category, F.lit("s/"), note_slug(topic, session), F.lit(".md"))


def render_note(notes: DataFrame) -> DataFrame:
    """(category, rel_path, content) of notes (topic, category, project, session_id, date, confidence, theme_lines,
    review, content, related: array of slug and topic): frontmatter with alias, themes and review fields, links to
    project and category, the body without its own related section, and the given one."""
    alias = kebab(F.col("topic"))
    fields = F.concat(
        F.array(F.lit("---"), F.concat(F.lit("topic: "), quoted(F.col("topic")))),
        F.when(alias != "", F.array(F.lit("aliases:"), F.concat(F.lit('  - "'), alias, F.lit('"')))).otherwise(F.array().cast("array<string>")),
        F.array(F.concat(F.lit("category: "), "category"), F.concat(F.lit("project: "), quoted(F.col("project"))), F.concat(F.lit("session_id: "), "session_id"), F.concat(F.lit("date: "), "date"), F.concat(F.lit("confidence: "), F.format_string("%.2f", "confidence"))),
        F.col("theme_lines"), F.col("review"), F.array(F.lit("---"), F.lit("")),
    )
    links = F.concat(F.lit("Project: [["), kebab(F.col("project")), F.lit("]]\nCategory: [["), "category", F.lit("]]\n\n"))
    related = F.when(F.size("related") > 0, F.concat(F.lit("\n\n## Related\n\n"), F.array_join(F.transform("related", lambda r: F.concat(F.lit("- [["), r["slug"], F.lit("|"), r["topic"], F.lit("]]"))), "\n"))).otherwise("")
    text = F.concat(F.array_join(fields, "\n"), links, strip_related(F.col("content")), related, F.lit("\n"))
    return notes.select("category", note_path(F.col("topic"), F.col("session_id"), F.col("category")).alias("rel_path"), text.alias("content"))


def render(notes: DataFrame) -> DataFrame:
    """Notes as markdown with frontmatter: (category, rel_path, content)."""
    front = F.array_join(F.array(F.lit("---"), F.concat(F.lit('topic: "'), F.replace("topic", F.lit('"'), F.lit('\\"')), F.lit('"')), F.concat(F.lit("category: "), "category"), F.concat(F.lit("project: "), "project"), F.concat(F.lit("session_id: "), "session_id"), F.concat(F.lit("date: "), F.date_format("started_at", "yyyy-MM-dd")), F.concat(F.lit("confidence: "), F.format_string("%.2f", "confidence"))), "\n")
    seen = F.when(F.col("verified"), F.lit("\nverified: true")).otherwise("")
    slug = F.concat("category", F.lit("s/"), F.substring(kebab(F.col("topic")), 1, 50), F.lit("-"), F.substring("session_id", 1, 8), F.lit(".md"))
    return notes.select("category", slug.alias("rel_path"), F.concat(front, seen, F.lit("\n---\n\n# "), "topic", F.lit("\n\n"), "content").alias("content"))


def route_model(rows: DataFrame, fast: str | None, smart: str, threshold: int = 100_000) -> DataFrame:
    chosen = F.lit(smart) if fast is None else F.when((F.col("category") == "decision") | (F.col("tokens") > threshold), smart).otherwise(fast)
    return rows.withColumn("model", chosen)


def freshness(last_seen: DataFrame, now: str, cadence_hours: float) -> DataFrame:
    """ok up to twice the cadence, then stale; down if never seen."""
    age = F.unix_timestamp(F.lit(now).cast("timestamp")) - F.unix_timestamp("last_seen")
    return last_seen.withColumn("health", F.when(F.col("last_seen").isNull(), "down").when(age <= 2 * cadence_hours * 3600, "ok").otherwise("stale"))
