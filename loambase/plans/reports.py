"""Registered queries: what a run did and saved, the index, periods with their range, payloads and skills bounded."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import replies
from ..operators import notes, pages, periods, sessions
from ..sources import files, views
from ..sources.views import NOTES_NOW, NOTES_SQL, TRANSCRIPTS_SQL, table
from .catalogue import _DISTILLED, _k, query

_STATUS = "CASE WHEN skipped THEN 'filtered' WHEN error IS NOT NULL THEN 'errored' WHEN confidence <= 0.6 THEN 'low' ELSE 'distilled' END"


@query(f"WITH {NOTES_SQL}, r AS (SELECT doc_id % 3 <> 0 AND doc_id % 5 <> 0 AS known, {_STATUS} AS status FROM notes) SELECT count(*) AS scanned, count(*) FILTER (known) AS already_processed, count(*) FILTER (NOT known AND status = 'filtered') AS skipped_by_filter, count(*) FILTER (NOT known AND status = 'distilled') AS distilled, count(*) FILTER (NOT known AND status = 'low') AS low_confidence, count(*) FILTER (NOT known AND status = 'errored') AS errored FROM r")
def run_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A run over all documents; two in three were processed before, of which every fifth has changed."""
    n = views.notes(spark, sf_dir).withColumn("hash", F.sha2("content", 256))
    known = n.filter("doc_id % 3 <> 0").select("path", F.when(F.col("doc_id") % 5 == 0, "old").otherwise(F.col("hash")).alias("hash"))
    return notes.run_summary(n, known, n)


_AUTHOR, _WHEN = "CASE WHEN page_id % 4 <> 0 THEN 'a' || page_id % 9 END", "CASE WHEN page_id % 3 <> 0 THEN strftime(DATE '2024-01-01' + CAST(page_id % 300 AS INT), '%Y-%m-%d') END"
_TITLE = "regexp_extract(html, '<title>([^<]*)</title>', 1)"


@query(f"""WITH {NOTES_SQL}, {_DISTILLED}, r AS (SELECT 'session' AS kind, category || 's/' || CASE WHEN left({_k('topic')}, 50) <> '' THEN left({_k('topic')}, 50) ELSE 'note' END || '-' || left(session_id, 8) AS link, strftime(started_at, '%Y-%m-%d') AS date, topic, category, project FROM distilled
 UNION ALL SELECT 'article', 'articles/' || page_id, coalesce({_WHEN}, '2024-05-05'), {_TITLE}, 'concept', coalesce({_AUTHOR}, 'web') FROM pages WHERE page_id % 5 <> 0 UNION ALL SELECT 'topic', 'topics/t' || item_id, CASE WHEN item_id % 2 = 0 THEN '2024-02-0' || (1 + item_id % 7) ELSE '2024-01-15' END, 'T ' || item_id, 'topic', 'topics' FROM benchmark)
 SELECT kind, link || '.md' AS rel_path, date, '| ' || date || ' | ' || topic || ' | ' || category || ' | ' || project || ' | [[' || link || '|' || topic || ']] |' AS row FROM r""")
def index_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, i = F.col("page_id"), F.col("item_id")
    day = F.date_format(F.date_add(F.lit("2024-01-01").cast("date"), (p % 300).cast("int")), "yyyy-MM-dd")
    articles = table(spark, sf_dir, "pages").select(F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title"), F.when(p % 4 != 0, F.concat(F.lit("a"), (p % 9).cast("string"))).alias("author"), F.lit("concept").alias("category"), F.when(p % 5 != 0, F.concat(F.lit("articles/"), p.cast("string"), F.lit(".md"))).alias("note_path"), F.when(p % 3 != 0, day).alias("published"), F.lit("2024-05-05T10:00").alias("distilled_at"))
    topics = table(spark, sf_dir, "benchmark").select(F.concat(F.lit("t"), i.cast("string")).alias("id"), F.concat(F.lit("T "), i.cast("string")).alias("title"), F.when(i % 2 == 0, F.concat(F.lit("2024-02-0"), (1 + i % 7).cast("string"))).alias("updated_at"), F.lit("2024-01-15").alias("created_at"))
    return notes.index_page(views.notes(spark, sf_dir), articles, topics)


@query(f"WITH {NOTES_SQL}, {_DISTILLED} SELECT path, category, strftime(started_at, '%Y-%m-%d') AS date, left(trim(regexp_replace(content, '\\s+', ' ', 'g')), 200) AS summary FROM distilled WHERE project = 'src1' AND verified ORDER BY started_at DESC, path LIMIT 20")
def recent_of_project(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The most that a client gets, of any age, of one project, verified."""
    return notes.recent(views.notes(spark, sf_dir), NOTES_NOW, None, verified=True, limit=500, project="Src1!")


@query(f"""WITH {NOTES_SQL}, {_DISTILLED}, d AS (SELECT DISTINCT date_trunc('week', started_at) AS w, date_trunc('month', started_at) AS m FROM distilled) SELECT DISTINCT printf('%d-W%02d (', isoyear(w), week(w)) || strftime(w, '%Y-%m-%d') || ' to ' || strftime(w + INTERVAL 6 DAY, '%Y-%m-%d') || ')' AS label FROM d
 UNION SELECT strftime(m, '%Y-%m (%Y-%m-%d to ') || strftime(m + INTERVAL 1 MONTH - INTERVAL 1 DAY, '%Y-%m-%d') || ')' FROM d""")
def period_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = notes.distilled(views.notes(spark, sf_dir)).filter("started_at is not null")
    labels = F.array(*(periods.period_label(F.date_trunc(u, "started_at"), u) for u in ("WEEK", "MONTH")))
    return n.select(F.explode(labels).alias("label")).distinct()


@query(f"WITH {NOTES_SQL}, {_DISTILLED} SELECT 'week' AS period, path FROM distilled WHERE started_at >= date_trunc('week', TIMESTAMP '{NOTES_NOW}') - INTERVAL 14 DAY AND started_at < date_trunc('week', TIMESTAMP '{NOTES_NOW}') - INTERVAL 7 DAY UNION ALL SELECT 'month', path FROM distilled WHERE started_at >= date_trunc('month', TIMESTAMP '{NOTES_NOW}') - INTERVAL 2 MONTH AND started_at < date_trunc('month', TIMESTAMP '{NOTES_NOW}') - INTERVAL 1 MONTH")
def past_periods(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Notes of the week and the month two before now."""
    n = notes.distilled(views.notes(spark, sf_dir))
    parts = []
    for unit in ("WEEK", "MONTH"):
        start, end = periods.period_range(NOTES_NOW, unit, 2)
        parts.append(n.filter((F.col("started_at") >= start) & (F.col("started_at") < end)).select(F.lit(unit.lower()).alias("period"), "path"))
    return parts[0].unionByName(parts[1])


@query("SELECT doc_id, CASE WHEN length(text) > 2000 THEN '[truncated ' || length(text) || ' chars of content for Write]' ELSE md5(text) END AS content, CASE WHEN length(text) > 1000 THEN '[truncated ' || length(text) || ' chars of new_string for MultiEdit]' ELSE md5(text) END AS edit, 'p' || doc_id AS path FROM documents")
def bounded_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Payloads of writing tools that hold whole documents."""
    held = table(spark, sf_dir, "documents").withColumn("path", F.concat(F.lit("p"), F.col("doc_id").cast("string")))
    write = F.to_json(F.struct("path", F.col("text").alias("content")))
    edit = F.to_json(F.struct("path", F.array(F.struct(F.lit("a").alias("old_string"), F.col("text").alias("new_string"))).alias("edits")))
    bound = held.select("doc_id", "text", replies.bound_payload(F.lit("Write"), write).alias("w"), replies.bound_payload(F.lit("MultiEdit"), edit).alias("e"))
    shown = lambda c: F.when(c.startswith("[truncated"), c).otherwise(F.md5(c))
    return bound.select("doc_id", shown(F.get_json_object("w", "$.content")).alias("content"), shown(F.get_json_object("e", "$.edits[0].new_string")).alias("edit"), F.get_json_object("w", "$.path").alias("path"))


@query("""WITH t AS (SELECT doc_id, text AS body, CASE WHEN doc_id % 3 = 0 THEN '{"skill":"s' || doc_id || '"}' WHEN doc_id % 3 = 1 THEN '{"skill":1,"name":"n"}' ELSE '{no' END AS call, CASE WHEN doc_id % 3 = 0 THEN 's' || doc_id WHEN doc_id % 3 = 1 THEN 'n' ELSE 'skill' END AS name, length(text) > 1000 AND doc_id % 5 <> 0 AS strip FROM documents),
 r AS (SELECT *, 'before' || chr(10) || chr(10) || '[tool_use: Skill] ' || call || chr(10) || chr(10) AS head, '[tool_result: Skill' || CASE WHEN doc_id % 5 = 0 THEN ' ERROR' ELSE '' END || ']' || chr(10) || body || chr(10) || '[/tool_result]' AS whole, chr(10) || chr(10) || 'after' AS tail FROM t),
 f AS (SELECT *, head || whole || tail AS a, head || CASE WHEN strip THEN '[tool_result: Skill] [Skill ' || name || ' loaded]' ELSE whole END || tail AS b FROM r)
 SELECT doc_id, md5(b) AS text, CASE WHEN strip THEN 1 ELSE 0 END AS stripped, CAST(ceil(length(a) / 4.0) AS BIGINT) AS original_tokens, CAST(ceil(length(b) / 4.0) AS BIGINT) AS filtered_tokens, greatest(0, CAST(ceil(length(a) / 4.0) AS BIGINT) - CAST(ceil(length(b) / 4.0) AS BIGINT)) AS tokens_saved FROM f""")
def skill_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rendered transcripts in which a skill was loaded, some with an error or a call that is no JSON."""
    d, s = F.col("doc_id"), F.col("doc_id").cast("string")
    call = F.when(d % 3 == 0, F.concat(F.lit('{"skill":"s'), s, F.lit('"}'))).when(d % 3 == 1, '{"skill":1,"name":"n"}').otherwise("{no")
    text = F.concat(F.lit("before\n\n[tool_use: Skill] "), call, F.lit("\n\n[tool_result: Skill"), F.when(d % 5 == 0, " ERROR").otherwise(""), F.lit("]\n"), "text", F.lit("\n[/tool_result]\n\nafter"))
    rows = table(spark, sf_dir, "documents").select("doc_id", text.alias("a")).withColumn("s", pages.stripped_skills(F.col("a")))
    return rows.select("doc_id", F.md5("s.text").alias("text"), F.col("s.stripped").alias("stripped"), pages.savings(F.col("a"), F.col("s.text")).alias("t")).select("doc_id", "text", "stripped", "t.*")


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = views.transcripts(spark, sf_dir)
    return lines.withColumn("ts", F.try_variant_get("event", "$.timestamp", "string"))


@query(f"""WITH {TRANSCRIPTS_SQL} SELECT path, line // 3 AS part, md5(string_agg(said, chr(10) || chr(10) ORDER BY line, block) FILTER (role = 'assistant')) AS assistant_text, md5(string_agg(said, chr(10) || chr(10) ORDER BY line, block) FILTER (role = 'user')) AS user_text, md5(string_agg(shown, chr(10) || chr(10) ORDER BY line, block)) AS transcript FROM blocks GROUP BY 1, 2""")
def transcript_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Transcripts in pieces of three lines; a result's call stands in the piece before it."""
    lines = _lines(spark, sf_dir)
    pieces = sessions.parts(files.transcript_blocks(lines), 3)
    return pieces.withColumns({c: F.md5(c) for c in ("assistant_text", "user_text", "transcript")})


@query(f"""WITH {TRANSCRIPTS_SQL} SELECT path, CAST(conv_id AS VARCHAR) AS session, 'c' || conv_id % 5 AS project, started_at, ended_at, line_count, tool_calls, n_files, md5(raw_summary) AS raw_summary FROM transcripts""")
def session_heads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is known of each session without its whole texts."""
    lines = _lines(spark, sf_dir)
    blocks = files.transcript_blocks(lines)
    return sessions.heads(lines, blocks, sessions.parts(blocks, 3)).withColumn("raw_summary", F.md5("raw_summary"))
