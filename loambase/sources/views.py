"""Domain tables derived from the test tables; "now" is always a parameter."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

NOTES_NOW, COST_NOW = "2025-02-04 00:00:00", "2024-01-31 00:00:00"
CATEGORIES = ["pattern", "gotcha", "decision", "tool"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per distilled session."""
    d = F.col("doc_id")
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    vectors = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), F.lit(True).alias("embedded"))
    # Only the first six words are taken apart, not the whole text.
    first = F.regexp_extract("text", "^[ \\t\\n\\r]*((?:[^ \\t\\n\\r]+[ \\t\\n\\r]*){0,6})", 1)
    words = F.filter(F.split(first, "[ \\t\\n\\r]+"), lambda w: w != "")
    return (
        docs.join(labels, "doc_id", "left").join(vectors, "doc_id", "left").select(
            "doc_id",
            F.concat(F.lit("/proj/"), "source", F.lit("/"), d.cast("string"), F.lit(".jsonl")).alias("path"),
            F.lpad(d.cast("string"), 8, "0").alias("session_id"),
            F.element_at(F.array(*map(F.lit, CATEGORIES)), (d % 4 + 1).cast("int")).alias("category"),
            F.array_join(F.slice(words, 1, 6), " ").alias("topic"),
            F.col("source").alias("project"),
            (d * 37 % 101 / 100.0).alias("confidence"),
            F.timestamp_add("DAY", (d * 7 % 400).cast("int"), F.lit("2024-01-01").cast("timestamp")).alias("started_at"),
            F.col("text").alias("content"),
            (d % 11 == 0).alias("skipped"),
            F.when(d % 13 == 0, F.lit("boom")).alias("error"),
            (F.coalesce("toxic", F.lit(0)) == 1).alias("archived"),
            (F.coalesce("quality", F.lit(0)) == 1).alias("verified"),
            F.coalesce("embedded", F.lit(False)).alias("embedded"),
        )
    )


NOTES_SQL = """notes AS (SELECT d.doc_id, '/proj/' || source || '/' || d.doc_id || '.jsonl' AS path, lpad(CAST(d.doc_id AS VARCHAR), 8, '0') AS session_id,
 ['pattern', 'gotcha', 'decision', 'tool'][CAST(d.doc_id % 4 + 1 AS INT)] AS category,
 array_to_string(list_filter(regexp_split_to_array(text, '[ \\t\\n\\r]+'), lambda w: w <> '')[1:6], ' ') AS topic, source AS project,
 (d.doc_id * 37 % 101) / 100.0::DOUBLE AS confidence, TIMESTAMP '2024-01-01' + to_days(CAST(d.doc_id * 7 % 400 AS INT)) AS started_at, text AS content,
 d.doc_id % 11 = 0 AS skipped, CASE WHEN d.doc_id % 13 = 0 THEN 'boom' END AS error, coalesce(toxic, 0) = 1 AS archived, coalesce(quality, 0) = 1 AS verified,
 d.doc_id IN (SELECT vec_id FROM embeddings) AS embedded
 FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)"""

#: Models of the cost records, the last without a price.
MODELS = ["claude-haiku-4-5-20251001", "claude-sonnet-4-6", "unpriced"]


def cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cost records: one per event."""
    e = F.col("event_id")
    return table(spark, sf_dir, "events").select(
        "event_id", "ts",
        F.when(F.col("event_type") != "signup", F.col("user_id").cast("string")).alias("session"),
        F.col("event_type").alias("stage"),
        F.when(F.get_json_object("props", "$.k").cast("long") % 5 != 0, F.concat(F.lit("p"), (F.get_json_object("props", "$.k").cast("long") % 5).cast("string"))).alias("project"),
        F.element_at(F.array(F.lit("anthropic"), F.lit("kie")), (e % 2 + 1).cast("int")).alias("provider"),
        F.element_at(F.array(*map(F.lit, MODELS)), (e % 3 + 1).cast("int")).alias("model"),
        F.floor(F.col("value") * 100).cast("long").alias("input_tokens"),
        F.floor(F.col("value") * 10).cast("long").alias("output_tokens"),
    )


COST_SQL = """cost AS (SELECT event_id, ts, CASE WHEN event_type <> 'signup' THEN CAST(user_id AS VARCHAR) END AS session, event_type AS stage,
 CASE WHEN CAST(json_extract_string(props, '$.k') AS BIGINT) % 5 <> 0 THEN 'p' || (CAST(json_extract_string(props, '$.k') AS BIGINT) % 5) END AS project,
 ['anthropic', 'kie'][CAST(event_id % 2 + 1 AS INT)] AS provider, ['claude-haiku-4-5-20251001', 'claude-sonnet-4-6', 'unpriced'][CAST(event_id % 3 + 1 AS INT)] AS model,
 CAST(floor(value * 100) AS BIGINT) AS input_tokens, CAST(floor(value * 10) AS BIGINT) AS output_tokens FROM events)"""


def articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as markdown with frontmatter."""
    title = F.regexp_extract("html", "<title>([^<]*)</title>", 1)
    front = F.concat(F.lit('---\ntitle: "'), title, F.lit('"\nsource: '), F.col("url"), F.lit("\ntags: [web, p"), (F.col("page_id") % 3).cast("string"), F.lit("]\npage: "), F.col("page_id").cast("string"), F.lit("\n---\n"))
    text = F.trim(F.regexp_replace(F.regexp_replace("html", "<[^>]*>", " "), "[ \\t\\n\\r]+", " "))
    return table(spark, sf_dir, "pages").select("page_id", F.concat(F.lit("raw/"), F.col("page_id").cast("string"), F.lit(".md")).alias("path"), F.concat(front, F.lit("\n# "), title, F.lit("\n\n"), text).alias("content"))


ARTICLES_SQL = """articles AS (SELECT page_id, 'raw/' || page_id || '.md' AS path, '---' || chr(10) || 'title: "' || regexp_extract(html, '<title>([^<]*)</title>', 1) || '"' || chr(10) || 'source: ' || url || chr(10) ||
 'tags: [web, p' || (page_id % 3) || ']' || chr(10) || 'page: ' || page_id || chr(10) || '---' || chr(10) || chr(10) || '# ' || regexp_extract(html, '<title>([^<]*)</title>', 1) || chr(10) || chr(10) ||
 trim(regexp_replace(regexp_replace(html, '<[^>]*>', ' ', 'g'), '[ \\t\\n\\r]+', ' ', 'g')) AS content FROM pages)"""


def tool_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per user, tool calls and results in order."""
    e = F.col("event_id")
    return table(spark, sf_dir, "events").select(
        F.concat(F.lit("/s/"), F.col("user_id").cast("string")).alias("path"), e.alias("line"),
        F.get_json_object("props", "$.k").alias("tool_id"),
        F.when(e % 2 == 0, "tool_use").otherwise("tool_result").alias("kind"),
        F.when(e % 2 == 0, F.element_at(F.array(*map(F.lit, ["Bash", "Read", "Write", "Skill"])), (e % 4 + 1).cast("int"))).alias("name"),
        (F.col("event_type") == "error").alias("is_error"),
        F.array_join(F.array_repeat(F.concat(F.lit("row "), e.cast("string")), (e % 70).cast("int")), "\n").alias("content"),
    )


TOOLS_SQL = """tools AS (SELECT '/s/' || user_id AS path, event_id AS line, json_extract_string(props, '$.k') AS tool_id, CASE WHEN event_id % 2 = 0 THEN 'tool_use' ELSE 'tool_result' END AS kind,
 CASE WHEN event_id % 2 = 0 THEN ['Bash', 'Read', 'Write', 'Skill'][CAST(event_id % 4 + 1 AS INT)] END AS name, event_type = 'error' AS is_error,
 array_to_string(list_transform(range(event_id % 70), lambda i: 'row ' || event_id), chr(10)) AS content FROM events)"""


TOOL_NAMES = ["Read", "Bash", "Write", "Edit"]


def transcripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """path, line, text, event: conversations as transcript lines. Assistants make up to three tool calls a turn,
    users return the first one's result; every tenth conversation has broken lines, too."""
    c, t, role, text = F.col("conv_id"), F.col("turn"), F.col("role"), F.col("text")
    path = F.concat(F.lit("/proj/c"), (c % 5).cast("string"), F.lit("/"), c.cast("string"), F.lit(".jsonl"))
    name = lambda k: F.element_at(F.array(*map(F.lit, TOOL_NAMES)), ((c + t + k) % 4 + 1).cast("int"))
    file = lambda k: F.concat(F.lit("/src/f"), ((c + k) % 5).cast("string"), F.lit(".py"))
    ident = lambda turn, k: F.concat(F.lit("u"), turn.cast("string"), F.lit("_"), k.cast("string"))
    said = F.to_json(F.struct(F.lit("text").alias("type"), text.alias("text")))
    call = lambda k: F.to_json(F.struct(F.lit("tool_use").alias("type"), ident(t, k).alias("id"), name(k).alias("name"), F.struct(F.when(name(k) != "Edit", file(k)).alias("file_path"), F.when(name(k) == "Edit", file(k)).alias("path")).alias("input")))
    calls = F.when(c % 4 > 0, F.transform(F.sequence(F.lit(0).cast("long"), c % 4 - 1), call)).otherwise(F.array().cast("array<string>"))
    result = F.to_json(F.struct(F.lit("tool_result").alias("type"), ident(t - 1, F.lit(0)).alias("tool_use_id"), (t % 4 == 2).alias("is_error"), F.substring(text, 1, 40).alias("content")))
    blocks = F.when(role == "assistant", F.concat(F.array(said), calls)).otherwise(F.array(result, said))
    plain = (role == "system") | ((role == "user") & (t == 0))
    whole = F.regexp_extract(F.to_json(F.array(text)), r"(?s)^\[(.*)\]$", 1)
    content = F.when(plain, whole).otherwise(F.concat(F.lit("["), F.array_join(blocks, ","), F.lit("]")))
    stamp = F.when(t % 7 != 3, F.format_string('"timestamp":"2024-01-%02dT00:%02d:00Z",', c % 28 + 1, t.cast("long"))).otherwise("")
    line = F.concat(F.lit("{"), stamp, F.lit('"type":"'), role, F.lit('","message":{"role":"'), role, F.lit('","content":'), content, F.lit("}}"))
    rows = table(spark, sf_dir, "conversations")
    broken = rows.filter("conv_id % 10 = 0").select(path.alias("path")).distinct().select("path", F.explode(F.sequence(F.lit(1001).cast("long"), F.lit(1060).cast("long"))).alias("line"), F.lit('{"broken').alias("text"))
    return rows.select(path.alias("path"), t.cast("long").alias("line"), line.alias("text")).unionByName(broken).withColumn("event", F.try_parse_json("text"))


TRANSCRIPTS_SQL = """c AS (SELECT CAST(conv_id AS BIGINT) AS conv_id, CAST(turn AS BIGINT) AS turn, role, text, '/proj/c' || conv_id % 5 || '/' || conv_id || '.jsonl' AS path, CASE WHEN turn % 7 <> 3 THEN printf('2024-01-%02dT00:%02d:00Z', conv_id % 28 + 1, turn) END AS ts FROM conversations),
 calls AS (SELECT c.*, k, ['Read', 'Bash', 'Write', 'Edit'][CAST((conv_id + turn + k) % 4 + 1 AS INT)] AS tool, '/src/f' || (conv_id + k) % 5 || '.py' AS file FROM c, range(3) r(k) WHERE role = 'assistant' AND k < conv_id % 4),
 blocks AS (SELECT path, turn AS line, CASE WHEN role = 'user' AND turn > 0 THEN 1 ELSE 0 END AS block, role, text AS said, CASE WHEN NOT (role = 'system' OR role = 'user' AND turn = 0) THEN text END AS shown, NULL AS file FROM c
  UNION ALL SELECT c.path, c.turn, 0, c.role, NULL, '[tool_result: ' || coalesce(t.tool, 'unknown') || CASE WHEN c.turn % 4 = 2 THEN ' ERROR' ELSE '' END || ']' || chr(10) || left(c.text, 40) || chr(10) || '[/tool_result]', NULL FROM c LEFT JOIN calls t ON t.conv_id = c.conv_id AND t.turn = c.turn - 1 AND t.k = 0 WHERE c.role = 'user' AND c.turn > 0
  UNION ALL SELECT path, turn, 1 + k, role, NULL, '[tool_use: ' || tool || '] {"' || CASE WHEN tool = 'Edit' THEN 'path' ELSE 'file_path' END || '":"' || file || '"}', CASE WHEN tool <> 'Bash' THEN file END FROM calls),
 firsts AS (SELECT path, file, min(line * 100 + block) AS pos FROM blocks WHERE file IS NOT NULL GROUP BY 1, 2),
 files AS (SELECT path, count(*) AS n_files, string_agg(file, chr(10) ORDER BY pos) AS files FROM firsts GROUP BY 1),
 texts AS (SELECT path, coalesce(string_agg(said, chr(10) || chr(10) ORDER BY line, block) FILTER (role = 'assistant'), '') AS assistant_text, coalesce(string_agg(said, chr(10) || chr(10) ORDER BY line, block) FILTER (role = 'user'), '') AS user_text, coalesce(string_agg(shown, chr(10) || chr(10) ORDER BY line, block), '') AS transcript FROM blocks GROUP BY 1),
 heads AS (SELECT path, min(conv_id) AS conv_id, count(*) + CASE WHEN min(conv_id) % 10 = 0 THEN 60 ELSE 0 END AS line_count, min_by(ts, turn) FILTER (ts IS NOT NULL) AS started_at, max_by(ts, turn) FILTER (ts IS NOT NULL) AS ended_at FROM c GROUP BY 1),
 transcripts AS (SELECT h.*, (SELECT count(*) FROM calls k WHERE k.path = h.path) AS tool_calls, coalesce(n_files, 0) AS n_files, coalesce(files, '') AS files, assistant_text, user_text, transcript,
  '# User messages' || chr(10) || CASE WHEN length(user_text) > 4000 THEN left(user_text, 4000) || chr(10) || '…[truncated ' || (length(user_text) - 4000) || ' chars]' ELSE user_text END || chr(10) || chr(10) || '# Assistant messages' || chr(10) || CASE WHEN length(assistant_text) > 8000 THEN left(assistant_text, 8000) || chr(10) || '…[truncated ' || (length(assistant_text) - 8000) || ' chars]' ELSE assistant_text END
  || chr(10) || chr(10) || '# Tool calls: ' || (SELECT count(*) FROM calls k WHERE k.path = h.path) || chr(10) || chr(10) || '# Files touched (' || coalesce(n_files, 0) || '):' || chr(10) || coalesce(files, '') AS raw_summary FROM heads h JOIN texts USING (path) LEFT JOIN files USING (path))"""


def pages_of_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc, path, content, verified: documents as notes of all types, with frontmatter that lacks a field here and there."""
    d = F.col("doc_id")
    s = d.cast("string")
    kind = F.element_at(F.array(*map(F.lit, ["article", "pdf", "topic", "session", "session", "session"])), (d % 6 + 1).cast("int"))
    category = F.element_at(F.array(*map(F.lit, CATEGORIES)), (d % 4 + 1).cast("int"))
    folder = F.when(kind == "session", F.concat(category, F.lit("s"))).otherwise(F.concat(kind, F.lit("s")))
    field = lambda key, value, when=None: F.when(F.lit(True) if when is None else when, F.concat(F.lit(f"{key}: "), value))
    fields = [
        field("type", kind, kind != "session"), field("category", F.when(kind == "article", "concept").otherwise(category), (kind == "article") | (kind == "session") & (d % 5 != 0)),
        field("project", F.concat(F.lit('"'), "source", F.lit('"')), (kind == "session") & (d % 7 != 0)), field("topic", F.concat(F.lit('"T'), (d % 50).cast("string"), F.lit('"')), kind == "session"),
        field("title", F.concat(F.lit("P"), s), kind == "topic"), field("source_title", F.concat(F.lit("S: "), s), kind.isin("article", "pdf")), field("source_author", F.concat(F.lit("A"), (d % 7).cast("string")), kind == "article"), field("source_url", F.concat(F.lit("http://x/"), s), kind == "article"),
        field("confidence", F.when(d % 17 == 0, "none").otherwise(F.format_string("%.2f", d * 37 % 101 / 100.0)), d % 19 != 0), field("date", F.date_format(F.date_add(F.lit("2024-01-01").cast("date"), (d % 400).cast("int")), "yyyy-MM-dd"), d % 3 != 1), field("verified", F.lit("true"), d % 3 == 0),
    ]
    content = F.concat(F.lit("---\n"), F.array_join(F.array_compact(F.array(*fields)), "\n"), F.lit("\n---\n"), "text")
    return table(spark, sf_dir, "documents").select(d.alias("doc"), F.concat(folder, F.lit("/"), s, F.lit(".md")).alias("path"), content.alias("content"), (d % 3 == 0).alias("verified"))


PAGES_SQL = """kinds AS (SELECT doc_id AS d, text, source, ['article', 'pdf', 'topic', 'session', 'session', 'session'][CAST(doc_id % 6 + 1 AS INT)] AS kind, ['pattern', 'gotcha', 'decision', 'tool'][CAST(doc_id % 4 + 1 AS INT)] AS cat FROM documents),
 vault AS (SELECT d AS doc, kind, cat, source, text, CASE WHEN kind = 'session' THEN cat ELSE kind END || 's/' || d || '.md' AS path, d % 3 = 0 AS verified, CASE WHEN d % 17 = 0 OR d % 19 = 0 THEN 0.0::DOUBLE ELSE (d * 37 % 101) / 100.0::DOUBLE END AS confidence,
  CASE WHEN d % 3 <> 1 THEN strftime(DATE '2024-01-01' + CAST(d % 400 AS INT), '%Y-%m-%d') ELSE '' END AS date, CASE WHEN kind = 'session' AND d % 7 <> 0 THEN source END AS project, left(trim(regexp_replace(text, '\\s+', ' ', 'g')), 200) AS preview FROM kinds)"""
