"""The registered queries and their SQL: operators over the domain tables of the test data."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import cost, hygiene, knn, notes, periods, search, sessions, state
from ..sources import views
from ..sources.scratch import materialize
from ..sources.views import ARTICLES_SQL, COST_NOW, COST_SQL, NOTES_NOW, NOTES_SQL, TOOLS_SQL, table

QUERIES: dict = {}
ORACLES: dict[str, str] = {}

_DISTILLED = "distilled AS (SELECT * FROM notes WHERE NOT skipped AND error IS NULL AND content <> '' AND category <> '' AND topic <> '' AND NOT archived)"
_USABLE = "usable AS (SELECT * FROM notes WHERE NOT skipped AND error IS NULL AND content <> '')"
_COUNTS = "count(*) FILTER (category = 'pattern') AS patterns, count(*) FILTER (category = 'gotcha') AS gotchas, count(*) FILTER (category = 'decision') AS decisions, count(*) FILTER (category = 'tool') AS tools"
_KEBAB = "regexp_replace(regexp_replace(lower({}), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g')"


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def _k(c: str) -> str:
    return _KEBAB.format(c)


@query(f"WITH {NOTES_SQL}, {_DISTILLED} SELECT path, category, project, confidence FROM distilled")
def distilled_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return notes.distilled(views.notes(spark, sf_dir)).select("path", "category", "project", "confidence")


@query(f"WITH {NOTES_SQL} SELECT count(*) AS total, count(*) FILTER (skipped) AS skipped, count(*) FILTER (error IS NOT NULL) AS errored, strftime(max(started_at), '%Y-%m-%d') AS last, count(*) - count(*) FILTER (skipped) - count(*) FILTER (error IS NOT NULL) AS distilled FROM notes")
def processing_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return notes.processing_stats(views.notes(spark, sf_dir))


@query(f"WITH {NOTES_SQL} SELECT CASE WHEN skipped THEN 'filtered' WHEN error IS NOT NULL THEN 'errored' WHEN confidence <= 0.6 THEN 'low confidence' ELSE 'distilled' END AS status, count(*) AS n FROM notes GROUP BY 1")
def run_status_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    status = F.when(F.col("skipped"), "filtered").when(notes.filled("error"), "errored").when(F.col("confidence") <= 0.6, "low confidence").otherwise("distilled")
    return views.notes(spark, sf_dir).groupBy(status.alias("status")).agg(F.count("*").alias("n"))


@query(f"WITH {NOTES_SQL}, {_DISTILLED} SELECT path, confidence FROM distilled WHERE confidence > 0.6")
def confidence_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return notes.distilled(views.notes(spark, sf_dir)).filter("confidence > 0.6").select("path", "confidence")


@query(f"WITH {NOTES_SQL}, {_USABLE} SELECT count(*) AS total, round(avg(confidence), 6) AS avg_confidence, count(*) FILTER (confidence >= 0.8) AS high, count(*) FILTER (confidence < 0.5) AS low, {_COUNTS}, strftime(min(started_at), '%Y-%m-%d') AS oldest, strftime(max(started_at), '%Y-%m-%d') AS newest FROM usable")
def knowledge_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return notes.knowledge_stats(views.notes(spark, sf_dir))


_PROJECTS = f"projects AS (SELECT project, count(*) AS total, {_COUNTS}, round(avg(confidence), 6) AS avg_confidence, strftime(max(started_at), '%Y-%m-%d') AS last_seen FROM usable GROUP BY project)"


@query(f"WITH {NOTES_SQL}, {_USABLE}, {_PROJECTS} SELECT * FROM projects")
def project_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return notes.project_stats(views.notes(spark, sf_dir))


@query(f"WITH {NOTES_SQL}, {_USABLE}, {_PROJECTS} SELECT project, total, 'no gotchas' AS gap FROM projects WHERE gotchas = 0 UNION ALL SELECT project, total, 'no decisions' FROM projects WHERE decisions = 0 UNION ALL SELECT project, total, 'low confidence' FROM projects WHERE floor(avg_confidence * 100 + 0.5) / 100 < 0.65")
def knowledge_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return notes.knowledge_gaps(notes.project_stats(views.notes(spark, sf_dir)))


@query(f"WITH {NOTES_SQL}, {_USABLE}, c AS (SELECT category, count(*) AS n FROM usable GROUP BY 1) SELECT category, n, CAST(floor(100.0 * n / (SELECT sum(n) FROM c) + 0.5) AS BIGINT) AS percent, CAST(floor(16.0 * n / (SELECT max(n) FROM c) + 0.5) AS BIGINT) AS bar FROM c")
def category_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    return notes.category_share(views.notes(spark, sf_dir))


def _layers(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    n = views.notes(spark, sf_dir)
    a = views.articles(spark, sf_dir).select(F.col("path").alias("id"), "content", (F.col("page_id") % 7 == 0).alias("skipped"), F.lit(None).cast("string").alias("error"), F.when(F.col("page_id") % 5 != 0, F.col("path")).alias("note_path"), (F.col("page_id") % 2 == 0).alias("embedded"))
    t = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("id"), F.col("text").alias("content"), (F.col("item_id") % 2 == 0).alias("embedded"))
    return {"sessions": n.withColumn("id", F.col("session_id")), "articles": a, "topics": t}


_BACKLOG = f"""WITH {NOTES_SQL}, {ARTICLES_SQL}, backlog AS (SELECT 'sessions' AS layer, session_id AS id FROM notes WHERE NOT skipped AND error IS NULL AND content <> '' AND topic <> '' AND category <> '' AND NOT archived AND NOT embedded
 UNION ALL SELECT 'articles', path FROM articles WHERE page_id % 7 <> 0 AND page_id % 5 <> 0 AND page_id % 2 <> 0 AND content <> '' UNION ALL SELECT 'topics', CAST(item_id AS VARCHAR) FROM benchmark WHERE item_id % 2 <> 0 AND text <> '')"""


@query(f"{_BACKLOG} SELECT * FROM backlog")
def embedding_backlog(spark: SparkSession, sf_dir: str) -> DataFrame:
    return notes.backlog(_layers(spark, sf_dir))


@query(f"{_BACKLOG} SELECT layer, count(*) AS n FROM backlog GROUP BY layer")
def pending_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return notes.backlog(_layers(spark, sf_dir)).groupBy("layer").agg(F.count("*").alias("n"))


_EMPTY = "CASE WHEN doc_id % 9 = 0 THEN '' ELSE content END"


@query(f"WITH {NOTES_SQL} SELECT path FROM notes WHERE NOT skipped AND {_EMPTY} = ''")
def reconcile_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = views.notes(spark, sf_dir)
    return notes.reconcile_targets(n.withColumn("content", F.when(F.col("doc_id") % 9 == 0, "").otherwise(F.col("content")))).select("path")


_PRICED = f"""{COST_SQL}, priced AS (SELECT c.*, CASE model WHEN 'unpriced' THEN 0.0::DOUBLE ELSE input_tokens / 1e6::DOUBLE * (CASE provider || model WHEN 'anthropicclaude-haiku-4-5-20251001' THEN 1.0::DOUBLE WHEN 'anthropicclaude-sonnet-4-6' THEN 3.0::DOUBLE WHEN 'kieclaude-haiku-4-5-20251001' THEN 0.28::DOUBLE ELSE 0.84::DOUBLE END)
 + output_tokens / 1e6::DOUBLE * (CASE provider || model WHEN 'anthropicclaude-haiku-4-5-20251001' THEN 5.0::DOUBLE WHEN 'anthropicclaude-sonnet-4-6' THEN 15.0::DOUBLE WHEN 'kieclaude-haiku-4-5-20251001' THEN 1.4::DOUBLE ELSE 4.2::DOUBLE END) END AS usd FROM cost c),
 report AS (SELECT coalesce(session, stage) AS key, sum(usd) AS usd, count(*) AS calls, CAST(sum(input_tokens) AS BIGINT) AS input_tokens, CAST(sum(output_tokens) AS BIGINT) AS output_tokens, min_by(project, ts::VARCHAR || lpad(event_id::VARCHAR, 12, '0')) FILTER (project IS NOT NULL) AS project FROM priced GROUP BY 1)"""


def _priced(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cost.priced(views.cost(spark, sf_dir), cost.prices(spark))


@query(f"WITH {_PRICED} SELECT event_id, round(usd, 8) AS usd FROM priced")
def priced_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _priced(spark, sf_dir).select("event_id", F.round("usd", 8).alias("usd"))


@query(f"WITH {_PRICED} SELECT key, round(usd, 6) AS usd, calls, input_tokens, output_tokens, project FROM report")
def cost_by_session(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cost.report(_priced(spark, sf_dir)).withColumn("usd", F.round("usd", 6))


@query(f"WITH {_PRICED} SELECT round(sum(usd), 6) AS total, count(*) AS sessions, CAST(sum(calls) AS BIGINT) AS records, round(median(usd), 6) AS median, round(quantile_disc(usd, 0.9), 6) AS p90 FROM report")
def cost_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cost.distribution(cost.report(_priced(spark, sf_dir)))


@query(f"WITH {_PRICED} SELECT key, round(usd, 6) AS usd FROM report ORDER BY report.usd DESC, key LIMIT 10")
def cost_top_n(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cost.top(cost.report(_priced(spark, sf_dir)), 10).select("key", F.round("usd", 6).alias("usd"))


@query(f"WITH {COST_SQL} SELECT stage, count(*) AS calls FROM cost WHERE ts IS NULL OR ts >= TIMESTAMP '{COST_NOW}' - INTERVAL 7 DAY GROUP BY 1")
def cost_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cost.within(views.cost(spark, sf_dir), COST_NOW, periods.parse_duration("7d")).groupBy("stage").agg(F.count("*").alias("calls"))


@query(f"WITH {COST_SQL} SELECT stage, session, max_by(event_id, ts::VARCHAR || lpad(event_id::VARCHAR, 12, '0')) AS event_id FROM cost GROUP BY 1, 2")
def latest_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cost.latest(views.cost(spark, sf_dir), ["stage", "session"]).select("stage", "session", "event_id")


@query(f"WITH {COST_SQL} SELECT strftime(date_trunc('week', ts), '%Y-%m-%d') AS week, stage, provider, count(*) AS calls, CAST(sum(input_tokens) AS BIGINT) AS input_tokens FROM cost GROUP BY 1, 2, 3")
def cost_weeks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cost.windows(views.cost(spark, sf_dir))


@query(f"WITH {_PRICED}, t AS (SELECT key, round(usd, 6) AS r FROM report) SELECT key, CASE WHEN r <= 0 THEN '$0' WHEN r < 0.01 THEN printf('$%.4f', r) WHEN r < 1 THEN printf('$%.3f', r) ELSE printf('$%.2f', r) END AS label FROM t")
def usd_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cost.report(_priced(spark, sf_dir)).select("key", T.usd(F.round("usd", 6)).alias("label"))


def _sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.notes(spark, sf_dir).select("path", F.sha2("content", 256).alias("hash"), "doc_id")


def _seen(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What was processed before: two of three documents."""
    return _sources(spark, sf_dir).filter(F.col("doc_id") % 3 != 0).select("path", "hash")


@query(f"WITH {NOTES_SQL} SELECT path, sha256(content) AS hash, doc_id FROM notes WHERE doc_id % 3 = 0 OR doc_id % 5 = 0")
def incremental_new(spark: SparkSession, sf_dir: str) -> DataFrame:
    stale = _sources(spark, sf_dir).filter(F.col("doc_id") % 3 != 0).select("path", F.when(F.col("doc_id") % 5 == 0, "old").otherwise(F.col("hash")).alias("hash"))
    return state.unprocessed(_sources(spark, sf_dir), stale).select("path", "hash", "doc_id")


@query(f"WITH {NOTES_SQL}, {_DISTILLED} SELECT session_id FROM distilled WHERE NOT embedded")
def unembedded_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = notes.distilled(views.notes(spark, sf_dir))
    return n.join(n.filter("embedded").select("session_id"), "session_id", "left_anti").select("session_id")


@query(f"""WITH {NOTES_SQL}, o AS (SELECT path, 'old' AS hash, topic, category, archived FROM notes WHERE doc_id % 3 <> 0), n AS (SELECT path, sha256(content) AS hash, CASE WHEN doc_id % 2 = 0 THEN topic || '!' END AS topic, category FROM notes WHERE doc_id % 5 <> 0)
 SELECT coalesce(o.path, n.path) AS path, CASE WHEN n.path IS NOT NULL THEN n.hash ELSE o.hash END AS hash, coalesce(n.topic, o.topic) AS topic, coalesce(n.category, o.category) AS category, o.archived FROM o FULL JOIN n ON o.path = n.path""")
def session_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = views.notes(spark, sf_dir)
    old = rows.filter("doc_id % 3 <> 0").select("path", F.lit("old").alias("hash"), "topic", "category", "archived")
    new = rows.filter("doc_id % 5 <> 0").select("path", F.sha2("content", 256).alias("hash"), F.when(F.col("doc_id") % 2 == 0, F.concat("topic", F.lit("!"))).alias("topic"), "category", F.lit(2).alias("n"))
    twice = new.unionByName(new.withColumn("hash", F.lit("earlier")).withColumn("n", F.lit(1)))
    return state.upsert(old, twice, "path", coalesced=["topic", "category"], order="n")


@query("""WITH o AS (SELECT item_id AS id, 'a' AS content, 1 AS created FROM benchmark WHERE item_id % 2 = 0), n AS (SELECT item_id AS id, text AS content, 2 AS created FROM benchmark WHERE item_id % 3 = 0 OR item_id % 2 = 1)
 SELECT coalesce(o.id, n.id) AS id, CASE WHEN n.id IS NOT NULL THEN n.content ELSE o.content END AS content, coalesce(o.created, n.created) AS created FROM o FULL JOIN n ON o.id = n.id""")
def topic_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = table(spark, sf_dir, "benchmark")
    old = b.filter("item_id % 2 = 0").select(F.col("item_id").alias("id"), F.lit("a").alias("content"), F.lit(1).alias("created"))
    new = b.filter("item_id % 3 = 0 or item_id % 2 = 1").select(F.col("item_id").alias("id"), F.col("text").alias("content"), F.lit(2).alias("created"))
    return state.upsert(old, new, "id", kept=["created"])


@query(f"WITH {NOTES_SQL} SELECT path, {_k('topic')} AS slug FROM notes")
def kebab_slug(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.notes(spark, sf_dir).select("path", T.kebab(F.col("topic")).alias("slug"))


@query(f"WITH {NOTES_SQL} SELECT path, CASE WHEN left({_k('topic')}, 50) <> '' THEN left({_k('topic')}, 50) || '-' || left(session_id, 8) ELSE 'note-' || left(session_id, 8) END AS slug FROM notes")
def note_slug(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.notes(spark, sf_dir).select("path", T.note_slug(F.col("topic"), F.col("session_id")).alias("slug"))


_TITLE = "regexp_extract(html, '<title>([^<]*)</title>', 1)"


@query(f"SELECT page_id, CASE WHEN left({_k(_TITLE)}, 60) <> '' THEN left({_k(_TITLE)}, 60) || '-' ELSE '' END || left(sha256(url), 8) AS slug, coalesce(nullif(regexp_replace(left({_k(_TITLE)}, 60), '-+$', ''), ''), 'topic') AS topic FROM pages")
def article_slug(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "pages").withColumn("title", F.regexp_extract("html", "<title>([^<]*)</title>", 1))
    return p.select("page_id", T.source_slug(F.col("title"), F.col("url"), F.lit("")).alias("slug"), T.compose_slug(F.col("title")).alias("topic"))


def _scrub_sql(c: str) -> str:
    steps = [(r"(^|[^A-Za-z0-9-])sk-ant-[A-Za-z0-9_-]{20,}", r"\1[REDACTED_ANTHROPIC_KEY]"), (r"(^|[^A-Za-z0-9-])sk-(?:proj-)?[A-Za-z0-9_-]{20,}", r"\1[REDACTED_OPENAI_KEY]")]
    for pattern, put in [*steps, *T.REDACTIONS[2:], ("/root", "~"), (r"/Users/(?:[^\s\"''`)\]]*/)?([^\s\"''`)\]/]+)/*", r"~/\1")]:
        c = f"regexp_replace({c}, '{pattern}', '{put}', 'g')"
    return c


@query(f"SELECT doc_id, md5({_scrub_sql('text')}) AS scrubbed, count(*) OVER () AS n FROM documents")
def scrub_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", F.md5(T.scrub(F.col("text"))).alias("scrubbed")).join(F.broadcast(d.agg(F.count("*").alias("n"))))


def _markdown_sql(c: str) -> str:
    for pattern, put in T.MARKDOWN:
        c = f"regexp_replace({c}, '{pattern}', '{put.replace('$1', chr(92) + '1')}', 'g')".replace("\n", "")
    return c.replace("'^---\\n", "'\\A---\\n")


@query(f"SELECT doc_id, md5({_markdown_sql('text')}) AS stripped FROM documents")
def strip_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(T.strip_markdown(F.col("text"))).alias("stripped"))


_TOKENS = "list_filter(regexp_split_to_array(lower({}), '\\W+'), lambda t: length(t) >= 3)"


@query(f"SELECT doc_id, len({_TOKENS.format('text')}) AS n, md5(array_to_string({_TOKENS.format('text')}, ' ')) AS tokens FROM documents")
def tokenize_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = T.tokenize(F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", F.size(t).cast("long").alias("n"), F.md5(F.array_join(t, " ")).alias("tokens"))


@query("SELECT doc_id, CAST(ceil(length(text) / 4.0) AS BIGINT) AS tokens, CAST(ceil(length(text) / 3.0) AS BIGINT) AS cautious FROM documents")
def token_estimate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", T.token_estimate(F.col("text")).alias("tokens"), T.token_estimate(F.col("text"), 3).alias("cautious"))


@query("SELECT doc_id, left(trim(regexp_replace(text, '\\s+', ' ', 'g')), 200) AS preview, CASE WHEN length(text) > 1000 THEN left(text, 1000) || '…[truncated ' || (length(text) - 1000) || ' chars]' ELSE text END AS short FROM documents")
def preview(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", T.preview(F.col("text")).alias("preview"), T.truncate(F.col("text"), 1000).alias("short"))


@query(f"SELECT 'raw/' || page_id || '.md' AS path, {_TITLE} AS title, url AS source, CAST(page_id AS VARCHAR) AS page, len(regexp_split_to_array(trim(regexp_replace(regexp_replace('# ' || {_TITLE} || ' ' || html, '<[^>]*>', ' ', 'g'), '[ \\t\\n\\r]+', ' ', 'g')), ' ')) AS words FROM pages")
def article_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = views.articles(spark, sf_dir).withColumn("fm", T.frontmatter(F.col("content")))
    text = F.trim(F.regexp_replace(T.body(F.col("content")), "[ \\t\\n\\r]+", " "))
    return a.select("path", F.col("fm")["title"].alias("title"), F.col("fm")["source"].alias("source"), F.col("fm")["page"].alias("page"), F.size(F.split(text, " ")).cast("long").alias("words"))


@query(f"WITH {ARTICLES_SQL} SELECT path, md5(replace(content, chr(10) || 'page: ' || page_id || chr(10) || '---', chr(10) || 'page: 0' || chr(10) || 'verified: true' || chr(10) || '---')) AS content, true AS verified FROM articles")
def frontmatter_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    changed = T.set_frontmatter(F.col("content"), [("page", F.lit("0")), ("verified", F.lit("true"))])
    return views.articles(spark, sf_dir).select("path", F.md5(changed).alias("content"), T.is_verified(changed).alias("verified"))


@query(f"WITH {NOTES_SQL} SELECT path, CASE WHEN category = 'decision' OR length(content) > 2000 THEN 'smart' ELSE 'fast' END AS model FROM notes")
def model_routing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return notes.route_model(views.notes(spark, sf_dir).withColumn("tokens", F.length("content")), "fast", "smart", 2000).select("path", "model")


@query(f"SELECT CAST(user_id AS VARCHAR) AS user_id, CASE WHEN epoch(TIMESTAMP '{COST_NOW}') - epoch(date_trunc('second', max(ts))) <= 2 * 24 * 3600 THEN 'ok' ELSE 'stale' END AS health FROM events GROUP BY 1")
def source_freshness(spark: SparkSession, sf_dir: str) -> DataFrame:
    seen = table(spark, sf_dir, "events").groupBy(F.col("user_id").cast("string").alias("user_id")).agg(F.max("ts").alias("last_seen"))
    return notes.freshness(seen, COST_NOW, 24).select("user_id", "health")


@query(f"WITH {NOTES_SQL}, {_DISTILLED} SELECT path FROM distilled WHERE started_at >= TIMESTAMP '2024-06-01' AND started_at < TIMESTAMP '2024-07-01'")
def period_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periods.in_period(notes.distilled(views.notes(spark, sf_dir)), "2024-06-01", "2024-07-01").select("path")


@query(f"""WITH {NOTES_SQL}, {_DISTILLED} SELECT printf('week-%d-W%02d', isoyear(started_at), week(started_at)) AS period, strftime(date_trunc('week', started_at), '%Y-%m-%d') AS start, count(*) AS n, {_COUNTS} FROM distilled GROUP BY 1, 2
 UNION ALL SELECT strftime(started_at, 'month-%Y-%m'), strftime(date_trunc('month', started_at), '%Y-%m-%d'), count(*), {_COUNTS} FROM distilled GROUP BY 1, 2""")
def period_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = views.notes(spark, sf_dir)
    return periods.rollup(n).unionByName(periods.rollup(n, "MONTH"))


@query(f"""WITH {NOTES_SQL}, {_DISTILLED}, l AS (SELECT {_k('project')} AS slug, category, string_agg('- ' || topic || ': ' || left(content, 200), chr(10) ORDER BY path) AS lines FROM distilled GROUP BY 1, 2), s AS (SELECT DISTINCT slug FROM l)
 SELECT slug, md5(concat_ws(chr(10) || chr(10), 'patterns:' || chr(10) || coalesce((SELECT lines FROM l WHERE l.slug = s.slug AND category = 'pattern'), '(none)'), 'gotchas:' || chr(10) || coalesce((SELECT lines FROM l WHERE l.slug = s.slug AND category = 'gotcha'), '(none)'), 'decisions:' || chr(10) || coalesce((SELECT lines FROM l WHERE l.slug = s.slug AND category = 'decision'), '(none)'), 'tools:' || chr(10) || coalesce((SELECT lines FROM l WHERE l.slug = s.slug AND category = 'tool'), '(none)'))) AS request FROM s""")
def project_summary_request(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periods.summary_request(views.notes(spark, sf_dir)).withColumn("request", F.md5("request"))


@query(f"WITH {NOTES_SQL}, {_DISTILLED} SELECT {_k('project')} AS slug, count(*) AS n, min_by(project, path) AS name FROM distilled GROUP BY 1 HAVING count(*) >= 3")
def summary_triggers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periods.triggers(views.notes(spark, sf_dir))


@query(f"WITH {NOTES_SQL}, {_DISTILLED} SELECT path, category, strftime(started_at, '%Y-%m-%d') AS date, left(trim(regexp_replace(content, '\\s+', ' ', 'g')), 200) AS summary FROM distilled WHERE started_at >= TIMESTAMP '{NOTES_NOW}' - INTERVAL 90 DAY AND category = 'gotcha' ORDER BY started_at DESC, path LIMIT 20")
def recent_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return notes.recent(views.notes(spark, sf_dir), NOTES_NOW, 90, category="gotcha")


@query(f"WITH {NOTES_SQL}, {_DISTILLED} SELECT path, project, category, strftime(started_at, '%Y-%m-%d') AS date, confidence FROM distilled WHERE NOT verified ORDER BY date DESC, path LIMIT 50")
def review_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    return notes.review_queue(views.notes(spark, sf_dir))


_TOP = f"scoped AS (SELECT '' AS scope, * FROM distilled UNION ALL SELECT project AS scope, * FROM distilled), top AS (SELECT *, category || '/' || {_k('topic')} AS slug, row_number() OVER (PARTITION BY scope, category ORDER BY confidence DESC, path) AS rank FROM scoped QUALIFY rank <= 5)"


@query(f"WITH {NOTES_SQL}, {_DISTILLED}, {_TOP} SELECT scope, category, rank, path, slug FROM top")
def top_per_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    return notes.top_per_category(views.notes(spark, sf_dir)).select("scope", "category", "rank", "path", "slug")


@query(f"WITH {NOTES_SQL}, {_DISTILLED}, {_TOP} SELECT scope, string_agg(CASE WHEN rank = 1 THEN '### ' || upper(left(category, 1)) || category[2:] || 's' || chr(10) ELSE '' END || '- ' || slug || ' (conf ' || printf('%.2f', confidence) || ') — ' || topic, chr(10) ORDER BY CASE category WHEN 'pattern' THEN 1 WHEN 'gotcha' THEN 2 WHEN 'decision' THEN 3 ELSE 4 END, rank) AS block FROM top GROUP BY scope")
def knowledge_block(spark: SparkSession, sf_dir: str) -> DataFrame:
    return notes.knowledge_block(notes.top_per_category(views.notes(spark, sf_dir)))


@query(f"""WITH {NOTES_SQL}, {_DISTILLED}, {_TOP}, o AS (SELECT scope, slug, max_by(confidence - CASE WHEN length(slug) % 2 = 0 THEN 0.1 ELSE 0 END, rank) AS was FROM top WHERE rank <= 3 GROUP BY 1, 2), n AS (SELECT scope, slug, max_by(confidence, rank) AS now FROM top WHERE rank >= 2 GROUP BY 1, 2)
 SELECT coalesce(o.scope, n.scope) AS scope, coalesce(o.slug, n.slug) AS slug, CASE WHEN was IS NULL THEN 'added' WHEN now IS NULL THEN 'removed' WHEN abs(round(was, 2) - now) > 0.05 THEN 'upgraded' ELSE 'unchanged' END AS status FROM o FULL JOIN n ON o.scope = n.scope AND o.slug = n.slug""")
def block_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    top = notes.top_per_category(views.notes(spark, sf_dir))
    old = top.filter("rank <= 3").withColumn("confidence", F.col("confidence") - F.when(F.length("slug") % 2 == 0, 0.1).otherwise(0.0))
    return notes.block_diff(old, top.filter("rank >= 2"))


@query(f"""WITH {NOTES_SQL}, {_DISTILLED}, {ARTICLES_SQL}, r AS (SELECT 'session' AS kind, path, topic, strftime(started_at, '%Y-%m-%d') AS date FROM distilled UNION ALL SELECT 'article', 'raw/' || page_id || '.md', {_TITLE}, '2024-03-01' FROM pages)
 SELECT kind, path, date, '| ' || date || ' | ' || kind || ' | ' || topic || ' |' AS row FROM r""")
def index_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = article_parse(spark, sf_dir).select("path", "title", F.lit("2024-03-01").alias("date"))
    return notes.index_table(views.notes(spark, sf_dir), a)


_PREP = f"""prep AS (SELECT doc_id AS id, {_k('project')} AS project, category, list_filter(string_split({_k('topic')}, '-'), lambda t: length(t) >= 3) AS tokens,
 list_distinct(list_filter(regexp_split_to_array(lower(left(content, 100)), '\\W+'), lambda t: length(t) >= 3 AND t NOT IN ({', '.join(repr(w) for w in hygiene.STOPWORDS)}))) AS words FROM distilled)"""


def _hygiene(spark: SparkSession, sf_dir: str) -> DataFrame:
    return notes.distilled(views.notes(spark, sf_dir)).withColumnRenamed("doc_id", "id")


@query(f"""WITH {NOTES_SQL}, {_DISTILLED}, {_PREP}, p AS (SELECT a.id AS a, b.id AS b, a.project = b.project AND a.category = b.category AS same, len(list_filter(a.tokens, lambda t: list_contains(b.tokens, t))) AS shared, len(list_distinct(list_concat(a.tokens, b.tokens))) AS u, len(list_intersect(a.words, b.words)) AS w FROM prep a JOIN prep b ON a.id < b.id),
 s AS (SELECT a, b, CASE WHEN same AND shared >= 2 THEN 5.0 ELSE 0.0 END + CASE WHEN shared / greatest(u, 1) > 0.7 THEN 4.0 ELSE 0.0 END + CASE WHEN w >= 3 THEN least(3, w - 2) ELSE 0 END + 0.5 * shared AS score FROM p) SELECT a, b, CAST(score AS DOUBLE) AS score FROM s WHERE score > 0 ORDER BY score DESC, a, b LIMIT 30""")
def duplicate_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hygiene.duplicate_pairs(_hygiene(spark, sf_dir))


@query(f"""WITH {NOTES_SQL}, {_DISTILLED}, {_PREP}, p AS (SELECT a.id AS a, b.id AS b, a.project = b.project AND a.category = b.category AS same, len(list_filter(b.tokens, lambda t: list_contains(a.tokens, t))) AS shared FROM prep a JOIN prep b ON a.id < b.id)
 SELECT a, b, CAST(CASE WHEN same THEN 2 ELSE 0 END + shared AS BIGINT) AS score FROM p WHERE same OR shared >= 2 ORDER BY score DESC, a, b LIMIT 20""")
def contradiction_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hygiene.contradiction_pairs(_hygiene(spark, sf_dir))


def _linked(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = _hygiene(spark, sf_dir)
    other = (F.col("id") * 3 % 1000).cast("string")
    link = F.when(F.col("id") % 4 == 0, F.concat(F.lit(" [[notes/"), other, F.lit("|see]]"))).when(F.col("id") % 4 == 1, F.concat(F.lit(" [["), "topic", F.lit("]] [[missing]]"))).otherwise("")
    return n.select(F.col("id").cast("string").alias("id"), "topic", F.concat("content", link).alias("content"))


_LINKS = f"""edges AS (SELECT DISTINCT a.doc_id::VARCHAR AS src, b.doc_id::VARCHAR AS dst FROM distilled a JOIN distilled b ON (a.doc_id % 4 = 0 AND b.doc_id = a.doc_id * 3 % 1000) OR (a.doc_id % 4 = 1 AND b.topic = trim(list_last(string_split(string_split(a.topic, '|')[1], '/')))) WHERE a.doc_id <> b.doc_id)"""


@query(f"WITH {NOTES_SQL}, {_DISTILLED}, {_LINKS} SELECT * FROM edges")
def link_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hygiene.links(_linked(spark, sf_dir))


@query(f"WITH {NOTES_SQL}, {_DISTILLED}, {_LINKS} SELECT doc_id::VARCHAR AS id FROM distilled WHERE doc_id::VARCHAR NOT IN (SELECT src FROM edges UNION SELECT dst FROM edges)")
def orphans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hygiene.orphans(_linked(spark, sf_dir))


@query(f"""WITH {NOTES_SQL}, {_DISTILLED}, a AS (SELECT doc_id AS id, {_k('project')} AS project, category, epoch(TIMESTAMP '{NOTES_NOW}') - epoch(started_at) AS age FROM distilled)
 SELECT id, CAST(floor(age / 86400) AS BIGINT) AS age_days, (SELECT count(*) FROM a b WHERE b.project = a.project AND b.age < a.age) AS newer FROM a WHERE floor(age / 86400) >= 90 AND EXISTS (SELECT 1 FROM a b WHERE b.project = a.project AND b.category = a.category AND b.age < a.age AND b.age <= 30 * 86400)""")
def stale_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hygiene.stale(_hygiene(spark, sf_dir), NOTES_NOW)


_JUDGED = ORACLES["duplicate_pairs"].replace("WITH ", "WITH RECURSIVE ", 1).replace(" SELECT a, b, CAST(score AS DOUBLE) AS score FROM s", ", dup AS (SELECT a, b, CAST(score AS DOUBLE) AS score FROM s") + """),
 told AS (SELECT row_number() OVER (ORDER BY score DESC, a, b) AS n, a, b, ['A', 'B', 'merge'][CAST(a % 3 + 1 AS INT)] AS keep, x.confidence AS ca, y.confidence AS cb FROM dup JOIN distilled x ON x.doc_id = a JOIN distilled y ON y.doc_id = b),
 won AS (SELECT n, keep, CASE WHEN keep = 'B' OR keep = 'merge' AND cb > ca THEN b ELSE a END AS winner, CASE WHEN keep = 'B' OR keep = 'merge' AND cb > ca THEN a ELSE b END AS loser FROM told),
 walk AS (SELECT 0::BIGINT AS n, []::BIGINT[] AS lost, []::BIGINT[] AS counted UNION ALL SELECT w.n, CASE WHEN list_contains(lost, winner) OR list_contains(lost, loser) THEN lost ELSE list_append(lost, loser) END, CASE WHEN list_contains(lost, winner) OR list_contains(lost, loser) THEN counted ELSE list_append(counted, w.n) END FROM walk JOIN won w ON w.n = walk.n + 1),
 judged AS (SELECT * FROM won WHERE list_contains((SELECT counted FROM walk ORDER BY n DESC LIMIT 1), n))"""


def _decided(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Notes, and decisions on their duplicate pairs: every third to keep the one, the other, or both as one."""
    n = _hygiene(spark, sf_dir)
    keep = F.element_at(F.array(F.lit("A"), F.lit("B"), F.lit("merge")), (F.col("a") % 3 + 1).cast("int"))
    told = hygiene.duplicate_pairs(n).withColumn("rank", F.format_string("%012.3f", 1e6 - F.col("score")))
    return n, materialize(told.select(F.concat("rank", F.format_string("-%012d-%012d", "a", "b")).alias("rank"), "a", "b", keep.alias("keep")), "decisions")


@query(f"{_JUDGED} SELECT doc_id AS id, confidence, doc_id IN (SELECT loser FROM judged) OR archived AS archived, coalesce((SELECT string_agg(DISTINCT CAST(loser AS VARCHAR), ',' ORDER BY CAST(loser AS VARCHAR)) FROM judged WHERE winner = doc_id), '') AS beat FROM distilled")
def apply_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, told = _decided(spark, sf_dir)
    return hygiene.apply_decisions(n.select("id", "confidence", "archived"), told)


@query(f"{_JUDGED} SELECT doc_id AS id, md5(coalesce((SELECT max_by('merged ' || winner || '+' || loser, n) FROM judged WHERE winner = doc_id AND keep = 'merge' AND loser % 5 <> 0), content)) AS content FROM distilled")
def merged_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Winners take the merged body, where the model gave one."""
    n, told = _decided(spark, sf_dir)
    counted = hygiene.judged(n, told)
    body = F.when(F.col("loser") % 5 != 0, F.concat(F.lit("merged "), F.col("winner").cast("string"), F.lit("+"), F.col("loser").cast("string"))).otherwise(" ")
    return hygiene.with_merged(n.select("id", "content"), counted, counted.select("winner", "loser", body.alias("body"))).withColumn("content", F.md5("content"))


@query("WITH t AS (SELECT doc_id, unnest(" + _TOKENS.format("text") + ") AS term FROM documents), p AS (SELECT doc_id, term, count(*) AS tf FROM t GROUP BY 1, 2) SELECT term, count(*) AS df, CAST(sum(tf) AS BIGINT) AS total FROM p GROUP BY 1")
def term_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    posted = search.postings(table(spark, sf_dir, "documents"), "doc_id", "text")
    return posted.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("total"))


def _corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    good = table(spark, sf_dir, "labels").filter("quality = 1").select("doc_id", F.lit(True).alias("verified"))
    return table(spark, sf_dir, "documents").join(good, "doc_id", "left").select(F.col("doc_id").alias("doc"), "text", F.coalesce("verified", F.lit(False)).alias("verified"))


_TFIDF = f"""WITH docs AS (SELECT doc_id AS doc, {_TOKENS.format('text')} AS tokens, doc_id IN (SELECT doc_id FROM labels WHERE quality = 1) AS verified FROM documents), t AS (SELECT doc, verified, len(tokens) AS len, unnest(tokens) AS term FROM docs),
 p AS (SELECT doc, verified, len, term, count(*) AS tf FROM t GROUP BY ALL), d AS (SELECT term, ln((SELECT count(*) FROM docs) / count(*)) AS idf FROM p GROUP BY 1), q AS (SELECT DISTINCT item_id AS query, unnest({_TOKENS.format('text')}) AS term FROM benchmark),
 s AS (SELECT query, doc, verified, sum(tf / greatest(1, len) * idf) AS s FROM q JOIN d USING (term) JOIN p USING (term) GROUP BY ALL HAVING sum(tf / greatest(1, len) * idf) > 0), r AS (SELECT query, doc, floor((s + CASE WHEN verified THEN 0.2 ELSE 0 END) * 10000 + 0.5) / 10000 AS score FROM s),
 hits AS (SELECT query, doc, score, row_number() OVER (PARTITION BY query ORDER BY score DESC, doc) AS rank FROM r QUALIFY rank <= 8)"""


@query(f"{_TFIDF} SELECT query, doc, score, rank FROM hits")
def tfidf_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    queries = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query"), "text")
    return search.tfidf(_corpus(spark, sf_dir), queries)


@query(f"{_TFIDF} SELECT query, md5(string_agg('### ' || doc || ' (' || printf('%.4f', score) || ')' || chr(10) || text, chr(10) || '---' || chr(10) ORDER BY rank)) AS context FROM hits JOIN documents ON doc_id = doc GROUP BY 1")
def answer_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("doc"), F.col("doc_id").cast("string").alias("title"), "text")
    return search.context(tfidf_search(spark, sf_dir), docs).withColumn("context", F.md5("context"))


def _vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc"), F.col("embedding").cast("array<double>").alias("vector"))


def _vector_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stated query set: the vectors of one in fifty rows."""
    return _vectors(spark, sf_dir).filter("doc % 50 = 0").withColumnRenamed("doc", "query")


@query("SELECT q.vec_id AS query, c.vec_id AS doc, round(least(1.0, list_cosine_similarity(q.embedding::DOUBLE[], c.embedding::DOUBLE[])), 6) AS score FROM embeddings q JOIN embeddings c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id WHERE list_cosine_similarity(q.embedding::DOUBLE[], c.embedding::DOUBLE[]) >= 0.3")
def vector_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = search.vector_candidates(_vectors(spark, sf_dir), _vector_queries(spark, sf_dir))
    return found.filter("query <> doc").withColumn("score", F.round("score", 6))


_NEAR = """WITH e AS (SELECT vec_id AS doc, embedding::DOUBLE[] AS v FROM embeddings), n AS (SELECT a.doc, list_transform(list_zip(a.v, b.v), lambda x: x[1] + 2 * x[2]) AS v FROM e a JOIN e b ON b.doc = a.doc - a.doc % 4),
 s AS (SELECT q.doc AS query, c.doc AS doc, round(least(1.0, greatest(0.0, list_cosine_similarity(q.v, c.v))), 12) AS score FROM n q JOIN n c ON q.doc <> c.doc)"""


@query(f"{_NEAR} SELECT query, doc, round(score, 6) AS score, row_number() OVER (PARTITION BY query ORDER BY score DESC, doc) AS rank FROM s WHERE score >= 0.6 QUALIFY rank <= 5")
def neighbour_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nearest neighbours of every vector. Vectors of notes: each embedding plus twice that of the first of its four, so that
    some are near."""
    v = _vectors(spark, sf_dir)
    firsts = v.select(F.col("doc").alias("first"), F.col("vector").alias("other"))
    near = v.join(firsts, F.col("doc") - F.col("doc") % 4 == F.col("first")).select("doc", F.zip_with("vector", "other", lambda x, y: x + 2 * y).alias("vector"))
    return knn.neighbours(near, 5, 0.6).withColumn("score", F.round("score", 6))


def mmr_sql(pool: str, k: int = 8, relevance: float = 0.7) -> str:
    """Tables ``picks`` (query, n, chosen) and ``mmr`` (query, layer, doc, score, rank) over ``pool`` (query, layer, doc, score, v)."""
    return f"""pool AS ({pool}), sizes AS (SELECT query, count(*) AS size FROM pool GROUP BY 1),
 picks AS (SELECT query, 1 AS n, [first({{'layer': layer, 'doc': doc, 'score': score, 'v': v}} ORDER BY score DESC, layer, doc)] AS chosen FROM pool JOIN sizes USING (query) WHERE size > {k} GROUP BY query UNION ALL
  SELECT query, n + 1, list_append(chosen, pick) FROM (SELECT query, n, chosen, first({{'layer': layer, 'doc': doc, 'score': score, 'v': v}} ORDER BY {relevance} * score - {1 - relevance:.1f} * list_max(list_transform(chosen, lambda c: greatest(0.0, least(1.0, list_cosine_similarity(c.v, v))))) DESC, score DESC, layer, doc) AS pick
   FROM picks JOIN pool USING (query) WHERE n < {k} AND NOT list_contains(list_transform(chosen, lambda c: c.layer || '/' || c.doc), layer || '/' || doc) GROUP BY query, n, chosen)),
 mmr AS (SELECT query, chosen[n].layer AS layer, chosen[n].doc AS doc, floor(chosen[n].score * 10000 + 0.5) / 10000 AS score, CAST(n AS BIGINT) AS rank FROM picks
  UNION ALL SELECT query, layer, doc, floor(score * 10000 + 0.5) / 10000, row_number() OVER (PARTITION BY query ORDER BY score DESC, layer, doc) FROM pool JOIN sizes USING (query) WHERE size <= {k})"""


_POOL_SQL = mmr_sql("SELECT q.vec_id AS query, '' AS layer, c.vec_id AS doc, least(1.0, list_cosine_similarity(q.embedding::DOUBLE[], c.embedding::DOUBLE[])) AS score, c.embedding::DOUBLE[] AS v FROM embeddings q JOIN embeddings c ON q.vec_id % 50 = 0 WHERE list_cosine_similarity(q.embedding::DOUBLE[], c.embedding::DOUBLE[]) >= 0.3")


@query(f"WITH RECURSIVE {_POOL_SQL} SELECT query, doc, score, rank FROM mmr")
def mmr_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    corpus = _vectors(spark, sf_dir).select(F.lit("").alias("layer"), "doc", "vector", F.lit(0.0).alias("bonus"))
    return search.diversified(corpus, _vector_queries(spark, sf_dir)).drop("layer")


@query(f"WITH RECURSIVE {_POOL_SQL}, {_TFIDF.removeprefix('WITH ')} SELECT query, doc, score, rank, 'embedding' AS method FROM mmr UNION ALL SELECT query, doc, score, rank, 'tfidf' FROM hits WHERE query NOT IN (SELECT query FROM mmr)")
def hybrid_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.hybrid(mmr_search(spark, sf_dir), tfidf_search(spark, sf_dir).select("query", "doc", "score", "rank"))


@query("SELECT 'embeddings' AS layer, CAST(vec_id AS VARCHAR) AS id, len(embedding) AS dims FROM embeddings UNION ALL SELECT 'topics', CAST(vec_id AS VARCHAR), len(embedding) FROM embeddings WHERE label = 0")
def embedding_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = table(spark, sf_dir, "embeddings").select("vec_id", "label", F.to_json("embedding").alias("json"))
    pool = text.select(F.lit("embeddings").alias("layer"), "vec_id", "json").unionByName(text.filter("label = 0").select(F.lit("topics").alias("layer"), "vec_id", "json"))
    v = F.from_json("json", "array<double>")
    return pool.select("layer", F.col("vec_id").cast("string").alias("id"), v.alias("v")).filter(F.col("v").isNotNull() & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x))).select("layer", "id", F.size("v").cast("long").alias("dims"))


@query(f"WITH {TOOLS_SQL} SELECT path, line, CASE WHEN kind = 'tool_use' THEN name ELSE coalesce((SELECT max_by(u.name, u.line) FROM tools u WHERE u.path = t.path AND u.tool_id = t.tool_id AND u.line < t.line AND u.kind = 'tool_use'), 'unknown') END AS tool FROM tools t")
def tool_name_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sessions.resolve_tools(views.tool_blocks(spark, sf_dir)).select("path", "line", "tool")


@query(f"""WITH {TOOLS_SQL}, r AS (SELECT *, coalesce((SELECT max_by(u.name, u.line) FROM tools u WHERE u.path = t.path AND u.tool_id = t.tool_id AND u.line < t.line AND u.kind = 'tool_use'), 'unknown') AS tool, CASE WHEN content = '' THEN 0 ELSE line % 70 END AS n FROM tools t WHERE kind = 'tool_result')
 SELECT path, line, tool IN ('Bash', 'Read', 'Grep', 'Glob') AND NOT is_error AND n > 50 AS stripped, CASE WHEN tool IN ('Bash', 'Read', 'Grep', 'Glob') AND NOT is_error AND n > 50 THEN '[tool_result: ' || tool || '] [' || n || ' lines stripped]' ELSE '[tool_result: ' || tool || CASE WHEN is_error THEN ' ERROR' ELSE '' END || ']' || chr(10) || content || chr(10) || '[/tool_result]' END AS rendered FROM r""")
def tool_result_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    results = sessions.resolve_tools(views.tool_blocks(spark, sf_dir)).filter("kind = 'tool_result'")
    return sessions.bounded_results(results).select("path", "line", "stripped", "rendered")


def _turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("session"), "turn", "role", "text")


@query("SELECT conv_id AS session, count(*) AS line_count, coalesce(string_agg(text, chr(10) || chr(10) ORDER BY turn, text) FILTER (role = 'assistant'), '') AS assistant_text, coalesce(string_agg(text, chr(10) || chr(10) ORDER BY turn, text) FILTER (role = 'user'), '') AS user_text, string_agg(text, chr(10) || chr(10) ORDER BY turn, role, text) AS transcript FROM conversations GROUP BY 1")
def session_assembly(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sessions.assemble(_turns(spark, sf_dir))


@query("""WITH s AS (SELECT conv_id AS session, count(*) AS n, coalesce(string_agg(text, ' ') FILTER (role IN ('assistant', 'user')), '') AS t FROM conversations GROUP BY 1), p AS (SELECT session, CASE WHEN n * 10 > 50 THEN 0.3::DOUBLE ELSE 0 END AS a, CASE WHEN n > 5 THEN 0.3::DOUBLE ELSE 0 END AS b, CASE WHEN n > 2 THEN 0.2::DOUBLE ELSE 0 END AS c, CASE WHEN regexp_matches(t, '(?i)\\b(error|fixed|bug|learned|gotcha|workaround|fixed it|root cause)\\b') THEN 0.2::DOUBLE ELSE 0 END AS d FROM s)
 SELECT session, floor((a + b + c + d) * 100 + 0.5) / 100 AS score, a + b + c + d >= 0.4 AS passes FROM p""")
def signal_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sessions.assemble(_turns(spark, sf_dir)).withColumn("tool_calls", F.col("line_count")).withColumn("files", F.array_repeat(F.lit("f"), F.col("line_count").cast("int"))).withColumn("line_count", F.col("line_count") * 10)
    return notes.signal_score(rows).select("session", "score", "passes")


@query("SELECT CAST(user_id AS VARCHAR) AS path, strftime(min_by(ts, event_id), '%Y-%m-%d %H:%M:%S') AS first, strftime(max_by(ts, event_id), '%Y-%m-%d %H:%M:%S') AS last FROM events GROUP BY 1")
def first_last_event(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("path"), F.col("event_id").alias("line"), "ts")
    return sessions.first_last(rows).select("path", F.date_format("first", "yyyy-MM-dd HH:mm:ss").alias("first"), F.date_format("last", "yyyy-MM-dd HH:mm:ss").alias("last"))


@query(f"""WITH {NOTES_SQL}, {_DISTILLED} SELECT category, category || 's/' || left({_k('topic')}, 50) || '-' || left(session_id, 8) || '.md' AS rel_path,
 md5('---' || chr(10) || 'topic: "' || replace(topic, '"', '\\"') || '"' || chr(10) || 'category: ' || category || chr(10) || 'project: ' || project || chr(10) || 'session_id: ' || session_id || chr(10) || 'date: ' || strftime(started_at, '%Y-%m-%d') || chr(10) || 'confidence: ' || printf('%.2f', confidence) || CASE WHEN verified THEN chr(10) || 'verified: true' ELSE '' END || chr(10) || '---' || chr(10) || chr(10) || '# ' || topic || chr(10) || chr(10) || content) AS content FROM distilled""")
def note_render(spark: SparkSession, sf_dir: str) -> DataFrame:
    return notes.render(notes.distilled(views.notes(spark, sf_dir))).withColumn("content", F.md5("content"))
