"""Further registered queries: whole transcripts, hits for clients, reviews, replies, state of all layers, files, streams."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import replies
from ..functions import text as T
from ..operators import cost, hits, notes, pages, requests, search, sessions, state
from ..sources import files, views
from ..sources.notes_sink import write_line_files
from ..sources.scratch import scratch_path
from ..sources.views import ARTICLES_SQL, NOTES_SQL, PAGES_SQL, TRANSCRIPTS_SQL, table
from ..streaming import jobs
from .catalogue import _DISTILLED, _PRICED, _TFIDF, ORACLES, QUERIES, _corpus, _k, _priced, _scrub_sql, _vectors, mmr_sql, query

#: The form of ``session_assembly`` over plain turns stays registered.
for _of in (QUERIES, ORACLES):
    _of["session_texts"] = _of.pop("session_assembly")


def _sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = views.transcripts(spark, sf_dir)
    stamped = lines.select("path", "line", F.try_variant_get("event", "$.timestamp", "string").alias("ts"))
    return sessions.assembled(stamped, files.transcript_blocks(lines))


@query(f"""WITH {TRANSCRIPTS_SQL} SELECT path, CAST(conv_id AS VARCHAR) AS session, 'c' || conv_id % 5 AS project, started_at, ended_at, line_count, tool_calls, files, md5(assistant_text) AS assistant_text, md5(user_text) AS user_text, md5(transcript) AS transcript, md5(raw_summary) AS raw_summary FROM transcripts""")
def session_assembly(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = {c: F.md5(c) for c in ("assistant_text", "user_text", "transcript", "raw_summary")}
    return _sessions(spark, sf_dir).withColumns({"files": F.array_join("files", "\n")} | texts)


_GATE = "CASE WHEN line_count > 50 THEN 0.3::DOUBLE ELSE 0 END + CASE WHEN tool_calls > 5 THEN 0.3::DOUBLE ELSE 0 END + CASE WHEN n_files > 2 THEN 0.2::DOUBLE ELSE 0 END + CASE WHEN regexp_matches(assistant_text || ' ' || user_text, '(?i)\\b(error|fixed|bug|learned|gotcha|workaround|fixed it|root cause)\\b') THEN 0.2::DOUBLE ELSE 0 END"


@query(f"WITH {TRANSCRIPTS_SQL} SELECT path, floor(({_GATE}) * 100 + 0.5) / 100 AS score, {_GATE} >= 0.4 AS passes FROM transcripts")
def transcript_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return notes.signal_score(_sessions(spark, sf_dir)).select("path", "score", "passes")


_CALL = "ceil(length({}) / 3.0) / 1e6 * 0.28 + {} / 1e6 * 1.4"


@query(f"""WITH {TRANSCRIPTS_SQL}, e AS (SELECT {_GATE} >= 0.4 AS passes, {_CALL.format(_scrub_sql('raw_summary'), 350)} + {_CALL.format(_scrub_sql('transcript'), 4500)} AS usd FROM transcripts WHERE conv_id % 3 <> 0)
 SELECT count(*) FILTER (passes) AS sessions, count(*) FILTER (NOT passes) AS filtered_out, round(coalesce(sum(usd) FILTER (passes), 0), 6) AS usd FROM e""")
def cost_preview(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions but those of every third conversation are new."""
    fresh = _sessions(spark, sf_dir).filter(F.col("session").cast("long") % 3 != 0)
    model = cost.PRICES[2][1]
    return cost.preview(notes.signal_score(fresh), cost.prices(spark), model, model, "kie")


@query(f"""WITH {NOTES_SQL}, {_PRICED}, t AS (SELECT path, session_id AS session FROM notes WHERE NOT skipped AND (doc_id % 9 = 0 OR content = '')), d AS (SELECT DISTINCT lpad(session, 8, '0') AS session FROM priced WHERE event_id % 3 = 1 AND session IS NOT NULL AND usd > 0)
 SELECT path, session, session IN (SELECT session FROM d) AS paid FROM t""")
def reconcile_collateral(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = views.notes(spark, sf_dir)
    targets = notes.reconcile_targets(n.withColumn("content", F.when(F.col("doc_id") % 9 == 0, "").otherwise(F.col("content")))).select("path", F.col("session_id").alias("session"))
    calls = _priced(spark, sf_dir).select(F.lpad("session", 8, "0").alias("session"), F.when(F.col("event_id") % 3 == 1, "distill").otherwise("classify").alias("stage"), "usd")
    return cost.collateral(targets, calls)


@query(f"""WITH {ARTICLES_SQL}, o AS (SELECT path, 'old' AS hash, 'concept' AS category, md5(content) AS content, CASE WHEN page_id % 4 = 0 THEN 'n' || page_id END AS note_path FROM articles WHERE page_id % 3 <> 0), n AS (SELECT path, sha256(content) AS hash, CASE WHEN page_id % 2 = 0 THEN 'opinion' END AS category, CASE WHEN page_id % 5 <> 0 THEN 'fresh' END AS content, CASE WHEN page_id % 7 = 0 THEN 'm' || page_id END AS note_path FROM articles WHERE page_id % 10 <> 9)
 SELECT coalesce(o.path, n.path) AS path, CASE WHEN n.path IS NOT NULL THEN n.hash ELSE o.hash END AS hash, coalesce(n.category, o.category) AS category, coalesce(n.content, o.content) AS content, coalesce(n.note_path, o.note_path) AS note_path FROM o FULL JOIN n ON o.path = n.path""")
def article_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, p = views.articles(spark, sf_dir), F.col("page_id")
    old = a.filter(p % 3 != 0).select("path", F.lit("old").alias("hash"), F.lit("concept").alias("category"), F.md5("content").alias("content"), F.when(p % 4 == 0, F.concat(F.lit("n"), p.cast("string"))).alias("note_path"))
    new = a.filter(p % 10 != 9).select("path", F.sha2("content", 256).alias("hash"), F.when(p % 2 == 0, "opinion").alias("category"), F.when(p % 5 != 0, "fresh").alias("content"), F.when(p % 7 == 0, F.concat(F.lit("m"), p.cast("string"))).alias("note_path"))
    return state.put("articles", old, new)


@query("SELECT d.doc_id, coalesce(len(e.embedding), CASE WHEN d.doc_id % 2 = 0 THEN 1 ELSE 0 END) AS dims, e.vec_id IS NOT NULL AS fresh FROM documents d LEFT JOIN embeddings e ON e.vec_id = d.doc_id AND e.vec_id % 5 <> 0")
def store_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("doc_id", F.when(F.col("doc_id") % 2 == 0, F.array(F.lit(0.5))).alias("embedding"))
    vectors = _vectors(spark, sf_dir).select(F.col("doc").alias("doc_id"), F.when(F.col("doc") % 5 != 0, F.col("vector")).alias("embedding"))
    stored = state.store_vectors(rows, vectors, "doc_id")
    size = F.coalesce(F.size("embedding"), F.lit(0))
    return stored.select("doc_id", F.greatest(F.lit(0), size).cast("long").alias("dims"), (size > 1).alias("fresh"))


_META = """CASE kind WHEN 'session' THEN 'T' || doc % 50 WHEN 'topic' THEN 'P' || doc ELSE 'S: ' || doc END AS topic, CASE kind WHEN 'session' THEN cat WHEN 'topic' THEN 'topic' WHEN 'article' THEN 'concept' ELSE '' END AS category,
 CASE kind WHEN 'session' THEN coalesce(project, '') WHEN 'article' THEN 'A' || doc % 7 ELSE '' END AS project, kind AS type, CASE WHEN kind = 'article' THEN 'http://x/' || doc END AS url"""


@query(f"WITH {PAGES_SQL}, m AS (SELECT doc, {_META} FROM vault) SELECT v.path, CASE WHEN kind = 'session' THEN cat ELSE kind END AS wire, m.* EXCLUDE (doc) FROM vault v JOIN m ON v.doc = m.doc")
def wire_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = views.pages_of_notes(spark, sf_dir).withColumn("front", T.frontmatter(F.col("content")))
    return rows.select("path", hits.wire_category(F.col("front"), F.col("path")).alias("wire"), hits.metadata(F.col("front"), F.regexp_replace("path", "\\.md$", "")).alias("m")).select("path", "wire", "m.*")


def _text_hits(spark: SparkSession, sf_dir: str, k: int) -> DataFrame:
    queries = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query"), "text")
    rows = views.pages_of_notes(spark, sf_dir).select("doc", "path", F.regexp_replace("path", "\\.md$", "").alias("title"), "content")
    return search.tfidf(_corpus(spark, sf_dir), queries, k).join(rows, "doc")


_TFIDF_25 = _TFIDF.replace("rank <= 8", "rank <= 25")


@query(f"{_TFIDF_25}, {PAGES_SQL}, f AS (SELECT query, doc, score, row_number() OVER (PARTITION BY query ORDER BY rank) AS rank FROM hits JOIN vault USING (doc) WHERE kind = 'session' AND vault.verified) SELECT * FROM f WHERE rank <= 5")
def filtered_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _text_hits(spark, sf_dir, hits.fetch_size(5, True))
    return hits.filtered(found, 5, kind="session", verified=True).select("query", "doc", "score", "rank")


@query(f"{_TFIDF}, {PAGES_SQL} SELECT query, rank, path, score, CASE WHEN kind = 'session' THEN cat ELSE kind END AS category, confidence, preview, project, date FROM hits JOIN vault USING (doc)")
def query_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hits.results(_text_hits(spark, sf_dir, 8))


@query(f"{_TFIDF}, {PAGES_SQL} SELECT query AS query_id, count(*) AS n, md5(string_agg('### ' || left(path, length(path) - 3) || ' (' || printf('%.4f', score) || ')' || chr(10) || chr(10) || trim(text, ' '), chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY rank)) AS sources FROM hits JOIN vault USING (doc) WHERE kind <> 'topic' GROUP BY 1")
def compose_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _text_hits(spark, sf_dir, 8).withColumnsRenamed({"query": "query_id", "path": "rel_path"})
    return pages.compose_sources(found).withColumn("sources", F.md5("sources"))


@query(f"""WITH p AS (SELECT DISTINCT source AS name FROM documents UNION SELECT 'No Such ' || source FROM documents), s AS (SELECT {_k('source')} AS slug, max(text) AS content FROM documents GROUP BY 1)
 SELECT name, {_k('name')} AS slug, md5(content) AS content, CASE WHEN content IS NULL THEN 'not generated yet: ' || {_k('name')} END AS hint FROM p LEFT JOIN s ON s.slug = {_k('name')}""")
def page_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    names = d.select(F.explode(F.array("source", F.concat(F.lit("No Such "), "source"))).alias("name")).distinct()
    made = d.groupBy(T.kebab(F.col("source")).alias("slug")).agg(F.max("text").alias("content"))
    return pages.look_up(names, made).select("name", "slug", F.md5("content").alias("content"), "hint")


@query("""SELECT title, category, url, author, published, confidence FROM (SELECT regexp_extract(html, '<title>([^<]*)</title>', 1) AS title, ['concept', 'technique'][CAST(page_id % 2 + 1 AS INT)] AS category, url, 'a' || page_id % 9 AS author, CASE WHEN page_id % 3 <> 0 THEN strftime(DATE '2024-01-01' + CAST(page_id % 300 AS INT), '%Y-%m-%d') END AS published, CASE WHEN page_id % 4 = 0 THEN '2024-05-05' END AS distilled_at, page_id / 1e6::DOUBLE AS confidence, 'raw/' || page_id || '.md' AS path FROM pages WHERE page_id % 7 <> 0 AND page_id % 11 <> 0)
 WHERE coalesce(published, distilled_at, '1970-01-01') >= '2024-02-01' ORDER BY coalesce(published, distilled_at, '1970-01-01') DESC, path LIMIT 20""")
def recent_articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = F.col("page_id")
    day = F.date_format(F.date_add(F.lit("2024-01-01").cast("date"), (p % 300).cast("int")), "yyyy-MM-dd")
    rows = views.articles(spark, sf_dir).join(table(spark, sf_dir, "pages").select("page_id", "url", "html"), "page_id").select(
        "path", F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title"), F.element_at(F.array(F.lit("concept"), F.lit("technique")), (p % 2 + 1).cast("int")).alias("category"), "url", F.concat(F.lit("a"), (p % 9).cast("string")).alias("author"),
        F.when(p % 3 != 0, day).alias("published"), F.when(p % 4 == 0, "2024-05-05").alias("distilled_at"), (p / 1e6).alias("confidence"), (p % 7 == 0).alias("skipped"), F.when(p % 11 == 0, "boom").alias("error"), "content",
    )
    return pages.recent_articles(rows, since="2024-02-01", limit=20).drop("summary")


@query(f"WITH {ARTICLES_SQL} SELECT path FROM articles WHERE page_id % 7 <> 0 AND page_id % 11 <> 0 AND page_id % 5 <> 0")
def article_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = F.col("page_id")
    rows = views.articles(spark, sf_dir).select("path", F.when(p % 5 != 0, F.col("content")).alias("content"), F.when(p % 7 == 0, True).alias("skipped"), F.when(p % 11 == 0, "boom").alias("error"))
    return pages.usable_sources(rows).select("path")


_FENCE = "chr(10) || '---' || chr(10)"


@query(f"""WITH {ARTICLES_SQL}, x AS (SELECT path, content, page_id, 'page: ' || page_id || {_FENCE} AS was FROM articles)
 SELECT CASE WHEN page_id % 3 = 1 THEN '.rejected/' || page_id || '.md' ELSE path END AS rel_path, md5(replace(content, was, CASE page_id % 3 WHEN 0 THEN 'page: ' || page_id || chr(10) || 'verified: true' || chr(10) || 'reviewed_at: 2025-01-01' || {_FENCE} WHEN 1 THEN 'page: ' || page_id || chr(10) || 'rejected_at: 2025-01-01' || {_FENCE} ELSE was END)) AS content FROM x""")
def apply_review(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = views.articles(spark, sf_dir).withColumnRenamed("path", "rel_path")
    told = a.filter("page_id % 3 < 2").select("rel_path", F.when(F.col("page_id") % 3 == 0, "approve").otherwise("reject").alias("decision"))
    both = told.unionByName(told.filter("decision = 'reject'").withColumn("decision", F.lit("approve")))
    return pages.apply_reviews(a.select("rel_path", "content"), both, "2025-01-01").select("rel_path", F.md5("content").alias("content"))


@query(f"""WITH s AS (SELECT {_k('source')} AS slug, count(*) AS n, string_agg('- ' || doc_id, chr(10) ORDER BY doc_id) FILTER (doc_id % 50 = 0) AS old FROM documents GROUP BY 1)
 SELECT slug, md5('# ' || slug || chr(10) || chr(10) || '---' || chr(10) || '## Changelog' || chr(10) || chr(10) || '- now ' || n || coalesce(chr(10) || old, '') || chr(10)) AS content FROM s""")
def project_changelog(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select(T.kebab(F.col("source")).alias("slug"), "doc_id")
    listed = F.array_sort(F.collect_list(F.when(F.col("doc_id") % 50 == 0, F.col("doc_id"))))
    kept = d.groupBy("slug").agg(listed.alias("ids")).select("slug", F.concat(F.lit("old text\n\n---\n## Changelog\n\n"), F.array_join(F.transform("ids", lambda x: F.concat(F.lit("- "), x.cast("string"))), "\n\n"), F.lit("\n")).alias("content"))
    fresh = d.groupBy("slug").agg(F.count("*").alias("n")).select("slug", F.concat(F.lit("# "), "slug").alias("body"), F.concat(F.lit("- now "), F.col("n").cast("string")).alias("entry"))
    return pages.with_changelog(fresh, kept).withColumn("content", F.md5("content"))


@query(f"WITH {NOTES_SQL} SELECT doc_id, md5(CASE WHEN doc_id % 3 = 0 THEN topic || '[' || category || ']' || topic ELSE topic || chr(10) || chr(10) || '[' || category || ']' || chr(10) END) AS text FROM notes")
def block_splice(spark: SparkSession, sf_dir: str) -> DataFrame:
    start, end = "<!-- from -->", "<!-- to -->"
    text = F.when(F.col("doc_id") % 3 == 0, F.concat("topic", F.lit(f"{start}old{end}"), "topic")).otherwise(F.col("topic"))
    block = F.concat(F.lit("["), "category", F.lit("]"))
    return views.notes(spark, sf_dir).select("doc_id", F.md5(pages.splice(text, block, start, end)).alias("text"))


def _rewritten(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distilled notes, half of which have fresh themes, and what they keep of their last version."""
    d = F.col("doc_id")
    n = notes.distilled(views.notes(spark, sf_dir)).withColumn("rel_path", notes.note_path(F.col("topic"), F.col("session_id"), F.col("category")))
    old = F.concat(F.lit("---\ntopic: x\n"), F.when(d % 3 == 0, F.lit('themes:\n  - "old a"\n  - "old b"\n')).otherwise(F.lit("themes:\n")), F.when(d % 5 == 0, F.lit("reviewed_at: 2024-02-02\nverified: true\n")).otherwise(F.lit("")), F.lit("---\nverified: false\nbody"))
    before = n.filter(d % 2 == 0).select("rel_path", old.alias("content"))
    return notes.with_preserved(n.withColumn("themes", F.when(d % 4 == 0, F.array(F.lit('say "hi"'), F.lit("two"))).otherwise(F.array().cast("array<string>"))), before)


_KEPT = """CASE WHEN doc_id % 4 = 0 THEN 'themes:' || chr(10) || '  - "say \\"hi\\""' || chr(10) || '  - "two"' WHEN doc_id % 2 = 0 AND doc_id % 3 = 0 THEN 'themes:' || chr(10) || '  - "old a"' || chr(10) || '  - "old b"' ELSE '' END AS theme_lines, CASE WHEN doc_id % 2 = 0 AND doc_id % 5 = 0 THEN 'verified: true' || chr(10) || 'reviewed_at: 2024-02-02' ELSE '' END AS review"""


@query(f"WITH {NOTES_SQL}, {_DISTILLED} SELECT doc_id, {_KEPT} FROM distilled")
def preserve_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rewritten(spark, sf_dir).select("doc_id", F.array_join("theme_lines", "\n").alias("theme_lines"), F.array_join("review", "\n").alias("review"))


@query(f"""WITH {NOTES_SQL}, {_DISTILLED}, r AS (SELECT *, {_KEPT}, {_k('topic')} AS alias FROM distilled) SELECT category, category || 's/' || CASE WHEN left(alias, 50) <> '' THEN left(alias, 50) ELSE 'note' END || '-' || left(session_id, 8) || '.md' AS rel_path,
 md5('---' || chr(10) || 'topic: "' || replace(topic, '"', '\\"') || '"' || chr(10) || CASE WHEN alias <> '' THEN 'aliases:' || chr(10) || '  - "' || alias || '"' || chr(10) ELSE '' END || 'category: ' || category || chr(10) || 'project: "' || project || '"' || chr(10) || 'session_id: ' || session_id || chr(10) || 'date: ' || strftime(started_at, '%Y-%m-%d') || chr(10) || 'confidence: ' || printf('%.2f', confidence) || chr(10)
 || CASE WHEN theme_lines <> '' THEN theme_lines || chr(10) ELSE '' END || CASE WHEN review <> '' THEN review || chr(10) ELSE '' END || '---' || chr(10) || 'Project: [[' || {_k('project')} || ']]' || chr(10) || 'Category: [[' || category || ']]' || chr(10) || chr(10) || '# One' || chr(10) || topic || CASE WHEN doc_id % 3 = 0 THEN chr(10) || chr(10) || '## Related' || chr(10) || chr(10) || '- [[x-1|X]]' || chr(10) || '- [[y-2|Y]]' ELSE '' END || chr(10)) AS content FROM r""")
def note_rewrite(spark: SparkSession, sf_dir: str) -> DataFrame:
    links = F.array(*(F.struct(F.lit(a).alias("slug"), F.lit(b).alias("topic")) for a, b in (("x-1", "X"), ("y-2", "Y"))))
    rows = _rewritten(spark, sf_dir).withColumns({"date": F.date_format("started_at", "yyyy-MM-dd"), "content": F.concat(F.lit("# One\n"), "topic", F.lit("\n\n## Related\n- stale\n")), "related": F.when(F.col("doc_id") % 3 == 0, links).otherwise(F.slice(links, 1, 0))})
    return notes.render_note(rows).withColumn("content", F.md5("content"))


@query(f"WITH {PAGES_SQL} SELECT path, CASE WHEN kind <> 'session' THEN kind END AS type, CASE WHEN kind IN ('article', 'pdf') THEN 'S: ' || doc END AS source_title, CASE WHEN kind = 'session' THEN 'T' || doc % 50 END AS topic, verified FROM vault")
def frontmatter_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = views.pages_of_notes(spark, sf_dir).withColumn("front", T.frontmatter(F.col("content")))
    return rows.select("path", *(F.try_element_at("front", F.lit(k)).alias(k) for k in ("type", "source_title", "topic")), T.is_verified(F.col("content")).alias("verified"))


@query(f"""WITH {NOTES_SQL} SELECT doc_id, CASE WHEN doc_id % 5 <> 0 AND doc_id % 7 <> 0 THEN category ELSE 'pattern' END AS category, CASE WHEN doc_id % 5 <> 0 THEN 't' || doc_id % 100 ELSE 'unknown' END AS topic, CASE WHEN doc_id % 5 <> 0 AND doc_id % 2 = 0 THEN 'mine' ELSE project END AS project, CASE WHEN doc_id % 5 <> 0 THEN least(1.0, doc_id * 37 % 120 / 100.0::DOUBLE) ELSE 0 END AS confidence, CASE WHEN doc_id % 5 <> 0 THEN 'a,b' ELSE '' END AS themes FROM notes""")
def classification_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Replies rendered from notes: every fifth is no JSON, every seventh has no known category."""
    d = F.col("doc_id")
    reply = F.concat(F.lit('Sure: {"category": "'), F.when(d % 7 == 0, "odd").otherwise(F.col("category")), F.lit('", "topic": " t'), (d % 100).cast("string"), F.lit(' ", "project": "'), F.when(d % 2 == 0, "mine").otherwise(""), F.lit('", "confidence": '), F.format_string("%.2f", d * 37 % 120 / 100.0), F.lit(', "themes": [" a", 3, "b", ""]} bye'))
    rows = views.notes(spark, sf_dir).withColumn("c", replies.classification(F.when(d % 5 == 0, "{no").otherwise(reply), F.col("project")))
    return rows.select("doc_id", "c.category", "c.topic", "c.project", "c.confidence", F.array_join("c.themes", ",").alias("themes"))


@query("""SELECT doc_id, doc_id % 4 = 0 AND doc_id % 9 <> 0 AS "isDuplicate", CASE WHEN doc_id % 9 <> 0 THEN doc_id % 101 / 100.0::DOUBLE ELSE 0 END AS confidence, CASE WHEN doc_id % 9 <> 0 THEN source ELSE '' END AS reason, CASE WHEN doc_id % 9 = 0 THEN 'merge' ELSE ['A', 'B', 'merge'][CAST(doc_id % 3 + 1 AS INT)] END AS keep_which FROM documents""")
def pair_reply_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.col("doc_id")
    keep = F.element_at(F.array(F.lit("A"), F.lit("B"), F.lit("C")), (d % 3 + 1).cast("int"))
    reply = F.when(d % 9 != 0, F.to_json(F.struct((d % 4 == 0).alias("isDuplicate"), F.round(d % 101 / 100.0, 2).alias("confidence"), F.col("source").alias("reason"), keep.alias("keepWhich"))))
    return table(spark, sf_dir, "documents").select("doc_id", replies.verdict(reply).alias("v")).select("doc_id", "v.*")


@query("""SELECT page_id, CASE WHEN page_id % 3 <> 0 THEN 'Page ' || page_id ELSE '' END AS title, CASE WHEN page_id % 4 <> 0 THEN page_id % 101 / 100.0::DOUBLE ELSE 0 END AS confidence, md5('body of ' || url || chr(10) || 'end') AS content FROM pages""")
def compose_reply_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = F.col("page_id")
    head = F.when(p % 3 != 0, F.concat(F.lit('TITLE: "Page '), p.cast("string"), F.lit('"\n'))).otherwise("")
    sure = F.when(p % 4 != 0, F.concat(F.lit("Confidence: "), F.format_string("%.2f", p % 101 / 100.0), F.lit("\n"))).otherwise("")
    reply = F.concat(head, sure, F.lit("\n# Heading\n\nbody of "), "url", F.lit("\nend\n"))
    return table(spark, sf_dir, "pages").select("page_id", replies.composed(reply).alias("r")).select("page_id", "r.title", "r.confidence", F.md5("r.content").alias("content"))


@query(f"""WITH {NOTES_SQL}, x AS (SELECT doc_id, topic, regexp_extract(trim(topic), '^\\[(.+?)\\]\\(.+\\)$', 1) AS label FROM notes),
 y AS (SELECT doc_id, CASE WHEN trim(topic) = '' OR regexp_full_match(trim(topic), '\\[\\[.+\\]\\]') THEN topic ELSE '[[' || CASE WHEN label <> '' THEN {_k('label')} ELSE {_k('topic')} END || ']]' END AS item FROM x)
 SELECT doc_id, md5('text' || chr(10) || '## Related' || chr(10) || '- ' || item || chr(10) || '- [[kept]]' || chr(10) || '## Next' || chr(10) || '- plain') AS linked, CASE WHEN item IS NOT NULL THEN md5('text' || chr(10) || '## Next' || chr(10) || '- plain') END AS stripped FROM y""")
def related_rewrite(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = views.notes(spark, sf_dir)
    text = F.concat(F.lit("text\n## Related\n- "), "topic", F.lit("\n- [[kept]]\n## Next\n- plain"))
    return rows.select("doc_id", F.md5(replies.link_related(text)).alias("linked"), F.md5(replies.strip_related(text)).alias("stripped"))


_ASK = {"classify": "Classify this session. Answer as JSON: category (pattern, gotcha, decision or tool), topic, themes, project, confidence.", "distil": "Write down what of this session others can use again, in markdown from ''## Summary'' on.", "lead": "Classify this article. Answer as JSON: category (concept, technique, reference or opinion), confidence.", "article": "Distil this article in your own words, in markdown from ''## Summary'' on.", "pdf": "Distil this document in your own words, in markdown from ''## Summary'' on. Name its kind: paper, reference, notes or other."}
_N = "chr(10)"


@query(f"""WITH {NOTES_SQL}, {_DISTILLED}, x AS (SELECT *, {_scrub_sql('content')} AS safe FROM distilled), r AS (
 SELECT doc_id, 'classify' AS kind, '{_ASK['classify']}' || {_N} || 'Project: ' || project || {_N} || {_N} || safe AS request FROM x UNION ALL SELECT doc_id, 'distil', '{_ASK['distil']}' || {_N} || 'Project: ' || project || {_N} || 'Category: ' || category || {_N} || 'Date: ' || strftime(started_at, '%Y-%m-%d') || {_N} || {_N} || safe FROM x
 UNION ALL SELECT doc_id, 'lead', '{_ASK['lead']}' || {_N} || 'Title: ' || topic || {_N} || 'Source: ' || path || {_N} || {_N} || left(safe, 3000) FROM x UNION ALL SELECT doc_id, 'article', '{_ASK['article']}' || {_N} || 'Title: ' || topic || {_N} || 'Source: ' || path || {_N} || {_N} || left(safe, 24000) FROM x UNION ALL SELECT doc_id, 'pdf', '{_ASK['pdf']}' || {_N} || 'Title: ' || topic || {_N} || {_N} || left(safe, 24000) FROM x)
 SELECT doc_id, kind, md5(request) AS request FROM r""")
def request_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = notes.distilled(views.notes(spark, sf_dir))
    c = {k: F.col(k) for k in ("content", "project", "category", "topic", "path")}
    made = {
        "classify": requests.classify(c["content"], c["project"]), "distil": requests.distil(c["content"], c["project"], c["category"], F.date_format("started_at", "yyyy-MM-dd")),
        "lead": requests.article(c["topic"], c["path"], c["content"], True), "article": requests.article(c["topic"], c["path"], c["content"], False), "pdf": requests.pdf(c["topic"], c["content"]),
    }
    return reduce(DataFrame.unionByName, (n.select("doc_id", F.lit(k).alias("kind"), F.md5(r).alias("request")) for k, r in made.items()))


@query(f"""WITH {NOTES_SQL}, {_DISTILLED}, p AS (SELECT a.doc_id AS a, b.doc_id AS b, a.topic AS ta, b.topic AS tb, a.started_at AS sa, b.started_at AS sb, a.confidence AS ca, b.confidence AS cb, a.content AS xa, b.content AS xb FROM distilled a JOIN distilled b ON b.doc_id = a.doc_id + 4)
 SELECT a, b, md5('Do these two notes teach the same? Answer as JSON: isDuplicate, confidence, reason, keepWhich (A, B or merge).' || {_N} || {_N} || 'Note A (topic: ' || ta || ', date: ' || strftime(sa, '%Y-%m-%d') || ', confidence: ' || printf('%.2f', ca) || '):' || {_N} || left(xa, 400) || {_N} || {_N} || 'Note B (topic: ' || tb || ', date: ' || strftime(sb, '%Y-%m-%d') || ', confidence: ' || printf('%.2f', cb) || '):' || {_N} || left(xb, 400)) AS duplicate,
 md5('Do these two notes contradict each other? Answer as JSON: contradicts, reason.' || {_N} || {_N} || 'Note A (topic: ' || ta || '):' || {_N} || left(trim(regexp_replace(xa, '\\s+', ' ', 'g')), 200) || {_N} || {_N} || 'Note B (topic: ' || tb || '):' || {_N} || left(trim(regexp_replace(xb, '\\s+', ' ', 'g')), 200)) AS contradiction FROM p""")
def pair_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = notes.distilled(views.notes(spark, sf_dir)).withColumnRenamed("doc_id", "id").select("id", "topic", "started_at", "confidence", "content")
    found = n.select(F.col("id").alias("a"), (F.col("id") + 4).alias("b"))
    one, two = requests.pairs(found, n).withColumn("request", F.md5("request")), requests.pairs(found, n, duplicates=False).withColumn("request", F.md5("request"))
    return one.withColumnRenamed("request", "duplicate").join(two.withColumnRenamed("request", "contradiction"), ["a", "b"])


_POOL = """pool AS (SELECT 'notes' AS layer, vec_id AS doc, embedding::DOUBLE[] AS v, vec_id % 3 = 0 AS verified FROM embeddings WHERE vec_id % 8 <> 0 UNION ALL SELECT 'articles', vec_id, embedding::DOUBLE[], FALSE FROM embeddings WHERE label % 4 = 0 UNION ALL SELECT 'pdfs', vec_id, embedding::DOUBLE[], FALSE FROM embeddings WHERE label % 4 = 1 UNION ALL SELECT 'topics', vec_id, embedding::DOUBLE[], vec_id % 2 = 0 FROM embeddings WHERE label % 4 = 2),
 asked AS (SELECT vec_id AS query, embedding::DOUBLE[] AS q FROM embeddings WHERE vec_id % 50 = 0), scored AS (SELECT query, layer, doc, list_cosine_similarity(q, v) AS s, verified FROM asked, pool)"""


def _note_layers(spark: SparkSession, sf_dir: str) -> tuple[dict[str, DataFrame], DataFrame]:
    """Four layers of vectors, some without content, and one in fifty of them as queries."""
    e, doc = table(spark, sf_dir, "embeddings"), F.col("vec_id")
    layer = lambda rows, verified, content=F.lit("text"): rows.select(doc.alias("doc"), F.col("embedding").cast("array<double>").alias("vector"), content.alias("content"), verified.alias("verified"))
    layers = {"notes": layer(e, doc % 3 == 0, F.when(doc % 8 != 0, "text").otherwise(" ")), "articles": layer(e.filter("label % 4 = 0"), F.lit(False)), "pdfs": layer(e.filter("label % 4 = 1"), F.lit(False)), "topics": layer(e.filter("label % 4 = 2"), doc % 2 == 0)}
    return layers, e.filter("vec_id % 50 = 0").select(doc.alias("query"), F.col("embedding").cast("array<double>").alias("vector"))


@query(f"WITH {_POOL}, r AS (SELECT query, layer, doc, least(1.0, s) + CASE WHEN verified THEN 0.2 ELSE 0 END AS score FROM scored WHERE s >= 0.3), k AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, layer, doc) AS rank FROM r) SELECT query, layer, doc, floor(score * 10000 + 0.5) / 10000 AS score, rank FROM k WHERE rank <= 8")
def layered_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hits.best(hits.layered(*_note_layers(spark, sf_dir)))


@query(f"WITH RECURSIVE {_POOL.replace('list_cosine_similarity(q, v) AS s, verified', 'list_cosine_similarity(q, v) AS s, verified, v')}, {mmr_sql('SELECT query, layer, doc, least(1.0, s) + CASE WHEN verified THEN 0.2 ELSE 0 END AS score, v FROM scored WHERE s >= 0.3').replace('pool AS', 'candidates AS').replace('FROM pool', 'FROM candidates').replace('JOIN pool', 'JOIN candidates')} SELECT query, layer, doc, score, rank FROM mmr")
def diverse_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The boosted search over four layers, re-ranked for diversity."""
    return hits.diverse(*_note_layers(spark, sf_dir))


@query("SELECT doc_id, trim(text, E' \\t\\n\\r') <> '' AS done, CASE WHEN trim(text, E' \\t\\n\\r') <> '' THEN length(text) END AS length FROM documents")
def embed_stage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The user's function gives each text of the backlog a vector of its length; blank texts get none."""
    rows = table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("content"))
    done = jobs.embedded(rows, lambda texts: [[float(len(t))] for t in texts])
    return done.select("doc_id", (F.col("embedding").isNotNull() & F.col("error").isNull()).alias("done"), F.get("embedding", 0).cast("long").alias("length"))


@query(f"""WITH {NOTES_SQL}, {_DISTILLED} SELECT doc_id, CASE WHEN length(content) % 2 = 0 THEN 'tool' ELSE 'gotcha' END AS category, 'distill' AS stage, CAST(ceil(length(content) / 4.0) AS BIGINT) AS input_tokens FROM distilled""")
def inference_stage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Replies of a rule in a model's place, parsed, with a cost record for each."""
    answer = lambda texts: [f'{{"category": "{"tool" if len(t) % 2 == 0 else "gotcha"}", "topic": "x", "confidence": 1}}' for t in texts]
    asked = notes.distilled(views.notes(spark, sf_dir)).select("doc_id", "project", F.col("content").alias("prompt"))
    done = jobs.recorded(jobs.inferred(asked, answer), "distill", "m", "p")
    return done.withColumn("c", replies.classification(F.col("reply"), F.col("project"))).select("doc_id", "c.category", "cost.stage", "cost.input_tokens")


@query("SELECT '/proj/c' || conv_id % 5 || '/' || conv_id || '.jsonl' AS path, count(*) AS lines, md5(string_agg(text, chr(10) ORDER BY turn)) AS texts FROM conversations GROUP BY conv_id")
def transcript_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations written as files of JSON lines, a folder for each project, and read back."""
    root = scratch_path(spark, "transcripts")
    path = F.concat(F.lit("c"), (F.col("conv_id") % 5).cast("string"), F.lit("/"), F.col("conv_id").cast("string"), F.lit(".jsonl"))
    write_line_files(table(spark, sf_dir, "conversations").select(path.alias("rel_path"), F.col("turn").alias("line"), F.to_json(F.struct(F.col("turn").alias("n"), F.struct("role", F.col("text").alias("content")).alias("message"))).alias("value")), root)
    lines = files.transcript_lines(spark, root)
    texts = F.array_sort(F.collect_list(F.struct(F.try_variant_get("event", "$.n", "long").alias("n"), F.try_variant_get("event", "$.message.content", "string").alias("t"))))
    named = lines.select(F.concat(F.lit("/proj/"), F.element_at(F.split("path", "/"), -2), F.lit("/"), F.element_at(F.split("path", "/"), -1)).alias("path"), "event")
    return named.groupBy("path").agg(F.count("*").alias("lines"), F.md5(F.array_join(F.transform(texts, lambda x: x["t"]), "\n")).alias("texts"))


@query(f"WITH {NOTES_SQL}, {_DISTILLED} SELECT category, category || '/' || doc_id || '.md' AS rel_path, md5(CASE WHEN doc_id % 2 = 0 THEN 'new ' ELSE '' END || topic) AS content FROM distilled")
def sink_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A version of the notes, half of them rewritten in the next, read back."""
    root = scratch_path(spark, "notes")
    n = notes.distilled(views.notes(spark, sf_dir)).select("doc_id", "category", F.concat("category", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".md")).alias("rel_path"), F.col("topic").alias("content"))
    columns = ["category", "rel_path", "content"]
    first = files.write_notes(n.select(*columns), root, "0")
    again = n.filter("doc_id % 2 = 0").withColumn("content", F.concat(F.lit("new "), "content"))
    second = files.write_notes(again.select(*columns), root, "1", spark.read.parquet(first).select(*columns))
    return spark.read.parquet(second).select("category", "rel_path", F.md5("content").alias("content"))
