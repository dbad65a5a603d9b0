"""Registered queries of files and streams: tables written as files and read back, streams replayed in batches."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import index, notes
from ..sources import files, views
from ..sources.notes_sink import write_note_files
from ..sources.scratch import scratch_path
from ..sources.views import ARTICLES_SQL, COST_SQL, NOTES_SQL, table
from ..streaming import jobs
from ..streaming.state import Buckets
from .catalogue import _DISTILLED, _TFIDF, _corpus, query, tfidf_search

_TITLE = "regexp_extract(html, '<title>([^<]*)</title>', 1)"


@query(f"WITH {NOTES_SQL}, {_DISTILLED} SELECT category || '/' || doc_id || '.md' AS rel_path, category || '/' || doc_id AS title, md5(CASE WHEN doc_id % 2 = 0 THEN 'new ' ELSE '' END || content) AS content FROM distilled")
def note_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Notes as files, one each, half of them written anew, and read back without index and summaries."""
    root = scratch_path(spark, "note_files")
    n = notes.distilled(views.notes(spark, sf_dir)).select("doc_id", F.concat("category", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".md")).alias("rel_path"), "content")
    others = n.groupBy("rel_path").agg(F.lit(1).alias("n")).limit(1).select(F.explode(F.array(F.lit("index.md"), F.lit("log.md"), F.lit("summaries/w.md"), F.lit("../out.md"))).alias("rel_path"), F.lit("x").alias("content"))
    write_note_files(n.select("rel_path", "content").unionByName(others), root)
    write_note_files(n.filter("doc_id % 2 = 0").select("rel_path", F.concat(F.lit("new "), "content").alias("content")), root)
    return files.note_corpus(spark, root).withColumn("content", F.md5("content"))


def _article_files(spark: SparkSession, sf_dir: str) -> str:
    root = scratch_path(spark, "article_files")
    write_note_files(views.articles(spark, sf_dir).select(F.concat(F.col("page_id").cast("string"), F.lit(".md")).alias("rel_path"), "content"), root)
    return root


@query(f"""WITH {ARTICLES_SQL}, r AS (SELECT page_id, content, url, {_TITLE} AS title FROM articles JOIN pages USING (page_id)) SELECT page_id || '.md' AS name, sha256(content) AS hash, title, url, 'web,p' || page_id % 3 AS tags,
 len(list_filter(regexp_split_to_array(content[length('---title: "' || title || '"source: ' || url || 'tags: [web, p0]page: ' || page_id || '---') + 7:], '\\s+'), lambda w: w <> '')) AS word_count FROM r""")
def article_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Articles as files with frontmatter, read back."""
    found = files.articles(spark, _article_files(spark, sf_dir))
    return found.select(F.element_at(F.split("path", "/"), -1).alias("name"), "hash", "title", "url", F.array_join("tags", ",").alias("tags"), F.col("word_count").cast("long").alias("word_count"))


@query(f"WITH {ARTICLES_SQL} SELECT page_id || '.md' AS name, sha256(content) AS hash, octet_length(encode(content)) AS size FROM articles")
def file_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files by the hash of their bytes, unopened otherwise."""
    return files.scan(spark, _article_files(spark, sf_dir), "*.md").select(F.element_at(F.split("path", "/"), -1).alias("name"), "hash", "size")


@query(f"WITH {COST_SQL} SELECT stage, provider, count(*) AS calls, CAST(sum(input_tokens) AS BIGINT) AS input_tokens FROM cost WHERE event_id % 11 = 0 OR ts >= TIMESTAMP '2024-01-15' GROUP BY 1, 2")
def cost_log_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cost records appended to a log in two parts, with broken lines and records without a time, and read back since a day."""
    root, rows = scratch_path(spark, "cost_log"), views.cost(spark, sf_dir)
    told = rows.withColumn("ts", F.when(F.col("event_id") % 11 == 0, "no time").otherwise(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")))
    for part in (0, 1):
        files.append_cost(told.filter(F.col("event_id") % 2 == part).drop("event_id"), root)
    rows.filter("event_id % 100 = 0").select(F.lit('{"stage": ').alias("value")).write.mode("append").text(root)
    return files.cost_log(spark, root, "2024-01-15").groupBy("stage", "provider").agg(F.count("*").alias("calls"), F.sum("input_tokens").alias("input_tokens"))


@query(f"{_TFIDF} SELECT query AS query_id, count(*) AS n, string_agg(doc || ':' || CAST(CAST(round(score * 10000) AS BIGINT) AS VARCHAR), ',' ORDER BY rank) AS results FROM hits GROUP BY 1")
def result_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Search results as JSON, a line for each query, read back."""
    path = scratch_path(spark, "results")
    files.write_results(tfidf_search(spark, sf_dir).withColumnRenamed("query", "query_id"), path)
    lines = spark.read.text(path).select(F.from_json("value", "query_id long, results array<struct<doc long, score double>>").alias("r")).select("r.*")
    each = F.transform("results", lambda x: F.concat(x["doc"].cast("string"), F.lit(":"), F.floor(x["score"] * 10000 + 0.5).cast("string")))
    return lines.select("query_id", F.size("results").cast("long").alias("n"), F.array_join(each, ",").alias("results"))


def _ended(started) -> None:
    started.awaitTermination()
    if started.exception():
        raise started.exception()


def _replayed(spark: SparkSession, parts: list[DataFrame], start) -> None:
    """A stream that gives each of these tables as a batch, in order. ``start`` begins the query over it, with one checkpoint; it
    goes on with each table once that is there, and reads its files, as many as the table has partitions, at once."""
    root = scratch_path(spark, "stream")
    for part in parts:
        part.write.mode("append").parquet(root)
        _ended(start(spark.readStream.schema(parts[0].schema).parquet(root)))


def _written(spark: SparkSession, parts: list[DataFrame], job) -> DataFrame:
    """What the ``job`` over a stream of these tables appends, as a table."""
    path, checkpoint, schema = scratch_path(spark, "appended"), scratch_path(spark, "checkpoint"), []

    def start(stream: DataFrame):
        out = job(stream)
        schema[:] = [out.schema]
        return out.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

    _replayed(spark, parts, start)
    return spark.read.schema(schema[0]).parquet(path)


@query("""SELECT 'p/' || doc_id AS path, sha256(t) AS hash, length(t) AS chars, n AS distilled_in FROM (SELECT doc_id, CASE WHEN doc_id % 6 = 0 THEN text || '!!' WHEN doc_id % 3 = 0 THEN text || '!' ELSE text END AS t, CASE WHEN doc_id % 6 = 0 THEN 2 WHEN doc_id % 3 = 0 THEN 1 ELSE 0 END AS n FROM documents)""")
def session_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three batches of files: all; a third changed and a third unchanged; a sixth changed, each row twice."""
    d, ident = table(spark, sf_dir, "documents"), F.col("doc_id")
    made = lambda rows, mark, n: rows.select(F.concat(F.lit("p/"), ident.cast("string")).alias("path"), F.concat(F.coalesce("text", F.lit("")), F.lit(mark)).alias("content"), F.lit(n).alias("n")).withColumn("hash", F.sha2("content", 256)).select("path", "hash", "content", "n")
    last = made(d.filter(ident % 6 == 0), "!!", 2)
    parts = [made(d, "", 0), made(d.filter(ident % 3 == 0), "!", 1).unionByName(made(d.filter(ident % 3 == 1), "", 1)), last.unionByName(last)]
    root, schema = scratch_path(spark, "sessions"), "path string, hash string, chars long, distilled_in int"
    distil = lambda rows: rows.select("path", "hash", F.length("content").cast("long").alias("chars"), F.col("n").alias("distilled_in"))
    checkpoint = scratch_path(spark, "checkpoint")
    _replayed(spark, parts, lambda stream: jobs.keep_sessions(stream, distil, schema, root, checkpoint, buckets=16))
    return Buckets(root, schema, count=16).current(spark)


_WEEKS = f"""WITH {COST_SQL}, w AS (SELECT date_trunc('week', ts) AS week, stage, provider, count(*) AS calls, CAST(sum(input_tokens) AS BIGINT) AS input_tokens FROM cost WHERE ts IS NOT NULL GROUP BY 1, 2, 3)"""


@query(f"{_WEEKS} SELECT strftime(week, '%Y-%m-%d') AS week, stage, provider, calls, input_tokens FROM w WHERE week + INTERVAL 7 DAY <= (SELECT max(ts) FROM cost) - INTERVAL 2 DAY")
def streamed_weeks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weeks that a stream gives out: those the watermark has passed. Records of weeks long gone come late and are dropped."""
    rows = views.cost(spark, sf_dir).select(F.col("ts").cast("timestamp").alias("ts"), "stage", "provider", "input_tokens", "output_tokens").filter("ts is not null")
    at = F.unix_seconds("ts")
    lo, hi = rows.agg(F.min(at), F.max(at)).first()
    days = 24 * 3600
    late = rows.filter((at < lo + days) & F.lit(hi - lo > 12 * days))
    out = _written(spark, [rows.filter(at < (lo + hi) // 2), rows.filter(at >= (lo + hi) // 2), late], jobs.weekly_cost)
    return out.select(F.date_format("week_start", "yyyy-MM-dd").alias("week"), "stage", "provider", "calls", "input_tokens")


@query(f"WITH {NOTES_SQL} SELECT path, sha256(content) AS hash FROM notes UNION SELECT path, sha256(content || '+') FROM notes WHERE doc_id % 4 = 0")
def delivered_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Deliveries of a stream that repeat in the same batch and in a later one; a path with another hash is none of them."""
    n = views.notes(spark, sf_dir).select("doc_id", "path", "content", F.lit("2024-01-05 00:00:00").cast("timestamp").alias("ts"))
    told = lambda rows, mark: rows.select("path", F.sha2(F.concat("content", F.lit(mark)), 256).alias("hash"), "ts")
    again, other = n.filter("doc_id % 3 = 0"), n.filter("doc_id % 4 = 0")
    parts = [told(n, "").unionByName(told(again, "")), told(again, "").unionByName(told(other, "+"))]
    return _written(spark, parts, lambda stream: jobs.once_each(stream, "30 days")).select("path", "hash")


def _length_vector(texts) -> list:
    """A user's function in a model's place; it fails on texts of some lengths, and so on any batch that holds one."""
    for t in texts:
        if len(t) % 5 == 0:
            raise ValueError("length")
    return [[float(len(t))] for t in texts]


@query("SELECT doc_id, CASE WHEN trim(text, E' \\t\\n\\r') <> '' AND length(text) % 5 <> 0 THEN length(text) END AS length, CASE WHEN trim(text, E' \\t\\n\\r') <> '' AND length(text) % 5 = 0 THEN 'ValueError: length' END AS error FROM documents")
def failed_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row that fails costs only itself, not its batch."""
    done = jobs.embedded(table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("content")), _length_vector)
    return done.select("doc_id", F.get("embedding", 0).cast("long").alias("length"), "error")


@query("""WITH a AS (SELECT doc_id, CASE WHEN doc_id % 10 = 0 THEN text || 'x' ELSE text END AS t FROM documents WHERE doc_id % 2 = 0 AND trim(text) <> '')
 SELECT doc_id, length(t) % 5 <> 0 AS healed, CASE WHEN doc_id % 10 = 0 OR length(t) % 5 = 0 THEN 1 ELSE 0 END AS batch FROM a""")
def backlog_heal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two batches of rows without a vector: what failed in the first is tried again with the second, or a newer row takes
    its place."""
    d = table(spark, sf_dir, "documents").filter("trim(text) <> ''")
    rows = lambda part, mark: part.select(F.col("doc_id").cast("string").alias("path"), F.concat("text", F.lit(mark)).alias("content"), F.lit(None).cast("array<double>").alias("embedding"))
    root, checkpoint = scratch_path(spark, "backlog"), scratch_path(spark, "checkpoint")
    _replayed(spark, [rows(d.filter("doc_id % 2 = 0"), ""), rows(d.filter("doc_id % 10 = 0"), "x")], lambda stream: jobs.heal_backlog(stream, _length_vector, root, checkpoint))
    tried = reduce(DataFrame.unionByName, (spark.read.schema("path string, error string").parquet(f"{root}/batch={n}").withColumn("batch", F.lit(n)) for n in (0, 1)))
    last = tried.groupBy("path").agg(F.max_by(F.struct("error", "batch"), "batch").alias("r"))
    return last.select(F.col("path").cast("long").alias("doc_id"), F.col("r.error").isNull().alias("healed"), F.col("r.batch").alias("batch"))


@query(f"{_TFIDF} SELECT query, doc, score, rank FROM hits")
def indexed_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A search of a stored index that three batches have built: other texts at first for a third of the documents, then their
    own; documents that aren't there any more."""
    root, docs = scratch_path(spark, "index"), _corpus(spark, sf_dir)
    other = docs.select("doc", F.when(F.col("doc") % 3 == 0, F.reverse("text")).otherwise(F.col("text")).alias("text"), "verified")
    extra = docs.select((-1 - F.col("doc")).alias("doc"), "text", "verified")
    index.add(other.unionByName(extra), root, 0)
    index.add(docs.filter("doc % 3 = 0"), root, 1, extra)
    return index.search(spark, root, table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query"), "text"))
