"""Collections of files as tables, and tables as files. Folders of many small files are read by pyarrow within tasks, all other paths go
through Spark's readers and writers."""

from __future__ import annotations

import fnmatch
import functools
import re
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import FRONTMATTER, body, frontmatter
from ..operators.state import publish, upsert
from .scratch import bounded_batches

COST_SCHEMA = "ts string, session string, project string, stage string, model string, provider string, input_tokens long, output_tokens long, token_source string, estimated_cost_usd double"
#: Files of a note folder that are no notes.
NOT_NOTES = ["index.md", "log.md"]


def scan(spark: SparkSession, root: str, pattern: str = "*.jsonl") -> DataFrame:
    """path, hash (SHA-256 of the bytes), size of all matching files below ``root``; files that can't be
    read are left out. Transcripts by default, ``*.pdf`` for documents that are not opened."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).option("ignoreCorruptFiles", True).load(root)
    return files.select("path", F.sha2("content", 256).alias("hash"), F.col("length").alias("size"))


#: Files are read in so many tasks a core.
READS = 4
#: What may not stand in a URI's path.
QUOTED = re.compile(r"[\x00-\x20\"#%<>?\[\\\]^`{|}\x7f]")


def _shown(name: str) -> bool:
    """Whether Spark's own readers would look at a file or folder of this name."""
    return not (name.startswith(".") or name.endswith("._COPYING_") or name.startswith("_") and "=" not in name)


def _listed(batches: Iterator[pa.RecordBatch], pattern: str, deep: bool) -> Iterator[pa.RecordBatch]:
    """Rows (uri, path, folder) as what is in the folders: matching files that aren't empty, and, unless ``deep``, folders."""
    for batch in batches:
        for uri, path, folder in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            store, todo = _store(uri), [path] if folder else []
            if not folder:
                yield pa.RecordBatch.from_pylist([{"uri": uri, "path": path, "folder": False}], batch.schema)
            while todo:
                held = [x for x in store.get_file_info(fs.FileSelector(todo.pop())) if _shown(x.base_name)]
                below = [x.path for x in held if x.type == fs.FileType.Directory]
                found = [x.path for x in held if x.type == fs.FileType.File and x.size and fnmatch.fnmatchcase(x.base_name, pattern)]
                todo += below if deep else []
                rows = [*found, *([] if deep else below)]
                yield pa.RecordBatch.from_pydict({"uri": [uri] * len(rows), "path": rows, "folder": [False] * len(found) + [True] * (len(rows) - len(found))}, batch.schema)
                if not deep:
                    break


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (uri, path) as (path, content), some 4 MB of files at once; paths quoted as Spark gives them."""
    held, size = [], 0
    for batch in batches:
        for uri, path in zip(batch.column("uri").to_pylist(), batch.column("path").to_pylist(), strict=True):
            store = _store(uri)
            with store.open_input_stream(path, compression=None) as file:
                held.append((QUOTED.sub(lambda m: f"%{ord(m[0]):02X}", path), file.read()))
            size += len(held[-1][1])
            if size > 4 << 20:
                yield _contents(held)
                held, size = [], 0
    if held:
        yield _contents(held)


@functools.lru_cache(4)
def _store(uri: str) -> fs.FileSystem:
    return fs.FileSystem.from_uri(uri)[0]


def _contents(rows: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({"path": [p for p, _ in rows], "content": pa.array([c for _, c in rows], pa.binary())})


def _openable(root: str) -> str | None:
    """The folder's path in a file system that pyarrow opens; None where only Spark's readers can, or where they are to complain."""
    try:
        store, path = fs.FileSystem.from_uri(root)
        return path if store.get_file_info(path).type == fs.FileType.Directory else None
    except (OSError, ValueError):
        return None


def _texts(spark: SparkSession, root: str, pattern: str) -> DataFrame:
    """path, content of all matching files below ``root`` that aren't empty. Small files are many: they are listed by tasks, a folder
    each, and opened without Spark's work for each file; where pyarrow can't open the root, or the pattern has alternatives, Spark reads them."""
    folder = None if re.search(r"[{\\^]", pattern) else _openable(root)
    if folder is None:
        files = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", pattern).text(root, wholetext=True)
        return files.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("content"))
    bounded_batches(spark)
    schema, tasks = "uri string, path string, folder boolean", READS * spark.sparkContext.defaultParallelism
    top = spark.createDataFrame([(root, folder, True)], schema).repartition(1).mapInArrow(lambda b: _listed(b, pattern, False), schema)
    every = top.repartition(tasks).mapInArrow(lambda b: _listed(b, pattern, True), schema).repartition(tasks)
    scheme = (re.match(r"[a-z0-9]+://[^/]+" if folder.startswith("/") else r"[a-z0-9]+://", root) or ["file:"])[0]
    return every.select("uri", "path").mapInArrow(_read, "path string, content binary").select(F.concat(F.lit(scheme), "path").alias("path"), F.col("content").cast("string").alias("content"))


def transcript_lines(spark: SparkSession, root: str, pattern: str = "*.jsonl") -> DataFrame:
    """path, line, text, event (variant; null if the line isn't JSON) of every line that isn't blank."""
    files = _texts(spark, root, pattern)
    lines = files.select("path", F.posexplode(F.split("content", "\n")).alias("line", "text")).filter(F.trim("text") != "")
    return lines.withColumn("event", F.try_parse_json("text"))


def session_of(path: Column) -> Column:
    """Struct of session (the file's name) and project (its folder)."""
    parts = F.split(path, "/")
    return F.struct(F.regexp_replace(F.element_at(parts, -1), "\\.jsonl$", "").alias("session"), F.element_at(parts, -2).alias("project"))


def transcript_blocks(lines: DataFrame) -> DataFrame:
    """path, line, block, ts, role, kind, name, tool_id, is_error, content, plain of each content block. A message
    that is plain text is one text block (``plain``); events without a message are their own."""
    e = F.col("event")
    get = lambda v, p, kind="string": F.try_variant_get(v, p, kind)
    held = F.coalesce(get(e, "$.message.content", "variant"), get(e, "$.content", "variant"))
    whole = F.when(F.schema_of_variant(held) == "STRING", F.coalesce(get(e, "$.message.content"), get(e, "$.content")))
    many = F.coalesce(get(e, "$.message.content", "array<variant>"), get(e, "$.content", "array<variant>"))
    rows = lines.select(
        "path", "line", get(e, "$.timestamp").alias("ts"), F.coalesce(get(e, "$.message.role"), get(e, "$.role")).alias("role"), whole.alias("whole"),
        F.posexplode_outer(F.when(whole.isNull(), many)).alias("block", "part"),
    ).filter("whole is not null or part is not null")
    p = F.col("part")
    inner = F.array_join(F.filter(F.transform(get(p, "$.content", "array<variant>"), lambda x: F.when((get(x, "$.type") == "text") & get(x, "$.text").isNotNull(), get(x, "$.text")).otherwise(F.concat(F.lit("["), get(x, "$.type"), F.lit("]")))), lambda t: t.isNotNull()), "\n")
    plain = F.when(F.schema_of_variant(get(p, "$.content", "variant")) == "STRING", get(p, "$.content"))
    return rows.select(
        "path", "line", F.coalesce("block", F.lit(0)).alias("block"), "ts", "role",
        F.coalesce(get(p, "$.type"), F.lit("text")).alias("kind"), get(p, "$.name").alias("name"),
        F.coalesce(get(p, "$.id"), get(p, "$.tool_use_id")).alias("tool_id"), F.coalesce(get(p, "$.is_error", "boolean"), F.lit(False)).alias("is_error"),
        F.coalesce("whole", get(p, "$.text"), F.to_json(get(p, "$.input", "variant")), plain, inner).alias("content"), F.col("whole").isNotNull().alias("plain"),
    )


def articles(spark: SparkSession, root: str) -> DataFrame:
    """Markdown articles: path, hash, title (frontmatter, first heading or file name), url, author,
    published, tags, word_count, body."""
    rows = _texts(spark, root, "*.[mM][dD]").withColumn("fm", frontmatter(F.col("content"))).withColumn("body", F.ltrim(body(F.col("content"))))
    fm = lambda k: F.nullif(F.try_element_at("fm", F.lit(k)), F.lit(""))
    block = F.regexp_extract("content", FRONTMATTER, 1)
    listed = F.transform(F.regexp_extract_all(F.regexp_extract(block, r"(?m)^tags:\s*\n((?:\s*-\s+.*\n?)+)", 1), F.lit(r"(?m)^\s*-\s+(.*)$"), 1), F.trim)
    inline = F.transform(F.split(F.regexp_replace(fm("tags"), r"^\[|\]$", ""), ","), lambda t: F.regexp_replace(F.trim(t), "^[\"']|[\"']$", ""))
    name = F.regexp_replace(F.element_at(F.split("path", "/"), -1), "(?i)\\.md$", "")
    tags = F.filter(F.coalesce(F.when(F.size(listed) > 0, listed), inline, F.array().cast("array<string>")), lambda t: t != "")
    return rows.select(
        "path", F.sha2("content", 256).alias("hash"),
        F.coalesce(fm("title"), F.nullif(F.regexp_extract("body", r"(?m)^#\s+(.+?)\s*$", 1), F.lit("")), name).alias("title"),
        F.coalesce(fm("source"), fm("url"), fm("source_url")).alias("url"), fm("author").alias("author"), fm("published").alias("published"),
        tags.alias("tags"), F.size(F.filter(F.split("body", "\\s+"), lambda w: w != "")).alias("word_count"), "body",
    )


def note_corpus(spark: SparkSession, root: str) -> DataFrame:
    """rel_path, title (the path without its ending), content of the notes below ``root``; the index, the
    log and the summaries are none."""
    base = root.rstrip("/").rpartition("://")[2].removeprefix("file:")
    rows = _texts(spark, root, "*.md").withColumn("rel_path", F.ltrim(F.substring_index("path", f"{base}/", -1)))
    name = F.element_at(F.split("rel_path", "/"), -1)
    return rows.filter(~name.isin(NOT_NOTES) & ~F.col("rel_path").rlike("(^|/)summaries/")).select("rel_path", F.regexp_replace("rel_path", "\\.md$", "").alias("title"), "content")


def cost_log(spark: SparkSession, path: str, since: str | None = None) -> DataFrame:
    """Records of a JSON-lines log. Broken lines are left out; a record without a valid time stays under
    any ``since``."""
    lines = spark.read.text(path).filter(F.try_parse_json("value").isNotNull())
    rows = lines.select(F.from_json("value", COST_SCHEMA).alias("r")).select("r.*").withColumn("at", F.expr("try_to_timestamp(ts)"))
    return rows.filter(F.col("at").isNull() | (F.col("at") >= F.lit(since).cast("timestamp"))) if since else rows


def append_cost(records: DataFrame, path: str) -> None:
    records.write.mode("append").json(path)


def write_notes(rendered: DataFrame, root: str, version: str, before: DataFrame | None = None) -> str:
    """A version of the notes table (category, rel_path, content) with ``rendered`` put in by path."""
    columns = rendered.select("category", "rel_path", "content")
    return publish(upsert(before, columns, "rel_path") if before is not None else columns, root, version, key="rel_path")


def write_results(hits: DataFrame, path: str) -> None:
    """One line per query: its results (already cut to k) as a JSON array in order of rank."""
    fields = [c for c in hits.columns if c not in ("query_id", "rank")]
    rows = F.array_sort(F.collect_list(F.struct("rank", F.struct(*fields).alias("hit"))))
    lines = hits.groupBy("query_id").agg(F.transform(rows, lambda x: x["hit"]).alias("results"))
    lines.write.mode("overwrite").json(path)
