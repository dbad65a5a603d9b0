"""Transcripts: tool names, bounding, assembly."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import render_tool_result, render_tool_use

#: Fixed value: tools that name a file.
FILE_TOOLS = ["Read", "Edit", "Write", "NotebookEdit", "MultiEdit"]
LARGE_TOOLS = ["Bash", "Read", "Grep", "Glob"]
LINES = {"moderate": 50, "aggressive": 20}


def resolve_tools(blocks: DataFrame) -> DataFrame:
    """Results get the name of the latest earlier call with their id in their file, or else unknown."""
    place = ["line", "block"] if "block" in blocks.columns else ["line"]
    w = Window.partitionBy("path", "tool_id").orderBy(*place).rowsBetween(Window.unboundedPreceding, -1)
    earlier = F.last(F.when(F.col("kind") == "tool_use", F.col("name")), ignorenulls=True).over(w)
    return blocks.withColumn("tool", F.when(F.col("kind") == "tool_use", F.coalesce("name", F.lit("unknown"))).otherwise(F.coalesce(earlier, F.lit("unknown"))))


def line_count(c: Column) -> Column:
    return F.when(c == "", 0).otherwise(F.size(F.split(c, "\n", -1)))


def bounded_results(results: DataFrame, mode: str = "moderate") -> DataFrame:
    """Rendered results; long ones of file and shell tools become a placeholder, errors never do."""
    n = line_count(F.col("content"))
    strip = F.col("tool").isin(LARGE_TOOLS) & ~F.col("is_error") & (n > LINES[mode])
    held = F.concat(F.lit("[tool_result: "), "tool", F.lit("] ["), n.cast("string"), F.lit(" lines stripped]"))
    return results.withColumn("stripped", strip).withColumn("rendered", F.when(strip, held).otherwise(render_tool_result(F.col("tool"), F.col("content"), F.col("is_error"))))


def assemble(turns: DataFrame) -> DataFrame:
    """One row per session of turns (session, turn, role, text): texts by role and in all, in order."""
    parts = F.array_sort(F.collect_list(F.struct("turn", "role", "text")))
    rows = turns.groupBy("session").agg(F.count("*").alias("line_count"), parts.alias("parts"))

    def joined(role: str | None) -> Column:
        mine = F.col("parts") if role is None else F.filter("parts", lambda p: p["role"] == role)
        return F.array_join(F.transform(mine, lambda p: p["text"]), "\n\n")

    return rows.select("session", "line_count", joined("assistant").alias("assistant_text"), joined("user").alias("user_text"), joined(None).alias("transcript"))


def _cut(c: Column, n: int) -> Column:
    return F.when(F.length(c) > n, F.concat(F.substring(c, 1, n), F.lit("\n…[truncated "), (F.length(c) - n).cast("string"), F.lit(" chars]"))).otherwise(c)


def raw_summary(user: Column, assistant: Column, tool_calls: Column, files: Column) -> Column:
    """What a session is classified by."""
    return F.concat_ws(
        "\n\n",
        F.concat(F.lit("# User messages\n"), _cut(user, 4000)), F.concat(F.lit("# Assistant messages\n"), _cut(assistant, 8000)),
        F.concat(F.lit("# Tool calls: "), tool_calls.cast("string")),
        F.concat(F.lit("# Files touched ("), F.size(files).cast("string"), F.lit("):\n"), F.array_join(F.slice(files, 1, 50), "\n")),
    )


def assembled(lines: DataFrame, blocks: DataFrame, mode: str | None = None) -> DataFrame:
    """One row per transcript from its lines (path, line, ts) and blocks (path, line, block, role, kind, name, tool_id,
    is_error, content, plain): session, project, started_at and ended_at (in order of lines), line_count, tool_calls,
    files (in order of first use), assistant_text, user_text, transcript, raw_summary. ``plain`` messages are no part
    of the transcript. With a ``mode``, long results of file and shell tools are bounded in it."""
    seen = F.when(F.coalesce("ts", F.lit("")) != "", F.col("line"))
    per = lines.groupBy("path").agg(F.count("*").alias("line_count"), F.min_by("ts", seen).alias("started_at"), F.max_by("ts", seen).alias("ended_at"))
    rows = resolve_tools(blocks)
    file = F.when((F.col("kind") == "tool_use") & F.col("name").isin(FILE_TOOLS), F.coalesce(F.get_json_object("content", "$.file_path"), F.get_json_object("content", "$.path")))
    content = F.coalesce("content", F.lit(""))
    result = render_tool_result(F.col("tool"), content, F.col("is_error"))
    if mode:
        result = bounded_results(rows.withColumn("content", content), mode)
        rows, result = result, F.col("rendered")
    shown = F.when(F.col("kind") == "text", F.when(~F.col("plain"), content)).when(F.col("kind") == "tool_use", render_tool_use(F.col("tool"), F.coalesce("content", F.lit("{}")))).when(F.col("kind") == "tool_result", result)
    parts = F.array_sort(F.collect_list(F.struct("line", "block", "kind", "role", content.alias("content"), shown.alias("shown"), file.alias("file"))))
    grouped = rows.groupBy("path").agg(F.count_if(F.col("kind") == "tool_use").alias("tool_calls"), parts.alias("parts"))

    def said(role: str) -> Column:
        return F.array_join(F.transform(F.filter("parts", lambda p: (p["kind"] == "text") & (p["role"] == role)), lambda p: p["content"]), "\n\n")

    texts = grouped.select("path", "tool_calls", F.array_distinct(F.array_compact(F.transform("parts", lambda p: p["file"]))).alias("files"), said("assistant").alias("assistant_text"), said("user").alias("user_text"), F.array_join(F.array_compact(F.transform("parts", lambda p: p["shown"])), "\n\n").alias("transcript"))
    empty = {"tool_calls": F.lit(0).cast("long"), "files": F.array().cast("array<string>"), "assistant_text": F.lit(""), "user_text": F.lit(""), "transcript": F.lit("")}
    out = per.join(texts, "path", "left").withColumns({c: F.coalesce(c, v) for c, v in empty.items()})
    return out.withColumns({"session": F.regexp_replace(F.element_at(F.split("path", "/"), -1), "\\.jsonl$", ""), "project": F.element_at(F.split("path", "/"), -2), "raw_summary": raw_summary(F.col("user_text"), F.col("assistant_text"), F.col("tool_calls"), F.col("files"))})


#: Lines of a run.
RUN = 10_000


def resolve_tools_in_runs(blocks: DataFrame, run: int = RUN) -> DataFrame:
    """As ``resolve_tools``, for sessions of any length: a window holds a run of lines, not a session, and what the runs before
    it knew last is carried over from one row per run and id. Only tool blocks are ordered at all."""
    tools = blocks.filter(F.col("kind").isin("tool_use", "tool_result")).withColumn("run", F.floor(F.col("line") / run))
    call = F.when(F.col("kind") == "tool_use", F.col("name"))
    ident = F.coalesce("tool_id", F.lit(""))
    keyed = tools.withColumns({"__id": ident, "__none": F.col("tool_id").isNull()})
    keys = ["path", "__id", "__none"]
    last = keyed.groupBy(*keys, "run").agg(F.max_by(call, F.when(call.isNotNull(), F.struct("line", "block"))).alias("last"))
    carried = last.withColumn("carried", F.last("last", ignorenulls=True).over(Window.partitionBy(*keys).orderBy("run").rowsBetween(Window.unboundedPreceding, -1))).drop("last")
    within = F.last(call, ignorenulls=True).over(Window.partitionBy(*keys, "run").orderBy("line", "block").rowsBetween(Window.unboundedPreceding, -1))
    found = keyed.join(carried, [*keys, "run"]).withColumn("earlier", F.coalesce(within, "carried"))
    named = found.withColumn("tool", F.coalesce(F.when(F.col("kind") == "tool_use", F.col("name")).otherwise(F.col("earlier")), F.lit("unknown")))
    rest = blocks.filter(~F.coalesce(F.col("kind").isin("tool_use", "tool_result"), F.lit(False))).withColumn("tool", F.lit("unknown"))
    return named.select(*blocks.columns, "tool").unionByName(rest)


def parts(blocks: DataFrame, run: int = RUN, mode: str | None = None) -> DataFrame:
    """(path, part, assistant_text, user_text, transcript): the texts of ``assembled`` in pieces, each of a run of lines; in order
    of part and with an empty line between those that aren't null they make the whole texts. A task holds the lines
    of one run, whatever a session's length."""
    rows = resolve_tools_in_runs(blocks, run)
    content = F.coalesce("content", F.lit(""))
    result = render_tool_result(F.col("tool"), content, F.col("is_error"))
    if mode:
        rows, result = bounded_results(rows.withColumn("content", content), mode), F.col("rendered")
    kind, said = F.col("kind"), lambda role: F.when((F.col("kind") == "text") & (F.col("role") == role), content)
    shown = F.when(kind == "text", F.when(~F.col("plain"), content)).when(kind == "tool_use", render_tool_use(F.col("tool"), F.coalesce("content", F.lit("{}")))).when(kind == "tool_result", result)
    texts = {"assistant_text": said("assistant"), "user_text": said("user"), "transcript": shown}

    def joined(value: Column) -> Column:
        held = F.array_sort(F.collect_list(F.when(value.isNotNull(), F.struct("line", "block", value.alias("text")))))
        return F.when(F.size(held) > 0, F.array_join(F.transform(held, lambda x: x["text"]), "\n\n"))

    return rows.groupBy("path", F.floor(F.col("line") / run).alias("part")).agg(*(joined(v).alias(c) for c, v in texts.items()))


def heads(lines: DataFrame, blocks: DataFrame, pieces: DataFrame) -> DataFrame:
    """One row per transcript, without its texts: session, project, started_at, ended_at, line_count, tool_calls, n_files, and the
    raw_summary, made of the first of its ``pieces`` (see ``parts``) alone. Files are those of all lines; 50 are named."""
    seen = F.when(F.coalesce("ts", F.lit("")) != "", F.col("line"))
    per = lines.groupBy("path").agg(F.count("*").alias("line_count"), F.min_by("ts", seen).alias("started_at"), F.max_by("ts", seen).alias("ended_at"))
    calls = blocks.filter("kind = 'tool_use'")
    file = F.when(F.col("name").isin(FILE_TOOLS), F.coalesce(F.get_json_object("content", "$.file_path"), F.get_json_object("content", "$.path")))
    used = calls.groupBy("path", file.alias("file")).agg(F.count("*").alias("n"), F.min(F.struct("line", "block")).alias("first"))
    rank = F.row_number().over(Window.partitionBy("path").orderBy(F.col("file").isNull(), "first"))
    ranked = used.withColumn("rank", rank)
    named = F.array_sort(F.collect_list(F.when((F.col("rank") <= 50) & F.col("file").isNotNull(), F.struct("rank", "file"))))
    tools = ranked.groupBy("path").agg(F.sum("n").alias("tool_calls"), F.count("file").alias("n_files"), F.transform(named, lambda x: x["file"]).alias("files"))

    def start(column: str, most: int) -> DataFrame:
        w = Window.partitionBy("path").orderBy("part")
        size = F.length(column)
        some = pieces.filter(F.col(column).isNotNull()).withColumns({"before": F.coalesce(F.sum(size + 2).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))})
        first = F.array_sort(F.collect_list(F.when(F.col("before") <= most, F.struct("part", F.substring(column, 1, most + 1).alias("text")))))
        return some.groupBy("path").agg((F.sum(size + 2) - 2).alias(f"{column}_length"), F.array_join(F.transform(first, lambda x: x["text"]), "\n\n").alias(column))

    out = per.join(tools, "path", "left").join(start("user_text", 4000), "path", "left").join(start("assistant_text", 8000), "path", "left")

    def cut(column: str, most: int) -> Column:
        text, size = F.coalesce(column, F.lit("")), F.coalesce(f"{column}_length", F.lit(0))
        return F.when(size > most, F.concat(F.substring(text, 1, most), F.lit("\n…[truncated "), (size - most).cast("string"), F.lit(" chars]"))).otherwise(text)

    count, n = F.coalesce("tool_calls", F.lit(0)), F.coalesce("n_files", F.lit(0))
    text = F.concat_ws(
        "\n\n", F.concat(F.lit("# User messages\n"), cut("user_text", 4000)), F.concat(F.lit("# Assistant messages\n"), cut("assistant_text", 8000)), F.concat(F.lit("# Tool calls: "), count.cast("string")),
        F.concat(F.lit("# Files touched ("), n.cast("string"), F.lit("):\n"), F.coalesce(F.array_join("files", "\n"), F.lit(""))),
    )
    name = F.regexp_replace(F.element_at(F.split("path", "/"), -1), "\\.jsonl$", "")
    return out.select("path", name.alias("session"), F.element_at(F.split("path", "/"), -2).alias("project"), "started_at", "ended_at", "line_count", count.alias("tool_calls"), n.alias("n_files"), text.alias("raw_summary"))


def first_last(records: DataFrame) -> DataFrame:
    """First and last time of each file in line order, not by time."""
    order = F.when(F.col("ts").isNotNull(), F.col("line"))
    return records.groupBy("path").agg(F.min_by("ts", order).alias("first"), F.max_by("ts", order).alias("last"))
