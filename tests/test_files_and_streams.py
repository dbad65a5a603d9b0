"""File sources, replies, pages and streams on small fixtures."""

import json
import shutil

from loambase.functions import replies
from loambase.operators import pages
from loambase.operators.state import upsert
from loambase.sources import files
from loambase.streaming import jobs
from loambase.streaming.state import Buckets, batches
from pyspark.sql import functions as F


def one(spark, schema, rows, column):
    return [r[0] for r in spark.createDataFrame(rows, schema).select(column.alias("x")).collect()]


def test_transcripts(spark, tmp_path):
    folder = tmp_path / "t" / "proj"
    folder.mkdir(parents=True)
    events = [
        {"type": "user", "timestamp": "2026-01-01T00:00:00Z", "message": {"role": "user", "content": "hi"}},
        {"type": "assistant", "message": {"role": "assistant", "content": [{"type": "text", "text": "yo"}, {"type": "tool_use", "id": "a", "name": "Bash", "input": {"command": "ls"}}]}},
        {"type": "user", "message": {"role": "user", "content": [{"type": "tool_result", "tool_use_id": "a", "is_error": True, "content": [{"type": "text", "text": "bad"}]}]}},
        {"type": "summary"},
    ]
    (folder / "s1.jsonl").write_text("\n".join(map(json.dumps, events)) + "\n{broken\n\n")
    scanned = files.scan(spark, str(tmp_path / "t")).collect()
    assert len(scanned) == 1 and len(scanned[0].hash) == 64
    lines = files.transcript_lines(spark, str(tmp_path / "t"))
    assert lines.count() == 5 and lines.filter("event is null").count() == 1
    got = [(r.line, r.block, r.kind, r.name, r.tool_id, r.is_error, r.content) for r in files.transcript_blocks(lines).orderBy("line", "block").collect()]
    assert got == [(0, 0, "text", None, None, False, "hi"), (1, 0, "text", None, None, False, "yo"), (1, 1, "tool_use", "Bash", "a", False, '{"command":"ls"}'), (2, 0, "tool_result", None, "a", True, "bad")]
    assert tuple(lines.select(files.session_of(F.col("path")).alias("s")).first().s) == ("s1", "proj")


def test_articles_and_notes(spark, tmp_path):
    (tmp_path / "summaries").mkdir()
    (tmp_path / "a.md").write_text('---\ntitle: "A: b"\nsource: http://x\ntags: [p, "q"]\n---\n\n# Head\n\none two')
    (tmp_path / "b.MD").write_text("# Second\nwords")
    (tmp_path / "c.md").write_text("---\ntags:\n  - r\n  - s\n---\nplain")
    (tmp_path / "index.md").write_text("x")
    (tmp_path / "summaries" / "w.md").write_text("x")
    got = {r.path.rsplit("/", 1)[1]: (r.title, r.url, r.tags, r.word_count) for r in files.articles(spark, str(tmp_path)).collect()}
    assert got["a.md"] == ("A: b", "http://x", ["p", "q"], 4) and got["b.MD"] == ("Second", None, [], 3) and got["c.md"] == ("c", None, ["r", "s"], 1)
    assert sorted(r.title for r in files.note_corpus(spark, str(tmp_path)).collect()) == ["a", "c"]


def test_cost_log_and_sinks(spark, tmp_path):
    log = tmp_path / "log"
    log.mkdir()
    (log / "x.json").write_text('{"ts": "2026-01-02T00:00:00Z", "stage": "a"}\n{"ts": "2025-01-02T00:00:00Z", "stage": "b"}\n{"stage": "c"}\nnonsense\n')
    assert sorted(r.stage for r in files.cost_log(spark, str(log), "2026-01-01").collect()) == ["a", "c"]
    files.append_cost(spark.createDataFrame([("2026-03-01T00:00:00Z", "d")], "ts string, stage string"), str(log))
    assert files.cost_log(spark, str(log)).count() == 4
    schema = "category string, rel_path string, content string"
    path = files.write_notes(spark.createDataFrame([("tool", "a", "1"), ("tool", "b", "2")], schema), str(tmp_path / "n"), "0")
    path = files.write_notes(spark.createDataFrame([("tool", "b", "3")], schema), str(tmp_path / "n"), "1", spark.read.parquet(path).select("category", "rel_path", "content"))
    assert {r.rel_path: r.content for r in spark.read.parquet(path).collect()} == {"a": "1", "b": "3"}
    files.write_results(spark.createDataFrame([(1, 2, "y"), (1, 1, "x")], "query_id int, rank int, path string"), str(tmp_path / "r"))
    assert json.loads(spark.read.text(str(tmp_path / "r")).first().value)["results"] == [{"path": "x"}, {"path": "y"}]


def test_replies(spark):
    texts = ['so: {"category": "tool", "topic": " T ", "project": "", "confidence": 3, "themes": [" a ", 1, ""]} end', '{"category": "odd", "topic": 5, "confidence": "0.5"}', "{broken}", "", None]
    got = [tuple(r) for r in one(spark, "r string", [(t,) for t in texts], replies.classification(F.col("r"), F.lit("P")))]
    empty = ("pattern", "unknown", "P", 0.0, [])
    assert got == [("tool", "T", "P", 1.0, ["a"]), ("pattern", "unknown", "P", 0.5, []), empty, empty, empty]
    got = [tuple(r) for r in one(spark, "r string", [('{"isDuplicate": true, "confidence": 0.4, "reason": "r", "keepWhich": "A"}',), ('{"isDuplicate": "true", "keepWhich": "C"}',), (None,)], replies.verdict(F.col("r")))]
    assert got == [(True, 0.4, "r", "A"), (False, 0.0, "", "merge"), (False, 0.0, "", "merge")]
    got = [tuple(r) for r in one(spark, "r string", [('TITLE: "Hi"\nConfidence: 2\n\n# Head\n\ntext\nTitle: again',), ("only",), ("",)], replies.composed(F.col("r")))]
    assert got == [("Hi", "text\nTitle: again", 1.0), ("", "only", 0.0), ("", "", 0.0)]


def test_related(spark):
    text = "a\n## Related\n- One Two\n- [[kept]]\n- [Name](u)\n# Next\n- b\n\n"
    assert one(spark, "t string", [(text,), ("x\n## Related notes\ny",), ("## Relatedness\nz",)], replies.strip_related(F.col("t"))) == ["a\n# Next\n- b", "x", "## Relatedness\nz"]
    assert one(spark, "t string", [(text,), (None,), ("",)], replies.link_related(F.col("t"))) == ["a\n## Related\n- [[one-two]]\n- [[kept]]\n- [[name]]\n# Next\n- b\n\n", None, ""]


def test_payloads_and_skills(spark):
    rows = [("Write", json.dumps({"path": "p", "content": "x" * 2001})), ("MultiEdit", json.dumps({"edits": [{"old_string": "y" * 1001, "new_string": "z"}]})), ("Bash", "{ }"), ("Write", "{"), ("Edit", None)]
    got = one(spark, "n string, p string", rows, replies.bound_payload(F.col("n"), F.col("p")))
    assert got == ['{"path":"p","content":"[truncated 2001 chars of content for Write]"}', '{"edits":[{"old_string":"[truncated 1001 chars of old_string for MultiEdit]","new_string":"z"}]}', "{ }", "{", None]
    blocks = [("f", 1, "tool_use", "Skill", False, '{"skill": "s"}'), ("f", 2, "tool_result", "Skill", False, "x" * 1001), ("f", 3, "tool_use", "Skill", False, "{"), ("f", 4, "tool_result", "Skill", True, "x" * 1001), ("f", 5, "tool_result", "Skill", False, "x" * 1001)]
    out = pages.bounded_skills(spark.createDataFrame(blocks, "path string, line int, kind string, tool string, is_error boolean, content string"))
    assert [r.loaded for r in out.orderBy("line").collect()] == [None, "[tool_result: Skill] [Skill s loaded]", None, None, None]


def test_pages(spark):
    notes = spark.createDataFrame([("tools/a.md", "---\ntopic: t\n---\nx"), ("tools/b.md", "y"), ("c.md", "z")], "rel_path string, content string")
    decided = spark.createDataFrame([("tools/a.md", "approve"), ("tools/b.md", "reject"), ("tools/b.md", "approve")], "rel_path string, decision string")
    got = {r.rel_path: r.content for r in pages.apply_reviews(notes, decided, "2026-01-01").collect()}
    assert got.keys() == {"tools/a.md", ".rejected/b.md", "c.md"} and "verified: true" in got["tools/a.md"] and "rejected_at: 2026-01-01" in got[".rejected/b.md"] and got["c.md"] == "z"
    kept = spark.createDataFrame([("p", "old\n\n---\n## Changelog\n\none\ntwo\n")], "slug string, content string")
    fresh = spark.createDataFrame([("p", "new", "three"), ("q", "other", "first")], "slug string, body string, entry string")
    got = {r.slug: r.content for r in pages.with_changelog(fresh, kept).collect()}
    assert got == {"p": "new\n\n---\n## Changelog\n\nthree\none\ntwo\n", "q": "other\n\n---\n## Changelog\n\nfirst\n"}
    assert one(spark, "t string", [("a<s>b<e>c",), ("a",), ("a\n",)], pages.splice(F.col("t"), F.lit("N"), "<s>", "<e>")) == ["aNc", "a\n\nN\n", "a\n\nN\n"]
    asked = pages.look_up(spark.createDataFrame([("P",), ("No Page",)], "name string"), kept).orderBy("slug").collect()
    assert [r.hint for r in asked] == ["not generated yet: no-page", None]
    hits = spark.createDataFrame([(1, 1, "topics/a.md", "a", "x", 0.9), (1, 2, "tools/b.md", "b", "---\nk: v\n---\ny", 0.5)], "query_id int, rank int, rel_path string, title string, content string, score double")
    assert [tuple(r) for r in pages.compose_sources(hits).collect()] == [(1, 1, "### b (0.5000)\n\ny")]


def test_recent_articles(spark):
    rows = [("a", "A", "c", "2026-01-01", None, False, None, "x"), ("b", "B", "c", None, "2026-02-01", False, None, "y"), ("c", "C", "c", "bad", None, False, None, "z"), ("d", "D", "c", "2026-03-01", None, True, None, "w"), ("e", "E", "c", "2026-03-01", None, False, "boom", "w")]
    t = spark.createDataFrame(rows, "path string, title string, category string, published string, distilled_at string, skipped boolean, error string, content string")
    t = t.withColumn("url", F.lit("u")).withColumn("author", F.lit(None).cast("string")).withColumn("confidence", F.lit(0.5))
    assert [r.title for r in pages.recent_articles(t).collect()] == ["B", "A", "C"]
    assert [r.title for r in pages.recent_articles(t, since="2026-01-15").collect()] == ["B"]


def test_streams(spark, tmp_path):
    src, schema = str(tmp_path / "src"), "path string, hash string, content string, ts timestamp"

    def put(*rows):
        spark.createDataFrame(rows, "path string, hash string, content string, ts string").withColumn("ts", F.col("ts").cast("timestamp")).coalesce(1).write.mode("append").parquet(src)

    def sweep():
        q = jobs.keep_sessions(spark.readStream.schema(schema).parquet(src).drop("ts"), lambda d: d, "path string, hash string, content string", str(tmp_path / "state"), str(tmp_path / "ck"))
        q.awaitTermination()
        assert q.exception() is None

    put(("a", "1", "one", "2026-01-05"), ("a", "1", "one", "2026-01-05"), ("b", "1", "two", "2026-01-06"))
    sweep()
    put(("b", "2", "new", "2026-01-20"), ("a", "1", "ignored", "2026-01-20"))
    sweep()
    kept = Buckets(str(tmp_path / "state"), "path string, hash string, content string")
    assert {r.path: r.content for r in kept.current(spark).collect()} == {"a": "one", "b": "new"}
    q = jobs.once_each(spark.readStream.schema(schema).parquet(src), "30 days").writeStream.format("memory").queryName("each").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("each").count() == 3
    records = spark.readStream.schema(schema).parquet(src).select("ts", F.lit("s").alias("stage"), F.lit("p").alias("provider"), F.lit(1).alias("input_tokens"), F.lit(2).alias("output_tokens"))
    q = jobs.weekly_cost(records, "1 day").writeStream.format("memory").queryName("weeks").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    assert [(str(r.week_start), r.calls) for r in spark.table("weeks").collect()] == [("2026-01-05 00:00:00", 3)]


def embedder():
    def embed(texts):
        if any(t == "bad" for t in texts):
            raise ValueError("no")
        return [[float(len(t))] for t in texts]

    return embed


def test_isolated(spark):
    rows = spark.createDataFrame([("a", "xy", 1), ("b", "bad", 2), ("c", " ", 3), ("d", None, 4)], "path string, content string, n int").coalesce(1)
    got = {r.path: (r.embedding, r.error, r.n) for r in jobs.embedded(rows, embedder()).collect()}
    assert got == {"a": ([2.0], None, 1), "b": (None, "ValueError: no", 2), "c": (None, None, 3), "d": (None, None, 4)}
    assert jobs.inferred(rows.withColumnRenamed("content", "prompt"), lambda t: [x.upper() for x in t]).filter("reply = 'XY' and error is null").count() == 1


def test_heal_backlog(spark, tmp_path):
    src, schema = str(tmp_path / "src"), "path string, content string, embedding array<double>"
    spark.createDataFrame([("a", "xy", None), ("b", "bad", None), ("c", " ", None), ("d", "has", [1.0])], schema).coalesce(1).write.parquet(src)
    q = jobs.heal_backlog(spark.readStream.schema(schema).parquet(src), embedder(), str(tmp_path / "out"), str(tmp_path / "ck"))
    q.awaitTermination()
    assert q.exception() is None
    assert {r.path: (r.embedding, r.error) for r in spark.read.parquet(str(tmp_path / "out" / "batch=0")).collect()} == {"a": ([2.0], None), "b": (None, "ValueError: no")}
    # The failed row is tried again with the next batch, and not once it has succeeded.
    for n, new in enumerate((("e", "later", None), ("f", "last", None)), 1):
        spark.createDataFrame([new], schema).coalesce(1).write.mode("append").parquet(src)
        jobs.heal_backlog(spark.readStream.schema(schema).parquet(src), lambda t: [[float(len(x))] for x in t], str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination()
        assert batches(spark, str(tmp_path / "out" / "open")) == list(range(n + 1))
        got = {r.path: r.error for r in spark.read.parquet(str(tmp_path / "out" / f"batch={n}")).collect()}
        assert got == ({"e": None, "b": None} if n == 1 else {"f": None})


def test_bucket_state(spark, tmp_path):
    """A batch writes only the buckets of its keys; one that runs again, also after a crash before its commit, changes nothing."""
    state = Buckets(str(tmp_path), "path string, hash string, n long", count=64)
    rows = lambda n, *paths: spark.createDataFrame([(p, f"{p}{n}", n) for p in paths], "path string, hash string, n long")
    put = lambda old, new: upsert(old, new, "path")
    every = [f"p{i}" for i in range(400)]
    state.apply(rows(0, *every), 0, put)
    state.apply(rows(1, "p3", "p7", "q"), 1, put)
    written = lambda n: {p.name for p in (tmp_path / "data" / f"batch={n}").glob("bucket=*")}
    assert len(written(0)) > 50 and 1 <= len(written(1)) <= 3
    want = {p: 1 if p in ("p3", "p7") else 0 for p in every} | {"q": 1}
    assert {r.path: r.n for r in state.current(spark).collect()} == want
    # Run again; then as if it had died before its commit; then with a gap in the numbers.
    state.apply(rows(1, "p3", "p7", "q"), 1, put)
    assert {r.path: r.n for r in state.current(spark).collect()} == want
    shutil.rmtree(tmp_path / "commits" / "batch=1")
    assert {r.path: r.n for r in state.current(spark).collect()} == dict.fromkeys(every, 0)
    state.apply(rows(1, "p3", "p7", "q"), 1, put)
    state.apply(rows(5, "q"), 5, lambda old, new: old.join(new.select("path"), "path", "left_anti"))
    assert {r.path: r.n for r in state.current(spark).collect()} == {p: n for p, n in want.items() if p != "q"}
    state.apply(rows(6), 6, put)
    assert batches(spark, str(tmp_path / "commits")) == [0, 1, 5]
