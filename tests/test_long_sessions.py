"""Sessions assembled in runs of lines against those assembled whole."""

import random

import pytest

from loambase.operators import sessions
from pyspark.sql import functions as F

SCHEMA = "path string, line long, block int, role string, kind string, name string, tool_id string, is_error boolean, content string, plain boolean"


def blocks(n, rng):
    out = []
    for path in ("/p/a/s1.jsonl", "/p/b/s2.jsonl"):
        for line in range(n):
            for block in range(rng.randrange(0, 3)):
                kind = rng.choice(["text", "tool_use", "tool_result"])
                ident = rng.choice(["x", "y", "z", None]) if kind != "text" else None
                content = {"text": "w" * rng.randrange(0, 400), "tool_use": f'{{"file_path":"/f{rng.randrange(70)}"}}', "tool_result": f"r{line}"}[kind]
                out.append((path, line, block, rng.choice(["user", "assistant", "system"]), kind, rng.choice(["Read", "Edit", "Bash", None]) if kind == "tool_use" else None, ident, rng.random() < 0.2, content, rng.random() < 0.2))
    return out


@pytest.mark.parametrize("run", [1, 7, 1000])
def test_runs(spark, run):
    rows = spark.createDataFrame(blocks(120, random.Random(run)), SCHEMA)
    key = lambda df: {(r.path, r.line, r.block): r.tool for r in df.filter("kind <> 'text'").collect()}
    assert key(sessions.resolve_tools_in_runs(rows, run)) == key(sessions.resolve_tools(rows))
    lines = rows.select("path", "line").distinct().withColumn("ts", F.when(F.col("line") % 3 == 0, F.concat(F.lit("t"), F.col("line").cast("string"))))
    whole = {r.path: r for r in sessions.assembled(lines, rows).collect()}
    pieces = sessions.parts(rows, run)
    got = {}
    for r in pieces.orderBy("path", "part").collect():
        for c in ("assistant_text", "user_text", "transcript"):
            if r[c] is not None:
                got.setdefault((r.path, c), []).append(r[c])
    for path, want in whole.items():
        for c in ("assistant_text", "user_text", "transcript"):
            assert "\n\n".join(got.get((path, c), [])) == want[c]
    for r in sessions.heads(lines, rows, pieces).collect():
        want = whole[r.path]
        assert (r.session, r.project, r.started_at, r.ended_at, r.line_count, r.tool_calls, r.n_files) == (want.session, want.project, want.started_at, want.ended_at, want.line_count, want.tool_calls, len(want.files))
        assert r.raw_summary == want.raw_summary
