"""The stored index against a search of the texts; the note sink when tasks run again or fail."""

import pyarrow as pa
import pytest

from loambase.operators import index, search
from loambase.sources import notes_sink

SCHEMA = "doc long, text string, verified boolean"


def test_index(spark, tmp_path):
    root = str(tmp_path / "i")
    first = [(d, f"alpha beta{d} common word{d % 3}", d % 2 == 0) for d in range(30)] + [(99, None, None), (None, "alpha", True)]
    index.add(spark.createDataFrame(first, SCHEMA), root, 0)
    now = {d: (t, v) for d, t, v in first if d is not None}
    second = [(3, "alpha alpha gamma", False), (40, "gamma common", True)]
    gone = spark.createDataFrame([(5,), (40,), (77,)], "doc long")
    for _ in range(2):  # a batch that runs again
        index.add(spark.createDataFrame(second, SCHEMA), root, 1, gone)
    now |= {3: second[0][1:], 40: second[1][1:]}
    del now[5]
    asked = spark.createDataFrame([(1, "alpha gamma"), (2, "word1 beta7 Common"), (3, "nothing here"), (4, None)], "query long, text string")
    docs = spark.createDataFrame([(d, t, bool(v)) for d, (t, v) in now.items()], SCHEMA)
    want = sorted(tuple(r) for r in search.tfidf(docs.fillna("", ["text"]), asked).collect())
    assert want and sorted(tuple(r) for r in index.search(spark, root, asked).collect()) == want
    index.compacted(spark, root, str(tmp_path / "j"))
    assert sorted(tuple(r) for r in index.search(spark, str(tmp_path / "j"), asked).collect()) == want
    plan = index.postings(spark, root, spark.createDataFrame([("alpha",)], "term string"))._jdf.queryExecution().toString()
    assert "PartitionFilters: [bucket" in plan or "PartitionFilters: [isnotnull(bucket" in plan


def batches(*rows):
    return iter([pa.RecordBatch.from_pylist([{"rel_path": p, "content": c} for p, c in rows], pa.schema([("rel_path", pa.string()), ("content", pa.string())]))])


def test_sink_runs_again(tmp_path):
    writer = notes_sink.NoteWriter(str(tmp_path))
    rows = [("a/x.md", "one"), ("y.md", None)]
    told = [writer.write(batches(*rows)), writer.write(batches(*rows))]

    def broken():
        yield from batches(("z.md", "half"))
        raise OSError("lost")

    with pytest.raises(OSError):
        writer.write(broken())
    writer.commit(told)
    assert sorted(str(p.relative_to(tmp_path)) for p in tmp_path.rglob("*") if p.is_file()) == ["a/x.md", "y.md"]
    assert (tmp_path / "a/x.md").read_text() == "one" and (tmp_path / "y.md").read_text() == ""
    failed = notes_sink.NoteWriter(str(tmp_path))
    with pytest.raises(OSError):
        failed.write(broken())
    failed.abort([None])
    assert not list(tmp_path.glob(".staging*"))


def test_note_files(spark, tmp_path):
    rows = [("a.md", "1", 1), ("a.md", "2", 2), ("d/b.md", "ü", 1), ("../up.md", "x", 1), ("/abs.md", "x", 1), (None, "x", 1), ("", "x", 1), ("d/", "x", 1)]
    notes_sink.write_note_files(spark.createDataFrame(rows, "rel_path string, content string, n int").repartition(3), str(tmp_path / "r"), "n")
    assert {str(p.relative_to(tmp_path)): p.read_text() for p in tmp_path.rglob("*") if p.is_file()} == {"r/a.md": "2", "r/d/b.md": "ü"}
