"""Many small files: folders are made once a task, and files are read as Spark's reader gives them, in few tasks."""

import json

import pyarrow as pa
from loambase.sources import files, notes_sink
from pyarrow import fs
from pyspark.sql import functions as F


def test_folders_are_made_once(tmp_path, monkeypatch):
    made = []

    class Store:
        def __init__(self, real):
            self.real = real

        def create_dir(self, path, **kwargs):
            made.append(path)
            self.real.create_dir(path, **kwargs)

        def __getattr__(self, name):
            return getattr(self.real, name)

    class Stores(fs.FileSystem):
        @staticmethod
        def from_uri(uri):
            store, path = fs.FileSystem.from_uri(uri)
            return Store(store), path

    monkeypatch.setattr(notes_sink, "fs", type("fs", (), {"FileSystem": Stores, "FileType": fs.FileType}))
    rows = pa.RecordBatch.from_pydict({"rel_path": [f"d{i % 2}/{i}.md" for i in range(100)], "content": [str(i) for i in range(100)]})
    assert notes_sink.NoteWriter(str(tmp_path)).write(iter([rows.slice(0, 60), rows.slice(60)])).files == 100
    assert len(made) <= 3 and {p.stem: p.read_text() for p in tmp_path.glob("d*/*.md")} == {str(i): str(i) for i in range(100)}


def test_read_as_spark_reads(spark, tmp_path):
    names = ["a.md", "b c.md", "ü%20.md", "h#q?.md", "[z].md", "d/e f/g.md", "_x.md", ".y.md", ".h/y.md", "_t/y.md", "_k=1/y.md", "empty.md", "n.MD", "n.txt", "d/index.md", "summaries/s.md"]
    for name in names:
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(b"" if name == "empty.md" else b"x\r\n\xff" + name.encode())
    for i in range(300):
        (tmp_path / f"many{i}.md").write_text("# t\n")
    for root in (str(tmp_path), f"file://{tmp_path}/"):
        for pattern in ("*.md", "*.[mM][dD]"):
            rows = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", pattern).text(root, wholetext=True)
            want = sorted(map(tuple, rows.select(F.col("_metadata.file_path"), F.hex("value")).collect()))
            got = files._texts(spark, root, pattern)
            assert sorted(map(tuple, got.select("path", F.hex("content")).collect())) == want and len(want) > 300
            assert got.rdd.getNumPartitions() == files.READS * spark.sparkContext.defaultParallelism
    assert "many7" in {r.title for r in files.note_corpus(spark, str(tmp_path)).collect()}


def test_line_files(spark, tmp_path):
    rows = [(p, n, json.dumps({"n": n, "p": p})) for p in ("c/a.jsonl", "c/b.jsonl", "d.jsonl") for n in range(200)] + [("../up.jsonl", 1, "x"), (None, 1, "x"), ("e.jsonl", 1, None)]
    notes_sink.write_line_files(spark.createDataFrame(rows, "rel_path string, line int, value string").repartition(7), str(tmp_path / "r"))
    want = {p: "".join(v + "\n" for q, _, v in rows if q == p) for p in ("c/a.jsonl", "c/b.jsonl", "d.jsonl")} | {"e.jsonl": "\n"}
    assert {str(p.relative_to(tmp_path / "r")): p.read_text() for p in tmp_path.rglob("*.jsonl")} == want
    assert files.transcript_lines(spark, str(tmp_path / "r")).groupBy("path").count().agg(F.min("count"), F.count("*")).first() == (200, 3)
