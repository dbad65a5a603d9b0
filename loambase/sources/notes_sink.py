"""A sink for notes as files, one for each, or for lines as files: a Spark data source with task and job commits.

Each task writes below a staging folder of its own. A job that commits has every task's files moved to their places by
the task itself at its end, a rename each, so that a task that is run again, or runs twice, leaves the same file once more;
a job that aborts, or commits, takes the staging folder away. File systems are those that pyarrow opens by URI.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage
from pyspark.sql.types import StructType

from .scratch import bounded_batches

SCHEMA = "rel_path string, content string"


@dataclass
class Written(WriterCommitMessage):
    files: int


class NoteWriter(DataSourceArrowWriter):
    def __init__(self, root: str):
        self.root, self.staging = root.rstrip("/"), f"{root.rstrip('/')}/.staging-{uuid.uuid4().hex}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        """Rows for one path that follow each other make one file. Folders are made once a task."""
        store, root = fs.FileSystem.from_uri(self.root)
        staging = fs.FileSystem.from_uri(f"{self.staging}/{uuid.uuid4().hex}")[1]
        moves, out = [], None
        try:
            for batch in iterator:
                for path, content in zip(batch.column("rel_path").to_pylist(), batch.column("content").to_pylist(), strict=True):
                    place = f"{root}/{path}"
                    if not moves:
                        store.create_dir(staging)
                    if out is None or moves[-1][1] != place:
                        if out is not None:
                            out.close()
                        moves.append((f"{staging}/{len(moves)}", place))
                        out = store.open_output_stream(moves[-1][0], compression=None)
                    out.write((content or "").encode("utf-8", "surrogatepass"))
        finally:
            if out is not None:
                out.close()
        for folder in {place.rpartition("/")[0] for _, place in moves}:
            store.create_dir(folder)
        for held, place in moves:
            store.move(held, place)
        return Written(len(moves))

    def _clear(self) -> None:
        store, staging = fs.FileSystem.from_uri(self.staging)
        if store.get_file_info(staging).type != fs.FileType.NotFound:
            store.delete_dir(staging)

    def commit(self, messages: list[Written | None]) -> None:
        self._clear()

    def abort(self, messages: list[Written | None]) -> None:
        self._clear()


class NoteFiles(DataSource):
    @classmethod
    def name(cls) -> str:
        return "loambase_notes"

    def schema(self) -> str:
        return SCHEMA

    def writer(self, schema: StructType, overwrite: bool) -> NoteWriter:
        return NoteWriter(self.options["path"])


def safe(path):
    """Whether a relative path stays below its root."""
    return path.isNotNull() & (path != "") & ~path.startswith("/") & ~path.rlike(r"(^|/)\.\.?(/|$)") & ~path.endswith("/")


def write_note_files(notes: DataFrame, root: str, order: str | None = None) -> None:
    """One file below ``root`` for each rel_path of notes (rel_path, content), in place of the one that was there; of
    several rows for a path the last by ``order`` counts, or else the greatest content. Rows whose path would lead out of the
    root are left out; null content is an empty file."""
    bounded_batches(notes.sparkSession)
    notes.sparkSession.dataSource.register(NoteFiles)
    last = notes.filter(safe(F.col("rel_path"))).groupBy("rel_path").agg(F.max_by(F.coalesce("content", F.lit("")), F.col(order) if order else F.coalesce("content", F.lit(""))).alias("content"))
    last.write.format("loambase_notes").mode("append").option("path", root).save()


def write_line_files(lines: DataFrame, root: str) -> None:
    """One file below ``root`` for each rel_path of lines (rel_path, line, value), its values in order of line, each with a line end. A file is
    written row by row and never held whole. Rows whose path would lead out of the root are left out."""
    bounded_batches(lines.sparkSession)
    lines.sparkSession.dataSource.register(NoteFiles)
    rows = lines.filter(safe(F.col("rel_path"))).repartition("rel_path").sortWithinPartitions("rel_path", "line")
    rows.select("rel_path", F.concat(F.coalesce("value", F.lit("")), F.lit("\n")).alias("content")).write.format("loambase_notes").mode("append").option("path", root).save()
