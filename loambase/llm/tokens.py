"""Token counts kept as delta-maintained rollups.

A batch is a table of signed rows: an insert adds a document's counts, a delete takes away what the
document counts now, a revision takes that away and adds new counts. Each attempt at a batch is written
to a folder of its own, as a ledger (net rows per document, in buckets of doc_ids) and as a delta (sums by
source, lang and tokenizer version); totals are the sum of the deltas. An attempt counts once it has an
entry in the log. Entries are numbered and each is made by one rename that overwrites nothing, so of two
writers one gets the number and the other starts from what the first has left: a batch given again, or by
two writers at once, counts once, and no document is taken away twice. An attempt that broke off has no entry.
(The rename must not overwrite, as in HDFS; object stores without that need one writer at a time.)

Null text has no tokens; null source, lang and doc_id are groups like any other. Deleting or revising
a document that isn't there takes nothing away. Rows that share a doc_id add up and are deleted
together; an id asked for twice in one batch is deleted once.
"""

from __future__ import annotations

import base64
import json
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache, reduce

import pyarrow as pa
from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .filters import key_filter, passing
from .store import materialize

#: Fixed value: the splitting pattern that belongs to the byte-level vocabularies.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
TOKENIZERS = "/opt/tokenizers"
LEDGER = "doc_id long, source string, lang string, tokenizer string, docs long, tokens long, bytes long"
_KEYS = ["source", "lang", "tokenizer"]
_SUMS = ["docs", "tokens", "bytes"]
BUCKETS = 32


def _bucket(ident: str):
    return F.pmod(F.xxhash64(ident), F.lit(BUCKETS)).cast("int").alias("bucket")


def _added(rows: DataFrame, keys: list[str]) -> DataFrame:
    return rows.groupBy(*keys).agg(*(F.sum(c).alias(c) for c in _SUMS))


@lru_cache(maxsize=4)
def _encoding(vocabulary: bytes):
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, vocabulary.splitlines())}
    return tiktoken.Encoding("given", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def _counts(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _encoding(shared.value).encode_ordinary
        for batch in batches:
            texts = batch.column(batch.num_columns - 1)
            tokens = [len(encode(t.as_py() or "")) for t in texts]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(tokens, pa.int64())], [*batch.schema.names[:-1], "tokens"])

    return run


def vocabulary(spark: SparkSession, name: str, folder: str = TOKENIZERS):
    """The vocabulary file's bytes (under 1 MB), read by the driver and broadcast."""
    with open(f"{folder}/{name}.tiktoken", "rb") as f:
        return spark.sparkContext.broadcast(f.read())


def counted(docs: DataFrame, tokenizer: str, folder: str = TOKENIZERS) -> DataFrame:
    """Ledger rows that insert ``docs``."""
    text = F.col("text").cast("string")
    rows = docs.select(F.col("doc_id").cast("long"), F.col("source").cast("string"), F.col("lang").cast("string"), F.coalesce(F.octet_length(text), F.lit(0)).cast("long").alias("bytes"), text.alias("text"))
    done = rows.mapInArrow(_counts(vocabulary(docs.sparkSession, tokenizer, folder)), "doc_id long, source string, lang string, bytes long, tokens long")
    return done.select("doc_id", "source", "lang", F.lit(tokenizer).alias("tokenizer"), F.lit(1).cast("long").alias("docs"), "tokens", "bytes")


@dataclass(frozen=True)
class State:
    """What the first ``version`` entries of the log add up to. parts: folders of the attempts that count."""

    spark: SparkSession
    version: int
    batches: frozenset[str]
    parts: tuple[str, ...]

    def _summed(self, kind: str, keys: list[str], buckets: list[int] | None = None) -> DataFrame:
        schema = f"{LEDGER}, bucket int" if kind == "ledger" else LEDGER.partition(", ")[2]
        if not self.parts:
            return self.spark.createDataFrame([], LEDGER).select(*keys, *_SUMS)
        # Each attempt is a root of its own, with its own bucket folders.
        rows = reduce(DataFrame.unionByName, (self.spark.read.schema(schema).parquet(f"{p}/{kind}") for p in self.parts))
        if buckets is not None:
            rows = rows.filter(F.col("bucket").isin(buckets))
        return _added(rows, keys).filter("docs <> 0 or tokens <> 0 or bytes <> 0")

    def current(self) -> DataFrame:
        """What each document counts now."""
        return self._summed("ledger", ["doc_id", *_KEYS])

    def removal(self, ids: DataFrame) -> DataFrame:
        """Ledger rows that take away what these doc_ids count now. Only the buckets of these ids are read."""
        gone = materialize(ids.select(F.col("doc_id").cast("long").alias("__id")).distinct(), "gone")
        buckets = [r[0] for r in gone.select(_bucket("__id")).distinct().collect()]
        rows = self._summed("ledger", ["doc_id", *_KEYS], buckets).join(gone, F.col("doc_id").eqNullSafe(F.col("__id")), "left_semi")
        return rows.select("doc_id", *_KEYS, *((-F.col(c)).alias(c) for c in _SUMS))

    def totals(self) -> DataFrame:
        """source, lang, tokenizer, docs, tokens, bytes; groups that are down to nothing are left out."""
        return self._summed("delta", _KEYS)


class Rollup:
    """Totals in a folder that driver and executors share: ``attempts`` with ledgers and deltas, and a ``log``
    whose numbered entries say which attempts count."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root
        self._jvm = spark.sparkContext._jvm
        self._conf = spark.sparkContext._jsc.hadoopConfiguration()

    def _path(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")

    def _claim(self, number: int, entry: dict) -> bool:
        """Make the log entry of this number, whole or not at all; false if another writer has made it."""
        made, place = self._path(f"log/_{uuid.uuid4().hex}"), self._path(f"log/{number:012d}")
        fs = made.getFileSystem(self._conf)
        out = fs.create(made)
        out.write(json.dumps(entry).encode())
        out.close()
        hadoop = self._jvm.org.apache.hadoop.fs
        no_overwrite = self.spark.sparkContext._gateway.new_array(getattr(hadoop, "Options$Rename"), 0)
        try:
            hadoop.FileContext.getFileContext(self._conf).rename(made, place, no_overwrite)
        except Py4JJavaError as e:
            if not e.java_exception.getClass().getName().endswith("FileAlreadyExistsException"):
                raise
            fs.delete(made, False)
            return False
        return True

    def state(self) -> State:
        """The log is read from its end back to where the last compaction reaches."""
        top = self._path("log")
        fs = top.getFileSystem(self._conf)
        numbers = sorted((int(x.getPath().getName()) for x in fs.listStatus(top) if x.getPath().getName().isdigit()), reverse=True) if fs.exists(top) else []
        batches, parts, upto, compacted = set(), [], 0, False
        for n in numbers:
            if n <= upto:
                break
            stream = fs.open(self._path(f"log/{n:012d}"))
            entry = json.loads(self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
            stream.close()
            folder = f"{self.root}/attempts/{entry['attempt']}"
            if "batch" in entry:
                batches.add(entry["batch"])
                parts.append(folder)
            elif not compacted:
                batches |= set(entry["batches"])
                parts.append(folder)
                upto, compacted = entry["upto"], True
        return State(self.spark, max(numbers, default=0), frozenset(batches), tuple(parts))

    def committed(self) -> list[str]:
        return sorted(self.state().batches)

    def _written(self, signed: DataFrame) -> str:
        """An attempt: the ledger (net rows per document, in buckets of doc_ids, each in 16 slices) and its delta."""
        attempt = uuid.uuid4().hex
        path = f"{self.root}/attempts/{attempt}"
        net = _added(signed, ["doc_id", *_KEYS]).withColumn("bucket", _bucket("doc_id"))
        net.repartition("bucket", F.pmod(F.xxhash64("doc_id", "source"), F.lit(16))).write.partitionBy("bucket").parquet(f"{path}/ledger")
        _added(self.spark.read.schema(f"{LEDGER}, bucket int").parquet(f"{path}/ledger"), _KEYS).write.parquet(f"{path}/delta")
        return attempt

    def commit(self, batch: str, signed: DataFrame | Callable[[State], DataFrame]) -> bool:
        """Apply signed ledger rows once; false if the batch was there. Rows that depend on what documents count
        now are given as a function of the state: if another writer commits meanwhile, they are made anew."""
        attempt = None
        while batch not in (state := self.state()).batches:
            if attempt is None or callable(signed):
                attempt = self._written(signed(state) if callable(signed) else signed)
            if self._claim(state.version + 1, {"batch": batch, "attempt": attempt}):
                return True
        return False

    def compact(self) -> None:
        """Put one attempt with the net rows of all documents in place of those so far. Folders that no longer
        count stay, for readers of older states."""
        state = self.state()
        entry = {"attempt": self._written(state.current()), "upto": state.version, "batches": sorted(state.batches)}
        while not self._claim(self.state().version + 1, entry):
            pass

    def current(self) -> DataFrame:
        return self.state().current()

    def removal(self, ids: DataFrame) -> Callable[[State], DataFrame]:
        """For ``commit``: rows that take away what these doc_ids count at that time."""
        return lambda state: state.removal(ids)

    def totals(self) -> DataFrame:
        return self.state().totals()


def maintained(docs: DataFrame, labels: DataFrame, root: str, folder: str = TOKENIZERS) -> DataFrame:
    """Totals after three batches, one of them given twice: all documents come in; those labelled as
    of low quality go; those labelled toxic are counted anew with the multilingual vocabulary."""
    rollup = Rollup(docs.sparkSession, root)
    rollup.commit("1-insert", counted(docs, "byte_bpe_50k", folder))
    low = labels.filter("quality = 0").select("doc_id")
    rollup.commit("2-delete", rollup.removal(low))
    again = labels.filter("toxic = 1").select("doc_id").join(low.withColumnRenamed("doc_id", "low"), F.col("doc_id") == F.col("low"), "left_anti").distinct()
    # Only texts that may be counted anew move.
    near = passing(docs.filter("doc_id is not null"), "doc_id", key_filter(again, "doc_id"))
    revised = near.join(again.withColumnRenamed("doc_id", "__id"), F.col("doc_id") == F.col("__id"), "left_semi")
    rollup.commit("3-revise", lambda state: state.removal(again).unionByName(counted(revised, "byte_bpe_multi_50k", folder)))
    rollup.commit("2-delete", rollup.removal(low))
    return rollup.totals()
