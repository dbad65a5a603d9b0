"""Toxic passages by maximum-scoring segments.

Each word has a log-odds of standing in toxic text: a hierarchy of Dirichlet priors over its
prefixes of 4 to 8 characters and the whole word, where each level's prior is the level above and
the root is even. A linear scan finds all maximal segments of a document's log-odds, less a
constant that makes their mean negative. The best segments of clean documents follow an
extreme-value law; with its parameters a segment's score becomes an expected count E in a document
of that length. A document's evidence is the sum of -ln E over its segments with E < 1 and a score of
``LEAST_SEGMENT`` or more (others are left out), and a logistic curve fitted to labelled documents turns
it into a score.

Counts are of documents per feature in a table of ``BUCKETS`` hash buckets, so that the model has
one size on any corpus. They are learned on at most ``most_labels`` labelled rows, chosen by a hash of
the doc_id. The extreme-value law and the logistic curve are fitted to all labelled rows; one that the
counts hold has its own taken out. Scores come from texts alone. Null and empty texts hold no words and have the least score. Several labels of one doc_id:
any toxic one counts. Rows that share a doc_id are scored one by one. Without toxic or without clean
rows to learn from, all scores are under 1e-8.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .filters import key_filter, passing
from .store import materialize, small_batches

BUCKETS = 1 << 20
LEVELS = (4, 5, 6, 7, 8)
#: Weight of each level's prior, in documents; and what every word's log-odds is lowered by.
PRIOR, SHIFT = 4.0, 0.7
_WORD = re.compile(r"\w+")
#: Words remembered by a task (some 25 MB).
_MOST_CACHED = 100_000
#: Segments of a lower score aren't looked at.
LEAST_SEGMENT = 1.0


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % 5 == 0


def words_of(text: str | None) -> list[str]:
    return _WORD.findall(text.lower()) if text else []


def features(word: str) -> list[int]:
    """Buckets of the word's prefixes and of the word; -1 where it is too short."""
    out = [zlib.crc32(word[:n].encode("utf-8", "surrogatepass"), n) % BUCKETS if len(word) > n else -1 for n in LEVELS]
    out.append(zlib.crc32(word.encode("utf-8", "surrogatepass")) % BUCKETS)
    return out


class _Table:
    """Features of the words that a task met lately."""

    def __init__(self) -> None:
        self.at: dict[str, int] = {}
        self.rows = np.zeros((_MOST_CACHED, len(LEVELS) + 1), np.int32)

    def of(self, words: list[str]) -> np.ndarray:
        if len(self.at) + len(words) > _MOST_CACHED:
            self.at.clear()
        if len(words) > _MOST_CACHED:
            return np.array([features(w) for w in words], np.int32)
        for w in words:
            if w not in self.at:
                self.rows[len(self.at)] = features(w)
                self.at[w] = len(self.at)
        return self.rows[[self.at[w] for w in words]]


@dataclass
class Model:
    """toxic, clean: documents per bucket. rate: how many counts toxic has for one of clean."""

    toxic: np.ndarray
    clean: np.ndarray
    rate: float
    lam: float = 1.0
    k: float = 1.0
    intercept: float = -20.0
    slope: float = 0.0

    def log_odds(self, rows: np.ndarray, own: int | None = None) -> np.ndarray:
        """Of words with these features; ``own``: the label of the document they come from, whose counts go."""
        theta = np.full(len(rows), 0.5)
        for level in range(rows.shape[1]):
            at = rows[:, level]
            toxic, clean = self.toxic[at].astype(float) - (own == 1), (self.clean[at].astype(float) - (own == 0)) * self.rate
            theta = np.where(at >= 0, (toxic + PRIOR * theta) / (toxic + clean + PRIOR), theta)
        return np.log(theta / (1 - theta)) - SHIFT


def segments(scores: np.ndarray) -> list[tuple[float, int, int]]:
    """All maximal scoring segments (score, start, end), in linear time: each segment keeps the last
    one before it with a lower left sum, so that none is looked at twice."""
    total = np.concatenate([[0.0], np.cumsum(scores)])
    found: list[tuple[float, float, int, int, int]] = []  # left sum, right sum, start, end, last lower
    for i in np.flatnonzero(scores > 0).tolist():
        left, right, start, j = total[i], total[i + 1], i, len(found) - 1
        while True:
            while j >= 0 and found[j][0] >= left:
                j = found[j][4]
            if j < 0 or found[j][1] >= right:
                break
            left, start = found[j][0], found[j][2]
            del found[j:]
            j = len(found) - 1
        found.append((left, right, start, i + 1, j))
    return [(r - l, s, e) for l, r, s, e, _ in found]


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    table, counts = _Table(), np.zeros((2, BUCKETS), np.int64)
    for batch in batches:
        for text, toxic in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
            at = np.unique(table.of(list(set(words_of(text.as_py())))))
            counts[toxic, at[at >= 0]] += 1
    at = np.flatnonzero(counts.any(axis=0))
    yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(counts[0, at]), pa.array(counts[1, at])], ["bucket", "clean", "toxic"])


def _calibration(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, table = shared.value, _Table()
        for batch in batches:
            out = {"toxic": batch.column(1).to_pylist(), "n": [], "segments": [], "moments": []}
            for text, toxic, counted in zip(batch.column(0), out["toxic"], batch.column(2).to_pylist(), strict=True):
                words = words_of(text.as_py())
                known = list(set(words))
                by_word = dict(zip(known, model.log_odds(table.of(known), toxic if counted else None).tolist(), strict=True)) if known else {}
                scores = np.array([by_word[w] for w in words])
                out["n"].append(len(words))
                out["segments"].append([s for s, _, _ in segments(scores) if s >= LEAST_SEGMENT])
                out["moments"].append(np.exp(np.outer(_LAMBDAS, scores)).sum(axis=1).tolist() if len(scores) else [0.0] * len(_LAMBDAS))
            yield pa.RecordBatch.from_pydict(out, schema=pa.schema([("toxic", pa.int32()), ("n", pa.int64()), ("segments", pa.list_(pa.float64())), ("moments", pa.list_(pa.float64()))]))

    return run


#: Where the mean of exp(lambda * score) is measured.
_LAMBDAS = np.arange(0.2, 5.01, 0.2)


def labelled(docs: DataFrame, labels: DataFrame, most_labels: int) -> DataFrame:
    """text, toxic, counted of the rows to learn from; ``counted``: among the ``most_labels`` ids whose words are
    counted (16 bytes each; broadcast). Texts that surely have no label don't move."""
    known = labels.filter("doc_id is not null and toxic is not null").groupBy(F.col("doc_id").cast("long").alias("id")).agg((F.max("toxic") > 0).cast("int").alias("toxic"))
    known = materialize(known.filter(~held_out(F.col("id"))), "labels")
    chosen = known.orderBy(F.xxhash64("id"), "id").limit(most_labels).select("id", F.lit(True).alias("counted"))
    texts = passing(docs.select(F.col("doc_id").cast("long").alias("id"), F.col("text").cast("string")), "id", key_filter(known, "id"))
    return texts.join(known.join(F.broadcast(chosen), "id", "left"), "id").select("text", "toxic", F.coalesce("counted", F.lit(False)).alias("counted"))


def train(docs: DataFrame, labels: DataFrame, most_labels: int = 40_000) -> Model:
    small_batches(docs.sparkSession)
    rows = labelled(docs, labels, most_labels)
    counts = rows.filter("counted").select("text", "toxic").mapInArrow(_count, "bucket int, clean long, toxic long").groupBy("bucket").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    table = counts.toArrow()  # BUCKETS rows at most
    toxic, clean = np.zeros(BUCKETS, np.float32), np.zeros(BUCKETS, np.float32)
    at = table["bucket"].to_numpy()
    toxic[at], clean[at] = table["toxic"].to_numpy(), table["clean"].to_numpy()
    model = Model(toxic, clean, float(toxic.sum() / max(1.0, clean.sum())))
    if not toxic.any() or not clean.any():
        return model
    shared = docs.sparkSession.sparkContext.broadcast(model)
    seen = materialize(rows.mapInArrow(_calibration(shared), "toxic int, n long, segments array<double>, moments array<double>"), "calibration").filter("n > 0")
    sums = seen.filter("toxic = 0").agg(F.sum("n").alias("n"), *(F.sum(F.col("moments")[i]).alias(f"m{i}") for i in range(len(_LAMBDAS)))).first()
    mean = np.array([sums[f"m{i}"] for i in range(len(_LAMBDAS))]) / sums["n"]
    # The extreme-value law's lambda is where the mean of exp(lambda * score) over clean words is 1.
    over = int(np.argmax(mean > 1)) if (mean > 1).any() else len(mean)
    if 0 < over < len(mean):
        x, y = _LAMBDAS[over - 1 : over + 1], np.log(mean[over - 1 : over + 1])
        model.lam = float(x[0] - y[0] * (x[1] - x[0]) / (y[1] - y[0]))
    else:
        model.lam = float(_LAMBDAS[0] if over == 0 else _LAMBDAS[-1])
    best = F.coalesce(F.array_max("segments"), F.lit(1.0))
    k = seen.filter("toxic = 0").agg((F.count("*") / F.sum(F.col("n") * F.exp(-model.lam * best))).alias("k")).first()["k"]
    model.k = float(min(1.0, k))
    evidence = F.aggregate("segments", F.lit(0.0), lambda t, s: t + F.greatest(F.lit(0.0), model.lam * s - F.log(model.k * F.col("n"))))
    bins = seen.select("toxic", F.round(10 * F.log1p(evidence)).cast("int").alias("bin")).groupBy("bin", "toxic").count().collect()  # some 100 rows
    model.intercept, model.slope = _logistic(np.array([r["bin"] / 10 for r in bins]), np.array([r["toxic"] for r in bins]), np.array([r["count"] for r in bins], float))
    return model


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Intercept and slope by Newton's method, with a weak pull of the slope to 0."""
    design, beta = np.stack([np.ones_like(x), x], axis=1), np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(design @ beta, -30, 30)))
        gradient = design.T @ (weight * (y - p)) - [0, 0.01 * beta[1]]
        hessian = (design * (weight * p * (1 - p))[:, None]).T @ design + np.diag([1e-6, 0.01])
        step = np.linalg.solve(hessian, gradient)
        beta = beta + np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-8:
            break
    # Without evidence no text is predicted toxic, however many labels are.
    return float(min(-0.1, beta[0])), float(max(0.0, beta[1]))


def _score(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, cache = shared.value, {}
        spans = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64()), ("e_value", pa.float64())]))
        for batch in batches:
            scores, passages = [], []
            for value in batch.column(1):
                text = value.as_py()
                words = words_of(text)
                fresh = [w for w in set(words) if w not in cache]
                if fresh:
                    if len(cache) + len(fresh) > _MOST_CACHED:
                        cache.clear()
                        fresh = list(set(words))
                    cache.update(zip(fresh, model.log_odds(np.array([features(w) for w in fresh], np.int32)).tolist(), strict=True))
                by_word = np.fromiter(map(cache.__getitem__, words), float, len(words))
                floor = np.log(max(model.k * len(words), 1e-300)) if words else 0.0
                toxic = [(s, a, b) for s, a, b in segments(by_word) if s >= LEAST_SEGMENT and model.lam * s > floor]
                evidence = sum(model.lam * s - floor for s, _, _ in toxic)
                scores.append(float(1 / (1 + np.exp(-np.clip(model.intercept + model.slope * np.log1p(evidence), -30, 30)))))
                at = [m.span() for m in _WORD.finditer(text.lower())] if toxic else []
                passages.append([{"start": at[a][0], "end": at[b - 1][1], "score": s, "e_value": float(np.exp(floor - model.lam * s))} for s, a, b in toxic])
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(2, batch.num_columns)), batch.column(0), pa.array(scores, pa.float64()), pa.array(passages, spans)], [*batch.schema.names[2:], "doc_id", "score", "passages"])

    return run


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score, predicted, passages (character spans of the lower-cased text, their scores and
    expected counts), one row per row of ``docs``."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    scored = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(_score(shared), "doc_id long, score double, passages array<struct<start:long,end:long,score:double,e_value:double>>")
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def clean(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of ``docs`` that aren't predicted toxic. Texts are scored where they lie."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    names, schema = [f"c{i}" for i in range(len(docs.columns))], docs.schema
    kinds = ", ".join(f"c{i} {f.dataType.simpleString()}" for i, f in enumerate(schema))
    at = {n: i for i, n in reversed(list(enumerate(docs.columns)))}
    wide = docs.toDF(*names)
    wide = wide.select(F.col(names[at["doc_id"]]).cast("long").alias("__id"), F.col(names[at["text"]]).cast("string").alias("__text"), *names)
    scored = wide.mapInArrow(_score(shared), f"{kinds}, doc_id long, score double, passages array<struct<start:long,end:long,score:double,e_value:double>>")
    return scored.filter("score < 0.5").select(*names).toDF(*docs.columns)
