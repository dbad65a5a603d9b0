"""How far the sources of a language are apart: single-pass in-memory indexing, then streamed corrections.

A task counts terms in memory, block by block; when a block is full, its counts go out as a run in order of the
terms. Runs are dealt to shards by a hash of language, term and source, Spark's external sort merges those of
a shard (a heap over what it has spilled), and a task adds up equal keys as they stream by. A pair of
sources starts with the sum that it would have if no term stood in both, which only takes how often each count
occurs in each source; the terms that do stand in both then stream by and correct it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .store import materialize, small_batches
from .text import LOWER, chunks, word_spans

#: Bytes of ASCII that aren't letters part terms.
APART = np.zeros(256, bool)
APART[[*range(0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]] = True
#: Entries of a block, and pairs of sources that a task holds corrections of.
BLOCK, PAIRS = 1 << 19, 1 << 19
LEAST_DOCUMENTS, MOST_TERMS, UNIT = 3, 200, 1_000_000_000
_RUN = "lang string, source string, term string, tf long, df long"


def _terms(data: np.ndarray, offsets: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """The terms of some texts as strings, and the row of each."""
    starts, ends, row = word_spans(data, offsets, APART)
    lengths = ends - starts
    at = np.concatenate([[0], np.cumsum(lengths)])
    body = LOWER[data[~APART[data]]]
    return pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(at.astype(np.int64)), pa.py_buffer(body)), row


def _counted(lang: pa.Array, source: pa.Array, data: np.ndarray, offsets: np.ndarray) -> pa.Table:
    """lang, source, term, tf, df of a few texts; every group has a row without a term."""
    pairs = list(zip(lang.to_pylist(), source.to_pylist(), strict=True))
    names = sorted(set(pairs))
    place = {name: i for i, name in enumerate(names)}
    of = np.array([place[x] for x in pairs], np.int64)
    terms, row = _terms(data, offsets)
    coded = terms.dictionary_encode()
    code, width = coded.indices.to_numpy(), max(1, len(coded.dictionary))
    each, times = np.unique(row * width + code, return_counts=True)
    total, at = np.unique(of[each // width] * width + each % width, return_inverse=True)
    tf, df = np.bincount(at, times, len(total)).astype(np.int64), np.bincount(at, minlength=len(total))
    group = pa.array(np.append(total // width, np.arange(len(names))))
    term = pa.concat_arrays([coded.dictionary.take(pa.array(total % width)).cast(pa.string()), pa.nulls(len(names), pa.string())])
    none = np.zeros(len(names), np.int64)
    return pa.table({"lang": pa.array([x for x, _ in names], pa.string()).take(group), "source": pa.array([y for _, y in names], pa.string()).take(group), "term": term, "tf": np.append(tf, none), "df": np.append(df, none)})


def _run(block: list[pa.Table]) -> Iterator[pa.RecordBatch]:
    keys = ["lang", "source", "term"]
    added = pa.concat_tables(block).group_by(keys).aggregate([("tf", "sum"), ("df", "sum")])
    added = added.select([*keys, "tf_sum", "df_sum"]).rename_columns([*keys, "tf", "df"])
    yield from added.sort_by([("term", "ascending"), ("lang", "ascending"), ("source", "ascending")]).combine_chunks().to_batches(max_chunksize=1 << 16)


def _indexed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From (text, lang, source): runs of counts. A block is full when it holds ``BLOCK`` entries though equal
    keys are added up."""
    block, held = [], 0
    for batch in batches:
        for lo, hi, data, offsets in chunks(batch.column("text")):
            block.append(_counted(batch.column("lang").slice(lo, hi - lo), batch.column("source").slice(lo, hi - lo), data, offsets))
            held += len(block[-1])
            if held >= BLOCK:
                run = pa.Table.from_batches(list(_run(block)))
                block, held = [run], len(run)
                if held >= BLOCK // 2:
                    yield from run.to_batches()
                    block, held = [], 0
    if block:
        yield from _run(block)


def _heads(table: pa.Table, columns: tuple[str, ...]) -> np.ndarray:
    """Where the rows of each key begin, keys in order; nulls are equal."""
    n, new = len(table), np.zeros(len(table), bool)
    new[:1] = True
    for c in columns:
        x = table.column(c).combine_chunks()
        a, b = x.slice(1), x.slice(0, n - 1)
        same = np.asarray(pc.fill_null(pc.equal(a, b), False)) | (np.asarray(a.is_null()) & np.asarray(b.is_null()))
        new[1:] |= ~same.astype(bool)
    return np.flatnonzero(new)


def _whole(batches: Iterator[pa.RecordBatch], columns: tuple[str, ...]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Tables of whole keys, in order, and where each key begins."""
    rest: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([*rest, batch]).combine_chunks()
        heads = _heads(table, columns)
        if len(heads) > 1:
            yield table.slice(0, heads[-1]), heads[:-1]
        rest = table.slice(heads[-1]).combine_chunks().to_batches()
    if rest:
        yield pa.Table.from_batches(rest).combine_chunks(), np.zeros(1, int)


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From runs in order of their keys: one row for each key."""
    rest: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([*rest, batch]).combine_chunks()
        heads = _heads(table, ("lang", "term", "source"))
        sums = [pa.array(np.add.reduceat(table.column(c).to_numpy(), heads)) for c in ("tf", "df")]
        out = pa.table([*(table.column(c).take(pa.array(heads)) for c in ("lang", "source", "term")), *sums], names=["lang", "source", "term", "tf", "df"]).combine_chunks()
        yield from out.slice(0, len(out) - 1).to_batches()
        rest = out.slice(len(out) - 1).to_batches()
    yield from rest


def frequencies(docs: DataFrame) -> DataFrame:
    """(lang, source, term, tf, df): how often and in how many documents each term stands in each group; every
    group has a row without a term."""
    small_batches(docs.sparkSession)
    given = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("text", "lang", "source")))
    runs = given.mapInArrow(_indexed, _RUN)
    keys = ["lang", "term", "source"]
    return materialize(runs.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(_merged, _RUN), "frequencies")


def _share(count: str, total: str, terms: str) -> Column:
    """1 + floor(10^9 * (count + 1) / (total + terms)) of columns, exact at any size."""
    return F.expr(f"1 + (cast({count} + 1 as decimal(19,0)) * {UNIT}) div ({total} + {terms})")


def _gain(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) * (p - q) // q


def _pairs_of_terms(key: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All ordered pairs i, j of rows with equal keys (in order), some at a time."""
    n = len(key)
    first = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
    width = np.diff(np.append(first, n))
    bucket = np.cumsum(np.append(False, key[1:] != key[:-1]))
    counts = width[bucket]
    total, lo = np.cumsum(counts), 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(total, (total[lo - 1] if lo else 0) + (1 << 18), "right")))
        part = counts[lo:hi]
        i = np.repeat(np.arange(lo, hi), part)
        j = first[bucket[i]] + np.arange(len(i)) - np.repeat(np.cumsum(part) - part, part)
        yield i[i != j], j[i != j]
        lo = hi


def _corrected(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From (lang, term, g, p, least) in order of lang and term: by how much the terms in both groups of a pair
    (g, other) change its sum. A task holds a bounded table of pairs and gives it away when it is full."""
    held, size = [], 0

    def added() -> list[np.ndarray]:
        g, h, value = (np.concatenate(x) for x in zip(*held, strict=True))
        order = np.lexsort((h, g))
        g, h, value = g[order], h[order], value[order]
        heads = np.flatnonzero(np.append(True, (g[1:] != g[:-1]) | (h[1:] != h[:-1])))
        return [g[heads], h[heads], np.add.reduceat(value, heads)]

    for table, heads in _whole(batches, ("lang", "term")):
        g, p, least = (table.column(c).to_numpy() for c in ("g", "p", "least"))
        for i, j in _pairs_of_terms(np.repeat(np.arange(len(heads)), np.diff(np.append(heads, len(g))))):
            if not len(i):
                continue
            held.append([g[i], g[j], _gain(p[i], p[j]) - _gain(p[i], least[j]) - _gain(least[i], p[j]) + _gain(least[i], least[j])])
            size += len(i)
            if size >= PAIRS:
                held[:] = [added()]
                size = len(held[0][0])
                if size >= PAIRS // 2:
                    yield pa.RecordBatch.from_arrays(list(map(pa.array, held.pop())), ["g", "other", "change"])
                    size = 0
    if held:
        yield pa.RecordBatch.from_arrays(list(map(pa.array, added())), ["g", "other", "change"])


def _f(p: str, q: str) -> Column:
    return F.expr(f"(({p} - {q}) * ({p} - {q})) div {q}")


def _pairs(kept: DataFrame, groups: DataFrame) -> DataFrame:
    """(lang, source, item, value) of all ordered pairs of a language's sources."""
    one, two = groups.select("lang", "source", "g", F.col("least").alias("x"), "v"), groups.select("lang", F.col("source").alias("item"), F.col("g").alias("other"), F.col("least").alias("y"))
    pairs = one.join(two, "lang").filter("g <> other")
    counts = materialize(kept.groupBy("g", "p").agg(F.count("*").alias("k")), "counts")
    base = pairs.select("g", "other", F.when(F.col("v") > 0, F.col("v").cast("decimal(38,0)") * _f("x", "y")).otherwise(F.lit(0)).cast("decimal(38,0)").alias("value"))
    mine = pairs.select("g", "other", "x", "y").join(counts, "g").select("g", "other", (F.col("k").cast("decimal(19,0)") * (_f("p", "y") - _f("x", "y"))).cast("decimal(38,0)").alias("value"))
    yours = pairs.select("g", "other", "x", "y").join(counts.withColumnRenamed("g", "other"), "other").select("g", "other", (F.col("k").cast("decimal(19,0)") * (_f("x", "p") - _f("x", "y"))).cast("decimal(38,0)").alias("value"))
    ordered = kept.select("lang", "term", "g", "p", "least").repartition("lang", "term").sortWithinPartitions("lang", "term")
    changes = ordered.mapInArrow(_corrected, "g long, other long, change long").select("g", "other", F.col("change").cast("decimal(38,0)").alias("value"))
    summed = base.unionByName(mine).unionByName(yours).unionByName(changes).groupBy("g", "other").agg(F.sum("value").cast("long").alias("value"))
    named = groups.select("g", "lang", "source")
    return summed.join(named, "g").join(named.select(F.col("g").alias("other"), F.col("source").alias("item")), "other").select("lang", "source", "item", "value")


def divergence(docs: DataFrame, least_documents: int = LEAST_DOCUMENTS, most_terms: int = MOST_TERMS) -> DataFrame:
    """(lang, source, part, item, value, rank): part ``pair`` compares each source with every other of its language,
    part ``term`` lists the terms that a source has more of than its language, ``most_terms`` of them.

    Null texts, languages and sources are empty ones. Terms are runs of letters (A-Z in lower case) and
    characters beyond ASCII; those in at least ``least_documents`` of a language's documents are kept. A
    repeated row is a document of its own; ids aren't looked at. Equal values go in order of the item's bytes. A
    language without kept terms gives pairs of value 0; a lone source gives none. No rows give no rows."""
    found = frequencies(docs)
    posted = found.filter("term is not null")
    vocabulary = materialize(posted.groupBy("lang", "term").agg(F.sum("df").alias("documents"), F.sum("tf").alias("lang_tf")).filter(F.col("documents") >= least_documents).drop("documents"), "vocabulary")
    counted = materialize(posted.join(vocabulary, ["lang", "term"]).select("lang", "source", "term", "tf", "lang_tf"), "counted")
    langs = vocabulary.groupBy("lang").agg(F.count("*").alias("v"), F.sum("lang_tf").alias("lang_n"))
    sizes = counted.groupBy("lang", "source").agg(F.sum("tf").alias("n"))
    every = found.filter("term is null").select("lang", "source").join(sizes, ["lang", "source"], "left").join(langs, "lang", "left").fillna(0, ["n", "v", "lang_n"])
    groups = materialize(every.withColumns({"g": F.monotonically_increasing_id(), "least": F.when(F.col("v") > 0, _share("0L", "n", "v")).otherwise(1)}), "groups")
    kept = counted.join(groups, ["lang", "source"]).withColumns({"p": _share("tf", "n", "v"), "q": _share("lang_tf", "lang_n", "v")})
    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    terms = kept.filter("p > q").select("lang", "source", F.col("term").alias("item"), _f("p", "q").alias("value")).withColumn("rank", rank).filter(F.col("rank") <= most_terms)
    pairs = _pairs(kept, groups).withColumn("rank", rank)
    out = pairs.withColumn("part", F.lit("pair")).unionByName(terms.withColumn("part", F.lit("term")))
    return out.select("lang", "source", "part", "item", "value", "rank")


#: The same in SQL, all terms against all pairs of sources.
ORACLE = """
    WITH d AS (SELECT row_number() OVER () AS doc, coalesce(lang, '') AS lang, coalesce(source, '') AS source, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
    t AS (SELECT doc, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
    voc AS (SELECT lang, term, count(*) AS tf FROM t GROUP BY 1, 2 HAVING count(DISTINCT doc) >= 3), langs AS (SELECT lang, count(*) AS v, sum(tf) AS n FROM voc GROUP BY 1),
    grp AS (SELECT DISTINCT lang, source FROM d), cnt AS (SELECT lang, source, term, count(*) AS tf FROM t SEMI JOIN voc USING (lang, term) GROUP BY 1, 2, 3), tot AS (SELECT lang, source, sum(tf) AS n FROM cnt GROUP BY 1, 2),
    p AS (SELECT g.lang, g.source, voc.term, coalesce(c.tf, 0) AS tf, CAST(1 + (1000000000::HUGEINT * (coalesce(c.tf, 0) + 1)) // (coalesce(tot.n, 0) + l.v)::HUGEINT AS BIGINT) AS p, CAST(1 + (1000000000::HUGEINT * (voc.tf + 1)) // (l.n + l.v)::HUGEINT AS BIGINT) AS q
     FROM grp g JOIN voc ON voc.lang = g.lang JOIN langs l ON l.lang = g.lang LEFT JOIN tot ON tot.lang = g.lang AND tot.source = g.source LEFT JOIN cnt c ON c.lang = g.lang AND c.source = g.source AND c.term = voc.term),
    w AS (SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // b.p) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY 1, 2, 3),
    r AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(w.value, 0) AS BIGINT) AS value FROM grp a JOIN grp b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN w ON w.lang = a.lang AND w.source = a.source AND w.item = b.source
     UNION ALL SELECT lang, source, 'term', term, CAST(((p - q) * (p - q)) // q AS BIGINT) FROM p WHERE tf > 0 AND p > q),
    k AS (SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INT) AS rank FROM r)
    SELECT lang, source, part, item, value, rank FROM k WHERE part = 'pair' OR rank <= 200"""
