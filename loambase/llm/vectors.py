"""Near-duplicate vectors: flat graphs over overlapping shards, united, searched, audited, verified.

Equal vectors of a label are one node. Nodes are dealt to shards of at most ``LIMIT``: a larger one is split
by centres fitted to a bounded sample, and a vector goes to the nearest centre and to others whose bisector
is within ``REACH``, ``OVERLAP`` at most. A shard of near copies, which no centre can part, is split into pairs of
parts instead, so that every pair of its members still meets. One task builds the graph of one shard; the
lists of all shards are united; one task searches the united lists of one shard's members. A pair that
meets in several shards counts in the first of them. Links never leave a task: it gives each member's
number of links and the smallest member it is connected to.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import flatgraph
from .graph import components
from .store import materialize, small_batches
from .text import mix

LIMIT, OVERLAP = 8192, 3
#: A vector also goes to centres whose bisector with its nearest one is no farther than this: half the distance
#: between vectors at cosine 0.98. With 0.2 in place of it nothing could be lost, but in shards without
#: clusters every vector would go everywhere.
REACH = 0.1
#: Members that centres are fitted to, on average; centres of a shard; share of linked pairs in the sample from
#: which on a shard counts as one of near copies.
SAMPLE, CENTRES, DENSE = 1000, 64, 0.25
#: A shard's members whose links are compared with brute force.
AUDITED = 16
#: Vectors of a shard that a task of the split reads at most, about.
SALTED = 1 << 16
_SHARD = "shard string, node long, unit array<double>"


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _mixed(ident: np.ndarray) -> np.ndarray:
    return mix(ident.astype(np.uint64))


def prepared(rows: DataFrame, ident: str, vector: str, label: str) -> tuple[DataFrame, DataFrame]:
    """(members, nodes): every row with an id, as (id, key, values; both null if it can't link), and the
    distinct vectors of each label as (node, key, values, unit, first, copies)."""
    v = F.col("__v")
    good = v.isNotNull() & (F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0) & F.col("__label").isNotNull()
    taken = rows.select(F.col(ident).cast("long").alias("id"), F.col(label).cast("string").alias("__label"), F.col(vector).cast("array<double>").alias("__v")).filter("id is not null")
    members = taken.withColumn("__ok", good).select("id", F.when(F.col("__ok"), F.concat("__label", F.lit(":"), F.size(v).cast("string"))).alias("key"), F.when(F.col("__ok"), v).alias("values"))
    # Scaled by its largest entry first, a vector's norm neither overflows nor vanishes.
    scaled = F.transform("values", lambda x: x / F.col("top"))
    norm = F.sqrt(F.aggregate("scaled", F.lit(0.0), lambda s, x: s + x * x))
    grouped = members.filter("key is not null").groupBy("key", "values").agg(F.min("id").alias("first"), F.count("*").alias("copies"))
    named = grouped.withColumn("top", F.array_max(F.transform("values", F.abs))).withColumn("scaled", scaled).withColumn("norm", norm)
    nodes = named.select(F.monotonically_increasing_id().alias("node"), "key", "values", F.transform("scaled", lambda x: x / F.col("norm")).alias("unit"), "first", "copies")
    return members, materialize(nodes, "nodes")


def _fitted(least: float, limit: int):
    """From a shard's sample (shard, n, node, unit): its centres, or none and a number of parts."""

    def run(table: pa.Table) -> pa.Table:
        units, n = _matrix(table.column("unit")), table.column("n")[0].as_py()
        units = units[np.argsort(table.column("node").to_numpy())]
        pairs = units @ units.T >= least
        parts = -(-2 * n // limit)
        k = int(min(CENTRES, max(8, 3 * parts), len(units)))
        dense = k < 2 or pairs.mean() > DENSE
        centres = np.zeros((0, units.shape[1]))
        if not dense:
            centres = units[np.linspace(0, len(units) - 1, k).astype(int)]
            for _ in range(8):
                home = (units @ centres.T).argmax(axis=1)
                for c in np.unique(home):
                    mean = units[home == c].sum(axis=0)
                    centres[c] = mean / (np.linalg.norm(mean) or 1)
            # Of centres in one group of near copies, which they would tear apart, the first stays.
            close = np.tril(centres @ centres.T > 1 - 5 * (1 - least), -1)
            alone = np.ones(k, bool)
            for c in range(k):
                alone[c] = not (close[c] & alone).any()
            centres = centres[alone]
            dense = np.bincount((units @ centres.T).argmax(axis=1)).max() > 0.9 * len(units)
        return pa.table({"shard": [table.column("shard")[0].as_py()], "parts": pa.array([parts if dense else 0], pa.int64()), "centres": pa.array([[] if dense else centres.ravel().tolist()], pa.list_(pa.float64()))})

    return run


def _dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From (shard, salt, node, unit, parts, centres) in order, each shard's and salt's head (node null) first:
    (shard, node, unit) of the smaller shards."""
    flat, parts = np.zeros(0), 0
    for batch in batches:
        nodes, shards = batch.column("node"), batch.column("shard")
        heads = np.flatnonzero(np.asarray(nodes.is_null()))
        cuts = [0, *heads.tolist(), batch.num_rows]
        for lo, hi in zip(cuts, cuts[1:], strict=False):
            if lo in heads:
                parts = batch.column("parts")[lo].as_py()
                flat, lo = np.array(batch.column("centres")[lo].as_py(), float), lo + 1
            if lo >= hi:
                continue
            unit = batch.column("unit").slice(lo, hi - lo)
            rows, name, ident = _matrix(unit), shards[lo].as_py(), nodes.slice(lo, hi - lo).to_numpy()
            if parts:
                mine = (_mixed(ident) % np.uint64(parts)).astype(np.int64)
                at, other = np.repeat(np.arange(len(rows)), parts), np.tile(np.arange(parts), len(rows))
                child = np.minimum(mine[at], other) * parts + np.maximum(mine[at], other)
            else:
                centres = flat.reshape(-1, rows.shape[1])
                like = rows @ centres.T
                home = like.argmax(axis=1)
                apart = np.sqrt(np.maximum(0, 2 - 2 * centres @ centres.T))[home]
                gap = (like[np.arange(len(rows)), home][:, None] - like) / np.where(apart > 0, apart, 1)
                ranks = np.argsort(np.argsort(gap, axis=1, kind="stable"), axis=1)
                at, child = np.nonzero((gap <= REACH) & (ranks < OVERLAP))
            yield pa.RecordBatch.from_arrays([pa.array([f"{name}/{c}" for c in child.tolist()], pa.string()), pa.array(ident[at]), unit.take(pa.array(at)).cast(pa.list_(pa.float64()))], ["shard", "node", "unit"])


def shards(nodes: DataFrame, least: float, limit: int = LIMIT, rounds: int = 12) -> DataFrame:
    """(shard, node, unit) of the overlapping shards."""
    live, done = nodes.select(F.col("key").alias("shard"), "node", "unit"), []
    for _ in range(rounds):
        live = materialize(live, "shards")
        sizes = materialize(live.groupBy("shard").agg(F.count("*").alias("n")), "sizes")
        large = sizes.filter(F.col("n") > limit)
        done.append(live.join(sizes.filter(F.col("n") <= limit).select("shard"), "shard"))
        if large.isEmpty():
            break
        share = F.lit(float(SAMPLE) * (1 << 30)) / F.col("n")
        sample = live.join(large, "shard").filter(F.pmod(F.xxhash64("node", "shard"), F.lit(1 << 30)) < share)
        centres = materialize(sample.select("shard", "n", "node", "unit").groupBy("shard").applyInArrow(_fitted(least, limit), "shard string, parts long, centres array<double>"), "centres")
        split = large.join(centres, "shard").withColumn("salts", F.ceil(F.col("n") / SALTED))
        heads = split.select("shard", F.explode(F.sequence(F.lit(0).cast("long"), F.col("salts") - 1)).alias("salt"), F.lit(None).cast("long").alias("node"), F.lit(None).cast("array<double>").alias("unit"), "parts", "centres")
        rows = live.join(split.select("shard", "salts"), "shard").select("shard", F.pmod(F.xxhash64("node"), F.col("salts")).alias("salt"), "node", "unit", F.lit(None).cast("long").alias("parts"), F.lit(None).cast("array<double>").alias("centres"))
        ordered = heads.unionByName(rows).repartition("shard", "salt").sortWithinPartitions("shard", "salt", F.col("node").asc_nulls_first())
        children = ordered.mapInArrow(_dealt, _SHARD)
        paired = materialize(split.filter("parts > 0").select("shard"), "paired")
        # Pairs of parts are small enough by count; only unlucky hashing could leave them over the limit.
        parent = F.regexp_replace("shard", "/[0-9]+$", "")
        children = materialize(children.withColumn("parent", parent), "children")
        done.append(children.join(paired.withColumnRenamed("shard", "parent"), "parent").select("shard", "node", "unit"))
        live = children.join(paired.withColumnRenamed("shard", "parent"), "parent", "left_anti").select("shard", "node", "unit")
    else:
        raise RuntimeError(f"shards: some still larger than {limit} after {rounds} rounds")
    return materialize(reduce(DataFrame.unionByName, done), "leaves")


def _lists(table: pa.Table) -> pa.Table:
    """(node, near) edges of one shard's graph."""
    ident = table.column("node").to_numpy()
    order = np.argsort(ident)
    ident, units = ident[order], _matrix(table.column("unit"))[order]
    graph, _ = flatgraph.build(units)
    at, of = np.nonzero(graph >= 0)
    return pa.table({"node": pa.array(ident[at]), "near": pa.array(ident[graph[at, of]])})


def _table_of(source: np.ndarray, target: np.ndarray, n: int) -> np.ndarray:
    """Edges in order of their source as a table of lists (-1: none)."""
    counts = np.bincount(source, minlength=n)
    out = np.full((n, max(1, int(counts.max(initial=0)))), -1, np.int32)
    out[source, np.arange(len(source)) - np.repeat(np.cumsum(counts) - counts, counts)] = target
    return out


def _searched(least: float):
    """Of a shard's members (shard, node, unit, copies, homes, near): links of each that count here, the smallest
    member it is connected to, and, for those audited, the links by brute force and by search."""

    def run(table: pa.Table) -> pa.Table:
        ident = table.column("node").to_numpy()
        order = np.argsort(ident)
        table = table.take(pa.array(order))
        ident, units, copies = ident[order], _matrix(table.column("unit")), table.column("copies").to_numpy()
        n, name = len(ident), table.column("shard")[0].as_py()
        lists = table.column("near").combine_chunks()
        source, near = np.repeat(np.arange(n), lists.value_lengths().fill_null(0).to_numpy()), lists.flatten().to_numpy()
        place = np.minimum(np.searchsorted(ident, near), n - 1)
        here = ident[place] == near
        source, target = source[here], place[here]
        audited = np.argsort(_mixed(ident))[:AUDITED]
        truth = units[audited] @ units.T >= least
        truth[np.arange(len(audited)), audited] = False
        graph, start, beam = _table_of(source, target, n), flatgraph.medoid(units), flatgraph.BEAM
        both = np.append(source, target), np.append(target, source)
        while True:
            found = flatgraph.in_range(units, *both, graph, start, least, min(beam, max(flatgraph.OPEN, n)))
            hit = int((found[audited] & truth).sum())
            if hit == truth.sum() or beam >= 8 * flatgraph.BEAM:
                break
            beam *= 2
        # A pair counts in the first shard that both are in.
        homes = table.column("homes").combine_chunks()
        names, code = np.unique(np.array(homes.flatten().to_pylist(), dtype=object), return_inverse=True)
        earlier = np.zeros((n, int(np.searchsorted(names, name))), np.float32)
        rows = np.repeat(np.arange(n), homes.value_lengths().to_numpy())
        before = code < earlier.shape[1]
        earlier[rows[before], code[before]] = 1
        links, root = np.zeros(n, np.int64), np.arange(n)
        for lo in range(0, n, flatgraph.TOGETHER):
            part = found[lo : lo + flatgraph.TOGETHER]
            counted = part & (earlier[lo : lo + flatgraph.TOGETHER] @ earlier.T == 0) if earlier.shape[1] else part
            links[lo : lo + flatgraph.TOGETHER] = counted @ copies
        while True:
            least_near = np.array([root[f].min(initial=n) for f in found])
            new = np.minimum(root, least_near)
            new = new[new]
            if (new == root).all():
                break
            root = new
        some = np.flatnonzero(found.any(axis=1))
        asked = np.zeros(n, np.int64)
        got = asked.copy()
        asked[audited], got[audited] = truth.sum(axis=1), (found[audited] & truth).sum(axis=1)
        keep = np.union1d(some, audited)
        return pa.table({"node": pa.array(ident[keep]), "links": pa.array(links[keep]), "root": pa.array(ident[root[keep]]), "asked": pa.array(asked[keep]), "got": pa.array(got[keep])})

    return run


def searched(nodes: DataFrame, least: float, limit: int = LIMIT) -> DataFrame:
    """(node, links, root, asked, got) for each shard and member with a link in it, or audited."""
    leaves = shards(nodes, least, limit)
    lists = materialize(leaves.groupBy("shard").applyInArrow(_lists, "node long, near long"), "lists")
    united = lists.groupBy("node").agg(F.collect_set("near").alias("near"))
    homes = leaves.groupBy("node").agg(F.array_sort(F.collect_set("shard")).alias("homes"))
    known = nodes.select("node", "copies").join(homes, "node").join(united, "node", "left")
    rows = leaves.join(known, "node").select("shard", "node", "unit", "copies", "homes", "near")
    return materialize(rows.groupBy("shard").applyInArrow(_searched(least), "node long, links long, root long, asked long, got long"), "searched")


def near_vectors(rows: DataFrame, ident: str = "vec_id", vector: str = "embedding", label: str = "label", least: float = 0.98, limit: int = LIMIT) -> DataFrame:
    """(ident, n_links, component_id, kept) of each row: the other vectors of its label at cosine ``least`` or
    more, the smallest id reachable by links, and whether that is its own.

    Vectors that are null, empty, zero or hold null or non-finite entries, rows without a label and
    vectors of another length link with nothing. Rows that repeat are vectors of their own and link with each
    other. Rows without an id are left out. No rows give no rows; other columns are ignored."""
    small_batches(rows.sparkSession)
    members, nodes = prepared(rows, ident, vector, label)
    hits = searched(nodes, least, limit)
    links = hits.groupBy("node").agg(F.sum("links").alias("links"))
    joined = components(hits.select(F.col("node").alias("a"), F.col("root").alias("b")))
    placed = nodes.join(joined, "node", "left").select("node", "key", "values", "first", "copies", F.coalesce("component", "node").alias("component"))
    smallest = placed.groupBy("component").agg(F.min("first").alias("component_id"))
    each = placed.join(smallest, "component").join(links, "node", "left")
    each = each.select("key", "values", F.xxhash64("key", "values").alias("h"), (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), "component_id")
    found = members.withColumn("h", F.xxhash64("key", "values")).join(each, ["h", "key", "values"], "left")
    component = F.coalesce("component_id", "id")
    return found.select(F.col("id").alias(ident), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), (F.col("id") == component).alias("kept"))


def audit(rows: DataFrame, ident: str = "vec_id", vector: str = "embedding", label: str = "label", least: float = 0.98, limit: int = LIMIT) -> DataFrame:
    """One row (asked, got): links of the audited members within their shards by brute force, and how many of
    them the search found."""
    hits = searched(prepared(rows, ident, vector, label)[1], least, limit)
    return hits.agg(F.coalesce(F.sum("asked"), F.lit(0)).alias("asked"), F.coalesce(F.sum("got"), F.lit(0)).alias("got"))
