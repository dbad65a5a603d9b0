"""Links between similar sets that share a signature bucket, in rounds.

First each member of a bucket is compared with the bucket's smallest. A bucket is settled once all its members
are in one component. A mixed bucket of at most ``LIMIT`` members (and ``ELEMENTS`` set elements) is searched as a
whole by one task, which reads it from rows in order of the bucket's key: by sketches, and where these leave more
than ``DENSE`` pairs a member open, by the sets themselves, so that such pairs never leave the task. A larger one
compares its members with two hubs, one of its largest component and one outside it; what is still mixed then is
searched in tiles: parts of its members, each no larger than a small bucket, against parts of them. Pairs
of the largest component are left out, and buckets that hold nearly the same members are searched once, together. So
no task holds more than two bounded parts, every pair of a bucket is looked at, and a large bucket of n members that no
hub settles makes some n * n / LIMIT rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .filters import key_filter, passing
from .graph import components
from .store import materialize

LIMIT, ELEMENTS, DENSE = 2048, 1 << 22, 8
#: A pair isn't compared on full sets if its sketches' estimate is so many standard deviations under the
#: threshold (one in 30,000 pairs at the threshold). A sketch of a small set has as many independent bins as elements.
DEVIATIONS = 4.0
#: Pairs that are looked at together.
_PAIRS = 1 << 18


@dataclass(frozen=True)
class Likeness:
    """How sketches are compared. ``share`` gives the similarity that two matrices of sketches (a row each,
    unsigned 64-bit words) tell, from ``bins`` bins. ``sizes``: the nodes' sizes are those of their sets, and
    limit both their similarity and how many bins are independent (one permutation, many bins)."""

    share: Callable[[np.ndarray, np.ndarray], np.ndarray]
    bins: int
    percent: int = 80
    sizes: bool = True

    def likely(self, x: np.ndarray, y: np.ndarray, nx: np.ndarray, ny: np.ndarray) -> np.ndarray:
        """Whether sizes and sketches leave a similarity of ``percent`` open."""
        t, share = self.percent / 100, self.share(x, y)
        if not self.sizes:
            return share >= t - DEVIATIONS * np.sqrt(t * (1 - t) / self.bins)
        lo, hi = np.minimum(nx, ny), np.maximum(nx, ny)
        return (100 * lo >= self.percent * hi) & (share >= t - DEVIATIONS * np.sqrt(t * (1 - t) / np.clip(hi, 1, self.bins)))


def _sketches(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy().view(np.uint64).reshape(len(column), -1)


def _pass(like: Likeness):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                mask = pa.array(like.likely(_sketches(batch.column(4)), _sketches(batch.column(5)), batch.column(2).to_numpy(), batch.column(3).to_numpy()))
                yield pa.RecordBatch.from_arrays([batch.column(i).filter(mask) for i in (0, 1)], ["a", "b"])

    return run


def likely(edges: DataFrame, reps: DataFrame, like: Likeness) -> DataFrame:
    """Edges whose sizes and sketches don't rule out the threshold."""
    a, b = (reps.select(F.col("node").alias(x), F.col("size").alias(f"n{x}"), F.col("sketch").alias(f"s{x}")) for x in "ab")
    return edges.join(a, "a").join(b, "b").select("a", "b", "na", "nb", "sa", "sb").mapInArrow(_pass(like), "a long, b long")


def _near(like: Likeness):
    """From buckets (key, node, component, size, sketch): likely pairs (a, b; key null) of different
    components, or where a bucket has more than DENSE a member, its members (key, a = node, b = component)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, table in whole_buckets(batches):
            node, component, size = (table.column(i).to_numpy() for i in (1, 2, 3))
            sketch = _sketches(table.column(4))
            bucket = np.cumsum(np.append(False, key[1:] != key[:-1]))
            members = np.bincount(bucket)
            found, counts = [(np.zeros(0, int),) * 2], np.zeros(len(members), np.int64)
            for i, j in pairs_within(key):
                open_ = (component[i] != component[j]) & (counts[bucket[i]] <= DENSE * members[bucket[i]])
                i, j = i[open_], j[open_]
                good = like.likely(sketch[i], sketch[j], size[i], size[j])
                i, j = i[good], j[good]
                counts += np.bincount(bucket[i], minlength=len(members))
                found.append((i, j))
            dense = counts > DENSE * members
            i, j = (np.concatenate(x) for x in zip(*found, strict=True))
            sparse = ~dense[bucket[i]] & (node[i] != node[j])
            i, j, whole = i[sparse], j[sparse], np.flatnonzero(dense[bucket])
            yield pa.RecordBatch.from_arrays([pa.nulls(len(i), pa.int64()), pa.array(np.minimum(node[i], node[j])), pa.array(np.maximum(node[i], node[j]))], ["key", "a", "b"])
            yield pa.RecordBatch.from_arrays([pa.array(key[whole]), pa.array(node[whole]), pa.array(component[whole])], ["key", "a", "b"])

    return run


def shared(rows: DataFrame) -> DataFrame:
    """key, at, node, size, hub (its smallest node) of the rows whose bucket has several members. A member's
    copies (equal key and node) count once. Keys of one member don't move twice."""
    hubs = materialize(rows.groupBy("key").agg(F.min("node").alias("hub"), F.max("node").alias("last")).filter("hub < last").select("key", "hub"), "hubs")
    return materialize(passing(rows, "key", key_filter(hubs, "key")).join(hubs, "key").select("key", "at", "node", "size", "hub"), "shared")


def mixed(rows: DataFrame, found: DataFrame, limit: int = LIMIT) -> DataFrame:
    """key, at, node, size, component, large, top (the component with most members in the bucket) of the rows
    (key, at, node, size) in buckets with several components."""
    placed = materialize(rows.select("key", "at", "node", "size").join(found, "node", "left").select("key", "at", "node", "size", F.coalesce("component", "node").alias("component")), "placed")
    counts = placed.groupBy("key", "component").agg(F.count("*").alias("n"), F.sum("size").alias("size"))
    large = (F.sum("n") > limit) | (F.sum("size") > ELEMENTS)
    buckets = counts.groupBy("key").agg(large.alias("large"), F.max(F.struct("n", "component"))["component"].alias("top"), F.count("*").alias("k"))
    return materialize(placed.join(materialize(buckets.filter("k > 1").drop("k"), "buckets"), "key").select("key", "at", "node", "size", "component", "large", "top"), "mixed")


def _stars(large: DataFrame) -> DataFrame:
    """Distinct pairs a < b of each member with a hub of another component: one of the bucket's largest
    component, one outside it."""
    order = F.struct(F.xxhash64("key", "node"), "node", "component")
    top = F.col("component") == F.col("top")
    hubs = materialize(large.groupBy("key").agg(F.min(F.when(top, order)).alias("x"), F.min(F.when(~top, order)).alias("y")), "hubs")
    stars = large.join(hubs, "key").select("node", "component", F.explode(F.array("x", "y")).alias("hub")).filter("component <> hub.component")
    return stars.select(F.least("node", "hub.node").alias("a"), F.greatest("node", "hub.node").alias("b")).distinct()


def tiles(large: DataFrame, limit: int = LIMIT) -> DataFrame:
    """key, node, component: the members of mixed buckets (key, node, size, component), dealt to parts of about
    ``limit`` members, and those to tiles of two parts, so that any two members of different components meet."""
    counts = large.groupBy("key").agg(F.count("*").alias("n"))
    homes = large.join(counts, "key").groupBy("node").agg(F.max(F.struct("n", "key"))["key"].alias("home"))
    # A bucket joins the one that most of its members have as their largest, if that one stays as it is.
    votes = large.join(homes, "node").groupBy("key", "home").agg(F.count("*").alias("k")).groupBy("key").agg(F.sum("k").alias("n"), F.max(F.struct("k", "home")).alias("best"))
    votes = materialize(votes.select("key", F.when(2 * F.col("best.k") >= F.col("n"), F.col("best.home")).otherwise(F.col("key")).alias("into")), "votes")
    stays = votes.filter("key = into").select(F.col("key").alias("into"), F.lit(True).alias("stays"))
    into = votes.join(stays, "into", "left").select("key", F.when(F.col("stays"), F.col("into")).otherwise(F.col("key")).alias("into"))
    members = materialize(large.join(into, "key").select(F.col("into").alias("key"), "node", "size", "component").distinct(), "families")
    each = members.groupBy("key", "component").agg(F.count("*").alias("n"), F.sum("size").alias("size"))
    parts = lambda n, size: F.greatest(F.ceil(n / limit), F.ceil(size / F.lit(ELEMENTS))).cast("long")
    best = F.col("best")
    sized = each.groupBy("key").agg(F.max(F.struct("n", "component", "size")).alias("best"), F.sum("n").alias("n"), F.sum("size").alias("size"))
    sized = sized.select("key", best["component"].alias("top"), parts(best["n"], best["size"]).alias("tops"), parts(F.col("n") - best["n"], F.col("size") - best["size"]).alias("others"))
    top = F.col("component") == F.col("top")
    part = F.pmod(F.xxhash64("node"), F.when(top, F.col("tops")).otherwise(F.col("others")))
    many = lambda n: F.when(n > 0, F.sequence(F.lit(0).cast("long"), n - 1)).otherwise(F.array().cast("array<long>"))
    tile = lambda kind, x, y: F.xxhash64("key", F.lit(kind), x, y)
    with_top = F.transform(many(F.col("others")), lambda i: tile("top", i, F.col("part")))
    apart = F.concat(F.transform(many(F.col("others")), lambda i: tile("other", F.least(i, F.col("part")), F.greatest(i, F.col("part")))), F.transform(many(F.col("tops")), lambda i: tile("top", F.col("part"), i)))
    placed = members.join(sized, "key").withColumn("part", part)
    return materialize(placed.select(F.explode(F.when(top, with_top).otherwise(apart)).alias("key"), "node", "component"), "tiles")


def merge(found: DataFrame, links: DataFrame) -> DataFrame:
    """``found`` (node, component) with components that ``links`` (a, b) connect joined: only components
    are joined anew, not their members. Nodes not in ``found`` are components of their own."""
    both = links.select("a", "b")
    for x in ("a", "b"):
        both = both.join(found.toDF(x, f"c{x}"), x, "left").withColumn(f"c{x}", F.coalesce(f"c{x}", x))
    joined = materialize(components(both, "ca", "cb").toDF("first", "merged"), "merged")
    moved = found.join(joined, F.col("component") == F.col("first"), "left").select("node", F.coalesce("merged", "component").alias("component"))
    new = joined.join(found, F.col("first") == F.col("node"), "left_anti").select(F.col("first").alias("node"), F.col("merged").alias("component"))
    return materialize(moved.unionByName(new), "components")


def linked(
    reps: DataFrame,
    rows: DataFrame,
    like: Likeness,
    confirm: Callable[[DataFrame], DataFrame],
    items: Callable[[DataFrame], DataFrame],
    sets_of: Callable[[pa.Table], tuple[np.ndarray, np.ndarray]],
    limit: int = LIMIT,
) -> DataFrame:
    """(node, component) of the nodes with a link, after rounds on the buckets of ``rows`` (see ``shared``).
    ``reps`` (node, size, sketch) has their nodes; ``confirm`` checks pairs (a, b) on full sets; ``items`` gives
    (node, item) of nodes, from which ``sets_of`` (see ``verified``) takes the sets."""
    stars = rows.filter("node <> hub").select(F.col("hub").alias("a"), F.col("node").alias("b")).distinct()
    tried = materialize(likely(stars, reps, like), "candidates")
    found = materialize(components(materialize(confirm(tried), "links")), "components")

    def search(live: DataFrame) -> DataFrame:
        sketched = live.join(reps.select("node", F.col("size").alias("of"), "sketch"), "node").select("key", "node", "component", "of", "sketch")
        near = materialize(sketched.repartition("key").sortWithinPartitions("key", "node").mapInArrow(_near(like), "key long, a long, b long"), "near")
        pairs = materialize(near.filter("key is null").select("a", "b").distinct().join(tried, ["a", "b"], "left_anti"), "pairs")
        dense = near.filter("key is not null").toDF("key", "node", "component").distinct()
        whole = dense.join(items(dense), "node").select("key", "node", "component", "item").repartition("key").sortWithinPartitions("key", "node")
        return confirm(pairs).unionByName(whole.mapInArrow(verified(sets_of, like.percent), "a long, b long"))

    live = mixed(rows, found, limit)
    if live.isEmpty():
        return found
    large = live.filter("large")
    some = not large.isEmpty()
    links = search(live.filter("not large"))
    if some:
        links = links.unionByName(confirm(materialize(likely(_stars(large), reps, like), "hub_pairs")))
    found = _merged(found, links)
    if some:
        left = mixed(large, found, limit)
        if not left.isEmpty():
            found = _merged(found, search(tiles(left, limit)))
    return found


def _merged(found: DataFrame, links: DataFrame) -> DataFrame:
    links = materialize(links, "round_links")
    return found if links.isEmpty() else merge(found, links)


def whole_buckets(batches: Iterator[pa.RecordBatch], rows: int = 4096) -> Iterator[tuple[np.ndarray, pa.Table]]:
    """From rows in order of their first column (key): tables of whole buckets, about ``rows`` rows each."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            held.append(batch.slice(at, rows))
            table = pa.Table.from_batches(held).combine_chunks()
            key = table.column(0).to_numpy()
            if len(key) < rows or key[0] == key[-1]:
                continue
            cut = int(np.flatnonzero(key != key[-1])[-1]) + 1
            yield key[:cut], table.slice(0, cut)
            held = table.slice(cut).combine_chunks().to_batches()
    if held and sum(map(len, held)):
        table = pa.Table.from_batches(held).combine_chunks()
        yield table.column(0).to_numpy(), table


def pairs_within(key: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All pairs i < j of rows with equal keys (in order), some at a time, in order of i."""
    n = len(key)
    last = np.flatnonzero(np.append(key[1:] != key[:-1], True))
    later = last[np.searchsorted(last, np.arange(n))] - np.arange(n)
    total, lo = np.cumsum(later), 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(total, (total[lo - 1] if lo else 0) + _PAIRS, "right")))
        part = later[lo:hi]
        i = np.repeat(np.arange(lo, hi), part)
        yield i, i + 1 + np.arange(len(i)) - np.repeat(np.cumsum(part) - part, part)
        lo = hi


def verified(sets_of: Callable[[pa.Table], tuple[np.ndarray, np.ndarray]], percent: int):
    """For ``mapInArrow`` over (key, node, component, item) in order of key: links (a, b) between different
    components of each bucket with 100 * intersection >= percent * union; of links among nodes that
    other links of the bucket connect, some are left out. ``sets_of`` gives the elements of a table's items and
    the row of each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, table in whole_buckets(batches):
            node, component = table.column(1).to_numpy(), table.column(2).to_numpy()
            elements, row = sets_of(table)
            order = np.argsort(elements)
            new = np.append(False, elements[order[1:]] != elements[order[:-1]])
            ids = np.empty(len(order), np.int64)
            ids[order] = np.cumsum(new)
            width = int(ids.max()) + 1 if len(ids) else 1
            both = np.sort(row * width + ids)
            both = both[np.append(True, both[1:] != both[:-1])] if len(both) else both
            row, ids = both // width, both % width
            at = np.searchsorted(row, np.arange(len(key) + 1))
            size = np.diff(at)
            mark = np.zeros(width, bool)
            bucket = np.cumsum(np.append(False, key[1:] != key[:-1]))
            bounds = np.searchsorted(bucket, np.arange(bucket[-1] + 2))
            # Labels of components within a bucket; links make them one.
            label = np.unique(np.stack([bucket, component], axis=1), axis=0, return_inverse=True)[1].ravel()
            a, b = [], []
            for i, j in pairs_within(key):
                maybe = (label[i] != label[j]) & (100 * np.minimum(size[i], size[j]) >= percent * np.maximum(size[i], size[j])) & (size[i] > 0)
                i, j = i[maybe], j[maybe]
                heads = np.flatnonzero(np.append(True, i[1:] != i[:-1])) if len(i) else []
                for lo, hi in zip(heads, [*heads[1:], len(i)], strict=True):
                    one, others = int(i[lo]), j[lo:hi]
                    others = others[label[others] != label[one]]
                    if not len(others):
                        continue
                    mark[ids[at[one] : at[one + 1]]] = True
                    counts = size[others]
                    first = np.cumsum(counts) - counts
                    held = mark[ids[np.repeat(at[others] - first, counts) + np.arange(int(counts.sum()))]]
                    common = np.add.reduceat(held, first, dtype=np.int32)
                    mark[ids[at[one] : at[one + 1]]] = False
                    alike = others[100 * common >= percent * (size[one] + counts - common)]
                    if len(alike):
                        joined, which = np.unique(label[alike], return_index=True)
                        a += [int(node[one])] * len(joined)
                        b += node[alike[which]].tolist()
                        of = slice(bounds[bucket[one]], bounds[bucket[one] + 1])
                        label[of][np.isin(label[of], joined)] = label[one]
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return run
