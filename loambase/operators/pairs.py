"""The best pairs of notes by a score of shared tokens and words: a top-k similarity join.

A lower bound of the k-th best score comes from a linear number of pairs (neighbours in the lists of notes that
share a token). Pairs above the bound must share so many tokens or words that, with each note's elements in order
of rarity, one of the rare ones at its front is shared (prefix filter); so frequent tokens make no pairs unless
such a pair can win. Of two ways to split the score between tokens and words the one with the shorter lists, as counted, is
joined. Lists over ``HOT`` notes are compared in tiles, a task each, which give only pairs that share enough. Ties with the
bound go by ids, so they are looked for from the smallest ids on, in growing batches.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import materialize

#: Members of a list from which on it is compared in tiles; so many pairs a note may be joined at once.
HOT, EASY = 1000, 50
_SALTS = 32


@dataclass(frozen=True)
class Rule:
    """same: for the same block, with ``same_needs`` shared tokens; alike: for shared / union over 0.7; words: 1 to 3 for
    3 to 5 shared words; each: for every shared token; apart: tokens that pairs of different blocks need; step: between two
    scores; alone: pairs of a block count though they share nothing; counted: the side whose repeats count."""

    same: float
    same_needs: int
    alike: float
    words: bool
    each: float
    apart: int
    step: float
    alone: bool
    counted: str

    def bound(self, shared: Column, distinct: Column, words: Column, same: bool) -> Column:
        """No pair of a note with so many shared tokens has a higher score."""
        most = F.when(shared > 0.7 * distinct, self.alike).otherwise(0.0) + self.each * shared + words
        return most + F.when(shared >= self.same_needs, self.same).otherwise(0.0) if same else F.when(shared >= self.apart, most).otherwise(-1.0)

    def score(self, same: Column, shared: Column, union: Column, words: Column) -> Column:
        value = F.when(same & (shared >= self.same_needs), self.same).otherwise(0.0) + F.when(shared / F.greatest(union, F.lit(1)) > 0.7, self.alike).otherwise(0.0) + self.each * shared
        value = value + F.when(words >= 3, F.least(F.lit(3), words - 2)).otherwise(0) if self.words else value
        return F.when(same | (shared >= self.apart), value).otherwise(0.0)


def featured(rows: DataFrame) -> DataFrame:
    """rows (id, block, tokens with repeats, words) with ``rare`` and ``rare_words``, the distinct ones, the rarest first, and
    ``repeats``: a power of two that no token's count exceeds."""
    rows = materialize(rows, "rows")
    kind = lambda c, k: F.transform(F.array_distinct(c), lambda t: F.struct(F.lit(k).alias("kind"), t.alias("t")))
    each = rows.select("id", F.explode(F.concat(kind("tokens", 0), kind("words", 1))).alias("x")).select("id", "x.kind", "x.t")
    often = each.groupBy("kind", "t").agg(F.count("*").alias("df"))
    found = each.join(often, ["kind", "t"]).groupBy("id").agg(F.array_sort(F.collect_list(F.struct("df", "t", "kind"))).alias("xs"))
    of = lambda k: F.coalesce(F.transform(F.filter("xs", lambda x: x["kind"] == k), lambda x: x["t"]), F.array().cast("array<string>"))
    most = F.coalesce(F.array_max(F.transform(F.array_distinct("tokens"), lambda t: F.size(F.filter("tokens", lambda x: x == t)))), F.lit(1))
    out = rows.join(found, "id", "left").withColumns({"rare": of(0), "rare_words": of(1), "repeats": F.pow(F.lit(2), F.ceil(F.log2(most))).cast("int")})
    return materialize(out.drop("xs"), "features")


def scored(found: DataFrame, rows: DataFrame, rule: Rule) -> DataFrame:
    """(a, b, score) of pairs a < b."""
    side = lambda x: rows.select(F.col("id").alias(x), F.struct("block", "tokens", "words").alias(f"of_{x}"))
    both = found.join(side("a"), "a").join(side("b"), "b")
    one, other = (F.col("of_a"), F.col("of_b")) if rule.counted == "a" else (F.col("of_b"), F.col("of_a"))
    shared = F.size(F.filter(one["tokens"], lambda t: F.array_contains(other["tokens"], t)))
    same = F.coalesce(one["block"] == other["block"], F.lit(False))
    value = rule.score(same, shared, F.size(F.array_union(one["tokens"], other["tokens"])), F.size(F.array_intersect(one["words"], other["words"])))
    return both.select("a", "b", value.cast("double").alias("score")).filter("score > 0")


def _first_bound(rows: DataFrame, rule: Rule, k: int) -> float:
    """A score that k pairs reach (0: none do): of notes next to each other in salted lists."""
    salt = F.pmod(F.xxhash64("rare"), F.lit(_SALTS))
    keys = F.concat(F.transform("rare", lambda t: F.concat(F.lit("t"), F.coalesce("block", F.lit("")), F.lit("|"), t)), F.transform("rare_words", lambda t: F.concat(F.lit("w"), t)))
    lists = rows.select("id", "rare", salt.alias("salt"), F.explode(keys).alias("key"))
    by = Window.partitionBy("key", "salt").orderBy("rare", "id")
    near = lists.select("id", F.array(F.lag("id").over(by), F.lag("id", 2).over(by)).alias("before")).select("id", F.explode("before").alias("other")).filter("other is not null")
    found = scored(near.select(F.least("id", "other").alias("a"), F.greatest("id", "other").alias("b")).distinct(), rows, rule)
    best = found.orderBy(F.desc("score")).limit(k).collect()
    return best[-1]["score"] if len(best) == k else 0.0


def _postings(rows: DataFrame, rule: Rule, least: float, classes: list[int], way: str) -> DataFrame:
    """(key, m, id, own, needs): what a note must share with another one, one of these, for a score of ``least``. ``m``: the
    greater ``repeats`` of a pair; ``own``: whether it is this note's; ``needs``: how many distinct elements of the kind it
    must share. ``way`` "tokens": tokens make up for what words can't; "words": three shared words, or tokens alone."""
    most_words = F.when(F.size("rare_words") >= 3, F.least(F.lit(3), F.size("rare_words") - 2)).otherwise(0) if rule.words and way == "tokens" else F.lit(0)
    out, steps = [], F.sequence(F.lit(1), F.lit(max(1, int(-(-least // rule.each)))))
    for same in (True, False):
        shared = F.array_min(F.filter(steps, lambda s: rule.bound(s, F.size("rare"), most_words, same) >= least))
        each = rows.filter("block is not null") if same else rows
        each = each.select("id", "block", "rare", "repeats", shared.alias("shared")).filter("shared is not null")
        each = each.withColumn("m", F.explode(F.array(*map(F.lit, classes)))).filter("m >= repeats").withColumn("needs", F.ceil(F.col("shared") / F.col("m")).cast("int"))
        each = each.withColumn("t", F.explode(F.slice("rare", 1, F.greatest(F.lit(0), F.size("rare") - F.col("needs") + 1))))
        key = F.concat(F.lit("b"), "block", F.lit("|"), "t") if same else F.concat(F.lit("t"), "t")
        out.append(each.select(key.alias("key"), "m", "id", (F.col("m") == F.col("repeats")).alias("own"), "needs"))
    words = 3 if way == "words" else int(-(-least // 1)) + 2
    if rule.words and words <= 5:
        front = rows.select("id", F.explode(F.slice("rare_words", 1, F.greatest(F.lit(0), F.size("rare_words") - words + 1))).alias("t"))
        out.append(front.select(F.concat(F.lit("w"), "t").alias("key"), F.lit(1).alias("m"), "id", F.lit(True).alias("own"), F.lit(words).alias("needs")))
    return reduce(DataFrame.unionByName, out)


def _tile(table: pa.Table) -> pa.Table:
    """Of a tile (left, id, own, needs, elements): the pairs a < b that share as much as both need."""
    ids, needs, own = (table.column(c).to_numpy() for c in ("id", "needs", "own"))
    elements = table.column("elements").combine_chunks()
    row, code = np.repeat(np.arange(len(ids)), elements.value_lengths().to_numpy()), elements.flatten().to_numpy()
    left = table.column("left").to_numpy()
    place = np.where(left, np.cumsum(left) - 1, np.cumsum(~left) - 1)
    count = np.zeros((int(left.sum()), int((~left).sum())), np.int16)
    order = np.argsort(code, kind="stable")
    row, code = row[order], code[order]
    heads = np.flatnonzero(np.append(True, code[1:] != code[:-1])) if len(code) else np.zeros(0, int)
    for part in np.split(row, heads[1:]):
        x, y = part[left[part]], part[~left[part]]
        if len(x) and len(y):
            count[np.ix_(place[x], place[y])] += 1
    x, y = np.flatnonzero(left), np.flatnonzero(~left)
    good = (count >= np.maximum(needs[x][:, None], needs[y][None, :])) & (own[x][:, None] | own[y][None, :]) & (ids[x][:, None] != ids[y][None, :])
    i, j = np.nonzero(good)
    a, b = ids[x[i]], ids[y[j]]
    return pa.table({"a": pa.array(np.minimum(a, b)), "b": pa.array(np.maximum(a, b))})


def _tiled(hot: DataFrame, rows: DataFrame) -> DataFrame:
    """Pairs of the lists in ``hot`` (key, m, id, own, needs, n) by tiles: parts of a list against parts of it."""
    parts = F.ceil(F.col("n") / HOT)
    mine = hot.withColumns({"parts": parts, "part": F.pmod(F.xxhash64("id"), parts)})
    spread = mine.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
    named = lambda left: spread.filter("part <= other" if left else "part >= other").select("key", "m", "id", "own", "needs", F.least("part", "other").alias("x"), F.greatest("part", "other").alias("y"), F.lit(left).alias("left"))
    hashed = lambda c: F.transform(c, lambda t: F.xxhash64(t))
    held = rows.select("id", hashed("rare").alias("tokens"), hashed("rare_words").alias("words"))
    both = named(True).unionByName(named(False)).join(held, "id")
    both = both.withColumn("elements", F.when(F.col("key").startswith("w"), F.col("words")).otherwise(F.col("tokens")))
    return both.select("key", "m", "x", "y", "left", "id", "own", "needs", "elements").groupBy("key", "m", "x", "y").applyInArrow(lambda key, t: _tile(t), "a long, b long")


def _joined(posted: DataFrame, cut: int | None = None) -> DataFrame:
    """Pairs a < b of the lists; with ``cut``, those with a of ``cut`` at most."""
    one = posted.filter(F.col("id") <= cut) if cut is not None else posted.filter("own")
    x, y = one.select("key", "m", F.col("id").alias("x"), F.col("own").alias("ox")), posted.select("key", "m", F.col("id").alias("y"), F.col("own").alias("oy"))
    both = x.join(y, ["key", "m"])
    both = both.filter("x < y and (ox or oy)") if cut is not None else both.filter("x < y or x > y and not oy")
    return both.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))


def _cheapest(rows: DataFrame, rule: Rule, least: float, classes: list[int]) -> tuple[DataFrame, int]:
    """The postings (with n, a list's length) of the way whose lists make fewer pairs, and how many they make."""
    best = None
    for way in ("tokens", "words") if rule.words else ("tokens",):
        posted = materialize(_postings(rows, rule, least, classes, way), "postings")
        lists = posted.groupBy("key", "m").agg(F.count("*").alias("n"), F.count_if("own").alias("k")).filter("n > 1 and k > 0")
        cost = int(lists.agg(F.coalesce(F.sum(F.col("n").cast("decimal(38,0)") * F.col("k")), F.lit(0))).first()[0])
        if best is None or cost < best[2]:
            best = posted, lists, cost
    posted, lists, cost = best
    return posted.join(lists.drop("k"), ["key", "m"]), cost


def _reach(posted: DataFrame, rows: DataFrame, rule: Rule, least: float) -> DataFrame:
    """All pairs of the lists with a score of ``least`` or more, scored."""
    few, hot = _joined(posted.filter(F.col("n") <= HOT)), _tiled(posted.filter(F.col("n") > HOT), rows)
    return scored(few.unionByName(hot).distinct(), rows, rule).filter(F.col("score") >= least)


def _alone(rows: DataFrame, k: int) -> DataFrame:
    """Pairs of a block's first members: of pairs that share nothing only these can be among the k first."""
    first = rows.filter("block is not null").select("id", "block", F.row_number().over(Window.partitionBy("block").orderBy("id")).alias("n")).filter(F.col("n") <= k + 1)
    return first.select(F.col("id").alias("a"), "block").join(first.select(F.col("id").alias("b"), "block"), "block").filter("a < b").select("a", "b")


def top_pairs(rows: DataFrame, rule: Rule, k: int) -> DataFrame:
    """(a, b, score) of the k best pairs a < b of rows (id, block, tokens, words), by score, then a, then b. Ids are
    distinct and not null; null tokens or words are none; a null block is no note's but its own."""
    none = F.array().cast("array<string>")
    rows = featured(rows.select(F.col("id").cast("long").alias("id"), "block", F.coalesce("tokens", none).alias("tokens"), F.coalesce("words", none).alias("words")))
    first: Callable[[DataFrame], DataFrame] = lambda found: found.orderBy(F.desc("score"), "a", "b").limit(k)
    classes = [r[0] for r in rows.select("repeats").distinct().orderBy("repeats").collect()] or [1]
    bound = _first_bound(rows, rule, k)
    alone = scored(_alone(rows, k), rows, rule) if rule.alone else None
    if alone is not None:
        best = first(alone).collect()
        bound = max(bound, best[-1]["score"] if len(best) == k else 0.0)
    least = bound if bound > 0 else rule.step
    posted, cost = _cheapest(rows, rule, least, classes)
    n = rows.count()
    if cost <= EASY * n:
        found = _reach(posted, rows, rule, least)
        return first(found if alone is None else found.unionByName(alone.filter(F.col("score") >= least)).distinct())
    # Too many pairs can reach the bound. Those above it come first; then ties with it, of the smallest ids.
    found = _reach(_cheapest(rows, rule, bound + rule.step, classes)[0], rows, rule, bound + rule.step)
    found = materialize(first(found if alone is None else found.unionByName(alone.filter(F.col("score") > bound)).distinct()), "best")
    have, size, level = found.count(), 64, F.col("score") == bound
    while bound > 0 and have < k:
        cut = None if size >= n else rows.select("id").orderBy("id").limit(size).agg(F.max("id")).first()[0]
        ties = _reach(posted, rows, rule, bound) if cut is None else scored(_joined(posted, cut).distinct(), rows, rule)
        tied = None if alone is None else alone.filter(level) if cut is None else alone.filter(level & (F.col("a") <= cut))
        ties = materialize(first(ties.filter(level) if tied is None else ties.filter(level).unionByName(tied).distinct()), "ties")
        if cut is None or ties.count() >= k - have:
            return first(found.unionByName(ties))
        size *= 8
    return first(found)
