"""Exact values at ranks of a large column: splitters, counts, and a bounded pick."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: So many values are sorted at once; splitters lie within one in so many of the rank.
PICK, ACCURACY = 10_000, 10_000


def values_at(rows: DataFrame, column: str, ranks: list[int], pick: int = PICK, accuracy: int = ACCURACY) -> list[float]:
    """The values at ``ranks`` (from 0, in order of value; nulls don't count) of a table. Give a table, not a
    plan that is costly to run again.

    Two splitters around a rank come from quantile sketches, whose partial results are merged; exact counts tell how many
    values lie below and between them, and the search goes on between them (or beside them, if a sketch was
    wrong) until few values are left. No task sorts or holds more than ``pick`` values."""
    v = F.col(column)
    held = rows.select(v.cast("double").alias(column)).filter(v.isNotNull())
    count = held.count()
    out = []
    for rank in ranks:
        if not 0 <= rank < count:
            raise ValueError(f"values_at: rank {rank} of {count}")
        part, below, inside = held, 0, count
        while True:
            if inside <= pick:
                out.append(part.orderBy(column).offset(rank - below).first()[0])
                break
            at, step = (rank - below) / inside, 2 / accuracy
            lo, hi = part.agg(F.percentile_approx(v, [max(0.0, at - step), min(1.0, at + step)], accuracy)).first()[0]
            under, upto = part.agg(F.count_if(v < lo), F.count_if(v <= hi)).first()
            if rank < below + under:
                part, inside = part.filter(v < lo), under
            elif rank >= below + upto:
                part, below, inside = part.filter(v > hi), below + upto, inside - upto
            elif lo == hi:
                out.append(lo)
                break
            elif upto - under == inside:
                # The sketch can't part these; halve the range of values.
                middle = lo + (hi - lo) / 2
                left = part.filter(v <= middle).count()
                if left == inside:
                    top = part.filter(v < hi).count()
                    part, inside, below = (part.filter(v < hi), top, below) if rank < below + top else (part.filter(v == hi).limit(1), 1, rank)
                elif rank < below + left:
                    part, inside = part.filter(v <= middle), left
                else:
                    part, below, inside = part.filter(v > middle), below + left, inside - left
            else:
                part, below, inside = part.filter((v >= lo) & (v <= hi)), below + under, upto - under
    return out
