"""Diversity re-ranking against its definition; the boost and the content gate of the search over layers."""

import numpy as np

from loambase.operators import hits, search


def greedy(pool, k, relevance=0.7):
    """pool: (doc, score, vector). One at a time, the best by relevance less likeness to what is chosen."""
    unit = {d: np.array(v) / (np.linalg.norm(v) or 1) for d, _, v in pool}
    rest = sorted(pool, key=lambda x: (-x[1], x[0]))
    if len(rest) <= k or k == 1:
        return [d for d, _, _ in rest[:k]]
    chosen = []
    for _ in range(k):
        near = lambda d: max([0.0, *(min(1.0, float(unit[d] @ unit[c])) for c in chosen)])
        best = max(rest, key=lambda x: (round(relevance * x[1] - (1 - relevance) * near(x[0]), 12), x[1], -x[0]))
        chosen.append(best[0])
        rest.remove(best)
    return chosen


def test_mmr(spark):
    rng = np.random.default_rng(2)
    rows, want = [], {}
    for q, n in enumerate((1, 5, 8, 9, 40, 120)):
        base = rng.normal(size=(4, 6))
        pool = [(d, round(float(rng.random()), 3), (base[d % 4] + 0.3 * rng.normal(size=6)).tolist()) for d in range(n)]
        pool[0] = (0, pool[0][1], [0.0] * 6)
        rows += [(q, *p) for p in pool]
        want[q] = greedy(pool, 8)
    frame = spark.createDataFrame(rows, "query long, doc long, score double, vector array<double>").repartition(3)
    got = {}
    for r in search.mmr(frame).orderBy("query", "rank").collect():
        got.setdefault(r["query"], []).append(r["doc"])
    assert got == want


def test_layers(spark):
    layer = lambda rows: spark.createDataFrame(rows, "doc long, vector array<double>, content string, verified boolean")
    layers = {
        "notes": layer([(1, [1.0, 0.0], "a", False), (2, [0.9, 0.5], "b", True), (3, [1.0, 0.0], "  ", True), (4, [0.0, 1.0], "c", True)]),
        "topics": layer([(1, [1.0, 0.1], "d", None), (5, [1.0, 0.0], None, False)]),
    }
    asked = spark.createDataFrame([(7, [1.0, 0.0])], "query long, vector array<double>")
    got = [(r["layer"], r["doc"]) for r in hits.best(hits.layered(layers, asked), 3).orderBy("rank").collect()]
    assert got == [("notes", 2), ("notes", 1), ("topics", 1)]
