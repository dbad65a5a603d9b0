"""Benchmark items whose parts stand in another order."""

from collections import Counter

import numpy as np

from loambase.llm import decontaminate


def brute_best(words, item):
    bag = Counter(tuple(item[j : j + 5]) for j in range(len(item) - 4))
    out = 0.0
    for s in range(max(1, len(words) - len(item) + 1)):
        part = words[s : s + len(item)]
        have = Counter(tuple(part[j : j + 5]) for j in range(len(part) - 4))
        out = max(out, sum((have & bag).values()) / sum(bag.values()))
    return out


def test_decontamination_reordered(spark):
    rng = np.random.default_rng(4)
    draw = lambda n: [f"w{x}" for x in rng.integers(0, 1 << 30, n)]
    items, docs = {}, {}
    for i in range(12):
        q = items[i] = draw(60)
        at, end = int(rng.integers(20, 40)), int(rng.integers(40, 60))
        moved = (q[30:] + q[:30], q[at:] + q[:at], q[end:] + q[at:end] + q[:at])[i % 3]
        docs[i] = [*draw(int(rng.integers(0, 50))), *moved, *draw(int(rng.integers(0, 50)))]
        docs[100 + i] = [*moved[:40], *draw(30), *moved[40:]]
        docs[200 + i] = [*moved[:53], *draw(3)]
    want = {(d, i): s for d, w in docs.items() for i, q in items.items() if (s := brute_best(w, q)) >= 0.8}
    assert {d for d, _ in want} >= {0, 1, 3, 4, 6, 7}
    frame = lambda rows, c: spark.createDataFrame([(k, " ".join(w)) for k, w in rows.items()], f"{c} long, text string")
    got = {(r.doc_id, r.item_id): r.similarity for r in decontaminate.matches(frame(docs, "doc_id"), frame(items, "item_id")).collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-6 for k in want)
