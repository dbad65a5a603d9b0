"""Near-duplicate vectors, source divergence and whitening against brute force, and on awkward rows."""

import re
from collections import Counter, defaultdict

import numpy as np
import pytest

pytest.importorskip("loambase.llm.registry")

from pyspark.sql import functions as F  # noqa: E402

from loambase.llm import divergence, flatgraph, registry, vectors, whitening  # noqa: E402

SF = "/root/testdata/sf0.001"
SCHEMA = "vec_id long, embedding array<double>, label int"


def brute(rows, least=0.98):
    """{position: (links, component)} of rows (id, vector, label)."""
    unit = {}
    for i, (v, x, label) in enumerate(rows):
        if v is not None and x and label is not None and all(c is not None and np.isfinite(c) for c in x) and any(x):
            y = np.array(x) / np.abs(x).max()
            unit[i] = y / np.linalg.norm(y)
    links = {i: [j for j in unit if j != i and i in unit and rows[i][2] == rows[j][2] and len(unit[i]) == len(unit[j]) and unit[i] @ unit[j] >= least] for i in range(len(rows))}
    out = {}
    for i in range(len(rows)):
        seen, todo = {i}, [i]
        while todo:
            for j in links[todo.pop()]:
                if j not in seen:
                    seen.add(j)
                    todo.append(j)
        out[i] = (len(links[i]), min(rows[j][0] for j in seen) if rows[i][0] is not None else None)
    return out


def groups(rng, sizes, d=16, spread=0.05, label=0, start=0):
    rows = []
    for n in sizes:
        centre = rng.normal(size=d)
        centre /= np.linalg.norm(centre)
        for _ in range(n):
            v = centre + spread * rng.normal(size=d) / np.sqrt(d)
            rows.append((start + len(rows), v.tolist(), label))
    return rows


@pytest.mark.parametrize("limit", [4096, 60])
def test_near_vectors(spark, limit):
    """Groups of all sizes, one of them larger than a shard, and vectors on their own; in one shard and in many."""
    rng = np.random.default_rng(1)
    rows = groups(rng, [150, 40, 9, 3, 2, *[1] * 150])
    rows += groups(rng, [30, 2, *[1] * 20], label=1, start=len(rows))
    rows += groups(rng, [1] * 5, label=2, d=8, start=len(rows))
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in vectors.near_vectors(spark.createDataFrame(rows, SCHEMA).repartition(5), limit=limit).collect()}
    want = {rows[i][0]: (k, c, rows[i][0] == c) for i, (k, c) in brute(rows).items()}
    assert len(got) == len(rows)
    true, found = sum(k for k, _, _ in want.values()), sum(k for k, _, _ in got.values())
    assert found <= true and found >= 0.99 * true
    assert sum(got[v] != want[v] for v in want) <= 0.02 * len(want)


def test_near_vectors_dense_shard(spark):
    """A group of near copies that no centre can part is compared whole, in pairs of parts."""
    rows = groups(np.random.default_rng(2), [300], spread=0.14)
    got = {r.vec_id: r.n_links for r in vectors.near_vectors(spark.createDataFrame(rows, SCHEMA), limit=60).collect()}
    want = {rows[i][0]: k for i, (k, _) in brute(rows).items()}
    assert sum(want.values()) > 10_000
    assert abs(sum(got.values()) - sum(want.values())) <= 0.005 * sum(want.values())
    assert all(got[v] <= want[v] for v in want)


def test_near_vectors_awkward(spark):
    big, tiny = 1e200, 1e-200
    rows = [
        (1, [1.0, 0.0], 1), (2, [2.0, 0.0], 1), (3, [1.0, 0.0], 1), (3, [1.0, 0.0], 1), (4, [1.0, 0.0], 2), (5, [1.0, 0.0], None), (6, None, 1), (7, [0.0, 0.0], 1), (8, [None, 1.0], 1),
        (9, [float("nan"), 1.0], 1), (10, [float("inf"), 0.0], 1), (11, [], 1), (12, [1.0, 0.0, 0.0], 1), (13, [big, big / 100], 1), (14, [tiny, 0.0], 1), (None, [1.0, 0.0], 1), (15, [-0.0, 5.0], 3), (16, [0.0, 5.0], 3),
    ]
    docs = spark.createDataFrame(rows, SCHEMA).withColumn("node", F.lit(1)).withColumn("key", F.lit("x")).withColumn("kept", F.lit(3)).withColumn("unit", F.lit(0.1))
    got = sorted((r.vec_id, r.n_links, r.component_id, r.kept) for r in vectors.near_vectors(docs).collect())
    want = brute([r for r in rows if r[0] is not None])
    kept = [r for r in rows if r[0] is not None]
    assert got == sorted((kept[i][0], k, c, kept[i][0] == c) for i, (k, c) in want.items())
    assert vectors.near_vectors(docs.limit(0)).collect() == []


def test_audit(spark):
    rows = groups(np.random.default_rng(3), [40, 20, *[1] * 100])
    row = vectors.audit(spark.createDataFrame(rows, SCHEMA)).first()
    assert row.asked > 0 and row.got >= 0.99 * row.asked


def test_flat_graph():
    """Pruned lists hold no candidate that one chosen is nearer to by the slack; greedy search ends at the nearest."""
    rng = np.random.default_rng(5)
    units = rng.normal(size=(400, 8))
    units /= np.linalg.norm(units, axis=1, keepdims=True)
    graph, start = flatgraph.build(units)
    assert graph.max() < 400 and not (graph == np.arange(400)[:, None]).any()
    for p in range(0, 400, 37):
        near = graph[p][graph[p] >= 0]
        assert len(set(near.tolist())) == len(near)
    asked = rng.normal(size=(60, 8))
    asked /= np.linalg.norm(asked, axis=1, keepdims=True)
    beam = flatgraph.greedy(units.astype(np.float32), graph, start, asked.astype(np.float32))
    best = (asked @ units.T).argmax(axis=1)
    assert np.mean([b in row for b, row in zip(best, beam, strict=True)]) >= 0.95


TERM = re.compile("[^\x00-\x40\x5b-\x60\x7b-\x7f]+")


def brute_divergence(docs):
    docs = [tuple(x or "" for x in d) for d in docs]
    terms = [[t.translate({c: c + 32 for c in range(65, 91)}) for t in TERM.findall(text)] for text, _, _ in docs]
    out = []
    for lang in {d[1] for d in docs}:
        df, every, groups_ = Counter(), Counter(), defaultdict(Counter)
        for t, (_, g, source) in zip(terms, docs, strict=True):
            if g == lang:
                df.update(set(t))
                every.update(t)
                groups_[source].update(t)
        kept = sorted(t for t in df if df[t] >= 3)
        p = lambda c: {t: 1 + 10**9 * (c[t] + 1) // (sum(c[x] for x in kept) + len(kept)) for t in kept}
        q, ps = p(every), {s: p(c) for s, c in groups_.items()}
        for s in ps:
            pairs = [(sum((ps[s][t] - ps[o][t]) ** 2 // ps[o][t] for t in kept), o) for o in ps if o != s]
            own = [((ps[s][t] - q[t]) ** 2 // q[t], t) for t in kept if groups_[s][t] and ps[s][t] > q[t]]
            for part, rows in (("pair", pairs), ("term", own)):
                ranked = sorted(rows, key=lambda x: (-x[0], x[1].encode()))
                out += [(lang, s, part, i, v, n) for n, (v, i) in enumerate(ranked, 1) if part == "pair" or n <= 200]
    return sorted(out)


def test_divergence(spark, monkeypatch):
    """Blocks and tables of pairs so small that they fill and go out many times."""
    monkeypatch.setattr(divergence, "BLOCK", 64)
    monkeypatch.setattr(divergence, "PAIRS", 8)
    rng = np.random.default_rng(6)
    words = ["the", "The", "über", "\U0001f600", "naïve", "A", "b", "x1y", "é", *[f"w{chr(97 + i)}" for i in range(26)]]
    docs = [(" ".join(words[i] for i in rng.zipf(1.3, int(rng.integers(0, 60))) % len(words)), f"l{rng.integers(0, 3)}", f"s{rng.integers(0, 5)}") for _ in range(120)]
    docs += [(None, None, None), ("", "l0", "empty"), ("\x00 \x7f 123", "l9", "s0"), ("one two", "l9", "s1"), ("lone", "l8", None), ("z" * 200_000, "l1", "s1"), ("the " * 50_000, "l1", "s2")] + [("same same", "l2", "s3")] * 4
    frame = spark.createDataFrame(docs, "text string, lang string, source string").withColumn("term", F.lit(1)).withColumn("g", F.lit(2)).withColumn("p", F.lit("x")).repartition(4)
    got = sorted(tuple(r) for r in divergence.divergence(frame).collect())
    assert got == brute_divergence(docs)
    assert divergence.divergence(frame.limit(0)).collect() == []


def test_divergence_sql(spark):
    import duckdb

    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    got = sorted(tuple(r) for r in registry.op12_source_divergence(spark, SF).collect())
    assert got == sorted(map(tuple, duck.sql(registry.ORACLES["op12_source_divergence"]).fetchall()))


def test_whitening(spark):
    e = spark.read.parquet(f"{SF}/embeddings.parquet")
    got = registry.op13_whitening(spark, SF).toPandas().sort_values(["vec_id", "component"])
    pdf = e.toPandas().sort_values("vec_id")
    x = np.floor(64 * np.array(pdf.embedding.tolist(), float)).astype(np.int64) + 1_000_000
    n, sums = len(x), x.sum(0)
    assert len(got) == n * 32 and (got.n == n).all()
    assert (got.deviation.to_numpy().reshape(n, 32) == ((n * x - sums) ** 2).sum(1)[:, None]).all()
    y = x - sums / n
    values, vecs = np.linalg.eigh(y.T @ y / n)
    values, vecs = values[::-1], vecs[:, ::-1]
    want, w = (y @ vecs / np.sqrt(values))[:, :32], got.whitened.to_numpy().reshape(n, 32)
    assert np.abs(w * np.sign((w * want).sum(0)) - want).max() < 1e-8
    assert np.abs(got.explained.to_numpy()[:32] - values[:32] / values.sum()).max() < 1e-12
    assert got.identity_error.max() < 1e-9 and got.identity_error.nunique() == 1


def test_cholesky_and_jacobi():
    rng = np.random.default_rng(8)
    for d, rank in ((1, 1), (5, 5), (12, 4), (31, 31)):
        a = rng.normal(size=(d, rank)) * np.logspace(0, 3, rank)
        m = a @ a.T
        factor, order = whitening.cholesky(m)
        assert factor.shape == (d, rank)
        assert np.abs(factor @ factor.T - m[np.ix_(order, order)]).max() <= 1e-9 * np.abs(m).max()
        values, vecs = whitening.decomposed(m)
        want = np.linalg.eigvalsh(m)[::-1][:rank]
        assert np.abs(values - want).max() <= 1e-10 * want.max()
        assert np.abs(vecs.T @ vecs - np.eye(len(values))).max() < 1e-10


def test_whitening_awkward(spark):
    rng = np.random.default_rng(9)
    rows = [(i, rng.normal(size=3).tolist(), 0) for i in range(20)] + [(0, [1.0, 2.0, 3.0], None), (0, [1.0, 2.0, 3.0], None), (None, [0.5, 0.5, 0.1], 1)]
    rows += [(50, None, 0), (51, [None, 1.0, 2.0], 0), (52, [float("nan")] * 3, 0), (53, [float("inf"), 0.0, 0.0], 0), (54, [1.0], 0), (55, [], 0)]
    docs = spark.createDataFrame(rows, SCHEMA).withColumn("id", F.lit("x")).withColumn("x", F.lit(1)).withColumn("n", F.lit(2)).repartition(3)
    got = whitening.whitened(docs).collect()
    assert len(got) == 23 * 3 and {r.component for r in got} == {1, 2, 3} and {r.n for r in got} == {23}
    assert max(r.identity_error for r in got) < 1e-9 and sum(r.vec_id is None for r in got) == 3
    # One direction only; equal vectors; huge entries; none at all.
    line = spark.createDataFrame([(i, [float(i), float(-i)], 0) for i in range(9)], SCHEMA)
    assert {r.component for r in whitening.whitened(line).collect()} == {1}
    assert whitening.whitened(spark.createDataFrame([(i, [1.0, 2.0], 0) for i in range(5)], SCHEMA)).collect() == []
    huge = whitening.whitened(spark.createDataFrame([(i, [float(rng.normal()) * 1e300, float(rng.normal())], 0) for i in range(30)], SCHEMA)).collect()
    assert len(huge) >= 30 and max(r.identity_error for r in huge) < 1e-4 and any(r.deviation is None for r in huge)
    assert whitening.whitened(docs.limit(0)).collect() == []
