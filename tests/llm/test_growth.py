"""What large families of one template cost: rows of all rounds, and the links found."""

import numpy as np
import pytest

from loambase.llm import lines, neardup, rounds


def template(n, length=200, changed=7, seed=1):
    """Documents of one template with other words at some places; each even one has a twin with one more change."""
    rng = np.random.default_rng(seed)
    base, out = [f"w{x}" for x in rng.integers(0, 1 << 40, length)], {}
    for d in range(0, n, 2):
        words = list(base)
        for i in rng.choice(length, changed, replace=False):
            words[i] = f"v{rng.integers(0, 1 << 40)}"
        twin = list(words)
        twin[int(rng.integers(0, length))] = f"v{rng.integers(0, 1 << 40)}"
        out |= {d: " ".join(words), d + 1: " ".join(twin)}
    return out


@pytest.mark.parametrize("n", [300, 600])
def test_rows_of_large_families(spark, monkeypatch, n):
    made = []
    real = rounds.materialize

    def counted(df, label):
        out = real(df, label)
        if label in ("mixed", "tiles"):
            made.append((label, out.count()))
        return out

    monkeypatch.setattr(rounds, "materialize", counted)
    texts = template(n)
    got = neardup.near_duplicates(spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(4), words=5, limit=20).toPandas()
    by = dict(zip(got.doc_id, got.component_id, strict=True))
    assert sum(by[d] == by[d + 1] for d in range(0, n, 2)) >= 0.99 * n / 2
    first = made[0][1]
    assert sum(k for _, k in made) <= 10 * first, made


def test_tiles_bring_all_together(spark):
    """Two members of different components of a bucket meet in a tile; no tile is much larger than two parts."""
    rng = np.random.default_rng(4)
    rows = []
    for key, n in ((1, 150), (2, 90), (3, 25)):
        rows += [(key, int(m), 5, int(m) if m % 3 else 0) for m in rng.choice(200, n, replace=False)]
    frame = spark.createDataFrame(rows, "key long, node long, size int, component long")
    held = {}
    for r in rounds.tiles(frame, 20).collect():
        held.setdefault(r.key, []).append((r.node, r.component))
    assert max(map(len, held.values())) <= 2 * 20 + 25
    met = {frozenset((a, b)) for t in held.values() for a, x in t for b, y in t if x != y}
    for key in (1, 2, 3):
        mine = [(m, c) for k, m, _, c in rows if k == key]
        assert all(frozenset((a, b)) in met for a, x in mine for b, y in mine if x != y)


def test_fuzzy_lines_tiles(spark):
    rng = np.random.default_rng(9)
    base, texts = [chr(0x4E00 + int(x)) for x in rng.integers(0, 20000, 200)], {}
    for d in range(0, 200, 2):
        line = list(base)
        for i in rng.choice(200, 6, replace=False):
            line[i] = chr(0x4E00 + int(rng.integers(0, 20000)))
        twin = list(line)
        twin[0] = "x"
        texts |= {d: "".join(line), d + 1: "".join(twin)}
    got = lines.fuzzy_lines(spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(4), limit=20).toPandas()
    by = dict(zip(got.doc_id, got.keep_doc_id, strict=True))
    assert sum(by[d] == by[d + 1] for d in range(0, 200, 2)) >= 99
