"""Pairs whose buckets all hold a large family of less similar members."""

import numpy as np

from loambase.llm import lines, neardup


def family(n_pairs, shared, paired, own, unit):
    """Members of one template: 2i and 2i + 1 share a part of their own, too, all others the template alone."""
    rng = np.random.default_rng(11)
    draw = lambda n: [unit(x) for x in rng.integers(0, 1 << 40, n)]
    body, out = draw(shared), {}
    for i in range(n_pairs):
        part = draw(paired)
        out |= {2 * i + j: [*body, *part, *draw(own)] for j in (0, 1)}
    return out


def test_near_duplicates_mixed_buckets(spark):
    texts = {d: " ".join(w) for d, w in family(600, 344, 15, 41, lambda x: f"{x:x}").items()}
    sets = {d: set(zip(t.split(), t.split()[1:], strict=False)) for d, t in texts.items()}
    assert all(100 * len(sets[d] & sets[e]) < 80 * len(sets[d] | sets[e]) for d, e in ((0, 2), (1, 3), (5, 9)))
    got = neardup.near_duplicates(spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(4)).toPandas()
    by = dict(zip(got.doc_id, got.component_id, strict=True))
    assert all(by[d] in (d, d - d % 2) for d in by)
    assert sum(by[d] == by[d + 1] for d in range(0, 1200, 2)) >= 597


def test_fuzzy_lines_mixed_buckets(spark):
    texts = {d: "".join(c) for d, c in family(300, 344, 12, 36, lambda x: chr(0x4E00 + x % 20000)).items()}
    assert all(lines.similar(texts[d], texts[d + 1]) and not lines.similar(texts[d], texts[(d + 2) % 600]) for d in range(0, 600, 2))
    got = lines.fuzzy_lines(spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(4)).toPandas()
    by = dict(zip(got.doc_id, got.keep_doc_id, strict=True))
    assert all(by[d] in (d, d - d % 2) for d in by)
    assert sum(by[d] == by[d + 1] for d in range(0, 600, 2)) >= 297
