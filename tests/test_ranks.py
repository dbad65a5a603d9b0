"""Values at ranks against sorting, with few values picked at once so that the search goes many rounds."""

import random

import pytest

from loambase.operators.cost import distribution
from loambase.operators.ranks import values_at


@pytest.mark.parametrize("kind", ["spread", "ties", "skewed"])
def test_values_at(spark, kind):
    rng = random.Random(3)
    make = {"spread": lambda: rng.random(), "ties": lambda: float(rng.randrange(5)), "skewed": lambda: 10 ** rng.uniform(-300, 300)}[kind]
    values = [make() for _ in range(3000)]
    rows = spark.createDataFrame([(v,) for v in values] + [(None,)] * 7, "v double").repartition(4).cache()
    ranks = [0, 1, 1499, 1500, 2700, 2999]
    assert values_at(rows, "v", ranks, pick=50, accuracy=20) == [sorted(values)[r] for r in ranks]
    rows.unpersist()
    with pytest.raises(ValueError):
        values_at(rows, "v", [3000])


def test_distribution(spark):
    rows = lambda xs: spark.createDataFrame([(float(x), 2) for x in xs], "usd double, calls long")
    assert tuple(distribution(rows([0.06, 0.10])).first()) == (0.16, 2, 4, 0.08, 0.1)
    assert tuple(distribution(rows([0.05])).first()) == (0.05, 1, 2, 0.05, 0.05)
    assert tuple(distribution(rows(range(1, 11))).first()) == (55.0, 10, 20, 5.5, 9.0)
    assert tuple(distribution(rows([])).first()) == (None, 0, None, None, None)
