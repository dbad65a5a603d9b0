"""The top-k pair join against all pairs, with rules, repeats, hot tokens and ties of all kinds."""

import random

import pytest

from loambase.operators import pairs
from loambase.operators.hygiene import CONTRADICTIONS, DUPLICATES

SCHEMA = "id long, block string, tokens array<string>, words array<string>"


def brute(rows, rule, k):
    out = []
    for i, (a, ba, ta, wa) in enumerate(rows):
        for b, bb, tb, wb in rows[i + 1 :]:
            one, other = (ta or [], tb or []) if rule.counted == "a" else (tb or [], ta or [])
            shared, union = sum(t in other for t in one), len({*one, *other})
            same, words = ba is not None and ba == bb, len({*(wa or [])} & {*(wb or [])})
            if not same and shared < rule.apart:
                continue
            score = (rule.same if same and shared >= rule.same_needs else 0) + (rule.alike if shared / max(union, 1) > 0.7 else 0) + rule.each * shared
            score += min(3, words - 2) if rule.words and words >= 3 else 0
            if score > 0:
                out.append((-score, a, b))
    return [(a, b, -s) for s, a, b in sorted(out)[:k]]


def notes(kind, n, rng):
    token = lambda m: f"t{min(int(rng.expovariate(1) * m / 4), m)}"
    rows = []
    for i in range(n):
        tokens, words = [token(60) for _ in range(rng.randrange(0, 7))], [f"w{rng.randrange(40)}" for _ in range(rng.randrange(0, 9))]
        if kind == "hot":
            tokens = ["hot", f"u{i}", f"v{i % 97}"]
        elif kind == "pair":
            tokens, words = ["hot", "warm", f"u{i}"], []
        elif kind == "same":
            tokens, words = ["one"], [f"w{i}"]
        elif kind == "apart":
            tokens, words = [f"u{i}"], []
        rows.append((i * 3 + 1, None if i % 11 == 5 else f"b{rng.randrange(4)}", None if i % 50 == 7 else tokens, None if i % 50 == 9 else sorted({*words})))
    return rows


@pytest.mark.parametrize("kind", ["random", "hot", "pair", "same", "apart"])
@pytest.mark.parametrize("rule", [DUPLICATES, CONTRADICTIONS], ids=["duplicates", "contradictions"])
@pytest.mark.parametrize("small", [False, True])
def test_top_pairs(spark, monkeypatch, kind, rule, small):
    """``small``: lists are hot from twenty notes on, and few pairs are easy, so that tiles and batches of ties are used."""
    if small:
        monkeypatch.setattr(pairs, "HOT", 20)
        monkeypatch.setattr(pairs, "EASY", 1)
    rows = notes(kind, 150, random.Random(4))
    got = [tuple(r) for r in pairs.top_pairs(spark.createDataFrame(rows, SCHEMA).repartition(3), rule, 12).collect()]
    assert got == brute(rows, rule, 12)


def test_hot_token_makes_no_quadratic_rows(spark, monkeypatch):
    """A token in half of the notes: rows of all tables grow with the notes, not with their square."""
    made = []
    real = pairs.materialize

    def counted(df, label):
        out = real(df, label)
        made.append(out.count())
        return out

    monkeypatch.setattr(pairs, "materialize", counted)
    joined = []
    real_scored = pairs.scored
    monkeypatch.setattr(pairs, "scored", lambda found, *a: (joined.append(found.count()), real_scored(found, *a))[1])
    rng, n = random.Random(5), 4000
    rows = [(i, f"b{i % 3}", ["hot"] * (i % 2) + [f"t{rng.randrange(800)}" for _ in range(3)], []) for i in range(n)]
    got = pairs.top_pairs(spark.createDataFrame(rows, SCHEMA), DUPLICATES, 30).collect()
    assert len(got) == 30 and got[-1].score >= 6
    assert max(made) <= 30 * n and max(joined) <= 30 * n, (made, joined)


def test_no_notes(spark):
    assert pairs.top_pairs(spark.createDataFrame([], SCHEMA), DUPLICATES, 5).collect() == []
    assert pairs.top_pairs(spark.createDataFrame([(1, "b", ["x"], [])], SCHEMA), CONTRADICTIONS, 5).collect() == []
