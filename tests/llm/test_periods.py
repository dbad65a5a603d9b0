"""Repeats within a document at distances about that of a window's last gram from its first."""

import hashlib

import numpy as np

from loambase.llm import suffix


def brute_repeats(body, seen, width=100):
    gone = np.zeros(len(body), bool)
    for i in range(len(body) - width + 1):
        if body[i : i + width] in seen:
            gone[i : i + width] = True
        seen.add(body[i : i + width])
    return int(gone.sum()), hashlib.sha256(np.frombuffer(body, np.uint8)[~gone].tobytes()).hexdigest()


def test_repeats_periods(spark):
    rng, texts = np.random.default_rng(7), {}
    for period in range(74, 80):
        for length in (178, 3 * period, 4 * period, 355, 5 * period):
            line = "".join(rng.choice(list("abcdefghij"), period - 1)) + "\n"
            texts[len(texts)] = (line * 6)[:length]
            if length == 4 * period:
                texts[len(texts)] = texts[len(texts) - 1]
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(3)
    got = {r[0]: tuple(r) for r in suffix.without_repeats(docs).collect()}
    seen = set()
    for d in sorted(texts):
        n, digest = brute_repeats(texts[d].encode(), seen)
        assert (got[d][2], got[d][4]) == (n, digest), d
