"""What op1's rounds look at, the hashes of shingles, and places at the ends of the number range."""

import numpy as np

from loambase.llm import lines, text

from .test_rounds import family


def test_fuzzy_lines_fetches_texts_once(spark, monkeypatch):
    """However many rounds there are: one scan for texts, and none of lines that share no bucket."""
    written, before = [], lines.materialize

    def counted(df, label):
        out = before(df, label)
        written.append((label, out.count()))
        return out

    monkeypatch.setattr(lines, "materialize", counted)
    rng = np.random.default_rng(2)
    texts = {d: "".join(c) for d, c in family(60, 344, 12, 36, lambda x: chr(0x4E00 + x % 20000)).items()}
    texts |= {1000 + d: "".join(chr(0x4E00 + int(x)) for x in rng.integers(0, 20000, 40)) for d in range(500)}
    got = lines.fuzzy_lines(spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(4)).toPandas()
    by = dict(zip(got.doc_id, got.keep_doc_id, strict=True))
    assert sum(by[d] == by[d + 1] for d in range(0, 120, 2)) >= 59 and all(by[d] == d for d in by if d >= 1000)
    held = dict(written)
    assert [label for label, _ in written].count("line_texts") == 1
    assert held["lines"] == 620 and 118 <= held["held_lines"] <= 130 and held["line_texts"] == held["held_lines"]


def test_fuzzy_lines_places(spark):
    """Of equal lines the first by doc_id, then by number, stays: ids of both signs and up to 64 bits."""
    low, high = -(1 << 63), (1 << 63) - 1
    docs = [(high, "a line of some length\nonly here, at the end"), (low, "begins here and only here\na line of some length"), (-1, "x\nthat one\nx"), (0, "that one\nx"), (high - 1, "only here, at the end")]
    got = {(r.doc_id, r.line_no): (r.keep_doc_id, r.keep_line_no, r.kept) for r in lines.fuzzy_lines(spark.createDataFrame(docs, "doc_id long, text string").repartition(3)).collect()}
    assert got == {
        (high, 0): (low, 1, False), (high, 1): (high - 1, 0, False), (low, 0): (low, 0, True), (low, 1): (low, 1, True), (-1, 0): (-1, 0, True),
        (-1, 1): (-1, 1, True), (-1, 2): (-1, 0, False), (0, 0): (-1, 1, False), (0, 1): (-1, 0, False), (high - 1, 0): (high - 1, 0, True),
    }


def test_shingle_hashes():
    """Those of each line's own runs, wherever it stands, short lines and characters beyond the basic plane included."""
    given = ["a", "1234567", "12345678", "123456789", "12345678", "😀" * 11, "x\ud800y", "é" * 30, "b"]
    hashes, first = lines.shingle_hashes(given)
    bounds = [*first, len(hashes)]
    for line, lo, hi in zip(given, bounds, bounds[1:], strict=False):
        values = text.mix(np.array([ord(c) for c in line], text.U))
        starts = np.arange(max(1, len(line) - lines.SHINGLE + 1))
        want = text.span_hash(text.prefix_hash_of(values), starts, np.minimum(starts + lines.SHINGLE, len(line)))
        assert (hashes[lo:hi] == want).all()
    whole, parts = lines.signatures(given * 9000), lines.signatures(given)
    assert all((w.reshape(9000, *p.shape) == p).all() for w, p in zip(whole, parts, strict=True))
