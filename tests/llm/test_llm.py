"""Operators against brute force and on awkward rows."""

import base64
import gzip
import hashlib
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

pytest.importorskip("loambase.llm.registry")

from pyspark.sql import functions as F  # noqa: E402

from loambase.llm import decontaminate, exact, graph, lines, mixing, neardup, registry, sharding, store, suffix, tokens, toxicity, warc  # noqa: E402

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def table(spark, name, sf=SF):
    return spark.read.parquet(f"{sf}/{name}.parquet")


@pytest.fixture(scope="module")
def texts(spark):
    return dict(table(spark, "documents").select("doc_id", "text").toPandas().itertuples(index=False))


AWKWARD = [
    (1, None, None, None),
    (2, "", "en", "a"),
    (3, "same words here and there again and again", "en", "a"),
    (4, "same words here and there again and again", "en", "a"),
    (4, "same words here and there again and again", "en", "a"),
    (5, "\x85  \t\r\n", "fr", "b"),
    (6, "x" * 300_000, "en", "a"),
    (7, "ab " * 60_000, "de", "c"),
    (8, "One", None, "b"),
    (9, "\U0001f600 éÀ \x00 z", "fr", None),
    (None, "no id", "en", "a"),
]


@pytest.fixture(scope="module")
def awkward(spark):
    """Nulls, empty and long texts, ties, repeated rows, and columns whose names clash with ours."""
    docs = spark.createDataFrame(AWKWARD, "doc_id long, text string, lang string, source string")
    return docs.withColumn("n_chars", F.length("text")).withColumn("size", F.lit("x")).withColumn("key", F.lit(1)).withColumn("doc", F.lit(2)).withColumn("score", F.lit(0.1)).withColumn("kept", F.lit(True))


def find(parent, x):
    while parent.setdefault(x, x) != x:
        parent[x] = parent[parent[x]]
        x = parent[x]
    return x


def grouped(nodes, links):
    parent = {}
    for a, b in links:
        a, b = find(parent, a), find(parent, b)
        parent[max(a, b)] = min(a, b)
    return {n: find(parent, n) for n in nodes}


def pairs_over(sets, percent=80):
    """All pairs of equal or similar sets, by an index of elements."""
    by, out = defaultdict(list), set()
    for n, s in sets.items():
        for x in s:
            by[x].append(n)
    counts = Counter()
    for ns in by.values():
        for i, a in enumerate(ns):
            for b in ns[i + 1 :]:
                counts[min(a, b), max(a, b)] += 1
    for (a, b), k in counts.items():
        if 100 * k >= percent * (len(sets[a]) + len(sets[b]) - k):
            out.add((a, b))
    return out


def test_components(spark):
    rng = np.random.default_rng(5)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 400, (300, 2))] + [(1000 + i, 1001 + i) for i in range(60)] + [(7, 7)]
    got = dict(graph.components(spark.createDataFrame(edges, "a long, b long")).toPandas().itertuples(index=False))
    want = grouped({x for e in edges if e[0] != e[1] for x in e}, edges)
    assert got == want
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0


def line_sets(texts):
    return {(d, n): lines.shingles(x) for d, t in texts.items() for n, x in enumerate(lines.lines_of(t)) if x and not x.isspace()}


def test_fuzzy_lines(spark, texts):
    sets = line_sets(texts)
    want = grouped(sets, pairs_over(sets))
    got = lines.fuzzy_lines(table(spark, "documents")).toPandas()
    assert len(got) == sum(len(lines.lines_of(t)) for t in texts.values())
    wrong = [r for r in got.itertuples(index=False) if (r.keep_doc_id, r.keep_line_no) != want.get((r.doc_id, r.line_no), (r.doc_id, r.line_no))]
    assert len(wrong) <= 0.001 * len(got)
    assert (got.kept == ((got.doc_id == got.keep_doc_id) & (got.line_no == got.keep_line_no))).all()


def test_fuzzy_lines_awkward(spark, awkward):
    decisions = lines.fuzzy_lines(awkward)
    got = {(r.doc_id, r.line_no): r for r in decisions.collect()}
    assert got[4, 0].keep_doc_id == 3 and not got[4, 0].kept and got[2, 0].kept and got[1, 0].kept
    back = {r.doc_id: r.text for r in lines.cleaned(awkward, decisions).collect()}
    assert back[4] == "" and back[3].startswith("same") and back[1] == ""
    assert lines.fuzzy_lines(awkward.limit(0)).count() == 0


PAGES = [(1, "http://a", "<p>é</p>" * 9000), (2, "http://b", None), (3, None, ""), (4, "http://c d\r\n", "<p>é</p>" * 9000), (4, "http://c", "WARC/1.1\r\nContent-Length: 5\r\n\r\nab\r\n\r\n"), (None, "u", "z"), (7, "u", "z"), (7, "u", "z")]


def expected_records(rows):
    by = defaultdict(list)
    for page, _, html in rows:
        by[(html or "").encode()].append(page)
    out = []
    for body, pages in by.items():
        best = max(pages, key=lambda p: (p is not None, p or 0))
        digest = base64.b32encode(hashlib.sha1(body).digest()).decode()
        pages = sorted(pages, key=lambda p: p != best)
        out += [(p, len(body), digest, "revisit" if i else "response", best if i else None) for i, p in enumerate(pages)]
    return sorted(out, key=str)


def test_warc(spark):
    for rows in (PAGES, [tuple(r) for r in table(spark, "pages").collect()]):
        got = warc.round_trip(spark.createDataFrame(rows, "page_id long, url string, html string"), segment_bytes=5000)
        got = [tuple(r) for r in got.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()]
        assert sorted(got, key=str) == expected_records(rows)
    assert warc.round_trip(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_warc_incomplete(spark, tmp_path):
    block = b"HTTP/1.1 200 OK\r\nTransfer-Encoding: chunked\r\n\r\n" + warc.chunked(b"a" * 100)
    made = [warc.record([("WARC-Type", "response"), ("WARC-Record-ID", "<x>"), ("X-Page-ID", 1), ("WARC-Segment-Number", 1)], block[:60]), warc.record([("WARC-Type", "continuation"), ("WARC-Segment-Origin-ID", "<x>"), ("WARC-Segment-Number", 3), ("WARC-Segment-Total-Length", len(block))], block[90:])]
    middle = warc.record([("WARC-Type", "continuation"), ("WARC-Segment-Origin-ID", "<x>"), ("WARC-Segment-Number", 2)], block[60:90])
    (tmp_path / "a.warc").write_bytes(b"\r\n\r\n".join([*made[::-1], b""]))
    assert warc.read_archives(spark, str(tmp_path)).first().payload is None
    (tmp_path / "b.warc").write_bytes(middle + b"\r\n\r\n")
    assert bytes(warc.read_archives(spark, str(tmp_path)).first().payload) == b"a" * 100
    assert warc.dechunked(b"3;x=y\r\nabc\r\n0\r\nT: v\r\n\r\n") == b"abc"
    # A copy of a segment that is cut off doesn't spoil the whole one.
    (tmp_path / "c.warc").write_bytes(middle[:-5])
    assert bytes(warc.read_archives(spark, str(tmp_path)).first().payload) == b"a" * 100


def test_warc_members_and_bytes(spark, tmp_path):
    page = lambda n: warc.record([("WARC-Type", "response"), ("WARC-Record-ID", f"<{n}>"), ("X-Page-ID", n)], b"HTTP/1.1 200 OK\r\n\r\n" + b"WARC/1.1\r\n" * n) + b"\r\n\r\n"
    (tmp_path / "in").mkdir()
    # A member for each record; the last record is cut off.
    (tmp_path / "in" / "a.warc.gz").write_bytes(b"".join(gzip.compress(page(n)) for n in range(5)) + gzip.compress(page(9)[:-20]))
    got = {r.page_id: None if r.payload is None else bytes(r.payload) for r in warc.read_archives(spark, str(tmp_path / "in")).collect()}
    assert got == {n: b"WARC/1.1\r\n" * n for n in range(5)} | {9: None}
    # A gzip stream that is cut off: what comes before it counts.
    (tmp_path / "cut").mkdir()
    whole = gzip.compress(page(1)) + gzip.compress(page(2))
    (tmp_path / "cut" / "a.warc.gz").write_bytes(whole[:-6])
    (tmp_path / "cut" / "b.warc.gz").write_bytes(gzip.compress(page(3)) + gzip.compress(page(4))[:14])
    got = {r.page_id: r.payload is not None for r in warc.read_archives(spark, str(tmp_path / "cut")).collect()}
    assert got[1] and got[3] and not got.get(4)
    # One page of 3 MB among small ones: files stay within their bytes.
    rows = [(n, f"http://x/{n}", f"{n}" * 10) for n in range(50)] + [(77, "http://x/77", "".join(map(str, range(500_000))))]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1)
    warc.write_archives(pages, str(tmp_path / "out"), segment_bytes=16384, file_bytes=1 << 19)
    sizes = [len(gzip.decompress(f.read_bytes())) for f in (tmp_path / "out").glob("*.gz")]
    assert sum(sizes) > 2_800_000 and max(sizes) <= 1 << 19
    read = warc.resolved(warc.read_archives(spark, str(tmp_path / "out")))
    assert {(r.page_id, r.payload_bytes) for r in read.collect()} == {(n, len(html)) for n, _, html in rows}


def test_token_rollup(spark):
    docs, labels = table(spark, "documents"), table(spark, "labels")
    got = {tuple(r[:3]): tuple(r[3:]) for r in tokens.maintained(docs, labels, store.scratch_path(spark, "t")).collect()}
    rows, marks = docs.collect(), {r.doc_id: r for r in labels.collect()}
    encode = {n: tokens._encoding(open(f"{tokens.TOKENIZERS}/{n}.tiktoken", "rb").read()).encode_ordinary for n in ("byte_bpe_50k", "byte_bpe_multi_50k")}
    want = defaultdict(lambda: [0, 0, 0])
    for r in rows:
        mark = marks.get(r.doc_id)
        if mark and mark.quality == 0:
            continue
        name = "byte_bpe_multi_50k" if mark and mark.toxic else "byte_bpe_50k"
        for i, v in enumerate((1, len(encode[name](r.text)), len(r.text.encode()))):
            want[r.source, r.lang, name][i] += v
    assert got == {k: tuple(v) for k, v in want.items()}


def test_token_rollup_batches(spark, awkward):
    rollup = tokens.Rollup(spark, store.scratch_path(spark, "t"))
    assert rollup.totals().count() == 0
    assert rollup.commit("1", tokens.counted(awkward, "byte_bpe_50k"))
    before = sorted(map(tuple, rollup.totals().collect()), key=str)
    assert not rollup.commit("1", tokens.counted(awkward, "byte_bpe_50k"))
    assert sorted(map(tuple, rollup.totals().collect()), key=str) == before
    every = spark.createDataFrame([(r[0],) for r in AWKWARD] + [(99,)], "doc_id long")
    assert rollup.commit("2", rollup.removal(every)) and rollup.totals().count() == 0


def test_token_rollup_writers(spark):
    """Two writers that delete the same document, a batch that two writers give at once, and a compaction between."""
    root = store.scratch_path(spark, "t")
    rows = lambda *ids: spark.createDataFrame([(i, "a", "en", "t", 1, 10 * i, i) for i in ids], tokens.LEDGER)
    one, two = tokens.Rollup(spark, root), tokens.Rollup(spark, root)
    assert one.commit("1", rows(1, 2, 3, 4))
    ids = lambda *xs: spark.createDataFrame([(x,) for x in xs], "doc_id long")
    tries = []

    def late(state):
        tries.append(state.version)
        if len(tries) == 1:
            assert two.commit("2", two.removal(ids(1, 2)))
        return state.removal(ids(2, 3))

    assert one.commit("3", late) and tries == [1, 2]
    assert [tuple(r) for r in one.totals().collect()] == [("a", "en", "t", 1, 40, 4)]

    def same(state):
        assert two.commit("4", rows(5))
        return rows(5)

    assert not one.commit("4", same)
    one.compact()
    assert len(one.state().parts) == 1 and one.committed() == ["1", "2", "3", "4"]
    assert not two.commit("3", rows(9)) and two.commit("5", two.removal(ids(4)))
    assert [tuple(r) for r in two.current().collect()] == [(5, "a", "en", "t", 1, 50, 5)]
    # An attempt without an entry doesn't count.
    two._written(rows(6))
    assert [tuple(r) for r in two.totals().collect()] == [("a", "en", "t", 1, 50, 5)]


def brute_segments(scores):
    """Maximal segments by their definition: the best one, then left and right of it."""
    if not len(scores):
        return []
    total = np.concatenate([[0.0], np.cumsum(scores)])
    s, e = max(((i, j) for i in range(len(scores)) for j in range(i + 1, len(scores) + 1)), key=lambda x: (round(total[x[1]] - total[x[0]], 9), x[0] - x[1]))
    if total[e] - total[s] <= 0:
        return []
    return brute_segments(scores[:s]) + [(round(total[e] - total[s], 6), s, e)] + [(x, a + e, b + e) for x, a, b in brute_segments(scores[e:])]


def test_segments():
    rng = np.random.default_rng(1)
    for n in [0, 1, 5, 20, 40]:
        for _ in range(20):
            scores = rng.normal(-0.3, 1, n).round(3)
            assert [(round(x, 6), a, b) for x, a, b in toxicity.segments(scores)] == brute_segments(scores)


def test_toxicity(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = table(spark, "documents", sf), table(spark, "labels", sf)
    model = toxicity.train(docs, labels)
    got = toxicity.score(docs, model).withColumn("held_out", toxicity.held_out(F.col("doc_id"))).join(labels, "doc_id").filter("held_out").toPandas()
    rank = got.score.rank()
    n1, n0 = int(got.toxic.sum()), int((got.toxic == 0).sum())
    auc = (rank[got.toxic == 1].sum() - n1 * (n1 + 1) / 2) / (n1 * n0)
    assert auc > 0.95
    assert (got.predicted == got.toxic).mean() > 0.96
    text = next(r for r in got.itertuples() if len(r.passages))
    assert all(p["e_value"] < 1 and p["start"] < p["end"] for p in text.passages)


def test_toxicity_awkward(spark, awkward):
    labels = spark.createDataFrame([(3, 1, 0), (4, 1, 1), (4, 0, 0), (None, 1, 1)], "doc_id long, quality int, toxic int")
    model = toxicity.train(awkward, labels)
    got = toxicity.score(awkward, model).toPandas()
    assert len(got) == len(AWKWARD) and got.score.between(0, 1).all() and got.score.notna().all()
    assert toxicity.clean(awkward, model).columns == awkward.columns
    empty = toxicity.train(awkward.limit(0), labels)
    assert toxicity.score(awkward, empty).filter("score > 0.01").count() == 0


def shingle_sets(texts, k):
    out = {}
    for d, t in texts.items():
        w = WORD.findall("".join(c.lower() if c < "\x80" else c for c in t or ""))
        out[d] = {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()
    return out


@pytest.mark.parametrize("k", [2, 5])
def test_near_duplicates(spark, texts, k):
    sets = shingle_sets(texts, k)
    want = grouped(sets, pairs_over(sets))
    got = neardup.near_duplicates(table(spark, "documents"), words=k).toPandas()
    assert dict(zip(got.doc_id, got.component_id, strict=True)) == want
    assert dict(zip(got.doc_id, got.n_shingles, strict=True)) == {d: len(s) for d, s in sets.items()}


def test_near_duplicates_awkward(spark, awkward):
    got = neardup.near_duplicates(awkward).toPandas()
    assert sorted(got.doc_id) == sorted(r[0] for r in AWKWARD if r[0] is not None)
    by = dict(zip(got.doc_id, got.component_id, strict=True))
    assert by == {1: 1, 2: 2, 3: 3, 4: 3, 5: 5, 6: 6, 7: 7, 8: 8, 9: 9}
    assert neardup.near_duplicates(awkward.limit(0)).count() == 0


def test_mixing(spark, awkward):
    for docs in (table(spark, "documents"), awkward):
        rows = docs.collect()
        got = mixing.mix(docs, run_rows=7).toPandas()
        assert len(got) == len(rows)
        sizes = Counter()
        for r in rows:
            sizes[r.source] += len(WORD.findall(r.text or ""))
        order = sorted(sizes, key=lambda s: (s is None, s or ""))
        weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
        left, target, open_ = 1.5 * sum(sizes.values()), {}, set(order)
        while open_:
            level = left / sum(weight[s] for s in open_)
            stop = {s for s in open_ if level * weight[s] >= 2 * sizes[s]}
            if not stop:
                target |= {s: level * weight[s] for s in open_}
                break
            target |= {s: 2.0 * sizes[s] for s in stop}
            left -= sum(2.0 * sizes[s] for s in stop)
            open_ -= stop
        for s in order:
            part = got[got.source.isna()] if s is None else got[got.source == s]
            assert abs(part.target - target[s]).max() < 1e-6 and part.source_size.eq(sizes[s]).all()
            assert abs(part.taken.sum() - target[s]) <= 1
        assert (got.taken <= 2 * got["size"]).all()
    assert mixing.mix(docs.limit(0)).count() == 0
    mixed = mixing.materialised(awkward)
    assert mixed.columns == awkward.columns


def brute_repeats(texts, width=100):
    seen, out = set(), {}
    for d in sorted(texts, key=lambda x: -(1 << 63) if x is None else x):
        body = (texts[d] or "").encode()
        gone = np.zeros(len(body), bool)
        for i in range(len(body) - width + 1):
            w = body[i : i + width]
            if w in seen:
                gone[i : i + width] = True
            seen.add(w)
        spans = int((gone[1:] & ~gone[:-1]).sum() + gone[:1].sum())
        out[d] = (len(body), int(gone.sum()), spans, hashlib.sha256(np.frombuffer(body, np.uint8)[~gone].tobytes()).hexdigest())
    return out


@pytest.mark.parametrize("most", [suffix.MOST_RANGES, 1])
def test_repeats(spark, texts, most):
    got = {r.doc_id: tuple(r)[1:] for r in suffix.without_repeats(table(spark, "documents"), most).collect()}
    assert got == brute_repeats(texts)


def test_repeats_random(spark):
    rng = np.random.default_rng(3)
    base = ["".join(rng.choice(list("abcé \n"), 400)) for _ in range(6)]
    texts = {i: "".join(base[j][rng.integers(0, 200) : rng.integers(200, 400)] for j in rng.integers(0, 6, 4)) for i in range(60)}
    texts |= {100: "ab" * 300, 101: "a" * 700, 102: "b" + "a" * 99, 103: "a" * 99, 104: "ab" * 40, 105: None}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(5)
    for most in (suffix.MOST_RANGES, 2):
        assert {r.doc_id: tuple(r)[1:] for r in suffix.without_repeats(docs, most).collect()} == brute_repeats(texts)


def test_two_stage_order():
    rng = np.random.default_rng(2)
    for letters in (1, 2, 3, 200):
        windows = rng.integers(1, 60, 30)
        sizes = windows + suffix.WINDOW - 1
        data = rng.integers(0, letters, sizes.sum()).astype(np.uint8)
        starts = np.cumsum(sizes) - sizes
        order = suffix.two_stage_order(data, starts, windows)
        keys = [data[i : i + suffix.WINDOW].tobytes() for i in order]
        assert sorted(order) == sorted(int(s + i) for s, n in zip(starts, windows, strict=True) for i in range(n))
        assert keys == sorted(keys)
        assert suffix.common_prefixes(data, order).tolist() == [a == b for a, b in zip(keys, keys[1:], strict=False)]


def test_repeats_awkward(spark, awkward):
    got = suffix.without_repeats(awkward).toPandas()
    assert len(got) == len(AWKWARD)
    by = {d: r for d, r in zip(got.doc_id, got.itertuples(index=False), strict=True)}
    assert by[6].n_removed == 299_999 and by[7].n_removed == 179_997 and by[1].n_bytes == 0
    assert suffix.without_repeats(awkward.limit(0)).count() == 0


def test_decontamination(spark):
    docs, bench = table(spark, "documents"), table(spark, "benchmark")
    norm = lambda t: re.findall(r"[0-9a-z\x80-\U0010ffff]+", (t or "").lower())
    items = {r.item_id: norm(r.text) for r in bench.collect()}
    want = {}
    for r in docs.collect():
        w = norm(r.text)
        for i, q in items.items():
            bag = Counter(tuple(q[j : j + 5]) for j in range(len(q) - 4))
            for s in range(max(1, len(w) - len(q) + 1)):
                part = w[s : s + len(q)]
                have = Counter(tuple(part[j : j + 5]) for j in range(len(part) - 4))
                k = sum((have & bag).values()) / sum(bag.values())
                if k >= 0.8 and k > want.get((r.doc_id, i), 0):
                    want[r.doc_id, i] = k
    got = {(r.doc_id, r.item_id): r.similarity for r in decontaminate.matches(docs, bench, block_items=7).collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-6 for k in want)


def test_decontamination_awkward(spark, awkward):
    bench = spark.createDataFrame([(1, "SAME words, here and there!"), (2, None), (3, ""), (4, "one"), (4, "one"), (None, "One")], "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontaminate.matches(awkward, bench).collect()}
    assert got == {(3, 1), (4, 1), (8, 4)}
    kept = decontaminate.decontaminated(awkward, bench)
    assert kept.columns == awkward.columns and {r.doc_id for r in kept.collect()} == {1, 2, 5, 6, 7, 9, None}
    assert decontaminate.matches(awkward, bench.limit(0)).count() == 0


def test_exact(spark, awkward):
    rows = AWKWARD + [(20, "same\twords here and there again and again  ", "en", "a"), (21, "x" * 300_000 + " ", "en", "a")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").withColumn("recipe", F.lit(1))
    by = defaultdict(list)
    for d, t, *_ in rows:
        by[re.sub(r"[\x20\x09-\x0D]+", "", t or "")].append((-len(t or ""), d is not None, d or 0, d))
    want = sorted(((m[3], min(g)[3], len(g), i == 0, hashlib.sha256(n.encode()).hexdigest()) for n, g in by.items() for i, m in enumerate(sorted(g))), key=str)
    for by_text in (False, True):
        groups = exact.recipes(docs, by_text).groupBy("recipe").count().collect()
        assert sorted(r["count"] for r in groups) == sorted(map(len, by.values()))
    assert sorted(map(tuple, exact.exact_duplicates(docs).collect()), key=str) == want
    assert exact.exact_duplicates(docs.limit(0)).count() == 0
    few = spark.createDataFrame([(1, "ab c"), (1, "ab c"), (1, "abc"), (2, "abc")], "doc_id long, text string")
    assert sorted(r.kept for r in exact.exact_duplicates(few).collect()) == [False, False, False, True]


def test_exact_clash(spark, monkeypatch):
    """A digest that stands for several chunks parts no equal texts and joins no others."""
    rows = [(1, "abc"), (2, "abd"), (3, "ab d"), (4, "xyz"), (5, "x yz")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    weak = lambda docs: docs.filter("text like 'ab%'").select(F.unhex(F.sha2(exact.normalised(F.col("text")), 256)).alias("digest")).distinct()
    monkeypatch.setattr(exact, "clashing", weak)
    got = {r.doc_id: (r.keep_id, r.group_size) for r in exact.exact_duplicates(docs).collect()}
    assert got == {1: (1, 1), 2: (3, 2), 3: (3, 2), 4: (5, 2), 5: (5, 2)}


def test_chunks_without_punctuation():
    """Two texts that differ at their start have most chunks in common, whatever their script."""
    duckless = re.compile(exact._CHUNK.replace("\\p{P}", "!-/:-@"))
    rng = np.random.default_rng(1)
    for letters in ("abcdefghijklmnopqrstuvwxyz", "的一是不了在人天地水火山石田土", "のはをにがでとさしすせそ"):
        body = "".join(rng.choice(list(letters), 60_000))
        one, two = set(duckless.findall(body)), set(duckless.findall("!?" + body[7:]))
        assert len(one & two) > 0.7 * len(one)


def test_sharding(spark, awkward):
    for docs in (table(spark, "documents"), awkward):
        n = docs.count()
        got = sharding.shard(docs, block_rows=11).toPandas()
        assert len(got) == n
        counts = got.groupby("shard")["slot"].agg(["count", "min", "max", "nunique"])
        assert counts["count"].sum() == n and counts["count"].max() - (counts["count"].min() if len(counts) == 8 else 0) <= 1
        assert (counts["nunique"] == counts["count"]).all() and (counts["max"] + 1 == counts["count"]).all() and (counts["min"] == 0).all()
        assert got.sort_values(list(got.columns)).equals(sharding.shard(docs, block_rows=11).toPandas().sort_values(list(got.columns)).set_axis(got.sort_values(list(got.columns)).index))
        placed = sharding.placed(docs)
        assert placed.count() == n and placed.columns == [*docs.columns, "shard", "slot"] and placed.select("shard", "slot").distinct().count() == n
    assert sharding.shard(awkward.limit(0)).count() == 0


def test_hypergeometric():
    rng = np.random.default_rng(0)
    drawn = np.array([sharding.hypergeometric(rng, 30, 70, 20) for _ in range(20000)])
    assert abs(drawn.mean() - 6) < 0.05 and abs(drawn.var() - 20 * 0.3 * 0.7 * 80 / 99) < 0.15
    assert sharding.hypergeometric(rng, 5, 0, 3) == 3 and sharding.hypergeometric(rng, 0, 9, 3) == 0
    big = sharding.hypergeometric(rng, 4 * 10**9, 28 * 10**9, 20000)
    assert 2000 < big < 3000
    m = sharding.matrix(np.array([5, 0, 17, 3]), 4, 1)
    assert m.sum(axis=1).tolist() == [5, 0, 17, 3] and np.ptp(m.sum(axis=0)) <= 1


def test_registry(spark):
    assert [re.match(r"op(\d+)_", k)[1] for k in registry.QUERIES] == [str(i) for i in range(1, 14)]
    assert set(registry.ORACLES) <= set(registry.QUERIES)


def test_pipeline(spark, tmp_path):
    pipeline = pytest.importorskip("corpus_pipeline")
    docs = table(spark, "documents")
    kept = pipeline.drop_near_duplicates(spark, docs, SF)
    sets = shingle_sets(dict(docs.select("doc_id", "text").toPandas().itertuples(index=False)), 5)
    want = grouped(sets, pairs_over(sets))
    assert {r.doc_id for r in kept.collect()} == {d for d, c in want.items() if d == c}
    out = pipeline.run(spark, SF)
    assert out.columns == [*docs.columns, "shard", "slot"] and out.count() > 0
    leaks = {r.doc_id for r in decontaminate.matches(docs, table(spark, "benchmark")).collect()}
    assert not leaks & {r.doc_id for r in out.collect()}
