"""A note's topic is its text's first six words, whatever stands between them; the rest of the text isn't taken apart."""

import re

import pytest
from loambase.operators import hygiene
from loambase.sources import views


@pytest.fixture
def folder(spark, tmp_path):
    texts = ["", " \t\n", "one", "  a b\tc\r\nd  e f g h", "a b c d e f", "a b c d e f  ", "\n\nx" + "y" * 100_000 + " z", "a\x0bb c d e f g h", "é " * 9, None]
    for name, rows, schema in (("documents", [(i, t, "en", "s", 1) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long"), ("labels", [(1, 1, 0)], "doc_id long, quality int, toxic int"), ("embeddings", [(1, [1.0])], "vec_id long, vector array<double>")):
        spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{name}.parquet")
    return str(tmp_path), texts


def test_topic(spark, folder):
    path, texts = folder
    rows = views.notes(spark, path)
    want = [None if t is None else " ".join([w for w in re.split("[ \t\n\r]+", t) if w][:6]) for t in texts]
    assert [r.topic for r in rows.select("doc_id", "topic").orderBy("doc_id").collect()] == want
    plan = rows.select("topic")._jdf.queryExecution().optimizedPlan().toString()
    assert "split(regexp_extract(text" in plan and "split(text" not in plan


def test_decisions_read_notes_once(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(hygiene, "materialize", lambda df, label, real=hygiene.materialize: seen.append((label, real(df, label))) or seen[-1][1])
    notes = spark.createDataFrame([(i, i / 10) for i in range(9)], "id long, confidence double")
    told = spark.createDataFrame([("1", 1, 2, "merge"), ("2", 2, 3, "A"), ("3", 4, 4, "A"), ("4", 5, 6, "A")], "rank string, a long, b long, keep string")
    assert sorted(tuple(r) for r in hygiene.judged(notes, told).collect()) == [("1", 2, 1, "merge"), ("2", 2, 3, "A"), ("4", 5, 6, "A")]
    assert [sorted(r[0] for r in df.collect()) for label, df in seen if label == "confidence"] == [[1, 2, 3, 4, 5, 6]]
