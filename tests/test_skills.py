"""Skill results in rendered transcripts, against the pattern itself; a text is searched twice, however much is made of it."""

import json
import re

from loambase.operators import pages
from pyspark.sql import functions as F

PAIR = re.compile(r"\[tool_use: Skill\] ([^\n\r\u0085\u2028\u2029]+)\n\n\[tool_result: Skill\]\n([\s\S]*?)\n\[/tool_result\]")


def stripped(text):
    done = []

    def put(m):
        if len(m[2]) <= 1000:
            return m[0]
        done.append(m)
        try:
            call = json.loads(m[1])
        except ValueError:
            call = None
        names = [call[k] for k in ("skill", "command", "name") if isinstance(call, dict) and isinstance(call.get(k), str)]
        return f"[tool_use: Skill] {m[1]}\n\n[tool_result: Skill] [Skill {(names or ['skill'])[0]} loaded]"

    return PAIR.sub(put, text), len(done)


def pair(call, body, head="Skill"):
    return f"[tool_use: Skill] {call}\n\n[tool_result: {head}]\n{body}\n[/tool_result]"


def test_stripped_skills(spark):
    long = "é[tool_result: Skill]\n" + "x" * 1001
    texts = [
        "", "plain", pair('{"skill": "s"}', "y" * 1000), pair('{"skill": "s"}', "y" * 1001), pair('{"skill": 1, "command": "c"}', long) + "\n\nmid\n\n" + pair("{no", long) + pair('{"name": "n"}', "z"),
        pair("{no", long, "Skill ERROR") + pair('["skill"]', long), "[tool_use: Skill] {}\n\n[tool_result: Skill]\n" + long, pair('x [tool_result: Skill] $1 \\', "\n\n[tool_result: Skill]\n" * 60),
    ]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate([*texts, None])], "i int, t string").select("i", pages.stripped_skills(F.col("t")).alias("s"))
    got = [(r.s.text, r.s.stripped) for r in rows.orderBy("i").collect()]
    assert got == [*map(stripped, texts), (None, None)] and sum(n for _, n in got[:-1]) == 5


def test_searched_twice(spark):
    rows = spark.createDataFrame([("t",)], "t string").repartition(1).select(F.concat("t", F.lit("")).alias("a")).withColumn("s", pages.stripped_skills(F.col("a")))
    plan = rows.select(F.md5("s.text").alias("text"), "s.stripped", pages.savings(F.col("a"), F.col("s.text")).alias("t")).select("text", "stripped", "t.*")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract(") == 0 and plan.count("regexp_extract_all(") == 1 and plan.count("split(") == 1
