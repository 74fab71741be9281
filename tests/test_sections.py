from oracle import DATA
from pyspark.sql import functions as F

from siftline.functions import sections
from siftline.plans import catalog


def test_each_heading_test_stands_once_in_the_plan(spark):
    plan = catalog.QUERIES["ad_sections"](spark, DATA)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("RLIKE") == 4, plan.count("RLIKE")  # sentence and heading, for starts and for stops


def test_pages_are_dealt_out_before_they_are_parsed(spark):
    plan = catalog.QUERIES["ad_sections"](spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert "REPARTITION_BY_NUM" in plan.split("ArrowEvalPython")[1]


def test_sections_of_odd_lists(spark):
    own = ["Requirements:", "a", "Krav", "About us", "b"]
    cases = [(own, "Requirements:\na\nKrav"), (own[3:], ""), (own[:1], "Requirements:"), (own[1:3], "Krav"), ([], ""), (None, ""), ([None, "Krav", None, "Vi erbjuder"], "Krav"), (["Not a krav", " -- KRAV: "], " -- KRAV: ")]
    rows = spark.createDataFrame([(i, c) for i, (c, _) in enumerate(cases)], "i int, lines array<string>")
    assert [r.s for r in rows.select("i", sections.section("lines").alias("s")).orderBy("i").collect()] == [want for _, want in cases]
    loose = ["^a|b", "c"]  # not tied to the start: found anywhere
    texts = spark.createDataFrame([("xb",), ("ax",), ("xa",), ("xc",)], "t string")
    assert [r.m for r in texts.select(sections.matches_any(F.col("t"), loose).alias("m")).collect()] == [True, True, False, True]
