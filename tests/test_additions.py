"""HTML references, forms of numbers, row numbers, checks, and the grid of specifications."""

import html

import pytest
from pyspark.sql import functions as F

from quillspark.functions import text as T
from quillspark.operators import evaluation as E
from quillspark.operators import probit, series


def test_html_unescape(spark):
    texts = ["a &amp; b &lt;i&gt; &#8220;x&#8221; &eacute;&Eacute; &copy 2020 &notit; &notin; &nosuch; & &; &#; &#x; &#xE9; &#128; &#0; &#xD800; &#1114112; &#7; &#13;",
             "&ampx &AMP &nbsp;&hellip;&mdash;&rsquo;s &#x1F600; &#99999999999;", "no references", "", None, "&&&amp;amp;", "&#38;lt;", "x&CounterClockwiseContourIntegral;y", "&#0000000065;"]
    x = spark.createDataFrame(list(enumerate(texts)), "id int, text string").select("id", T.html_unescape(F.col("text")).alias("t"))
    got = {r.id: r.t for r in x.collect()}
    assert got == {i: None if t is None else html.unescape(t) for i, t in enumerate(texts)}


def test_number_forms(spark):
    values = [14.5, 13.0, 0.25, 123456.0, 7.125, 0.0, 1234.5678, 0.001, 14.25, 3.15, 25.0]
    x = spark.createDataFrame([(v,) for v in values], "v double").select("v", T.number_forms(F.col("v")).alias("f"))
    for r in x.collect():
        assert list(r.f) == [f"{r.v:g}", f"{r.v:.1f}", f"{r.v:.2f}"]


def test_numbered(spark):
    x = spark.range(0, 30_000, 3).withColumnRenamed("id", "k").repartition(7)
    assert [r.at for r in E.numbered(x, "k", "at").orderBy("k").collect()] == list(range(10_000))
    assert E.numbered(x.limit(0), "k", "at").count() == 0


def test_selection_and_checks(spark):
    assert E.first_that_agrees([("q8", 0.84), ("half", 0.99), ("full", 1.0)]) == "half" and E.first_that_agrees([("q8", 0.84)]) is None
    assert E.check_labels({0: "a", 1: "b"}, ("b", "a")) == {0: "a", 1: "b"}
    for bad in ({0: "a"}, {0: "a", 1: "a"}, {1: "a", 2: "b"}):
        with pytest.raises(ValueError):
            E.check_labels(bad, ("a", "b"))
    rows = [("r", 1, 10), ("r", 2, 20), ("e", 1, 5)]
    assert series.check_rising(spark.createDataFrame(rows, "kind string, n int, v int"), "kind", "n", "v").count() == 3
    with pytest.raises(Exception, match="does not rise"):
        series.check_rising(spark.createDataFrame([*rows, ("r", 3, 20)], "kind string, n int, v int"), "kind", "n", "v").collect()


def test_spec_grid(spark):
    x = spark.range(240).selectExpr("id", "2000 + cast(id / 10 as int) as year", "cast(pmod(hash(id, 1), 3) - 1 as double) as m", "pmod(hash(id, 2), 1000) / 500.0 - 1 as tone", "if(id % 2 = 0, pmod(hash(id, 3), 100) / 10.0, null) as infl")
    x = x.withColumn("y", F.when(F.col("tone") + F.rand(1) > 0.9, 1).when(F.col("tone") + F.rand(1) < -0.1, -1).otherwise(0).cast("double")).cache()
    grid = probit.spec_grid(x, "y", ["tone"], "m", "infl")
    assert [(g["variable"], g["controls"], g["n"]) for g in grid] == [("tone", "m", 240), ("tone", "m + infl", 120)]
    assert grid[0]["p_lr"] < 0.01 and grid[0]["oos_gain"] is not None
    assert len(probit.spec_grid(x, "y", ["tone"], "m", "infl", least=200)) == 1
