"""Queries against their SQL on rows that the given tables don't hold."""

from pyspark.sql import functions as F

import __spark_entry__
from quillspark.operators import evaluation as V
from quillspark.operators import rules as E


def differing(spark, path, name, table, rows, schema):
    """(rows that only the SQL has, rows that only the query has) over one table of the given rows."""
    import duckdb

    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{path}/{table}.parquet")
    c = duckdb.connect()
    c.execute(f"create view {table} as select * from '{path}/{table}.parquet/*.parquet'")
    r = c.execute(__spark_entry__.oracle_sql()[name])
    names = [x[0] for x in r.description]
    want = {repr(list(row)) for row in r.fetchall()}
    got = {repr([row[n] for n in names]) for row in __spark_entry__.queries()[name](spark, str(path)).collect()}
    return want - got, got - want


def test_html_unescape_open_references(spark, tmp_path):
    texts = ["token = &quot</title>", "&lt &gt;&nbsp", "&#39 &#39; &#8217", "&amp &amp; &ampx &amp;lt; &amp;quot", "&copy 2020 &copy;", None, ""]
    rows = [(i, "u", t) for i, t in enumerate(texts)]
    assert differing(spark, tmp_path, "html_unescape", "pages", rows, "page_id long, url string, html string") == (set(), set())


DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"


def texts(*found):
    return [(i, t, "en", "s", len(t or "")) for i, t in enumerate(found)]


def test_sentence_split_simple_empty_texts(spark, tmp_path):
    rows = texts("", "  ", "\n", None, "One. Two! (Three)", "Mr. A came. Then B", "?", " a")
    assert differing(spark, tmp_path, "sentence_split_simple", "documents", rows, DOCUMENTS) == (set(), set())


def test_strip_bullets_odd_openings(spark, tmp_path):
    rows = texts("", "", "", "", " a", " a", "\n a", " a", "• b", "(cid:1) b", "2. b", "- B", "xx", "x", " ", None)
    assert differing(spark, tmp_path, "strip_bullets", "documents", rows, DOCUMENTS) == (set(), set())


def test_spans_only_where_a_rule_can_fire(spark):
    rules = [E.ToneRule("a", "hawkish", "that", "tion", "", 3), E.ToneRule("b", "dovish", "que", "ment", "and", 2)]
    rows = [(1, "the nation alone"), (2, "that nation and a moment"), (3, "que moment"), (4, None)]
    x, names = E.with_spans(spark.createDataFrame(rows, "id int, text string"), rules)
    got = {r.id: [r.tion, r.ment, r.que] for r in x.select("id", *(F.size(names[f"all:{p}"]).alias(p) for p in ("tion", "ment", "que"))).collect()}
    assert got == {1: [0, 0, 0], 2: [1, 1, 0], 3: [0, 0, 0], 4: [0, 0, 0]}


def test_bootstrap_looks_draws_up_in_blocks(spark, monkeypatch):
    rows = [(i, [0, 1, None, 7][i % 4], i % 2, [1, None, 0][i % 3]) for i in range(40)]
    x = spark.createDataFrame(rows, "at long, truth int, a int, b int")
    whole = {r.metric: (r.low, r.high) for r in V.bootstrap(x, "at", "truth", ["a", "b"], [0, 1], 50).collect()}
    monkeypatch.setattr(V, "BLOCK", 7)
    parted = V.bootstrap(x, "at", "truth", ["a", "b"], [0, 1], 50)
    assert whole == {r.metric: (r.low, r.high) for r in parted.collect()} and len(whole) == 3
    assert "SortMergeJoin" not in parted._jdf.queryExecution().toString()


def test_parts_grow_with_the_table(spark):
    from quillspark.tables import dealt_by_size, table

    x = table(spark, "/root/testdata/sf0.001", "documents")
    assert dealt_by_size(x, "doc_id", 4096).rdd.getNumPartitions() > dealt_by_size(x, "doc_id").rdd.getNumPartitions() == 16


def test_exact_quantiles_of_groups(spark):
    from quillspark.operators import relational as R

    x = spark.range(30_000).selectExpr("if(id < 7, null, if(id < 8, 'one', if(id < 400, 'b', 'a'))) as g", "if(id % 11 = 0, null, pmod(hash(id), if(id % 2 = 0, 50, 100000)) / 7.0) as v")
    q = {"p0": 0.0, "mid": 0.5, "p99": 0.99, "p1": 1.0}
    got = {r.g: list(r)[1:] for r in R.exact_quantiles(x, "g", "v", q).collect()}
    want = {r.g: r.p for r in x.groupBy("g").agg(F.percentile("v", F.array(*map(F.lit, q.values()))).alias("p")).collect()}
    assert set(got) == set(want) and all(abs(a - b) < 1e-9 * max(1, b) for g in want for a, b in zip(got[g], want[g], strict=True))
