"""Series, sampling, evaluation, probit, sources, streaming; and queries against their SQL."""

import datetime
import json
import threading
from collections import Counter
from http.server import BaseHTTPRequestHandler, HTTPServer

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from quillspark.operators import documents as D
from quillspark.operators import evaluation, probit, relational, series
from quillspark.operators.sampling import split_evenly, stratified_sample
from quillspark.sources import files, rest
from quillspark.streaming import events

RAW = [(1, "March 22 – 24, 2005", "29 Mar 2005", 15.5), (2, "May 23 – 25, 2005", "30 Jun 2005", 15.0), (3, "August 17, 2005 (Emergency)", "18 Aug 2005", 15.0)]


def raw(spark):
    return spark.createDataFrame(RAW, "meeting_no int, mpc_dates string, effective_raw string, mpr double")


def corrections(spark, rows):
    return spark.createDataFrame(rows, "seq int, meeting_no int, meeting_type string, field string, old_value string, new_value string")


def test_clean_series(spark):
    fix = corrections(spark, [(1, 2, "regular", "meeting_no", "2", "9"), (2, 9, "regular", "mpr", "15.0", "14.0")])
    add = spark.createDataFrame([(4, "regular", None, datetime.date(2005, 9, 1), 16.0)], "meeting_no int, meeting_type string, meeting_start date, meeting_end date, mpr double")
    got = [(r.meeting_no, r.mpr_change_bp, r.decision, r.effective_date_flag, r.corrected) for r in series.clean_series(raw(spark), fix, add).orderBy("meeting_end").collect()]
    assert got == [(1, None, None, False, False), (9, -150, "cut", True, True), (3, 100, "hike", False, False), (4, 100, "hike", False, True)]


def test_corrections_must_hit(spark):
    for row in ((1, 7, "regular", "mpr", "15.0", "14.0"), (1, 2, "regular", "mpr", "15.1", "14.0")):
        with pytest.raises(ValueError):
            series.clean_series(raw(spark), corrections(spark, [row]))
    with pytest.raises(ValueError):
        series.add_meetings(series.clean_series(raw(spark)), spark.createDataFrame([(1, "regular", None, datetime.date(2005, 9, 1), 16.0)], "meeting_no int, meeting_type string, meeting_start date, meeting_end date, mpr double"))


def test_asof_is_strict_and_bounded(spark):
    cpi = spark.createDataFrame([(datetime.date(2020, 1, 1), 7.0), (datetime.date(2020, 2, 1), 8.0)], "m date, v double")
    left = spark.createDataFrame([(1, datetime.date(2020, 2, 9)), (2, datetime.date(2020, 3, 1)), (3, datetime.date(2020, 6, 30)), (4, datetime.date(2020, 7, 1)), (5, None)], "k int, d date")
    got = {r.k: r.v for r in relational.asof_backward(left, cpi, "d", "m", "v").collect()}
    assert got == {1: 7.0, 2: 8.0, 3: 8.0, 4: None, 5: None}


def test_roles(spark):
    rows = [("10", 1, "press_release", True, "a", 1000), ("9", 1, "press_release", False, "b", 1005), ("3", 1, "highlights", True, "c", 100), ("11", 1, "press_release", None, "d", 500), ("5", 2, "highlights", True, "e", 90)]
    df = spark.createDataFrame(rows, "doc_id string, meeting_no int, doc_type string, title_ok boolean, text_hash string, n_chars int").withColumns({"meeting_type": F.lit("regular"), "role": F.lit("candidate")})
    got = {r.doc_id: (r.role, r.duplicate_of) for r in D.assign_roles(df).collect()}
    assert got == {"10": ("primary", None), "9": ("duplicate", "10"), "3": ("summary_of_primary", "10"), "11": ("conflicting_version", "10"), "5": ("primary", None)}


def test_stratified_sample(spark):
    rng = np.random.default_rng(1)
    eras = ["2002-2009", "2010-2016", "2017-2021", "2022-2026"]
    rows = [(str(i), int(rng.integers(200)), eras[i % 4], str(rng.choice(["hawkish", "neutral", "dovish"], p=[0.1, 0.7, 0.2])), str(rng.choice(["a", "b", "c"])), f"t{i % 3500}", "", "x") for i in range(4000)]
    pool = spark.createDataFrame(rows, "sentence_id string, doc_id long, era string, tone_weak string, topic_weak string, norm_text string, section_heading string, text string")
    got = stratified_sample(pool).collect()
    assert Counter((r.era, r.draw) for r in got) == {("2002-2009", "random"): 36, ("2002-2009", "stratified"): 54, ("2010-2016", "random"): 36, ("2010-2016", "stratified"): 54, ("2017-2021", "random"): 32, ("2017-2021", "stratified"): 48, ("2022-2026", "random"): 56, ("2022-2026", "stratified"): 84}
    assert len({r.norm_text for r in got}) == 400 and max(Counter(r.doc_id for r in got).values()) <= 8
    tones = Counter(r.tone_weak for r in got if r.draw == "stratified" and r.era == "2002-2009")
    assert max(tones.values()) - min(tones.values()) <= 1
    assert sorted(r.gold_id for r in got) == [f"G{i:03d}" for i in range(1, 401)] and 90 <= sum(r.split == "dev" for r in got) <= 110
    assert [r.sentence_id for r in stratified_sample(pool).orderBy("gold_id").collect()] == [r.sentence_id for r in sorted(got, key=lambda r: r.gold_id)]
    assert split_evenly(8, 3) == [3, 3, 2]


def test_scores(spark):
    df = spark.createDataFrame([("h", "h"), ("h", "n"), ("n", "n"), ("n", "n")], "t string, p string")
    r = df.agg(*evaluation.scores("t", "p", ["h", "n", "d"])).first()
    assert r.accuracy == 0.75 and abs(r.macro_f1 - (2 / 3 + 0.8 + 0) / 3) < 1e-12


@pytest.mark.parametrize("effect", [0.0, 0.9])
def test_probit(spark, effect):
    rng = np.random.default_rng(3)
    x, c = rng.normal(size=400), rng.normal(size=400)
    e = effect * x + 0.5 * c + rng.normal(size=400)
    y = np.where(e < -0.6, -1.0, np.where(e < 0.8, 0.0, 1.0))
    df = spark.createDataFrame([(float(a), float(b), float(d), 2000 + i // 16) for i, (a, b, d) in enumerate(zip(x, c, y, strict=True))], "x double, c double, y double, year int")
    r = probit.test_variable(df, "y", "x", ["c"])
    assert abs(r["coef"] - effect * x.std()) < 0.2 and abs(r["fit"].cuts[0] + 0.6) < 0.25
    assert (r["p_lr"] < 0.01 and r["oos_gain"] > 0) if effect else r["p_lr"] > 0.01
    p = probit.scenarios(r, ["c"])
    assert all(abs(sum(v) - 1) < 1e-9 for v in p.values()) and (p["+1 sd"][2] > p["-1 sd"][2] if effect else True)


def test_files(spark, tmp_path):
    df = spark.createDataFrame([(1, datetime.date(2020, 2, 29), [1.0])], "k int, d date, a array<double>")
    files.write_csv(df, f"{tmp_path}/x")
    assert [tuple(r) for r in files.read_csv(spark, f"{tmp_path}/x", "k int, d date").collect()] == [(1, datetime.date(2020, 2, 29))]
    with pytest.raises(Exception, match="exists"):
        files.write_csv(df, f"{tmp_path}/x")
    assert files.read_optional(spark, f"{tmp_path}/none", "k int") is None and files.first_existing(spark, f"{tmp_path}/none", f"{tmp_path}/x") == f"{tmp_path}/x"
    (tmp_path / "b").mkdir()
    (tmp_path / "b/a.pdf").write_bytes(b"%PDF-1.4 page")
    (tmp_path / "b/b.pdf").write_bytes(b"<html>")
    b = files.read_binaries(spark, f"{tmp_path}/b")
    assert sorted(r.is_pdf for r in b.collect()) == [False, True]
    assert {r.text for r in files.extract_texts(b, lambda c: [c[:3].decode(), "2"]).collect()} == {"%PD\n\n2", "<ht\n\n2"}
    assert json.loads(files.as_json(spark.createDataFrame([(1, float("nan"), None)], "k int, v double, s string")).first().json) == {"k": 1, "v": None, "s": None}


class Handler(BaseHTTPRequestHandler):
    def do_GET(self):
        page = int(self.path.partition("&page=")[2].partition("&")[0] or 1)
        body = json.dumps([{"id": 10 * page + i, "title": f"t{page}{i}"} for i in range(2)]).encode()
        self.send_response(200)
        self.send_header("X-WP-TotalPages", "3")
        self.end_headers()
        self.wfile.write(body)

    def log_message(self, *_):
        pass


def test_paged_feed(spark):
    server = HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    spark.dataSource.register(rest.Feed)
    got = spark.read.format("paged_feed").schema("id string, title string").option("url", f"http://127.0.0.1:{server.server_port}/posts").option("perPage", 2).option("delay", 0).load()
    assert sorted(r.id for r in got.collect()) == ["10", "11", "20", "21", "30", "31"]
    server.shutdown()


def test_fetch_retries():
    waits, tries = [], []

    def opener(url, timeout):
        tries.append(url)
        raise OSError

    assert rest.fetch("u", opener, waits.append) is None and len(tries) == 3 and waits == [2.0, 5.0] * 3


def test_stream_equals_batch(spark, tmp_path):
    spark.read.parquet("/root/testdata/sf0.001/events.parquet").write.parquet(f"{tmp_path}/in")
    schema = spark.read.parquet(f"{tmp_path}/in").schema
    events.run_available(events.windowed_counts(events.stream(spark, f"{tmp_path}/in", schema)), f"{tmp_path}/out", f"{tmp_path}/cp")
    got = spark.read.parquet(f"{tmp_path}/out")
    batch = spark.read.parquet(f"{tmp_path}/in").groupBy(F.window(F.col("ts").cast("timestamp"), "1 day"), "event_type").agg(F.count(F.lit(1)).alias("n")).select(F.col("window.start").alias("window_start"), "event_type", "n")
    assert got.count() > 0 and got.select("window_start", "event_type", "n").subtract(batch).count() == 0


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    queries, oracles = __spark_entry__.queries(), __spark_entry__.oracle_sql()
    assert len(queries) > 100 and set(oracles) <= set(queries)


@pytest.mark.parametrize("name", ["rule_fires", "topic_first", "asof_backward", "nearest_in_window", "bootstrap_ci", "clean_series", "match_cascade", "document_roles", "sentence_split", "tone_index"])
def test_query_against_sql(spark, name):
    import duckdb

    d, c = "/root/testdata/sf0.001", duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        c.execute(f"create view {t} as select * from '{d}/{t}.parquet'")
    df = __spark_entry__.queries()[name](spark, d)
    r = c.execute(__spark_entry__.oracle_sql()[name])
    names = [x[0] for x in r.description]
    assert sorted(df.columns) == sorted(names)
    flat = lambda v: float(f"{v:.9g}") if isinstance(v, float) else str(v)
    want = sorted(repr([flat(v) for v in row]) for row in r.fetchall())
    assert sorted(repr([flat(row[n]) for n in names]) for row in df.collect()) == want
