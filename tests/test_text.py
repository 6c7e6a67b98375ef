"""Text functions and the rule engine on literal cases."""

import datetime

import pytest
from pyspark.sql import functions as F

from quillspark.functions import text as T
from quillspark.operators import rules as E
from quillspark.operators import segment as S


def one(spark, value, column):
    return spark.createDataFrame([(value,)], "t string").select(column.alias("x")).first().x


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("Rates rose. Growth fell.", ["Rates rose.", "Growth fell."]),
        ("The U.S. economy grew by 2.5 percent. It slowed.", ["The U.S. economy grew by 2.5 percent.", "It slowed."]),
        ("Mr. J. K. Mensah spoke. He left.", ["Mr. J. K. Mensah spoke.", "He left."]),
        ('He said "Yes." Then he left.', ['He said "Yes."', "Then he left."]),
        ("First point. 2. Second point", ["First point.", "Second point"]),
        ("alpha • beta • gamma", ["alpha", "beta", "gamma"]),
    ],
)
def test_sentences(spark, text, want):
    assert one(spark, text, T.sentences(F.col("t"))) == want


def test_simple_sentences(spark):
    assert one(spark, " The U.S.  grew. (It slowed.) etc. end ", T.sentences_simple(F.col("t"))) == ["The U.S. grew.", "(It slowed.) etc. end"]


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("The Committee decided to maintain the policy rate at 14 percent.", True),
        ("The Committee therefore raised the policy rate.", True),
        ("The Fed raised its policy rate by 25 basis points.", False),
        ("The policy rate is an instrument.", False),
        ("Maintain the policy rate at 16 percent.", True),
    ],
)
def test_decision(spark, text, want):
    assert one(spark, text, T.is_decision(F.col("t"))) is want


def test_dates_and_numbers(spark):
    assert one(spark, "Bank\nMonetary Policy Committee E ST. 1957 May 23, 2003 text", T.letterhead_date(F.col("t"))) == datetime.date(2003, 5, 23)
    assert one(spark, "Press Release February 31, 2003", T.letterhead_date(F.col("t"))) is None
    assert one(spark, "On the 3rd day; far away " + "x " * 60 + "the 41st meeting of the MPC", T.meeting_number(F.col("t"))) == 41
    assert one(spark, "MPC Press Release – Sept. 2019", T.title_month(F.col("t"))) == datetime.date(2019, 9, 1)
    assert one(spark, "the policy rate at 14.5 per cent, from 15%", T.rates_near_mentions(F.col("t"))) == [14.5, 15.0]
    d = one(spark, "August 29 – September 1, 2011", T.parse_dates(F.col("t")))
    assert (d.start, d.end, d.emergency) == (datetime.date(2011, 8, 29), datetime.date(2011, 9, 1), False)
    assert one(spark, "August 17, 2022 (Emergency)", T.parse_dates(F.col("t"))).emergency
    with pytest.raises(Exception, match="Cannot parse"):
        one(spark, "soon", T.parse_dates(F.col("t")))


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("Headline inflation rose to 10.4 percent in May.", 10.4),
        ("Core inflation rose to 9 percent.", None),
        ("Inflation moved towards the target of 8 percent.", None),
        ("Inflation, within the target band, eased further to 7.5 per cent.", None),
    ],
)
def test_level(spark, text, want):
    assert one(spark, text, T.level(F.col("t"))) == want


def test_doc_type_and_hint(spark):
    assert one(spark, "MPC Press Release, May 2020", T.doc_type(F.col("t"))) == "press_release"
    assert one(spark, "Notice: MPC press release", T.doc_type(F.col("t"))) == "notice"
    assert one(spark, "Global Price Developments", T.section_hint(F.col("t"))) == "global"


def test_links(spark):
    page = '<a class="x" href="/a.PDF">1</a> <iframe src=\'b.pdf?x=1\'></iframe> <a href="/c.html"></a> <object data="/a.PDF"></object>'
    assert one(spark, page, T.pdf_links(F.col("t"))) == ["/a.PDF", "b.pdf?x=1"]


RULES = [
    E.ToneRule("T1", "hawkish", r"\b(?:rose|rising)\b", r"\binflation\b", "", 12),
    E.ToneRule("T2", "dovish", r"\b(?:fell|slowed)\b", r"\binflation\b", "", 12),
    E.ToneRule("T3", "dovish", r"\b(?:fell|slowed)\b", r"\bgrowth\b", "", 6),
    E.ToneRule("T4", "hawkish", r"\bvigilant\b"),
]


@pytest.mark.parametrize(
    ("text", "label", "ids"),
    [
        ("Inflation rose in May.", "hawkish", ["T1"]),
        ("Inflation has not rose.", "neutral", []),
        ("Growth slowed while inflation rose.", "neutral", ["T1"]),
        ("The Committee stays vigilant.", "hawkish", ["T4"]),
        ("Inflation " + "and so on " * 5 + "rose.", "neutral", []),
    ],
)
def test_tone(spark, text, label, ids):
    r = E.score_tone(spark.createDataFrame([(text,)], "text string"), RULES).first()
    assert (r.tone_weak, r.hawk_rules) == (label, ids)
    assert "T2" not in r.dove_rules


def test_topics(spark):
    rules = [E.TopicRule("policy", "policy stance", 3), E.TopicRule("global", "the fed", 4), E.TopicRule("inflation", "inflation", 2), E.TopicRule("growth", "growth", 2), E.TopicRule("fiscal", "tax", 1)]
    df = spark.createDataFrame([("growth and inflation", ""), ("inflation, then the policy stance", ""), ("the fed and its policy stance", ""), ("tax", "growth"), ("none", "growth"), ("none", "decision")], "text string, section_hint string")
    got = [tuple(r) for r in E.score_topic(df, rules).select("topic_weak", "topic_source", "hint_agrees").collect()]
    assert got == [("growth", "keywords", None), ("policy", "keywords", None), ("global", "keywords", None), ("fiscal", "keywords", False), ("growth", "heading", None), ("", "none", None)]


def test_rule_tables(spark):
    kind = "rule_id string, label string, subject string, move string, require string, window int"
    assert E.tone_rules(spark.createDataFrame([("a", "hawkish", None, "UP", None, 3)], kind))[0].window == 3
    for bad in ([("a", "x", "", "UP", "", 1)], [("a", "hawkish", "", "SIDE", "", 1)], [("a", "hawkish", "", "UP", "", 1)] * 2):
        with pytest.raises(ValueError):
            E.tone_rules(spark.createDataFrame(bad, kind))


def test_statement(spark):
    text = "B O G\nPRESS RELEASE\nMonetary Policy Committee May 23, 2003\nGood morning to all of you.\nGlobal Developments\n1. Growth was strong year-on-\nyear. It held.\n• Prices rose.\nPage 2 of 3\nConclusion\nThe Committee decided to keep the policy rate."
    got = S.sentence_rows(spark.createDataFrame([(7, text)], "doc_id long, text string")).orderBy("position").collect()
    assert [(r.paragraph, r.text, r.section_heading) for r in got] == [
        (1, "Good morning to all of you.", ""),
        (2, "Growth was strong year-on-year.", "Global Developments"),
        (2, "It held.", "Global Developments"),
        (3, "Prices rose.", "Global Developments"),
        (4, "The Committee decided to keep the policy rate.", "Conclusion"),
    ]
    assert got[0].sentence_id == "7-001" and got[-1].is_decision and got[1].section_hint == "global"


def test_heading_needs_an_ended_line_before(spark):
    """A capitalised line that goes on from one without a full stop is no heading, whatever stands before that."""
    from quillspark.operators import segment as S

    lines = ["It ended.", "the rate is set by", "The Bank", "Growth was strong.", "Outlook", "Prices and Wages", "They rose."]
    rows = spark.createDataFrame([(1, i, x) for i, x in enumerate(lines)], "doc_id long, pos int, line string")
    got = S.with_headings(rows).orderBy("pos").collect()
    assert [r.is_heading for r in got] == [False, False, False, False, True, True, False]
    assert [r.heading for r in got] == [""] * 4 + ["Outlook / Prices and Wages"] * 3


def test_whole_texts(spark):
    """Beyond the first 200 code points a decision counts, no text is cut, and texts that start with no letter are there."""
    from quillspark.functions import patterns as P
    from quillspark.operators import segment as S

    long = "word " * 400
    rows = [(1, long + "The Committee decided to keep the policy rate."), (2, long), (3, "2. " + long), (4, "Press Release May 5, 2020 " + long), (5, "• " + long)]
    bare = F.regexp_replace(F.regexp_replace("text", P.NUMBERED, ""), P.BULLET, "")
    x = spark.createDataFrame(rows, "doc_id long, text string").select("doc_id", T.is_decision(F.col("text")).alias("flag"), S.strip_letterhead(F.col("text")).alias("body"), bare.alias("bare")).collect()
    assert {r.doc_id: r.flag for r in x} == {1: True, 2: False, 3: False, 4: False, 5: False}
    assert {r.doc_id: r.body for r in x} == dict(rows) | {4: " " + long}
    assert {r.doc_id: r.bare for r in x} == dict(rows) | {3: long, 5: long}
