"""Queries of the rule engine over the sentences of documents, with a small lexicon of the test texts' own syllables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import patterns as P
from ..functions import text as T
from ..operators import rules as E
from ..operators import segment as S
from ..tables import dealt, table
from .base import query
from .texts import SENTENCE_SQL

TONE = [
    E.ToneRule("A1", "hawkish", "that", "tion", "", 3),
    E.ToneRule("A2", "dovish", "que", "ment", "", 2),
    E.ToneRule("A3", "hawkish", "ingst"),
    E.ToneRule("A4", "dovish", "onth", "tion", "and", 5),
]
TOPIC = [E.TopicRule("policy", "bleer", 3), E.TopicRule("global", "thsh", 4), E.TopicRule("growth", "tion", 2), E.TopicRule("inflation", "ment", 2), E.TopicRule("fiscal", "ando", 1), E.TopicRule("external", "que", 2), E.TopicRule("growth", "ti", 1)]


def sentences(spark: SparkSession, d: str) -> DataFrame:
    hint = F.when(F.col("doc_id") % 5 == 0, "inflation").when(F.col("doc_id") % 5 == 1, "growth").when(F.col("doc_id") % 5 == 2, "admin").otherwise("")
    return S.plain_sentences(dealt(table(spark, d, "documents"), "doc_id")).withColumn("section_hint", hint)


KEYED = f"(select s.*, printf('%s-%03d', cast(doc_id as varchar), position) as sentence_id, case doc_id % 5 when 0 then 'inflation' when 1 then 'growth' when 2 then 'admin' else '' end as hint from ({SENTENCE_SQL}) s)"


def _spans(p: str) -> str:
    m, g = f"regexp_extract_all(text, '(?i){p}')", f"string_split_regex(text, '(?i){p}')"
    start = f"cast(list_sum(list_transform({g}[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform({m}[1:i - 1], lambda x: length(x))), 0) as int)"
    return f"list_transform(range(1, len({m}) + 1), lambda i: {{'s': {start}, 'e': {start} + length({m}[i])}})"


def _negated(s: str) -> str:
    """Whether one of the last three words before place `s` is a negator: words are read from the place backwards."""
    w, other = r"[\p{L}\p{N}_]", r"[^\p{L}\p{N}_]"
    last = f"regexp_extract_all(regexp_extract(reverse(lower(left(text, {s}))), '^{other}*{w}+({other}+{w}+){{0,2}}'), '{w}+')"
    return f"len(list_intersect({last}, ['" + "', '".join(x[::-1] for x in P.NEGATORS) + "'])) > 0"


N_WORDS = r"len(list_filter(string_split_regex({x}, '\s+'), lambda w: w <> ''))"
BETWEEN = "(case when {b}.s >= {a}.e then " + N_WORDS.format(x="substring(text, {a}.e + 1, {b}.s - {a}.e)") + " when {a}.s >= {b}.e then " + N_WORDS.format(x="substring(text, {b}.e + 1, {a}.s - {b}.e)") + " else 0 end)"
PATTERNS = ("that", "que", "ingst", "onth", "tion", "ment")
#: Gaps and hits of each pattern as rows; places and word numbers are running sums over them.
PIECES = "(" + " union all ".join(
    f"select sentence_id, text, '{p}' as pat, unnest(range(1, len(h) + 1)) as i, g[i] as gap, h[i] as hit, coalesce(nullif(g[i + 1], ''), h[i + 1], '') as nxt from "
    f"(select sentence_id, text, string_split_regex(text, '(?i){p}') as g, regexp_extract_all(text, '(?i){p}') as h from {KEYED} where regexp_matches(text, '(?i){p}'))" for p in PATTERNS
) + ")"
BEGINS, ENDS = r"regexp_matches({x}, '^\S')", r"regexp_matches({x}, '\S\z')"
BEFORE_HIT = "coalesce(nullif(gap, ''), before)"
COUNTED = f"""(select *, {N_WORDS.format(x='gap')} - (coalesce({ENDS.format(x='before')}, false) and {BEGINS.format(x='gap')})::int as gw,
{N_WORDS.format(x='hit')} - (coalesce({ENDS.format(x=BEFORE_HIT)}, false) and {BEGINS.format(x='hit')})::int as hw
from (select *, lag(hit) over (partition by sentence_id, pat order by i) as before from {PIECES})
)"""
PLACED = f"""(select sentence_id, text, pat, length(hit) as n, sum(length(gap) + length(hit)) over w as e, sum(gw + hw) over w as we,
hw, ({ENDS.format(x='hit')} and {BEGINS.format(x='nxt')})::int as goes_on from {COUNTED} window w as (partition by sentence_id, pat order by i))"""
SPANS = f"""(select sentence_id, pat, cast(e - n as int) as s, cast(e as int) as e, we - hw as ws, we - goes_on as we,
pat in ('that', 'que', 'ingst', 'onth') and {_negated('cast(e - n as int)')} as negated from {PLACED})"""


def _apart(a: str, b: str) -> str:
    return f"(case when {b}.s > {a}.e then {b}.ws - {a}.we when {a}.s > {b}.e then {a}.ws - {b}.we else 0 end)"


def _fires(rule: str, move: str, subject: str, other: str, window: int) -> str:
    if not subject:
        return f"select distinct sentence_id, '{rule}' as rule from sp where pat = '{move}' and not negated"
    return f"""select distinct s.sentence_id, '{rule}' as rule from sp s join sp m on m.sentence_id = s.sentence_id and s.pat = '{subject}' and m.pat = '{move}' and not m.negated and {_apart('s', 'm')} <= {window}
where not exists (select 1 from sp o where o.sentence_id = s.sentence_id and o.pat = '{other}' and not (o.s < s.e and s.s < o.e) and {_apart('o', 'm')} < {_apart('s', 'm')})"""


FIRED = f"""(with sp as materialized (select * from {SPANS}),
hits as ({_fires('a1', 'that', 'tion', 'ment', 3)} union all {_fires('a2', 'que', 'ment', 'tion', 2)} union all {_fires('a3', 'ingst', '', '', 0)} union all {_fires('a4', 'onth', 'tion', 'ment', 5)}),
f as (select sentence_id, list(rule) as rules from hits group by 1)
select k.*, coalesce(list_contains(rules, 'a1'), false) as a1, coalesce(list_contains(rules, 'a2'), false) as a2, coalesce(list_contains(rules, 'a3'), false) as a3,
coalesce(list_contains(rules, 'a4'), false) and regexp_matches(text, '(?i)and') as a4 from {KEYED} k left join f using (sentence_id))"""
SCORED = f"(select *, a1::int + a3::int - a2::int - a4::int as tone_score from {FIRED})"
LABELLABLE = r"not (regexp_matches(text, '^\p{Ll}') or len(list_filter(string_split_regex(text, '\s+'), lambda w: w <> '')) < 5 or len(list_filter(string_split_regex(text, '\s+'), lambda w: w <> '')) > 80 or hint = 'admin')"
TONE_OF = "case when tone_score > 0 then 'hawkish' when tone_score < 0 then 'dovish' else 'neutral' end"


@query(f"select sentence_id, {_spans('tion')} as spans from {KEYED} where regexp_matches(text, '(?i)tion')")
def match_spans(spark, d):
    x = sentences(spark, d).where(F.col("text").rlike("(?iU)tion"))
    return x.select("sentence_id", T.spans(F.col("text"), "(?iU)tion").alias("spans"))


@query(f"select sentence_id, list_transform({_spans('de')}, lambda m: {_negated('m.s')}) as negated from {KEYED} where regexp_matches(text, '(?i)de')")
def negation(spark, d):
    x = sentences(spark, d).where(F.col("text").rlike("(?iU)de"))
    x = E.materialise(x, {"found": T.gaps_and_hits(F.col("text"), "(?iU)de")})
    return x.select("sentence_id", F.transform(T.marked_spans(F.col("found.gaps"), F.col("found.hits")), lambda m: m["negated"]).alias("negated"))


def _first(p: str) -> str:
    s = f"length(string_split_regex(text, '(?i){p}')[1])"
    return f"{{'s': {s}, 'e': {s} + length(regexp_extract(text, '(?i){p}'))}}"


@query(f"select sentence_id, {BETWEEN.format(a='a', b='b')} as words from (select *, {_first('tion')} as a, {_first('that')} as b from {KEYED} where regexp_matches(text, '(?i)tion') and regexp_matches(text, '(?i)that'))")
def words_between(spark, d):
    x = sentences(spark, d).where(F.col("text").rlike("(?iU)tion") & F.col("text").rlike("(?iU)that"))
    x = E.materialise(x, {p: T.gaps_and_hits(F.col("text"), "(?iU)" + p) for p in ("tion", "that")})
    x = E.materialise(x, {n: F.get(T.marked_spans(F.col(f"{p}.gaps"), F.col(f"{p}.hits")), 0) for n, p in (("a", "tion"), ("b", "that"))})
    return x.select("sentence_id", T.words_apart(F.col("a"), F.col("b")).cast("long").alias("words"))


@query(f"select rule, count(*) as n from (select unnest(list_filter([case when regexp_matches(text, '(?i)that') then 'A1' end, case when regexp_matches(text, '(?i)que') then 'A2' end, case when regexp_matches(text, '(?i)ingst') then 'A3' end, case when regexp_matches(text, '(?i)onth') then 'A4' end], lambda x: x is not null)) as rule from {KEYED}) group by 1")
def rule_cross_join(spark, d):
    """Sentences by rule whose move they hold: the rule set is unrolled, not joined."""
    hit = F.array_compact(F.array(*(F.when(F.col("text").rlike("(?iU)" + r.move), F.lit(r.rule_id)) for r in TONE)))
    return sentences(spark, d).select(F.explode(hit).alias("rule")).groupBy("rule").agg(F.count(F.lit(1)).alias("n"))


@query(f"select sentence_id, a1, a2, a3, a4 from {FIRED} where a1 or a2 or a3 or a4")
def rule_fires(spark, d):
    x, names = E.with_spans(sentences(spark, d), TONE)
    x = E.materialise(x, {r.rule_id.lower(): E.fires(r, names, F.col("text")) for r in TONE})
    return x.where("a1 or a2 or a3 or a4").select("sentence_id", "a1", "a2", "a3", "a4")


@query(f"select sentence_id, tone_score, {TONE_OF} as tone_weak, trim(case when a1 then 'A1 ' else '' end || case when a3 then 'A3' else '' end) as hawk from {SCORED}")
def tone_label(spark, d):
    return E.score_tone(sentences(spark, d), TONE).select("sentence_id", "tone_score", "tone_weak", F.array_join("hawk_rules", " ").alias("hawk"))


def _topic_rows() -> str:
    rows = ", ".join(f"('{r.topic}', '{r.pattern}', {float(r.weight)}, {P.TOPIC_ORDER.index(r.topic)}, {k})" for k, r in enumerate(TOPIC))
    return f"(select sentence_id, hint, t.*, strpos(lower(text), t.pattern) as pos from {KEYED} k, (values {rows}) t(topic, pattern, w, place, k) where contains(lower(text), t.pattern))"


FIRST = f"""(with m as (select * from {_topic_rows()}), g as (select sentence_id, bool_or(topic = 'policy' and w >= 3) and not bool_or(topic = 'global' and w >= 4) as own, bool_or(w >= 2) as strong from m group by 1),
p as (select m.*, own, min(pos) over (partition by sentence_id) as first_at from m join g using (sentence_id) where w >= 2 or not strong),
l as (select *, row_number() over (partition by sentence_id, topic order by k desc) as rn from p where pos = first_at)
select sentence_id, case when own then 'policy' else topic end as topic from (select *, row_number() over (partition by sentence_id order by w desc, place) as best from l where rn = 1) where best = 1)"""
SUM = f"(select sentence_id, topic from (select sentence_id, topic, row_number() over (partition by sentence_id order by sum(w) desc, min(place)) as rn from {_topic_rows()} group by 1, 2) where rn = 1)"


@query(f"select k.sentence_id, coalesce(f.topic, '') as topic from {KEYED} k left join {FIRST} f using (sentence_id)")
def topic_first(spark, d):
    return E.topic_by_first(sentences(spark, d), TOPIC).select("sentence_id", "topic")


@query(f"select k.sentence_id, coalesce(f.topic, '') as topic from {KEYED} k left join {SUM} f using (sentence_id)")
def topic_sum(spark, d):
    return E.topic_by_sum(sentences(spark, d), TOPIC).select("sentence_id", "topic")


FROM_HINT = "case when hint in ('inflation', 'growth') then hint end"


@query(f"""select k.sentence_id, coalesce(f.topic, {FROM_HINT}, '') as topic_weak, case when f.topic is not null then 'keywords' when {FROM_HINT} is not null then 'heading' else 'none' end as topic_source,
case when f.topic is not null then f.topic = {FROM_HINT} end as hint_agrees from {KEYED} k left join {FIRST} f using (sentence_id)""")
def topic_source(spark, d):
    return E.score_topic(sentences(spark, d), TOPIC).select("sentence_id", "topic_weak", "topic_source", "hint_agrees")


@query(f"""select method, count(*) as n, avg(case when topic = hint then 1.0 else 0.0 end) as agree from (select k.hint, m.* from {KEYED} k join (select 'first' as method, * from {FIRST} union all select 'sum', * from {SUM}) m using (sentence_id)
where hint in ('inflation', 'growth')) group by 1""")
def topic_method_compare(spark, d):
    """Both methods against the hints in one pass."""
    x = sentences(spark, d).where(F.col("section_hint").isin("inflation", "growth"))
    x = E.topic_by_sum(E.topic_by_first(x, TOPIC, out="first"), TOPIC, out="sum")
    both = F.array(*(F.struct(F.lit(k).alias("method"), F.col(k).alias("topic")) for k in ("first", "sum")))
    x = x.select("section_hint", F.explode(both).alias("m")).where("m.topic <> ''")
    return x.groupBy("m.method").agg(F.count(F.lit(1)).alias("n"), F.avg((F.col("m.topic") == F.col("section_hint")).cast("double")).alias("agree"))


@query(f"select sentence_id from {KEYED} where {LABELLABLE}")
def labellable_pool(spark, d):
    x = sentences(spark, d)
    return x.where(E.labellable(x)).select("sentence_id")


@query(f"""select s.sentence_id, {LABELLABLE} as labellable, case when {LABELLABLE} then {TONE_OF} end as tone_weak, case when {LABELLABLE} then coalesce(f.topic, {FROM_HINT}, '') end as topic_weak
from {SCORED} s left join {FIRST} f using (sentence_id)""")
def weak_labels(spark, d):
    return E.label_sentences(sentences(spark, d), TONE, TOPIC).select("sentence_id", "labellable", "tone_weak", "topic_weak")


@query("select * from (values ('A1', 'that', 'tion'), ('A2', 'que', 'ment'), ('A3', 'ingst', ''), ('A4', 'onth', 'tion')) t(rule_id, move, subject)")
def rule_table_expand(spark, d):
    """A rule table read, checked and expanded."""
    rows = [(r.rule_id, r.label, r.subject, "re:" + r.move, r.require, r.window) for r in TONE]
    rules = E.tone_rules(spark.createDataFrame(rows, "rule_id string, label string, subject string, move string, require string, window int"))
    return spark.createDataFrame([(r.rule_id, r.move, r.subject) for r in rules], "rule_id string, move string, subject string")


@query(f"""with p as (select doc_id, sentence_id, tone_score, substr(md5(sentence_id), 1, 8) as h from {SCORED} where {LABELLABLE}),
q as (select *, ('0x' || substr(h, 1, 2))::bigint as d, ('0x' || substr(h, 3, 2))::bigint as n, ('0x' || substr(h, 5, 2))::bigint as k from p)
select doc_id, source, count(*) as n_scored, avg(sign(tone_score)) as lexicon_net, avg((k - d) / (d + n + k + 1.0)) as model_net, avg(case when d >= n and d >= k then -1 when n >= k then 0 else 1 end) as model_net_hard
from q join documents using (doc_id) group by 1, 2""")
def tone_index(spark, d):
    """Documents to sentences, weak labels, predictions (here from a hash), and one row a document."""
    x = E.label_sentences(sentences(spark, d), TONE, TOPIC).where("labellable").select("doc_id", "sentence_id", "tone_weak")
    from ..operators.index import build_index

    h = F.md5(F.col("sentence_id").cast("binary"))
    byte = lambda i: F.conv(F.substring(h, i, 2), 16, 10).cast("long")
    total = byte(1) + byte(3) + byte(5) + 1.0
    x = x.withColumns({"p_dovish": byte(1) / total, "p_neutral": byte(3) / total, "p_hawkish": byte(5) / total})
    return build_index(x).join(table(spark, d, "documents").select("doc_id", "source"), "doc_id")
