"""The tone and topic rule engine. Rules are data; a rule set is unrolled into expressions over one row's text, so that
scoring is a projection: no join of rules with rows, no explosion of matches, no shuffle."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import patterns as P
from ..functions import text as T


@dataclass(frozen=True)
class ToneRule:
    rule_id: str
    label: str
    move: str
    subject: str = ""
    require: str = ""
    window: int = 0


@dataclass(frozen=True)
class TopicRule:
    topic: str
    pattern: str
    weight: float


def tone_rules(table: DataFrame) -> list[ToneRule]:
    """Rules of a table (rule_id, label, subject, move, require, window), checked. A move is `re:` and a pattern or a named move."""
    rules = []
    for r in table.na.fill("").collect():
        if r.label not in ("hawkish", "dovish"):
            raise ValueError(f"{r.rule_id}: label must be hawkish or dovish, got {r.label!r}")
        if not r.move.startswith("re:") and r.move not in P.MOVES:
            raise ValueError(f"{r.rule_id}: unknown move {r.move!r}")
        rules.append(ToneRule(r.rule_id, r.label, r.move[3:] if r.move.startswith("re:") else P.MOVES[r.move], r.subject, r.require, int(r.window or 0)))
    if len({r.rule_id for r in rules}) < len(rules):
        raise ValueError("Duplicate rule_id in the tone rules")
    return rules


def topic_rules(table: DataFrame) -> list[TopicRule]:
    rules = [TopicRule(r.topic, r.pattern, float(r.weight)) for r in table.collect()]
    for r in rules:
        if r.topic not in P.TOPIC_ORDER:
            raise ValueError(f"Unknown topic {r.topic!r}")
    return rules


def materialise(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """Columns computed once a row. A plain projection would be merged into the next one, and what a lambda there uses would be computed anew for
    every element; a generator of one row is not merged."""
    one = F.explode(F.array(F.struct(*(c.alias(n) for n, c in columns.items()))))
    return df.select("*", one.alias("__one")).select("*", "__one.*").drop("__one")


def _overlap(a: Column, b: Column) -> Column:
    return (a["s"] < b["e"]) & (b["s"] < a["e"])


def with_spans(df: DataFrame, rules: list[ToneRule], text: str = "text") -> tuple[DataFrame, dict[str, str]]:
    """Adds the marked spans of each distinct pattern, found once however many rules share it; of moves those that aren't negated, and for
    each subject the spans of all others. The names of the new columns are returned by what they hold.

    A rule can only fire in a row that its move, subject and requirement match, so a pattern's spans are found where such a rule uses it, and are
    empty elsewhere: all moves' and subjects' patterns are searched for once, and most rows need no more."""
    subjects, moves = (list(dict.fromkeys(getattr(r, k) for r in rules if getattr(r, k))) for k in ("subject", "move"))
    patterns = list(dict.fromkeys([*subjects, *moves]))
    tested = list(dict.fromkeys([*patterns, *(r.require for r in rules if r.require)]))
    has = {p: F.col(f"__has{i}") for i, p in enumerate(tested)}
    df = materialise(df, {f"__has{i}": F.coalesce(F.col(text).rlike("(?iU)" + p), F.lit(False)) for i, p in enumerate(tested)})

    def needed(p: str) -> Column:
        """Whether `p` occurs and a rule that can fire uses it: as its move or subject, or as a subject that may be nearer."""
        used = [reduce(and_, (has[q] for q in (r.move, r.subject, r.require) if q)) for r in rules if p in (r.move, r.subject) or (p in subjects and r.subject)]
        return has[p] & reduce(or_, used)

    df = materialise(df, {f"__raw{i}": T.gaps_and_hits(F.col(text), "(?iU)" + p, needed(p)) for i, p in enumerate(patterns)})
    df = df.drop(*(f"__has{i}" for i in range(len(tested))))
    df = materialise(df, {f"__span{i}": T.marked_spans(F.col(f"__raw{i}.gaps"), F.col(f"__raw{i}.hits")) for i in range(len(patterns))})
    df = df.drop(*(f"__raw{i}" for i in range(len(patterns))))
    span = {p: f"__span{i}" for i, p in enumerate(patterns)}
    names, later = {f"all:{p}": c for p, c in span.items()} | {f"subject:{p}": span[p] for p in subjects}, {}
    for i, p in enumerate(moves):
        later[f"__move{i}"] = F.filter(span[p], lambda m: ~m["negated"])
        names[f"move:{p}"] = f"__move{i}"
    for i, p in enumerate(subjects):
        rest = [F.col(span[q]) for q in subjects if q != p]
        later[f"__other{i}"] = F.concat(*rest) if rest else F.slice(span[p], 1, 0)
        names[f"other:{p}"] = f"__other{i}"
    return materialise(df, later), names


def fires(rule: ToneRule, names: dict[str, str], text: Column) -> Column:
    """Whether some move that isn't negated stands within the window of the subject, and no other rule's subject that
    doesn't share words with it is nearer to the move."""
    moves = F.col(names[f"move:{rule.move}"])
    if not rule.subject:
        hit = F.size(moves) > 0
    else:
        subject, other = F.col(names[f"subject:{rule.subject}"]), F.col(names[f"other:{rule.subject}"])

        def pair(s: Column, m: Column) -> Column:
            d = T.words_apart(s, m)
            return (d <= rule.window) & ~F.exists(other, lambda o: (T.words_apart(o, m) < d) & ~_overlap(o, s))

        hit = (F.size(subject) > 0) & (F.size(moves) > 0) & F.exists(subject, lambda s: F.exists(moves, lambda m: pair(s, m)))
    if rule.require:
        hit = hit & text.rlike("(?iU)" + rule.require)
    return F.coalesce(hit, F.lit(False))


def score_tone(df: DataFrame, rules: list[ToneRule], text: str = "text") -> DataFrame:
    """Adds tone_weak, tone_score, hawk_rules, dove_rules (arrays of ids in the order of the rules)."""
    found, names = with_spans(df, rules, text)
    fired = {k: F.array_compact(F.array(*(F.when(fires(r, names, F.col(text)), F.lit(r.rule_id)) for r in rules if r.label == k))) for k in ("hawkish", "dovish")}
    out = materialise(found, {"hawk_rules": fired["hawkish"], "dove_rules": fired["dovish"]}).drop(*names.values())
    score = F.size("hawk_rules") - F.size("dove_rules")
    return out.withColumn("tone_score", score).withColumn("tone_weak", F.when(score > 0, "hawkish").when(score < 0, "dovish").otherwise("neutral"))


def _matches(rules: list[TopicRule], text: Column) -> Column:
    """(position of the first match, place of the topic in the order, weight, place of the rule) of the rules that match."""
    def one(k: int, r: TopicRule) -> Column:
        p = "(?iU)" + r.pattern
        at = F.length(F.get(F.split(text, p, 2), 0))
        return F.when(text.rlike(p), F.struct(at.alias("at"), F.lit(P.TOPIC_ORDER.index(r.topic)).alias("topic"), F.lit(float(r.weight)).alias("w"), F.lit(k).alias("k")))

    return F.array_compact(F.array(*(one(k, r) for k, r in enumerate(rules))))


def _named(place: Column) -> Column:
    return F.coalesce(F.get(F.array(*map(F.lit, P.TOPIC_ORDER)), place), F.lit(""))


def topic_by_sum(df: DataFrame, rules: list[TopicRule], text: str = "text", out: str = "topic") -> DataFrame:
    """Adds the topic of greatest summed weight, the first in the order on ties; empty if none is over 0."""
    df = materialise(df, {"__m": _matches(rules, F.col(text))})
    m = F.col("__m")
    total = [F.aggregate(m, F.lit(0.0), lambda acc, x: acc + F.when(x["topic"] == i, x["w"]).otherwise(0.0)) for i in range(len(P.TOPIC_ORDER))]  # noqa: B023
    df = materialise(df, {"__t": F.array(*total)})
    t = F.col("__t")
    return df.withColumn(out, F.when(F.array_max(t) > 0, _named((F.array_position(t, F.array_max(t)) - 1).cast("int"))).otherwise("")).drop("__m", "__t")


def topic_by_first(df: DataFrame, rules: list[TopicRule], text: str = "text", out: str = "topic") -> DataFrame:
    """Adds the topic of the earliest match among those of weight 2 or more (else all); the bank's own policy (3 or more) comes first
    unless another central bank is named (global, 4 or more). At one place the last rule of a topic counts, then the greatest
    weight, then the order."""
    df = materialise(df, {"__m": _matches(rules, F.col(text))})
    m = F.col("__m")
    strong = F.filter(m, lambda x: x["w"] >= 2)
    df = materialise(df, {"__pool": F.when(F.size(strong) > 0, strong).otherwise(m)})
    df = materialise(df, {"__first": F.array_min(F.transform("__pool", lambda x: x["at"]))})
    df = materialise(df, {"__here": F.filter("__pool", lambda x: x["at"] == F.col("__first"))})
    last = F.filter("__here", lambda x: ~F.exists("__here", lambda y: (y["topic"] == x["topic"]) & (y["k"] > x["k"])))
    best = F.array_min(F.transform(last, lambda x: F.struct((-x["w"]).alias("w"), x["topic"].alias("topic"))))["topic"]
    policy, world = P.TOPIC_ORDER.index("policy"), P.TOPIC_ORDER.index("global")
    own = F.exists(m, lambda x: (x["topic"] == policy) & (x["w"] >= 3)) & ~F.exists(m, lambda x: (x["topic"] == world) & (x["w"] >= 4))
    df = df.withColumn(out, F.when(own, "policy").when(F.size(m) == 0, "").otherwise(_named(best)))
    return df.drop("__m", "__pool", "__first", "__here")


def score_topic(df: DataFrame, rules: list[TopicRule], method: str = "first", text: str = "text", hint: str = "section_hint") -> DataFrame:
    """Adds topic_weak, topic_source (keywords, heading, none) and hint_agrees (null where it can't be told)."""
    by = topic_by_first if method == "first" else topic_by_sum
    from_hint = F.when(F.col(hint).isin(*P.HINT_TOPICS), F.col(hint))
    out = by(df, rules, text, "__topic")
    found = F.col("__topic") != ""
    return out.withColumns({
        "topic_weak": F.when(found, F.col("__topic")).otherwise(F.coalesce(from_hint, F.lit(""))),
        "topic_source": F.when(found, "keywords").when(from_hint.isNotNull(), "heading").otherwise("none"),
        "hint_agrees": F.when(found, F.col("__topic") == from_hint),
    }).drop("__topic")


def labellable(df: DataFrame) -> Column:
    """No decisions, fragments, short or long sentences, or administrative notes."""
    return ~((F.col("section_hint") == "admin") | F.col("is_fragment") | F.col("is_short") | (F.col("n_words") > 80) | F.col("is_decision"))


def label_sentences(df: DataFrame, tones: list[ToneRule], topics: list[TopicRule], method: str = "first") -> DataFrame:
    """Weak labels of sentences; those that aren't labellable have null labels, and the rules don't read them."""
    read = materialise(df, {"labellable": labellable(df)})
    read = materialise(read, {"__text": F.when(F.col("labellable"), F.col("text"))})
    out = score_topic(score_tone(read, tones, "__text"), topics, method, "__text").drop("__text")
    keep = F.col("labellable")
    joined = {c: F.array_join(c, " ") for c in ("hawk_rules", "dove_rules")}
    cols = {c: F.when(keep, joined.get(c, F.col(c))) for c in ("tone_weak", "tone_score", "hawk_rules", "dove_rules", "topic_weak", "topic_source", "hint_agrees")}
    return out.withColumns(cols)
