"""Places, word numbers and negation of matches against Python's re; and the time of long sentences."""

import random
import re
import time

from pyspark.sql import functions as F

from quillspark.functions import patterns as P
from quillspark.functions import text as T
from quillspark.operators import rules as E


def _spans(spark, texts, pattern):
    x = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    x = E.materialise(x, {"r": T.gaps_and_hits(F.col("text"), pattern)})
    x = x.select("id", T.marked_spans(F.col("r.gaps"), F.col("r.hits")).alias("m"))
    return {r.id: r.m for r in x.collect()}


def test_marked_spans_like_re(spark):
    rng = random.Random(4)
    word = ["rise", "rising", "not", "no", "the", "a", "ri", "se", "rise.", "-", "\n", "  ", "never", "rates,", "éris", "risen"]
    texts = ["", None, "rise", "rise rise", "riserise not rise", " rise ", "not a b rise"]
    texts += ["".join(rng.choice(word) + rng.choice([" ", "", " ", "  ", "\t"]) for _ in range(rng.randint(1, 40))) for _ in range(120)]
    found = _spans(spark, texts, "(?iU)ris(?:e|ing)")
    for i, t in enumerate(texts):
        if t is None:
            assert not found[i]
            continue
        want = [m.span() for m in re.finditer("ris(?:e|ing)", t, re.I)]
        got = found[i]
        assert [(x.s, x.e) for x in got] == want
        for x in got:
            before = re.findall(r"\w+", t[: x.s].lower())
            assert x.negated == bool(set(before[-3:]) & set(P.NEGATORS)), (t, x)
        for a in got:
            for b in got:
                if a.e < b.s:
                    assert b.ws - a.we == len(t[a.e : b.s].split()), (t, a, b)


def test_a_sentence_of_many_matches(spark):
    rules = [E.ToneRule("A", "hawkish", "tion", "ment", "", 2), E.ToneRule("B", "dovish", "ment", "zone", "", 1)]
    text = "ment " + "".join(f"w{i} of it tion x{i} of it ment " for i in range(3000))
    assert len(text) > 80_000
    x = spark.createDataFrame([(1, text), (2, "ment a b tion"), (3, "not ment tion")], "id int, text string")
    began = time.time()
    got = {r.id: (r.hawk_rules, r.dove_rules) for r in E.score_tone(x, rules).collect()}
    assert time.time() - began < 60
    assert got == {1: ([], []), 2: (["A"], []), 3: ([], [])}
