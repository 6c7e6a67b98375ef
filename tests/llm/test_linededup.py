"""Line dedup against a plain loop, and its edge cases."""

import hashlib
import random
from collections import defaultdict

import pytest

from quillspark.llm import linededup
from quillspark.llm.linededup import drop_repeated_lines, op10

LOWER = str.maketrans({chr(65 + i): chr(97 + i) for i in range(26)})


def brute(rows):
    key = lambda x: x.strip(" \t\n\x0b\f\r").translate(LOWER)
    holds = defaultdict(set)
    for d, t in rows:
        for x in (t or "").split("\n"):
            if len(key(x)) >= 10 and d is not None:
                holds[key(x)].add(d)
    out = []
    for d, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if d is None or len(holds[key(x)]) < 2 or d == min(holds[key(x)])]
        out.append((d, len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("frequent", [1000, 30, 1])
def test_brute_force(spark, monkeypatch, frequent):
    """With all repeated keys frequent, some, and none."""
    monkeypatch.setattr(linededup, "FREQUENT", frequent)
    rng = random.Random(3)
    pool = ["a short", "ÄÖÜ äöü ßßßß", "  A line that REPEATS \t", "a line that repeats", "Ä line that repeats", "", "x" * 10, "y" * 9] + [f"own line {i}" for i in range(60)]
    rows = [(i, "\n".join(rng.choice(pool) for _ in range(rng.randrange(9)))) for i in range(120)]
    rows += [(500, None), (501, ""), (None, "a line that repeats\nx"), (502, "\n\n"), (503, "z" * 200_000 + "\n" + "a line that repeats"), (504, "tail line 123\n"), (505, "tail line 123"), (505, "tail line 123")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted((tuple(r) for r in op10(df).collect()), key=str) == brute(rows)


def test_keeps_columns_and_texts(spark):
    df = spark.createDataFrame([(2, "the same line\nb", 9), (1, "The same line ", 8), (3, None, 7)], "doc_id long, text string, n_dropped int")
    got = {r.doc_id: (r.text, r.n_dropped) for r in drop_repeated_lines(df).collect()}
    assert got == {1: ("The same line ", 0), 2: ("b", 1), 3: (None, 0)}


def test_clashing_names_stay(spark):
    df = spark.createDataFrame([(2, "the same line\nb", 1, 2, 3, 4), (1, "the same line", 5, 6, 7, 8)], "doc_id long, text string, lost int, lost_id int, at int, h int")
    got = {r.doc_id: tuple(r) for r in drop_repeated_lines(df, lines_col=None, dropped_col=None).collect()}
    assert got == {1: (1, "the same line", 5, 6, 7, 8), 2: (2, "b", 1, 2, 3, 4)}


def test_empty(spark):
    assert op10(spark.createDataFrame([], "doc_id long, text string")).count() == 0
