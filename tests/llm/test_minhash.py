"""MinHash components against brute force, and the defined edge cases."""

import random
import re

import pytest
from pyspark.sql import functions as F

from quillspark.llm.minhash import near_duplicates

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans({chr(65 + i): chr(97 + i) for i in range(26)})


def shingle_set(text):
    w = WORD.findall((text or "").translate(LOWER))
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def brute(rows, percent=85):
    sets = [shingle_set(t) for _, t in rows]
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j]:
                both = len(sets[i] & sets[j])
                if 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                    parent[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        least[find(i)] = min(least.get(find(i), d), d)
    return sorted((d, len(s), least[find(i)], d == least[find(i)]) for i, ((d, _), s) in enumerate(zip(rows, sets, strict=True)))


def made(seed, n_bases=6, copies=25, words=60):
    """Groups of edited copies of which many pairs lie on either side of the threshold."""
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    rows = []
    for _ in range(n_bases):
        base = [rng.choice(vocabulary) for _ in range(words)]
        for _ in range(copies):
            w = list(base)
            for _ in range(rng.randrange(4)):
                k = rng.randrange(len(w))
                how = rng.random()
                if how < 0.4:
                    w[k] = rng.choice(vocabulary)
                elif how < 0.7:
                    del w[max(0, len(w) - rng.randrange(1, 4)) :]
                else:
                    w = w[rng.randrange(3) :]
            rows.append(" ".join(w))
    rng.shuffle(rows)
    return list(enumerate(rows))


def result(df):
    return sorted((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in df.collect())


@pytest.mark.parametrize("seed", [1, 2])
def test_brute_force(spark, seed):
    rows = made(seed)
    assert result(near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))) == brute(rows)


@pytest.mark.parametrize("seed", [5, 6, 7])
def test_open_pairs_of_a_group(spark, seed):
    """One bucket for all texts: every link but those of its leader must come from the prefix join."""
    def one_bucket(signature):
        import numpy as np

        return np.tile(np.arange(24, dtype=np.uint64), (len(signature), 1))

    rows = made(seed, n_bases=2, copies=30)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert result(near_duplicates(df, banding=one_bucket)) == brute(rows)


@pytest.mark.parametrize("part", [2, 5])
def test_parts_of_a_group(spark, monkeypatch, part):
    """Groups dealt over many tasks give the same rows."""
    from quillspark.llm import minhash

    monkeypatch.setattr(minhash, "PART", part)
    rows = made(8, n_bases=2, copies=40)
    assert result(near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))) == brute(rows)


def test_dealt_keeps_each_row_once(spark):
    from quillspark.llm.minhash import dealt

    rows = spark.range(3000).selectExpr("id % 2 as a", "id as u", "if(id % 2 = 0, 1500L, 2L) as m")
    keyed = spark.createDataFrame([(0, 1500, "p"), (1, 900, "q"), (2, 5, "r")], "a long, size long, v string")
    got = dealt(rows, keyed)
    assert got.columns == ["a", "u", "m", "v"] and sorted((r.u, r.v) for r in got.collect()) == [(i, "pq"[i % 2]) for i in range(3000)]


def test_pipeline_stage_links_from_080(spark):
    """The stage against brute force at 80, on rows of which some are linked at 80 only."""
    import corpus_pipeline

    rows = made(3)
    want = {d for d, _, _, kept in brute(rows, 80) if kept}
    assert want < {d for d, _, _, kept in brute(rows) if kept}
    got = corpus_pipeline.remove_near_duplicates(spark, spark.createDataFrame(rows, "doc_id long, text string"), "")
    assert {r.doc_id for r in got.collect()} == want


def test_edges(spark):
    long_text = "word " * 60_000
    rows = [(1, None, "x"), (2, "", "x"), (3, " \n\t", "x"), (4, "A b", "x"), (5, "a  B", "x"), (6, long_text, "x"), (7, long_text, "x"), (7, long_text, "y"), (None, "a b", "z"), (8, "b a", "")]
    df = spark.createDataFrame(rows, "doc_id long, text string, kept string").withColumn("n_shingles", F.lit(1))
    got = [tuple(r) for r in near_duplicates(df).collect()]
    assert sorted(got, key=lambda r: (r[0] is None, r)) == [(1, 0, 1, True), (2, 0, 2, True), (3, 0, 3, True), (4, 1, 4, True), (5, 1, 4, False), (6, 1, 6, True), (7, 1, 6, False), (7, 1, 6, False), (8, 1, 8, True), (None, 1, None, True)]


def test_empty(spark):
    assert near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0
