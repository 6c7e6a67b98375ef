"""The pipeline as a whole: run() against its stages, null ids and texts, repeated ids, clashing columns, empty tables."""

import random

import corpus_pipeline as c
import pytest
from test_minhash import shingle_set
from test_packing import check


def write(spark, path, docs, labels, items):
    spark.createDataFrame(docs, "doc_id long, text string, lang string, n_chars int, n_lines int, leaked string, lost string, toxicity string").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    rng = random.Random(8)
    words = [f"{a}{b}{e}" for a in "bcdfglmnprst" for b in "aeiou" for e in ("n", "rk", "st")]
    bad = ["vile", "scum", "filthy", "wretch", "hateful", "loathsome"]
    prose = lambda n: " ".join(rng.choice(words) for _ in range(n))
    docs, labels = [], []
    for i in range(300):
        toxic = i % 6 == 0
        text = prose(120).split()
        if toxic:
            for k in range(0, 120, 5):
                text[k] = rng.choice(bad)
        docs.append([i, " ".join(text)])
        if i % 3 != 1:
            labels.append((i, 0, int(toxic)))
    item = prose(30)
    line = "this one line stands in two documents"
    close = docs[7][1].split()
    close[60] = "changed"
    close = " ".join(close)  # five of about 116 shingles are others: a similarity over 0.9
    docs += [[1000, docs[1][1]], [1001, close], [1002, prose(40) + " " + item + " " + prose(40)], [1003, prose(30) + "\n" + line], [1004, prose(30) + "\n" + line]]
    docs += [[1005, None], [1006, ""], [None, prose(60)], [None, None], [1007, prose(80)], [1007, prose(80)]]
    rows = [(d, t, "en", len(t) if t else 0, 5, "x", "y", "z") for d, t in docs]
    path = str(tmp_path_factory.mktemp("corpus"))
    return write(spark, path, rows, [*labels, (None, 0, 1), (3, 0, None)], [(1, item), (None, "no id"), (2, "")]), dict(enumerate(docs))


def test_stages_keep_what_is_clean(spark, corpus):
    path, docs = corpus
    out, kept = spark.read.parquet(f"{path}/documents.parquet"), {}
    columns = out.columns
    for name, stage in c.STAGES[:-1]:
        out = stage(spark, out, path).cache()
        assert out.columns == columns
        kept[name] = out.collect()
        assert all((r.n_lines, r.leaked, r.lost, r.toxicity, r.lang) == (5, "x", "y", "z", "en") for r in kept[name])
    ids = {name: [r.doc_id for r in rows] for name, rows in kept.items()}
    first = set(ids["toxicity"])
    assert sum(i % 6 == 0 for i in first if i is not None and i < 300) <= 5 and sum(i % 6 != 0 for i in first if i is not None and i < 300) >= 245
    for special in (1000, 1001, 1002, 1003, 1004, 1005, 1006, 1007, None):
        assert special in first
    assert len(ids["line_dedup"]) == len(ids["toxicity"])
    texts = {r.doc_id: r.text for r in kept["line_dedup"]}
    assert "stands in two" in texts[1003] and "stands in two" not in texts[1004] and texts[1005] is None
    assert set(ids["line_dedup"]) - set(ids["minhash_dedup"]) == {1001} and texts[1000] == "" and ids["minhash_dedup"].count(None) == 2 and ids["minhash_dedup"].count(1007) == 2
    a, b = (shingle_set(docs_text) for docs_text in (texts[7], texts[1001]))
    assert len(a & b) / len(a | b) >= 0.8
    assert set(ids["minhash_dedup"]) - set(ids["decontamination"]) == {1002}
    assert check([(r.doc_id, r.text) for r in kept["decontamination"]], c.run(spark, path).collect(), 4096) < 2 * 4096


def test_empty_tables(spark, tmp_path):
    path = write(spark, str(tmp_path), [], [], [])
    assert c.run(spark, path).count() == 0


def test_no_labels_and_no_items(spark, tmp_path):
    path = write(spark, str(tmp_path), [(1, "a b c", None, None, None, None, None, None), (2, None, "x", 1, 1, "l", "m", "n")], [], [])
    got = c.run(spark, path).collect()
    assert sorted((r.doc_id, r.doc_tokens) for r in got) == [(1, 4), (2, 1)]
