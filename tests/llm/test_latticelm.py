"""The lattice recursion against enumeration of segmentations; base scores against a plain count; edge cases."""

import math
import zlib
from collections import Counter

import numpy as np
import pytest

from quillspark.llm import latticelm
from quillspark.llm.latticelm import Lattice, model_path, op2, score, vocabulary


def enumerated(word, weight):
    if not word:
        return 1.0
    return sum(w * enumerated(word[len(p) :], weight) for p, w in weight.items() if word.startswith(p))


@pytest.fixture(scope="module")
def small():
    pieces = [b" ", b"a", b"b", b"ab", b" a", b" ab", b"bab", b"aba"]
    weight = np.array([0.1, 0.2, 0.1, 0.1, 0.1, 0.1, 0.05, 0.05])
    return pieces, weight, Lattice(pieces, np.log(weight))


@pytest.mark.parametrize("few", [0, 1000])
def test_sums_all_segmentations(small, monkeypatch, few):
    """In arrays and word by word."""
    monkeypatch.setattr(latticelm, "FEW", few)
    pieces, weight, m = small
    strings = [b"a", b"ab", b"abab", b"babab", b"aaaa", b"abababab"]
    want = [math.log(enumerated(b" " + s, dict(zip(pieces, weight, strict=True)))) for s in strings]
    assert np.allclose(m.log_probability(strings), want)


@pytest.mark.parametrize("few", [0, 1000])
def test_expected_uses(small, monkeypatch, few):
    """The uses are the derivative of the log probability by the piece's log weight."""
    monkeypatch.setattr(latticelm, "FEW", few)
    pieces, weight, m = small
    strings, counts = [b"abab", b"b", b"ababababab" * 30], np.array([3.0, 2.0, 1.0])
    uses = m.expected(strings, counts)
    letters = sum(u * len(p) for u, p in zip(uses, pieces, strict=True))
    assert abs(letters - (3 * 5 + 2 * 2 + 301)) < 1e-6
    for k in range(len(pieces)):
        up, down = (np.log(weight) + s * 1e-5 * (np.arange(len(pieces)) == k) for s in (1, -1))
        slope = counts @ (Lattice(pieces, up).log_probability(strings) - Lattice(pieces, down).log_probability(strings)) / 2e-5
        assert abs(slope - uses[k]) < 1e-4


def test_blocks_of_any_lengths(monkeypatch):
    """Words of mixed lengths, long ones too, give in arrays what they give one by one."""
    rng = np.random.default_rng(2)
    pieces, prior = vocabulary(model_path())
    m = Lattice(pieces, np.log(prior))
    strings = [bytes(rng.choice(np.frombuffer(b"abcdefghiostn\xc3\xa9-1", np.uint8), int(k)).tobytes()) for k in rng.integers(1, 150, 200)]
    whole = m.log_probability(strings)
    uses = m.expected(strings, np.ones(200))
    monkeypatch.setattr(latticelm, "FEW", 10_000)
    assert np.allclose(whole, m.log_probability(strings)) and np.allclose(uses, m.expected(strings, np.ones(200)))


def test_scores_of_one_text_by_enumeration(spark, monkeypatch):
    """The score of a text is the sum over all segmentations, with the learned weights; so is that of the existing ones."""
    pieces, prior = [b" ", b"a", b"b", b" a", b"ab", b" ab"], np.array([0.3, 0.2, 0.2, 0.1, 0.1, 0.1])
    monkeypatch.setattr(latticelm, "vocabulary", lambda path: (pieces, prior))
    df = spark.createDataFrame([(1, "ab aab b"), (2, None)], "doc_id long, text string")
    got = {r.doc_id: r for r in score(df, "false").collect()}
    weight = dict(zip(pieces, 0.99 * prior, strict=True))
    want = sum(math.log10(enumerated(b" " + w, weight)) for w in (b"ab", b"aab", b"b")) + math.log10(0.01)
    assert abs(got[1].existing_score - want) < 1e-9 and abs(got[1].score - want) < 1e-9 and abs(got[2].score + 2) < 1e-9


def test_against_counts(spark):
    rows = [(i, " ".join(f"w{(i * j) % 17} The" for j in range(i % 7))) for i in range(60)]
    rows += [(100, None), (101, ""), (102, "x" * 5000 + " é É"), (None, "the end"), (103, "The  tHE"), (103, "The  tHE")]
    lower = str.maketrans({chr(65 + i): chr(97 + i) for i in range(26)})
    tokens = [(d, (t or "").translate(lower).encode().split()) for d, t in rows]
    learn = [d is None or zlib.crc32(str(d).encode()) % 5 != 1 for d, _ in rows]
    c = Counter(w for (_, t), on in zip(tokens, learn, strict=True) if on for w in [*t, None])
    n, v = sum(c.values()), len(c)
    want = sorted(
        ((d is None, d or 0), bool(d is not None and zlib.crc32(str(d).encode()) % 5 == 1), len(t) + 1, sum(c[w] > 0 for w in [*t, None]), n, round(sum(math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in [*t, None]), 6))
        for d, t in tokens
    )
    df = spark.createDataFrame([(d, t, 1) for d, t in rows], "doc_id long, text string, score int")
    got = op2(df).collect()
    assert sorted(((r.doc_id is None, r.doc_id or 0), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got) == want
    assert all(math.isfinite(r.score) and r.score < 0 for r in got)


def test_learns_the_texts(spark):
    """Held-out texts made as the training texts are get more likely by learning; texts in other letters stay unlikely."""
    rows = [(i, " ".join("walk talk jump look".split()[(i * k) % 4] + ["ing", "ed", "er", "s"][(i + k) % 4] for k in range(20)) + f" un{i}known") for i in range(200)]
    df = spark.createDataFrame([*rows, (1000, "qxz zzq kvj " * 7)], "doc_id long, text string")
    got = {r.doc_id: r for r in op2(df).collect()}
    none = {r.doc_id: r for r in score(df, "false").collect()}
    held = [d for d, r in got.items() if r.held_out and d < 1000]
    assert held and all(got[d].score > none[d].score + 10 for d in held)
    assert all(got[d].score / got[d].n_tokens > got[1000].score / got[1000].n_tokens for d in held)


def test_empty(spark):
    assert op2(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_vocabulary():
    pieces, prior = vocabulary(model_path())
    assert len(set(pieces)) == len(pieces) > 10_000 and abs(prior.sum() - 1) < 1e-9 and all(bytes([b]) in set(pieces) for b in range(256))
