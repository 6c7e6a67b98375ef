"""Packing: an exact round trip against the tokenizer, gapless sequences, little padding, edge cases."""

import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from quillspark.llm.packing import Encoder, combinations, nnls, pack, plan, tokenizer_path


def check(rows, pieces, window):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer_path())
    want = sorted([d if d is not None else -1, *t.encode(x or "", add_special_tokens=False).ids, 2] for d, x in rows)
    by_doc, sequences = defaultdict(list), defaultdict(list)
    for p in pieces:
        by_doc[p.doc_id if p.doc_id is not None else -1].append(p)
        sequences[p.sequence_id].append(p)
    ids = defaultdict(list)
    for d, *x in want:
        ids[d].append(x)
    for d, texts in ids.items():
        if len(texts) == 1:
            at = 0
            for p in sorted(by_doc[d], key=lambda p: p.start):
                assert p.start == at and p.doc_tokens == len(texts[0])
                assert p.ids_crc32 == zlib.crc32(np.array(texts[0][at : at + p.length], "<u4").tobytes())
                at += p.length
            assert at == len(texts[0])
        else:
            assert sum(p.length for p in by_doc[d]) == sum(map(len, texts))
    padding = 0
    for own in sequences.values():
        at = 0
        for p in sorted(own, key=lambda p: p.offset):
            assert p.offset == at and p.length > 0
            at += p.length
        assert at <= window and {p.sequence_tokens for p in own} == {at}
        padding += own[0].padded_to - at
    return padding


@pytest.mark.parametrize("window", [16, 4096])
def test_round_trip(spark, window):
    rng = random.Random(window)
    vocabulary = ["the", "Größe", "don't", "x1y22", "naïve", "—", "日本語", "<|endoftext|>", "é", "a b", "ΣΑΣ"]
    rows = [(i, rng.choice(" \n\t").join(rng.choice(vocabulary) for _ in range(rng.choice([1, 3, 9, 30])))) for i in range(400)]
    rows += [(900, None), (901, ""), (902, "word " * 20_000), (903, "z" * 9000), (None, "null id"), (904, "same row"), (904, "same row")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert check(rows, pack(df, window=window).collect(), window) < window


def test_clashing_columns_and_empty(spark):
    df = spark.createDataFrame([(1, "a b", "x", "y")], "doc_id long, text string, offset string, rest string")
    assert [r.length for r in pack(df).collect()] == [3]
    assert pack(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def placed(histogram, made, window):
    """Sequences as lists of (offset, length), by replaying the runs rank by rank."""
    runs, sequences = made["runs"], defaultdict(list)
    rows = list(zip(*(runs[k].tolist() for k in ("length", "rank", "kind", "sequence", "copies", "offset", "total")), strict=True))
    for i, (y, rank, kind, first, copies, offset, total) in enumerate(rows):
        end = rows[i + 1][1] if i + 1 < len(rows) and rows[i + 1][0] == y else histogram[y]
        for r in range(rank, end):
            if kind == 0:
                group, slot = divmod(r - rank, copies)
                sequences[first + group].append((offset + slot * y, y, total))
            else:
                at, left = offset + (r - rank) * y, y
                while left:
                    size = min(left, window - at % window)
                    sequences[first + at // window].append((at % window, size, made["short"] if first + at // window == made["last"] else window))
                    at, left = at + size, left - size
    return sequences


@pytest.mark.parametrize(("n", "mean", "share"), [(100_000, 800, 0.97), (3000, 800, 0.9), (3000, 1600, 0.4), (40, 800, 0.0), (1, 800, 0.0), (0, 1, 0.0)])
def test_plan_places_all(n, mean, share):
    rng = random.Random(n)
    histogram = dict(Counter(1 + int(rng.expovariate(1 / mean)) % 4095 for _ in range(n)))
    made = plan(histogram)
    total = sum(x * k for x, k in histogram.items())
    assert made["combined"] + made["fitted"] + made["cut"] == total and made["combined"] >= share * total
    sequences = placed(histogram, made, 4096)
    assert sorted(sequences) == list(range(made["used"]))
    for own in sequences.values():
        at = 0
        for offset, size, _ in sorted(own):
            assert offset == at
            at += size
        assert at <= 4096 and {x for _, _, x in own} == {at}
    assert 4096 * made["used"] - total <= 64 * made["used"] + 4096 and plan(histogram)["used"] == made["used"]


def test_combinations_fill_the_window():
    rng = random.Random(2)
    left = np.zeros(4097, np.int64)
    left[rng.sample(range(1, 4096), 1500)] = 3
    found = combinations(left, 5000, 8, np.random.default_rng(1))
    assert len(found) > 500 and (found.sum(1) == 4096).all() and (left[found[found > 0]] > 0).all()
    assert len(np.unique(found, axis=0)) == len(found)


def test_nnls_meets_the_optimality_conditions():
    rng = np.random.default_rng(1)
    columns = rng.integers(0, 13, (40, 4))
    columns = columns[columns.any(1)]
    a = np.stack([np.bincount(c[c > 0], minlength=13) for c in columns], 1).astype(float)
    b = rng.integers(0, 50, 13).astype(float)
    b[0] = 0
    x = nnls(columns, b, 5000)
    gradient = a.T @ (a @ x - b)
    assert (x >= 0).all() and (gradient > -1e-3).all() and (np.abs(gradient[x > 1e-6]) < 1e-3).all()


def test_table_of_words_empties_and_grows():
    import pyarrow as pa

    whole, small = Encoder(tokenizer_path()), Encoder(tokenizer_path(), 4)
    texts = pa.array(["a b c d e f g h i j", None, "", "k l m n o p q r s t u v w x y z a b c", "the naïve The"])
    for _ in range(2):
        assert all((x == y).all() for x, y in zip(whole.encode(texts), small.encode(texts), strict=True))
