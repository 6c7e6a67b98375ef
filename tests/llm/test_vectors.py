"""Vectors against brute force (recall of links, no false ones), a bucket of several blocks, edge cases."""

import numpy as np

from quillspark.llm import vectors
from quillspark.llm.vectors import hadamard, keys, near_vectors


def brute(ids, x, least=0.95):
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = (u @ u.T) >= least
    np.fill_diagonal(near, False)
    label = list(ids)
    changed = True
    while changed:
        changed = False
        for i in range(len(ids)):
            low = min([label[i], *(label[j] for j in np.flatnonzero(near[i]))])
            if low < label[i]:
                label[i], changed = low, True
    return {d: (int(n), c) for d, n, c in zip(ids, near.sum(1), label, strict=True)}


def test_hadamard_is_orthonormal():
    x = np.random.default_rng(1).normal(size=(5, 64))
    assert np.allclose(hadamard(hadamard(x)), x)


def test_recall_at_the_threshold():
    rng = np.random.default_rng(2)
    a = rng.normal(size=(4000, 64))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    b = rng.normal(size=a.shape)
    b -= (a * b).sum(1, keepdims=True) * a
    b /= np.linalg.norm(b, axis=1, keepdims=True)
    met = (keys(a)[:, :, None] == keys(0.95 * a + np.sqrt(1 - 0.95**2) * b)[:, None, :]).any((1, 2))
    assert met.mean() > 0.97


def test_brute_force(spark):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(30, 32))
    x = np.concatenate([rng.normal(size=(200, 32)), centres.repeat(12, 0) + 0.12 * rng.normal(size=(360, 32)), centres[:1] + 0.08 * rng.normal(size=(700, 32)), centres[1:2].repeat(40, 0)]).astype(np.float32)
    ids = rng.permutation(len(x)).tolist()
    want = brute(ids, x.astype(float))
    got = {r.vec_id: r for r in near_vectors(spark.createDataFrame([(i, v.tolist(), 0) for i, v in zip(ids, x, strict=True)], "vec_id long, embedding array<float>, n_links int")).collect()}
    total = sum(n for n, _ in want.values())
    assert all(got[i].n_links <= n for i, (n, _) in want.items())
    assert sum(r.n_links for r in got.values()) > 0.97 * total
    assert sum(got[i].component_id == c for i, (_, c) in want.items()) > 0.97 * len(ids)


def test_edges(spark):
    one = [1.0, 0.0, 0.0]
    rows = [(1, one), (2, one), (2, one), (3, None), (4, []), (5, [0.0, 0.0, 0.0]), (6, [1.0, None, 0.0]), (7, [float("nan"), 1.0, 0.0]), (8, [float("inf"), 0.0, 0.0]), (None, one), (9, [1.0, 0.0]), (10, [0.0, -1.0, 0.0]), (11, [5e300, 0.0, 0.0]), (12, [2.0])]
    got = sorted((tuple(r) for r in near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()), key=lambda r: (r[0] is None, r))
    alone = [(i, 0, i, True) for i in range(3, 11)]
    assert got == [(1, 3, 1, True), (2, 3, 1, False), (2, 3, 1, False), *alone, (11, 3, 1, False), (12, 0, 12, True), (None, 0, None, True)]
    assert near_vectors(spark.createDataFrame([], "vec_id long, embedding array<double>")).count() == 0
    assert vectors.BLOCK == 256
