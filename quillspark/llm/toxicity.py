"""Toxicity by non-negative positive-unlabelled learning: a linear numpy model over hashed words.

The positives are all confirmed toxic texts. The unlabelled set is all texts that aren't confirmed, whether someone called them clean
or nobody looked; none counts as clean. With p, the share of toxic texts among the unlabelled, the risk is
p R+(positives) + max(0, R-(unlabelled) - p R-(positives)): the second part estimates the risk on clean texts and is kept from turning
negative, which would be overfitting; where it does, its gradient is followed back instead. The decision threshold has the least
non-negative risk of the same form with the zero-one loss. Only words that are more frequent in positives than in the unlabelled set
(`selected`) have weights. That a row was labelled clean enters in one number alone, p.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from .scratch import Scratch, free_name
from .textnum import NOT_ALNUM, chunks, words

BITS = 20
#: A feature counts if it is found in so many texts, and so many standard deviations more often in positive ones.
LEAST_TEXTS, LEAST_Z = 5, 4.0
#: Steps of Adam over all rows, the first step's length, and the steps after which it is halved.
STEPS, RATE, HALF = 80, 0.3, 20
#: The threshold lies between two cells of logits of this width.
CELL = 1 / 1024
#: A step has a task for so many distinct rows, but no fewer than TASKS. So many ids of positives at most are broadcast, more are joined by a shuffle.
TASK_ROWS, TASKS, BROADCAST_ROWS = 250_000, 6, 500_000


def features(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(text, feature) of the distinct words of each text, A-Z lower-cased, without ASCII punctuation, and of the first four,
    five and six bytes of longer words."""
    w = words(texts, NOT_ALNUM)
    text, value = zip((w.text, w.hash), *map(w.prefixes, (4, 5, 6)), strict=True)
    key = np.unique((np.concatenate(text).astype(np.uint64) << np.uint64(BITS)) | (np.concatenate(value) >> np.uint64(64 - BITS)))
    return (key >> np.uint64(BITS)).astype(np.int64), (key & np.uint64((1 << BITS) - 1)).astype(np.int64)


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(feature, p, u): the positive and the other texts that hold each feature; with -1 all texts."""
    total, n = np.zeros((2, 1 << BITS), np.int32), np.zeros(2, np.int64)
    for batch in batches:
        toxic = np.asarray(batch["toxic"])
        for a, b in chunks(batch["text"]):
            text, feature = features(batch["text"].slice(a, b - a))
            n += np.bincount(toxic[a:b], minlength=2)
            # A chunk has far fewer pairs than there are features.
            np.add.at(total, (toxic[a:b][text], feature), 1)
    used = np.flatnonzero(total.any(0))
    sums = (np.append(total[k][used].astype(np.int64), n[k]) for k in (1, 0))
    yield pa.RecordBatch.from_arrays([pa.array(np.append(used, -1)), *map(pa.array, sums)], ["feature", "p", "u"])


def _only(batches: Iterator[pa.RecordBatch], shared) -> Iterator[pa.RecordBatch]:
    """(toxic, f): the places of the selected features that each text holds, as packed int32 in order."""
    place = np.full(1 << BITS, -1, np.int32)
    place[shared.value] = np.arange(len(shared.value))
    for batch in batches:
        for a, b in chunks(batch["text"]):
            text, feature = features(batch["text"].slice(a, b - a))
            held = place[feature] >= 0
            ends = 4 * np.cumsum(np.bincount(text[held], minlength=b - a))
            packed = pa.Array.from_buffers(pa.binary(), b - a, [None, pa.py_buffer(np.append(0, ends).astype(np.int32)), pa.py_buffer(place[feature[held]])])
            yield pa.RecordBatch.from_arrays([batch["toxic"].slice(a, b - a), packed], ["toxic", "f"])


def selected(positive: np.ndarray, unlabelled: np.ndarray, n: int, m: int) -> np.ndarray:
    """Which features count, from the texts that hold them among n positive and m unlabelled ones."""
    n, m = max(1, n), max(1, m)
    both = (positive + unlabelled) / (n + m)
    with np.errstate(divide="ignore", invalid="ignore"):
        z = np.nan_to_num((positive / n - unlabelled / m) / np.sqrt(both * (1 - both) * (1 / n + 1 / m)))
    return (positive + unlabelled >= LEAST_TEXTS) & (z >= LEAST_Z)


def pu_risk(zp: np.ndarray, zu: np.ndarray, prior: float) -> tuple[float, float, np.ndarray, np.ndarray]:
    """(p R+, R- on the unlabelled less p R- on the positives, step for zp, step for zu) with the logistic loss at logits of positives and unlabelled.
    The steps are the gradient of the sum, or where the second part is negative, of that part with its sign turned."""
    sigmoid = lambda z: 1 / (1 + np.exp(-np.clip(z, -40, 40)))
    positive, negative = prior * np.logaddexp(0, -zp).mean(), np.logaddexp(0, zu).mean() - prior * np.logaddexp(0, zp).mean()
    if negative >= 0:
        return positive, negative, prior * (-sigmoid(-zp) - sigmoid(zp)) / len(zp), sigmoid(zu) / len(zu)
    return positive, negative, prior * sigmoid(zp) / len(zp), -sigmoid(zu) / len(zu)


def threshold(zp: np.ndarray, zu: np.ndarray, prior: float) -> float:
    """The logit between two neighbouring ones at which the non-negative PU risk of the zero-one loss is least: p FNR + max(0, share of the
    unlabelled above - p TPR). Of equal ones that in the widest gap, then the highest."""
    values, at = np.unique(np.concatenate((zp, zu)), return_inverse=True)
    p, u = (np.bincount(x, minlength=len(values)) for x in (at[: len(zp)], at[len(zp) :]))
    return least_risk(values, values, p, u, prior)


def least_risk(low: np.ndarray, high: np.ndarray, p: np.ndarray, u: np.ndarray, prior: float) -> float:
    """`threshold` for rising groups of logits, each from low to high with p positives and u unlabelled ones; it lies behind one of them."""
    gaps = np.append(low[1:] - high[:-1], 2.0)
    cuts = high + gaps / 2
    miss, above = np.cumsum(p) / p.sum(), 1 - np.cumsum(u) / u.sum()
    risk = prior * miss + np.maximum(0, above - prior * (1 - miss))
    least = np.flatnonzero(risk <= risk.min() + 1e-12)
    return float(cuts[least[::-1][np.argmax(gaps[least[::-1]])]])


class Rows:
    """Distinct rows of features with how many positives and unlabelled texts (columns 1 and 0 of n) each stands for."""

    def __init__(self, packed: pa.Array | list[bytes], n: np.ndarray):
        packed = packed if isinstance(packed, pa.Array) else pa.array(packed, pa.binary())
        _, ends, data = packed.buffers()
        ends = np.frombuffer(ends, np.int32)[packed.offset : packed.offset + len(packed) + 1]
        self.n, self.flat = n.astype(float), np.frombuffer(data or b"", np.uint8)[ends[0] : ends[-1]].view(np.int32)
        self.row = np.repeat(np.arange(len(packed)), np.diff(ends) // 4)

    def logits(self, theta: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, weights=theta[self.flat], minlength=len(self.n)) + theta[-1]

    def sums(self, theta: np.ndarray) -> np.ndarray:
        """For unlabelled, then positives: the sum of softplus(z), of sigmoid(z) by feature, and of sigmoid(z)."""
        z = self.logits(theta)
        s = self.n / (1 + np.exp(-np.clip(z, -40, 40)))[:, None]
        return np.array([[self.n[:, k] @ np.logaddexp(0, z), *np.bincount(self.flat, weights=s[self.row, k], minlength=len(theta) - 1), s[:, k].sum()] for k in (0, 1)])

    def cells(self, theta: np.ndarray) -> np.ndarray:
        """(cell, least logit, greatest logit, unlabelled, positives) of each cell that holds a logit."""
        z = self.logits(theta)
        cell, at = np.unique(np.floor(z / CELL), return_inverse=True)
        low, high = np.full(len(cell), np.inf), np.full(len(cell), -np.inf)
        np.minimum.at(low, at, z)
        np.maximum.at(high, at, z)
        return np.stack([cell, low, high, *(np.bincount(at, self.n[:, k], len(cell)) for k in (0, 1))], 1)


def merged(cells: np.ndarray) -> tuple[np.ndarray, ...]:
    """(low, high, positives, unlabelled) of the cells of all tasks."""
    cells = cells[np.argsort(cells[:, 0], kind="stable")]
    first = np.flatnonzero(np.concatenate(([True], cells[1:, 0] != cells[:-1, 0])))
    low, high = np.minimum.reduceat(cells[:, 1], first), np.maximum.reduceat(cells[:, 2], first)
    u, p = (np.add.reduceat(cells[:, k], first) for k in (3, 4))
    return low, high, p, u


def descend(sums, held: np.ndarray, sizes: tuple[float, float], prior: float, l2: float = 1e-4) -> np.ndarray:
    """Weights, then bias, of least non-negative PU risk with the logistic loss, by Adam over all rows. sums(theta): see Rows.sums, of all rows; held:
    the positives that hold each feature; sizes: unlabelled, positives. The steps are those of `pu_risk`; since sigmoid(z) + sigmoid(-z) = 1, the
    first part's gradient needs only `held`."""
    theta = np.zeros(len(held) + 1)
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    for step in range(1, STEPS + 1):
        (loss_u, *unlabelled), (loss_p, *positive) = sums(theta)
        unlabelled, positive = np.array(unlabelled) / sizes[0], np.array(positive) / sizes[1]
        if loss_u / sizes[0] - prior * loss_p / sizes[1] >= 0:
            grad = unlabelled - prior * np.append(held / sizes[1], 1)
        else:
            grad = prior * positive - unlabelled
        grad[:-1] += l2 * theta[:-1]
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad**2
        theta -= RATE * 0.5 ** (step / HALF) * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return theta


def fit_nnpu(positive: list[np.ndarray], unlabelled: list[np.ndarray], prior: float) -> tuple[np.ndarray, np.ndarray, float]:
    """(features, weights, bias) of the model of least non-negative PU risk for rows in memory; 0 is its threshold."""
    df = [np.bincount(np.concatenate([*s, np.zeros(0, np.int64)]).astype(np.int64), minlength=1 << BITS) for s in (positive, unlabelled)]
    used = np.flatnonzero(selected(df[0], df[1], len(positive), len(unlabelled)))
    if not positive or not unlabelled:
        return used, np.zeros(len(used)), -4.0
    place = np.full(1 << BITS, -1, np.int32)
    place[used] = np.arange(len(used))
    packed = [p[p >= 0].tobytes() for p in (place[r] for r in [*positive, *unlabelled])]
    rows = Rows(packed, np.repeat([[0, 1], [1, 0]], [len(positive), len(unlabelled)], axis=0))
    theta = descend(rows.sums, df[0][used], (len(unlabelled), len(positive)), prior)
    return used, theta[:-1], float(theta[-1]) - least_risk(*merged(rows.cells(theta)), prior)


def _of_rows(batches: Iterator[pa.RecordBatch], shared, what: str) -> Iterator[pa.RecordBatch]:
    """One row: Rows.sums or Rows.cells over the task's rows, as bytes."""
    total = []
    for batch in batches:
        rows = Rows(batch["f"], np.stack([np.asarray(batch[c]) for c in ("u", "p")], 1))
        total.append(getattr(rows, what)(shared.value))
        if what == "sums":
            total = [sum(total)]
    if total:
        yield pa.RecordBatch.from_arrays([pa.array([np.concatenate(total).tobytes()], pa.binary())], ["z"])


def logits(model: tuple[np.ndarray, np.ndarray, float], text: np.ndarray, feature: np.ndarray, n: int) -> np.ndarray:
    used, weight, bias = model
    at = np.minimum(np.searchsorted(used, feature), max(0, len(used) - 1))
    w = np.where(used[at] == feature, weight[at], 0.0) if len(used) else np.zeros(len(feature))
    return np.bincount(text, weights=w, minlength=n) + bias


def train(docs: DataFrame, labels: DataFrame, held_out: int = 0) -> dict:
    """The model. docs: doc_id, text; labels: doc_id, toxic. Rows whose crc32(doc_id as text) mod 5 is `held_out`, and rows
    with null ids, take no part; all others do.

    Positive are the texts of ids with a label over 0; all others are unlabelled. Features are counted over all texts. Rows of the
    selected features are written once, equal ones with a count; each step of the descent sums its gradient over them in the cluster. What reaches the
    driver is the features that positives hold (2**20 at most), gradients, and counts by cell of the logit for the threshold.

    Of the labelled ids a share q is over 0; if labels are given to ids at random, the ids that nobody labelled hold
    as large a share, which gives p among all that aren't confirmed. Where all labels are over 0, q is their share of the documents. Of
    labels that contradict each other the highest counts, null labels don't. Without labels over 0 all scores are those of an empty
    model (clean)."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "toxicity")
    side = F.expr(f"crc32(cast(doc_id as string)) % 5 <> {held_out}")
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where(side).where("toxic is not null")
    known = known.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    n, toxic = known.agg(F.count(F.lit(1)), F.coalesce(F.sum((F.col("toxic") > 0).cast("long")), F.lit(0))).first()
    ids = docs.select("doc_id").where(side).distinct()
    total = max(ids.count(), n, 1)
    q = toxic / (n if toxic < n else total) if n else 0.0
    prior = min(max(q * (total - n) / max(total - toxic, 1), 1e-3), 0.9)
    positive = known.where("toxic > 0").select("doc_id", F.lit(1).alias("toxic"))
    positive = F.broadcast(positive) if toxic <= BROADCAST_ROWS else positive
    marked = docs.select("doc_id", "text").where(side).join(positive, "doc_id", "left").select(F.coalesce("toxic", F.lit(0)).alias("toxic"), "text")
    df = scratch.keep(marked.mapInArrow(_counts, "feature long, p long, u long").groupBy("feature").agg(F.sum("p").alias("p"), F.sum("u").alias("u")))
    sizes = [(r.u or 0, r.p or 0) for r in df.where("feature = -1").collect()] or [(0, 0)]
    if not all(sizes[0]):
        return {"used": np.zeros(0, np.int32), "weight": np.zeros(0, np.float32), "bias": -4.0, "prior": prior}
    df = df.where(f"feature >= 0 and p + u >= {LEAST_TEXTS} and p > 0").orderBy("feature").toArrow()
    held, others = np.asarray(df["p"]), np.asarray(df["u"])
    counted = selected(held, others, sizes[0][1], sizes[0][0])
    used, held = np.asarray(df["feature"])[counted], held[counted]
    del df
    shared = scratch.share(used)
    rows = marked.mapInArrow(partial(_only, shared=shared), "toxic int, f binary").groupBy("f")
    rows = scratch.keep(rows.agg(F.sum(1 - F.col("toxic")).alias("u"), F.sum("toxic").alias("p")))
    dealt = rows.coalesce(max(TASKS, rows.count() // TASK_ROWS))
    scratch.free()

    def of_rows(theta: np.ndarray, what: str) -> list[np.ndarray]:
        shared = scratch.share(theta)
        out = [np.frombuffer(r.z, float) for r in dealt.mapInArrow(partial(_of_rows, shared=shared, what=what), "z binary").collect()]
        scratch.free()
        return out

    theta = descend(lambda theta: sum(of_rows(theta, "sums")).reshape(2, -1), held, sizes[0], prior)
    cells = np.concatenate([x.reshape(-1, 5) for x in of_rows(theta, "cells")])
    bias = float(theta[-1]) - least_risk(*merged(cells), prior)
    return {"used": used.astype(np.int32), "weight": theta[:-1].astype(np.float32), "bias": bias, "prior": prior}


def _scored(batches: Iterator[pa.RecordBatch], model, text: int, columns: list[int], names: list[str]) -> Iterator[pa.RecordBatch]:
    m = model.value
    model_of = m["used"], m["weight"].astype(np.float64), m["bias"]
    for batch in batches:
        parts = []
        for a, b in chunks(batch[text]):
            z = logits(model_of, *features(batch[text].slice(a, b - a)), b - a)
            parts.append(1 / (1 + np.exp(-np.clip(z, -40, 40))))
        yield pa.RecordBatch.from_arrays([*(batch[c] for c in columns), pa.array(np.concatenate([*parts, np.zeros(0)]))], names)


def score(docs: DataFrame, model: Broadcast, text_col: str = "text", score_col: str = "toxicity__score", keep: list[str] | None = None) -> DataFrame:
    """The columns `keep` of `docs` (all, unless named) and `score_col`, 0 to 1: at 0.5 or more the text is taken for toxic. The only input is
    the text; a null or empty one, or one without known words, gets the score of the bias. Every row is returned, and a column named as
    `score_col` is replaced. Columns that aren't kept don't come back from the workers. `model` is a broadcast of what `train` returns."""
    names = [c for c in (docs.columns if keep is None else keep) if c != score_col]
    schema = StructType([*(docs.schema[c] for c in names), StructField(score_col, DoubleType())])
    inner, text = docs.select(*names), names.index(text_col) if text_col in names else len(names)
    if text == len(names) or schema[text].dataType != StringType():
        inner, text = docs.select(*names, F.col(text_col).cast("string").alias(free_name(names, "toxicity__text"))), len(names)
    return inner.mapInArrow(partial(_scored, model=model, text=text, columns=list(range(len(names))), names=[*names, score_col]), schema)


def op4(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted for each row of documents. A null id is not held out. Without labels the scores are
    those of an empty model (all clean). No rows give none."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    scratch = Scratch(docs.sparkSession, "toxicity")
    scored = scratch.keep(score(docs, scratch.share(train(docs, labels)), score_col="score", keep=["doc_id"]))
    scratch.free()
    held = F.coalesce(F.expr("crc32(cast(doc_id as string)) % 5 = 0"), F.lit(False))
    return scored.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
