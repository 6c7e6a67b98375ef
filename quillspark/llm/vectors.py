"""Near-duplicate vectors: cross-polytope hashing after fast Hadamard rotations, multiprobe, every candidate verified.

A rotation is three rounds of random signs and a Walsh-Hadamard transform; a hash is the coordinate of greatest size with
its sign; a table's bucket is two hashes. Each vector enters its bucket and, as a probe, the bucket in which the less
certain of the two hashes takes its second choice, in each of 12 tables. Vectors of equal components are one node with a
count. Buckets are cut into blocks of 256 nodes, and a task compares two blocks of a bucket at a time by a matrix product,
so no bucket, however large, has to meet in one task, and no pairs leave a task: only sums of links and a spanning forest.
A pair that shares several buckets counts in the one of least key.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache, partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .scratch import Scratch
from .textnum import mix

TABLES, HASHES, BLOCK = 12, 2, 256


@lru_cache(8)
def _signs(width: int) -> np.ndarray:
    return np.random.Generator(np.random.PCG64(width)).choice([-1.0, 1.0], (TABLES, HASHES, 3, width))


def hadamard(x: np.ndarray) -> np.ndarray:
    """The orthonormal Walsh-Hadamard transform of rows whose width is a power of two."""
    n, width = x.shape
    h = 1
    while h < width:
        x = x.reshape(n, width // (2 * h), 2, h)
        x = np.stack((x[:, :, 0] + x[:, :, 1], x[:, :, 0] - x[:, :, 1]), 2).reshape(n, width)
        h *= 2
    return x / np.sqrt(width)


def keys(x: np.ndarray) -> np.ndarray:
    """(n x 24) uint64: for each table the key of a unit vector's bucket and that of its probe."""
    n, dim = x.shape
    width = max(2, 1 << (dim - 1).bit_length())
    x = np.concatenate((x, np.zeros((n, width - dim))), 1)
    out, rows = np.empty((n, TABLES, 2), np.uint64), np.arange(n)
    for t in range(TABLES):
        first, second, gap = [], [], []
        for k in range(HASHES):
            y = x
            for signs in _signs(width)[t, k]:
                y = hadamard(y * signs)
            size = np.abs(y)
            a = size.argmax(1)
            top = size[rows, a]
            size[rows, a] = -1
            b = size.argmax(1)
            first.append(2 * a + (y[rows, a] < 0))
            second.append(2 * b + (y[rows, b] < 0))
            gap.append(top - size[rows, b])
        turn = gap[0] <= gap[1]
        both = [(first[0], first[1]), (np.where(turn, second[0], first[0]), np.where(turn, first[1], second[1]))]
        for p, (h, g) in enumerate(both):
            with np.errstate(over="ignore"):
                out[:, t, p] = mix(((np.uint64(t + 1) * np.uint64(1 << 20) + h.astype(np.uint64)) * np.uint64(1 << 22) + g.astype(np.uint64)) * np.uint64(4099) + np.uint64(dim))
    return out.reshape(n, -1)


def unit(lists: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, unit vectors in double precision) by dimension, of valid vectors."""
    size = np.diff(np.asarray(lists.offsets))
    flat = np.asarray(lists.values).astype(float)
    start = np.asarray(lists.offsets)[:-1] - (lists.offsets[0].as_py() if len(lists.offsets) else 0)
    flat = flat[lists.offsets[0].as_py() :] if len(lists.offsets) else flat
    for d in np.unique(size).tolist():
        rows = np.flatnonzero(size == d)
        x = flat[start[rows][:, None] + np.arange(d)]
        x = x / np.abs(x).max(1, keepdims=True)
        yield rows, x / np.sqrt((x * x).sum(1, keepdims=True))


def _keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for rows, x in unit(batch["v"]):
            k = keys(x)
            own = [np.unique(r) for r in k]
            count = np.array([len(r) for r in own])
            yield pa.RecordBatch.from_arrays([batch["node"].take(pa.array(np.repeat(rows, count))), pa.array(np.concatenate(own).view(np.int64))], ["node", "key"])


def _forest(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least row that each of n rows reaches by links a-b."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def _compared(batches: Iterator[pa.RecordBatch], least: float) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (key, i, j); a group lies in one task, but may be cut by a batch's end."""
    held: pa.Table | None = None

    def work(t: pa.Table) -> Iterator[pa.RecordBatch]:
        t = t.combine_chunks()
        key, i, j = (np.asarray(t[c]) for c in ("key", "i", "j"))
        node, weight, block = (np.asarray(t[c]) for c in ("node", "copies", "block"))
        edge = np.concatenate(([True], (key[1:] != key[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])))
        first = np.append(np.flatnonzero(edge), len(key))
        vector = next((x for _, x in unit(t["v"].combine_chunks())), None) if len(set(np.diff(np.asarray(t["v"].combine_chunks().offsets)))) == 1 else None
        many = None
        if vector is None:  # several dimensions: a key's vectors have one
            many = {int(r): x for rows, xs in unit(t["v"].combine_chunks()) for r, x in zip(rows, xs, strict=True)}
        found: list[tuple[np.ndarray, np.ndarray]] = []
        for s, e in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
            if e - s < 2:
                continue
            x = vector[s:e] if many is None else np.array([many[r] for r in range(s, e)])
            cross = i[s] != j[s]
            a, b = np.nonzero(np.triu(x @ x.T >= least, 1) & ((block[s:e, None] != block[None, s:e]) if cross else True))
            if len(a):
                found.append((a + s, b + s))
        if not found:
            return
        a, b = (np.concatenate(x) for x in zip(*found, strict=True))
        own, where = np.unique(np.concatenate((a, b)), return_inverse=True)
        all_keys = np.empty((len(own), 2 * TABLES), np.uint64)
        if many is None:
            all_keys[:] = keys(vector[own])
        else:
            for r, row in enumerate(own.tolist()):
                all_keys[r] = keys(many[row][None])[0]
        ka, kb = where[: len(a)], where[len(a) :]
        on = np.zeros(len(a), bool)
        for s in range(0, len(a), 20_000):
            u, v = all_keys[ka[s : s + 20_000]], all_keys[kb[s : s + 20_000]]
            shared = np.where((u[:, :, None] == v[:, None, :]).any(2), u, np.uint64(2**64 - 1)).min(1)
            on[s : s + 20_000] = shared == key[a[s : s + 20_000]].view(np.uint64)
        a, b = a[on], b[on]
        if not len(a):
            return
        ids, place = np.unique(node[np.concatenate((a, b))], return_inverse=True)
        pa_, pb = place[: len(a)], place[len(a) :]
        links = np.bincount(pa_, weight[b], len(ids)) + np.bincount(pb, weight[a], len(ids))
        yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(links.astype(np.int64)), pa.array(ids[_forest(len(ids), pa_, pb)])], ["node", "links", "to"])

    for batch in batches:
        t = pa.Table.from_batches([batch])
        held = t if held is None else pa.concat_tables([held, t])
        if len(held) < 4 * BLOCK:
            continue
        last = [held[c][-1].as_py() for c in ("key", "i", "j")]
        k, i, j = (np.asarray(held[c]) for c in ("key", "i", "j"))
        same = np.flatnonzero(~((k == last[0]) & (i == last[1]) & (j == last[2])))
        cut = int(same[-1]) + 1 if len(same) else 0
        if cut:
            yield from work(held.slice(0, cut))
        held = held.slice(cut)
    if held is not None and len(held):
        yield from work(held)


def near_vectors(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", least: float = 0.95) -> DataFrame:
    """One row per row of `rows`: vec_id, n_links, component_id, kept; links are found pairs of cosine >= least, in double precision.

    Vectors that are null, empty or zero, or hold null or non-finite components, and vectors of different dimensions, are not linked;
    they are components of their own. Rows with a null id count as no vector: n_links 0, component_id null, kept true.
    Repeated rows are linked with each other. Other columns are not read. No rows give none."""
    spark = rows.sparkSession
    scratch = Scratch(spark, "vectors")
    rows = rows.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v"))
    sound = F.col("vec_id").isNotNull() & F.coalesce(F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0), F.lit(False))
    rows = rows.withColumn("node", F.when(sound, F.xxhash64("v")))
    nodes = scratch.keep(rows.where("node is not null").groupBy("node").agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("copies"), F.first("v").alias("v")))
    keyed = scratch.keep(nodes.select("node", "v").mapInArrow(_keyed, "node long, key long"))
    blocks = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("m")).where("m > 1").select("key", F.ceil(F.col("m") / BLOCK).cast("int").alias("blocks"))
    member = keyed.join(blocks, "key").withColumn("block", F.pmod(F.xxhash64("node", F.lit(1)), F.col("blocks")).cast("int"))
    member = member.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    member = member.select("node", "key", "block", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"))
    met = member.join(nodes.select("node", "copies", "v"), "node").select("node", "copies", "v", "key", "block", "i", "j")
    met = met.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")
    linked = scratch.keep(met.mapInArrow(partial(_compared, least=least), "node long, links long, to long"))
    links = linked.groupBy("node").agg(F.sum("links").alias("links"))
    tied = components(linked.select(F.col("node").alias("x"), F.col("to").alias("y")), scratch)
    named = nodes.select("node", "rep", "copies").join(tied, "node", "left").withColumn("component", F.coalesce("component", "node"))
    named = scratch.keep(named.join(links, "node", "left").select("node", "rep", "component", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links")))
    named = named.join(named.groupBy("component").agg(F.min("rep").alias("component_id")), "component").select("node", "n_links", "component_id")
    return rows.select("vec_id", "node").join(named, "node", "left").select(
        "vec_id",
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.coalesce("component_id", "vec_id").alias("component_id"),
        F.coalesce(F.coalesce("component_id", "vec_id") == F.col("vec_id"), F.lit(True)).alias("kept"),
    )
