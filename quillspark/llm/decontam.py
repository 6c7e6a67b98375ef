"""Benchmark decontamination by latent semantic retrieval, with longest-common-subsequence and answer checks.

Words are hashed to 2**14 features, weighted by inverse document frequency over all documents. A distributed randomised SVD of TF-IDF passages
(random test vectors, one power iteration, then Nystrom's small eigenproblem) gives a whitened latent space. Its passages are those of every
document and of every item. The texts are read once for it: word counts of passages are written as packed arrays, which both passes
of the decomposition read. The search is over everything too: every window of every document, at scales of 32 words and four times more until
they are a third of the longest item, is compared with every item by cosine, and near ones are verified on the words themselves: the longest
common subsequence of item and surroundings must hold 80 % of the item's words, or 60 % if also the item's answer, its last sentence, is there whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

from .scratch import Scratch, free_name
from .textnum import Words, chunks, words

BITS, RANK, EXTRA = 14, 64, 8
#: A pass of the SVD has a task for so many chunks, but no fewer than TASKS; its sums are in so many blocks of features,
#: summed in so many tasks at least, and a fourth of the tasks that bring them.
TASK_CHUNKS, TASKS, SUM_BLOCKS, SUM_TASKS = 256, 8, 64, 8
#: Chunks that are multiplied at once, and the word counts whose vectors are held at once, so that they stay in a core's cache.
PRODUCT_CHUNKS, PRODUCT_BLOCK = 16, 1024
PASSAGE, FIRST_SCALE = 64, 32
LEAST_COSINE, LEAST_SHARE, LEAST_SHARE_WITH_ANSWER = 0.35, 0.8, 0.6
#: Of the lesser idf sum of window and item, so much must be of words of both before the subsequence is computed.
LEAST_OVERLAP = 0.4
#: Items are searched in blocks of so many; each block is one pass over the documents.
ITEM_BLOCK = 4096
#: Windows and pairs are compared in blocks of so many, small enough that their arrays are reused and not mapped anew.
WINDOW_BLOCK, PAIR_BLOCK = 1024, 2048
#: Bytes of text taken at once, so that the arrays stay in a core's cache.
CHUNK = 1 << 17


def feature(w: Words) -> np.ndarray:
    return (w.hash >> np.uint64(64 - BITS)).astype(np.int64)


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(feature, n, passages): the packed passages of each chunk, with feature -2 and n 1; at the end the texts that hold each feature,
    with -1 the texts."""
    total, n = np.zeros(1 << BITS, np.int64), 0
    for batch in batches:
        packed = []
        for a, b in chunks(batch["text"], CHUNK):
            w = words(batch["text"].slice(a, b - a))
            n += b - a
            if len(w.hash):
                text, parts = _passages(w)
                packed.append(parts)
                total += np.bincount(text, minlength=1 << BITS)
        if packed:
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(packed), -2)), pa.array(np.ones(len(packed), np.int64)), pa.array(packed, pa.binary())], ["feature", "n", "passages"])
    used = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(np.append(used, -1)), pa.array(np.append(total[used], n)), pa.nulls(len(used) + 1, pa.binary())], ["feature", "n", "passages"])


def _passages(w: Words) -> tuple[np.ndarray, bytes]:
    """Of a chunk with words: the feature of each pair of a text and one of its features, and the consecutive passages of each text, packed: how many there
    are, the features in each, then feature and count of each."""
    counts = w.counts()
    within = np.arange(len(w.hash)) - np.repeat(np.cumsum(counts) - counts, counts)
    first = within % PASSAGE == 0
    row = np.cumsum(first) - 1
    key = ((row << BITS) | feature(w)).astype(np.int32 if row[-1] < 1 << 31 - BITS - 1 else np.int64)
    key.sort()
    at = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
    row, f, tf = key[at] >> BITS, key[at] & ((1 << BITS) - 1), np.diff(np.append(at, len(key)))
    sizes = np.bincount(row)
    # A text's features, of all its passages.
    pair = ((w.text[first][row].astype(np.int64)) << BITS) | f
    pair.sort()
    distinct = pair[np.concatenate(([True], pair[1:] != pair[:-1]))] & ((1 << BITS) - 1)
    return distinct, np.uint32(len(sizes)).tobytes() + sizes.astype(np.uint8).tobytes() + f.astype("<u2").tobytes() + tf.astype(np.uint8).tobytes()


def _unpacked(packed: memoryview) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(features in each passage, feature, count)."""
    n = int(np.frombuffer(packed, "<u4", 1)[0])
    sizes = np.frombuffer(packed, np.uint8, n, 4).astype(np.int64)
    f = np.frombuffer(packed, np.uint8, 2 * int(sizes.sum()), 4 + n).view("<u2")
    return sizes, f, np.frombuffer(packed, np.uint8, len(f), 4 + n + 2 * len(f))


def _products(batches: Iterator[pa.RecordBatch], shared) -> Iterator[pa.RecordBatch]:
    """A'A Q for the task's passages A (unit TF-IDF vectors), in blocks of features; blocks without a word of the task are left out."""
    idf, q = shared.value
    out = np.zeros(q.shape, np.float64)
    held = np.empty((PRODUCT_BLOCK, q.shape[1]), np.float32)
    for batch in batches:
        for at in range(0, batch.num_rows, PRODUCT_CHUNKS):
            packed = [_unpacked(memoryview(x.as_buffer())) for x in batch["passages"].slice(at, PRODUCT_CHUNKS)]
            sizes, f, tf = map(np.concatenate, zip(*packed, strict=True))
            row, weight = np.repeat(np.arange(len(sizes)), sizes), tf * idf[f]
            norm = np.sqrt(np.maximum(np.add.reduceat(weight * weight, np.cumsum(sizes) - sizes), 1e-24))
            weight = (weight / norm[row]).astype(np.float32)
            y = np.zeros((len(sizes), q.shape[1]), np.float32)
            _add_rows(y, row, q, f, weight, held)
            order = np.argsort(f, kind="stable")
            _add_rows(out, f[order], y, row[order], weight[order], held)
    parts = out.reshape(SUM_BLOCKS, -1)
    used = np.flatnonzero(parts.any(1))
    yield pa.RecordBatch.from_arrays([pa.array(used), pa.array([parts[i].astype(np.float32).tobytes() for i in used], pa.binary())], ["block", "z"])


def _add_rows(to: np.ndarray, at: np.ndarray, table: np.ndarray, rows: np.ndarray, weight: np.ndarray, held: np.ndarray) -> None:
    """to[at] += weight * table[rows], for rising `at`, which may repeat."""
    for a in range(0, len(at), len(held)):
        own = at[a : a + len(held)]
        part = np.take(table, rows[a : a + len(held)], axis=0, out=held[: len(own)], mode="clip")
        part *= weight[a : a + len(held), None]
        first = np.flatnonzero(np.concatenate(([True], own[1:] != own[:-1])))
        to[own[first]] += np.add.reduceat(part, first, axis=0)


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The sum of each block that is dealt to the task."""
    total: dict[int, np.ndarray] = {}
    for batch in batches:
        for block, z in zip(batch["block"].to_pylist(), batch["z"], strict=True):
            total[block] = total.get(block, 0) + np.frombuffer(z.as_buffer(), np.float32).astype(float)
    yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int64()), pa.array([x.tobytes() for x in total.values()], pa.binary())], ["block", "z"])


def fit(docs: DataFrame, items: DataFrame, scratch: Scratch, sample_texts: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(idf, projection): the latent space of the passages of all `items` and all `docs` (doc_id, text), rows with null ids too. With `sample_texts`
    the passages are those of so many documents, whose ids have the least hashes, and of all items; idf is of all documents anyway. Two
    passes over the packed passages sum their products in the cluster, so that only the sums of 2**14 x 72 numbers reach the driver."""
    schema = "feature long, n long, passages binary"
    counted = scratch.keep(docs.select("text").mapInArrow(_counted, schema))
    df, n, packed = np.zeros(1 << BITS), 0, 0
    for r in counted.groupBy("feature").agg(F.sum("n").alias("n")).collect():
        if r.feature >= 0:
            df[r.feature] = r.n
        elif r.feature == -1:
            n = r.n
        else:
            packed = r.n
    idf = np.log((n + 1) / (df + 1)) + 0.01
    if sample_texts is not None:
        order = F.xxhash64("doc_id", F.lit(29))
        chosen = docs.select("doc_id").where("doc_id is not null").distinct().orderBy(order, "doc_id").limit(sample_texts)
        counted = scratch.keep(docs.join(F.broadcast(chosen), "doc_id").select("text").mapInArrow(_counted, schema))
    own = scratch.keep(items.select("text").coalesce(1).mapInArrow(_counted, schema))
    # A task brings up to 5 MB of sums, so a small table has few.
    tasks = max(TASKS, packed // TASK_CHUNKS)
    every = counted.union(own).where("feature = -2").select("passages").coalesce(tasks)

    def product(q: np.ndarray) -> np.ndarray:
        shared = scratch.share((idf, q.astype(np.float32)))
        parts = every.mapInArrow(partial(_products, shared=shared), "block long, z binary").repartition(min(SUM_BLOCKS, max(SUM_TASKS, tasks // 4)), "block")
        out = np.zeros((SUM_BLOCKS, q.size // SUM_BLOCKS))
        for r in parts.mapInArrow(_summed, "block long, z binary").collect():
            out[r.block] = np.frombuffer(r.z, np.float64)
        scratch.free()
        return out.reshape(q.shape)

    q = np.random.Generator(np.random.PCG64(31)).normal(size=(1 << BITS, RANK + EXTRA))
    q = np.linalg.qr(product(q))[0]
    return idf.astype(np.float32), whitened(q, product(q))


def whitened(q: np.ndarray, z: np.ndarray) -> np.ndarray:
    """The first RANK eigenvectors of G, each over the root of its eigenvalue, by Nystrom's approximation z (q'z)^-1 z' with z = G q, whose range is that of
    another power iteration without another pass."""
    value, vector = np.linalg.eigh((q.T @ z + z.T @ q) / 2)
    keep = value > 1e-9 * max(1e-12, value[-1])
    u, root, _ = np.linalg.svd(z @ (vector[:, keep] / np.sqrt(value[keep])), full_matrices=False)
    keep = root[:RANK] > 1e-6 * max([1e-12, *root[:1]])
    return np.ascontiguousarray(u[:, :RANK][:, keep] / root[:RANK][keep], np.float32)


def answer(text: bytes) -> list[bytes]:
    """The words of an item's last sentence: what follows the last stop, question mark or line end before its final one."""
    body = text.strip().rstrip(b".!?").replace(b"?", b".").replace(b"!", b".").replace(b"\n", b".")
    return body.rpartition(b".")[2].lower().split()


class Index:
    """A block of items: words, places in the latent space, answers."""

    def __init__(self, ids: list[int], texts: list[str], idf: np.ndarray, projection: np.ndarray, exact_below: int = 8):
        self.exact_below = exact_below
        self.idf, self.projection, self.scaled = idf, projection, idf[:, None] * projection
        self.rows = np.ascontiguousarray(self.scaled, np.float32)
        w = words(pa.array(texts, pa.string()))
        ends = np.cumsum(w.counts())
        self.ids, self.words, self.answers = [], [], []
        places = []
        for i, (a, b) in enumerate(zip(ends - w.counts(), ends, strict=True)):
            if b > a:
                self.ids.append(ids[i])
                self.words.append(w.hash[a:b])
                self.answers.append(w.hash[b - min(b - a, max(1, len(answer(texts[i].encode())))) : b])
                f = feature(w)[a:b]
                places.append(self.scaled[f].sum(0))
        self.place = np.array(places, np.float32).reshape(len(places), projection.shape[1])
        self.place /= np.maximum(np.linalg.norm(self.place, axis=1, keepdims=True), 1e-12)
        longest = max([len(x) for x in self.words], default=0)
        self.scales = [FIRST_SCALE]
        while 3 * self.scales[-1] < longest:
            self.scales.append(4 * self.scales[-1])
        self.vocabulary, where = np.unique(np.concatenate([*self.words, np.zeros(0, np.uint64)]), return_inverse=True)
        item = np.repeat(np.arange(len(self.words)), [len(x) for x in self.words])
        self.member = np.zeros(max(1 << 20, 1 << (64 * len(item)).bit_length()), bool)
        self.member[self._slot(item, where)] = True
        self.weight = np.array([idf[(x >> np.uint64(64 - BITS)).astype(np.int64)].sum() for x in self.words])
        self.masks: list[dict[int, int] | None] = [None] * len(self.ids)
        self.distinct = [np.unique(x) for x in self.words]

    def _slot(self, item: np.ndarray, word: np.ndarray) -> np.ndarray:
        """Place of a pair in a hashed table; two pairs in one place only cost a needless verification."""
        x = item * 0x9E3779B1 + word * 0x85EBCA77
        return (x ^ (x >> 21)) & (len(self.member) - 1)

    def common(self, k: int, text: np.ndarray) -> int:
        """Length of the longest common subsequence of item k and a text (bit-parallel)."""
        if self.masks[k] is None:
            masks: dict[int, int] = {}
            for i, h in enumerate(self.words[k].tolist()):
                masks[h] = masks.get(h, 0) | 1 << i
            self.masks[k] = masks
        full = (1 << len(self.words[k])) - 1
        v, get = full, self.masks[k].get
        for h in text.tolist():
            m = get(h)
            if m is not None:
                u = v & m
                v = (v + u) | (v - u)
                v &= full
        return len(self.words[k]) - v.bit_count()

    def verified(self, k: int, text: np.ndarray) -> bool:
        own = self.words[k]
        d = self.distinct[k]
        at = np.minimum(d.searchsorted(text), len(d) - 1)
        hit = d[at] == text
        if np.count_nonzero(hit) < LEAST_SHARE_WITH_ANSWER * len(own) or np.count_nonzero(np.bincount(at[hit])) < LEAST_SHARE_WITH_ANSWER * 0.8 * len(d):
            return False
        share = self.common(k, text[hit]) / len(own)
        if len(own) < self.exact_below:
            return share == 1 and contains(text, own)
        return share >= LEAST_SHARE or (share >= LEAST_SHARE_WITH_ANSWER and len(self.answers[k]) >= 2 and contains(text, self.answers[k]))

    def found(self, h: np.ndarray, f: np.ndarray, first: np.ndarray) -> list[set[int]]:
        """Ids of the verified items of each text of a chunk; h, f: hashes and features of all words; first: bounds of texts."""
        out: list[set[int]] = [set() for _ in range(len(first) - 1)]
        if not len(h) or not self.ids:
            return out
        sizes = np.diff(first)
        # Sums of eight words each, from the start of each text; windows begin and end at these.
        within = np.arange(len(h)) - np.repeat(first[:-1], sizes)
        eight = np.concatenate(([0], np.cumsum(-(-sizes // 8))))
        begin = np.append(np.flatnonzero(within % 8 == 0), len(h))
        total, held = np.empty((int(eight[-1]), self.rows.shape[1]), np.float32), np.empty((PRODUCT_BLOCK, self.rows.shape[1]), np.float32)
        for a in range(0, len(total), PRODUCT_BLOCK // 8):
            own = begin[a : a + PRODUCT_BLOCK // 8 + 1]
            part = np.take(self.rows, f[own[0] : own[-1]], axis=0, out=held[: own[-1] - own[0]], mode="clip")
            np.add.reduceat(part, own[:-1] - own[0], axis=0, out=total[a : a + len(own) - 1])
        sums = np.zeros((len(total) + 1, total.shape[1]), np.float32)
        np.cumsum(total, axis=0, out=sums[1:])
        at = np.minimum(np.searchsorted(self.vocabulary, h), len(self.vocabulary) - 1)
        at = np.append(np.where(self.vocabulary[at] == h, at, -1), -1)
        idf = np.append(np.where(at[:-1] >= 0, self.idf[f], 0), 0)
        vocabulary_sums = np.concatenate(([0], np.cumsum(idf[:-1], dtype=np.float64)))
        idf_sums = np.concatenate(([0], np.cumsum(self.idf[f], dtype=np.float64)))
        for scale in self.scales:
            step = scale // 4
            count = np.where(sizes > 0, np.maximum(0, -(-(sizes - scale) // step)) + 1, 0)
            text = np.repeat(np.arange(len(sizes)), count)
            nth = np.arange(len(text)) - np.repeat(np.cumsum(count) - count, count)
            start = first[text] + step * nth
            low = eight[text] + step // 8 * nth
            high = np.minimum(low + scale // 8, eight[text + 1])
            end = np.minimum(start + scale, first[text + 1])
            # A window's words of any item bound those it shares with one, which rules most windows and pairs out.
            known, whole = vocabulary_sums[end] - vocabulary_sums[start] + 1e-6, idf_sums[end] - idf_sums[start]
            text, start, end, low, high, known, whole = (y[known >= LEAST_OVERLAP * np.minimum(self.weight.min(), whole)] for y in (text, start, end, low, high, known, whole))
            for s in range(0, len(text), WINDOW_BLOCK):
                x = sums[high[s : s + WINDOW_BLOCK]] - sums[low[s : s + WINDOW_BLOCK]]
                x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
                r, k = np.nonzero(x @ self.place.T >= LEAST_COSINE)
                able = known[s + r] >= LEAST_OVERLAP * np.minimum(self.weight[k], whole[s + r])
                near = r[able], k[able]
                kept: list[tuple[int, int]] = []
                for c in range(0, len(near[0]), PAIR_BLOCK):
                    r, k = (y[c : c + PAIR_BLOCK] for y in near)
                    a, b = start[s + r], end[s + r]
                    token = np.where((t := a[:, None] + np.arange(scale)) < b[:, None], t, len(h))
                    word = at[token]
                    both = np.where((word >= 0) & self.member[self._slot(k[:, None], word)], idf[token], 0).sum(1)
                    on = both >= LEAST_OVERLAP * np.minimum(self.weight[k], whole[s + r])
                    kept += zip(r[on].tolist(), k[on].tolist(), strict=True)
                for r, k in kept:
                    t, around = int(text[s + r]), len(self.words[k])
                    if self.ids[k] not in out[t]:
                        a, b = max(int(first[t]), int(start[s + r]) - around), min(int(first[t + 1]), int(end[s + r]) + around)
                        if self.verified(k, h[a:b]):
                            out[t].add(self.ids[k])
        return out


def contains(text: np.ndarray, part: np.ndarray) -> bool:
    at = np.flatnonzero(text[: len(text) - len(part) + 1] == part[0]) if len(part) <= len(text) else np.zeros(0, int)
    return any((text[i : i + len(part)] == part).all() for i in at.tolist())


def _flagged(batches: Iterator[pa.RecordBatch], shared, text: int, columns: list[int], names: list[str]) -> Iterator[pa.RecordBatch]:
    index = Index(*shared.value)
    for batch in batches:
        rows: list[list[int]] = []
        for a, b in chunks(batch[text], CHUNK):
            w = words(batch[text].slice(a, b - a))
            first = np.concatenate(([0], np.cumsum(w.counts())))
            rows += [sorted(x) for x in index.found(w.hash, feature(w), first)]
        yield pa.RecordBatch.from_arrays([*(batch[c] for c in columns), pa.array(rows, pa.list_(pa.int64()))], names)


def leaked(docs: DataFrame, items: DataFrame, scratch: Scratch, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text", out_col: str = "leaked_items", keep: list[str] | None = None, sample_texts: int | None = None, exact_below: int = 8) -> DataFrame:
    """The columns `keep` of `docs` (all, unless named) and `out_col`: the sorted ids of the items that the text holds (replacing a column of
    this name). `scratch` holds the broadcasts of what the result reads, to be freed when it is written.

    Every row and the whole text are searched; rows with null ids too. Null or empty texts hold nothing; items that are null, or
    without words, or with null ids are held by nothing; items of fewer words than `exact_below` are held only word for word, since a
    subsequence of a few words is found in any text. Of items that share an id each counts for the id. No rows give none; without
    items all lists are empty. The latent space is of all documents and items; with `sample_texts`, of so many documents and all items."""
    items = items.select(F.col(item_id).cast("long").alias("item_id"), F.coalesce(F.col(item_text).cast("string"), F.lit("")).alias("text")).where("item_id is not null")
    names = [c for c in (docs.columns if keep is None else keep) if c != out_col]
    n = items.count()
    if not n:
        return docs.select(*names, F.expr("cast(array() as array<bigint>)").alias(out_col))
    plain = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    idf, projection = fit(plain, items, scratch, sample_texts)
    blocks = -(-n // ITEM_BLOCK) if n <= ITEM_BLOCK else -(-2 * n // ITEM_BLOCK)
    text, before = (free_name([*docs.columns, out_col], c) for c in ("leaked__text", "leaked__before"))
    if text_col in names and docs.schema[text_col].dataType == StringType():
        text, own_text = text_col, []
    else:
        own_text = [F.col(text_col).cast("string").alias(text)]
    out = docs.select(*names, *own_text, F.expr("cast(array() as array<bigint>)").alias(before))
    for b in range(blocks):
        own = items.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == b).orderBy("item_id", "text").collect()
        shared = scratch.share(([r.item_id for r in own], [r.text for r in own], idf, projection, exact_below))
        # The text comes back only where another block has to read it.
        back = [*names, *([text] if own_text and b < blocks - 1 else []), before]
        schema = StructType([*(out.schema[c] for c in back), StructField(out_col, ArrayType(LongType()))])
        at = partial(_flagged, shared=shared, text=out.columns.index(text), columns=[out.columns.index(c) for c in back], names=[*back, out_col])
        out = out.mapInArrow(at, schema)
        found = F.col(out_col) if blocks == 1 else F.array_sort(F.array_union(before, out_col))
        out = out.select(*back[:-1], found.alias(out_col if b == blocks - 1 else before))
    return out


def op5(docs: DataFrame, items: DataFrame) -> DataFrame:
    """(doc_id, item_id) of each document of `documents` and each item of `benchmark` that it holds; each pair once."""
    scratch = Scratch(docs.sparkSession, "decontam")
    found = leaked(docs.select("doc_id", "text"), items.select("item_id", "text"), scratch, keep=["doc_id"])
    found = scratch.keep(found.where(F.size("leaked_items") > 0).select("doc_id", F.explode("leaked_items").alias("item_id")).distinct())
    scratch.free()
    return found
