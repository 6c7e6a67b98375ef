"""Packing of tokenised documents into sequences of a fixed window, by non-negative least squares.

Full windows of a document are sequences of their own. The remainders' lengths form a histogram of at most window - 1 bins, which
is all the driver sees. In each of a few rounds, shallow combinations of lengths that fill a window exactly are enumerated by drawing
lengths from the histogram and closing with a length that is there; non-negative least squares against the histogram gives their repeat
counts, which are rounded and bounded by what is left, and combinations are used again while they fit. The next round does the same with the
histogram of what is left. The rest is packed greedily, the longest first and then always the longest that fits; what would leave
a gap of more than `slack` ids is cut at the windows' ends instead. Documents find their place from the rank within their length alone.
"""

from __future__ import annotations

import bisect
import itertools
import os
import zlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .scratch import Scratch
from .textnum import Words, WordTable, chunks, words

WINDOW, END = 4096, 2
#: Places of the table of words already met; it is emptied when half full.
TABLE_BITS = 21
#: Bytes of text encoded at once.
CHUNK = 1 << 18


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class Encoder:
    """Ids of texts. The tokenizer drops white space, so a text's ids are its words' ids in turn; words already met are
    looked up. The table is emptied when half full, which changes no ids."""

    def __init__(self, path: str, bits: int = TABLE_BITS):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.bits = Tokenizer.from_file(path), bits
        self.clear(bits)

    def clear(self, bits: int) -> None:
        self.table = WordTable(bits)
        self.pool, self.used = np.zeros(1 << 20, np.uint16), 0
        self.first, self.length = np.zeros(1 << bits, np.int32), np.zeros(1 << bits, np.int32)

    def _learn(self, w: Words, rows: np.ndarray, hashes: np.ndarray) -> None:
        """Tokenises the words in `rows`, whose hashes are distinct and new."""
        strings = w.strings(rows).cast(pa.large_string()).to_pylist()
        got = [e.ids for e in self.tokenizer.encode_batch_fast(strings, add_special_tokens=False)]
        sizes = np.fromiter(map(len, got), np.int64, len(got))
        flat = np.fromiter(itertools.chain.from_iterable(got), np.uint16, int(sizes.sum()))
        if self.used + len(flat) > len(self.pool):
            self.pool = np.concatenate((self.pool[: self.used], np.zeros(max(len(self.pool) // 2, len(flat)), np.uint16)))
        self.pool[self.used : self.used + len(flat)] = flat
        place = self.table.add(hashes)
        self.first[place], self.length[place] = self.used + np.cumsum(sizes) - sizes, sizes
        self.used += len(flat)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, END after each; end of each text in them)."""
        w = words(texts)
        h = np.maximum(w.hash, np.uint64(1))
        place = self.table.find(h)
        if len(missing := np.flatnonzero(place < 0)):
            new, at = np.unique(h[missing], return_index=True)
            rows = missing[at]
            if 2 * (self.table.count + len(new)) > len(self.table.key) or self.used > 1 << 30:
                new, rows = np.unique(h, return_index=True)
                self.clear(max(self.bits, (2 * len(new)).bit_length()))
                missing = np.arange(len(h))
            self._learn(w, rows, new)
            place[missing] = self.table.find(h[missing])
        size = self.length[place].astype(np.int64)
        before = np.cumsum(size) - size
        total = int(size.sum())
        ends = np.cumsum(np.bincount(w.text, weights=size, minlength=w.n_texts).astype(np.int64) + 1)
        out = np.full(total + w.n_texts, END, np.uint16)
        inside = np.ones(len(out), bool)
        inside[ends - 1] = False
        out[inside] = self.pool[np.repeat(self.first[place] - before, size) + np.arange(total)]
        return out, ends


_encoders: dict[str, Encoder] = {}


def _encode(batches: Iterator[pa.RecordBatch], path: str, window: int) -> Iterator[pa.RecordBatch]:
    """Ids of each text, the writing task, and what that task has met before: `local` texts of the same remainder, `full` whole windows."""
    encoder = _encoders.setdefault(path, None) or Encoder(path)
    _encoders[path] = encoder
    task, met, full = TaskContext.get().partitionId(), np.zeros(window, np.int64), 0
    for batch in batches:
        for a, b in chunks(batch["text"], CHUNK):
            ids, ends = encoder.encode(batch["text"].slice(a, b - a))
            offsets = np.concatenate(([0], ends * 2)).astype(np.int32)
            raw = pa.Array.from_buffers(pa.binary(), b - a, [None, pa.py_buffer(offsets), pa.py_buffer(ids.astype("<u2"))])
            sizes = np.diff(offsets).astype(np.int64) // 2
            whole, rest = np.divmod(sizes, window)
            local = np.empty(b - a, np.int64)
            for i, r in enumerate(rest.tolist()):
                local[i] = met[r]
                met[r] += 1
            before = full + np.cumsum(whole) - whole
            full += int(whole.sum())
            columns = [raw, sizes, rest, np.full(b - a, task), local, before]
            yield pa.RecordBatch.from_arrays([batch["doc_id"].slice(a, b - a), *map(pa.array, columns)], ["doc_id", "ids", "doc_tokens", "rest", "task", "local", "full"])


def nnls(columns: np.ndarray, b: np.ndarray, rounds: int = 150) -> np.ndarray:
    """x >= 0 with small |A x - b|, by accelerated projected gradient. A row of `columns` lists the places of b that a column of A
    adds one to, as often as they are listed; place 0 stands for none."""
    depth, flat, on = columns.shape[1], columns.ravel(), columns > 0
    product = lambda x: np.bincount(flat, np.where(on, x[:, None], 0.0).ravel(), len(b))
    back = lambda r: np.where(on, r[columns], 0.0).sum(1)
    v, largest = np.ones(len(columns)), float(depth)
    for _ in range(8):
        v = back(product(v))
        largest = float(np.linalg.norm(v))
        v /= largest
    x = ahead = np.zeros(len(columns))
    t = 1.0
    for _ in range(rounds):
        new = np.maximum(ahead - back(product(ahead) - b) / (1.05 * largest), 0)
        after = (1 + np.sqrt(1 + 4 * t * t)) / 2
        ahead = new + (t - 1) / after * (new - x)
        x, t = new, after
    return x


def combinations(left: np.ndarray, draws: int, depth: int, rng: np.random.Generator) -> np.ndarray:
    """Distinct multisets of at most `depth` lengths that fill the window exactly; left: how many remainders there are of each length up
    to the window. Lengths are drawn as often as they occur; of the places at which a draw can be closed by a length that
    is there, the one with the most frequent such length is taken. Rows are in falling order, with zeros behind."""
    window, lengths = len(left) - 1, np.flatnonzero(left)
    bounds = np.cumsum(left[lengths].astype(float))
    picks = lengths[np.minimum(np.searchsorted(bounds, rng.random((draws, depth - 1)) * bounds[-1], "right"), len(lengths) - 1)]
    rest = window - np.cumsum(picks, 1)
    closing = np.where(rest > 0, left[np.maximum(rest, 0)], 0)
    k, row = closing.argmax(1), np.arange(draws)
    out = np.concatenate((np.where(np.arange(depth - 1) <= k[:, None], picks, 0), rest[row, k][:, None]), 1)[closing[row, k] > 0]
    return np.unique(np.sort(out, 1)[:, ::-1], axis=0)


#: Of a plan: the lengths and first ranks of the runs, and where each leads.
RUN = ("length", "rank", "kind", "sequence", "copies", "offset", "total")


def plan(histogram: dict[int, int], window: int = WINDOW, draws: int = 20_000, depth: int = 8, rounds: int = 8, slack: int | None = None, seed: int = 11) -> dict:
    """Where the remainders go. `runs` has, sorted by length and rank, the runs of ranks of a length: into a combination (kind 0: its first
    sequence, copies of the length in it, offset of the first copy, ids in the sequence) or into the stream that is cut at the window
    (kind 1: its first sequence, place of the run's first id). `used`: sequences; `last`, `short`: the stream's last sequence and
    the ids in it; `combined`, `fitted`, `cut`: ids that went into combinations, were fitted greedily, went into the stream. `slack` is a 64th of the window unless given."""
    slack = window // 64 if slack is None else slack
    left, counts = np.zeros(window + 1, np.int64), np.zeros(window + 1, np.int64)
    for x, n in histogram.items():
        left[x] = counts[x] = n
    found: list[tuple[int, ...]] = []
    sequence, ids = 0, {"combined": 0, "fitted": 0, "cut": 0}

    def use(combo: dict[int, int], n: int, kind: str) -> None:
        nonlocal sequence
        offset, total = 0, sum(y * k for y, k in combo.items())
        for y, k in combo.items():
            found.append((y, int(counts[y] - left[y]), 0, sequence, k, offset, total))
            left[y] -= n * k
            offset += y * k
        sequence += n
        ids[kind] += n * total

    rng = np.random.default_rng(seed)
    for _ in range(rounds):
        columns = combinations(left, draws, depth, rng) if left.any() else ()
        if not len(columns):
            break
        times = nnls(columns, left.astype(float))
        order = np.argsort(-times, kind="stable")
        combos = [{y: row.count(y) for y in dict.fromkeys(row) if y} for row in columns[order].tolist()]
        for most in (np.rint(times[order]).astype(np.int64).tolist(), [int(left.max())] * len(combos)):
            for combo, n in zip(combos, most, strict=True):
                if n and (n := min(n, *(int(left[y]) // k for y, k in combo.items()))) > 0:
                    use(combo, n, "combined")
    stream: list[int] = []
    present = np.flatnonzero(left).tolist()
    while present:
        combo, room = {present[-1]: 1}, window - present[-1]
        i = len(present) - 1
        while room and (i := min(i, bisect.bisect_right(present, room) - 1)) >= 0:
            y = present[i]
            if k := min(room // y, int(left[y]) - combo.get(y, 0)):
                combo[y] = combo.get(y, 0) + k
                room -= k * y
            i -= 1
        if room <= slack:
            use(combo, min(int(left[y]) // k for y, k in combo.items()), "fitted")
        else:
            stream.append(present.pop())
        present = [y for y in present if left[y]] if any(not left[y] for y in combo) else present
    at = 0
    for y in stream:
        found.append((y, int(counts[y] - left[y]), 1, sequence, 1, at, window))
        at += int(left[y]) * y
    ids["cut"] = at
    last = sequence + max(0, at - 1) // window
    runs = np.array(sorted(found), np.int64).reshape(-1, len(RUN))
    return {"runs": dict(zip(RUN, runs.T.copy(), strict=True)), "used": last + 1 if at else sequence, "last": last if at else -1, "short": at - (last - sequence) * window} | ids


def _pieces(batches: Iterator[pa.RecordBatch], shared, window: int) -> Iterator[pa.RecordBatch]:
    made = shared.value
    runs, used, last, short = (made[k] for k in ("runs", "used", "last", "short"))
    keys = (runs["length"] << 44) | runs["rank"]
    for batch in batches:
        n, rest, rank, full = (np.asarray(batch[c]) for c in ("doc_tokens", "rest", "rank", "first_full"))
        whole = n // window
        doc = np.repeat(np.arange(len(n)), whole)
        nth = np.arange(len(doc)) - np.repeat(np.cumsum(whole) - whole, whole)
        parts = [(doc, nth * window, np.full(len(doc), window), used + full[doc] + nth, np.zeros(len(doc), np.int64), np.full(len(doc), window))]
        doc = np.flatnonzero(rest)
        run = np.searchsorted(keys, (rest[doc] << 44) | rank[doc], "right") - 1
        kind, first, copies, offset, total = (runs[k][run] for k in ("kind", "sequence", "copies", "offset", "total"))
        step, start, size = rank[doc] - runs["rank"][run], n[doc] - rest[doc], rest[doc]
        group, slot = np.divmod(step, copies)
        at = offset + step * size
        into = np.where(kind == 0, offset + slot * size, at % window)
        fits = np.where(kind == 0, size, np.minimum(size, window - at % window))
        parts.append((doc, start, fits, first + np.where(kind == 0, group, at // window), into, total))
        cut = np.flatnonzero(fits < size)
        parts.append((doc[cut], (start + fits)[cut], (size - fits)[cut], (first + at // window + 1)[cut], np.zeros(len(cut), np.int64), total[cut]))
        doc, start, size, sequence, into, total = (np.concatenate(x) for x in zip(*parts, strict=True))
        order = np.lexsort((start, doc))
        doc, start, size, sequence, into, total = (x[order] for x in (doc, start, size, sequence, into, total))
        total = np.where(sequence == last, short, total)
        sums = np.zeros(len(doc), np.int64)
        ids, held = b"", -1
        for i, (d, a, k) in enumerate(zip(doc.tolist(), (4 * start).tolist(), (4 * size).tolist(), strict=True)):
            if d != held:
                ids, held = memoryview(np.frombuffer(batch["ids"][d].as_buffer(), "<u2").astype("<u4")).cast("B"), d
            sums[i] = zlib.crc32(ids[a : a + k])
        columns = [batch["doc_id"].take(pa.array(doc)), *map(pa.array, (start, size, sums, n[doc], sequence, into, total))]
        yield pa.RecordBatch.from_arrays(columns, ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "sequence_tokens"])


#: A table of at most so many rows of 24 bytes is broadcast; a larger one is joined by a shuffle.
BROADCAST_ROWS = 500_000


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None, window: int = WINDOW) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, sequence_tokens, padded_to.

    Each id of each row of `docs`, and id 2 after them, lies in exactly one piece; a null or empty text is id 2 alone. A
    sequence holds at most `window` ids without gaps, and is padded to the window unless its length is a power of
    two (padded_to). Repeated rows and null ids are packed like any other; which of several rows of one length goes where
    depends on the order of the input's splits. Columns other than the two named are not read. No rows give none."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "packing")
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    encode = partial(_encode, path=tokenizer or tokenizer_path(), window=window)
    encoded = scratch.keep(docs.mapInArrow(encode, "doc_id long, ids binary, doc_tokens long, rest long, task long, local long, full long"))
    # A row's rank in its length: those of earlier tasks, and those before it in its task; no row has to move.
    sizes = encoded.groupBy("rest", "task").agg(F.count(F.lit(1)).alias("n"))
    whole = encoded.groupBy("task").agg(F.sum(F.expr(f"doc_tokens div {window}")).alias("n")).select(F.lit(-1).cast("long").alias("rest"), "task", "n")
    sizes = sizes.union(whole)
    before = Window.partitionBy("rest").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    sizes = scratch.keep(sizes.withColumn("base", F.coalesce(F.sum("n").over(before), F.lit(0))))
    made = plan({r.rest: r.n for r in sizes.where("rest > 0").groupBy("rest").agg(F.sum("n").alias("n")).collect()}, window)
    # Its size is bounded by the combinations of all rounds.
    shared = spark.sparkContext.broadcast(made)
    fit = F.broadcast if sizes.count() <= BROADCAST_ROWS else lambda x: x
    ranked = encoded.join(fit(sizes.where("rest >= 0").select("rest", "task", "base")), ["rest", "task"])
    ranked = ranked.join(fit(sizes.where("rest < 0").select("task", F.col("base").alias("full_base"))), "task")
    ranked = ranked.select("doc_id", "ids", "doc_tokens", "rest", (F.col("base") + F.col("local")).alias("rank"), (F.col("full_base") + F.col("full")).alias("first_full"))
    cut = partial(_pieces, shared=shared, window=window)
    pieces = ranked.mapInArrow(cut, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, sequence_tokens long")
    power = F.expr("bit_count(sequence_tokens) = 1")
    return pieces.withColumn("padded_to", F.when(power, F.col("sequence_tokens")).otherwise(F.lit(window).cast("long")))
