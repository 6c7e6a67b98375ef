"""Subword lattice likelihood: an existing vocabulary of pieces, all segmentations of a text, forward recursion in log space.

A text is its words, each with a leading space, and one end. Pieces are drawn independently until the end is drawn; the probability of a
text is the sum over all its segmentations into pieces. No piece reaches over a word's start, so the recursion factorises by word, and
each distinct word of the corpus is computed once, whatever its length.

The vocabulary and its scores are given, and no piece is ever added. The scores are ranks; with them as prior weights, the pieces' unigram
probabilities are re-estimated from the training rows by expectation-maximisation over all segmentations of all training words, as often as
they occur (`score`). `existing_score` is the same sum under the weights of the ranks alone, learned from nothing. `word_score` is a
further model beside them: its lattice also has an arc for each training word as a whole, with the word's count c as its weight, against
which the segmentations have the weight k together, the number of words met once (the Good-Turing estimate of how often a new word
comes): P(word) = (c + k P(pieces)) / (N + k). It is there because pieces drawn independently give known words less than a model of
whole words does.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import Scratch
from .textnum import WordTable, chunks, words

ROUNDS, PRIOR_COUNT = 3, 2000.0
#: A lattice of fewer words than this is walked word by word, of more in arrays; both are the same recursion.
FEW = 24
BLOCK_ROWS, BLOCK_CELLS = 4096, 1 << 19
#: So many of the most frequent words are looked up in a broadcast table of fixed size; the others are joined.
FREQUENT = 1 << 18
_R = 0xD6E8FEB86659FD93
_VALUE = np.random.Generator(np.random.PCG64(99)).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def model_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def vocabulary(path: str) -> tuple[list[bytes], np.ndarray]:
    """(pieces, prior weights summing to 1): the model's pieces that can stand in a lower-cased word with a space before it, and all
    single bytes. A piece's prior falls with its rank in the model."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    weight = {bytes([b]): 1e-6 for b in range(256)}
    for i in range(model.get_piece_size()):
        if model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i):
            continue
        piece = model.id_to_piece(i).replace("▁", " ").encode()
        if not any(65 <= b <= 90 for b in piece) and b" " not in piece[1:]:
            weight[piece] = weight.get(piece, 0) + 1 / (10 - model.get_score(i))
    total = sum(weight.values())
    return list(weight), np.array(list(weight.values())) / total


def _add(a: float, b: float) -> float:
    """log(exp(a) + exp(b))."""
    if a < b:
        a, b = b, a
    return a if b == -math.inf else a + math.log1p(math.exp(b - a))


class Lattice:
    """Log probabilities (natural) of words under piece weights."""

    def __init__(self, pieces: list[bytes], log_weight: np.ndarray):
        self.log_weight, self.weights = log_weight, log_weight.tolist()
        self.longest = max(map(len, pieces))
        #: Each beginning of a piece, and the piece that it is (-1: none).
        self.prefix: dict[bytes, int] = {}
        for k, p in enumerate(pieces):
            for n in range(1, len(p)):
                self.prefix.setdefault(p[:n], -1)
            self.prefix[p] = k
        with np.errstate(over="ignore"):
            value = _VALUE.tolist()
            hashed = np.array([sum(value[b] * pow(_R, i, 2**64) for i, b in enumerate(p)) % 2**64 for p in self.prefix], np.uint64)
        self.table = WordTable(max(8, (2 * len(hashed)).bit_length()))
        self.piece = np.full(len(self.table.key), -1, np.int64)
        self.piece[self.table.add(hashed)] = np.fromiter(self.prefix.values(), np.int64, len(hashed))
        self.up, self.down = self._powers(64)

    @staticmethod
    def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
        return tuple(np.array([pow(_R, s * i, 2**64) for i in range(n + 1)], np.uint64) for s in (1, -1))

    def _blocks(self, strings: list[bytes]):
        """(rows, bytes with the leading space padded to one length, lengths in rising order), and rows of blocks with few words as a list."""
        lengths = np.fromiter(map(len, strings), np.int64, len(strings)) + 1
        order = np.argsort(lengths, kind="stable")
        at = 0
        while at < len(order):
            end = min(at + BLOCK_ROWS, len(order))
            while end - at > 1 and (end - at) * int(lengths[order[end - 1]]) > BLOCK_CELLS:
                end = at + max(1, (end - at) // 2)
            rows = order[at:end]
            width = int(lengths[rows[-1]])
            if len(rows) < FEW:
                yield rows, None, None
            else:
                block = np.frombuffer(b"".join((b" " + strings[r]).ljust(width) for r in rows.tolist()), np.uint8).reshape(len(rows), width)
                yield rows, block, lengths[rows]
            at = end

    def _arcs(self, block: np.ndarray, lengths: np.ndarray):
        """(i, j, rows, pieces) for all places i < j at which rows hold a piece, i rising."""
        n, width = block.shape
        if len(self.up) <= width:
            self.up, self.down = self._powers(width)
        first = np.searchsorted(lengths, np.arange(width + 1))  # rows from here on have a place
        with np.errstate(over="ignore"):
            sums = np.zeros((width + 1, n), np.uint64)
            np.cumsum(_VALUE[block.T] * self.up[:width, None], axis=0, out=sums[1:])
            for i in range(width):
                rows = np.arange(first[i + 1], n)
                for j in range(i + 1, min(width, i + self.longest) + 1):
                    rows = rows[np.searchsorted(rows, first[j]) :]
                    place = self.table.find((sums[j, rows] - sums[i, rows]) * self.down[i])
                    on = place >= 0
                    rows = rows[on]
                    if not len(rows):
                        break
                    piece = self.piece[place[on]]
                    whole = piece >= 0
                    yield i, j, rows[whole], piece[whole]

    def _forward(self, n: int, width: int, arcs) -> np.ndarray:
        alpha = np.full((width + 1, n), -np.inf)
        alpha[0] = 0
        for i, j, rows, piece in arcs:
            alpha[j, rows] = np.logaddexp(alpha[j, rows], alpha[i, rows] + self.log_weight[piece])
        return alpha

    def _steps(self, text: bytes, i: int):
        """(j, piece) of the pieces that begin at i."""
        for j in range(i + 1, min(len(text), i + self.longest) + 1):
            piece = self.prefix.get(text[i:j])
            if piece is None:
                return
            if piece >= 0:
                yield j, piece

    def _forward_one(self, text: bytes) -> list[float]:
        alpha = [0.0] + [-math.inf] * len(text)
        for i in range(len(text)):
            for j, piece in self._steps(text, i):
                alpha[j] = _add(alpha[j], alpha[i] + self.weights[piece])
        return alpha

    def log_probability(self, strings: list[bytes]) -> np.ndarray:
        """Of words without their leading space, lower-cased."""
        out = np.zeros(len(strings))
        for rows, block, lengths in self._blocks(strings):
            if block is None:
                out[rows] = [self._forward_one(b" " + strings[r])[-1] for r in rows.tolist()]
            else:
                out[rows] = self._forward(*block.shape, self._arcs(block, lengths))[lengths, np.arange(len(rows))]
        return out

    def expected(self, strings: list[bytes], counts: np.ndarray) -> np.ndarray:
        """Expected uses of each piece over words with counts."""
        total = np.zeros(len(self.log_weight))
        for rows, block, lengths in self._blocks(strings):
            if block is None:
                for r in rows.tolist():
                    self._expect_one(b" " + strings[r], float(counts[r]), total)
                continue
            arcs, own = list(self._arcs(block, lengths)), np.arange(len(rows))
            alpha = self._forward(*block.shape, arcs)
            whole, times = alpha[lengths, own], counts[rows]
            beta = np.full_like(alpha, -np.inf)
            beta[lengths, own] = 0
            for i, j, at, piece in reversed(arcs):
                after = beta[j, at] + self.log_weight[piece]
                beta[i, at] = np.logaddexp(beta[i, at], after)
                np.add.at(total, piece, np.exp(alpha[i, at] + after - whole[at]) * times[at])
        return total

    def _expect_one(self, text: bytes, times: float, total: np.ndarray) -> None:
        alpha, beta = self._forward_one(text), [-math.inf] * len(text) + [0.0]
        for i in range(len(text) - 1, -1, -1):
            for j, piece in self._steps(text, i):
                after = beta[j] + self.weights[piece]
                beta[i] = _add(beta[i], after)
                total[piece] += math.exp(alpha[i] + after - alpha[-1]) * times


def lattice(pieces: list[bytes], weight: np.ndarray) -> Lattice:
    return Lattice(pieces, np.log(weight))


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        learn = np.asarray(batch["learn"].cast(pa.int64()))
        for a, b in chunks(batch["text"], 4 << 20):
            w = words(batch["text"].slice(a, b - a))
            if not len(w.hash):
                continue
            distinct, at, where = np.unique(w.hash, return_index=True, return_inverse=True)
            n = np.bincount(where, minlength=len(distinct))
            learned = np.bincount(where, learn[a:b][w.text], len(distinct)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(distinct.view(np.int64)), w.strings(at, lower=True).cast(pa.binary()), pa.array(learned), pa.array(n)], ["h", "word", "c", "n"])


def _expected(batches: Iterator[pa.RecordBatch], model) -> Iterator[pa.RecordBatch]:
    m, total = lattice(*model.value), 0
    for batch in batches:
        total = total + m.expected(batch["word"].to_pylist(), np.asarray(batch["c"]).astype(float))
    if np.ndim(total):
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], ["piece", "uses"])


def _with_log(batches: Iterator[pa.RecordBatch], models, k: float, total: float, stop: float) -> Iterator[pa.RecordBatch]:
    """Log probabilities of words: under the learned weights, the existing ones, and with an arc for the word itself."""
    pieces, learned, existing = models.value
    learned, existing = lattice(pieces, learned), lattice(pieces, existing)
    for batch in batches:
        strings = batch["word"].to_pylist()
        log = learned.log_probability(strings)
        with np.errstate(divide="ignore"):
            whole = np.logaddexp(np.log(np.asarray(batch["c"])), log + math.log(k) + stop) - math.log(total)
        yield pa.RecordBatch.from_arrays([batch["h"], batch["c"], batch["n"], *map(pa.array, (log, existing.log_probability(strings), whole))], ["h", "c", "n", *LOGS])


#: Of a word's log probabilities: learned, existing, with whole words.
LOGS = ("log", "log_existing", "log_whole")


def _texts(batches: Iterator[pa.RecordBatch], frequent) -> Iterator[pa.RecordBatch]:
    """Of each text what frequent words bring, and its other words with their counts."""
    keys, count, logs = frequent.value
    for batch in batches:
        for a, b in chunks(batch["text"]):
            w = words(batch["text"].slice(a, b - a))
            at = np.minimum(np.searchsorted(keys, w.hash), max(0, len(keys) - 1))
            hit = keys[at] == w.hash if len(keys) else np.zeros(len(w.hash), bool)
            total = lambda x: np.bincount(w.text[hit], x, b - a).astype(float)  # noqa: B023, E731
            base, known = total(np.log10(count[at[hit]] + 0.5)), total((count[at[hit]] > 0).astype(float))
            rest = np.flatnonzero(~hit)
            order = rest[np.lexsort((w.hash[rest], w.text[rest]))]
            text, value = w.text[order], w.hash[order]
            new = np.ones(len(order), bool)
            new[1:] = (text[1:] != text[:-1]) | (value[1:] != value[:-1])
            first = np.flatnonzero(new)
            times = np.diff(np.append(first, len(order)))
            offsets = pa.array(np.concatenate(([0], np.cumsum(np.bincount(text[first], minlength=b - a)))).astype(np.int32))
            columns = [pa.array(w.counts().astype(np.int64)), pa.array(base), pa.array(known.astype(np.int64)), *(pa.array(total(x[at[hit]])) for x in logs)]
            lists = [pa.ListArray.from_arrays(offsets, pa.array(x)) for x in (value[first].view(np.int64), times.astype(np.int64))]
            yield pa.RecordBatch.from_arrays([batch["doc_id"].slice(a, b - a), *columns, *lists], ["doc_id", "n", "base", "known", *LOGS, "h", "times"])


def score(docs: DataFrame, learn: str, model: str | None = None, rounds: int = ROUNDS) -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score, score, existing_score, word_score for each row of `docs` (doc_id, text). Rows for
    which the SQL condition `learn` is true are learned from; null counts as false.

    base_score is the add-half unigram score over words, the others are those of the lattice models (see the module), all log10 of a
    probability. Words are hashed to 64 bits. A null or empty text is its end alone. Rows with null ids are scored too; repeated rows are each
    scored, and each learned from. Where nothing is learned from, the counts are zero and the weights are the vocabulary's. Other
    columns are not read. No rows give none."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "latticelm")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.coalesce(F.expr(learn), F.lit(False)).alias("learn"))
    table = docs.mapInArrow(_counted, "h long, word binary, c long, n long").groupBy("h", "word").agg(F.sum("c").alias("c"), F.sum("n").alias("n"))
    table = scratch.keep(table)
    ends = docs.where("learn").count()
    in_words, kinds, once = table.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count_if(F.col("c") > 0), F.count_if(F.col("c") == 1)).first()
    n_train, v = in_words + ends, kinds + (1 if ends else 0)

    pieces, prior = vocabulary(model or model_path())
    weight, end = prior * 0.99, 0.01
    fit = table.where("c > 0").select("word", "c")
    for _ in range(rounds if in_words else 0):
        uses = np.zeros(len(pieces))
        for r in fit.mapInArrow(partial(_expected, model=scratch.share((pieces, weight))), "piece long, uses double").groupBy("piece").agg(F.sum("uses").alias("uses")).collect():
            uses[r.piece] = r.uses
        total = uses.sum() + ends + PRIOR_COUNT
        weight, end = (uses + 0.99 * PRIOR_COUNT * prior) / total, (ends + 0.01 * PRIOR_COUNT) / total
        scratch.free()
    # A word of pieces ends where a piece with a space or the end follows; its first piece is one with a space.
    k, spaced = max(1, once), sum(w for p, w in zip(pieces, weight.tolist(), strict=True) if p[:1] == b" ")
    total, stop = n_train + k, math.log((spaced + end) / spaced)
    models = scratch.share((pieces, weight, prior * 0.99))
    known = scratch.keep(table.mapInArrow(partial(_with_log, models=models, k=k, total=total, stop=stop), f"h long, c long, n long, {', '.join(f'{x} double' for x in LOGS)}"))
    scratch.free()
    top = known.orderBy(F.desc("n"), "h").limit(FREQUENT).select("h", "c", *LOGS).toArrow()
    key = np.asarray(top["h"]).view(np.uint64)
    order = np.argsort(key)
    frequent = scratch.share((key[order], np.asarray(top["c"])[order].astype(float), [np.asarray(top[x])[order] for x in LOGS]))
    schema = f"doc_id long, n long, base double, known long, {', '.join(f'{x} double' for x in LOGS)}, h array<long>, times array<long>"
    texts = scratch.keep(docs.select("doc_id", "text").mapInArrow(partial(_texts, frequent=frequent), schema).withColumn("uid", F.monotonically_increasing_id()))
    scratch.free()
    rare = texts.select("uid", F.explode(F.arrays_zip("h", "times")).alias("x")).select("uid", "x.h", "x.times")
    rare = rare.join(known, "h").groupBy("uid").agg(
        F.sum(F.col("times") * F.log10(F.col("c") + 0.5)).alias("b"), F.sum(F.when(F.col("c") > 0, F.col("times")).otherwise(0)).alias("k"),
        *(F.sum(F.col("times") * F.col(x)).alias(f"rare_{x}") for x in LOGS),
    )
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    scale = math.log10(n_train + 0.5 * (v + 1))
    lattice_score = lambda x, stop: (F.col(x) + zero(f"rare_{x}")) / math.log(10) + math.log10(stop)
    return texts.drop("h", "times").join(rare, "uid", "left").select(
        "doc_id",
        (F.col("n") + 1).alias("n_tokens"),
        (F.col("known") + zero("k") + (1 if ends else 0)).alias("n_known"),
        F.lit(n_train).cast("long").alias("train_tokens"),
        (F.col("base") + zero("b") + math.log10(ends + 0.5) - (F.col("n") + 1) * F.lit(scale)).alias("base_score"),
        lattice_score("log", end).alias("score"),
        lattice_score("log_existing", 0.01).alias("existing_score"),
        lattice_score("log_whole", max(ends, 0.5) / total).alias("word_score"),
    )


def op2(docs: DataFrame) -> DataFrame:
    """The scores of documents, learned from rows whose crc32(doc_id as text) mod 5 is not 1 (a null id counts so too)."""
    out = score(docs, "coalesce(crc32(cast(doc_id as string)) % 5 <> 1, true)")
    held = F.coalesce(F.expr("crc32(cast(doc_id as string)) % 5 = 1"), F.lit(False))
    return out.select("doc_id", held.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score", "existing_score", "word_score")
