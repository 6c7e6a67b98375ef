"""Language identification by compression: a text is of the language whose dictionary compresses it best.

For each language that the training rows name, the raw-content zstandard dictionary is a bounded sample of its texts. A
text is lower-cased and cut into blocks, so that it can't lean on itself but on the dictionary, each block is compressed with each
dictionary, and the sizes are summed over the whole text.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

DICTIONARY_BYTES, SAMPLE_TEXTS, SHORT_CHARS = 32 << 10, 100, 4000
BLOCK_BYTES, LEVEL = 512, 9
#: A choice is rejected if the second language's size is less than so much above the first's.
LEAST_MARGIN = 0.01
_LETTER = re.compile(r"[^\W\d_]")


def train(docs: DataFrame, held_out: int = 0, dictionary_bytes: int = DICTIONARY_BYTES, sample_texts: int = SAMPLE_TEXTS) -> dict[str, bytes]:
    """Dictionaries by language, of rows whose crc32(doc_id as text) mod 5 is not `held_out` and whose lang is not null.

    Whole texts are taken until a dictionary of `dictionary_bytes` is full, `sample_texts` at most: those of up to SHORT_CHARS code points in
    the order of a hash of their id, so that one long text doesn't fill it, then longer ones by length. Only the last text is cut, where the
    dictionary ends. Rows with null ids take no part."""
    known = docs.where(F.expr(f"crc32(cast(doc_id as string)) % 5 <> {held_out}")).where("lang is not null and length(text) > 0")
    first = Window.partitionBy("lang").orderBy(F.greatest(F.length("text"), F.lit(SHORT_CHARS)), F.xxhash64("doc_id", F.lit(3)), "doc_id", "hash")
    sized = known.select("doc_id", "lang", F.xxhash64("text").alias("hash"), F.octet_length("text").cast("long").alias("bytes"), "text")
    chosen = sized.withColumn("rn", F.row_number().over(first)).where(f"rn <= {sample_texts}").drop("text")
    before = F.coalesce(F.sum("bytes").over(Window.partitionBy("lang").orderBy("rn").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    chosen = chosen.withColumn("before", before).where(f"before < {dictionary_bytes}").select("doc_id", "lang", "hash", "rn")
    rows = docs.select("doc_id", "lang", "text", F.xxhash64("text").alias("hash")).join(F.broadcast(chosen), ["doc_id", "lang", "hash"])
    rows = rows.select("lang", "rn", F.left("text", F.lit(dictionary_bytes)).alias("text")).dropDuplicates(["lang", "rn"]).collect()
    texts: dict[str, list[bytes]] = {}
    for r in sorted(rows, key=lambda r: (r.lang, r.rn)):
        texts.setdefault(r.lang, []).append(r.text.lower().encode())
    # The first texts stand last, where zstandard reaches them at the least cost.
    return {k: b"\n".join(reversed(v))[-dictionary_bytes:].ljust(8) for k, v in texts.items()}


class Classifier:
    def __init__(self, dictionaries: dict[str, bytes]):
        import zstandard as z

        self.names = list(dictionaries)
        self.compressors = []
        for raw in dictionaries.values():
            d = z.ZstdCompressionDict(raw, dict_type=z.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(level=LEVEL)
            self.compressors.append(z.ZstdCompressor(level=LEVEL, dict_data=d, write_content_size=False, write_checksum=False))

    def sizes(self, text: str) -> np.ndarray:
        raw = text.lower().encode("utf-8", "surrogatepass")
        blocks = [raw[i : i + BLOCK_BYTES] for i in range(0, len(raw), BLOCK_BYTES)]
        return np.array([sum(len(c.compress(b)) for b in blocks) for c in self.compressors], float)

    def predict(self, text: str | None) -> tuple[str, float, float]:
        """(language, score, margin); ('und', 0, 0) without a letter or without languages."""
        if not text or not self.names or not _LETTER.search(text):
            return "und", 0.0, 0.0
        size = self.sizes(text)
        best = int(np.argmin(size))
        if len(size) == 1:
            return self.names[0], 1.0, 1.0
        weight = np.exp(-(size - size[best]) / (0.01 * size[best]))
        return self.names[best], float(weight[best] / weight.sum()), float(np.partition(size, 1)[1] / size[best] - 1)


def _predicted(batches: Iterator[pa.RecordBatch], dictionaries) -> Iterator[pa.RecordBatch]:
    classifier = Classifier(dictionaries.value)
    for batch in batches:
        got = [classifier.predict(t.as_py()) for t in batch["text"]]
        names, scores, margins = zip(*got, strict=True) if got else ((), (), ())
        yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(names, pa.string()), pa.array(scores, pa.float64()), pa.array(margins, pa.float64())], ["doc_id", "lang_pred", "score", "margin"])


def identify(docs: DataFrame, dictionaries: dict[str, bytes], least_margin: float = LEAST_MARGIN) -> DataFrame:
    """doc_id, lang_pred, score, margin, lang_accepted for each row of `docs` (doc_id, text), from the text alone. lang_accepted is
    lang_pred, or und if the margin is narrow. Ties go to the first language by name. A text that is null or has no
    letter is und with score 0. No rows give none."""
    shared = docs.sparkSession.sparkContext.broadcast(dictionaries)
    out = docs.select("doc_id", "text").mapInArrow(partial(_predicted, dictionaries=shared), "doc_id long, lang_pred string, score double, margin double")
    return out.withColumn("lang_accepted", F.when(F.col("margin") >= least_margin, F.col("lang_pred")).otherwise(F.lit("und")))


def op6(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score, margin, lang_accepted for each row of documents. A null id is not held out."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    held = F.coalesce(F.expr("crc32(cast(doc_id as string)) % 5 = 0"), F.lit(False))
    return identify(docs, train(docs)).withColumn("held_out", held).select("doc_id", "held_out", "lang_pred", "score", "margin", "lang_accepted")
