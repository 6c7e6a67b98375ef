"""Seeded sampling, quotas, splits. Randomness is the md5 of seed and id, so it is the same in any engine and on any cluster."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import patterns as P


def draw(seed: str | int, *ids: str) -> Column:
    """A 128-bit random key of a row, as hex."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *(F.col(c).cast("string") for c in ids)).cast("binary"))


def uniform(seed: str | int, *ids: str) -> Column:
    """0 to 2**32 - 1."""
    return F.conv(F.substring(draw(seed, *ids), 1, 8), 16, 10).cast("long")


def seeded_sample(df: DataFrame, n: int, seed: int, id_col: str) -> DataFrame:
    return df.orderBy(draw(seed, id_col), id_col).limit(n)


def split_evenly(total: int, parts: int) -> list[int]:
    return [total // parts + (i < total % parts) for i in range(parts)]


def half_even(x: float) -> int:
    return round(x)


def round_robin(df: DataFrame, group: str, seed: int, id_col: str, by: list[str] | None = None) -> DataFrame:
    """Adds turn and its place: groups shuffled each, then dealt in turns, one row of each group a turn."""
    w = Window.partitionBy(*(by or []), group).orderBy(draw(seed, id_col), id_col)
    return df.withColumn("turn", F.row_number().over(w))


def dev_split(df: DataFrame, cell: list[str], seed: int, id_col: str, share: float = P.DEV_SHARE) -> DataFrame:
    """The first half-even round(share * n) of each shuffled cell are dev, the others test."""
    w = Window.partitionBy(*cell)
    rank = F.row_number().over(w.orderBy(draw(seed, id_col), id_col))
    return df.withColumn("split", F.when(rank <= F.bround(share * F.count(F.lit(1)).over(w), 0), "dev").otherwise("test"))


def stratified_sample(pool: DataFrame, quotas: dict[str, int] = P.QUOTAS, seed: int = 42, per_doc: int = P.MAX_PER_DOC) -> DataFrame:
    """A sample of a pool (sentence_id, doc_id, era, tone_weak, topic_weak, norm_text): for each era its quota, 40 % at random, the rest in equal
    parts by tone in turns over topics, what a tone lacks from the rest of the era. Texts are unique, and at most `per_doc` rows
    come from a document. Adds draw (random, stratified), split (dev, test) and gold_id.

    Texts are made unique and documents capped first, by windows over a text and a document; then no draw can break either, and
    each era is a few windows more. The number of rows after each era's limits is the quota, so they are small."""
    unique = Window.partitionBy("norm_text").orderBy(draw(f"{seed}t", "sentence_id"), "sentence_id")
    capped = Window.partitionBy("doc_id").orderBy(draw(f"{seed}d", "sentence_id"), "sentence_id")
    pool = pool.withColumn("__k", F.row_number().over(unique)).where("__k = 1").withColumn("__k", F.row_number().over(capped)).where(F.col("__k") <= per_doc).drop("__k")
    out = []
    for era, quota in quotas.items():
        own = pool.where(F.col("era") == era)
        random = own.orderBy(draw(f"{seed}r", "sentence_id"), "sentence_id").limit(half_even(P.RANDOM_SHARE * quota)).withColumn("draw", F.lit("random"))
        rest = own.join(random.select("sentence_id"), "sentence_id", "left_anti")
        remaining = quota - half_even(P.RANDOM_SHARE * quota)
        share = F.element_at(F.create_map(*(F.lit(x) for kv in zip(P.TONES, split_evenly(remaining, 3), strict=True) for x in kv)), F.col("tone_weak"))
        dealt = round_robin(rest, "topic_weak", f"{seed}s", "sentence_id", ["tone_weak"])
        place = F.row_number().over(Window.partitionBy("tone_weak").orderBy("turn", "topic_weak"))
        dealt = dealt.withColumn("__first", F.coalesce(place <= share, F.lit(False)))
        # Those within their tone's share come first; then the turns go on over the era until the quota is full.
        over = round_robin(dealt, "topic_weak", f"{seed}u", "sentence_id", ["__first"])
        out.append(random.unionByName(over.orderBy(F.desc("__first"), "turn", "topic_weak", "sentence_id").limit(remaining).drop("turn", "__first").withColumn("draw", F.lit("stratified"))))
    sample = dev_split(reduce(DataFrame.unionByName, out), ["era", "draw"], seed, "sentence_id")
    number = F.row_number().over(Window.orderBy(draw(f"{seed}g", "sentence_id"), "sentence_id"))
    return sample.withColumn("gold_id", F.format_string("G%03d", number))


def annotation_sheet(sample: DataFrame) -> DataFrame:
    """What annotators see: no labels, empty columns to fill."""
    empty = lambda c: F.lit(None).cast("string").alias(c)
    return sample.select("gold_id", "section_heading", F.col("text").alias("sentence"), empty("tone"), empty("topic"), empty("unsure"), empty("notes"))
