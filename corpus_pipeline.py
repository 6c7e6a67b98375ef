"""From raw documents to packed training sequences: five stages, each over all that the one before it kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm import decontam, linededup, minhash, packing, toxicity
from quillspark.llm.scratch import Scratch, free_name
from quillspark.tables import table


def remove_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose toxicity score is under 0.5; the model learns from all labelled rows of `docs`. Rows with null ids are scored like any other."""
    model = toxicity.train(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), table(spark, sf_dir, "labels"), held_out=-1)
    score = free_name(docs.columns, "toxicity")
    return toxicity.score(docs, spark.sparkContext.broadcast(model), score_col=score).where(F.col(score) < 0.5).drop(score)


def remove_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, without the lines that repeat across documents; n_chars follows the text."""
    out = linededup.drop_repeated_lines(docs, lines_col=None, dropped_col=None)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)


def remove_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates (a similarity of 0.8 or more) the document of least id, and rows with null ids. Rows that share an id are one document."""
    kept = minhash.near_duplicates(docs, percent=80).where("kept and doc_id is not null").select("doc_id").distinct()
    return docs.where("doc_id is null").union(docs.join(kept, "doc_id", "left_semi").select(*docs.columns))


def remove_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that hold no item of the benchmark."""
    found = free_name(docs.columns, "leaked")
    out = decontam.leaked(docs, table(spark, sf_dir, "benchmark"), Scratch(spark, "decontam"), out_col=found)
    return out.where(F.size(found) == 0).drop(found)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of what is left, in sequences of 4096 ids."""
    return packing.pack(docs)


STAGES = [("toxicity", remove_toxic), ("line_dedup", remove_lines), ("minhash_dedup", remove_near_duplicates), ("decontamination", remove_leaks), ("packing", pack)]

#: The learned and tokenised stages have no SQL; tests/llm/test_pipeline.py checks the run against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces of the packed corpus. Each stage's result is a Parquet table in the shared folder, which the next one reads."""
    docs, scratch = table(spark, sf_dir, "documents"), Scratch(spark, "pipeline")
    for _, stage in STAGES[:-1]:
        docs = scratch.keep(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
