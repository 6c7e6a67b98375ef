"""Labels and predictions of sentences aggregated to one row a document."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.stats import argmax_label


def build_index(scored: DataFrame) -> DataFrame:
    """Rows (doc_id, tone_weak, p_dovish, p_neutral, p_hawkish) as doc_id, n_scored, lexicon_net, model_net, model_net_hard."""
    value = lambda c: F.when(c == "hawkish", 1).when(c == "dovish", -1).when(c == "neutral", 0)
    hard = argmax_label(F.array("p_dovish", "p_neutral", "p_hawkish"), ["dovish", "neutral", "hawkish"])
    return scored.groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("n_scored"),
        F.avg(value(F.col("tone_weak"))).alias("lexicon_net"),
        F.avg(F.col("p_hawkish") - F.col("p_dovish")).alias("model_net"),
        F.avg(value(hard)).alias("model_net_hard"),
    )


def with_dates(index: DataFrame, statements: DataFrame) -> DataFrame:
    """Adds the meeting and its date, or the letterhead's date where no meeting is known."""
    info = statements.select("doc_id", "meeting_no", "meeting_type", F.coalesce(F.to_date("meeting_end"), F.to_date("letterhead_date")).alias("date"))
    return index.join(info, "doc_id", "left")
