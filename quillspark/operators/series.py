"""The decision time series: parsing, audited corrections, additions, flags, changes, analysis frame."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from .relational import direction_bins

TYPES = {"mpr": "double", "meeting_no": "int", "meeting_type": "string", "meeting_start": "date", "meeting_end": "date", "effective_date": "date"}
KEY = ["meeting_no", "meeting_type"]


def audited_update(df: DataFrame, corrections: DataFrame) -> DataFrame:
    """Corrections (field, old_value, new_value by key, with `seq` for their order) in turn; a later one sees the earlier ones. Each must hit
    exactly one row whose value is the old one, else the job fails. The corrections are a small hand-made table; the series isn't collected."""
    for c in corrections.orderBy("seq").collect():
        kind = TYPES[c.field]
        hit = (F.col("meeting_no") == int(c.meeting_no)) & (F.col("meeting_type") == c.meeting_type)
        n, ok = df.agg(F.count_if(hit), F.count_if(hit & F.col(c.field).eqNullSafe(F.lit(c.old_value).cast(kind)))).first()
        if n != 1:
            raise ValueError(f"Correction targets {n} rows: {c.meeting_no} {c.meeting_type}")
        if ok != 1:
            raise ValueError(f"Meeting {c.meeting_no}: {c.field} is not {c.old_value}")
        df = df.withColumns({"corrected": F.col("corrected") | hit, c.field: F.when(hit, F.lit(c.new_value).cast(kind)).otherwise(F.col(c.field))})
    return df


def add_meetings(df: DataFrame, additions: DataFrame) -> DataFrame:
    """Rows appended by name, effective at their end, marked corrected; a key that exists already is an error."""
    if df.join(additions, KEY, "left_semi").take(1):
        raise ValueError("An added meeting already exists in the table")
    rows = additions.select("meeting_no", "meeting_type", "meeting_start", "meeting_end", F.col("meeting_end").alias("effective_date"), "mpr", F.lit(True).alias("corrected"))
    return df.unionByName(rows, allowMissingColumns=True)


def check_series(df: DataFrame) -> DataFrame:
    """The rows, or a failing job if a key repeats."""
    n = F.count(F.lit(1)).over(Window.partitionBy(*KEY))
    return df.withColumn("__n", F.when(n > 1, F.raise_error(F.lit("duplicate (meeting_no, meeting_type)")).cast("int")).otherwise(n)).where("__n = 1").drop("__n")


def check_rising(df: DataFrame, by: str, number: str, value: str) -> DataFrame:
    """The rows, or a failing job where within a `by` the value doesn't rise with the number."""
    before = F.lag(value).over(Window.partitionBy(by).orderBy(number))
    bad = F.col(value) <= before
    return df.withColumn("__ok", F.when(bad, F.raise_error(F.lit(f"{value} does not rise with {number}")).cast("boolean")).otherwise(F.lit(True))).where("__ok").drop("__ok")


def clean_series(raw: DataFrame, corrections: DataFrame | None = None, additions: DataFrame | None = None) -> DataFrame:
    """Raw rows (meeting_no, mpc_dates, effective_raw, mpr) as the clean series. The change is over all meetings in the order of their end; it is one
    series of a few rows a year, which is the only reason why its window has no partition."""
    d = T.parse_dates(F.col("mpc_dates"))
    df = raw.withColumn("__d", d).select(
        F.col("meeting_no").cast("int").alias("meeting_no"),
        F.when(F.col("__d.emergency"), "emergency").otherwise("regular").alias("meeting_type"),
        F.col("__d.start").alias("meeting_start"), F.col("__d.end").alias("meeting_end"),
        F.to_date("effective_raw", "d MMM yyyy").alias("effective_date"), F.col("mpr").cast("double").alias("mpr"), F.lit(False).alias("corrected"),
    )
    if corrections is not None:
        df = audited_update(df, corrections)
    if additions is not None:
        df = add_meetings(df, additions)
    df = check_series(df)
    gap = F.datediff("effective_date", "meeting_end")
    w = Window.orderBy("meeting_end", "meeting_no")
    df = df.withColumn("effective_date_flag", F.coalesce(~gap.between(-3, 21), F.lit(True)))
    df = df.withColumn("mpr_change_bp", F.bround((F.col("mpr") - F.lag("mpr").over(w)) * 100, 0).cast("long"))
    df = df.withColumn("decision", direction_bins(F.col("mpr_change_bp")))
    return df.select("meeting_no", "meeting_type", "meeting_start", "meeting_end", "effective_date", "effective_date_flag", "mpr", "mpr_change_bp", "decision", "corrected")


def analysis_frame(index: DataFrame, rates: DataFrame, inflation: DataFrame | None) -> DataFrame:
    """One row per regular meeting with an index: direction now, direction of the next regular meeting by number, index, inflation."""
    reg = rates.where("meeting_type = 'regular'").withColumn("dir", F.signum(F.col("mpr_change_bp").cast("double")))
    reg = reg.withColumn("next_dir", F.lead("dir").over(Window.orderBy("meeting_no"))).withColumn("year", F.year("meeting_end"))
    frame = reg.join(index.where("meeting_type = 'regular'").select("meeting_no", "lexicon_net", "model_net", "n_scored"), "meeting_no")
    if inflation is None:
        frame = frame.withColumn("infl", F.lit(None).cast("double"))
    else:
        frame = frame.join(inflation.where("meeting_type = 'regular'").select("meeting_no", "infl"), "meeting_no", "left")
    return frame.na.drop(subset=["dir", "next_dir", "lexicon_net", "model_net"])
