"""Documents matched to meetings: cascade of clues, roles within a meeting, coverage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import patterns as P
from ..functions import text as T
from .relational import nearest_in_window, unique_month_match

CLUES = ("by_date", "by_number", "by_title")


def conflict(*clues: str) -> Column:
    """More than one distinct clue."""
    return F.size(F.array_distinct(F.array_compact(F.array(*clues)))) > 1


def with_clues(docs: DataFrame) -> DataFrame:
    """Adds letter_date, text_number, title_first (the month of the title) to documents (doc_id, title, text)."""
    return docs.withColumns({"letter_date": T.letterhead_date(F.col("text")), "text_number": T.meeting_number(F.col("text")), "title_first": T.title_month(F.col("title"))})


def match_regular(docs: DataFrame, rates: DataFrame) -> DataFrame:
    """Clues of documents (doc_id, letter_date, text_number, title_first) against regular meetings, and what the cascade makes of them:
    a letterhead date decides, and a date without a meeting ends the search; then the number in the text if the title agrees
    or is silent; then the title."""
    reg = rates.where("meeting_type = 'regular'")
    x = nearest_in_window(docs, reg.select(F.col("meeting_no").alias("by_date"), "meeting_end"), "letter_date", "meeting_end", "by_date")
    x = x.join(reg.select(F.col("meeting_no").alias("text_number"), F.col("meeting_no").alias("by_number")).distinct(), "text_number", "left")
    effective = F.when(~F.col("effective_date_flag"), F.col("effective_date"))
    x = unique_month_match(x, reg.withColumnRenamed("meeting_no", "by_title"), "title_first", "by_title", [F.col("meeting_end"), effective])
    agrees = F.coalesce(F.col("by_title") == F.col("by_number"), F.lit(True))
    method = (
        F.when(F.col("by_date").isNotNull(), "letterhead_date").when(F.col("letter_date").isNotNull(), "letterhead_no_meeting")
        .when(F.col("by_number").isNotNull() & agrees, "text_number").when(F.col("by_title").isNotNull(), "title").otherwise("unmatched")
    )
    return _chosen(x.withColumn("match_method", method).withColumn("meeting_type", F.lit("regular")))


def match_emergency(docs: DataFrame, rates: DataFrame) -> DataFrame:
    """Against emergency meetings: the closest letterhead date within three days, else the title's month."""
    own = rates.where("meeting_type = 'emergency'")
    x = nearest_in_window(docs, own.select(F.col("meeting_no").alias("by_date"), "meeting_end"), "letter_date", "meeting_end", "by_date", -3, 3)
    x = unique_month_match(x, own.withColumnRenamed("meeting_no", "by_title"), "title_first", "by_title", [F.col("meeting_end")])
    method = F.when(F.col("by_date").isNotNull(), "letterhead_date").when(F.col("by_title").isNotNull(), "title").otherwise("no_rate_row")
    return _chosen(x.withColumns({"by_number": F.lit(None).cast("int"), "match_method": method, "meeting_type": F.lit("emergency")}))


def _chosen(x: DataFrame) -> DataFrame:
    m = F.col("match_method")
    no = F.when(m == "letterhead_date", F.col("by_date")).when(m == "text_number", F.col("by_number")).when(m == "title", F.col("by_title"))
    x = x.withColumn("meeting_no", no.cast("int"))
    title_ok = F.when(F.col("title_first").isNotNull(), F.coalesce(F.col("by_title") == F.col("meeting_no"), F.col("by_title").isNull() & F.col("meeting_no").isNull()))
    return x.withColumns({"conflict": conflict(*CLUES), "title_ok": title_ok})


def match_documents(docs: DataFrame, rates: DataFrame) -> DataFrame:
    """All statements (doc_id, title, doc_type, text) matched: emergency releases to emergency meetings, the others to regular
    ones, and those left over get a second try at emergency meetings."""
    x = with_clues(docs)
    keys = ["doc_id", "meeting_no", "meeting_type", "match_method", "conflict", "title_ok", *CLUES]
    emergency = match_emergency(x, rates).select(*keys)
    regular = match_regular(x.where("doc_type <> 'emergency'"), rates).select(*keys)
    second = emergency.where("meeting_no is not null").select("doc_id", F.struct(*keys[1:]).alias("second"))
    first = regular.select("doc_id", F.struct(*keys[1:]).alias("first"))
    both = first.join(second, "doc_id", "left").select("doc_id", F.when(F.col("first.meeting_no").isNull() & F.col("second").isNotNull(), F.col("second")).otherwise(F.col("first")).alias("m"))
    found = both.select("doc_id", "m.*").unionByName(emergency.join(x.where("doc_type = 'emergency'").select("doc_id"), "doc_id", "left_semi"))
    facts = x.select("doc_id", "title", "doc_type", "letter_date", "text_number", "title_first", F.length(T.ws_normalise(F.col("text"))).alias("n_chars"), T.text_hash(F.col("text")).alias("text_hash"), T.rates_near_mentions(F.col("text")).alias("rates_in_text"))
    seed = F.when(F.col("meeting_no").isNotNull(), "candidate").when(F.col("doc_type") == "emergency", "primary_no_rate_row").otherwise("unmatched")
    return facts.join(found, "doc_id").withColumn("role", seed)


def assign_roles(docs: DataFrame) -> DataFrame:
    """Of each meeting's candidates one is primary: full texts before highlights, those whose title disagrees last, then the least id. The others
    are summaries, duplicates (equal or of like length) or conflicting versions. Adds role, duplicate_of, text_identical."""
    first = [F.col("doc_type") == "highlights", F.coalesce(~F.col("title_ok"), F.lit(False)), F.col("doc_id").cast("long")]
    w = Window.partitionBy("meeting_type", "meeting_no").orderBy(*first)
    mine = docs.where("role = 'candidate'").withColumn("__p", F.first(F.struct("doc_id", "doc_type", "text_hash", "n_chars")).over(w))
    same = T.near_identical(F.col("text_hash"), F.col("n_chars"), F.col("__p.text_hash"), F.col("__p.n_chars"))
    role = (
        F.when(F.col("doc_id") == F.col("__p.doc_id"), "primary").when((F.col("doc_type") == "highlights") & (F.col("__p.doc_type") != "highlights"), "summary_of_primary")
        .when(same, "duplicate").otherwise("conflicting_version")
    )
    mine = mine.withColumn("role", role)
    other = F.col("role") != "primary"
    mine = mine.withColumns({"duplicate_of": F.when(other, F.col("__p.doc_id")), "text_identical": F.when(other, F.col("text_hash") == F.col("__p.text_hash"))}).drop("__p")
    rest = docs.where("role <> 'candidate'").withColumns({"duplicate_of": F.lit(None).cast(mine.schema["duplicate_of"].dataType), "text_identical": F.lit(None).cast("boolean")})
    return mine.unionByName(rest)


def rate_agrees(rate: Column, found: Column) -> Column:
    """Whether the rate is among the figures; null without figures or rate."""
    return F.when((F.size(found) > 0) & rate.isNotNull(), F.array_contains(found, rate))


def build_tables(review: DataFrame, rates: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(statements, coverage): primaries with their meeting's rate; every meeting with its statement, if any."""
    key = ["meeting_no", "meeting_type"]
    own = review.where(F.col("role").isin("primary", "primary_no_rate_row"))
    statements = own.join(rates.select(*key, "meeting_end", "mpr", "mpr_change_bp", "decision"), key, "left").withColumn("rate_agrees", rate_agrees(F.col("mpr"), F.col("rates_in_text")))
    coverage = rates.join(statements.select(*key, "doc_id", "match_method", "conflict", "rate_agrees"), key, "left").withColumn("has_statement", F.col("doc_id").isNotNull())
    return statements.drop("rates_in_text"), coverage


def statement_types() -> tuple[str, ...]:
    return P.STATEMENT_TYPES
