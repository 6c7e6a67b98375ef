"""From a statement's text to its sentences: lines, noise, headings, paragraphs, sentences. Each step is a projection or a window
over the lines of one document."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import patterns as P
from ..functions import text as T


def strip_letterhead(c: Column) -> Column:
    """The text without its letterhead block, unless the block holds a real sentence."""
    block = F.regexp_extract(c, P.LETTERHEAD_BLOCK, 0)
    return F.when((block == "") | block.rlike(r"[a-z]{3,}[.!?]\s"), c).otherwise(F.substring(c, F.length(block) + 1, F.length(c)))


def lines_of(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, pos, line): trimmed lines, numbered from 0."""
    parts = F.split(strip_letterhead(F.col(text)), r"\r\n|[\n\r\u000b\u000c\u001c\u001d\u001e\u0085  ]", -1)
    return docs.select(F.col(id_col).alias("doc_id"), F.posexplode(parts).alias("pos", "line")).withColumn("line", F.regexp_replace("line", r"(?U)^\s+|\s+$", ""))


def _tokens(line: Column) -> Column:
    return F.filter(F.split(line, r"(?U)\s+"), lambda x: x != "")


def _bare(x: Column) -> Column:
    return F.regexp_replace(x, "^[.,]+|[.,]+$", "")


def is_noise(line: Column) -> Column:
    """Empty lines, letterhead words, page numbers, short capitals, spaced-out letters."""
    t = _tokens(line)
    capitals = (line == F.upper(line)) & line.rlike(r"\p{Lu}") & (F.size(t) <= 3) & F.forall(t, lambda x: F.length(_bare(x)) <= 5)
    singles = F.size(F.filter(t, lambda x: F.length(_bare(x)) <= 1))
    return (line == "") | line.rlike(P.LETTERHEAD_WORDS) | line.rlike(P.PAGE_NUMBER) | capitals | ((F.size(t) >= 4) & (singles / F.size(t) >= 0.6))


def is_debris(line: Column) -> Column:
    """What a letterhead leaves behind: lines of at most ten words."""
    t = _tokens(line)
    letters = F.size(F.filter(t, lambda w: (F.length(_bare(w)) == 1) & w.rlike(r"\p{Lu}") & (w == F.upper(w))))
    named = F.contains(F.lower(line), F.lit(P.ISSUER)) & (F.size(t) <= 6) & (letters >= 2)
    return (F.size(t) <= 10) & (line.rlike(P.DEBRIS) | named)


def clean_lines(lines: DataFrame, min_repeats: int = 3, debris_window: int = 15) -> DataFrame:
    """Lines without noise, debris among the first ones, and headers that repeat in the document; `pos` is numbered anew."""
    order = Window.partitionBy("doc_id").orderBy("pos")
    lines = lines.where(~is_noise(F.col("line"))).withColumn("pos", F.row_number().over(order) - 1)
    lines = lines.where((F.col("pos") >= debris_window) | ~is_debris(F.col("line")))
    key = F.trim(F.regexp_replace(F.lower("line"), r"(?U)\d+", "#"))
    lines = lines.withColumn("__n", F.count(F.lit(1)).over(Window.partitionBy("doc_id", key)))
    header = (F.col("__n") >= min_repeats) & (T.n_words(F.col("line")) <= 8) & ~F.col("line").rlike("[.?!:;,]$") & F.col("line").rlike(r"(?U)^[\p{Lu}\p{Nd}@w]")
    return lines.where(~header).drop("__n").withColumn("pos", F.row_number().over(order) - 1)


def _heading_base(line: Column, following: Column) -> Column:
    """All conditions of a heading but what the line before must be."""
    body = F.trim(F.regexp_replace(line, P.LIST_MARKER, ""))
    t = _tokens(body)
    content = F.filter(t, lambda w: ~F.lower(w).isin(*P.STOPWORDS))
    titled = F.forall(content, lambda w: w.rlike(r"^\p{Lu}") | ~w.rlike(r"^\p{L}"))
    next_ok = F.coalesce(following.rlike(r"^[\p{Lu}\p{Nd}•]"), F.lit(False))
    return F.size(t).between(1, 9) & body.rlike(r"^\p{Lu}") & ~line.rlike("[.?!:;,]$") & next_ok & titled


def with_headings(lines: DataFrame) -> DataFrame:
    """Adds is_heading and heading. A line after a heading needs no full stop before it, so within a run of lines that are otherwise
    headings, all from the first whose forerunner ends a sentence are headings. Headings in a row are joined by ' / '."""
    w = Window.partitionBy("doc_id").orderBy("pos")
    before = F.lag("line").over(w)
    x = lines.withColumn("__base", _heading_base(F.col("line"), F.lead("line").over(w))).withColumn("__ok", F.coalesce(before.rlike("[.?!:]$"), F.lit(True)))
    x = x.withColumn("__run", F.sum((~F.col("__base")).cast("int")).over(w))
    x = x.withColumn("is_heading", F.col("__base") & F.max(F.col("__base") & F.col("__ok")).over(Window.partitionBy("doc_id", "__run").orderBy("pos")))
    title = F.trim(F.regexp_replace("line", P.LIST_MARKER, ""))
    x = x.withColumn("__block", F.sum((F.col("is_heading") & ~F.coalesce(F.lag("is_heading").over(w), F.lit(False))).cast("int")).over(w))
    joined = F.array_join(F.collect_list(F.when(F.col("is_heading"), title)).over(Window.partitionBy("doc_id", "__block").orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)), " / ")
    return x.withColumn("heading", F.when(F.col("__block") > 0, joined).otherwise("")).drop("__base", "__ok", "__run")


def paragraphs(lines: DataFrame) -> DataFrame:
    """(doc_id, paragraph, heading, body) of cleaned lines. Headings, inline headings, numbers and bullets start a paragraph; lines are
    joined by a space, or by nothing after a hyphen."""
    x = with_headings(lines)
    w = Window.partitionBy("doc_id").orderBy("pos")
    inline = F.when(~F.col("is_heading"), F.regexp_extract("line", P.INLINE_HEADING, 1)).otherwise("")
    x = x.withColumn("__inline", inline)
    rest = F.when(F.col("__inline") != "", F.regexp_replace("line", P.INLINE_HEADING, "")).otherwise(F.col("line"))
    x = x.withColumn("__rest", F.regexp_replace(rest, r"(?U)^\s+", ""))
    listed = F.col("__rest").rlike(P.NUMBERED) | F.col("__rest").rlike(P.BULLET)
    x = x.withColumn("__starts", ~F.col("is_heading") & ((F.col("__inline") != "") | listed | F.coalesce(F.lag("is_heading").over(w), F.lit(True))))
    x = x.withColumn("__body", F.regexp_replace(F.regexp_replace("__rest", P.NUMBERED, ""), P.BULLET, ""))
    x = x.withColumn("paragraph", F.sum(F.col("__starts").cast("int")).over(w))
    # An inline heading holds until the next heading of either kind.
    x = x.withColumn("__held", F.last(F.when(F.col("__inline") != "", F.struct("__block", F.trim("__inline").alias("h"))), ignorenulls=True).over(w))
    x = x.withColumn("heading", F.when(F.col("__held.__block") == F.col("__block"), F.col("__held.h")).otherwise(F.col("heading")))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "__body"))), lambda z: z["__body"]), "\u0001")
    out = x.where(~F.col("is_heading")).groupBy("doc_id", "paragraph").agg(F.min_by("heading", "pos").alias("heading"), body.alias("body"))
    return out.withColumn("body", F.regexp_replace(F.regexp_replace("body", "-\u0001", "-"), "\u0001", " "))


def sentence_rows(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """The sentence table of statements: sentence_id, doc_id, paragraph, position, text, n_words, is_short, is_fragment, is_decision,
    section_heading, section_hint. Null texts have no sentences."""
    found = paragraphs(clean_lines(lines_of(docs, id_col, text)))
    x = found.select("doc_id", "paragraph", F.col("heading").alias("section_heading"), F.posexplode(T.sentences(F.col("body"))).alias("__i", "text"))
    return _numbered(x, ["paragraph", "__i"]).withColumn("section_hint", T.section_hint(F.col("section_heading")))


def plain_sentences(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """As `sentence_rows`, of texts without letterheads and headings: each text is one paragraph."""
    x = docs.select(F.col(id_col).alias("doc_id"), F.posexplode(T.sentences(F.col(text))).alias("__i", "text"))
    w = {"paragraph": F.lit(1), "section_heading": F.lit(""), "section_hint": F.lit(""), "position": F.col("__i") + 1}
    return _flagged(x.withColumns(w)).drop("__i")


def _numbered(x: DataFrame, order: list[str]) -> DataFrame:
    return _flagged(x.withColumn("position", F.row_number().over(Window.partitionBy("doc_id").orderBy(*order))).drop("__i"))


def _flagged(x: DataFrame) -> DataFrame:
    return x.withColumns({
        "sentence_id": F.format_string("%s-%03d", F.col("doc_id").cast("string"), F.col("position")),
        "n_words": T.n_words(F.col("text")),
    }).withColumns({
        "is_short": F.col("n_words") < 5,
        "is_fragment": F.col("text").rlike(r"^\p{Ll}"),
        "is_decision": T.is_decision(F.col("text")),
    })
