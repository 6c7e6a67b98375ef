"""Repeated-line removal: explode normalised lines, hash, count documents per hash, drop, reassemble by position."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scratch import Scratch, free_name

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: A key with more than one of so many lines is frequent, so there are fewer frequent keys than this, which bounds what is broadcast.
FREQUENT = 1000


def line_key(line: Column) -> Column:
    """A line without ASCII white space at its ends, A-Z lower-cased."""
    return F.translate(F.trim(line, F.lit(" \t\n\x0b\f\r")), UPPER, LOWER)


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def _without(text: Column, lost: Column) -> Column:
    """The text without the lines at the places `lost` (from 0); each line and each place is looked at once."""
    def kept(lines: Column) -> Column:
        places = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), lost)
        return F.array_join(F.transform(places, lambda i: F.get(lines, i)), "\n")

    return F.get(F.transform(F.array(_lines(text)), kept), 0)


def drop_repeated_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 10, lines_col: str | None = "n_lines", dropped_col: str | None = "n_dropped") -> DataFrame:
    """`docs` with `text_col` rewritten, and the numbers of lines before and of lines dropped in `lines_col` and `dropped_col` (replacing columns
    of these names; None adds none).

    Lines whose key has at least `min_chars` code points and is found in at least two documents stay only in the
    smallest id that holds the key (there all of them stay); other lines stay. Only hashes of keys are shuffled; how often a hash is found and in
    which ids is a count, a minimum and a maximum, aggregated before the shuffle. Lines of the few frequent hashes are told by a broadcast, so
    they don't meet in one task; the others meet by hash. The places to drop then meet their texts once, by id and text.

    A null or empty text is one empty line and stays as it is. Rows with a null id count as no document and stay
    whole. Rows that share an id are one document: what is dropped is dropped from each. No rows give none."""
    scratch = Scratch(docs.sparkSession, "linededup")
    own = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("t"), F.posexplode(_lines(F.col(text_col))).alias("at", "line"))
    keyed = own.withColumn("line", line_key(F.col("line"))).where(F.length("line") >= min_chars)
    keyed = scratch.keep(keyed.select("id", "t", "at", F.unhex(F.md5("line")).alias("h")))
    ends = keyed.groupBy("h").agg(F.min("id").alias("least"), F.max("id").alias("most"), F.count(F.lit(1)).alias("n")).where("least < most")
    often = F.col("n") > keyed.count() / FREQUENT
    frequent = scratch.keep(ends.where(often).select("h", "least"))
    met = keyed.join(F.broadcast(frequent), "h").union(
        keyed.join(F.broadcast(frequent), "h", "left_anti").join(ends.where(~often).select("h", "least"), "h")
    )
    lost = met.where("id > least").groupBy("id", "t").agg(F.collect_set("at").alias("lost"))
    i, t, x = (free_name(docs.columns, n) for n in ("lost_id", "lost_text", "lost"))
    out = docs.join(lost.withColumnsRenamed({"id": i, "t": t, "lost": x}), (F.col(id_col) == F.col(i)) & (F.xxhash64(text_col) == F.col(t)), "left")
    counts = {lines_col: F.size(_lines(F.col(text_col))).cast("long"), dropped_col: F.when(F.col(x).isNull(), 0).otherwise(F.size(x)).cast("long")}
    text = F.when(F.col(x).isNull(), F.col(text_col)).otherwise(_without(F.col(text_col), F.col(x)))
    kept = [text.alias(c) if c == text_col else F.col(c) for c in docs.columns if c not in counts]
    return out.select(*kept, *(v.alias(c) for c, v in counts.items() if c))


def op10(docs: DataFrame) -> DataFrame:
    """The digest of `drop_repeated_lines`: doc_id, n_lines, n_dropped, kept_sha256 of the remaining text (null: empty)."""
    kept = drop_repeated_lines(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("kept_sha256"))


ORACLE = r"""
with l as (select doc_id, u.i as pos, u.l as line from (select doc_id, unnest(list_transform(string_split(coalesce(text, ''), chr(10)), lambda x, i: {'i': i, 'l': x})) as u from documents)),
k as (select *, translate(trim(line, E' \t\n\x0b\f\r'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as key from l),
g as (select key, min(doc_id) as least from k where length(key) >= 10 group by key having count(distinct doc_id) >= 2),
m as (select k.*, g.key is not null and k.doc_id > g.least as lost from k left join g using (key))
select doc_id, count(*) as n_lines, count(*) filter (lost) as n_dropped,
  sha256(coalesce(string_agg(line, chr(10) order by pos) filter (not lost), '')) as kept_sha256
from m group by doc_id
"""
