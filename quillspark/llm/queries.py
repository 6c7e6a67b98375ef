"""One query per operator over its whole table, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..tables import table
from . import decontam, langid, latticelm, linededup, minhash, packing, pii, secrets, toxicity, vectors


def op1_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"))


def op2_latticelm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return latticelm.op2(table(spark, sf_dir, "documents"))


def op3_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.near_vectors(table(spark, sf_dir, "embeddings"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.op4(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.op5(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op6_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.op6(table(spark, sf_dir, "documents"))


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.op7(table(spark, sf_dir, "documents"))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op9_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.op9(table(spark, sf_dir, "documents"))


def op10_linededup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linededup.op10(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_minhash, op2_latticelm, op3_vectors, op4_toxicity, op5_decontamination, op6_langid, op7_pii, op8_packing, op9_secrets, op10_linededup)
}

ORACLES = {
    "op1_minhash": r"""
with recursive w as (
  select doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') as w from documents),
s as (select doc_id, unnest(case when len(w) >= 5 then list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' ')))
  when len(w) > 0 then [array_to_string(w, ' ')] else [] end) as shingle from w),
n as (select doc_id, count(*) as n from s group by doc_id),
p as (select a.doc_id as x, b.doc_id as y, count(*) as i from s a join s b using (shingle) where a.doc_id < b.doc_id group by 1, 2),
e as (select x, y from p join n nx on nx.doc_id = x join n ny on ny.doc_id = y where 100 * i >= 85 * (nx.n + ny.n - i)),
both_ways as (select x, y from e union select y, x from e),
reach(x, y) as (select x, y from both_ways union select r.x, b.y from reach r join both_ways b on r.y = b.x),
c as (select x as doc_id, min(least(x, y)) as component_id from reach group by x)
select d.doc_id, coalesce(n.n, 0) as n_shingles, coalesce(c.component_id, d.doc_id) as component_id, coalesce(c.component_id, d.doc_id) = d.doc_id as kept
from documents d left join n on n.doc_id = d.doc_id left join c on c.doc_id = d.doc_id
""",
    "op10_linededup": linededup.ORACLE,
}
