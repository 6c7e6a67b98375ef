"""Queries of evaluation: scores, confusion, bootstrap, subsets, agreement; and of the streaming extension."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import evaluation as E
from ..operators import relational as R
from ..tables import table
from .base import query

PREDS = "(select doc_id, row_number() over (order by doc_id) - 1 as nth, quality as truth, toxic as a, cast((quality + doc_id % 3) % 2 as int) as b from labels)"


def predictions(spark, d):
    x = table(spark, d, "labels")
    return x.select("doc_id", F.col("quality").alias("truth"), F.col("toxic").alias("a"), ((F.col("quality") + F.col("doc_id") % 3) % 2).cast("int").alias("b"))


def _f1(pred: str, v: int, w: str = "1") -> str:
    tp, both = f"sum({w}) filter (truth = {v} and {pred} = {v})", f"coalesce(sum({w}) filter (truth = {v}), 0) + coalesce(sum({w}) filter ({pred} = {v}), 0)"
    return f"case when {both} > 0 then 2.0 * coalesce({tp}, 0) / ({both}) else 0.0 end"


@query("select truth, count(*) filter (a = 0) as \"0\", count(*) filter (a = 1) as \"1\", 0 as \"2\" from (select quality as truth, toxic as a from labels) group by 1")
def confusion_matrix(spark, d):
    return E.confusion(predictions(spark, d), "truth", "a", [0, 1, 2])


@query(f"select avg(case when truth = b then 1.0 else 0.0 end) as accuracy, {_f1('b', 0)} as f1_0, {_f1('b', 1)} as f1_1, {_f1('b', 2)} as f1_2, ({_f1('b', 0)} + {_f1('b', 1)} + {_f1('b', 2)}) / 3 as macro_f1 from {PREDS}")
def macro_f1(spark, d):
    return predictions(spark, d).agg(*E.scores("truth", "b", [0, 1, 2]))


@query(f"""with l as (select * from {PREDS}), n as (select count(*) as n from l),
k as (select r.i // n as b, ('0x' || substr(md5('0|' || cast(r.i // n as varchar) || '|' || cast(r.i % n as varchar)), 1, 8))::bigint % n as nth from n, range(0, 1000 * (select count(*) from labels)) r(i)),
s as (select k.b as rep, ({_f1('a', 0)} + {_f1('a', 1)}) / 2 as fa, ({_f1('l.b', 0)} + {_f1('l.b', 1)}) / 2 as fb from k join l using (nth) group by k.b),
m as (select 'a' as metric, fa as v from s union all select 'b', fb from s union all select 'b - a', fb - fa from s)
select metric, round(quantile_cont(v, 0.025), 9) as low, round(quantile_cont(v, 0.975), 9) as high from m group by 1""")
def bootstrap_ci(spark, d):
    x = E.bootstrap(E.numbered(predictions(spark, d), "doc_id", "at"), "at", "truth", ["a", "b"], [0, 1], 1000)
    return x.select("metric", F.round("low", 9).alias("low"), F.round("high", 9).alias("high"))


@query(f"select doc_id, truth, a, b from {PREDS} where (truth is distinct from a or truth is distinct from b)")
def dev_errors(spark, d):
    x = predictions(spark, d)
    return x.where(~F.col("truth").eqNullSafe(F.col("a")) | ~F.col("truth").eqNullSafe(F.col("b"))).select("doc_id", "truth", "a", "b")


@query(f"""select subset, count(*) as n, avg(case when truth = b then 1.0 else 0.0 end) as accuracy from (select unnest(list_filter([case when doc_id % 4 = 0 then 'dev' end, case when doc_id % 4 > 0 then 'test' end, case when doc_id % 4 > 0 and doc_id > 500 then 'test late' end, 'all'], lambda x: x is not null)) as subset, * from {PREDS}) group by 1""")
def overlapping_subsets(spark, d):
    k = F.col("doc_id")
    x = R.overlapping_subsets(predictions(spark, d), {"dev": k % 4 == 0, "test": k % 4 > 0, "test late": (k % 4 > 0) & (k > 500), "all": F.lit(True)})
    return x.groupBy("subset").agg(F.count(F.lit(1)).alias("n"), F.avg((F.col("truth") == F.col("b")).cast("double")).alias("accuracy"))


@query("select avg(case when sign(a) = sign(b) then 1.0 else 0.0 end) as agreement, avg(abs(a - b)) as gap from (select cast(embedding[1] as double) as a, cast(embedding[2] as double) as b from embeddings)")
def model_agreement(spark, d):
    a, b = (F.element_at("embedding", i).cast("double") for i in (1, 2))
    return table(spark, d, "embeddings").agg(F.avg((F.signum(a) == F.signum(b)).cast("double")).alias("agreement"), F.avg(F.abs(a - b)).alias("gap"))


@query("""select count(x) as done, count(*) filter (x is null) as open, coalesce(list_sort(list(doc_id) filter (x = 'bad')), []) as invalid, count(*) filter (x = 'unsure') as unsure
from (select d.doc_id, case when l.doc_id is null then null when l.toxic = 1 and l.doc_id % 10 = 0 then 'bad' when l.doc_id % 7 = 0 then 'unsure' else 'ok' end as x from documents d left join labels l on l.doc_id = d.doc_id)""")
def label_progress(spark, d):
    lab = table(spark, d, "labels").select("doc_id", F.when((F.col("toxic") == 1) & (F.col("doc_id") % 10 == 0), "bad").when(F.col("doc_id") % 7 == 0, "unsure").otherwise("ok").alias("x"))
    x = table(spark, d, "documents").select("doc_id").join(lab, "doc_id", "left")
    return x.agg(F.count("x").alias("done"), F.count_if(F.col("x").isNull()).alias("open"), F.array_sort(F.collect_list(F.when(F.col("x") == "bad", F.col("doc_id")))).alias("invalid"), F.count_if(F.col("x") == "unsure").alias("unsure"))
