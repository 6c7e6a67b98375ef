"""Queries of projections, filters, joins, aggregations, windows, sorting and set operations."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import patterns as P
from ..functions import stats
from ..operators import relational as R
from ..operators.sampling import annotation_sheet, dev_split, draw, round_robin, seeded_sample, split_evenly, stratified_sample
from ..sources.files import as_json
from ..tables import table
from .base import query

MD5 = "md5('{}|' || cast({} as varchar))"
ERA_SQL = "case " + " ".join(f"when {{y}} between {a} and {b} then '{n}'" for n, a, b in P.ERAS) + " else '' end"


# ---- filters and projections ----
@query("select o_orderkey, o_totalprice from orders where o_orderstatus = 'F'")
def filter_eq(spark, d):
    return table(spark, d, "orders").where(F.col("o_orderstatus") == "F").select("o_orderkey", "o_totalprice")


@query("select o_orderkey, o_orderpriority from orders where o_orderpriority in ('1-URGENT', '2-HIGH')")
def filter_in(spark, d):
    return table(spark, d, "orders").where(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH")).select("o_orderkey", "o_orderpriority")


@query("select l_orderkey, l_linenumber, coalesce(case when l_returnflag <> 'N' then l_quantity end between 10 and 30, false) as inside from lineitem")
def filter_between_null(spark, d):
    q = F.when(F.col("l_returnflag") != "N", F.col("l_quantity"))
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.coalesce(q.between(10, 30), F.lit(False)).alias("inside"))


@query("select doc_id, quality from (select doc_id, nullif(quality, 0) as quality from labels) where quality is not null")
def filter_notnull(spark, d):
    return table(spark, d, "labels").select("doc_id", F.nullif("quality", F.lit(0)).alias("quality")).na.drop(subset=["quality"])


@query("select c_custkey as customer, c_mktsegment as segment, c_acctbal as balance from customer")
def project_rename(spark, d):
    return table(spark, d, "customer").select("c_custkey", "c_mktsegment", "c_acctbal").toDF("customer", "segment", "balance")


@query("select o_orderkey, case o_orderstatus when 'F' then 1 when 'O' then -1 end as mapped from orders")
def map_values(spark, d):
    return table(spark, d, "orders").select("o_orderkey", F.create_map(F.lit("F"), F.lit(1), F.lit("O"), F.lit(-1))[F.col("o_orderstatus")].alias("mapped"))


@query("select case when source = 'src0' then '(none)' else source end as source, count(*) as n from documents group by 1")
def sentinel_counts(spark, d):
    return table(spark, d, "documents").withColumn("source", F.when(F.col("source") == "src0", "(none)").otherwise(F.col("source"))).groupBy("source").agg(F.count(F.lit(1)).alias("n"))


@query("""select count(*) filter (coalesce(x, false)) as yes, count(*) filter (coalesce(not x, false)) as no, count(*) filter (x is null) as unknown
from (select l.toxic = 1 as x from documents d left join labels l using (doc_id))""")
def tristate_counts(spark, d):
    x = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id", "left").select((F.col("toxic") == 1).alias("x"))
    return x.agg(F.count_if(F.coalesce("x", F.lit(False))).alias("yes"), F.count_if(F.coalesce(~F.col("x"), F.lit(False))).alias("no"), F.count_if(F.col("x").isNull()).alias("unknown"))


@query(f"select o_orderkey, {ERA_SQL.format(y='year(o_orderdate) + 8')} as era from orders")
def era_bucket(spark, d):
    return table(spark, d, "orders").select("o_orderkey", R.era(F.year("o_orderdate") + 8, P.ERAS).alias("era"))


@query("select o_orderkey, case when year(o_orderdate) + 20 <= 2018 then 'train' when year(o_orderdate) + 20 <= 2021 then 'validation' else 'test' end as split from orders")
def time_split(spark, d):
    return table(spark, d, "orders").select("o_orderkey", R.time_split(F.year("o_orderdate") + 20).alias("split"))


@query("""select l_orderkey, l_linenumber, case when x <= -0.5 then 'cut' when x <= 0.5 then 'hold' when x > 0.5 then 'hike' end as decision
from (select *, case when l_returnflag <> 'R' then l_quantity - 25 end as x from lineitem)""")
def decision_bins(spark, d):
    x = F.when(F.col("l_returnflag") != "R", F.col("l_quantity") - 25)
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", R.direction_bins(x).alias("decision"))


@query("select vec_id, case when e > 0.05 then 'hawkish' when e < -0.05 then 'dovish' else 'balanced' end as lean from (select vec_id, cast(embedding[1] as double) as e from embeddings)")
def net_lean(spark, d):
    net = F.element_at("embedding", 1).cast("double")
    return table(spark, d, "embeddings").select("vec_id", F.when(net > 0.05, "hawkish").when(net < -0.05, "dovish").otherwise("balanced").alias("lean"))


@query("select o_orderkey, coalesce(case when o_orderstatus = 'F' then cast(o_orderdate as date) end, date '2000-01-01') as day from orders")
def date_coalesce(spark, d):
    return table(spark, d, "orders").select("o_orderkey", F.coalesce(F.when(F.col("o_orderstatus") == "F", F.to_date("o_orderdate")), F.lit("2000-01-01").cast("date")).alias("day"))


GAP = "date_diff('day', cast(o_orderdate as date), case when l_returnflag <> 'R' then cast(l_shipdate as date) end)"


@query(f"select l_orderkey, l_linenumber, {GAP} as gap, coalesce(not ({GAP} between -3 and 21), true) as flag from lineitem join orders on l_orderkey = o_orderkey")
def date_gap_flag(spark, d):
    x = table(spark, d, "lineitem").join(table(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    gap = F.datediff(F.when(F.col("l_returnflag") != "R", F.to_date("l_shipdate")), F.to_date("o_orderdate"))
    return x.select("l_orderkey", "l_linenumber", gap.cast("long").alias("gap"), F.coalesce(~gap.between(-3, 21), F.lit(True)).alias("flag"))


# ---- joins ----
@query("select o_orderkey, c_mktsegment from orders join customer on o_custkey = c_custkey")
def join_inner(spark, d):
    return table(spark, d, "orders").join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "c_mktsegment")


@query("select d.doc_id, l.quality from documents d left join labels l on d.doc_id = l.doc_id")
def join_left(spark, d):
    return table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id", "left").select("doc_id", "quality")


@query("""select a.conv_id, a.turn, a.role, b.role as next_role from conversations a left join
(select conv_id, turn - 1 as turn, role from conversations) b on a.conv_id = b.conv_id and a.turn = b.turn""")
def join_left_composite(spark, d):
    a = table(spark, d, "conversations")
    b = a.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("role").alias("next_role"))
    return a.join(b, ["conv_id", "turn"], "left").select("conv_id", "turn", "role", "next_role")


@query("select d.doc_id, l.doc_id is not null as labelled from documents d left join labels l on d.doc_id = l.doc_id")
def coverage_flag(spark, d):
    lab = table(spark, d, "labels").select(F.col("doc_id").alias("lid"))
    return table(spark, d, "documents").join(lab, F.col("doc_id") == F.col("lid"), "left").select("doc_id", F.col("lid").isNotNull().alias("labelled"))


@query("select doc_id, source from documents d where exists (select 1 from labels l where l.doc_id = d.doc_id)")
def join_semi(spark, d):
    return table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id", "left_semi").select("doc_id", "source")


@query("select doc_id, source from documents d where not exists (select 1 from labels l where l.doc_id = d.doc_id)")
def join_anti(spark, d):
    return table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id", "left_anti").select("doc_id", "source")


NORM = r"trim(regexp_replace(lower({}), '[^a-z0-9]+', ' ', 'g'))"


@query(f"""select doc_id from documents d where doc_id not in (select item_id from benchmark)
and {NORM.format('text')} not in (select {NORM.format('b.text')} from benchmark b)""")
def leakage_anti_join(spark, d):
    held = table(spark, d, "benchmark").select(F.col("item_id").alias("id"), "text")
    return R.leakage_anti_join(table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text"), held).select(F.col("id").alias("doc_id"))


@query("select d.doc_id, coalesce(cast(l.quality * 1000 as bigint), d.n_chars) as n_chars from documents d left join labels l using (doc_id)")
def override_lookup(spark, d):
    fixes = table(spark, d, "labels").select("doc_id", (F.col("quality") * 1000).cast("long").alias("n_chars"))
    return R.override(table(spark, d, "documents").select("doc_id", "n_chars"), fixes, "doc_id", "n_chars")


@query("""select vec_id, case when len(a) > 0 and label <> 0 then list_contains(a, label) end as agrees
from (select vec_id, label, list_filter([1, 3, 5, 7], lambda x: x < label + 2 and label <> 1) as a from embeddings)""")
def array_contains_tri(spark, d):
    from ..operators.documents import rate_agrees

    a = F.filter(F.array(*map(F.lit, (1, 3, 5, 7))), lambda x: (x < F.col("label") + 2) & (F.col("label") != 1))
    return table(spark, d, "embeddings").select("vec_id", rate_agrees(F.nullif("label", F.lit(0)), a).alias("agrees"))


@query("""select conv_id, turn, lag(length(text)) over (partition by conv_id order by turn) as before from conversations""")
def prev_row(spark, d):
    w = Window.partitionBy("conv_id").orderBy("turn")
    return table(spark, d, "conversations").select("conv_id", "turn", F.lag(F.length("text")).over(w).cast("long").alias("before"))


# ---- aggregations ----
@query("select event_type, count(*) as n from events group by 1")
def value_counts(spark, d):
    return table(spark, d, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "event_type")


@query("""select year(o_orderdate) as year, count(*) as n, avg(case when o_orderstatus = 'F' then 1 else 0 end) as share,
(count(*) filter (o_orderstatus = 'F') - count(*) filter (o_orderstatus = 'O')) / count(*) as net from orders group by 1""")
def net_by_year(spark, d):
    up, down = F.count_if(F.col("o_orderstatus") == "F"), F.count_if(F.col("o_orderstatus") == "O")
    n = F.count(F.lit(1))
    return table(spark, d, "orders").groupBy(F.year("o_orderdate").cast("long").alias("year")).agg(n.alias("n"), (up / n).alias("share"), ((up - down) / n).alias("net"))


@query("select source, avg(case when length(text) > 1000 then 1 else 0 end) as rate from documents group by 1")
def bool_rate(spark, d):
    return table(spark, d, "documents").groupBy("source").agg(F.avg((F.length("text") > 1000).cast("int")).alias("rate"))


@query("select l_shipmode, n_small, n_large from (select l_returnflag as l_shipmode, count(*) filter (l_quantity < 15) as n_small, count(*) filter (l_quantity > 40) as n_large from lineitem group by 1)")
def count_if(spark, d):
    return table(spark, d, "lineitem").groupBy(F.col("l_returnflag").alias("l_shipmode")).agg(F.count_if(F.col("l_quantity") < 15).alias("n_small"), F.count_if(F.col("l_quantity") > 40).alias("n_large"))


@query("select event_type, count(distinct user_id) as users from events group by 1")
def count_distinct(spark, d):
    return table(spark, d, "events").groupBy("event_type").agg(F.countDistinct("user_id").alias("users"))


@query("""select l_returnflag, min(l_extendedprice) as least, median(l_extendedprice) as middle, quantile_cont(l_extendedprice, 0.9) as q90,
quantile_cont(l_extendedprice, 0.99) as q99, max(l_extendedprice) as most from lineitem group by 1""")
def quantiles(spark, d):
    x = table(spark, d, "lineitem")
    ends = x.groupBy("l_returnflag").agg(F.min("l_extendedprice").alias("least"), F.max("l_extendedprice").alias("most"))
    found = R.exact_quantiles(x, "l_returnflag", "l_extendedprice", {"middle": 0.5, "q90": 0.9, "q99": 0.99})
    return ends.join(F.broadcast(found), ends.l_returnflag.eqNullSafe(found.l_returnflag), "left").select(ends.l_returnflag, "least", "middle", "q90", "q99", "most")


@query("""select count(x) as n, round_even(avg(x), 3) as mean, round_even(stddev_samp(x), 3) as std, min(x) as least, round_even(quantile_cont(x, 0.25), 3) as q25,
round_even(quantile_cont(x, 0.5), 3) as q50, round_even(quantile_cont(x, 0.75), 3) as q75, max(x) as most from (select value as x from events)""")
def describe(spark, d):
    p = lambda q: F.bround(F.percentile("value", F.lit(q)), 3)
    return table(spark, d, "events").agg(
        F.count("value").alias("n"), F.bround(F.avg("value"), 3).alias("mean"), F.bround(F.stddev_samp("value"), 3).alias("std"), F.min("value").alias("least"),
        p(0.25).alias("q25"), p(0.5).alias("q50"), p(0.75).alias("q75"), F.max("value").alias("most"),
    )


@query("""select round_even(corr(l_quantity, l_extendedprice), 2) as quantity_price, round_even(corr(l_quantity, l_discount), 2) as quantity_discount,
round_even(corr(l_extendedprice, l_discount), 2) as price_discount from lineitem""")
def corr_matrix(spark, d):
    c = lambda a, b: F.bround(F.corr(a, b), 2)
    return table(spark, d, "lineitem").agg(c("l_quantity", "l_extendedprice").alias("quantity_price"), c("l_quantity", "l_discount").alias("quantity_discount"), c("l_extendedprice", "l_discount").alias("price_discount"))


@query("""select source, count(*) filter (lang = 'en') as en, count(*) filter (lang = 'fr') as fr, count(*) filter (lang = 'de') as de,
count(*) filter (lang = 'es') as es from documents group by 1""")
def crosstab(spark, d):
    return table(spark, d, "documents").groupBy("source").pivot("lang", ["en", "fr", "de", "es"]).count().na.fill(0)


@query("select o_custkey, string_agg(cast(o_orderkey as varchar), ' ' order by o_orderkey) as keys from orders group by 1")
def string_agg(spark, d):
    """The order keys of each customer: lists are as long as a customer's orders are many."""
    x = table(spark, d, "orders").groupBy("o_custkey").agg(F.array_sort(F.collect_list("o_orderkey")).alias("keys"))
    return x.select("o_custkey", F.array_join(F.transform("keys", lambda k: k.cast("string")), " ").alias("keys"))


@query("select rule, count(*) as n from (select unnest(string_split(concat_ws(' ', p_brand, nullif(p_type, '')), ' ')) as rule from part) group by 1")
def explode_counts(spark, d):
    x = table(spark, d, "part").select(F.explode(F.split(F.concat_ws(" ", "p_brand", F.nullif("p_type", F.lit(""))), " ")).alias("rule"))
    return x.groupBy("rule").agg(F.count(F.lit(1)).alias("n"))


@query("select c_custkey from customer where c_custkey not in (select o_custkey from orders)")
def never_fired(spark, d):
    return table(spark, d, "customer").select("c_custkey").join(table(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "left_anti")


@query("select sum(n * ln(n / total)) as loglik from (select count(*) as n, sum(count(*)) over () as total from events group by event_type)")
def null_loglik(spark, d):
    n = table(spark, d, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))
    return n.agg((F.sum(F.col("n") * F.ln("n")) - F.sum("n") * F.ln(F.sum("n"))).alias("loglik"))


@query("select event_type, sum(count(*)) over () / (count(*) over () * count(*)) as weight from events group by event_type")
def class_weights(spark, d):
    n = table(spark, d, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))
    total = n.agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("k"))
    return n.join(F.broadcast(total)).select("event_type", (F.col("total") / (F.col("k") * F.col("n"))).alias("weight"))


# ---- windows ----
@query("""with m as (select cast(date_trunc('month', o_orderdate) as date) as month, avg(o_totalprice) as price from orders group by 1)
select month, cast(round_even((price - lag(price) over (order by month)) * 100, 0) as bigint) as change_bp from m""")
def lag_diff_bp(spark, d):
    m = table(spark, d, "orders").groupBy(F.to_date(F.date_trunc("month", "o_orderdate")).alias("month")).agg(F.avg("o_totalprice").alias("price"))
    return R.lag_diff_bp(m, "price", ["month"]).select("month", "change_bp")


@query("""with m as (select o_custkey, o_orderkey, o_totalprice, o_totalprice - lag(o_totalprice) over (partition by o_custkey order by o_orderkey) as diff from orders)
select o_custkey, o_orderkey, cast(sign(diff) as double) as dir, lead(cast(sign(diff) as double)) over (partition by o_custkey order by o_orderkey) as next_dir from m""")
def lead_next(spark, d):
    w = Window.partitionBy("o_custkey").orderBy("o_orderkey")
    x = table(spark, d, "orders").withColumn("dir", F.signum(F.col("o_totalprice") - F.lag("o_totalprice").over(w)))
    return x.select("o_custkey", "o_orderkey", "dir", F.lead("dir").over(w).alias("next_dir"))


@query("""select source, doc_id from (select source, doc_id, row_number() over (partition by source order by lang <> 'en', coalesce(l.quality = 0, false), doc_id) as rn
from documents left join labels l using (doc_id)) where rn = 1""")
def choose_primary(spark, d):
    x = table(spark, d, "documents").select("doc_id", "source", "lang").join(table(spark, d, "labels"), "doc_id", "left")
    order = [F.col("lang") != "en", F.coalesce(F.col("quality") == 0, F.lit(False)), F.col("doc_id")]
    return R.dedup_first(x, ["source"], order).select("source", "doc_id")


@query("""select event_id, case when s = 0 then 0 else (value - m) / s end as z from events, (select avg(value) as m, stddev_pop(value) as s from events)""")
def zscore(spark, d):
    return R.with_zscore(table(spark, d, "events").select("event_id", "value"), "value", "z").select("event_id", "z")


@query("""with z as (select o_custkey, o_orderkey, o_orderstatus, o_totalprice, lead(o_orderstatus) over (partition by o_custkey order by o_orderkey) as nxt from orders)
select nxt as next_status, count(*) as n, avg((o_totalprice - m) / s) as mean_z from z, (select avg(o_totalprice) as m, stddev_pop(o_totalprice) as s from orders) where nxt is not null group by 1""")
def tone_by_next(spark, d):
    x = R.with_zscore(table(spark, d, "orders").select("o_custkey", "o_orderkey", "o_orderstatus", "o_totalprice"), "o_totalprice", "z")
    x = x.withColumn("next_status", F.lead("o_orderstatus").over(Window.partitionBy("o_custkey").orderBy("o_orderkey"))).na.drop(subset=["next_status"])
    return x.groupBy("next_status").agg(F.count(F.lit(1)).alias("n"), F.avg("z").alias("mean_z"))


@query("select conv_id, turn, printf('%s-%03d', cast(conv_id as varchar), row_number() over (partition by conv_id order by turn)) as sentence_id from conversations")
def sentence_position(spark, d):
    n = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn"))
    return table(spark, d, "conversations").select("conv_id", "turn", F.format_string("%s-%03d", F.col("conv_id").cast("string"), n).alias("sentence_id"))


@query(f"select item_id, printf('G%03d', row_number() over (order by {MD5.format(42, 'item_id')})) as gold_id from benchmark")
def sequential_ids(spark, d):
    n = F.row_number().over(Window.orderBy(draw(42, "item_id")))
    return table(spark, d, "benchmark").select("item_id", F.format_string("G%03d", n).alias("gold_id"))


@query(f"select doc_id, source, row_number() over (partition by source order by {MD5.format(7, 'doc_id')}, doc_id) as turn from documents", name="round_robin")
def round_robin_(spark, d):
    return round_robin(table(spark, d, "documents").select("doc_id", "source"), "source", 7, "doc_id").select("doc_id", "source", F.col("turn").cast("long").alias("turn"))


@query("select source, doc_id from (select source, doc_id, row_number() over (partition by source order by n_chars desc, doc_id) as rn from documents) where rn <= 8")
def cap_per_group(spark, d):
    return R.cap_per_group(table(spark, d, "documents"), ["source"], [F.desc("n_chars"), F.col("doc_id")], 8).select("source", "doc_id")


@query(f"""select doc_id, case when row_number() over (partition by source, lang order by {MD5.format(5, 'doc_id')}, doc_id)
<= round_even(0.25 * count(*) over (partition by source, lang), 0) then 'dev' else 'test' end as split from documents""", name="dev_split")
def dev_split_(spark, d):
    return dev_split(table(spark, d, "documents").select("doc_id", "source", "lang"), ["source", "lang"], 5, "doc_id").select("doc_id", "split")


@query("select l_orderkey, l_linenumber, count(*) over (partition by l_orderkey, l_partkey) > 1 as repeated from lineitem")
def duplicate_keys(spark, d):
    n = F.count(F.lit(1)).over(Window.partitionBy("l_orderkey", "l_partkey"))
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", (n > 1).alias("repeated"))


@query("""select o_custkey, bool_and(coalesce(o_orderdate >= b, true)) as monotonic from (select o_custkey, o_orderdate, lag(o_orderdate) over (partition by o_custkey order by o_orderkey) as b from orders) group by 1""")
def monotonic_check(spark, d):
    before = F.lag("o_orderdate").over(Window.partitionBy("o_custkey").orderBy("o_orderkey"))
    x = table(spark, d, "orders").select("o_custkey", F.coalesce(F.col("o_orderdate") >= before, F.lit(True)).alias("ok"))
    return x.groupBy("o_custkey").agg(F.bool_and("ok").alias("monotonic"))


@query("select lang, source, min(doc_id) as doc_id from documents group by 1, 2")
def dedup_first(spark, d):
    return R.dedup_first(table(spark, d, "documents").select("lang", "source", "doc_id"), ["lang", "source"], [F.col("doc_id")])


# ---- sorting, sampling ----
@query("select coalesce(nullif(l_linestatus, 'O'), '0') as status, l_orderkey, l_linenumber from lineitem order by 1, 2, 3")
def sort_multi(spark, d):
    s = F.coalesce(F.nullif("l_linestatus", F.lit("O")), F.lit("0")).alias("status")
    return table(spark, d, "lineitem").select(s, "l_orderkey", "l_linenumber").orderBy("status", "l_orderkey", "l_linenumber")


@query("select user_id, count(*) as n from events group by 1 order by n desc, user_id limit 10")
def topk_counts(spark, d):
    return table(spark, d, "events").groupBy("user_id").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "user_id").limit(10)


@query("select doc_id, n_chars from documents order by n_chars desc, doc_id limit 5")
def nlargest(spark, d):
    return table(spark, d, "documents").select("doc_id", "n_chars").orderBy(F.desc("n_chars"), "doc_id").limit(5)


@query("select conv_id, turn from (select conv_id, turn, row_number() over (partition by conv_id order by turn) as rn from conversations) where rn <= 3")
def limit_per_doc(spark, d):
    return R.cap_per_group(table(spark, d, "conversations"), ["conv_id"], [F.col("turn")], 3).select("conv_id", "turn")


@query("""select vec_id, case when a >= b and a >= c then 'dovish' when b >= c then 'neutral' else 'hawkish' end as label
from (select vec_id, round(embedding[1], 1) as a, round(embedding[2], 1) as b, round(embedding[3], 1) as c from (select vec_id, list_transform(embedding, lambda x: cast(x as double)) as embedding from embeddings))""")
def argmax_label(spark, d):
    v = F.transform(F.slice("embedding", 1, 3), lambda x: F.round(x.cast("double"), 1))
    return table(spark, d, "embeddings").select("vec_id", stats.argmax_label(v, ["dovish", "neutral", "hawkish"]).alias("label"))


@query("""select vec_id, list_filter(embedding[1:60], lambda x: x > 0.2)[1] as first_over from embeddings""")
def first_qualifying(spark, d):
    return table(spark, d, "embeddings").select("vec_id", F.get(F.filter(F.slice("embedding", 1, 60), lambda x: x > 0.2), 0).alias("first_over"))


@query(f"select doc_id from documents order by {MD5.format(11, 'doc_id')}, doc_id limit 100", name="seeded_sample")
def seeded_sample_(spark, d):
    return seeded_sample(table(spark, d, "documents").select("doc_id"), 100, 11, "doc_id")


@query("select i as part, 144 // 3 + case when i < 144 % 3 then 1 else 0 end as share, 17 // 5 + case when i < 17 % 5 then 1 else 0 end as other from range(3) t(i)", name="split_evenly")
def split_evenly_(spark, d):
    rows = [(i, a, b) for i, (a, b) in enumerate(zip(split_evenly(144, 3), split_evenly(17, 5), strict=False))]
    return spark.createDataFrame(rows, "part long, share long, other long")


POOL = {"tone_weak": ["hawkish", "neutral", "dovish"], "era": list(P.QUOTAS)}


def pool(spark, d):
    """Documents as a sampling pool: tone from the length, era from the source."""
    pick = lambda values, c: F.get(F.array(*map(F.lit, values)), c.cast("int"))
    x = table(spark, d, "documents")
    return x.select(
        F.col("doc_id").cast("string").alias("sentence_id"), (F.col("doc_id") % 400).alias("doc_id"), F.col("text"),
        pick(POOL["era"], F.regexp_extract("source", r"(\d+)", 1).cast("int") % 4).alias("era"), pick(POOL["tone_weak"], F.col("n_chars") % 3).alias("tone_weak"),
        F.col("lang").alias("topic_weak"), F.md5(F.lower("text").cast("binary")).alias("norm_text"), F.lit("").alias("section_heading"),
    )


@query(name="stratified_sample")
def stratified_sample_(spark, d):
    """Counts of the sample by era and draw; tests hold its properties."""
    return stratified_sample(pool(spark, d)).groupBy("era", "draw").agg(F.count(F.lit(1)).cast("int").alias("n"))


@query(f"select printf('G%03d', row_number() over (order by {MD5.format(42, 'item_id')})) as gold_id, '' as section_heading, text as sentence, cast(null as varchar) as tone, cast(null as varchar) as topic, cast(null as varchar) as unsure, cast(null as varchar) as notes from benchmark", name="annotation_sheet")
def annotation_sheet_(spark, d):
    n = F.row_number().over(Window.orderBy(draw(42, "item_id")))
    return annotation_sheet(table(spark, d, "benchmark").select(F.format_string("G%03d", n).alias("gold_id"), F.lit("").alias("section_heading"), "text"))


# ---- sets, arrays, json ----
@query("select s_suppkey as k, s_name as name from supplier union all select c_custkey, c_name from customer")
def union_all(spark, d):
    a = table(spark, d, "supplier").select(F.col("s_suppkey").alias("k"), F.col("s_name").alias("name"))
    return a.unionByName(table(spark, d, "customer").select(F.col("c_name").alias("name"), F.col("c_custkey").alias("k")))


@query("select distinct p_brand, p_size from part")
def distinct(spark, d):
    return table(spark, d, "part").select("p_brand", "p_size").distinct()


@query("select source, list_sort(list_intersect(list(distinct lang), ['en', 'fr', 'xx'])) as both from documents group by 1")
def array_intersect(spark, d):
    return table(spark, d, "documents").groupBy("source").agg(F.array_sort(F.array_intersect(F.collect_set("lang"), F.array(*map(F.lit, ("en", "fr", "xx"))))).alias("both"))


@query("""select vec_id, list_reverse(e[1:3]) as head, list_bool_or(list_transform(e, lambda x: x > 0.3)) as some, list_bool_and(list_transform(e, lambda x: x < 0.5)) as every,
list_sort(list_distinct(list_transform(e[1:8], lambda x: round(x, 1) + 0.0))) as steps from (select vec_id, list_transform(embedding, lambda x: cast(x as double)) as e from embeddings)""")
def array_ops(spark, d):
    e = F.transform("embedding", lambda x: x.cast("double"))
    return table(spark, d, "embeddings").select(
        "vec_id", F.reverse(F.slice(e, 1, 3)).alias("head"), F.exists(e, lambda x: x > 0.3).alias("some"), F.forall(e, lambda x: x < 0.5).alias("every"),
        F.array_sort(F.array_distinct(F.transform(F.slice(e, 1, 8), lambda x: F.round(x, 1) + 0.0))).alias("steps"),
    )


@query("""select vec_id, list_transform(x, lambda v: round(v / list_sum(x), 9)) as p from (select vec_id, list_transform(embedding[1:3], lambda v: exp(cast(v as double))) as x from embeddings)""")
def softmax(spark, d):
    p = stats.softmax(F.transform(F.slice("embedding", 1, 3), lambda v: v.cast("double")))
    return table(spark, d, "embeddings").select("vec_id", F.transform(p, lambda v: F.round(v, 9)).alias("p"))


@query("select event_id, cast(json_extract_string(props, '$.k') as bigint) as k from events")
def json_props(spark, d):
    return table(spark, d, "events").select("event_id", F.from_json("props", "k long")["k"].alias("k"))


@query("""select '{"o_orderkey":' || o_orderkey || ',"status":' || case when o_orderstatus = 'F' then 'null' else '"' || o_orderstatus || '"' end || ',"day":"' || strftime(o_orderdate, '%Y-%m-%d') || '"}' as json from orders""")
def json_export(spark, d):
    x = table(spark, d, "orders").select("o_orderkey", F.nullif("o_orderstatus", F.lit("F")).alias("status"), F.to_date("o_orderdate").alias("day"))
    return as_json(x)


# ---- scans ----
@query("select r_regionkey, r_name from region where r_regionkey > 1")
def scan_column_pruning(spark, d):
    return table(spark, d, "region").where("r_regionkey > 1").select("r_regionkey", "r_name")


@query("select n_nationkey, n_name, n_regionkey, date '2020-02-29' as day, case when n_nationkey % 2 = 0 then n_nationkey + 0.5 end as v from nation")
def scan_csv_roundtrip(spark, d):
    """A table through CSV: written into the warehouse folder, read with a declared schema."""
    import uuid

    from ..sources.files import read_csv, write_csv

    v = F.when(F.col("n_nationkey") % 2 == 0, F.col("n_nationkey") + F.lit(0.5))
    x = table(spark, d, "nation").select("n_nationkey", "n_name", "n_regionkey", F.lit("2020-02-29").cast("date").alias("day"), v.alias("v"))
    path = f"{spark.conf.get('spark.sql.warehouse.dir')}/csv-{uuid.uuid4().hex}"
    write_csv(x, path)
    return read_csv(spark, path, "n_nationkey int, n_name string, n_regionkey int, day date, v double")
