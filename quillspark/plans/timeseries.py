"""Queries of the decision series and of matching by date."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import documents as D
from ..operators import probit
from ..operators import relational as R
from ..operators import series
from ..tables import table
from .base import query

MONTHLY = "(select cast(date_trunc('month', l_shipdate) as date) as month, avg(l_extendedprice) as v from lineitem where month(l_shipdate) not in (2, 3, 4, 5, 6) group by 1)"


@query(f"""select o_orderkey, case when date_diff('month', m.month, date_trunc('month', o.day) - interval 1 month) <= 3 then m.v end as v
from (select o_orderkey, cast(o_orderdate as date) as day, cast(date_trunc('month', o_orderdate) - interval 1 month as date) as at from orders) o asof left join {MONTHLY} m on m.month <= o.at""")
def asof_backward(spark, d):
    cpi = table(spark, d, "lineitem").where(~F.month("l_shipdate").isin(2, 3, 4, 5, 6)).groupBy(F.to_date(F.date_trunc("month", "l_shipdate")).alias("month")).agg(F.avg("l_extendedprice").alias("v"))
    o = table(spark, d, "orders").select("o_orderkey", F.to_date("o_orderdate").alias("day"))
    return R.asof_backward(o, cpi, "day", "month", "v").select("o_orderkey", "v")


MEETINGS = "(select row_number() over (order by m) as no, m + 9 as day from (select distinct cast(date_trunc('month', o_orderdate) as date) as m from orders where month(o_orderdate) % 2 = 1))"


def meetings(spark, d):
    m = table(spark, d, "orders").where(F.month("o_orderdate") % 2 == 1).select(F.to_date(F.date_trunc("month", "o_orderdate")).alias("m")).distinct()
    from pyspark.sql import Window

    return m.select(F.row_number().over(Window.orderBy("m")).cast("long").alias("no"), F.date_add("m", 9).alias("day_"))


@query(f"""select o_orderkey, no from (select o_orderkey, m.no, row_number() over (partition by o_orderkey order by abs(date_diff('day', m.day, cast(o_orderdate as date))), m.no) as rn
from orders left join {MEETINGS} m on date_diff('day', m.day, cast(o_orderdate as date)) between -5 and 30) where rn = 1""")
def nearest_in_window(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", F.to_date("o_orderdate").alias("d"))
    return R.nearest_in_window(o, meetings(spark, d), "d", "day_", "no").select("o_orderkey", "no")


@query(f"""with x as (select distinct no, date_trunc('month', u) as mon from (select no, unnest([day, day + cast(no % 3 * 25 as int)]) as u from {MEETINGS})), u as (select mon, max(no) as no from x group by 1 having count(*) = 1)
select o_orderkey, u.no from orders left join u on u.mon = date_trunc('month', o_orderdate)""")
def unique_month_match(spark, d):
    m = meetings(spark, d).withColumn("other", F.expr("date_add(day_, cast(no % 3 * 25 as int))"))
    o = table(spark, d, "orders").select("o_orderkey", F.to_date(F.date_trunc("month", "o_orderdate")).alias("mon"))
    return R.unique_month_match(o, m, "mon", "no", [F.col("day_"), F.col("other")]).select("o_orderkey", "no")


@query("select item_id, len(list_distinct(list_filter([case when item_id % 2 = 0 then item_id % 3 end, case when item_id % 5 > 0 then item_id % 4 end, 1], lambda x: x is not null))) > 1 as conflict from benchmark")
def clue_conflict(spark, d):
    k = F.col("item_id")
    x = table(spark, d, "benchmark").withColumns({"a": F.when(k % 2 == 0, k % 3), "b": F.when(k % 5 > 0, k % 4), "c": F.lit(1).cast("long")})
    return x.select("item_id", D.conflict("a", "b", "c").alias("conflict"))


def raw_series(spark, d):
    """One meeting a month: its rate is the month's mean order price in thousands; three are emergencies."""
    m = table(spark, d, "orders").groupBy(F.to_date(F.date_trunc("month", "o_orderdate")).alias("m")).agg(F.round(F.avg("o_totalprice") / 1000, 1).alias("mpr"))
    no = F.expr("cast(months_between(m, date '1995-01-01') as int) + 1")
    dates = F.concat(F.date_format("m", "MMMM"), F.lit(" 3 – 5, "), F.date_format("m", "yyyy"), F.when(no % 30 == 0, " (Emergency)").otherwise(""))
    return m.select(no.alias("meeting_no"), dates.alias("mpc_dates"), F.date_format(F.date_add("m", F.when(no % 13 == 0, 40).otherwise(7)), "d MMM yyyy").alias("effective_raw"), "mpr")


SERIES = """(with m as (select cast(date_trunc('month', o_orderdate) as date) as m, round(avg(o_totalprice) / 1000, 1) as mpr from orders group by 1),
n as (select *, cast(date_diff('month', date '1995-01-01', m) as int) + 1 as meeting_no from m),
u as (select meeting_no, case when meeting_no % 30 = 0 then 'emergency' else 'regular' end as meeting_type, m + 4 as meeting_end, case when meeting_no = 2 then 99.5 else mpr end as mpr, meeting_no % 13 = 0 as effective_date_flag, meeting_no = 2 as corrected from n
union all select 500, 'emergency', date '2002-01-20', 7.5, false, true)
select *, cast(round_even((mpr - lag(mpr) over (order by meeting_end, meeting_no)) * 100, 0) as bigint) as mpr_change_bp from u)"""
DECISION = "case when mpr_change_bp <= -0.5 then 'cut' when mpr_change_bp <= 0.5 then 'hold' when mpr_change_bp > 0.5 then 'hike' end"


def cleaned(spark, d):
    raw = raw_series(spark, d)
    old = raw.where("meeting_no = 2").select(F.col("mpr").cast("string").alias("old_value"))
    fix = old.select(F.lit(1).alias("seq"), F.lit(2).alias("meeting_no"), F.lit("regular").alias("meeting_type"), F.lit("mpr").alias("field"), "old_value", F.lit("99.5").alias("new_value"))
    add = spark.createDataFrame([(500, "emergency", "2002-01-20", 7.5)], "meeting_no int, meeting_type string, meeting_end string, mpr double").withColumns({"meeting_end": F.to_date("meeting_end"), "meeting_start": F.lit(None).cast("date")})
    return series.clean_series(raw, fix, add)


@query(f"select meeting_no, meeting_type, meeting_end, effective_date_flag, mpr, mpr_change_bp, {DECISION} as decision, corrected from {SERIES}")
def clean_series(spark, d):
    return cleaned(spark, d).select("meeting_no", "meeting_type", "meeting_end", "effective_date_flag", "mpr", "mpr_change_bp", "decision", "corrected")


@query(f"select meeting_no, meeting_type, mpr, corrected from {SERIES} where meeting_no < 500")
def audited_update(spark, d):
    x = series.clean_series(raw_series(spark, d)).withColumn("corrected", F.lit(False))
    old = x.where("meeting_no = 2").select(F.col("mpr").cast("string").alias("old_value"))
    fix = old.select(F.lit(1).alias("seq"), F.lit(2).alias("meeting_no"), F.lit("regular").alias("meeting_type"), F.lit("mpr").alias("field"), "old_value", F.lit("99.5").alias("new_value"))
    return series.audited_update(x, fix).select("meeting_no", "meeting_type", "mpr", "corrected")


INDEX = "(select meeting_no, (meeting_no * 7 % 11) / 10.0 - 0.5 as lexicon_net, (meeting_no * 5 % 13) / 10.0 - 0.6 as model_net, 10 as n_scored from {} where meeting_type = 'regular' and meeting_no % 9 > 0)"


def index_of(rates):
    k = F.col("meeting_no")
    return rates.where("meeting_type = 'regular' and meeting_no % 9 > 0").select(k, "meeting_type", ((k * 7 % 11) / F.lit(10.0) - 0.5).alias("lexicon_net"), ((k * 5 % 13) / F.lit(10.0) - 0.6).alias("model_net"), F.lit(10).alias("n_scored"))


@query(f"""with s as (select * from {SERIES}), r as (select *, cast(sign(mpr_change_bp) as double) as dir, year(meeting_end) as year from s where meeting_type = 'regular'), n as (select *, lead(dir) over (order by meeting_no) as next_dir from r)
select n.meeting_no, n.dir, n.next_dir, n.year, i.lexicon_net, i.model_net, cast(null as double) as infl from n join {INDEX.format('s')} i using (meeting_no) where dir is not null and next_dir is not null""")
def analysis_frame(spark, d):
    rates = cleaned(spark, d)
    x = series.analysis_frame(index_of(rates), rates, None)
    return x.select("meeting_no", "dir", "next_dir", F.col("year").cast("long").alias("year"), "lexicon_net", "model_net", "infl")


def statements(spark, d):
    """A statement for each meeting but some; some have a second version, a summary, a wrong title or no letterhead."""
    rates = cleaned(spark, d)
    k = F.col("meeting_no")
    kinds = F.array(F.lit(0), F.when(k % 6 == 0, 1), F.when((k % 10 == 0) & (F.col("meeting_type") == "regular"), 2))
    x = rates.where("meeting_no % 8 <> 7").select("*", F.explode(F.array_compact(kinds)).alias("kind"))
    doc = (k * 10 + F.col("kind")).cast("string")
    day = F.date_format("meeting_end", "MMMM d, yyyy")
    head = F.when((k % 5 == 4) & (F.col("meeting_type") == "regular"), F.concat(F.lit("The "), k.cast("string"), F.lit("th meeting of the MPC "))).otherwise(F.concat(F.lit("Monetary Policy Committee "), day, F.lit(" ")))
    body = F.concat(head, F.lit("the policy rate at "), F.col("mpr").cast("string"), F.lit(" per cent. "), F.when(F.col("kind") == 1, F.repeat(F.lit("other words "), F.lit(30))).otherwise(F.lit("some words")))
    kind = F.when(F.col("kind") == 2, "highlights").when(F.col("meeting_type") == "emergency", "emergency").otherwise("press_release")
    return x.select(doc.alias("doc_id"), F.concat(F.lit("MPC Press Release "), F.date_format("meeting_end", "MMMM yyyy")).alias("title"), kind.alias("doc_type"), body.alias("text")), rates


#: What `statements` makes, as SQL; the number in the text is the meeting's, so each statement finds its own meeting.
STATEMENTS = f"(select s.*, k, cast(s.meeting_no * 10 + k as varchar) as doc_id, s.meeting_no % 5 = 4 and meeting_type = 'regular' as unlettered from (select * from {SERIES}) s, (values (0), (1), (2)) t(k) where s.meeting_no % 8 <> 7 and (k = 0 or (k = 1 and s.meeting_no % 6 = 0) or (k = 2 and s.meeting_no % 10 = 0 and meeting_type = 'regular')))"


@query(f"select doc_id, meeting_no, case when unlettered then 'text_number' else 'letterhead_date' end as match_method from {STATEMENTS} where meeting_no < 141 and meeting_type = 'regular'")
def match_cascade(spark, d):
    docs, rates = statements(spark, d)
    return D.match_documents(docs, rates).where("meeting_type = 'regular' and meeting_no < 141").select("doc_id", "meeting_no", "match_method")


@query(f"select doc_id, case when k = 0 then 'primary' when k = 2 then 'summary_of_primary' else 'conflicting_version' end as role, case when k > 0 then cast(meeting_no * 10 as varchar) end as duplicate_of from {STATEMENTS}")
def document_roles(spark, d):
    docs, rates = statements(spark, d)
    return D.assign_roles(D.match_documents(docs, rates)).select("doc_id", "role", "duplicate_of")


@query()
def ordered_probit(spark, d):
    """Coefficient and tests of the index on the next decision; tests check the estimator on series with a known effect."""
    rates = cleaned(spark, d)
    frame = series.analysis_frame(index_of(rates), rates, None)
    r = probit.test_variable(frame, "next_dir", "lexicon_net", ["dir"])
    return spark.createDataFrame([(r["n"], r["coef"], r["se"], r["lr"], r["p_lr"], r["aic_base"], r["aic_full"])], "n long, coef double, se double, lr double, p_lr double, aic_base double, aic_full double")
