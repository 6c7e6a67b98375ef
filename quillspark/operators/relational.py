"""Joins, windows and set operations that have a name of their own."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T


def asof_backward(left: DataFrame, right: DataFrame, date: str, month: str, value: str, max_age_months: int = 3, key: str | None = None) -> DataFrame:
    """Adds `value` of the latest right month before the left date's month; null if it is older than max_age_months.

    The age bound makes it an equi-join: a right row is offered to the max_age_months + 1 months in which it can still be
    used, and of those offered to a month the latest is taken before the join. Both sides shuffle once, by month, and the
    right side has one row a month (and key) then, whatever the left side holds."""
    keys = [key] if key else []
    offered = right.where(F.col(month).isNotNull()).select(*keys, F.trunc(month, "month").alias("__m"), F.col(value).alias("__v"))
    offered = offered.select(*keys, "__m", "__v", F.explode(F.sequence(F.lit(1), F.lit(max_age_months + 1))).alias("__age"))
    best = offered.groupBy(*keys, F.add_months("__m", F.col("__age")).alias("__at")).agg(F.max_by("__v", "__m").alias(value))
    return left.withColumn("__at", F.trunc(date, "month")).join(best, [*keys, "__at"], "left").drop("__at")


def nearest_in_window(left: DataFrame, right: DataFrame, left_date: str, right_date: str, right_id: str, low: int = -5, high: int = 30) -> DataFrame:
    """Adds the right_id whose date is closest to the left date, of those for which left - right is from low to high days; the least id on ties.

    Each left date asks for the days of the window; dates are deduplicated first, so the join is on days, not on rows."""
    days = left.select(F.col(left_date).alias("__d")).where("__d is not null").distinct()
    asked = days.select("__d", F.explode(F.sequence(F.lit(low), F.lit(high))).alias("__diff")).withColumn("__r", F.date_sub("__d", F.col("__diff")))
    least = right.groupBy(F.col(right_date).cast("date").alias("__r")).agg(F.min(right_id).alias(right_id))
    best = asked.join(least, "__r").groupBy("__d").agg(F.min_by(right_id, F.struct(F.abs("__diff").alias("a"), F.col(right_id).alias("b"))).alias(right_id))
    return left.join(best.withColumnRenamed("__d", left_date), left_date, "left")


def unique_month_match(left: DataFrame, right: DataFrame, left_month: str, right_id: str, dates: list[Column]) -> DataFrame:
    """Adds the right_id that has one of its dates in the left month, if it is the only one."""
    months = right.select(F.col(right_id).alias("__id"), F.explode(F.array_distinct(F.array_compact(F.array(*(F.trunc(d, "month") for d in dates))))).alias("__m"))
    only = months.groupBy("__m").agg(F.count(F.lit(1)).alias("__n"), F.max("__id").alias(right_id)).where("__n = 1").select(F.col("__m").alias(left_month), right_id)
    return left.join(only, left_month, "left")


def dedup_first(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key in the given order."""
    return df.withColumn("__rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("__rn = 1").drop("__rn")


def cap_per_group(df: DataFrame, keys: list[str], order: list[Column], n: int) -> DataFrame:
    return df.withColumn("__rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("__rn") <= n).drop("__rn")


def leakage_anti_join(train: DataFrame, held: DataFrame, id_col: str = "id", text: str = "text") -> DataFrame:
    """Training rows that share neither id nor normalised text with the held rows."""
    ids = held.select(F.col(id_col).alias("__id")).distinct()
    texts = held.select(T.normal_form(F.col(text)).alias("__t")).distinct()
    out = train.join(ids, F.col(id_col) == F.col("__id"), "left_anti")
    return out.join(texts, T.normal_form(F.col(text)) == F.col("__t"), "left_anti")


def override(df: DataFrame, fixes: DataFrame, key: str, value: str) -> DataFrame:
    """`value` replaced where a fix names the key."""
    return df.join(fixes.select(key, F.col(value).alias("__fix")), key, "left").withColumn(value, F.coalesce("__fix", value)).drop("__fix")


def overlapping_subsets(df: DataFrame, subsets: dict[str, Column]) -> DataFrame:
    """One row for each named subset that a row is in, in one pass."""
    return df.withColumn("subset", F.explode(F.array_compact(F.array(*(F.when(c, F.lit(k)) for k, c in subsets.items())))))


def latest_wins(rows: DataFrame, keys: list[str], version: Column) -> DataFrame:
    """Upsert: of all rows of a key the one of the greatest version, by aggregation."""
    rest = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), version).alias("__r")).select(*keys, "__r.*")


def pending(feed: DataFrame, manifest: DataFrame, key: str) -> DataFrame:
    """Rows of a feed that the manifest doesn't have as ok."""
    return feed.join(manifest.where("status = 'ok'").select(key), key, "left_anti")


def lag_diff_bp(df: DataFrame, value: str, order: list[str], by: list[str] | None = None) -> DataFrame:
    """Adds change_bp: difference to the row before, times 100, rounded half to even."""
    w = Window.partitionBy(*(by or [])).orderBy(*order)
    return df.withColumn("change_bp", F.bround((F.col(value) - F.lag(value).over(w)) * 100, 0).cast("long"))


def direction_bins(bp: Column) -> Column:
    """cut, hold or hike by right-closed bins at -0.5 and 0.5."""
    return F.when(bp <= -0.5, "cut").when(bp <= 0.5, "hold").when(bp > 0.5, "hike")


def era(year: Column, eras) -> Column:
    return reduce(lambda acc, e: acc.when(year.between(e[1], e[2]), e[0]), eras[1:], F.when(year.between(eras[0][1], eras[0][2]), eras[0][0])).otherwise("")


def time_split(year: Column, last_train: int = 2018, last_validation: int = 2021) -> Column:
    return F.when(year <= last_train, "train").when(year <= last_validation, "validation").otherwise("test")


def with_zscore(df: DataFrame, c: str, out: str) -> DataFrame:
    """Adds (x - mean) / population deviation over all rows (0 where it is 0): two numbers are aggregated and joined back."""
    s = df.agg(F.avg(c).alias("__m"), F.stddev_pop(c).alias("__s"))
    z = F.when(F.col("__s") == 0, F.when(F.col(c).isNotNull(), 0.0)).otherwise((F.col(c) - F.col("__m")) / F.col("__s"))
    return df.join(F.broadcast(s)).withColumn(out, z).drop("__m", "__s")


def exact_quantiles(df: DataFrame, by: str, value: str, wanted: dict[str, float], margin: float = 0.001, few: int = 10_000) -> DataFrame:
    """`by` and the exact interpolated quantiles of each group, by name, without a task that holds a group.

    A sketch, which is of fixed size, gives bounds `margin` of the ranks to either side of each quantile, ten times its error; rows below are
    counted, and only the values between the bounds (of groups of up to `few` rows all) are put in order."""
    x = df.where(F.col(value).isNotNull()).select(F.col(by).alias("__by"), F.col(value).cast("double").alias("__v"))
    ends = [max(0.0, min(1.0, q + s)) for q in wanted.values() for s in (-margin, margin)]
    sketch = x.groupBy("__by").agg(F.count(F.lit(1)).alias("__n"), F.percentile_approx("__v", F.array(*map(F.lit, ends)), F.lit(round(10 / margin))).alias("__e"))
    end = lambda i: F.when((F.col("__n") > few) & F.lit(0 < ends[i] < 1), F.get("__e", i))
    sketch = sketch.select(F.col("__by").alias("__g"), "__n", *(end(i).alias(f"__e{i}") for i in range(len(ends))))
    met = x.join(F.broadcast(sketch), F.col("__by").eqNullSafe(F.col("__g")))
    below = [F.coalesce(F.col("__v") < F.col(f"__e{2 * k}"), F.lit(False)) for k in range(len(wanted))]
    within = [~b & F.coalesce(F.col("__v") <= F.col(f"__e{2 * k + 1}"), F.lit(True)) for k, b in enumerate(below)]
    before = met.groupBy("__by").agg(F.max("__n").alias("__n"), F.array(*(F.count_if(b) for b in below)).alias("__below"))
    near = met.select("__by", "__v", F.explode(F.array_compact(F.array(*(F.when(w, k) for k, w in enumerate(within))))).alias("__k"))
    near = near.groupBy("__by", "__k", "__v").agg(F.count(F.lit(1)).alias("__c"))
    near = near.withColumn("__upto", F.sum("__c").over(Window.partitionBy("__by", "__k").orderBy("__v")))
    near = near.join(F.broadcast(before.withColumnRenamed("__by", "__g")), F.col("__by").eqNullSafe(F.col("__g")))
    at = (F.col("__n") - 1) * F.get(F.array(*map(F.lit, wanted.values())), F.col("__k"))
    upto = F.get("__below", F.col("__k")) + F.col("__upto")
    least = lambda rank: F.min(F.when(upto > rank, F.col("__v")))
    ranks = near.groupBy("__by", "__k").agg(F.first(at).alias("at"), least(F.floor(at)).alias("lo"), least(F.ceil(at)).alias("hi"))
    mixed = F.col("lo") + (F.col("hi") - F.col("lo")) * (F.col("at") - F.floor("at"))
    return ranks.groupBy(F.col("__by").alias(by)).agg(*(F.max(F.when(F.col("__k") == k, mixed)).alias(name) for k, name in enumerate(wanted)))
