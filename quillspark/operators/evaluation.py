"""Scores of classifiers: accuracy, F1, confusion, paired bootstrap."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .sampling import uniform

#: Rows of one block of a lookup table.
BLOCK = 65_536


def f1(truth: Column, pred: Column, label: Column) -> Column:
    """F1 of one label as an aggregate; 0 where nothing has it."""
    tp = F.count_if((truth == label) & (pred == label))
    both = F.count_if(truth == label) + F.count_if(pred == label)
    return F.when(both > 0, 2 * tp / both).otherwise(0.0)


def scores(truth: str, pred: str, labels: list) -> list[Column]:
    """accuracy, f1_<label> and macro_f1 as aggregates; absent labels count as 0 in the mean."""
    each = [f1(F.col(truth), F.col(pred), F.lit(v)) for v in labels]
    mean = sum(each[1:], each[0]) / len(labels)
    return [F.avg((F.col(truth) == F.col(pred)).cast("double")).alias("accuracy"), *(e.alias(f"f1_{v}") for e, v in zip(each, labels, strict=True)), mean.alias("macro_f1")]


def confusion(df: DataFrame, truth: str, pred: str, labels: list) -> DataFrame:
    """Truth by prediction with all labels in the given order."""
    return df.groupBy(truth).pivot(pred, labels).count().na.fill(0)


def numbered(df: DataFrame, order: str, name: str) -> DataFrame:
    """Adds the number of each row, from 0, in the order of a numeric column of distinct values without nulls. Rows are sorted within ranges of the column,
    whose bounds and sizes are all that reaches the driver, so no task sees all rows."""
    parts = 2 * df.sparkSession.sparkContext.defaultParallelism
    bounds = sorted(set(df.approxQuantile(order, [i / parts for i in range(1, parts)], 0.001)))
    part = F.size(F.filter(F.array(*map(F.lit, bounds)).cast("array<double>"), lambda x: x < F.col(order)))
    sizes = {r[0]: r[1] for r in df.groupBy(part.alias("part")).count().collect()}
    before = [sum(sizes.get(j, 0) for j in range(i)) for i in range(len(bounds) + 1)]
    at = F.row_number().over(Window.partitionBy(part).orderBy(order)) - 1 + F.get(F.array(*map(F.lit, before)), part)
    return df.withColumn(name, at.cast("long"))


def first_that_agrees(options: list[tuple[str, float]], least: float = 0.97) -> str | None:
    """Of options in their order, each with its share of equal labels, the first that reaches `least`; None if none does."""
    return next((name for name, share in options if share >= least), None)


def check_labels(mapping: dict[int, str], expected: tuple[str, ...]) -> dict[int, str]:
    """The mapping of class numbers to names, or an error unless it names each expected class once, numbered from 0."""
    if sorted(mapping) != list(range(len(expected))) or sorted(mapping.values()) != sorted(expected):
        raise ValueError(f"Label mapping {mapping} does not name {expected}")
    return mapping


def bootstrap(df: DataFrame, order: str, truth: str, preds: list[str], labels: list, n: int, seed: int = 0) -> DataFrame:
    """metric, low, high: 95 % intervals of each system's macro-F1 and of its difference from the first system, over n samples that all systems share.

    `order` numbers the rows from 0. Each replicate draws numbers by md5. All that counts of a row is which of `labels`, or none, its truth and its
    predictions are, which is one number: these are broadcast in blocks of BLOCK rows, 4 bytes a row, and draws look them up. So n times the rows are
    drawn, which is inherent, but neither shuffled nor joined by row; what is shuffled is n times the cells."""
    size, base, cols = df.count(), len(labels) + 1, [truth, *preds]
    index = lambda c: F.coalesce(*(F.when(F.col(c) == v, k) for k, v in enumerate(labels)), F.lit(len(labels)))
    cell = sum((index(c) * base**k for k, c in enumerate(cols[1:], 1)), index(truth)).cast("int")
    rows = df.select(F.col(order).alias("at"), cell.alias("cell")).groupBy((F.col("at") / BLOCK).cast("long").alias("block"))
    blocks = rows.agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "cell"))), lambda x: x["cell"]).alias("cells"))
    picks = df.sparkSession.range(0, n * size, 1).select((F.col("id") / size).cast("long").alias("__b"), (F.col("id") % size).alias("__i"))
    picks = picks.select("__b", (uniform(seed, "__b", "__i") % size).alias("at"))
    met = picks.withColumn("block", (F.col("at") / BLOCK).cast("long")).join(F.broadcast(blocks), "block")
    counts = met.groupBy("__b", F.get("cells", (F.col("at") % BLOCK).cast("int")).alias("__cell")).agg(F.count(F.lit(1)).alias("__w"))
    cells = counts.select("__b", "__w", *((F.col("__cell") / base**k).cast("long") % base for k in range(len(cols)))).toDF("__b", "__w", *cols)
    out = {}
    for p in preds:
        each = []
        for v in range(len(labels)):
            count = lambda c: F.sum(F.when(c, F.col("__w")).otherwise(0))
            tp, both = count((F.col(truth) == v) & (F.col(p) == v)), count(F.col(truth) == v) + count(F.col(p) == v)
            each.append(F.when(both > 0, 2 * tp / both).otherwise(0.0))
        out[p] = (sum(each[1:], each[0]) / len(labels)).alias(p)
    per = cells.groupBy("__b").agg(*out.values())
    metrics = [F.struct(F.lit(p).alias("metric"), F.col(p).alias("v")) for p in preds] + [F.struct(F.lit(f"{p} - {preds[0]}").alias("metric"), (F.col(p) - F.col(preds[0])).alias("v")) for p in preds[1:]]
    rows = per.select(F.explode(F.array(*metrics)).alias("m")).select("m.*")
    return rows.groupBy("metric").agg(F.percentile("v", F.lit(0.025)).alias("low"), F.percentile("v", F.lit(0.975)).alias("high"))
