"""Statistical functions of columns; a Python worker only where Spark has no error function."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType


def softmax(c: Column) -> Column:
    """Softmax of an array, shifted by its greatest element."""
    e = F.transform(c, lambda x: F.exp(x - F.array_max(c)))
    return F.transform(e, lambda x: x / F.aggregate(e, F.lit(0.0), lambda a, b: a + b))


def argmax_label(values: Column, labels: list[str]) -> Column:
    """Label of the greatest element; of equal ones the first in the given order."""
    return F.element_at(F.array(*map(F.lit, labels)), F.array_position(values, F.array_max(values)).cast("int"))


def zscore(c: Column, *by: str) -> Column:
    """(x - mean) / population deviation over all rows or those of a group; 0 where the deviation is 0. With no group and many
    rows use operators.aggregates.with_zscore, which needs no window over all rows."""
    w = Window.partitionBy(*by)
    sd = F.stddev_pop(c).over(w)
    return F.when(sd == 0, F.when(c.isNotNull(), 0.0)).otherwise((c - F.avg(c).over(w)) / sd)


@F.pandas_udf(DoubleType())
def normal_cdf(x: pd.Series) -> pd.Series:
    return x.map(lambda v: 0.5 * math.erfc(-v / math.sqrt(2)))


@F.pandas_udf(DoubleType())
def chi2_sf_1(x: pd.Series) -> pd.Series:
    """Upper tail of the chi-squared distribution with one degree of freedom."""
    return x.map(lambda v: math.erfc(math.sqrt(max(v, 0.0) / 2)))
