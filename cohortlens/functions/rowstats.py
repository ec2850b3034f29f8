"""Null-skipping row-wise statistics over a handful of columns.

All of these are plain Column arithmetic (no UDF), so they compile into the
surrounding whole-stage-codegen span.
"""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column
from pyspark.sql import functions as F


def _cols(names):
    return [F.col(c) if isinstance(c, str) else c for c in names]


def nan_to_null(c: Column | str) -> Column:
    """NaN -> NULL (Spark orders NaN above every number, Python compares it False)."""
    c = F.col(c) if isinstance(c, str) else c
    return F.when(~F.isnan(c), c)


def non_null_count(names) -> Column:
    return reduce(add, [F.when(c.isNotNull(), F.lit(1)).otherwise(F.lit(0)) for c in _cols(names)])


def null_safe_sum(names) -> Column:
    return reduce(add, [F.coalesce(c, F.lit(0.0)) for c in _cols(names)])


def row_mean(names) -> Column:
    """Mean of the non-null values; NULL when all are NULL."""
    return F.try_divide(null_safe_sum(names), non_null_count(names).cast("double"))


def _sq_dev_sum(names, mean: Column) -> Column:
    return reduce(add, [F.coalesce((c - mean) * (c - mean), F.lit(0.0)) for c in _cols(names)])


def row_var_sample(names) -> Column:
    """Sample variance (ddof 1) of the non-null values; NULL below two values."""
    n = non_null_count(names)
    ss = _sq_dev_sum(names, row_mean(names))
    return F.when(n >= 2, F.try_divide(ss, (n - 1).cast("double")))


def row_var_population(names) -> Column:
    """Population variance (ddof 0) of the non-null values."""
    n = non_null_count(names)
    ss = _sq_dev_sum(names, row_mean(names))
    return F.try_divide(ss, n.cast("double"))
