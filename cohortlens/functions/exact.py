"""Order-independent aggregates.

Each value is summed as a wide decimal, which is exact, so the mean is the same
whatever the partitioning and whatever order the partial sums are combined in
(a floating-point sum is not, and a rounded mean near a tie can then flip
between runs).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def exact_mean(col: str) -> Column:
    """Mean of a numeric column at 15 decimals a value (NULLs skipped)."""
    return F.try_divide(F.sum(F.col(col).cast("decimal(28,15)")).cast("double"), F.count(F.col(col)).cast("double"))
