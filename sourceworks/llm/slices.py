"""Slices of a table by quantiles of an integer id."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def id_marks(df: DataFrame, column: str, slices: int) -> list[int]:
    """Ids in the table that cut it into about ``slices`` even runs; at most ``slices`` - 1 numbers, ascending.

    An id that fills several runs is there as often.
    """
    steps = [k / slices for k in range(1, slices)]
    if not steps:
        return []
    return sorted(df.agg(F.percentile_approx(column, steps, 10 * slices)).first()[0] or [])


def slice_of(column: str, marks: list[int], null_slice: int) -> Column:
    """Number of the slice of an id: how many marks are not above it, looked up in two steps."""
    if not marks:
        return F.lit(0)
    width = math.isqrt(len(marks)) or 1
    every = F.array(*[F.lit(m).cast("bigint") for m in marks])
    coarse = F.array(*[F.lit(m).cast("bigint") for m in marks[::width]])
    below = lambda among: F.size(F.filter(among, lambda m: m <= F.col(column)))
    # let block = ... in: a lambda over one element keeps the first step from being computed twice
    found = F.transform(
        F.array(below(coarse)),
        lambda block: F.when(
            block > 0, (block - 1) * width + below(F.slice(every, (block - 1) * width + 1, F.lit(width)))
        ).otherwise(0),
    )
    return F.when(F.col(column).isNull(), null_slice).otherwise(F.get(found, 0)).cast("int")
