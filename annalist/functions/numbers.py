"""Rounding that agrees with correctly rounded decimal output of IEEE doubles."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_SPLITTER = 134217729.0  # 2**27 + 1, cuts a double into two exact halves


def round_exact(value: Column, digits: int = 0) -> Column:
    """Round the exact binary value, ties to even, as ``round(x, n)`` does in Python.

    Spark's ``bround`` rounds the shortest decimal text instead, which turns values a
    hair off a tie into ties. The product ``x * 10**digits`` is taken together with its
    rounding error, and the error breaks apparent ties. The one-element array binds x, so
    a long *value* is computed once.
    """
    if digits == 0:
        return F.rint(value.cast("double"))
    scale = F.lit(10.0**digits)

    def rounded(x: Column) -> Column:
        product = x * scale
        t = x * F.lit(_SPLITTER)
        high = t - (t - x)
        # scale is below 2**26, so its own low half is zero
        error = (high * scale - product) + (x - high) * scale
        below = F.floor(product).cast("double")
        tie = (product - below) == F.lit(0.5)
        return (
            F.when(~tie, F.rint(product))
            .when(error > 0, below + 1.0)
            .when(error < 0, below)
            .otherwise(F.rint(product))
        ) / scale

    return F.transform(F.array(value.cast("double")), rounded)[0]


def truncate(value: Column) -> Column:
    """Toward zero, as an integer."""
    return F.when(value < 0, F.ceil(value)).otherwise(F.floor(value)).cast("int")
