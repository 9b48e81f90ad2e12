"""Column helpers that reproduce the missing-value and number semantics.

All are Catalyst expressions (no UDF), so they stay inside whole-stage codegen.

* ``flag``: a comparison with a missing value is false, so the flag is 0.
* ``mismatch``: ``!=`` with a missing operand counts as a mismatch.
* ``clip``: keeps missing values missing (``greatest``/``least`` alone skip NULL).
* ``ratio``: division that never raises under ANSI mode (NULL on a zero divisor).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def flag(cond: Column) -> Column:
    """0/1 integer; NULL comparisons count as false."""
    return F.coalesce(cond, F.lit(False)).cast("int")


def truth(cond: Column) -> Column:
    """Boolean with NULL mapped to false."""
    return F.coalesce(cond, F.lit(False))


def mismatch(a: str | Column, b: str | Column) -> Column:
    """0/1: values differ, or either is missing (even both)."""
    return F.coalesce(col(a) != col(b), F.lit(True)).cast("int")


def yes(c: str | Column) -> Column:
    """0/1 for a Yes/No text column."""
    return flag(col(c) == F.lit("Yes"))


def clip(x: Column, lo: float, hi: float) -> Column:
    """Bound to [lo, hi]; missing stays missing."""
    return F.when(x.isNotNull(), F.least(F.greatest(x, F.lit(float(lo))), F.lit(float(hi))))


def ratio(num: Column, den: Column) -> Column:
    """num / den as double; NULL instead of an error on a zero divisor."""
    return F.try_divide(num.cast("double"), den.cast("double"))


def zero_guarded(num: Column, den: Column) -> Column:
    """num / den, 0 when the divisor is zero or missing (zero-division -> 0)."""
    return F.coalesce(ratio(num, den), F.lit(0.0))


def nan_to_null(x: Column) -> Column:
    """Map NaN and +/-Inf to NULL (result sanitising)."""
    return F.when(F.isnan(x) | (F.abs(x) == F.lit(float("inf"))), F.lit(None)).otherwise(x)
