"""Python-compatible rounding of doubles as Column arithmetic.

Python's ``round(x, d)`` rounds the exact binary value of ``x`` half to
even. Spark's ``round``/``bround`` round the shortest decimal text instead
(``bround(2.675, 2) = 2.68``; Python gives 2.67), and ``rint(x * 10^d)``
errs when the product itself rounds onto a half (12.35 * 10 -> 123.5).

``py_round`` computes p = x * 10^d together with its exact rounding error
(Dekker's error-free product: plain multiplications and additions, no UDF),
and uses the error's sign to break the apparent ties. ``py_round_sql`` emits
the same arithmetic as SQL text for the DuckDB oracle.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_SPLIT = 134217729.0  # 2^27 + 1


def _split_const(s: float) -> tuple[float, float]:
    c = _SPLIT * s
    hi = c - (c - s)
    return hi, s - hi


def py_round(x: Column, digits: int) -> Column:
    """Round half to even on the exact binary value, like Python's round()."""
    s = 10.0 ** digits
    sh, sl = _split_const(s)
    p = x * F.lit(s)
    cx = F.lit(_SPLIT) * x
    xh = cx - (cx - x)
    xl = x - xh
    err = ((xh * F.lit(sh) - p) + xh * F.lit(sl) + xl * F.lit(sh)) + xl * F.lit(sl)
    fl = F.floor(p).cast("double")
    near = F.rint(p)
    r = (F.when(p - fl == 0.5,
                F.when(err > 0, fl + 1).when(err < 0, fl).otherwise(near))
         .otherwise(near))
    return r / F.lit(s)


def py_round_sql(x: str, digits: int) -> str:
    """DuckDB text of ``py_round``; ``x`` must be a DOUBLE expression."""
    s = 10.0 ** digits
    sh, sl = _split_const(s)
    p = f"(({x}) * {s!r}::DOUBLE)"
    cx = f"({_SPLIT!r}::DOUBLE * ({x}))"
    xh = f"({cx} - ({cx} - ({x})))"
    xl = f"(({x}) - {xh})"
    err = (f"((({xh} * {sh!r}::DOUBLE - {p}) + {xh} * {sl!r}::DOUBLE + {xl} * {sh!r}::DOUBLE)"
           f" + {xl} * {sl!r}::DOUBLE)")
    fl = f"CAST(floor({p}) AS DOUBLE)"
    near = f"round_even({p}, 0)"
    return (f"(CASE WHEN {p} - {fl} = 0.5 THEN (CASE WHEN {err} > 0 THEN {fl} + 1 "
            f"WHEN {err} < 0 THEN {fl} ELSE {near} END) ELSE {near} END / {s!r}::DOUBLE)")
