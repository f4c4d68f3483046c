"""Division and logarithm as IEEE 754 has them, for prices that may be 0; Spark's own raise an error or give null."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

_INF = float("inf")


def _col(x: Column | str | float) -> Column:
    return F.col(x) if isinstance(x, str) else x if isinstance(x, Column) else F.lit(float(x))


def ratio(a: Column | str | float, b: Column | str | float) -> Column:
    """a / b; by 0 it is an infinity with a's sign, or NaN for 0 / 0."""
    a, b = _col(a), _col(b)
    return F.when(b == 0, a * F.lit(_INF)).otherwise(a / b)


def ln(x: Column | str) -> Column:
    """The natural logarithm; minus infinity for 0."""
    return F.when(_col(x) == 0, F.lit(-_INF)).otherwise(F.log(_col(x)))
