"""The normal distribution as Column arithmetic."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, functions as F

# The coefficients of the published rational approximation of the
# normal integral (Abramowitz and Stegun, 26.2.17; absolute error below 7.5e-8).
P = 0.2316419
B = (0.319381530, -0.356563782, 1.781477937, -1.821255978, 1.330274429)


def pdf(x: Column) -> Column:
    return F.exp(-x * x / 2) / F.sqrt(F.lit(2.0) * F.lit(3.141592653589793))


def cdf(x: Column) -> Column:
    """P(Z <= x); absolute error below 7.5e-8."""
    t = 1 / (1 + P * F.abs(x))
    tail = pdf(x) * (t * (B[0] + t * (B[1] + t * (B[2] + t * (B[3] + t * B[4])))))
    return F.when(x >= 0, 1 - tail).otherwise(tail)


def cdf_of(x: np.ndarray) -> np.ndarray:
    """The same on an array."""
    t = 1 / (1 + P * np.abs(x))
    tail = np.exp(-x * x / 2) / np.sqrt(2.0 * 3.141592653589793) * (t * (B[0] + t * (B[1] + t * (B[2] + t * (B[3] + t * B[4])))))
    return np.where(x >= 0, 1 - tail, tail)


def cdf_sql(x: str) -> str:
    """The same as SQL text."""
    t = f"(1 / (1 + {P!r} * ABS({x})))"
    tail = f"(EXP(-({x}) * ({x}) / 2) / SQRT(2E0 * 3.141592653589793E0) * ({t} * ({B[0]!r} + {t} * ({B[1]!r} + {t} * ({B[2]!r} + {t} * ({B[3]!r} + {t} * {B[4]!r}))))))"
    return f"(CASE WHEN {x} >= 0 THEN 1 - {tail} ELSE {tail} END)"
