"""Standard normal density and distribution as Column expressions.

Spark SQL has no error function, so the distribution uses a published double-precision
rational approximation (Hart, as given by G. West, 2005); its error is about 2e-16.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, functions as F

# Horner coefficients, highest power first.
NUMERATOR = (
    3.52624965998911e-2, 0.700383064443688, 6.37396220353165, 33.912866078383,
    112.079291497871, 221.213596169931, 220.206867912376,
)
DENOMINATOR = (
    8.83883476483184e-2, 1.75566716318264, 16.064177579207, 86.7807322029461,
    296.564248779674, 637.333633378831, 793.826512519948, 440.413735824752,
)
TAIL_START, TAIL_END, ROOT_TWO_PI, TAIL_SEED = 7.07106781186547, 37.0, 2.506628274631, 0.65


def _horner(coefficients, x):
    total = x * coefficients[0] + coefficients[1]
    for c in coefficients[2:]:
        total = total * x + c
    return total


def _tail(x):
    fraction = x + TAIL_SEED
    for i in (4.0, 3.0, 2.0, 1.0):
        fraction = x + i / fraction
    return 1.0 / (fraction * ROOT_TWO_PI)


def norm_pdf(z: Column) -> Column:
    return F.exp(z * z * -0.5) / math.sqrt(2 * math.pi)


def norm_cdf(z: Column) -> Column:
    """Pass a plain column: the argument appears many times in the expression."""
    x = F.abs(z)
    weight = F.exp(x * x * -0.5)
    middle = weight * _horner(NUMERATOR, x) / _horner(DENOMINATOR, x)
    lower = F.when(x > TAIL_END, 0.0).when(x < TAIL_START, middle).otherwise(weight * _tail(x))
    return F.when(z > 0, 1.0 - lower).otherwise(lower)


def chi2_1_upper_tail(x: Column) -> Column:
    """P(chi-squared with one degree of freedom > x)."""
    return 2.0 * norm_cdf(-F.sqrt(F.greatest(x, F.lit(0.0))))


def norm_cdf_array(z: np.ndarray) -> np.ndarray:
    """The same approximation over an Arrow batch."""
    x = np.abs(z)
    weight = np.exp(-0.5 * x * x)
    inner = np.minimum(x, TAIL_START)
    middle = weight * _horner(NUMERATOR, inner) / _horner(DENOMINATOR, inner)
    lower = np.where(x < TAIL_START, middle, np.where(x > TAIL_END, 0.0, weight * _tail(np.maximum(x, 1.0))))
    return np.where(z > 0, 1.0 - lower, lower)
