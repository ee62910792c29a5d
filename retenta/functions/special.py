"""Log-gamma and its derivatives for positive arguments, as columns or as floats.

The argument is raised by seven through the recurrence, where the asymptotic series is
good to about 1e-12. Plain arithmetic and ``log`` only, so it stays in generated code.
"""

from __future__ import annotations

import math
from functools import reduce
from operator import add, mul

from pyspark.sql import Column
from pyspark.sql import functions as F

_SHIFT = 7

# Coefficients of the asymptotic series, from 1/w, 1/w^3, ... on.
_LGAMMA_SERIES = (1 / 12, -1 / 360, 1 / 1260, -1 / 1680, 1 / 1188, -691 / 360360)
# End of fixed values.


def ln(value):
    return F.log(value) if isinstance(value, Column) else math.log(value)


def _horner(coefficients, x):
    return reduce(lambda acc, c: acc * x + c, reversed(coefficients))


def lgamma(z):
    w = z + _SHIFT
    series = _horner(_LGAMMA_SERIES, 1.0 / (w * w)) / w
    below = reduce(mul, (z + float(k) for k in range(_SHIFT)))
    return (w - 0.5) * ln(w) - w + 0.5 * math.log(2 * math.pi) + series - ln(below)


def digamma(z):
    w = z + _SHIFT
    u = 1.0 / (w * w)
    slopes = [-(2 * k + 1) * c for k, c in enumerate(_LGAMMA_SERIES)]
    below = reduce(add, (1.0 / (z + float(k)) for k in range(_SHIFT)))
    return ln(w) - 0.5 / w + _horner(slopes, u) * u - below


def trigamma(z):
    w = z + _SHIFT
    u = 1.0 / (w * w)
    bends = [(2 * k + 1) * (2 * k + 2) * c for k, c in enumerate(_LGAMMA_SERIES)]
    below = reduce(add, (1.0 / ((z + float(k)) * (z + float(k))) for k in range(_SHIFT)))
    return 1.0 / w + 0.5 * u + _horner(bends, u) * u / w + below
