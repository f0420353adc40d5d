"""Special functions as Column arithmetic."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Coefficients of the Lanczos series for g = 5, n = 6.
_LANCZOS = [76.18009172947146, -86.50532032941677, 24.01409824083091, -1.231739572450155, 0.1208650973866179e-2, -0.5395239384953e-5]


def lgamma(x: Column) -> Column:
    """Natural logarithm of the gamma function for positive x."""
    # small arguments use the recurrence, so that the series keeps its accuracy
    shifted = x + 7
    series = F.lit(1.000000000190015)
    for k, c in enumerate(_LANCZOS, 1):
        series = series + F.lit(c) / (shifted + k)
    t = shifted + 5.5
    value = (shifted + 0.5) * F.log(t) - t + F.log(F.lit(2.5066282746310005) * series / shifted)
    product = x
    for k in range(1, 7):
        product = product * (x + k)
    return value - F.log(product)


def sigmoid(z: Column) -> Column:
    return 1 / (1 + F.exp(-z))
