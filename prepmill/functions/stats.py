"""Moment and correlation expressions with bias corrections."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .roles import col


def skew_sample(name: str) -> Column:
    """Bias-corrected skewness (NULL below three values)."""
    c = col(name)
    n = F.count(c).cast("double")
    spread = F.stddev_pop(c)
    # skewness() divides by the spread, so constant input is guarded by try_divide.
    g1 = F.when(spread > 0, F.skewness(c))
    return F.when(F.count(c) >= 3, F.try_divide(F.sqrt(n * (n - 1)), n - 2) * g1)


def kurt_sample(name: str) -> Column:
    """Bias-corrected excess kurtosis (NULL below four values)."""
    c = col(name)
    n = F.count(c).cast("double")
    g2 = F.when(F.stddev_pop(c) > 0, F.kurtosis(c))
    return F.when(
        F.count(c) >= 4, F.try_divide(n - 1, (n - 2) * (n - 3)) * ((n + 1) * g2 + 6)
    )


def pearson(a: str, b: str) -> Column:
    """Pearson r over rows where both are present; NULL when either is constant."""
    x, y = col(a).cast("double"), col(b).cast("double")
    both_x = F.when(y.isNotNull(), x)
    both_y = F.when(x.isNotNull(), y)
    return F.try_divide(F.covar_pop(x, y), F.stddev_pop(both_x) * F.stddev_pop(both_y))
