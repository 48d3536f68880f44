"""Aggregate column expressions over a return column; use inside ``groupBy(...).agg(...)``.

Each takes the name of a return column and gives one aggregate Column, so a caller may pass any of them as the
criterion of a selection, resampling or sensitivity operator.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .mathx import ANN

ROOT = ANN**0.5


def compound(r) -> Column:
    """Product of ``1 + r``; -100 % or worse in any period gives a product with the right sign through F.product."""
    return F.product(1 + (F.col(r) if isinstance(r, str) else r))


def total_return(r: str) -> Column:
    return compound(r) - 1


def cagr(r: str, date: str = "date") -> Column:
    """Growth per elapsed calendar year (365.25 days)."""
    d = F.when(F.col(r).isNotNull(), F.col(date))
    years = F.greatest(F.datediff(F.max(d), F.min(d)), F.lit(1)) / F.lit(365.25)
    g = compound(r)
    return F.when(F.count(r) < 2, F.lit(None).cast("double")).when(g <= 0, F.lit(-1.0)).otherwise(F.pow(g, 1 / years) - 1)


def ann_vol(r: str) -> Column:
    return F.stddev_samp(r) * ROOT


def sharpe(r: str) -> Column:
    return F.when(F.stddev_samp(r) > 0, F.avg(r) / F.stddev_samp(r) * ROOT)


def sortino(r: str) -> Column:
    down = F.stddev_samp(F.when(F.col(r) < 0, F.col(r)))
    return F.when(down > 0, F.avg(r) / down * ROOT)


def win_rate(r: str) -> Column:
    c = F.col(r)
    return F.avg(F.when(c > 0, 1.0).when(c < 0, 0.0))


def profit_factor(r: str) -> Column:
    c = F.col(r)
    loss = F.coalesce(F.sum(F.when(c < 0, -c)), F.lit(0.0))
    return F.when(loss > 0, F.coalesce(F.sum(F.when(c > 0, c)), F.lit(0.0)) / loss)


def skew_g1(r: str) -> Column:
    """Sample-corrected skewness."""
    n = F.count(r).cast("double")
    return F.when(n >= 3, F.skewness(r) * F.sqrt(n * (n - 1)) / (n - 2))


def kurt_g2(r: str) -> Column:
    """Sample-corrected excess kurtosis."""
    n = F.count(r).cast("double")
    return F.when(n >= 4, ((n + 1) * F.kurtosis(r) + 6) * (n - 1) / ((n - 2) * (n - 3)))


def beta(r: str, b: str, min_rows: int = 60) -> Column:
    return F.when(F.count(F.when(F.col(r).isNotNull() & F.col(b).isNotNull(), 1)) >= min_rows,
                  F.try_divide(F.covar_samp(r, b), _paired(F.var_samp, b, r)))


def _paired(agg, x: str, other: str) -> Column:
    return agg(F.when(F.col(other).isNotNull(), F.col(x)))


def alpha(r: str, b: str, min_rows: int = 60) -> Column:
    return (_paired(F.avg, r, b) - beta(r, b, min_rows) * _paired(F.avg, b, r)) * ANN


def tracking_error(r: str, b: str) -> Column:
    return F.stddev_samp(F.col(r) - F.col(b)) * ROOT


def information_ratio(r: str, b: str) -> Column:
    d = F.col(r) - F.col(b)
    return F.when(F.stddev_samp(d) > 0, F.avg(d) / F.stddev_samp(d) * ROOT)


def capture(r: str, b: str, up: bool) -> Column:
    side = (F.col(b) > 0) if up else (F.col(b) < 0)
    both = side & F.col(r).isNotNull()
    return F.try_divide(F.avg(F.when(both, F.col(r))), F.avg(F.when(both, F.col(b))))


def correlation(r: str, b: str, min_rows: int = 31) -> Column:
    return F.when(F.count(F.when(F.col(r).isNotNull() & F.col(b).isNotNull(), 1)) >= min_rows, F.corr(r, b))
