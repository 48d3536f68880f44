"""Trailing window expressions over one series (columns ``series_id`` and ``pos``).

Every frame ends at the current row or earlier. ``rolling`` counts rows of the dense calendar and returns
NULL until ``min_periods`` non-null values are inside the frame. Inputs are names or columns.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, Window, WindowSpec
from pyspark.sql import functions as F

from .mathx import ANN

KEY, ORDER = ["series_id"], "pos"


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def over(n: int | None = None, *, shift: int = 0, key=None, order: str | Column = ORDER) -> WindowSpec:
    """The last ``n`` rows (all earlier rows when ``n`` is None), ending ``shift`` rows before the current one."""
    base = Window.partitionBy(*(KEY if key is None else key)).orderBy(order)
    lo = Window.unboundedPreceding if n is None else -(n - 1) - shift
    return base.rowsBetween(lo, -shift)


def order_only(key=None, order: str | Column = ORDER) -> WindowSpec:
    return Window.partitionBy(*(KEY if key is None else key)).orderBy(order)


def lag(c, n: int = 1, **kw) -> Column:
    return col(c) if n == 0 else F.lag(col(c), n).over(order_only(**kw))


def rolling(agg: Callable[[Column], Column], c, n: int | None, min_periods: int | None = None, *, shift: int = 0, **kw) -> Column:
    w = over(n, shift=shift, **kw)
    need = min_periods if min_periods is not None else (n if n is not None else 1)
    return F.when(F.count(col(c)).over(w) >= need, agg(col(c)).over(w))


def pct_change(c, n: int = 1, **kw) -> Column:
    return F.try_divide(col(c), lag(c, n, **kw)) - 1


def momentum(c, lookback: int, skip: int = 0) -> Column:
    return F.try_divide(lag(c, skip), lag(c, lookback)) - 1


def sma(c, n: int, min_periods: int | None = None) -> Column:
    return rolling(F.avg, c, n, min_periods)


def std(c, n: int, min_periods: int | None = None) -> Column:
    return rolling(F.stddev_samp, c, n, min_periods)


def realized_vol(ret, n: int) -> Column:
    """Annualised rolling deviation of a return column."""
    return std(ret, n) * F.lit(ANN**0.5)


def above(c, level) -> Column:
    """``c > level``; False while either side is missing."""
    return F.coalesce(col(c) > col(level), F.lit(False))


def below(c, level) -> Column:
    return F.coalesce(col(c) < col(level), F.lit(False))


def rsi(diff, n: int) -> Column:
    """RSI from a one-row difference column, simple means."""
    d = col(diff)
    up = rolling(F.avg, F.when(d.isNotNull(), F.greatest(d, F.lit(0.0))), n)
    dn = rolling(F.avg, F.when(d.isNotNull(), F.greatest(-d, F.lit(0.0))), n)
    return F.lit(100.0) - F.try_divide(F.lit(100.0), 1 + F.try_divide(up, dn))


def bollinger_z(c, n: int) -> Column:
    return F.try_divide(col(c) - sma(c, n), std(c, n))


def prior_max(c, n: int) -> Column:
    """Highest of the previous ``n`` rows, today excluded."""
    return rolling(F.max, c, n, shift=1)


def prior_min(c, n: int) -> Column:
    return rolling(F.min, c, n, shift=1)


def rolling_adv(c, n: int = 21, min_periods: int = 5) -> Column:
    """Mean of the last ``n`` rows known on the previous row."""
    return rolling(F.avg, c, n, min_periods, shift=1)


def quantile(c, n: int | None, q: float, min_periods: int | None = None) -> Column:
    return rolling(lambda x: F.percentile(x, F.lit(q)), c, n, min_periods)


def rolling_beta(y, x, n: int, min_periods: int | None = None) -> Column:
    """Covariance of ``y`` with ``x`` over pairwise-complete rows, divided by the variance of ``x``."""
    y, x = col(y), col(x)
    w = over(n)
    need = n if min_periods is None else min_periods
    both = F.when(y.isNotNull() & x.isNotNull(), F.lit(1))
    cov = F.when(F.count(both).over(w) >= need, F.covar_samp(y, x).over(w))
    var = F.when(F.count(x).over(w) >= need, F.var_samp(x).over(w))
    return F.try_divide(cov, var)


def percentile_rank(c, n: int, min_periods: int | None = None) -> Column:
    """Average-tie percentile rank of the current value inside its own trailing window.

    The frame is bounded by ``n`` rows, so is the collected array.
    """
    w = over(n)
    need = n if min_periods is None else min_periods
    vals = F.collect_list(col(c)).over(w)
    less = F.size(F.filter(vals, lambda v: v < col(c)))
    same = F.size(F.filter(vals, lambda v: v == col(c)))
    return F.when(col(c).isNotNull() & (F.count(col(c)).over(w) >= need), (less + (same + 1) / 2) / F.size(vals))


def latch(entry, exit_, initial: bool = False) -> Column:
    """Held from an entry row until an exit row; an entry on the same row wins."""
    mark = F.when(F.coalesce(col(entry), F.lit(False)), F.lit(True)).when(F.coalesce(col(exit_), F.lit(False)), F.lit(False))
    return F.coalesce(F.last(mark, ignorenulls=True).over(over()), F.lit(initial))


def ffill(c, limit: int | None = None) -> Column:
    return F.last(col(c), ignorenulls=True).over(over(None if limit is None else limit + 1))


def growth_path(ret, **kw) -> Column:
    """Running equity: the cumulative product of ``1 + ret``, missing returns skipped; zero for good after a wipe-out."""
    one = 1 + F.coalesce(col(ret), F.lit(0.0))
    w = over(**kw)
    logs = F.when(one > 0, F.ln(F.when(one > 0, one)))
    return F.when(F.min(one).over(w) <= 0, F.lit(0.0)).otherwise(F.exp(F.sum(logs).over(w)))
