"""Exponential smoothing and the filters built on it, without a recursion.

``y_t = a_t y_{t-1} + b_t x_t`` unrolls to a cumulative sum of ``b x / P`` times ``P``, where ``P`` is the running product of
``a``. To stay inside double range, rows are cut into blocks where ``P`` falls by at most ``exp(-BLOCK_LOG)``; a block adds the
decayed end of the one before it, and anything older has decayed below ``exp(-BLOCK_LOG)``. All steps are windows over one
series, so they share one shuffle and cost one pass each, whatever the smoothing length.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import rolling as R

BLOCK_LOG = 200.0


def ewm(df: DataFrame, x: str, alpha: float, out: str, min_periods: int = 1) -> DataFrame:
    """Recursive exponential mean seeded with the first value; a gap of k rows decays the old weight k times."""
    keep = df.columns
    w = R.over()
    valid = F.col(x).isNotNull()
    prev = F.last(F.when(valid, F.col("pos")), ignorenulls=True).over(R.over(None, shift=1))
    df = df.withColumn("_gap", F.when(valid, F.col("pos") - prev))
    decay = F.pow(F.lit(1.0 - alpha), F.col("_gap"))
    first = valid & F.col("_gap").isNull()
    df = df.withColumns({
        "_la": F.when(valid & ~first, F.ln(decay / (decay + alpha))).otherwise(F.lit(0.0)),
        "_bx": F.when(first, F.col(x)).when(valid, F.col(x) * (alpha / (decay + alpha))).otherwise(F.lit(0.0))})
    df = df.withColumns({"_L": F.sum("_la").over(w), "_n": F.count(x).over(w)})
    df = df.withColumn("_blk", F.floor(-F.col("_L") / BLOCK_LOG))
    df = df.withColumn("_P", F.exp(F.col("_L") + F.col("_blk") * BLOCK_LOG))
    wb = Window.partitionBy("series_id", "_blk").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    df = df.withColumn("_y", F.col("_P") * F.sum(F.col("_bx") / F.col("_P")).over(wb))
    df = df.withColumn("_end", F.lead("_blk").over(R.order_only()) != F.col("_blk"))
    df = df.withColumn("_pv", F.last(F.when(F.col("_end"), F.struct("_L", "_y")), ignorenulls=True).over(R.over(None, shift=1)))
    y = F.col("_y") + F.coalesce(F.exp(F.col("_L") - F.col("_pv._L")) * F.col("_pv._y"), F.lit(0.0))
    df = df.withColumn(out, F.when(F.col("_n") >= max(min_periods, 1), y))
    return df.select(*[c for c in keep if c != out], out)


def true_range(high="high", low="low", close="close") -> Column:
    """Largest of the day's range and its distances from the previous close; missing parts are ignored."""
    pc = R.lag(close)
    return F.greatest(F.abs(F.col(high) - F.col(low)), F.abs(F.col(high) - pc), F.abs(F.col(low) - pc))


def atr(df: DataFrame, window: int, out: str = "atr", close: str = "adj_close") -> DataFrame:
    """Wilder-smoothed average true range."""
    return ewm(df.withColumn("_tr", true_range(close=close)), "_tr", 1.0 / window, out, window).drop("_tr")


def gaussian_alpha(period: int, poles: int) -> float:
    b = (1.0 - math.cos(2.0 * math.pi / period)) / (2.0 ** (1.0 / poles) - 1.0)
    return -b + math.sqrt(b * b + 2.0 * b)


def gaussian(df: DataFrame, x: str, period: int, poles: int = 4, out: str = "centre") -> DataFrame:
    """A causal N-pole Gaussian filter: the same one-pole smoothing applied ``poles`` times."""
    a = gaussian_alpha(period, poles)
    src = x
    for k in range(poles):
        df = ewm(df, src, a, out if k == poles - 1 else f"_g{k}")
        src = f"_g{k}"
    return df.drop(*[f"_g{k}" for k in range(poles - 1)])


def adx(df: DataFrame, di_window: int, adx_window: int, close: str = "adj_close") -> DataFrame:
    """Directional indices ``plus_di`` and ``minus_di`` and their smoothed strength ``adx``."""
    up = F.col("high") - R.lag("high")
    down = R.lag("low") - F.col("low")
    df = df.withColumns({"_up": up, "_dn": down})
    move = lambda a, b: F.when(F.coalesce((F.col(a) > F.coalesce(F.col(b), F.lit(float("inf")))) & (F.col(a) > 0), F.lit(False)), F.col(a)).otherwise(F.lit(0.0))
    df = df.withColumns({"_pdm": move("_up", "_dn"), "_mdm": move("_dn", "_up")})
    df = atr(df, di_window, "_atr", close)
    df = ewm(df, "_pdm", 1.0 / di_window, "_ps", di_window)
    df = ewm(df, "_mdm", 1.0 / di_window, "_ms", di_window)
    df = df.withColumns({"plus_di": 100.0 * F.try_divide("_ps", "_atr"), "minus_di": 100.0 * F.try_divide("_ms", "_atr")})
    df = df.withColumn("_dx", 100.0 * F.try_divide(F.abs(F.col("plus_di") - F.col("minus_di")), F.col("plus_di") + F.col("minus_di")))
    df = ewm(df, "_dx", 1.0 / adx_window, "adx", adx_window)
    return df.drop("_up", "_dn", "_pdm", "_mdm", "_atr", "_ps", "_ms", "_dx")
