"""Signal library: each signal maps a market to a sparse weight table ``(series_id, date, w)`` on its decision dates.

A signal is a plain function of a :class:`Market` and keyword parameters; ``SIGNALS`` is the extension point. Every feature is
trailing, masked names are never selected, and the one-row execution lag is applied downstream.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import rolling as R
from ..operators import allocation, stateful
from ..operators import xsection as X
from ..operators.asof import pit_asof, trailing_filings
from ..operators.order_stats import expanding_quantile
from ..operators.recursive import adx, atr, gaussian
from ..operators.returns import portfolio_returns, vol_target


@dataclass
class Market:
    """Dense panel with ``mask`` and ``ret``, its calendar and the optional side tables."""

    panel: DataFrame
    cal: DataFrame
    members: DataFrame | None = None
    macro: DataFrame | None = None
    filings: DataFrame | None = None
    short: DataFrame | None = None
    fallback: str = ""
    index: str = ""

    @property
    def universe(self) -> DataFrame:
        return self.panel.where(F.col("series_id") != self.fallback) if self.fallback else self.panel

    def basket(self, name: str) -> DataFrame:
        ids = self.members.where(F.col("basket") == name).select("series_id")
        return self.panel.join(ids, "series_id", "left_semi")

    def index_series(self) -> DataFrame:
        """Level and return of the index series, one row per date."""
        return self.panel.where(F.col("series_id") == self.index).select("date", "pos", F.col("adj_close").alias("ix"), F.col("ret").alias("ix_ret"))

    def with_index(self, df: DataFrame) -> DataFrame:
        return df.join(F.broadcast(self.index_series().select("date", "ix", "ix_ret")), "date")


SIGNALS: dict[str, Callable[..., DataFrame]] = {}
BY_DATE = {"key": [], "order": "date"}


def signal(fn):
    SIGNALS[fn.__name__] = fn
    return fn


def decisions(df: DataFrame, m: Market, freq: str) -> DataFrame:
    """Rows on the decision dates of ``freq``."""
    if freq == "day":
        return df
    return df.join(F.broadcast(m.cal.where(F.col(f"{freq}_stamp")).select("date")), "date", "left_semi")


def _stamps(m: Market, freq: str) -> DataFrame:
    return m.cal.where(F.col(f"{freq}_stamp")).select("date")


def _w(df: DataFrame) -> DataFrame:
    return df.where("w <> 0").select("series_id", "date", "w")


def _pick(m: Market, df: DataFrame, score, n: int, freq: str, positive: bool = True, ascending: bool = False) -> DataFrame:
    """Equal weights of the ``n`` best masked scores on decision dates."""
    x = decisions(df.where("mask").withColumn("score", score), m, freq)
    if positive:
        x = x.where("score > 0")
    return _w(X.equal_weight(X.top_n(x.select("series_id", "date", "score"), "score", n, ascending=ascending), few=True))


def _masked_equal(df: DataFrame) -> DataFrame:
    return X.equal_weight(df.where("mask").select("series_id", "date"))


def _held(df: DataFrame, held: str = "held") -> DataFrame:
    """Equal weights of the held, masked names of each date."""
    return _w(X.equal_weight(df.where(F.col(held) & F.col("mask")).select("series_id", "date")))


def _own_return(m: Market, weights: DataFrame) -> DataFrame:
    """Lagged daily return of daily weights on every calendar date (zero while nothing is held)."""
    p = portfolio_returns(weights, m.panel, m.cal, "day").select("date", "gross")
    return m.cal.select("date").join(p, "date", "left").na.fill(0.0, ["gross"])


# ------------------------------------------------------------------ benchmarks
@signal
def buy_and_hold(m: Market, series: str) -> DataFrame:
    return m.panel.where((F.col("series_id") == series) & F.col("adj_close").isNotNull()).select("series_id", "date", F.lit(1.0).alias("w"))


@signal
def equal_weight_universe(m: Market, freq: str = "me", basket: str | None = None) -> DataFrame:
    src = m.basket(basket) if basket else m.panel
    return _w(_masked_equal(decisions(src, m, freq)))


@signal
def cap_weight_universe(m: Market, freq: str = "qe", cap: float = 0.25) -> DataFrame:
    """Price times published shares, capped."""
    x = pit_asof(m.panel.select("series_id", "date", "close", "mask"), m.filings, ["shares"])
    x = decisions(x.where("mask"), m, freq).withColumn("size", F.col("close") * F.col("shares"))
    x = X.score_weight(x, "size")
    return _w(X.cap_weights(x.select("series_id", "date", "w"), cap))


@signal
def dollar_volume_weight(m: Market, freq: str = "qe", cap: float = 0.25, window: int = 13) -> DataFrame:
    """Size proxied by mean dollar volume, for panels without share counts."""
    x = m.panel.withColumn("size", R.sma("dollar_volume", window))
    x = X.score_weight(decisions(x.where("mask"), m, freq), "size")
    return _w(X.cap_weights(x.select("series_id", "date", "w"), cap))


@signal
def index_moving_average(m: Market, window: int) -> DataFrame:
    """The index above its average, else the fallback."""
    ix = m.panel.where(F.col("series_id") == m.index).withColumn("on", R.above("adj_close", R.sma("adj_close", window)))
    ix = ix.where("adj_close is not null").select("date", "on")
    fb = m.panel.where((F.col("series_id") == m.fallback) & F.col("adj_close").isNotNull()).select("date", F.lit(True).alias("_fb"))
    x = ix.join(fb, "date", "left").withColumn("series_id", F.when(F.col("on"), F.lit(m.index)).when(F.col("_fb"), F.lit(m.fallback)))
    return x.where("series_id is not null").select("series_id", "date", F.lit(1.0).alias("w"))


@signal
def simple_momentum(m: Market, lookback: int, skip: int, n: int = 5) -> DataFrame:
    return _pick(m, m.panel.withColumn("mom", R.momentum("adj_close", lookback, skip)), F.col("mom"), n, "me", positive=False)


# ------------------------------------------------------------------ time-series momentum
@signal
def trend_follow_cash(m: Market, window: int, freq: str = "wf") -> DataFrame:
    x = m.universe.withColumn("on", R.above("adj_close", R.sma("adj_close", window)))
    x = decisions(x.where("mask").select("series_id", "date", "on"), m, freq)
    x = X.equal_weight(x).where("on")
    return X.with_fallback(_w(x), _stamps(m, freq), m.panel, m.fallback)


@signal
def absolute_momentum(m: Market, lookback: int, per_year: int, freq: str = "me", rate: str = "RATE") -> DataFrame:
    from ..operators.panel import calendar_align

    r = calendar_align(m.macro.where(F.col("series") == rate), m.cal).select("date", F.col("value").alias("_rate"))
    x = m.universe.withColumn("mom", R.momentum("adj_close", lookback)).join(F.broadcast(r), "date")
    x = x.withColumn("hurdle", F.pow(1 + F.col("_rate") / 100, lookback / per_year) - 1)
    x = decisions(x.where("mask and mom > hurdle").select("series_id", "date"), m, freq)
    return X.with_fallback(_w(X.equal_weight(x)), _stamps(m, freq), m.panel, m.fallback)


@signal
def dual_momentum(m: Market, choices: list[str], lookback: int) -> DataFrame:
    x = m.panel.where(F.col("series_id").isin(choices)).withColumn("mom", R.momentum("adj_close", lookback))
    best = X.argmax_pick(decisions(x, m, "me"), "mom")
    fb = m.panel.where((F.col("series_id") == m.fallback) & F.col("adj_close").isNotNull()).select("date", F.lit(True).alias("_fb"))
    best = best.join(fb, "date", "left")
    pick = F.when(F.col("mom") > 0, F.col("series_id")).when(F.col("_fb"), F.lit(m.fallback))
    return best.select(pick.alias("series_id"), "date", F.lit(1.0).alias("w")).where("series_id is not null")


# ------------------------------------------------------------------ cross-sectional momentum
@signal
def xs_momentum(m: Market, lookback: int, skip: int, n: int = 5, weighting: str = "equal", freq: str = "me", vol_window: int = 13,
                basket: str | None = None) -> DataFrame:
    src = (m.basket(basket) if basket else m.panel).withColumns({"mom": R.momentum("adj_close", lookback, skip), "vol": R.realized_vol("ret", vol_window)})
    x = decisions(src.where("mask and mom > 0").select("series_id", "date", "mom", "vol"), m, freq)
    x = X.top_n(x, "mom", n)
    how = {"equal": lambda d: X.equal_weight(d, few=True), "inverse_vol": lambda d: X.inverse_vol_weight(d, "vol", few=True), "momentum": lambda d: X.score_weight(d, "mom", few=True)}
    return _w(how[weighting](x))


@signal
def risk_adjusted_momentum(m: Market, lookback: int, skip: int, n: int = 5, freq: str = "me") -> DataFrame:
    return _pick(m, m.panel.withColumn("ram", F.try_divide(R.momentum("adj_close", lookback, skip), R.realized_vol("ret", lookback))), F.col("ram"), n, freq)


@signal
def relative_strength(m: Market, lookback: int, n: int = 8, freq: str = "me") -> DataFrame:
    ix = m.index_series().select("date", R.pct_change("ix", lookback, **BY_DATE).alias("_im"))
    x = m.panel.withColumn("mom", R.momentum("adj_close", lookback)).join(F.broadcast(ix), "date")
    return _pick(m, x, F.col("mom") - F.col("_im"), n, freq)


# ------------------------------------------------------------------ mean reversion and breakout
@signal
def rsi_reversion(m: Market, window: int, entry: float, exit: float, trend: int, positions: int = 5) -> DataFrame:
    x = m.panel.withColumn("_d", F.col("adj_close") - R.lag("adj_close"))
    x = x.withColumns({"rsi": R.rsi("_d", window), "up": R.above("adj_close", R.sma("adj_close", trend))})
    x = x.withColumn("held", R.latch(F.coalesce(F.col("rsi") < entry, F.lit(False)) & F.col("up") & F.col("mask"),
                                     F.coalesce(F.col("rsi") > exit, F.lit(False)) | ~F.col("up")))
    return _w(X.equal_weight(X.top_n(x.where("held").select("series_id", "date", "rsi"), "rsi", positions, ascending=True), few=True))


@signal
def short_term_reversal(m: Market, window: int = 5, n: int = 5, trend: int = 40, freq: str = "wf") -> DataFrame:
    x = m.panel.withColumns({"rev": -R.momentum("adj_close", window), "up": R.above("adj_close", R.sma("adj_close", trend))})
    return _pick(m, x.where("up"), F.col("rev"), n, freq, positive=False)


@signal
def bollinger_reversion(m: Market, window: int, entry_z: float, exit_z: float, trend: int, positions: int = 5) -> DataFrame:
    x = m.panel.withColumns({"z": R.bollinger_z("adj_close", window), "up": R.above("adj_close", R.sma("adj_close", trend))})
    x = x.withColumn("held", R.latch(F.coalesce(F.col("z") < entry_z, F.lit(False)) & F.col("up") & F.col("mask"),
                                     F.coalesce(F.col("z") > exit_z, F.lit(False)) | ~F.col("up")))
    return _w(X.equal_weight(X.top_n(x.where("held").select("series_id", "date", "z"), "z", positions, ascending=True), few=True))


@signal
def donchian_breakout(m: Market, entry_window: int, exit_window: int, positions: int = 6, index_trend: int | None = 40) -> DataFrame:
    x = m.panel.withColumns({"hi": R.prior_max("adj_close", entry_window), "lo": R.prior_min("adj_close", exit_window)})
    entry = R.above("adj_close", "hi") & F.col("mask")
    if index_trend:
        ix = m.index_series().select("date", R.above("ix", R.rolling(F.avg, "ix", index_trend, **BY_DATE)).alias("_on"))
        x = x.join(F.broadcast(ix), "date")
        entry = entry & F.col("_on")
    x = x.withColumn("held", R.latch(entry, R.below("adj_close", "lo"))).withColumn("strength", F.try_divide("adj_close", "hi") - 1)
    return _w(X.equal_weight(X.top_n(x.where("held").select("series_id", "date", "strength"), "strength", positions), few=True))


@signal
def squeeze_breakout(m: Market, entry_window: int, exit_window: int, squeeze: float, vol_window: int, rank_window: int, positions: int = 6) -> DataFrame:
    x = m.panel.withColumn("vol", R.realized_vol("ret", vol_window)).withColumn("vr", R.percentile_rank("vol", rank_window))
    x = x.withColumns({"hi": R.prior_max("adj_close", entry_window), "lo": R.prior_min("adj_close", exit_window),
                       "sq": F.coalesce(R.lag(F.col("vr") < squeeze), F.lit(False))})
    x = x.withColumn("held", R.latch(R.above("adj_close", "hi") & F.col("sq") & F.col("mask"), R.below("adj_close", "lo")))
    x = x.withColumn("strength", F.try_divide("adj_close", "hi") - 1)
    return _w(X.equal_weight(X.top_n(x.where("held").select("series_id", "date", "strength"), "strength", positions), few=True))


# ------------------------------------------------------------------ filings
def _filed(m: Market, fields: list[str], base: DataFrame | None = None) -> DataFrame:
    """Panel with point-in-time trailing statistics; ``fields`` are names like ``revenue_ttm`` or plain columns."""
    f = m.filings
    for root in dict.fromkeys(x.rsplit("_", 1)[0] for x in fields if x.endswith(("_ttm", "_yoy", "_accel"))):
        f = trailing_filings(f, root)
    return pit_asof(m.panel if base is None else base, f, fields)


@signal
def quality_growth(m: Market, n: int = 8, freq: str = "qe", w_growth: float = 0.4, w_accel: float = 0.3, w_margin: float = 0.3) -> DataFrame:
    x = _filed(m, ["revenue_yoy", "revenue_accel", "revenue_ttm", "fcf_ttm"]).where("mask")
    x = decisions(x.withColumn("margin", F.try_divide("fcf_ttm", "revenue_ttm")), m, freq)
    x = X.with_zscores(x, ["revenue_yoy", "revenue_accel", "margin"])
    x = x.withColumn("z", w_growth * F.col("z_revenue_yoy") + w_accel * F.col("z_revenue_accel") + w_margin * F.col("z_margin"))
    return _pick(m, x, F.col("z"), n, "day", positive=False)


@signal
def valuation_aware_growth(m: Market, n: int = 8, freq: str = "qe", max_pct: float = 0.85, history: int = 156, min_history: int = 52) -> DataFrame:
    x = _filed(m, ["revenue_yoy", "revenue_ttm", "fcf_ttm", "shares"])
    x = x.withColumn("ps", F.try_divide(F.col("close") * F.col("shares"), F.col("revenue_ttm")))
    x = x.withColumn("ps_pct", R.percentile_rank("ps", history, min_history)).withColumn("margin", F.try_divide("fcf_ttm", "revenue_ttm"))
    x = X.with_zscores(decisions(x.where("mask"), m, freq), ["revenue_yoy", "margin"]).withColumn("z", F.col("z_revenue_yoy") + 0.5 * F.col("z_margin"))
    return _pick(m, x.where(F.col("ps_pct") < max_pct), F.col("z"), n, "day", positive=False)


@signal
def fundamental_acceleration(m: Market, n: int = 8, freq: str = "qe") -> DataFrame:
    x = _filed(m, ["revenue_yoy", "revenue_accel"])
    return _pick(m, x.where("revenue_yoy > 0"), F.col("revenue_accel"), n, freq)


@signal
def gross_profitability(m: Market, n: int = 12, freq: str = "qe") -> DataFrame:
    """Gross profit over assets where filed, free cash flow over revenue otherwise."""
    if {"gross_profit", "assets"} <= set(m.filings.columns):
        x, score = _filed(m, ["gross_profit_ttm", "assets"]), F.try_divide("gross_profit_ttm", "assets")
    else:
        x, score = _filed(m, ["fcf_ttm", "revenue_ttm"]), F.try_divide("fcf_ttm", "revenue_ttm")
    return _pick(m, x, score, n, freq)


@signal
def post_filing_drift(m: Market, hold: int = 13, n: int = 10, freq: str = "wf") -> DataFrame:
    x = _filed(m, ["revenue_yoy"]).withColumn("step", F.col("revenue_yoy") - R.lag("revenue_yoy"))
    x = x.withColumn("fresh", F.when(F.abs("step") > 1e-12, F.col("step")))
    x = x.withColumn("score", F.last("fresh", ignorenulls=True).over(R.over(hold)))
    return _pick(m, x, F.col("score"), n, freq)


@signal
def research_intensity(m: Market, n: int = 12, freq: str = "qe", profitable: bool = False) -> DataFrame:
    x = _filed(m, ["rnd_ttm", "revenue_ttm", "net_income_ttm"])
    if profitable:
        x = x.where("net_income_ttm > 0")
    return _pick(m, x, F.try_divide("rnd_ttm", "revenue_ttm"), n, freq)


@signal
def accrual_quality(m: Market, n: int = 12, freq: str = "qe") -> DataFrame:
    x = _filed(m, ["net_income_ttm", "fcf_ttm", "assets"])
    return _pick(m, x, -F.try_divide(F.col("net_income_ttm") - F.col("fcf_ttm"), F.col("assets")), n, freq, positive=False)


# ------------------------------------------------------------------ regimes and risk management
def regime_flags(m: Market, trend: int, change: int, rate_step: float = 0.05, high: float = 25.0, stress_window: int | None = None) -> DataFrame:
    """Per-date descriptors: index trend and change, rate direction, level threshold and multiple, breadth."""
    from ..operators.panel import calendar_align

    w = Window.orderBy("date")
    ix = m.index_series().select("date", "ix", R.rolling(F.avg, "ix", trend, **BY_DATE).alias("_s"), R.pct_change("ix", change, **BY_DATE).alias("ix_change"))
    ix = ix.select("date", R.above("ix", "_s").cast("double").alias("ix_above"), "ix_change")
    mac = calendar_align(m.macro, m.cal).groupBy("date").agg(F.max(F.when(F.col("series") == "RATE", F.col("value"))).alias("rate"),
                                                             F.max(F.when(F.col("series") == "LEVEL", F.col("value"))).alias("level"))
    sw = stress_window or trend
    mac = mac.select("date", "rate", "level",
                     F.coalesce((F.col("rate") - F.lag("rate", change).over(w)) > rate_step, F.lit(False)).cast("double").alias("rates_rising"),
                     F.coalesce(F.col("level") > high, F.lit(False)).cast("double").alias("level_high"),
                     F.coalesce(F.col("rate") < 0, F.lit(False)).cast("double").alias("rate_negative"),
                     F.coalesce(F.col("level") > 1.25 * R.rolling(lambda c: F.percentile(c, F.lit(0.5)), "level", sw, **BY_DATE), F.lit(False)).cast("double").alias("stress"))
    br = breadth(m, trend).withColumnRenamed("breadth", "breadth_raw")
    return m.cal.select("date").join(ix, "date", "left").join(mac, "date", "left").join(br, "date", "left")


def breadth(m: Market, window: int, smooth: int | None = None) -> DataFrame:
    """Share of listed names above their own average, optionally smoothed."""
    x = m.panel.withColumn("_a", R.above("adj_close", R.sma("adj_close", window)).cast("double"))
    b = x.where("adj_close is not null").groupBy("date").agg(F.avg("_a").alias("breadth"))
    if smooth:
        b = b.withColumn("breadth", R.rolling(F.avg, "breadth", smooth, 1, **BY_DATE))
    return b


def _overlay(m: Market, weights: DataFrame, exposure: DataFrame, freq: str, rest_of_exposure: bool = False) -> DataFrame:
    """Scale weights by a per-date exposure; the rest, of one or of the exposure, goes to the fallback."""
    w = decisions(X.scale_by_date(weights, exposure, "exposure"), m, freq)
    if not rest_of_exposure:
        return X.with_fallback(_w(w), _stamps(m, freq), m.panel, m.fallback)
    fb = m.panel.where((F.col("series_id") == m.fallback) & F.col("adj_close").isNotNull()).select("series_id", "date")
    fb = decisions(fb, m, freq).join(F.broadcast(exposure), "date").select("series_id", "date", F.least(F.greatest(1 - F.col("exposure"), F.lit(0.0)), F.lit(1.0)).alias("w"))
    return _w(w).unionByName(_w(fb))


@signal
def regime_switched(m: Market, cut: float = 0.25, freq: str = "wf", trend: int = 40, change: int = 13, high: float = 25.0, weak: float = 0.4) -> DataFrame:
    f = regime_flags(m, trend, change, high=high)
    risk = (1 - F.coalesce("ix_above", F.lit(1.0))) + F.coalesce("level_high", F.lit(0.0)) + F.coalesce("rates_rising", F.lit(0.0)) \
        + F.coalesce(F.col("breadth_raw") < weak, F.lit(False)).cast("double")
    ex = f.select("date", F.least(F.greatest(1 - cut * risk, F.lit(0.0)), F.lit(1.0)).alias("exposure"))
    return _overlay(m, _masked_equal(m.universe), ex, freq, rest_of_exposure=True)


@signal
def leadership_switch(m: Market, leader: str, lookback: int, trend: int) -> DataFrame:
    """The leader while it beats the index in an uptrend, the index otherwise, the fallback in a downtrend."""
    ix = m.index_series().select("date", "ix", R.rolling(F.avg, "ix", trend, **BY_DATE).alias("_s"), R.pct_change("ix", lookback, **BY_DATE).alias("_im"))
    ld = m.panel.where(F.col("series_id") == leader).select("date", R.pct_change("adj_close", lookback).alias("_lm"))
    fb = m.panel.where((F.col("series_id") == m.fallback) & F.col("adj_close").isNotNull()).select("date", F.lit(True).alias("_fb"))
    x = decisions(ix.join(ld, "date").join(fb, "date", "left"), m, "me")
    up = R.above("ix", "_s")
    rel = F.col("_lm") - F.col("_im")
    pick = F.when(up & (rel > 0), F.lit(leader)).when(up & (rel <= 0), F.lit(m.index)).when(~up & F.col("_fb"), F.lit(m.fallback))
    return x.select(pick.alias("series_id"), "date", F.lit(1.0).alias("w")).where("series_id is not null")


@signal
def vol_targeted_basket(m: Market, basket: str, target: float, window: int, freq: str = "wf") -> DataFrame:
    w = vol_target(_masked_equal(m.basket(basket)), m.panel, m.cal, "day", target, window)
    return X.with_fallback(_w(decisions(w, m, freq)), _stamps(m, freq), m.panel, m.fallback)


def hysteresis_gate(m: Market, trend: int, band: float, floor: float) -> DataFrame:
    """1 until the index falls below its lower band, ``floor`` until it rises above the upper band; 1 while warming up."""
    ix = m.index_series().withColumn("_s", R.rolling(F.avg, "ix", trend, **BY_DATE))
    ix = ix.withColumn("_on", R_latch_by_date(F.col("ix") > F.col("_s") * (1 + band), F.col("ix") < F.col("_s") * (1 - band)))
    return ix.select("date", F.when(F.col("_s").isNull() | F.col("_on"), F.lit(1.0)).otherwise(F.lit(floor)).alias("exposure"))


def R_latch_by_date(entry, exit_):
    mark = F.when(F.coalesce(entry, F.lit(False)), F.lit(True)).when(F.coalesce(exit_, F.lit(False)), F.lit(False))
    return F.coalesce(F.last(mark, ignorenulls=True).over(R.over(**BY_DATE)), F.lit(True))


@signal
def trend_plus_vol_target(m: Market, basket: str, target: float, window: int, trend: int, band: float = 0.02, floor: float = 0.2, freq: str = "wf") -> DataFrame:
    w = vol_target(_masked_equal(m.basket(basket)), m.panel, m.cal, "day", target, window)
    return _overlay(m, w, hysteresis_gate(m, trend, band, floor), freq)


@signal
def drawdown_derisk(m: Market, basket: str, start: float = -0.10, full: float = -0.30, freq: str = "wf") -> DataFrame:
    w = _masked_equal(m.basket(basket))
    return _overlay(m, w, drawdown_exposure(m, w, start, full), freq, rest_of_exposure=True)


def drawdown_exposure(m: Market, weights: DataFrame, start: float, full: float) -> DataFrame:
    """Exposure falling from one to zero as the weights' own drawdown deepens from ``start`` to ``full``."""
    p = _own_return(m, weights).withColumn("_eq", R.growth_path("gross", **BY_DATE))
    p = p.withColumn("_dd", F.try_divide("_eq", F.max("_eq").over(R.over(**BY_DATE))) - 1)
    return p.select("date", F.least(F.greatest((F.col("_dd") - full) / (start - full), F.lit(0.0)), F.lit(1.0)).alias("exposure"))


@signal
def inverse_vol_basket(m: Market, basket: str, window: int, freq: str = "me") -> DataFrame:
    x = m.basket(basket).withColumn("vol", R.realized_vol("ret", window))
    return _w(X.inverse_vol_weight(decisions(x.where("mask"), m, freq), "vol"))


# ------------------------------------------------------------------ factors
@signal
def residual_momentum(m: Market, lookback: int, skip: int, beta_window: int, n: int = 8, freq: str = "me") -> DataFrame:
    x = m.with_index(m.panel.where(F.col("series_id") != m.index)).withColumn("beta", R.rolling_beta("ret", "ix_ret", beta_window))
    x = x.withColumn("resid", F.col("ret") - F.col("beta") * F.col("ix_ret"))
    x = x.withColumns({"_s": R.rolling(F.sum, "resid", lookback - skip, shift=skip), "_v": R.std("resid", lookback)})
    return _pick(m, x, F.try_divide("_s", "_v"), n, freq)


@signal
def multi_horizon_momentum(m: Market, horizons: tuple[int, ...], skip: int, n: int = 8, weighting: str = "equal", vol_window: int = 13, freq: str = "me") -> DataFrame:
    x = m.panel.withColumns({f"m{h}": R.momentum("adj_close", h, skip) for h in horizons} | {"vol": R.realized_vol("ret", vol_window)})
    x = decisions(x.where("mask"), m, freq)
    x = X.with_zscores(x, [f"m{h}" for h in horizons])
    x = x.withColumn("z", sum((F.col(f"z_m{h}") for h in horizons[1:]), F.col(f"z_m{horizons[0]}")))
    for h in horizons:
        x = x.where(F.col(f"m{h}") > 0)
    x = X.top_n(x.select("series_id", "date", "z", "vol"), "z", n)
    return _w(X.inverse_vol_weight(x, "vol", few=True) if weighting == "inverse_vol" else X.equal_weight(x, few=True))


@signal
def low_volatility(m: Market, window: int, n: int = 12, trend: int | None = None, freq: str = "me") -> DataFrame:
    x = m.panel.withColumn("vol", R.realized_vol("ret", window))
    if trend:
        x = x.withColumn("_s", R.sma("adj_close", trend)).where(F.col("adj_close") > F.col("_s"))
    return _pick(m, x, F.col("vol"), n, freq, positive=False, ascending=True)


@signal
def breadth_gated_basket(m: Market, basket: str, window: int, threshold: float = 0.45, smooth: int = 4, floor: float = 0.0, freq: str = "wf") -> DataFrame:
    b = m.cal.select("date").join(breadth(m, window, smooth), "date", "left")
    gate = F.greatest(F.when(F.col("breadth").isNull() | (F.col("breadth") >= threshold), 1.0).otherwise(0.0), F.lit(floor))
    return _overlay(m, _masked_equal(m.basket(basket)), b.select("date", gate.alias("exposure")), freq)


def theme_levels(m: Market, themes: list[str] | None = None) -> DataFrame:
    """Equal-weight compounded index of each theme (of all, if none are named) over its masked members: ``(basket, date, pos, level)``."""
    x = m.panel.join(m.members.where(F.col("basket").isin(themes)) if themes else m.members, "series_id")
    x = x.groupBy("basket", "date", "pos").agg(F.avg(F.when(F.col("mask"), F.col("ret"))).alias("ret"))
    return x.withColumn("level", R.growth_path("ret", key=["basket"], order="pos"))


@signal
def theme_rotation(m: Market, themes: list[str], lookback: int, skip: int, top: int, freq: str = "me") -> DataFrame:
    t = theme_levels(m, themes)
    w = Window.partitionBy("basket").orderBy("pos")
    t = t.withColumn("mom", F.try_divide(F.lag("level", skip).over(w), F.lag("level", lookback).over(w)) - 1)
    t = X.top_n(decisions(t, m, freq).where("mom > 0"), "mom", top, tie="basket")
    t = X.equal_weight(t, out="share", few=True).select("basket", "date", "share")
    live = decisions(m.panel.where("mask").select("series_id", "date"), m, freq).join(m.members.where(F.col("basket").isin(themes)), "series_id")
    inner = X.equal_weight(live, key=["basket", "date"]).join(t, ["basket", "date"])
    return _w(inner.groupBy("series_id", "date").agg(F.sum(F.col("w") * F.col("share")).alias("w")))


@signal
def dispersion_timed(m: Market, lookback: int, skip: int, n: int, window: int, pct: float, min_history: int, freq: str = "me") -> DataFrame:
    x = m.panel.withColumn("_r", F.when(F.col("mask"), F.col("ret"))).withColumn("_sd", R.std("_r", window))
    d = x.groupBy("date").agg(F.stddev_samp("_sd").alias("disp"))
    d = expanding_quantile(d, "disp", pct, "_t", min_history)
    d = d.select("date", F.coalesce(F.col("disp") >= F.col("_t"), F.lit(False)).alias("selective"))
    picked = xs_momentum(m, lookback, skip, n, freq=freq).join(F.broadcast(d.where("selective")), "date", "left_semi")
    broad = _masked_equal(decisions(m.panel, m, freq)).join(F.broadcast(d.where("not selective")), "date", "left_semi")
    return _w(picked).unionByName(_w(broad))


# ------------------------------------------------------------------ allocation and long-short
@signal
def equal_risk(m: Market, basket: str, window: int, cap: float = 0.25, freq: str = "me") -> DataFrame:
    return _w(X.cap_weights(allocation.equal_risk_weights(m.basket(basket), m.cal, freq, window), cap))


@signal
def min_correlation(m: Market, window: int, n: int = 10, freq: str = "qe") -> DataFrame:
    return _w(allocation.least_correlated(m.panel, m.cal, freq, window, n))


@signal
def market_neutral_momentum(m: Market, lookback: int, skip: int, n: int = 10, gross: float = 1.0, freq: str = "me") -> DataFrame:
    x = decisions(m.panel.withColumn("mom", R.momentum("adj_close", lookback, skip)).where("mask"), m, freq)
    return _w(X.two_books(x.select("series_id", "date", "mom"), "mom", n, gross))


def _hedge_leg(m: Market, book_return: DataFrame, window: int, max_hedge: float, min_rows: int | None, exposure: str | None = None, ratio: float = 1.0) -> DataFrame:
    """Short index weight per date from the trailing beta of a book's return column ``book``."""
    x = book_return.join(m.index_series().select("date", "ix_ret"), "date", "left")
    w = Window.orderBy("date").rowsBetween(-(window - 1), 0)
    need = min_rows or window
    pair = F.when(F.col("book").isNotNull() & F.col("ix_ret").isNotNull(), 1)
    cov = F.when(F.count(pair).over(w) >= need, F.covar_samp("book", "ix_ret").over(w))
    var = F.when(F.count("ix_ret").over(w) >= need, F.var_samp("ix_ret").over(w))
    beta = F.try_divide(cov, var)
    hedge = F.coalesce(-F.least(F.greatest(beta, F.lit(0.0)), F.lit(max_hedge)), F.lit(0.0)) if exposure is None else \
        F.coalesce(-F.least(F.greatest(beta, F.lit(0.0)), F.lit(max_hedge)) * F.col(exposure) * ratio, F.lit(0.0))
    return x.select(F.lit(m.index).alias("series_id"), "date", F.when(beta.isNull(), 0.0).otherwise(hedge).alias("w"))


@signal
def beta_hedged_basket(m: Market, basket: str, window: int, max_hedge: float = 1.5, freq: str = "wf") -> DataFrame:
    w = _masked_equal(m.basket(basket).where(F.col("series_id") != m.index)) if m.index else _masked_equal(m.basket(basket))
    leg = _hedge_leg(m, _own_return(m, w).withColumnRenamed("gross", "book"), window, max_hedge, None)
    return _w(decisions(w.unionByName(leg), m, freq))


# ------------------------------------------------------------------ single-series chart rules
@signal
def gaussian_bands(m: Market, period: int, poles: int = 4, atr_window: int = 22, band: float = 1.5, exit_band: float = 0.0, min_hold: int = 0) -> DataFrame:
    x = atr(gaussian(m.panel, "adj_close", period, poles), atr_window)
    x = x.withColumns({"entry": R.above("adj_close", F.col("centre") + band * F.col("atr")) & F.col("mask"),
                       "leave": R.below("adj_close", F.col("centre") - exit_band * F.col("atr"))})
    return _held(_latched(x, min_hold))


@signal
def gaussian_hold(m: Market, period: int, poles: int = 4, atr_window: int = 22, band: float = 2.5, confirm: int = 5, min_hold: int = 0) -> DataFrame:
    x = atr(gaussian(m.panel, "adj_close", period, poles), atr_window)
    x = x.withColumns({"entry": R.above("adj_close", "centre") & R.above("centre", R.lag("centre", confirm)) & F.col("mask"),
                       "leave": R.below("adj_close", F.col("centre") - band * F.col("atr"))})
    return _held(_latched(x, min_hold))


def _latched(x: DataFrame, min_hold: int) -> DataFrame:
    if min_hold <= 0:
        return x.withColumn("held", R.latch("entry", "leave"))
    return stateful.min_hold_latch(x, "entry", "leave", min_hold).join(x.select("series_id", "date", "mask"), ["series_id", "date"])


@signal
def supertrend(m: Market, atr_window: int = 10, mult: float = 3.0, min_hold: int = 0) -> DataFrame:
    held = stateful.ratchet_band(atr(m.panel, atr_window), "atr", mult, min_hold)
    return _w(X.equal_weight(held.where("held").select("series_id", "date")))


@signal
def adx_strength(m: Market, di_window: int = 14, adx_window: int = 14, floor: float = 20.0, exit_floor: float | None = None, min_hold: int = 0) -> DataFrame:
    x = adx(m.panel, di_window, adx_window)
    up = R.above("plus_di", "minus_di")
    x = x.withColumns({"entry": up & F.coalesce(F.col("adx") >= floor, F.lit(False)) & F.col("mask"),
                       "leave": ~up | R.below("adx", F.lit(floor if exit_floor is None else exit_floor))})
    return _held(_latched(x, min_hold))


@signal
def relative_new_high(m: Market, entry_window: int, exit_window: int, trend: int) -> DataFrame:
    x = m.with_index(m.panel).withColumn("rs", F.try_divide("adj_close", "ix"))
    x = x.withColumns({"hi": R.prior_max("rs", entry_window), "lo": R.prior_min("rs", exit_window), "_s": R.sma("adj_close", trend)})
    x = x.withColumn("held", R.latch(R.above("rs", "hi") & R.above("adj_close", "_s") & F.col("mask"), R.below("rs", "lo")))
    return _held(x)


@signal
def atr_trailing_stop(m: Market, entry_window: int, atr_window: int, mult: float) -> DataFrame:
    x = atr(m.panel.withColumn("hi", R.prior_max("adj_close", entry_window)), atr_window).withColumn("breakout", R.above("adj_close", "hi"))
    held = stateful.trailing_stop(x, "breakout", "atr", mult)
    return _w(X.equal_weight(held.where("held").select("series_id", "date")))


@signal
def high_proximity(m: Market, window: int, n: int = 10, floor: float = 0.9, freq: str = "me") -> DataFrame:
    x = m.panel.withColumn("prox", F.try_divide("adj_close", R.rolling(F.max, "adj_close", window, window // 2)))
    return _pick(m, x.where(F.col("prox") >= floor), F.col("prox"), n, freq, positive=False)


@signal
def quiet_trend(m: Market, trend: int, vol_window: int, q: float, lookback: int, min_history: int) -> DataFrame:
    x = m.panel.withColumns({"_s": R.sma("adj_close", trend), "vol": R.realized_vol("ret", vol_window)})
    x = x.withColumn("_t", R.quantile("vol", lookback, q, min_history))
    return _held(x.withColumn("held", R.above("adj_close", "_s") & F.coalesce(F.col("vol") <= F.col("_t"), F.lit(False))))


@signal
def volume_breakout(m: Market, entry_window: int, exit_window: int, vol_window: int, mult: float) -> DataFrame:
    x = m.panel.withColumns({"hi": R.prior_max("adj_close", entry_window), "lo": R.prior_min("adj_close", exit_window),
                             "base": R.rolling_adv("dollar_volume", vol_window, vol_window // 2)})
    heavy = R.above("dollar_volume", F.col("base") * mult)
    return _held(x.withColumn("held", R.latch(R.above("adj_close", "hi") & heavy & F.col("mask"), R.below("adj_close", "lo"))))


@signal
def turn_of_month(m: Market, start_day: int = 26, end_day: int = 5) -> DataFrame:
    d = F.dayofmonth("date")
    return _w(_masked_equal(m.panel.where((d >= start_day) | (d <= end_day))))


@signal
def short_squeeze(m: Market, lookback: int, q: float, trend: int, exit_q: float, min_history: int, min_hold: int = 0) -> DataFrame:
    s = m.short.select("series_id", "date", F.try_divide("short_volume", "total_volume").alias("share"))
    x = m.panel.join(s, ["series_id", "date"], "left").withColumn("share", R.ffill("share", 5))
    x = x.withColumns({"_hi": R.quantile("share", lookback, q, min_history), "_lo": R.quantile("share", lookback, exit_q, min_history),
                       "up": R.above("adj_close", R.sma("adj_close", trend))})
    x = x.withColumns({"entry": F.coalesce(F.col("share") >= F.col("_hi"), F.lit(False)) & F.col("up") & F.col("mask"),
                       "leave": F.coalesce(F.col("share") <= F.col("_lo"), F.lit(False)) | ~F.col("up")})
    return _held(_latched(x, min_hold))


@signal
def hedged_signal(m: Market, book: str, window: int, max_hedge: float = 1.5, ratio: float = 1.0, min_rows: int = 13, **params) -> DataFrame:
    """A chart rule's long book minus the index at the trailing beta of the book as if fully invested."""
    w = SIGNALS[book](m, **params).where(F.col("series_id") != m.index)
    ex = w.groupBy("date").agg(F.least(F.sum(F.abs("w")), F.lit(1.0)).alias("_e"))
    p = _own_return(m, w).join(ex, "date", "left").na.fill(0.0, ["_e"])
    p = p.withColumn("book", F.try_divide("gross", F.lag("_e").over(Window.orderBy("date"))))
    return _w(w.unionByName(_hedge_leg(m, p, window, max_hedge, min_rows, "_e", ratio)))


@signal
def golden_cross(m: Market, fast: int, slow: int, freq: str = "me") -> DataFrame:
    x = m.panel.withColumns({"_f": R.sma("adj_close", fast), "_s": R.sma("adj_close", slow)}).where(F.col("_f") > F.col("_s"))
    return _w(_masked_equal(decisions(x, m, freq)))
