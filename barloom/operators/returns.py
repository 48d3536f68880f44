"""Weight tables to lagged portfolio returns, turnover, costs and net curves.

Weights decided on a date are traded one calendar row later: the calendar's ``<freq>_exec`` column names the decision in force
on each row, so the lag is an equi-join key and not a window over history. Accounting is in weight space: after each trade the
holdings equal the targets, and participation is measured against a fixed capital.
"""

from __future__ import annotations

from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import rolling as R

TOLERANCE = 0.0015
MAX_PARTICIPATION = 0.05


@dataclass(frozen=True)
class CostScenario:
    """One-way trading costs and yearly borrow, in basis points."""

    name: str
    commission_bps: float
    half_spread_bps: float
    slippage_bps: float
    impact_coeff_bps: float
    borrow_bps: float


# The four evaluation scenarios.
SCENARIOS = [
    CostScenario("zero", 0.0, 0.0, 0.0, 0.0, 0.0),
    CostScenario("low", 0.0, 1.0, 1.0, 5.0, 25.0),
    CostScenario("base", 0.5, 2.5, 2.5, 10.0, 50.0),
    CostScenario("stressed", 1.0, 7.5, 7.5, 25.0, 150.0),
]


def scenario_structs(scenarios: list[CostScenario]):
    """The scenarios as a literal array; exploding it pairs every row with every scenario without a join."""
    return F.array(*[F.struct(*[F.lit(v).alias(k) for k, v in asdict(s).items()]) for s in scenarios])


def delisted_mark(panel: DataFrame) -> DataFrame:
    """Mark each row: last quoted price once quotes stop, its return, and whether the quote is gone."""
    panel = panel.withColumn("mark", R.ffill("adj_close"))
    return panel.withColumns({"mark_ret": F.coalesce(F.try_divide("mark", R.lag("mark")) - 1, F.lit(0.0)),
                              "stopped": F.col("adj_close").isNull() & F.col("mark").isNotNull()})


def _ids(weights: DataFrame) -> list[str]:
    return [c for c in weights.columns if c not in ("series_id", "date", "w")]


def held_weights(weights: DataFrame, cal: DataFrame, freq: str, lagged: bool = False) -> DataFrame:
    """Expand decisions to every row they are in force on (``lagged``: the rows they are traded and held on)."""
    in_force = cal.select(F.col("date").alias("_row"), F.col(f"{freq}_{'exec' if lagged else 'force'}").alias("date"))
    x = weights.join(F.broadcast(in_force), "date")
    return x.select(*_ids(weights), "series_id", F.col("_row").alias("date"), "w")


def portfolio_returns(weights: DataFrame, panel: DataFrame, cal: DataFrame, freq: str, ret: str = "ret") -> DataFrame:
    """Sum of held weight times return per date, from the first decision on; idle dates earn zero.

    Both sides meet on (series, decision date), so each history row is shuffled once, and the sum is pre-aggregated.
    """
    ids = _ids(weights)
    hist = panel.where(F.col(ret).isNotNull()).select("series_id", "date", F.col(ret).alias("_r"))
    ex = cal.select("date", F.col(f"{freq}_exec").alias("_d")).where("_d is not null")
    hist = hist.join(F.broadcast(ex), "date")
    w = weights.select(*ids, "series_id", F.col("date").alias("_d"), "w")
    p = hist.join(w, ["series_id", "_d"]).groupBy(*ids, "date").agg(F.sum(F.col("w") * F.col("_r")).alias("gross"),
                                                                    F.sum("w").alias("net_exposure"),
                                                                    F.sum(F.when(F.col("w") < 0, -F.col("w")).otherwise(0.0)).alias("short_exposure"))
    first = weights.groupBy(*ids).agg(F.min("date").alias("_first")) if ids else weights.agg(F.min("date").alias("_first"))
    days = first.join(F.broadcast(cal.select("date")), F.col("date") >= F.col("_first")).drop("_first")
    return days.join(p, [*ids, "date"], "left").na.fill(0.0, ["gross", "net_exposure", "short_exposure"])


def two_part_returns(weights: DataFrame, panel: DataFrame, cal: DataFrame, freq: str) -> DataFrame:
    """Overnight moves earned on the old weights plus intraday moves on the new ones, per date."""
    ids = _ids(weights)
    px = panel.withColumns({"_k": F.try_divide("adj_close", "close")})
    px = px.withColumn("_o", F.col("open") * F.col("_k"))
    px = px.withColumns({"_night": F.try_divide("_o", R.lag("adj_close")) - 1, "_day": F.try_divide("adj_close", "_o") - 1})
    w = Window.orderBy("date")
    ex = cal.select("date", F.col(f"{freq}_exec").alias("_new"), F.lag(f"{freq}_exec").over(w).alias("_old"))
    x = px.select("series_id", "date", "_night", "_day").join(F.broadcast(ex), "date")
    legs = x.select("series_id", "date", F.inline(F.array(F.struct(F.col("_old").alias("_d"), F.col("_night").alias("_r")),
                                                          F.struct(F.col("_new").alias("_d"), F.col("_day").alias("_r")))))
    legs = legs.where("_d is not null and _r is not null")
    return legs.join(weights.withColumnRenamed("date", "_d"), ["series_id", "_d"]).groupBy(*ids, "date").agg(F.sum(F.col("w") * F.col("_r")).alias("ret"))


def stamp_steps(cal: DataFrame, freq: str) -> DataFrame:
    """Each decision date with the row it is traded on and the following decision date."""
    w = Window.orderBy("date")
    s = cal.where(F.col(f"{freq}_stamp")).select("date", F.col("next_date").alias("trade_date"))
    return s.withColumn("next_stamp", F.lead("date").over(w))


def trades(weights: DataFrame, cal: DataFrame, freq: str, tolerance: float = TOLERANCE) -> DataFrame:
    """Weight changes per decision: every weight enters at its own decision and leaves at the next, and the two are summed."""
    ids = _ids(weights)
    x = weights.join(F.broadcast(stamp_steps(cal, freq)), "date")
    x = x.select(*ids, "series_id", F.inline(F.array(F.struct(F.col("date").alias("date"), F.col("w").alias("d")),
                                                     F.struct(F.col("next_stamp").alias("date"), (-F.col("w")).alias("d")))))
    t = x.where("date is not null").groupBy(*ids, "series_id", "date").agg(F.sum("d").alias("delta"))
    t = t.where(F.abs("delta") >= tolerance)
    return t.join(F.broadcast(stamp_steps(cal, freq).select("date", "trade_date")), "date").where("trade_date is not null") \
        .select(*ids, "series_id", F.col("trade_date").alias("date"), "delta")


def turnover(weights: DataFrame, cal: DataFrame, freq: str, tolerance: float = TOLERANCE) -> DataFrame:
    t = trades(weights, cal, freq, tolerance)
    ids = [c for c in t.columns if c not in ("series_id", "date", "delta")]
    return t.groupBy(*ids, "date").agg(F.sum(F.abs("delta")).alias("turnover"), F.count("*").alias("n_trades"))


def cost_fraction(value="value", adv="adv", s="scen"):
    """Cost of a one-way trade of ``value`` dollars: fixed basis points plus square-root participation impact."""
    fixed = F.col(f"{s}.commission_bps") + F.col(f"{s}.half_spread_bps") + F.col(f"{s}.slippage_bps")
    part = F.least(F.try_divide(F.col(value), F.col(adv)), F.lit(1.0))
    impact = F.when(F.col(adv) > 0, F.col(f"{s}.impact_coeff_bps") * F.sqrt(part)).otherwise(F.lit(0.0))
    return F.col(value) * (fixed + impact) / 1e4


def priced_trades(weights: DataFrame, panel: DataFrame, cal: DataFrame, freq: str, scenarios: list[CostScenario], capitals: list[float],
                  participation: float | None = MAX_PARTICIPATION, adv_window: int = 21) -> DataFrame:
    """Every trade under every scenario and capital, with the participation cap, its cost and the doubled cost of dead names."""
    t = trades(weights, cal, freq)
    liq = panel.withColumn("adv", R.rolling_adv("dollar_volume", adv_window)).select("series_id", "date", "adv", F.col("adj_close").isNull().alias("dead"))
    x = t.join(liq, ["series_id", "date"], "left")
    x = x.withColumn("capital", F.explode(F.array(*[F.lit(float(c)) for c in capitals])))
    value = F.abs("delta") * F.col("capital")
    if participation is not None:
        value = F.when(F.col("adv").isNotNull(), F.least(value, participation * F.col("adv"))).otherwise(value)
    x = x.withColumn("value", value).withColumn("scen", F.explode(scenario_structs(scenarios)))
    return x.withColumn("cost", cost_fraction() * F.when(F.coalesce("dead", F.lit(False)), 2.0).otherwise(1.0))


def net_curves(weights: DataFrame, panel: DataFrame, cal: DataFrame, freq: str, scenarios: list[CostScenario] = SCENARIOS,
               capitals: list[float] = (1e6,), cash_rate: DataFrame | None = None, ret: str = "ret") -> DataFrame:
    """``(ids, scenario, capital, date, gross, turnover, cost, borrow, interest, ret)`` for one weight table."""
    ids = _ids(weights)
    p = portfolio_returns(weights, panel, cal, freq, ret)
    if cash_rate is not None:
        p = p.join(F.broadcast(cash_rate.select("date", "rate")), "date", "left")
    else:
        p = p.withColumn("rate", F.lit(0.0))
    p = p.withColumn("capital", F.explode(F.array(*[F.lit(float(c)) for c in capitals]))).withColumn("scen", F.explode(scenario_structs(scenarios)))
    p = p.withColumn("scenario", F.col("scen.name"))
    c = priced_trades(weights, panel, cal, freq, list(scenarios), list(capitals)).groupBy(*ids, F.col("scen.name").alias("scenario"), "capital", "date").agg(
        (F.sum("cost") / F.max("capital")).alias("cost"), (F.sum("value") / F.max("capital")).alias("turnover"), F.count("*").alias("n_trades"))
    x = p.join(c, [*ids, "scenario", "capital", "date"], "left").na.fill(0.0, ["cost", "turnover", "rate"]).na.fill(0, ["n_trades"])
    x = x.withColumns({"borrow": F.col("short_exposure") * F.col("scen.borrow_bps") / 1e4 / 252.0,
                       "interest": (1 - F.col("net_exposure")) * F.col("rate") / 100.0 / 252.0})
    return x.select(*ids, "scenario", "capital", "date", "gross", "turnover", "n_trades", "cost", "borrow", "interest",
                    (F.col("gross") - F.col("cost") - F.col("borrow") + F.col("interest")).alias("ret"))


def vol_target(weights: DataFrame, panel: DataFrame, cal: DataFrame, freq: str, target: float, window: int, max_leverage: float = 1.0,
               ret: str = "ret") -> DataFrame:
    """Scale each decision so the trailing volatility of the weights' own lagged return meets ``target``."""
    p = portfolio_returns(weights, panel, cal, freq, ret)
    days = cal.select("date").join(p.select("date", "gross"), "date", "left").na.fill(0.0, ["gross"])
    vol = R.rolling(F.stddev_samp, "gross", window, key=[], order="date") * F.lit(252.0**0.5)
    x = days.withColumn("scale", F.coalesce(F.least(F.try_divide(F.lit(target), vol), F.lit(max_leverage)), F.lit(1.0)))
    return weights.join(F.broadcast(x.select("date", "scale")), "date").withColumn("w", F.col("w") * F.col("scale")).drop("scale")


def capacity(curves: DataFrame, ids: list[str], share: float = 0.8) -> DataFrame:
    """Largest capital keeping ``share`` of the smallest capital's Sharpe under the base scenario, and the drag per size."""
    from ..functions import stats as S

    both = curves.where("scenario IN ('zero', 'base')").groupBy(*ids, "capital", "scenario").agg(S.cagr("ret").alias("cagr"), S.sharpe("ret").alias("sharpe"))
    of = lambda c, s: F.max(F.when(F.col("scenario") == s, F.col(c)))
    x = both.groupBy(*ids, "capital").agg(of("cagr", "zero").alias("zero_cagr"), of("cagr", "base").alias("cagr"), of("sharpe", "base").alias("sharpe"), F.count("*").alias("_both"))
    x = x.where("_both = 2").drop("_both").withColumn("cost_drag", F.col("zero_cagr") - F.col("cagr"))
    w = Window.partitionBy(*ids)
    x = x.withColumn("_s0", F.min_by("sharpe", "capital").over(w))
    cap = F.max(F.when(F.col("sharpe") >= share * F.col("_s0"), F.col("capital"))).over(w)
    return x.withColumn("capacity", F.coalesce(cap, F.min("capital").over(w))).drop("_s0")


def tax_overlay(curves: DataFrame, ids: list[str], st_rate: float = 0.37, lt_rate: float = 0.20, dividend_rate: float = 0.20,
                dividend_yield: float = 0.005, wash_sale_haircut: float = 0.30, harvest: bool = False, deferred: bool = False) -> DataFrame:
    """After-tax growth from yearly returns and turnover: realised share, holding-period rate, loss carry-forward.

    The yearly rows of one curve (a few dozen) are folded in order by a higher-order function.
    """
    y = curves.groupBy(*ids, F.year("date").alias("year")).agg((F.product(1 + F.col("ret")) - 1).alias("r"), F.sum("turnover").alias("to"))
    arr = F.sort_array(F.collect_list(F.struct("year", "r", "to")))
    g = y.groupBy(*ids).agg(arr.alias("_y"))
    d = lambda v: F.lit(float(v))
    zero = F.struct(d(1).alias("eq"), d(0).alias("carry"), d(0).alias("tax"), d(1).alias("pre"))

    def fold(acc, v):
        gain = acc["eq"] * v["r"]
        realised = gain * F.least(v["to"], d(1))
        rate = F.when(v["to"] > 1, d(st_rate)).otherwise(d(lt_rate))
        offset = F.when(realised > 0, F.least(acc["carry"], realised)).otherwise(d(0))
        loss = F.when(realised < 0, -realised * (1 - wash_sale_haircut if harvest else 1.0)).otherwise(d(0))
        tax = d(0) if deferred else acc["eq"] * dividend_yield * dividend_rate + F.when(realised > 0, (realised - offset) * rate).otherwise(d(0))
        return F.struct((acc["eq"] + gain - tax).alias("eq"), (acc["carry"] + (d(0) if deferred else loss - offset)).alias("carry"),
                        (acc["tax"] + tax).alias("tax"), (acc["pre"] * (1 + v["r"])).alias("pre"))

    g = g.select(*ids, F.size("_y").alias("years"), F.aggregate("_y", zero, fold).alias("s"))
    eq = F.col("s.eq")
    liq = F.when(eq > 1, (eq - 1) * lt_rate).otherwise(0.0) if deferred else F.lit(0.0)
    g = g.select(*ids, "years", F.col("s.pre").alias("pre_tax_equity"), (eq - liq).alias("after_tax_equity"), (F.col("s.tax") + liq).alias("taxes_paid"))
    grow = lambda c: F.pow(F.greatest(F.col(c), F.lit(1e-9)), 1.0 / F.col("years")) - 1
    return g.withColumns({"pre_tax_cagr": grow("pre_tax_equity"), "after_tax_cagr": grow("after_tax_equity")}) \
        .withColumn("tax_drag", F.col("pre_tax_cagr") - F.col("after_tax_cagr"))


def blend(curves: DataFrame, members: DataFrame, blend_id: str = "blend") -> DataFrame:
    """Monthly-rebalanced mixes: ``members(blend, strategy, weight)``; weights drift with performance inside each month.

    Missing returns count as zero on dates where any member has one; other dates are dropped. The growth of a member inside a
    month is needed on every date of the month, so members are completed per (blend, date) from the grouped dates.
    """
    m = members.withColumn("weight", F.col("weight") / F.sum("weight").over(Window.partitionBy(blend_id)))
    x = m.join(curves.select("strategy", "date", "ret"), "strategy").where("ret is not null")
    dates = x.groupBy(blend_id, F.trunc("date", "month").alias("_m")).agg(F.collect_set("date").alias("_dates"))
    grid = dates.join(m, blend_id).select(blend_id, "strategy", "weight", "_m", F.explode("_dates").alias("date"))
    x = grid.join(x.select(blend_id, "strategy", "date", "ret"), [blend_id, "strategy", "date"], "left")
    w = Window.partitionBy(blend_id, "strategy", "_m").orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    x = x.withColumn("_g", F.product(1 + F.coalesce("ret", F.lit(0.0))).over(w) * F.col("weight"))
    v = x.groupBy(blend_id, "_m", "date").agg(F.sum("_g").alias("_v"))
    prev = F.coalesce(F.lag("_v").over(Window.partitionBy(blend_id, "_m").orderBy("date")), F.lit(1.0))
    return v.select(blend_id, "date", (F.col("_v") / prev - 1).alias("ret"))
