"""Trailing window operators."""

from pyspark.sql import functions as F

from ..functions import rolling as R
from ..operators.order_stats import expanding_quantile
from ..sources import tables as T
from .base import W, lagx, query, roll, sql_panel
from .panel import masked_panel, sql_mask

PW = sql_panel("w")
RET = f"px AS (SELECT *, adj_close AS px, adj_close / nullif({lagx('adj_close')}, 0) - 1 AS ret, adj_close - {lagx('adj_close')} AS diff FROM panel)"
BASE = f"{PW}, {RET}"
ROOT = "sqrt(252e0)"


def px(spark, d):
    panel, _ = T.market_panel(spark, d)
    return panel.withColumn("px", F.col("adj_close")).withColumns({"ret": R.pct_change("px"), "diff": F.col("px") - R.lag("px")})


def _simple(key, expr_spark, expr_sql, extra="", kind="f"):
    @query(key, f"series_id:s date:d x:{kind}", f"{BASE}, {extra} out AS (SELECT series_id, date, {expr_sql} AS x FROM px)")
    def run(spark, d):
        return px(spark, d).withColumn("x", expr_spark())


_simple("w1_momentum", lambda: R.momentum("px", 52, 4), f"{lagx('px', 4)} / nullif({lagx('px', 52)}, 0) - 1")
_simple("w2_risk_adjusted_momentum", lambda: F.try_divide(R.momentum("px", 26, 4), R.realized_vol("ret", 26)),
        f"({lagx('px', 4)} / nullif({lagx('px', 26)}, 0) - 1) / nullif(({roll('stddev_samp', 'ret', 26)}) * {ROOT}, 0)")
_simple("w4_rsi", lambda: R.rsi("diff", 3),
        f"100 - 100 / (1 + ({roll('avg', '(CASE WHEN diff IS NOT NULL THEN greatest(diff, 0e0) END)', 3)}) / nullif({roll('avg', '(CASE WHEN diff IS NOT NULL THEN greatest(-diff, 0e0) END)', 3)}, 0))")
_simple("w5_short_term_reversal", lambda: -R.momentum("px", 5), f"-(px / nullif({lagx('px', 5)}, 0) - 1)")
_simple("w6_bollinger_z", lambda: R.bollinger_z("px", 20), f"(px - ({roll('avg', 'px', 20)})) / nullif({roll('stddev_samp', 'px', 20)}, 0)")
_simple("w8_realized_vol", lambda: R.realized_vol("ret", 21), f"({roll('stddev_samp', 'ret', 21)}) * {ROOT}")
_simple("w9_rolling_adv", lambda: R.rolling_adv("dollar_volume"), roll("avg", "dollar_volume", 21, 5, 1), kind="p")
_simple("w11_rolling_quantile", lambda: R.quantile("ret", 104, 0.75, 52), roll("quantile_cont({x}, 0.75)", "ret", 104, 52))
_simple("w13_percentile_rank", lambda: R.percentile_rank("ret", 52), f"""CASE WHEN ret IS NOT NULL AND count(ret) {W(52)} >= 52 THEN
 (len(list_filter(list(ret) {W(52)}, lambda v: v < ret)) + (len(list_filter(list(ret) {W(52)}, lambda v: v = ret)) + 1) / 2e0) / 52e0 END""")
_simple("w14_median_multiple", lambda: F.coalesce(F.col("px") > 1.1 * R.quantile("px", 52, 0.5), F.lit(False)).cast("double"),
        f"CAST(coalesce(px > 1.1 * ({roll('median', 'px', 52)}), FALSE) AS DOUBLE)")
_simple("w29_running_equity", lambda: F.ln(R.growth_path("ret")), f"sum(ln(1 + coalesce(ret, 0))) {W(None)}")  # as log growth


@query("w3_sma_distance", "series_id:s date:d sma:p above:b distance:f", f"""{BASE}, m AS (SELECT series_id, date, px, {roll('avg', 'px', 40)} AS sma FROM px),
out AS (SELECT series_id, date, sma, coalesce(px > sma, FALSE) AS above, px / nullif(sma, 0) - 1 AS distance FROM m)""")
def w3(spark, d):
    return px(spark, d).withColumn("sma", R.sma("px", 40)).select(
        "series_id", "date", "sma", R.above("px", "sma").alias("above"), (F.try_divide("px", "sma") - 1).alias("distance"))


@query("w3_sma_daily", "series_id:s date:d sma:p dist:f", f"""{sql_panel('d')}, m AS (SELECT *, {roll('avg', 'adj_close', 200, 120)} AS sma FROM panel),
out AS (SELECT series_id, date, sma, adj_close / nullif(sma, 0) - 1 AS dist FROM m)""")
def w3d(spark, d):
    panel, _ = T.market_panel(spark, d, "d")
    return panel.withColumn("sma", R.sma("adj_close", 200, 120)).withColumn("dist", F.try_divide("adj_close", "sma") - 1)


@query("w7_donchian", "series_id:s date:d hi:p lo:p breakout:b", f"""{BASE}, m AS (SELECT *, {roll('max', 'px', 13, None, 1)} AS hi, {roll('min', 'px', 6, None, 1)} AS lo FROM px),
out AS (SELECT series_id, date, hi, lo, coalesce(px > hi, FALSE) AS breakout FROM m)""")
def w7(spark, d):
    x = px(spark, d).withColumns({"hi": R.prior_max("px", 13), "lo": R.prior_min("px", 6)})
    return x.withColumn("breakout", R.above("px", "hi"))


SQL_BENCH = f"""bn AS (SELECT date, bench, bench / nullif(lag(bench) OVER (ORDER BY date), 0) - 1 AS bret FROM (SELECT date, avg(adj_close) AS bench FROM panel GROUP BY 1)),
pb AS (SELECT px.*, bn.bench, bn.bret FROM px JOIN bn USING (date))"""


def with_bench(panel):
    """Attach the benchmark level and return of each date (one row per date, so it is broadcast)."""
    b = T.bench(panel)
    from pyspark.sql import Window

    b = b.withColumn("bret", F.try_divide("bench", F.lag("bench").over(Window.orderBy("pos"))) - 1)
    return panel.join(F.broadcast(b.select("date", "bench", "bret")), "date")


@query("w10_rolling_beta", "series_id:s date:d beta:f beta_min:f", f"""{BASE}, {SQL_BENCH}, m AS (SELECT *, ret * bret AS pair FROM pb),
out AS (SELECT series_id, date, (CASE WHEN count(pair) {W(52)} >= 52 THEN covar_samp(ret, bret) {W(52)} END) / nullif({roll('var_samp', 'bret', 52)}, 0) AS beta,
 (CASE WHEN count(pair) {W(26)} >= 13 THEN covar_samp(ret, bret) {W(26)} END) / nullif({roll('var_samp', 'bret', 26, 13)}, 0) AS beta_min FROM m)""")
def w10(spark, d):
    return with_bench(px(spark, d)).withColumns({"beta": R.rolling_beta("ret", "bret", 52), "beta_min": R.rolling_beta("ret", "bret", 26, 13)})


@query("w12_expanding_quantile", "date:d disp:f q:f", f"""{BASE}, x AS (SELECT date, stddev_samp(ret) AS disp FROM px GROUP BY 1),
out AS (SELECT date, disp, CASE WHEN count(disp) OVER (ORDER BY date ROWS UNBOUNDED PRECEDING) >= 52 THEN quantile_cont(disp, 0.6) OVER (ORDER BY date ROWS UNBOUNDED PRECEDING) END AS q FROM x)""")
def w12(spark, d):
    x = px(spark, d).groupBy("date").agg(F.stddev_samp("ret").alias("disp"))
    return expanding_quantile(x, "disp", 0.6, "q", 52)


@query("w19_latch", "series_id:s date:d held:b", f"""{BASE}, m AS (SELECT *, (px - ({roll('avg', 'px', 10)})) / nullif({roll('stddev_samp', 'px', 10)}, 0) AS z FROM px),
k AS (SELECT *, CASE WHEN z < -1 THEN TRUE WHEN z > 0 THEN FALSE END AS mark FROM m),
out AS (SELECT series_id, date, coalesce(last_value(mark IGNORE NULLS) {W(None)}, FALSE) AS held FROM k)""")
def w19(spark, d):
    x = px(spark, d).withColumn("z", R.bollinger_z("px", 10))
    return x.withColumn("held", R.latch(F.col("z") < -1, F.col("z") > 0))


@query("w24_rolling_sharpe_cagr", "series_id:s date:d rs:f rc:f", f"""{BASE}, c AS (SELECT * FROM px WHERE ret IS NOT NULL),
out AS (SELECT series_id, date, ({roll('avg', 'ret', 104)}) / nullif({roll('stddev_samp', 'ret', 104)}, 0) * {ROOT} AS rs,
 pow(exp({roll('sum', 'ln(1 + ret)', 104)}), 0.5) - 1 AS rc FROM c)""")
def w24(spark, d):
    x = px(spark, d).where("ret is not null")
    return x.select("series_id", "date", (F.try_divide(R.rolling(F.avg, "ret", 104), R.std("ret", 104)) * F.lit(252.0**0.5)).alias("rs"),
                    (F.pow(F.exp(R.rolling(F.sum, F.ln(1 + F.col("ret")), 104)), 0.5) - 1).alias("rc"))


@query("w30_squeeze_lagged", "series_id:s date:d squeezed:b", f"""{BASE}, v AS (SELECT *, ({roll('stddev_samp', 'ret', 5)}) * {ROOT} AS vol FROM px),
k AS (SELECT *, CASE WHEN vol IS NOT NULL AND count(vol) {W(40)} >= 40 THEN
 (len(list_filter(list(vol) {W(40)}, lambda v: v < vol)) + (len(list_filter(list(vol) {W(40)}, lambda v: v = vol)) + 1) / 2e0) / 40e0 END AS pr FROM v),
out AS (SELECT series_id, date, coalesce(lag(pr < 0.25) OVER (PARTITION BY series_id ORDER BY date), FALSE) AS squeezed FROM k)""")
def w30(spark, d):
    x = px(spark, d).withColumn("vol", R.realized_vol("ret", 5)).withColumn("pr", R.percentile_rank("vol", 40))
    return x.withColumn("squeezed", F.coalesce(R.lag(F.col("pr") < 0.25), F.lit(False)))
