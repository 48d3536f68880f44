"""Return and risk metrics (A1-A31), tax and blends."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import rolling as R
from ..functions import stats as S
from ..operators import gram
from ..operators import metrics as M
from ..operators import returns as B
from ..operators.panel import period_key
from ..session import materialize
from ..sources import curves as C
from ..sources import tables as T
from .base import WK, W, lagx, query, roll, sql_panel
from .returns import CAGR, SHARPE

SQL_CURVES = f"""cv0 AS (SELECT strategy, family, cls, line, date, sum(p) / sum(n) AS px, sum(q) AS qty FROM (
 SELECT {WK} AS date, sum(l_extendedprice) AS p, count(*) AS n, sum(l_quantity) AS q, l_linenumber AS line,
 CASE l_returnflag WHEN 'A' THEN 'Growth' WHEN 'N' THEN 'Value' ELSE 'Rotate' END AS cls, lower(CASE l_returnflag WHEN 'A' THEN 'Growth' WHEN 'N' THEN 'Value' ELSE 'Rotate' END) AS family,
 CASE l_returnflag WHEN 'A' THEN 'Growth' WHEN 'N' THEN 'Value' ELSE 'Rotate' END || '(' || CASE WHEN l_linenumber <= 3 THEN 'basket=T' || (l_linenumber % 3) || ',line=' || l_linenumber
 WHEN l_linenumber <= 5 THEN 'basket=None,line=' || l_linenumber ELSE 'line=' || l_linenumber || ',ticker=X' || l_linenumber END || ')' AS strategy FROM lineitem GROUP BY ALL
 UNION ALL SELECT {WK}, sum(l_extendedprice), count(*), sum(l_quantity), 0, CASE l_linestatus WHEN 'O' THEN 'BuyAndHold' ELSE 'EqualWeightUniverse' END, 'benchmark',
 CASE l_linestatus WHEN 'O' THEN 'BuyAndHold(ticker=SPY)' ELSE 'EqualWeightUniverse(rebalance=ME)' END FROM lineitem GROUP BY ALL) GROUP BY 1, 2, 3, 4, 5),
cv AS (SELECT * FROM (SELECT strategy, family, cls, line, date, (px / lag(px) OVER (PARTITION BY strategy ORDER BY date) - 1) / 10 AS ret,
 coalesce(CASE WHEN lag(qty) OVER (PARTITION BY strategy ORDER BY date) > 0 THEN least(abs(qty / lag(qty) OVER (PARTITION BY strategy ORDER BY date) - 1), 1e0) / 10 END, 0e0) AS turnover FROM cv0) WHERE ret IS NOT NULL)"""
SQL_BN = "bn AS (SELECT date, ret AS bench FROM cv WHERE strategy = 'BuyAndHold(ticker=SPY)'), cb AS (SELECT cv.*, bench FROM cv LEFT JOIN bn USING (date))"
ID = ["strategy"]


def curves(spark, d):
    return C.strategy_curves(spark, d)


def stored_curves(spark, d):
    """The curves as a written table, for plans that read them more than once."""
    return materialize(C.strategy_curves(spark, d), "curves")


def sql_dd(src: str, ids: str, name: str = "dd") -> str:
    return f"""{name}_e AS (SELECT *, exp(sum(ln(1 + ret)) OVER (PARTITION BY {ids} ORDER BY date)) AS equity, row_number() OVER (PARTITION BY {ids} ORDER BY date) AS rn FROM {src}),
{name}_d AS (SELECT *, equity / max(equity) OVER (PARTITION BY {ids} ORDER BY date) - 1 AS drawdown FROM {name}_e),
{name} AS (SELECT *, rn - coalesce(max(CASE WHEN drawdown >= -1e-12 THEN rn END) OVER (PARTITION BY {ids} ORDER BY date ROWS UNBOUNDED PRECEDING), 0) AS below_run FROM {name}_d)"""


AGG = {
    "a1_total_return": (lambda: S.total_return("ret"), "product(1 + ret) - 1"),
    "a2_cagr": (lambda: S.cagr("ret"), CAGR),
    "a3_ann_vol": (lambda: S.ann_vol("ret"), "stddev_samp(ret) * sqrt(252e0)"),
    "a4_sharpe": (lambda: S.sharpe("ret"), SHARPE),
    "a5_sortino": (lambda: S.sortino("ret"), "avg(ret) / stddev_samp(CASE WHEN ret < 0 THEN ret END) * sqrt(252e0)"),
    "a11_tracking_error": (lambda: S.tracking_error("ret", "bench"), "stddev_samp(ret - bench) * sqrt(252e0)"),
    "a11_information_ratio": (lambda: S.information_ratio("ret", "bench"), "CASE WHEN stddev_samp(ret - bench) > 0 THEN avg(ret - bench) / stddev_samp(ret - bench) * sqrt(252e0) END"),
    "a10_beta": (lambda: S.beta("ret", "bench"), "CASE WHEN count(ret * bench) >= 60 THEN covar_samp(ret, bench) / var_samp(bench) END"),
    "a10_alpha": (lambda: S.alpha("ret", "bench"), "CASE WHEN count(ret * bench) >= 60 THEN (avg(CASE WHEN bench IS NOT NULL THEN ret END) - covar_samp(ret, bench) / var_samp(bench) * avg(bench)) * 252 END"),
    "a12_upside_capture": (lambda: S.capture("ret", "bench", True), "avg(CASE WHEN bench > 0 THEN ret END) / avg(CASE WHEN bench > 0 THEN bench END)"),
    "a12_downside_capture": (lambda: S.capture("ret", "bench", False), "avg(CASE WHEN bench < 0 THEN ret END) / avg(CASE WHEN bench < 0 THEN bench END)"),
    "a13_win_rate": (lambda: S.win_rate("ret"), "count_if(ret > 0) / count_if(ret <> 0)"),
    "a13_profit_factor": (lambda: S.profit_factor("ret"), "sum(CASE WHEN ret > 0 THEN ret END) / -sum(CASE WHEN ret < 0 THEN ret END)"),
    "a15_skew": (lambda: S.skew_g1("ret"), "skewness(ret)"),
    "a15_kurtosis": (lambda: S.kurt_g2("ret"), "kurtosis(ret)"),
    "a15_correlation": (lambda: S.correlation("ret", "bench"), "CASE WHEN count(ret * bench) > 30 THEN corr(ret, bench) END"),
    "a23_annual_turnover": (lambda: F.avg("turnover") * 252, "avg(turnover) * 252"),
}


def _agg(key, expr, sql):
    @query(key, "strategy:s x:f", f"{SQL_CURVES}, {SQL_BN}, out AS (SELECT strategy, {sql} AS x FROM cb GROUP BY 1)")
    def run(spark, d):
        c = curves(spark, d)
        if "bench" in sql:
            c = C.with_benchmark(c)
        return c.groupBy("strategy").agg(expr().alias("x"))


for _k, (_e, _s) in AGG.items():
    _agg(_k, _e, _s)


@query("a4_sharpe_excess", "strategy:s x:f", f"""{SQL_CURVES}, rf AS (SELECT date, rate / 100 / 252 AS rf FROM (SELECT date, count(*) % 5 AS rate FROM cv WHERE line <= 3 GROUP BY 1) WHERE rate > 0),
e AS (SELECT strategy, date, ret - coalesce(rf, 0) AS ret FROM cv LEFT JOIN rf USING (date)), out AS (SELECT strategy, {SHARPE} AS x FROM e GROUP BY 1)""")
def a4x(spark, d):
    c = curves(spark, d)
    rf = c.where("line <= 3").groupBy("date").agg((F.count("*") % 5 / 100 / 252).alias("rf")).where("rf > 0")
    return c.join(F.broadcast(rf), "date", "left").withColumn("ex", F.col("ret") - F.coalesce("rf", F.lit(0.0))).groupBy("strategy").agg(S.sharpe("ex").alias("x"))


@query("a6_drawdown_series", "strategy:s date:d drawdown:f", f"{SQL_CURVES}, {sql_dd('cv', 'strategy')}, out AS (SELECT * FROM dd)")
def a6(spark, d):
    return M.drawdowns(curves(spark, d), ID)


@query("a6_max_avg_drawdown", "strategy:s max_dd:f avg_dd:f", f"{SQL_CURVES}, {sql_dd('cv', 'strategy')}, out AS (SELECT strategy, min(drawdown) AS max_dd, coalesce(avg(CASE WHEN drawdown < 0 THEN drawdown END), 0) AS avg_dd FROM dd GROUP BY 1)")
def a6m(spark, d):
    return M.drawdowns(curves(spark, d), ID).groupBy("strategy").agg(M.max_drawdown().alias("max_dd"), F.coalesce(F.avg(F.when(F.col("drawdown") < 0, F.col("drawdown"))), F.lit(0.0)).alias("avg_dd"))


@query("a7_max_dd_duration", "strategy:s n:i", f"""{SQL_CURVES}, {sql_dd('cv', 'strategy')}, i AS (SELECT strategy, drawdown >= -1e-12 AS peak, sum(CASE WHEN drawdown >= -1e-12 THEN 1 ELSE 0 END) OVER (PARTITION BY strategy ORDER BY date) AS g FROM dd_d),
r AS (SELECT strategy, g, count(*) AS n FROM i WHERE NOT peak GROUP BY 1, 2), out AS (SELECT strategy, max(n) AS n FROM r GROUP BY 1)""")
def a7(spark, d):
    return M.drawdowns(curves(spark, d), ID).groupBy("strategy").agg(F.max("below_run").alias("n"))


@query("a8_calmar", "strategy:s x:f", f"{SQL_CURVES}, {sql_dd('cv', 'strategy')}, out AS (SELECT strategy, CASE WHEN min(drawdown) < 0 THEN ({CAGR}) / abs(min(drawdown)) END AS x FROM dd GROUP BY 1)")
def a8(spark, d):
    return M.drawdowns(curves(spark, d), ID).groupBy("strategy").agg(F.when(M.max_drawdown() < 0, S.cagr("ret") / F.abs(M.max_drawdown())).alias("x"))


SQL_VAR = "va AS (SELECT strategy, CASE WHEN count(ret) >= 20 THEN quantile_cont(ret, 0.05) END AS v FROM cv GROUP BY 1), cva AS (SELECT strategy, v AS var_95, avg(CASE WHEN ret <= v THEN ret END) AS cvar_95 FROM cv JOIN va USING (strategy) GROUP BY 1, 2)"


@query("a9_var_cvar", "strategy:s var_95:f cvar_95:f", f"{SQL_CURVES}, {SQL_VAR}, out AS (SELECT * FROM cva)")
def a9(spark, d):
    return M.summary(curves(spark, d), ID)


SQL_BW = "bw AS (SELECT strategy, " + ", ".join(f"(SELECT max(x) FROM (SELECT product(1 + ret) - 1 AS x FROM cv c WHERE c.strategy = s.strategy GROUP BY date_trunc('{u}', date)) WHERE x <> 0) AS best_{u}, (SELECT min(x) FROM (SELECT product(1 + ret) - 1 AS x FROM cv c WHERE c.strategy = s.strategy GROUP BY date_trunc('{u}', date)) WHERE x <> 0) AS worst_{u}" for u in ("month", "quarter", "year")) + " FROM (SELECT DISTINCT strategy FROM cv) s)"


@query("a14_best_worst", "strategy:s best_day:f worst_day:f best_month:f worst_month:f best_quarter:f worst_quarter:f best_year:f worst_year:f",
       f"{SQL_CURVES}, {SQL_BW}, dy AS (SELECT strategy, max(ret) AS best_day, min(ret) AS worst_day FROM cv GROUP BY 1), out AS (SELECT * FROM bw JOIN dy USING (strategy))")
def a14(spark, d):
    return M.summary(curves(spark, d), ID)


SQL_SUMMARY = f"""{SQL_CURVES}, {SQL_BN}, {sql_dd('cb', 'strategy')}, {SQL_VAR}, {SQL_BW},
sm AS (SELECT strategy, product(1 + ret) - 1 AS total_return, {CAGR} AS cagr, stddev_samp(ret) * sqrt(252e0) AS ann_vol, {SHARPE} AS sharpe, {AGG['a5_sortino'][1]} AS sortino, min(drawdown) AS max_drawdown,
 coalesce(avg(CASE WHEN drawdown < 0 THEN drawdown END), 0) AS avg_drawdown, max(below_run) AS max_dd_duration, skewness(ret) AS skew, kurtosis(ret) AS kurtosis, {AGG['a13_win_rate'][1]} AS win_rate,
 {AGG['a13_profit_factor'][1]} AS profit_factor, count(ret) AS n_days, {AGG['a10_beta'][1]} AS beta, {AGG['a10_alpha'][1]} AS alpha_ann, {AGG['a15_correlation'][1]} AS correlation, {AGG['a11_tracking_error'][1]} AS tracking_error,
 {AGG['a11_information_ratio'][1]} AS information_ratio, {AGG['a12_upside_capture'][1]} AS upside_capture, {AGG['a12_downside_capture'][1]} AS downside_capture, avg(turnover) * 252 AS annual_turnover FROM dd GROUP BY 1),
out AS (SELECT *, CASE WHEN max_drawdown < 0 THEN cagr / abs(max_drawdown) END AS calmar FROM sm JOIN cva USING (strategy) JOIN bw USING (strategy))"""


@query("a16_summary", "strategy:s total_return:f cagr:f ann_vol:f sharpe:f sortino:f calmar:f max_drawdown:f avg_drawdown:f max_dd_duration:i var_95:f cvar_95:f skew:f kurtosis:f win_rate:f profit_factor:f "
       "n_days:i beta:f alpha_ann:f correlation:f tracking_error:f information_ratio:f upside_capture:f downside_capture:f annual_turnover:f best_month:f worst_year:f", SQL_SUMMARY)
def a16(spark, d):
    return M.summary(C.with_benchmark(curves(spark, d)), ID, bench="bench", turnover="turnover")


@query("a17_resample_compound", "strategy:s period:d ret:f", f"{SQL_CURVES}, out AS (SELECT strategy, date_trunc('quarter', date) AS period, product(1 + ret) - 1 AS ret FROM cv GROUP BY 1, 2)")
def a17(spark, d):
    return M.resample_compound(curves(spark, d), ID, "qe")


SQL_MONTHLY = "mo AS (SELECT strategy, cls, family, CAST(date_trunc('month', date) AS DATE) AS period, product(1 + ret) - 1 AS ret FROM cv GROUP BY 1, 2, 3, 4)"
SQL_CORR = f"pc AS (SELECT a.strategy AS a, b.strategy AS b, count(*) AS n, corr(a.ret, b.ret) AS corr FROM mo a JOIN mo b ON a.period = b.period AND a.strategy < b.strategy GROUP BY 1, 2 HAVING count(*) >= 25)"


def monthly(spark, d, *extra):
    return M.resample_compound(curves(spark, d), [*ID, *extra], "me")


@query("a18_correlation_matrix", "a:s b:s n:i corr:f", f"{SQL_CURVES}, {SQL_MONTHLY}, {SQL_CORR}, out AS (SELECT * FROM pc)")
def a18(spark, d):
    m = monthly(spark, d).withColumn("g", F.lit(1))
    return gram.pairwise(m, ["g"], "strategy", "period", "ret", min_rows=25).where("a < b")


@query("j10_correlated_pairs", "a:s b:s n:i corr:f", f"{SQL_CURVES}, {SQL_MONTHLY}, {SQL_CORR}, out AS (SELECT * FROM pc WHERE corr > 0.1)")
def j10(spark, d):
    m = monthly(spark, d).withColumn("g", F.lit(1))
    return gram.pairwise(m, ["g"], "strategy", "period", "ret", min_rows=25, min_corr=0.1)


SQL_PER = "per AS (SELECT * FROM (VALUES ('early', DATE '1995-01-01', DATE '1996-12-31'), ('mid', DATE '1997-01-01', DATE '1998-12-31'), ('bull', DATE '1999-01-01', DATE '1999-12-31'), ('ai_rally', DATE '2000-01-01', DATE '2001-12-31')) v(period, lo, hi))"


@query("a19_subperiods", "strategy:s period:s n:i first:d last:d cagr:f sharpe:f max_dd:f bench_cagr:f excess_cagr:f", f"""{SQL_CURVES}, {SQL_BN}, {SQL_PER}, cp AS (SELECT cb.*, period FROM cb JOIN per ON date BETWEEN lo AND hi), {sql_dd('cp', 'strategy, period')},
s AS (SELECT strategy, period, count(*) AS n, min(date) AS first, max(date) AS last, {CAGR} AS cagr, {SHARPE} AS sharpe, min(drawdown) AS max_dd,
 CASE WHEN product(1 + bench) <= 0 THEN -1 ELSE pow(product(1 + bench), 365.25e0 / greatest(max(CASE WHEN bench IS NOT NULL THEN date END) - min(CASE WHEN bench IS NOT NULL THEN date END), 1)) - 1 END AS bench_cagr FROM dd GROUP BY 1, 2 HAVING count(*) >= 40),
out AS (SELECT *, cagr - bench_cagr AS excess_cagr FROM s)""")
def a19(spark, d):
    return M.period_metrics(C.with_benchmark(curves(spark, d)), ID, C.PERIODS, bench="bench", min_rows=40)


@query("a20_period_split", "strategy:s pre_cagr:f pre_sharpe:f pre_max_dd:f post_cagr:f post_sharpe:f post_max_dd:f late_only:b", f"""{SQL_CURVES},
cp AS (SELECT *, 'pre' AS side FROM cv WHERE date <= DATE '1998-06-05' UNION ALL SELECT *, 'post' FROM cv WHERE date >= DATE '1998-06-05'), {sql_dd('cp', 'strategy, side')},
s AS (SELECT strategy, side, {CAGR} AS cagr, {SHARPE} AS sharpe, min(drawdown) AS max_dd FROM dd GROUP BY 1, 2 HAVING count(*) >= 60),
p AS (SELECT strategy, """ + ", ".join(f"max(CASE WHEN side = '{x}' THEN {c} END) AS {x}_{c}" for x in ("pre", "post") for c in ("cagr", "sharpe", "max_dd")) + """ FROM s GROUP BY 1),
out AS (SELECT *, coalesce(post_sharpe > 0.5 AND pre_sharpe <= 0, FALSE) AS late_only FROM p)""")
def a20(spark, d):
    return M.period_split(curves(spark, d), ID, "1998-06-05")


@query("a21_leave_one_year_out", "strategy:s years:i full:f min:f max:f worst_year_removed:i most_supportive_year:i range:f", f"""{SQL_CURVES}, ys AS (SELECT DISTINCT year(date) AS y FROM cv),
l AS (SELECT strategy, y, avg(ret) / stddev_samp(ret) * sqrt(252e0) AS s FROM cv JOIN ys ON year(date) <> y GROUP BY 1, 2),
f AS (SELECT strategy, {SHARPE} AS "full", count(DISTINCT year(date)) AS years FROM cv GROUP BY 1),
out AS (SELECT strategy, years, "full", min(s) AS "min", max(s) AS "max", arg_max(y, s) AS worst_year_removed, arg_min(y, s) AS most_supportive_year, max(s) - min(s) AS "range" FROM l JOIN f USING (strategy) WHERE years >= 4 GROUP BY ALL)""")
def a21(spark, d):
    return M.leave_one_year_out(curves(spark, d), ID)


PXD = f"{sql_panel('w')}, px AS (SELECT *, adj_close / nullif(lag(adj_close) OVER (PARTITION BY series_id ORDER BY date), 0) - 1 AS ret, coalesce(adj_close > {roll('avg', 'adj_close', 40)}, FALSE) AS up FROM panel), bnk AS (SELECT date, b / nullif(lag(b) OVER (ORDER BY date), 0) - 1 AS bret FROM (SELECT date, avg(adj_close) AS b FROM panel GROUP BY 1))"
TRAIL = lambda n: f"(SELECT CASE WHEN count(*) >= {n * 52} THEN pow(product(1 + ret), 1e0 / {n}) - 1 END FROM (SELECT ret FROM bh z WHERE z.series_id = s.series_id ORDER BY date DESC LIMIT {n * 52})) AS ret_{n}y"


@query("a24_company_analysis", "series_id:s first_data:d last_data:d bh_cagr:f bh_vol:f bh_sharpe:f bh_max_dd:f corr_bench:f ret_1y:f ret_3y:f ret_5y:f ret_10y:f overlay_cagr:f overlay_sharpe:f timing_adds_value:b", f"""{PXD},
bh0 AS (SELECT px.*, bret, lag(up) OVER (PARTITION BY series_id ORDER BY date) AS hold FROM px JOIN bnk USING (date)), bh AS (SELECT * FROM bh0 WHERE ret IS NOT NULL),
rows_ AS (SELECT series_id, min(date) AS first_data, max(date) AS last_data, count(*) AS n FROM panel WHERE adj_close IS NOT NULL GROUP BY 1 HAVING count(*) >= 104), {sql_dd('bh', 'series_id')},
m AS (SELECT series_id, {CAGR} AS bh_cagr, stddev_samp(ret) * sqrt(252e0) AS bh_vol, {SHARPE} AS bh_sharpe, min(drawdown) AS bh_max_dd, corr(ret, bret) AS corr_bench FROM dd GROUP BY 1),
ov AS (SELECT series_id, {CAGR} AS overlay_cagr, {SHARPE} AS overlay_sharpe FROM (SELECT series_id, date, CASE WHEN hold THEN ret ELSE 0 END AS ret FROM bh) GROUP BY 1),
s AS (SELECT * FROM rows_ JOIN m USING (series_id) JOIN ov USING (series_id)),
out AS (SELECT *, {TRAIL(1)}, {TRAIL(3)}, {TRAIL(5)}, {TRAIL(10)}, coalesce(overlay_sharpe > bh_sharpe AND overlay_cagr > 0, FALSE) AS timing_adds_value FROM s)""")
def a24(spark, d):
    from ..plans.company import company_analysis

    return company_analysis(T.market_panel(spark, d)[0], trend=40, min_rows=104, rows_per_year=52)


@query("a25_coverage_table", "series_id:s first:d last:d days:i delisted:b", f"{PXD}, out AS (SELECT series_id, min(date) AS first, max(date) AS last, count(*) AS days, CAST(substr(series_id, 7) AS INTEGER) % 5 = 0 AS delisted FROM panel WHERE adj_close IS NOT NULL GROUP BY 1)")
def a25(spark, d):
    b = T.bars(spark, d).groupBy("series_id").agg(F.min("date").alias("first"), F.max("date").alias("last"), F.count("*").alias("days"))
    return b.join(T.listing(spark, d).select("series_id", F.col("delisted").isNotNull().alias("delisted")), "series_id")


@query("b9_tax_overlay", "strategy:s years:i pre_tax_equity:f after_tax_equity:f taxes_paid:f pre_tax_cagr:f after_tax_cagr:f tax_drag:f", f"""{SQL_CURVES},
y AS (SELECT strategy, year(date) AS yr, product(1 + ret) - 1 AS r, sum(turnover) / 4 AS t FROM cv GROUP BY 1, 2), yn AS (SELECT *, row_number() OVER (PARTITION BY strategy ORDER BY yr) AS k FROM y),
f AS (SELECT strategy, 0 AS k, 1e0 AS eq, 0e0 AS carry, 0e0 AS tax, 1e0 AS pre FROM (SELECT DISTINCT strategy FROM yn) UNION ALL
 SELECT strategy, k, eq + eq * r - tx, carry + loss - off, tax + tx, pre * (1 + r) FROM (SELECT *, eq * 0.005e0 * 0.2e0 + CASE WHEN rl > 0 THEN (rl - off) * CASE WHEN t > 1 THEN 0.37e0 ELSE 0.2e0 END ELSE 0 END AS tx FROM (
 SELECT f.strategy, yn.k, eq, carry, tax, pre, r, t, eq * r * least(t, 1) AS rl, CASE WHEN eq * r * least(t, 1) > 0 THEN least(carry, eq * r * least(t, 1)) ELSE 0 END AS off,
 CASE WHEN eq * r * least(t, 1) < 0 THEN -(eq * r * least(t, 1)) ELSE 0 END AS loss FROM f JOIN yn ON yn.strategy = f.strategy AND yn.k = f.k + 1))),
e AS (SELECT strategy, max(k) AS years, arg_max(pre, k) AS pre_tax_equity, arg_max(eq, k) AS after_tax_equity, arg_max(tax, k) AS taxes_paid FROM f GROUP BY 1),
out AS (SELECT *, pow(greatest(pre_tax_equity, 1e-9), 1e0 / years) - 1 AS pre_tax_cagr, pow(greatest(after_tax_equity, 1e-9), 1e0 / years) - 1 AS after_tax_cagr,
 pow(greatest(pre_tax_equity, 1e-9), 1e0 / years) - pow(greatest(after_tax_equity, 1e-9), 1e0 / years) AS tax_drag FROM e)""")
def b9(spark, d):
    return B.tax_overlay(curves(spark, d).withColumn("turnover", F.col("turnover") / 4), ID)


@query("b9_tax_deferred", "strategy:s years:i pre_tax_equity:f after_tax_equity:f taxes_paid:f", f"""{SQL_CURVES}, y AS (SELECT strategy, product(1 + ret) AS g, count(DISTINCT year(date)) AS years FROM cv GROUP BY 1),
out AS (SELECT strategy, years, g AS pre_tax_equity, g - CASE WHEN g > 1 THEN (g - 1) * 0.2e0 ELSE 0 END AS after_tax_equity, CASE WHEN g > 1 THEN (g - 1) * 0.2e0 ELSE 0 END AS taxes_paid FROM y)""")
def b9d(spark, d):
    return B.tax_overlay(curves(spark, d), ID, deferred=True)


SQL_BLEND = """g AS (SELECT m.blend, m.strategy, wt, dts.date, coalesce(cv.ret, 0) AS ret FROM mem m JOIN (SELECT DISTINCT m2.blend, c2.date FROM mem m2 JOIN cv c2 USING (strategy)) dts ON dts.blend = m.blend LEFT JOIN cv ON cv.strategy = m.strategy AND cv.date = dts.date),
gg AS (SELECT blend, date, sum(wt * v) AS v FROM (SELECT *, exp(sum(ln(1 + ret)) OVER (PARTITION BY blend, strategy, date_trunc('month', date) ORDER BY date)) AS v FROM g) GROUP BY 1, 2),
bl AS (SELECT blend, date, v / coalesce(lag(v) OVER (PARTITION BY blend, date_trunc('month', date) ORDER BY date), 1) - 1 AS ret FROM gg)"""


@query("b10_blend", "blend:s date:d ret:f", f"{SQL_CURVES}, mem AS (SELECT family AS blend, strategy, (line + 1e0) / sum(line + 1e0) OVER (PARTITION BY family) AS wt FROM (SELECT DISTINCT family, strategy, line FROM cv)), {SQL_BLEND}, out AS (SELECT * FROM bl)")
def b10(spark, d):
    c = stored_curves(spark, d)
    mem = c.select(F.col("family").alias("blend"), "strategy", (F.col("line") + 1.0).alias("weight")).distinct()
    return B.blend(c, mem)


@query("b11_blend_report", "a:s b:s corr_monthly:f sharpe_a:f sharpe_b:f sharpe_blend:f blend_beats_both:b max_dd_blend:f cagr_blend:f", f"""{SQL_CURVES}, sh AS (SELECT strategy, cls, {SHARPE} AS s FROM cv GROUP BY 1, 2),
tp AS (SELECT * FROM (SELECT *, row_number() OVER (ORDER BY s DESC, strategy) AS rn FROM sh) WHERE rn <= 6),
pr AS (SELECT x.strategy || ' + ' || y.strategy AS blend, x.strategy AS a, y.strategy AS b, x.s AS sa, y.s AS sb FROM tp x JOIN tp y ON x.rn < y.rn AND x.cls <> y.cls),
mem AS (SELECT blend, unnest([a, b]) AS strategy, 0.5e0 AS wt FROM pr), {SQL_BLEND}, {SQL_MONTHLY}, {sql_dd('bl', 'blend')},
bs AS (SELECT blend, {SHARPE} AS s, {CAGR} AS c, min(drawdown) AS md FROM dd GROUP BY 1), cr AS (SELECT pr.blend, corr(x.ret, y.ret) AS c FROM pr JOIN mo x ON x.strategy = pr.a JOIN mo y ON y.strategy = pr.b AND y.period = x.period GROUP BY 1),
out AS (SELECT a, b, cr.c AS corr_monthly, sa AS sharpe_a, sb AS sharpe_b, bs.s AS sharpe_blend, bs.s > greatest(sa, sb) AS blend_beats_both, md AS max_dd_blend, bs.c AS cagr_blend FROM pr JOIN bs USING (blend) JOIN cr USING (blend))""")
def b11(spark, d):
    from ..plans.lab import blend_report

    return blend_report(stored_curves(spark, d), 6)
