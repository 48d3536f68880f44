"""Portfolio returns, turnover, costs and net curves (B1-B8) and the flagship study."""

from pyspark.sql import functions as F

from ..functions import stats as S
from ..operators import metrics as M
from ..operators import returns as B
from ..plans.signals import SIGNALS
from ..sources import tables as T
from .base import W, query, roll
from .panel import SQL_MACRO
from .signals import FB, MK, market, mom, topn

W5 = f"{MK}, {topn(mom(52, 4), 5, 'me').replace('out AS', 'w0 AS')}"
WN = f"""{MK}, t AS (SELECT series_id, date, {mom(26, 4)} AS mo, mask, me_stamp FROM px),
r AS (SELECT *, row_number() OVER (PARTITION BY date ORDER BY mo DESC, series_id) AS l, row_number() OVER (PARTITION BY date ORDER BY mo, series_id) AS s FROM t WHERE mask AND me_stamp AND mo IS NOT NULL),
b AS (SELECT *, l <= 5 AS lng, count(*) FILTER (WHERE l <= 5) OVER (PARTITION BY date) AS nl, count(*) FILTER (WHERE NOT l <= 5) OVER (PARTITION BY date) AS ns FROM r WHERE (l <= 5) <> (s <= 5)),
w0 AS (SELECT series_id, date, CASE WHEN lng THEN 0.5e0 / nl ELSE -0.5e0 / ns END AS w FROM b WHERE nl > 0 AND ns > 0)"""
EXEC = """ex AS (SELECT date, max(CASE WHEN me_stamp THEN date END) OVER (ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS d FROM cal)"""
GROSS = f"""{EXEC}, pr AS (SELECT ex.date, sum(w * ret) AS g, sum(w) AS net, sum(greatest(-w, 0)) AS short FROM ex JOIN w0 ON w0.date = ex.d JOIN px ON px.series_id = w0.series_id AND px.date = ex.date
 WHERE ret IS NOT NULL GROUP BY 1),
gr AS (SELECT c.date, coalesce(g, 0) AS gross, coalesce(net, 0) AS net_exposure, coalesce(short, 0) AS short_exposure FROM cal c LEFT JOIN pr USING (date) WHERE c.date >= (SELECT min(date) FROM w0))"""
TRADES = """stp AS (SELECT date, (SELECT min(c2.date) FROM cal c2 WHERE c2.date > c.date) AS trade_date FROM cal c WHERE me_stamp),
dn AS (SELECT s.series_id, stp.date, trade_date, coalesce(w0.w, 0) AS w FROM (SELECT DISTINCT series_id FROM w0) s CROSS JOIN stp LEFT JOIN w0 ON w0.series_id = s.series_id AND w0.date = stp.date),
tr AS (SELECT series_id, trade_date AS date, delta FROM (SELECT *, w - coalesce(lag(w) OVER (PARTITION BY series_id ORDER BY date), 0) AS delta FROM dn) WHERE abs(delta) >= 0.0015 AND trade_date IS NOT NULL)"""
SCEN = """scen AS (SELECT * FROM (VALUES ('zero', 0e0, 0e0, 0e0, 0e0, 0e0), ('low', 0e0, 1e0, 1e0, 5e0, 25e0), ('base', 0.5e0, 2.5e0, 2.5e0, 10e0, 50e0), ('stressed', 1e0, 7.5e0, 7.5e0, 25e0, 150e0)) v(scenario, com, spr, slp, imp, bor))"""


def sql_priced(capitals: list[float], part: str = "0.05") -> str:
    caps = ", ".join(f"({c!r}e0)" if "e" not in repr(c) else f"({c!r})" for c in capitals)
    value = f"CASE WHEN adv IS NOT NULL THEN least(abs(delta) * capital, {part} * adv) ELSE abs(delta) * capital END" if part else "abs(delta) * capital"
    return f"""{TRADES}, {SCEN}, lq AS (SELECT series_id, date, {roll('avg', 'dollar_volume', 21, 5, 1)} AS adv, adj_close IS NULL AS dead FROM panel),
pt0 AS (SELECT tr.series_id, tr.date, delta, capital, scen.*, adv, dead, {value} AS value FROM tr LEFT JOIN lq ON lq.series_id = tr.series_id AND lq.date = tr.date CROSS JOIN (VALUES {caps}) c(capital) CROSS JOIN scen),
pt AS (SELECT *, value * (com + spr + slp + CASE WHEN adv > 0 THEN imp * sqrt(least(value / adv, 1)) ELSE 0 END) / 1e4 * CASE WHEN dead THEN 2 ELSE 1 END AS cost FROM pt0)"""


def sql_net(capitals: list[float], rate: str = "0e0") -> str:
    return f"""{GROSS}, {sql_priced(capitals)}, cs AS (SELECT scenario, capital, date, sum(cost) / max(capital) AS cost, sum(value) / max(capital) AS turnover, count(*) AS n_trades FROM pt GROUP BY 1, 2, 3),
net AS (SELECT s.scenario, k.capital, gr.date, gross, coalesce(turnover, 0) AS turnover, coalesce(n_trades, 0) AS n_trades, coalesce(cost, 0) AS cost, short_exposure * bor / 1e4 / 252 AS borrow,
 (1 - net_exposure) * {rate} / 100 / 252 AS interest, gross - coalesce(cost, 0) - short_exposure * bor / 1e4 / 252 + (1 - net_exposure) * {rate} / 100 / 252 AS ret
 FROM gr CROSS JOIN scen s CROSS JOIN (SELECT DISTINCT capital FROM pt) k LEFT JOIN cs ON cs.scenario = s.scenario AND cs.capital = k.capital AND cs.date = gr.date{{join}})"""


def top5(spark, d):
    m = market(spark, d)
    return m, SIGNALS["simple_momentum"](m, lookback=52, skip=4)


@query("b1_execution_lag", "series_id:s date:d w:f", f"{W5}, {EXEC}, out AS (SELECT w0.series_id, ex.date, w FROM ex JOIN w0 ON w0.date = ex.d)")
def b1(spark, d):
    m, w = top5(spark, d)
    return B.held_weights(w, m.cal, "me", lagged=True)


@query("b2_portfolio_return", "date:d gross:f net_exposure:f short_exposure:f", f"{W5}, {GROSS}, out AS (SELECT * FROM gr)")
def b2(spark, d):
    m, w = top5(spark, d)
    return B.portfolio_returns(w, m.panel, m.cal, "me")


@query("b2_two_part_return", "date:d ret:f", f"""{W5}, {EXEC}, o AS (SELECT *, open * adj_close / nullif(close, 0) AS ao FROM px),
lg AS (SELECT series_id, date, ao / nullif(lag(adj_close) OVER (PARTITION BY series_id ORDER BY date), 0) - 1 AS night, adj_close / nullif(ao, 0) - 1 AS day FROM o),
e2 AS (SELECT date, d, lag(d) OVER (ORDER BY date) AS dold FROM ex),
u AS (SELECT e2.date, w * night AS c FROM e2 JOIN w0 ON w0.date = e2.dold JOIN lg ON lg.series_id = w0.series_id AND lg.date = e2.date WHERE night IS NOT NULL
 UNION ALL SELECT e2.date, w * day FROM e2 JOIN w0 ON w0.date = e2.d JOIN lg ON lg.series_id = w0.series_id AND lg.date = e2.date WHERE day IS NOT NULL),
out AS (SELECT date, sum(c) AS ret FROM u GROUP BY 1)""")
def b2t(spark, d):
    m, w = top5(spark, d)
    opens = T.bars(spark, d).select("series_id", "date", "open")
    return B.two_part_returns(w, m.panel.join(opens, ["series_id", "date"], "left"), m.cal, "me")


@query("b3_turnover", "date:d turnover:f n_trades:i", f"{W5}, {TRADES}, out AS (SELECT date, sum(abs(delta)) AS turnover, count(*) AS n_trades FROM tr GROUP BY 1)")
def b3(spark, d):
    m, w = top5(spark, d)
    return B.turnover(w, m.cal, "me")


@query("b4_one_way_cost", "series_id:s date:d scenario:s value:p cost:f", f"{W5}, {sql_priced([1e5], '')}, out AS (SELECT * FROM pt)")
def b4(spark, d):
    m, w = top5(spark, d)
    return B.priced_trades(w, m.panel, m.cal, "me", B.SCENARIOS, [1e5], None).withColumn("scenario", F.col("scen.name"))


@query("b6_participation_cap", "series_id:s date:d scenario:s value:p cost:f", f"{W5}, {sql_priced([1e6])}, out AS (SELECT * FROM pt)")
def b6(spark, d):
    m, w = top5(spark, d)
    return B.priced_trades(w, m.panel, m.cal, "me", B.SCENARIOS, [1e6]).withColumn("scenario", F.col("scen.name"))


RATE = f"{SQL_MACRO}, rt AS (SELECT c.date, last_value(m.value IGNORE NULLS) OVER (ORDER BY c.date ROWS UNBOUNDED PRECEDING) AS rate FROM cal c LEFT JOIN macro m ON m.date = c.date AND m.series = 'RATE')"


@query("b5_borrow_and_interest", "scenario:s date:d gross:f turnover:f n_trades:i cost:f borrow:f interest:f ret:f",
       f"{WN}, {RATE}, {sql_net([1e5], 'coalesce(rate, 0)').replace('{join}', ' LEFT JOIN rt ON rt.date = gr.date')}, out AS (SELECT * FROM net)")
def b5(spark, d):
    from ..operators.panel import calendar_align

    m = market(spark, d, "macro")
    w = SIGNALS["market_neutral_momentum"](m, lookback=26, skip=4, n=5)
    rate = calendar_align(m.macro.where("series = 'RATE'"), m.cal).select("date", F.col("value").alias("rate"))
    return B.net_curves(w, m.panel, m.cal, "me", capitals=[1e5], cash_rate=rate)


@query("b7_delisted_mark", "series_id:s date:d mark:p mark_ret:f stopped:b", f"""{MK}, m AS (SELECT *, last_value(adj_close IGNORE NULLS) {W(None)} AS mark FROM px),
out AS (SELECT series_id, date, mark, coalesce(mark / nullif(lag(mark) OVER (PARTITION BY series_id ORDER BY date), 0) - 1, 0) AS mark_ret, adj_close IS NULL AND mark IS NOT NULL AS stopped FROM m)""")
def b7(spark, d):
    return B.delisted_mark(market(spark, d).panel)


SHARPE = "CASE WHEN stddev_samp(ret) > 0 THEN avg(ret) / stddev_samp(ret) * sqrt(252e0) END"
CAGR = "CASE WHEN count(ret) < 2 THEN NULL WHEN product(1 + ret) <= 0 THEN -1 ELSE pow(product(1 + ret), 365.25e0 / greatest(max(date) - min(date), 1)) - 1 END"


@query("b8_capacity", "capital:f cagr:f sharpe:f zero_cagr:f cost_drag:f capacity:f", f"""{W5}, {sql_net([1e5, 1e6, 1e7, 1e8]).replace('{join}', '')},
bs AS (SELECT capital, {CAGR} AS cagr, {SHARPE} AS sharpe FROM net WHERE scenario = 'base' GROUP BY 1), z AS (SELECT capital, {CAGR} AS zero_cagr FROM net WHERE scenario = 'zero' GROUP BY 1),
out AS (SELECT bs.capital, cagr, sharpe, zero_cagr, zero_cagr - cagr AS cost_drag,
 (SELECT coalesce(max(capital), 1e5) FROM bs WHERE sharpe >= 0.8 * (SELECT sharpe FROM bs WHERE capital = 1e5)) AS capacity FROM bs JOIN z USING (capital))""")
def b8(spark, d):
    m, w = top5(spark, d)
    c = B.net_curves(w.withColumn("strategy", F.lit("momentum")), m.panel, m.cal, "me", capitals=[1e5, 1e6, 1e7, 1e8])
    return B.capacity(c, ["strategy"])


@query("study_momentum_net", "scenario:s n_days:i log_growth:f cagr:f ann_vol:f sharpe:f max_drawdown:f turnover:f costs:f", f"""{W5}, {sql_net([1e5]).replace('{join}', '')},
eq AS (SELECT *, exp(sum(ln(1 + ret)) OVER (PARTITION BY scenario ORDER BY date)) AS e FROM net), dd AS (SELECT *, e / max(e) OVER (PARTITION BY scenario ORDER BY date) - 1 AS drawdown FROM eq),
out AS (SELECT scenario, count(*) AS n_days, ln(product(1 + ret)) AS log_growth, {CAGR} AS cagr, stddev_samp(ret) * sqrt(252e0) AS ann_vol, {SHARPE} AS sharpe, min(drawdown) AS max_drawdown,
 avg(turnover) * 252 AS turnover, sum(cost) AS costs FROM dd GROUP BY 1)""")
def study(spark, d):
    m, w = top5(spark, d)
    c = M.drawdowns(B.net_curves(w, m.panel, m.cal, "me", capitals=[1e5]), ["scenario"])
    return c.groupBy("scenario").agg(F.count("*").alias("n_days"), F.ln(S.compound("ret")).alias("log_growth"), S.cagr("ret").alias("cagr"), S.ann_vol("ret").alias("ann_vol"),
                                     S.sharpe("ret").alias("sharpe"), M.max_drawdown().alias("max_drawdown"), (F.avg("turnover") * 252).alias("turnover"), F.sum("cost").alias("costs"))


@query("a22_contribution_shares", "top1_share:f top3_share:f top5_share:f named_share:f top_name:s top_name_share:f", f"""{W5}, {EXEC},
c AS (SELECT w0.series_id, sum(w * ret) AS c FROM ex JOIN w0 ON w0.date = ex.d JOIN px ON px.series_id = w0.series_id AND px.date = ex.date WHERE ret IS NOT NULL GROUP BY 1),
k AS (SELECT *, row_number() OVER (ORDER BY c DESC, series_id) AS rn, row_number() OVER (ORDER BY abs(c) DESC, series_id) AS ra FROM c),
out AS (SELECT sum(CASE WHEN rn <= 1 THEN c END) / sum(c) AS top1_share, sum(CASE WHEN rn <= 3 THEN c END) / sum(c) AS top3_share, sum(CASE WHEN rn <= 5 THEN c END) / sum(c) AS top5_share,
 sum(CASE WHEN series_id = 'Brand#3' THEN c END) / sum(c) AS named_share, max(CASE WHEN ra = 1 THEN series_id END) AS top_name, sum(CASE WHEN ra = 1 THEN c END) / sum(c) AS top_name_share FROM k)""")
def a22(spark, d):
    m, w = top5(spark, d)
    return M.contributions(w, m.panel, m.cal, "me", "Brand#3")
