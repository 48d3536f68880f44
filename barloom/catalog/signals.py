"""The signal library (G1-G53): weights on decision dates."""

from ..functions import rolling as R
from ..operators import panel as P
from ..plans import signals as S
from ..plans.signals import SIGNALS, Market
from ..sources import tables as T
from .base import SQL_CAL, W, lagx, query, roll, sql_panel
from .panel import SQL_MACRO, SQL_MEMBERS, masked_panel, sql_mask

FB, IX = "Brand#25", "Brand#1"
ROOT = "sqrt(252e0)"
MK = f"""{sql_panel('w')}, {sql_mask()},
px AS (SELECT p.*, m.mask, p.adj_close / nullif(lag(p.adj_close) OVER (PARTITION BY p.series_id ORDER BY p.date), 0) - 1 AS ret
 FROM panel p JOIN mask m ON m.series_id = p.series_id AND m.date = p.date),
ix AS (SELECT date, pos, adj_close AS ix, ret AS ix_ret FROM px WHERE series_id = '{IX}')"""
MB = f"{MK}, {SQL_MEMBERS}"
SQL_FUND = """fund AS (SELECT series_id, period_end, period_end + 40 + CAST(substr(series_id, 7) AS INTEGER) % 21 AS published, revenue, fcf, shares,
 revenue * 4 AS assets, fcf * 2 - rnd * 1.5e0 AS net_income, rnd, revenue - rnd * 6 AS gross_profit FROM (
 SELECT series_id, CAST(last_day(date_trunc('quarter', l_shipdate) + INTERVAL 2 MONTH) AS DATE) AS period_end, sum(l_extendedprice) AS revenue,
 sum(l_extendedprice * l_discount) AS fcf, sum(l_quantity) AS shares, sum(l_extendedprice * l_tax) AS rnd FROM lines GROUP BY 1, 2))"""


def sql_trailing(*roots: str) -> str:
    o = "OVER (PARTITION BY series_id ORDER BY period_end)"
    a = ", ".join(f"{roll('sum', r, 4, order='period_end')} AS {r}_ttm" for r in roots)
    b = ", ".join(f"{r}_ttm / nullif(lag({r}_ttm, 4) {o}, 0) - 1 AS {r}_yoy" for r in roots)
    c = ", ".join(f"{r}_yoy - lag({r}_yoy) {o} AS {r}_accel" for r in roots)
    return f"f1 AS (SELECT *, {a} FROM fund), f2 AS (SELECT *, {b} FROM f1), filed AS (SELECT *, {c} FROM f2)"


def sql_asof(fields: list[str], src: str = "px", out: str = "pf", op: str = ">=") -> str:
    joins = " ".join(f"ASOF LEFT JOIN (SELECT series_id, published, {f} FROM filed WHERE {f} IS NOT NULL) j{i} ON j{i}.series_id = p.series_id AND p.date {op} j{i}.published"
                     for i, f in enumerate(fields))
    cols = ", ".join(f"j{i}.{f}" for i, f in enumerate(fields))
    return f"{out} AS (SELECT p.*, {cols} FROM {src} p {joins})"


MF = f"{MK}, {SQL_FUND}"


def topn(score: str, n: int, stamp: str, cond: str = "TRUE", order: str = "DESC", src: str = "px", mask: str = "mask") -> str:
    return f"""sel AS (SELECT series_id, date, row_number() OVER (PARTITION BY date ORDER BY score {order}, series_id) AS rn
 FROM (SELECT *, {score} AS score FROM {src}) WHERE {mask} AND {stamp}_stamp AND score IS NOT NULL AND {cond}),
out AS (SELECT series_id, date, 1e0 / count(*) OVER (PARTITION BY date) AS w FROM sel WHERE rn <= {n})"""


def fallback(src: str, stamp: str) -> str:
    return f"""out AS (SELECT series_id, date, w FROM {src} WHERE w <> 0 UNION ALL
 SELECT '{FB}', c.date, greatest(1 - coalesce(u.s, 0), 0) FROM cal c JOIN px q ON q.series_id = '{FB}' AND q.date = c.date AND q.adj_close IS NOT NULL
 LEFT JOIN (SELECT date, sum(w) AS s FROM {src} GROUP BY 1) u ON u.date = c.date WHERE c.{stamp}_stamp AND greatest(1 - coalesce(u.s, 0), 0) > 1e-12)"""


def mom(lb: int, skip: int, x: str = "adj_close") -> str:
    a = lagx(x, skip) if skip else x
    return f"({a} / nullif({lagx(x, lb)}, 0) - 1)"


def latch(entry: str, leave: str, initial: str = "FALSE", part: str = "series_id") -> str:
    return f"coalesce(last_value(CASE WHEN {entry} THEN TRUE WHEN {leave} THEN FALSE END IGNORE NULLS) OVER (PARTITION BY {part} ORDER BY date ROWS UNBOUNDED PRECEDING), {initial})"


def sma(n: int, x: str = "adj_close") -> str:
    return f"({roll('avg', x, n)})"


def equal(src: str, stamp: str, cond: str = "TRUE", name: str = "out") -> str:
    return f"{name} AS (SELECT series_id, date, 1e0 / count(*) OVER (PARTITION BY date) AS w FROM {src} WHERE mask AND {stamp}_stamp AND {cond})"


# Signals that read the panel once; every other plan starts from the stored panel.
SINGLE_PASS = {
    "buy_and_hold", "equal_weight_universe", "cap_weight_universe", "dollar_volume_weight", "simple_momentum", "xs_momentum", "risk_adjusted_momentum", "rsi_reversion", "short_term_reversal", "bollinger_reversion",
    "squeeze_breakout", "quality_growth", "valuation_aware_growth", "fundamental_acceleration", "gross_profitability", "post_filing_drift", "research_intensity", "accrual_quality", "inverse_vol_basket",
    "multi_horizon_momentum", "low_volatility", "market_neutral_momentum", "gaussian_bands", "gaussian_hold", "supertrend", "adx_strength", "atr_trailing_stop", "high_proximity", "quiet_trend", "volume_breakout",
    "turn_of_month", "short_squeeze", "golden_cross",
}


def market(spark, d, *extra: str, stored: bool = True) -> Market:
    panel, cal = masked_panel(spark, d, stored=stored)
    m = Market(panel, cal, fallback=FB, index=IX)
    makers = {"members": T.members, "macro": T.macro, "filings": T.fundamentals, "short": T.short_volume}
    for e in extra:
        setattr(m, e, makers[e](spark, d))
    return m


def sig(key: str, name: str, sql: str | None, needs: tuple = (), **params):
    @query(key, "series_id:s date:d w:f", sql)
    def run(spark, d):
        return SIGNALS[name](market(spark, d, *needs, stored=name not in SINGLE_PASS), **params)


sig("g1_buy_and_hold", "buy_and_hold", f"{MK}, out AS (SELECT series_id, date, 1e0 AS w FROM px WHERE series_id = 'Brand#3' AND adj_close IS NOT NULL)", series="Brand#3")
sig("g2_equal_weight", "equal_weight_universe", f"{MK}, {equal('px', 'me')}")
sig("g2_equal_weight_basket", "equal_weight_universe", f"{MB}, {equal('px', 'qe', cond='series_id IN (SELECT series_id FROM members WHERE basket = $$T2$$)')}".replace("$$", "'"), ("members",), freq="qe", basket="T2")


def sql_cap(src: str, cap: float) -> str:
    """Iterative capping, 25 rounds of clip and pro-rata redistribution, as an independent twin of the closed form."""
    return f"""it AS (SELECT 0 AS k, series_id, date, w FROM {src} UNION ALL
 SELECT k + 1, series_id, date, CASE WHEN c > 0 THEN v + (CASE WHEN v > 1e-12 AND v < {cap}e0 - 1e-12 AND room > 1e-12 THEN v / room * c ELSE 0 END) ELSE v END
 FROM (SELECT *, sum(CASE WHEN v > 1e-12 AND v < {cap}e0 - 1e-12 THEN v ELSE 0 END) OVER (PARTITION BY date) AS room FROM (
  SELECT k, series_id, date, least(w, {cap}e0) AS v, sum(CASE WHEN w > {cap}e0 + 1e-12 THEN w - {cap}e0 ELSE 0 END) OVER (PARTITION BY date) AS c FROM it WHERE k < 25))),
out AS (SELECT series_id, date, least(w, {cap}e0) AS w FROM it WHERE k = 25)"""


sig("g3_cap_weight", "cap_weight_universe", f"""{MF}, {sql_trailing('revenue')}, {sql_asof(['shares'])},
c AS (SELECT series_id, date, close * shares AS size FROM pf WHERE mask AND qe_stamp AND close * shares > 0),
w0 AS (SELECT series_id, date, size / sum(size) OVER (PARTITION BY date) AS w FROM c), {sql_cap('w0', 0.05)}""", ("filings",), cap=0.05)
sig("g3_dollar_volume_weight", "dollar_volume_weight", f"""{MK}, c0 AS (SELECT *, {sma(13, 'dollar_volume')} AS size FROM px),
c AS (SELECT series_id, date, size FROM c0 WHERE mask AND qe_stamp AND size > 0),
w0 AS (SELECT series_id, date, size / sum(size) OVER (PARTITION BY date) AS w FROM c), {sql_cap('w0', 0.05)}""", cap=0.05)
sig("g4_index_moving_average", "index_moving_average", f"""{MK}, t AS (SELECT date, ix, coalesce(ix > {roll('avg', 'ix', 40, part='1')}, FALSE) AS up FROM ix),
out AS (SELECT '{IX}' AS series_id, date, 1e0 AS w FROM t WHERE ix IS NOT NULL AND up UNION ALL
 SELECT '{FB}', t.date, 1e0 FROM t JOIN px ON px.series_id = '{FB}' AND px.date = t.date WHERE ix IS NOT NULL AND NOT up AND px.adj_close IS NOT NULL)""", window=40)
sig("g5_simple_momentum", "simple_momentum", f"{MK}, {topn(mom(52, 4), 5, 'me')}", lookback=52, skip=4)
sig("g6_trend_follow_cash", "trend_follow_cash", f"""{MK}, t AS (SELECT *, coalesce(adj_close > {sma(40)}, FALSE) AS up FROM px WHERE series_id <> '{FB}'),
w0 AS (SELECT series_id, date, CASE WHEN up THEN 1e0 ELSE 0e0 END / count(*) OVER (PARTITION BY date) AS w FROM t WHERE mask AND wf_stamp), {fallback('w0', 'wf')}""", window=40)
sig("g7_absolute_momentum", "absolute_momentum", f"""{MK}, {SQL_MACRO},
rt AS (SELECT c.date, last_value(m.value IGNORE NULLS) OVER (ORDER BY c.date ROWS UNBOUNDED PRECEDING) AS rate FROM cal c LEFT JOIN macro m ON m.date = c.date AND m.series = 'RATE'),
t AS (SELECT px.*, {mom(52, 0)} AS mo FROM px WHERE series_id <> '{FB}'),
u AS (SELECT t.* FROM t JOIN rt USING (date) WHERE mo > pow(1 + rate / 100, 52e0 / 52) - 1), {equal('u', 'me', name='w0')}, {fallback('w0', 'me')}""",
    ("macro",), lookback=52, per_year=52)
CH = ["Brand#1", "Brand#2", "Brand#3", "Brand#4"]
sig("g8_dual_momentum", "dual_momentum", f"""{MK}, t AS (SELECT *, {mom(26, 0)} AS mo FROM px WHERE series_id IN ('Brand#1', 'Brand#2', 'Brand#3', 'Brand#4')),
b AS (SELECT *, row_number() OVER (PARTITION BY date ORDER BY mo DESC, series_id) AS rn FROM t WHERE me_stamp AND mo IS NOT NULL),
out AS (SELECT series_id, date, 1e0 AS w FROM b WHERE rn = 1 AND mo > 0 UNION ALL SELECT '{FB}', b.date, 1e0 FROM b JOIN px q ON q.series_id = '{FB}' AND q.date = b.date
 AND q.adj_close IS NOT NULL WHERE rn = 1 AND mo <= 0)""", choices=CH, lookback=26)
sig("g9_xs_momentum", "xs_momentum", f"{MK}, {topn(mom(26, 4), 5, 'me', 'score > 0')}", lookback=26, skip=4)
VOL13 = f"(({roll('stddev_samp', 'ret', 13)}) * {ROOT})"
SEL9 = f"""t AS (SELECT *, {mom(26, 4)} AS mo, {VOL13} AS vol FROM px),
s AS (SELECT *, row_number() OVER (PARTITION BY date ORDER BY mo DESC, series_id) AS rn FROM t WHERE mask AND me_stamp AND mo > 0)"""
sig("g9_xs_momentum_inverse_vol", "xs_momentum", f"""{MK}, {SEL9},
out AS (SELECT series_id, date, (1 / nullif(vol, 0)) / sum(1 / nullif(vol, 0)) OVER (PARTITION BY date) AS w FROM s WHERE rn <= 5 AND vol > 0)""",
    lookback=26, skip=4, weighting="inverse_vol")
sig("g9_xs_momentum_score", "xs_momentum", f"{MK}, {SEL9}, out AS (SELECT series_id, date, mo / sum(mo) OVER (PARTITION BY date) AS w FROM s WHERE rn <= 5)",
    lookback=26, skip=4, weighting="momentum")
sig("g10_risk_adjusted_momentum", "risk_adjusted_momentum", f"{MK}, {topn(mom(26, 4) + ' / nullif((' + roll('stddev_samp', 'ret', 26) + ') * ' + ROOT + ', 0)', 5, 'me', 'score > 0')}", lookback=26, skip=4)
sig("g11_relative_strength", "relative_strength", f"""{MK}, i2 AS (SELECT date, ix / nullif(lag(ix, 26) OVER (ORDER BY date), 0) - 1 AS im FROM ix),
t AS (SELECT *, {mom(26, 0)} AS mo FROM px), u AS (SELECT t.*, mo - im AS rel FROM t JOIN i2 USING (date)), {topn('rel', 8, 'me', 'score > 0', src='u')}""", lookback=26)
UP40 = f"coalesce(adj_close > {sma(40)}, FALSE)"
DIFF = f"df AS (SELECT *, adj_close - {lagx('adj_close')} AS diff FROM px)"
RSI3 = f"(100 - 100 / (1 + ({roll('avg', '(CASE WHEN diff IS NOT NULL THEN greatest(diff, 0e0) END)', 3)}) / nullif({roll('avg', '(CASE WHEN diff IS NOT NULL THEN greatest(-diff, 0e0) END)', 3)}, 0)))"
sig("g12_rsi_reversion", "rsi_reversion", f"""{MK}, {DIFF}, t AS (SELECT *, {RSI3} AS rsi, {UP40} AS up FROM df),
h AS (SELECT *, {latch('coalesce(rsi < 30, FALSE) AND up AND mask', 'coalesce(rsi > 60, FALSE) OR NOT up')} AS held FROM t),
s AS (SELECT *, row_number() OVER (PARTITION BY date ORDER BY rsi, series_id) AS rn FROM h WHERE held AND rsi IS NOT NULL),
out AS (SELECT series_id, date, 1e0 / count(*) OVER (PARTITION BY date) AS w FROM s WHERE rn <= 5)""", window=3, entry=30.0, exit=60.0, trend=40)
sig("g13_short_term_reversal", "short_term_reversal", f"{MK}, t AS (SELECT *, {UP40} AS up, -{mom(5, 0)} AS rev FROM px), {topn('rev', 5, 'wf', 'up', src='t')}", window=5)
sig("g14_bollinger_reversion", "bollinger_reversion", f"""{MK}, t AS (SELECT *, (adj_close - {sma(10)}) / nullif({roll('stddev_samp', 'adj_close', 10)}, 0) AS z, {UP40} AS up FROM px),
h AS (SELECT *, {latch('coalesce(z < -0.5, FALSE) AND up AND mask', 'coalesce(z > 0.3, FALSE) OR NOT up')} AS held FROM t),
s AS (SELECT *, row_number() OVER (PARTITION BY date ORDER BY z, series_id) AS rn FROM h WHERE held AND z IS NOT NULL),
out AS (SELECT series_id, date, 1e0 / count(*) OVER (PARTITION BY date) AS w FROM s WHERE rn <= 5)""", window=10, entry_z=-0.5, exit_z=0.3, trend=40)
HILO = lambda a, b: f"{roll('max', 'adj_close', a, None, 1)} AS hi, {roll('min', 'adj_close', b, None, 1)} AS lo"
SEL_STRENGTH = """s AS (SELECT *, row_number() OVER (PARTITION BY date ORDER BY adj_close / nullif(hi, 0) - 1 DESC, series_id) AS rn FROM h WHERE held AND adj_close / nullif(hi, 0) IS NOT NULL),
out AS (SELECT series_id, date, 1e0 / count(*) OVER (PARTITION BY date) AS w FROM s WHERE rn <= 6)"""
sig("g15_donchian_breakout", "donchian_breakout", f"""{MK}, i2 AS (SELECT date, coalesce(ix > {roll('avg', 'ix', 40, part='1')}, FALSE) AS ron FROM ix),
t AS (SELECT *, {HILO(11, 4)} FROM px), t2 AS (SELECT t.*, ron FROM t JOIN i2 USING (date)),
h AS (SELECT *, {latch('coalesce(adj_close > hi, FALSE) AND mask AND ron', 'coalesce(adj_close < lo, FALSE)')} AS held FROM t2), {SEL_STRENGTH}""", entry_window=11, exit_window=4)


def pct_rank(x: str, n: int, minp: int) -> str:
    lst = f"list({x}) FILTER (WHERE {x} IS NOT NULL) {W(n)}"
    return f"CASE WHEN {x} IS NOT NULL AND count({x}) {W(n)} >= {minp} THEN (len(list_filter({lst}, lambda v: v < {x})) + (len(list_filter({lst}, lambda v: v = {x})) + 1) / 2e0) / count({x}) {W(n)} END"


sig("g16_squeeze_breakout", "squeeze_breakout", f"""{MK}, v AS (SELECT *, ({roll('stddev_samp', 'ret', 5)}) * {ROOT} AS vol, {HILO(8, 4)} FROM px),
v2 AS (SELECT *, {pct_rank('vol', 40, 40)} AS vr FROM v), v3 AS (SELECT *, coalesce({lagx('vr < 0.4')}, FALSE) AS sq FROM v2),
h AS (SELECT *, {latch('coalesce(adj_close > hi, FALSE) AND sq AND mask', 'coalesce(adj_close < lo, FALSE)')} AS held FROM v3), {SEL_STRENGTH}""",
    entry_window=8, exit_window=4, squeeze=0.4, vol_window=5, rank_window=40)
Z = lambda x: f"(({x} - avg({x}) OVER (PARTITION BY date)) / nullif(stddev_samp({x}) OVER (PARTITION BY date), 0))"
sig("g17_quality_growth", "quality_growth", f"""{MF}, {sql_trailing('revenue', 'fcf')}, {sql_asof(['revenue_yoy', 'revenue_accel', 'revenue_ttm', 'fcf_ttm'])},
t AS (SELECT *, fcf_ttm / nullif(revenue_ttm, 0) AS margin FROM pf WHERE mask AND qe_stamp),
u AS (SELECT *, 0.4e0 * {Z('revenue_yoy')} + 0.3e0 * {Z('revenue_accel')} + 0.3e0 * {Z('margin')} AS z FROM t), {topn('z', 8, 'qe', src='u')}""", ("filings",))
sig("g18_valuation_aware_growth", "valuation_aware_growth", f"""{MF}, {sql_trailing('revenue', 'fcf')}, {sql_asof(['revenue_yoy', 'revenue_ttm', 'fcf_ttm', 'shares'])},
t0 AS (SELECT *, close * shares / nullif(revenue_ttm, 0) AS ps, fcf_ttm / nullif(revenue_ttm, 0) AS margin FROM pf),
t1 AS (SELECT *, {pct_rank('ps', 104, 40)} AS pp FROM t0), t AS (SELECT *, {Z('revenue_yoy')} + 0.5e0 * {Z('margin')} AS z FROM t1 WHERE mask AND qe_stamp),
{topn('z', 8, 'qe', 'pp < 0.85', src='t')}""", ("filings",), history=104, min_history=40)
IXT = f"ixt AS (SELECT date, coalesce(ix > {roll('avg', 'ix', 40, part='1')}, FALSE) AS up, ix / nullif(lag(ix, 13) OVER (ORDER BY date), 0) - 1 AS ic FROM ix)"
MACD = f"""mac AS (SELECT c.date, last_value(r.value IGNORE NULLS) OVER (ORDER BY c.date ROWS UNBOUNDED PRECEDING) AS rate, last_value(l.value IGNORE NULLS) OVER (ORDER BY c.date ROWS UNBOUNDED PRECEDING) AS level
 FROM cal c LEFT JOIN macro r ON r.date = c.date AND r.series = 'RATE' LEFT JOIN macro l ON l.date = c.date AND l.series = 'LEVEL'),
mf AS (SELECT date, coalesce(rate - lag(rate, 13) OVER (ORDER BY date) > 0.05, FALSE) AS rising, coalesce(level > 250000, FALSE) AS high, coalesce(rate < 0, FALSE) AS neg,
 coalesce(level > 1.25 * ({roll('median', 'level', 40, part='1')}), FALSE) AS stress FROM mac)"""
BRD = f"br AS (SELECT date, avg(CASE WHEN up THEN 1e0 ELSE 0e0 END) AS breadth FROM (SELECT *, {UP40} AS up FROM px) WHERE adj_close IS NOT NULL GROUP BY 1)"
sig("g19_regime_switched", "regime_switched", f"""{MK}, {SQL_MACRO}, {IXT}, {MACD}, {BRD},
ex AS (SELECT c.date, least(greatest(1 - 0.25e0 * ((CASE WHEN up THEN 0 ELSE 1 END) + (CASE WHEN high THEN 1 ELSE 0 END) + (CASE WHEN rising THEN 1 ELSE 0 END)
 + (CASE WHEN coalesce(breadth < 0.4, FALSE) THEN 1 ELSE 0 END)), 0e0), 1e0) AS e FROM cal c LEFT JOIN ixt USING (date) LEFT JOIN mf USING (date) LEFT JOIN br USING (date)),
{equal('px', 'wf', f"series_id <> '{FB}'", 'w0')},
out AS (SELECT series_id, date, w * e AS w FROM w0 JOIN ex USING (date) WHERE w * e <> 0 UNION ALL
 SELECT series_id, date, 1 - e FROM px JOIN ex USING (date) WHERE series_id = '{FB}' AND adj_close IS NOT NULL AND wf_stamp AND 1 - e <> 0)""", ("macro",), high=250000.0)
sig("g20_leadership_switch", "leadership_switch", f"""{MK}, i2 AS (SELECT date, coalesce(ix > {roll('avg', 'ix', 40, part='1')}, FALSE) AS up, ix / nullif(lag(ix, 26) OVER (ORDER BY date), 0) - 1 AS im FROM ix),
l2 AS (SELECT date, me_stamp, {mom(26, 0)} AS lm FROM px WHERE series_id = 'Brand#2'),
t AS (SELECT i2.date, CASE WHEN up AND lm - im > 0 THEN 'Brand#2' WHEN up AND lm - im <= 0 THEN '{IX}' WHEN NOT up AND q.adj_close IS NOT NULL THEN '{FB}' END AS series_id
 FROM i2 JOIN l2 USING (date) JOIN px q ON q.date = i2.date AND q.series_id = '{FB}' WHERE l2.me_stamp),
out AS (SELECT series_id, date, 1e0 AS w FROM t WHERE series_id IS NOT NULL)""", leader="Brand#2", lookback=26, trend=40)


def basket_cond(b: str) -> str:
    return f"series_id IN (SELECT series_id FROM members WHERE basket = '{b}')"


def own_return(w: str = "w0", out: str = "own") -> str:
    """Lagged return of daily weights, zero on idle dates."""
    return f"""hw AS (SELECT c.date, x.series_id, x.w FROM cal c JOIN {w} x ON x.date = c.prev_date),
{out} AS (SELECT c.date, coalesce(sum(hw.w * px.ret), 0) AS g FROM cal c LEFT JOIN hw ON hw.date = c.date LEFT JOIN px ON px.series_id = hw.series_id AND px.date = hw.date GROUP BY 1)"""


BT1 = f"{MB}, {equal('px', 'day', basket_cond('T1'), 'w0')}, {own_return()}"
VT = f"sc AS (SELECT date, coalesce(least(0.9e0 / nullif(({roll('stddev_samp', 'g', 13, part='1')}) * {ROOT}, 0), 1e0), 1e0) AS s FROM own)"
sig("g21_vol_targeted_basket", "vol_targeted_basket", f"{BT1}, {VT}, w1 AS (SELECT series_id, date, w * s AS w FROM w0 JOIN sc USING (date)), {fallback('w1', 'wf')}", ("members",), basket="T1", target=0.9, window=13)
GATE = f"""gt AS (SELECT date, CASE WHEN s IS NULL OR {latch('ix > s * 1.02', 'ix < s * 0.98', 'TRUE', '1')} THEN 1e0 ELSE 0.2e0 END AS e FROM (SELECT *, {roll('avg', 'ix', 40, part='1')} AS s FROM ix))"""
sig("g22_trend_plus_vol_target", "trend_plus_vol_target", f"{BT1}, {VT}, {GATE}, w1 AS (SELECT series_id, date, w * s * e AS w FROM w0 JOIN sc USING (date) JOIN gt USING (date)), {fallback('w1', 'wf')}",
    ("members",), basket="T1", target=0.9, window=13, trend=40)
sig("g23_drawdown_derisk", "drawdown_derisk", f"""{BT1}, eq AS (SELECT date, exp(sum(ln(1 + g)) OVER (ORDER BY date)) AS e FROM own), dd AS (SELECT date, e / max(e) OVER (ORDER BY date) - 1 AS d FROM eq),
ex AS (SELECT date, least(greatest((d + 0.3e0) / 0.2e0, 0e0), 1e0) AS e FROM dd),
out AS (SELECT series_id, date, w * e AS w FROM w0 JOIN ex USING (date) WHERE w * e <> 0 UNION ALL
 SELECT series_id, date, 1 - e FROM px JOIN ex USING (date) WHERE series_id = '{FB}' AND adj_close IS NOT NULL AND 1 - e <> 0)""", ("members",), basket="T1")
sig("g24_inverse_vol_basket", "inverse_vol_basket", f"""{MB}, t AS (SELECT *, {VOL13} AS vol FROM px WHERE {basket_cond('T1')}),
out AS (SELECT series_id, date, (1 / vol) / sum(1 / vol) OVER (PARTITION BY date) AS w FROM t WHERE mask AND me_stamp AND vol > 0)""", ("members",), basket="T1", window=13)
BETA = lambda n, minp: f"((CASE WHEN count(ret * ix_ret) {W(n)} >= {minp} THEN covar_samp(ret, ix_ret) {W(n)} END) / nullif({roll('var_samp', 'ix_ret', n, minp)}, 0))"
sig("g26_residual_momentum", "residual_momentum", f"""{MK}, t0 AS (SELECT px.*, ix_ret FROM px JOIN ix USING (date) WHERE series_id <> '{IX}'), t1 AS (SELECT *, ret - {BETA(52, 52)} * ix_ret AS resid FROM t0),
t AS (SELECT *, ({roll('sum', 'resid', 22, None, 4)}) / nullif({roll('stddev_samp', 'resid', 26)}, 0) AS sc FROM t1), {topn('sc', 8, 'me', 'score > 0', src='t')}""", lookback=26, skip=4, beta_window=52)
MH = f"""t0 AS (SELECT *, {mom(13, 4)} AS a, {mom(26, 4)} AS b, {mom(52, 4)} AS c, {VOL13} AS vol FROM px),
t AS (SELECT *, {Z('a')} + {Z('b')} + {Z('c')} AS z FROM t0 WHERE mask AND me_stamp)"""
sig("g27_multi_horizon_momentum", "multi_horizon_momentum", f"{MK}, {MH}, {topn('z', 8, 'me', 'a > 0 AND b > 0 AND c > 0', src='t')}", horizons=(13, 26, 52), skip=4)
sig("g28_low_volatility", "low_volatility", f"{MK}, t AS (SELECT *, {UP40} AS up, ({roll('stddev_samp', 'ret', 26)}) * {ROOT} AS vol FROM px), {topn('vol', 12, 'me', 'up', 'ASC', 't')}", window=26, trend=40)
sig("g29_breadth_gated", "breadth_gated_basket", f"""{MB}, {BRD}, {equal('px', 'wf', basket_cond('T1'), 'w0')},
b2 AS (SELECT c.date, CASE WHEN breadth IS NULL OR avg(breadth) OVER (ORDER BY date ROWS 3 PRECEDING) >= 0.45 THEN 1e0 ELSE 0e0 END AS e FROM cal c LEFT JOIN br USING (date)),
w1 AS (SELECT series_id, date, w * e AS w FROM w0 JOIN b2 USING (date)), {fallback('w1', 'wf')}""", ("members",), basket="T1", window=40)
THEME = f"""tb AS (SELECT basket, date, avg(CASE WHEN mask THEN ret END) AS r FROM px JOIN members USING (series_id) WHERE basket LIKE 'U%' GROUP BY 1, 2),
tl AS (SELECT basket, date, exp(sum(ln(1 + coalesce(r, 0))) OVER (PARTITION BY basket ORDER BY date)) AS level FROM tb)"""
sig("g30_theme_rotation", "theme_rotation", f"""{MB}, {THEME}, tm AS (SELECT *, {mom(26, 4, 'level').replace('series_id', 'basket')} AS mo FROM tl),
ts AS (SELECT t.basket, t.date, row_number() OVER (PARTITION BY t.date ORDER BY mo DESC, basket) AS rn FROM tm t JOIN cal USING (date) WHERE me_stamp AND mo > 0),
th AS (SELECT *, 1e0 / count(*) OVER (PARTITION BY date) AS share FROM ts WHERE rn <= 2),
inn AS (SELECT series_id, date, basket, 1e0 / count(*) OVER (PARTITION BY basket, date) AS w FROM px JOIN members USING (series_id) WHERE mask AND me_stamp AND basket LIKE 'U%'),
out AS (SELECT series_id, date, sum(w * share) AS w FROM inn JOIN th USING (basket, date) GROUP BY 1, 2)""", ("members",), themes=["U0", "U1", "U2", "U3"], lookback=26, skip=4, top=2)
sig("g31_fundamental_acceleration", "fundamental_acceleration", f"{MF}, {sql_trailing('revenue')}, {sql_asof(['revenue_yoy', 'revenue_accel'])}, {topn('revenue_accel', 8, 'qe', 'revenue_yoy > 0 AND score > 0', src='pf')}", ("filings",))
sig("g34_market_neutral_momentum", "market_neutral_momentum", f"""{MK}, t AS (SELECT series_id, date, {mom(26, 4)} AS mo, mask, me_stamp FROM px),
r AS (SELECT *, row_number() OVER (PARTITION BY date ORDER BY mo DESC, series_id) AS l, row_number() OVER (PARTITION BY date ORDER BY mo, series_id) AS s FROM t WHERE mask AND me_stamp AND mo IS NOT NULL),
b AS (SELECT *, l <= 10 AS lng, count(*) FILTER (WHERE l <= 10) OVER (PARTITION BY date) AS nl, count(*) FILTER (WHERE NOT l <= 10) OVER (PARTITION BY date) AS ns FROM r WHERE (l <= 10) <> (s <= 10)),
out AS (SELECT series_id, date, CASE WHEN lng THEN 0.5e0 / nl ELSE -0.5e0 / ns END AS w FROM b WHERE nl > 0 AND ns > 0)""", lookback=26, skip=4)
HEDGE = lambda book, e, minp: f"""hb AS (SELECT o.date, {book} AS b, ix_ret, {e} AS e FROM {{src}} o JOIN ix USING (date)),
hc AS (SELECT date, e, (CASE WHEN count(b * ix_ret) {W(26, part='1')} >= {minp} THEN covar_samp(b, ix_ret) {W(26, part='1')} END) / nullif({roll('var_samp', 'ix_ret', 26, minp, part='1')}, 0) AS beta FROM hb),
leg AS (SELECT '{IX}' AS series_id, date, -least(greatest(beta, 0e0), 1.5e0) * e AS w FROM hc WHERE beta > 0 AND e <> 0)"""  # noqa: E731
sig("g35_beta_hedged_basket", "beta_hedged_basket", f"{MB}, {equal('px', 'wf', basket_cond('T0'), 'w0')}, {own_return()}, {HEDGE('g', '1e0', 26).format(src='own')}, out AS (SELECT * FROM w0 UNION ALL SELECT * FROM leg)",
    ("members",), basket="T0", window=26)
sig("g36_gross_profitability", "gross_profitability", f"{MF}, {sql_trailing('gross_profit')}, {sql_asof(['gross_profit_ttm', 'assets'])}, {topn('gross_profit_ttm / nullif(assets, 0)', 12, 'qe', 'score > 0', src='pf')}", ("filings",))
sig("g37_post_filing_drift", "post_filing_drift", f"""{MF}, {sql_trailing('revenue')}, {sql_asof(['revenue_yoy'])}, t AS (SELECT *, revenue_yoy - {lagx('revenue_yoy')} AS step FROM pf),
u AS (SELECT *, last_value(CASE WHEN abs(step) > 1e-12 THEN step END IGNORE NULLS) {W(8)} AS sc FROM t), {topn('sc', 10, 'wf', 'score > 0', src='u')}""", ("filings",), hold=8)
sig("g38_dispersion_timed", "dispersion_timed", f"""{MK}, t AS (SELECT *, {roll('stddev_samp', '(CASE WHEN mask THEN ret END)', 13)} AS sd, {mom(26, 4)} AS mo FROM px), dp AS (SELECT date, stddev_samp(sd) AS d FROM t GROUP BY 1),
dt AS (SELECT date, coalesce(d >= CASE WHEN count(d) OVER (ORDER BY date ROWS UNBOUNDED PRECEDING) >= 52 THEN quantile_cont(d, 0.6) OVER (ORDER BY date ROWS UNBOUNDED PRECEDING) END, FALSE) AS on_ FROM dp),
s AS (SELECT *, row_number() OVER (PARTITION BY date ORDER BY mo DESC, series_id) AS rn FROM t WHERE mask AND me_stamp AND mo > 0),
p1 AS (SELECT series_id, date, 1e0 / count(*) OVER (PARTITION BY date) AS w FROM s WHERE rn <= 8), {equal('px', 'me', name='p2')},
out AS (SELECT p1.* FROM p1 JOIN dt USING (date) WHERE on_ UNION ALL SELECT p2.* FROM p2 JOIN dt USING (date) WHERE NOT on_)""", lookback=26, skip=4, n=8, window=13, pct=0.6, min_history=52)
sig("g39_research_intensity", "research_intensity", f"{MF}, {sql_trailing('rnd', 'revenue', 'net_income')}, {sql_asof(['rnd_ttm', 'revenue_ttm', 'net_income_ttm'])}, {topn('rnd_ttm / nullif(revenue_ttm, 0)', 12, 'qe', 'net_income_ttm > 0 AND score > 0', src='pf')}",
    ("filings",), profitable=True)
sig("g40_accrual_quality", "accrual_quality", f"{MF}, {sql_trailing('net_income', 'fcf')}, {sql_asof(['net_income_ttm', 'fcf_ttm', 'assets'])}, {topn('-((net_income_ttm - fcf_ttm) / nullif(assets, 0))', 12, 'qe', src='pf')}", ("filings",))
HELD = "out AS (SELECT series_id, date, 1e0 / count(*) OVER (PARTITION BY date) AS w FROM h WHERE held AND mask)"
RSNH = f"""r0 AS (SELECT px.*, adj_close / nullif(ix, 0) AS rs FROM px JOIN ix USING (date)),
r1 AS (SELECT *, {roll('max', 'rs', 13, None, 1)} AS hi, {roll('min', 'rs', 5, None, 1)} AS lo, {UP40} AS up FROM r0),
h AS (SELECT *, {latch('coalesce(rs > hi, FALSE) AND up AND mask', 'coalesce(rs < lo, FALSE)')} AS held FROM r1)"""
sig("g45_relative_new_high", "relative_new_high", f"{MK}, {RSNH}, {HELD}", entry_window=13, exit_window=5, trend=40)
sig("g47_high_proximity", "high_proximity", f"{MK}, t AS (SELECT *, adj_close / nullif({roll('max', 'adj_close', 26, 13)}, 0) AS prox FROM px), {topn('prox', 10, 'me', 'prox >= 0.8', src='t')}", window=26, floor=0.8)
sig("g48_quiet_trend", "quiet_trend", f"""{MK}, t AS (SELECT *, {UP40} AS up, ({roll('stddev_samp', 'ret', 5)}) * {ROOT} AS vol FROM px),
h AS (SELECT *, up AND coalesce(vol <= {roll('quantile_cont({x}, 0.75)', 'vol', 104, 52)}, FALSE) AS held FROM t), {HELD}""", trend=40, vol_window=5, q=0.75, lookback=104, min_history=52)
sig("g49_volume_breakout", "volume_breakout", f"""{MK}, t AS (SELECT *, {HILO(11, 4)}, {roll('avg', 'dollar_volume', 10, 5, 1)} AS base FROM px),
h AS (SELECT *, {latch('coalesce(adj_close > hi, FALSE) AND coalesce(dollar_volume > base * 1.2, FALSE) AND mask', 'coalesce(adj_close < lo, FALSE)')} AS held FROM t), {HELD}""",
    entry_window=11, exit_window=4, vol_window=10, mult=1.2)
sig("g50_turn_of_month", "turn_of_month", f"{MK}, {equal('px', 'day', '(day(date) >= 26 OR day(date) <= 5)')}")
SHORT = """sv AS (SELECT series_id, {wk} AS date, sum(CASE WHEN l_linestatus = 'O' THEN l_quantity ELSE 0e0 END) AS short_volume, sum(l_quantity) AS total_volume FROM lines GROUP BY 1, 2)"""
from .base import WK  # noqa: E402

SQL_SHORT = SHORT.format(wk=WK)
sig("g51_short_squeeze", "short_squeeze", f"""{MK}, {SQL_SHORT}, s0 AS (SELECT px.*, short_volume / nullif(total_volume, 0) AS sh FROM px LEFT JOIN sv ON sv.series_id = px.series_id AND sv.date = px.date),
s1 AS (SELECT *, last_value(sh IGNORE NULLS) {W(6)} AS share FROM s0),
s2 AS (SELECT *, {roll('quantile_cont({x}, 0.8)', 'share', 52, 26)} AS qh, {roll('quantile_cont({x}, 0.5)', 'share', 52, 26)} AS ql, coalesce(adj_close > {sma(20)}, FALSE) AS up FROM s1),
h AS (SELECT *, {latch('coalesce(share >= qh, FALSE) AND up AND mask', 'coalesce(share <= ql, FALSE) OR NOT up')} AS held FROM s2), {HELD}""",
    ("short",), lookback=52, q=0.8, trend=20, exit_q=0.5, min_history=26)
sig("g52_hedged_signal", "hedged_signal", f"""{MK}, {RSNH}, w00 AS (SELECT series_id, date, 1e0 / count(*) OVER (PARTITION BY date) AS w FROM h WHERE held AND mask),
w0 AS (SELECT * FROM w00 WHERE series_id <> '{IX}'), {own_return()},
ee AS (SELECT c.date, least(coalesce(sum(abs(w)), 0e0), 1e0) AS e0 FROM cal c LEFT JOIN w0 USING (date) GROUP BY 1),
o2 AS (SELECT date, g / nullif(lag(e0) OVER (ORDER BY date), 0) AS inv, e0 FROM own JOIN ee USING (date)), {HEDGE('inv', 'e0', 13).format(src='o2')},
out AS (SELECT * FROM w0 UNION ALL SELECT * FROM leg)""", book="relative_new_high", window=26, entry_window=13, exit_window=5, trend=40)
BSK = f"{MB}, bk AS (SELECT * FROM px WHERE {basket_cond('T1')})"
sig("g32_equal_risk", "equal_risk", None, ("members",), basket="T1", window=26)
# Pairwise-complete correlations of the trailing window, every pair of live names joined on the row position.
sig("g33_min_correlation", "min_correlation", f"""{MK}, st AS (SELECT date AS stamp, pos AS sp FROM cal WHERE qe_stamp),
wn AS (SELECT stamp, px.series_id, px.pos, px.ret FROM st JOIN px ON px.pos BETWEEN sp - 51 AND sp AND px.ret IS NOT NULL
 SEMI JOIN (SELECT series_id, date FROM px WHERE mask) lv ON lv.series_id = px.series_id AND lv.date = st.stamp),
en AS (SELECT * FROM wn QUALIFY count(*) OVER (PARTITION BY stamp, series_id) >= 26),
pc AS (SELECT a.stamp, a.series_id AS a, b.series_id AS b, corr(a.ret, b.ret) AS c FROM en a JOIN en b ON a.stamp = b.stamp AND a.pos = b.pos AND a.series_id <> b.series_id GROUP BY 1, 2, 3),
av AS (SELECT stamp, a, sum(c) / count(*) AS m FROM pc GROUP BY 1, 2), rk AS (SELECT *, row_number() OVER (PARTITION BY stamp ORDER BY m, a) AS rn FROM av),
pk AS (SELECT a AS series_id, stamp AS date, 1e0 / count(*) OVER (PARTITION BY stamp) AS w FROM rk WHERE rn <= 10),
{equal('px', 'qe', 'date NOT IN (SELECT date FROM pk)', 'rest')}, out AS (SELECT * FROM pk UNION ALL SELECT * FROM rest)""", window=52)
sig("g53_golden_cross", "golden_cross", f"{MK}, t AS (SELECT *, {sma(10)} > {sma(40)} AS x FROM px), {equal('t', 'me', 'x')}", fast=10, slow=40)
