"""Cross-sectional operators (C1-C18) and recursive filters."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import rolling as R
from ..operators import allocation as AL
from ..operators import recursive as REC
from ..operators import returns as B
from ..operators import stateful as ST
from ..operators import xsection as X
from ..operators.order_stats import expanding_quantile
from ..plans import signals as S
from ..plans.signals import SIGNALS, Market
from ..sources import tables as T
from .base import ORACLES, QUERIES, W, lagx, query, roll, shape_sql, sql_panel
from .panel import SQL_MACRO, SQL_MEMBERS, masked_panel
from .signals import (SINGLE_PASS, BRD, BT1, FB, GATE, HELD, IX, IXT, MACD, MB, MK, ROOT, THEME, UP40, VT, Z, basket_cond, equal, latch, market, mom, own_return, sma, sql_cap)

RK = "(rank() OVER (PARTITION BY date ORDER BY {x}) + (count(*) OVER (PARTITION BY date, {x}) - 1) / 2e0) / count(*) OVER (PARTITION BY date)"


def stamped(spark, d, freq="me"):
    panel, cal = masked_panel(spark, d)
    return panel, cal, S.decisions


@query("c1_xs_rank", "series_id:s date:d r:f", f"""{MK}, t AS (SELECT series_id, date, round(adj_close / 5000) AS x FROM px WHERE mask AND adj_close IS NOT NULL),
out AS (SELECT series_id, date, {RK.format(x='x')} AS r FROM t)""")
def c1(spark, d):
    panel, _ = masked_panel(spark, d)
    return X.xs_rank(panel.where("mask").withColumn("x", F.round(F.col("adj_close") / 5000)), "x", "r")


@query("c1_xs_rank_suppliers", "series_id:s date:d r:f", f"""{sql_panel('w', 'supplier')}, t AS (SELECT series_id, date, {mom(13, 1)} AS x FROM panel),
u AS (SELECT * FROM t WHERE x IS NOT NULL), out AS (SELECT series_id, date, {RK.format(x='x')} AS r FROM u)""")
def c1s(spark, d):
    panel, _ = T.market_panel(spark, d, "w", "supplier")
    return X.xs_rank(panel.withColumn("x", R.momentum("adj_close", 13, 1)), "x", "r")


@query("c2_xs_zscore", "series_id:s date:d z:f", f"{MK}, t AS (SELECT * FROM px WHERE mask), out AS (SELECT series_id, date, {Z('ret')} AS z FROM t)")
def c2(spark, d):
    panel, _ = masked_panel(spark, d)
    return X.with_zscores(panel.where("mask"), ["ret"]).withColumnRenamed("z_ret", "z")


@query("c3_top_n", "series_id:s date:d score:f", f"""{MK}, t AS (SELECT series_id, date, ret AS score, row_number() OVER (PARTITION BY date ORDER BY ret DESC, series_id) AS rn FROM px WHERE mask AND ret IS NOT NULL),
out AS (SELECT * FROM t WHERE rn <= 5)""")
def c3(spark, d):
    panel, _ = masked_panel(spark, d)
    return X.top_n(panel.where("mask").withColumn("score", F.col("ret")), "score", 5)


@query("c3_bottom_n_suppliers", "series_id:s date:d score:f", f"""{sql_panel('w', 'supplier')}, t AS (SELECT series_id, date, {mom(4, 0)} AS score FROM panel),
u AS (SELECT *, row_number() OVER (PARTITION BY date ORDER BY score, series_id) AS rn FROM t WHERE score IS NOT NULL), out AS (SELECT * FROM u WHERE rn <= 10)""")
def c3b(spark, d):
    panel, _ = T.market_panel(spark, d, "w", "supplier")
    return X.top_n(panel.withColumn("score", R.momentum("adj_close", 4)), "score", 10, ascending=True)


@query("c4_equal_weight", "series_id:s date:d w:f", f"{MK}, {equal('px', 'day', 'ret > 0')}")
def c4(spark, d):
    return X.equal_weight(masked_panel(spark, d)[0].where("mask and ret > 0"))


@query("c5_score_weight", "series_id:s date:d w:f", f"{MK}, out AS (SELECT series_id, date, ret / sum(ret) OVER (PARTITION BY date) AS w FROM px WHERE mask AND ret > 0)")
def c5(spark, d):
    return X.score_weight(masked_panel(spark, d)[0].where("mask"), "ret")


@query("c6_inverse_vol_weight", "series_id:s date:d w:f", f"""{MK}, t AS (SELECT *, ({roll('stddev_samp', 'ret', 13)}) * {ROOT} AS vol FROM px),
out AS (SELECT series_id, date, (1 / vol) / sum(1 / vol) OVER (PARTITION BY date) AS w FROM t WHERE mask AND vol > 0)""")
def c6(spark, d):
    return X.inverse_vol_weight(masked_panel(spark, d)[0].withColumn("vol", R.realized_vol("ret", 13)).where("mask"), "vol")


@query("c7_cap_weights", "series_id:s date:d w:f", f"{MK}, w0 AS (SELECT series_id, date, ret / sum(ret) OVER (PARTITION BY date) AS w FROM px WHERE mask AND ret > 0), {sql_cap('w0', 0.12)}")
def c7(spark, d):
    w = X.score_weight(masked_panel(spark, d)[0].where("mask"), "ret")
    return X.cap_weights(w.select("series_id", "date", "w"), 0.12)


@query("c9_rebalance_hold", "series_id:s date:d w:f", f"""{MK}, {equal('px', 'me', 'ret > 0', 'w0')}, hd AS (SELECT date, max(CASE WHEN me_stamp THEN date END) OVER (ORDER BY date ROWS UNBOUNDED PRECEDING) AS f FROM cal),
out AS (SELECT w0.series_id, hd.date, w FROM hd JOIN w0 ON w0.date = hd.f)""")
def c9(spark, d):
    panel, cal = masked_panel(spark, d)
    m = Market(panel, cal)
    w = X.equal_weight(S.decisions(panel.where("mask and ret > 0"), m, "me")).select("series_id", "date", "w")
    return B.held_weights(w, cal, "me")


@query("c10_fallback_sleeve", "series_id:s date:d w:f", f"""{MK}, w0 AS (SELECT series_id, date, least(ret, 0.2e0) * 0.2e0 AS w FROM px WHERE mask AND ret > 0),
ot AS (SELECT * FROM w0 UNION ALL SELECT '{FB}', c.date, greatest(1 - coalesce(s, 0), 0) FROM cal c JOIN px q ON q.date = c.date AND q.series_id = '{FB}' AND q.adj_close IS NOT NULL
 LEFT JOIN (SELECT date, sum(w) AS s FROM w0 GROUP BY 1) u ON u.date = c.date), out AS (SELECT * FROM ot WHERE w > 1e-12)""")
def c10(spark, d):
    panel, cal = masked_panel(spark, d)
    w = panel.where("mask and ret > 0").select("series_id", "date", (F.least("ret", F.lit(0.2)) * 0.2).alias("w"))
    return X.with_fallback(w, cal, panel, FB)


@query("c11_breadth", "date:d breadth:f", f"{MK}, {BRD}, out AS (SELECT date, avg(breadth) OVER (ORDER BY date ROWS 3 PRECEDING) AS breadth FROM br)")
def c11(spark, d):
    return S.breadth(market(spark, d), 40, 4)


@query("c12_dispersion", "date:d disp:f threshold:f", f"""{MK}, t AS (SELECT *, {roll('stddev_samp', 'ret', 13)} AS sd FROM px), dp AS (SELECT date, stddev_samp(sd) AS disp FROM t GROUP BY 1),
out AS (SELECT date, disp, CASE WHEN count(disp) OVER (ORDER BY date ROWS UNBOUNDED PRECEDING) >= 52 THEN quantile_cont(disp, 0.6) OVER (ORDER BY date ROWS UNBOUNDED PRECEDING) END AS threshold FROM dp)""")
def c12(spark, d):
    panel, _ = masked_panel(spark, d)
    x = panel.withColumn("sd", R.std("ret", 13)).groupBy("date").agg(F.stddev_samp("sd").alias("disp"))
    return expanding_quantile(x, "disp", 0.6, "threshold", 52)


@query("c13_argmax_pick", "date:d series_id:s ret:f", f"""{MK}, t AS (SELECT date, series_id, ret, row_number() OVER (PARTITION BY date ORDER BY ret DESC, series_id) AS rn FROM px WHERE ret IS NOT NULL),
out AS (SELECT * FROM t WHERE rn = 1 AND ret > 0)""")
def c13(spark, d):
    return X.argmax_pick(masked_panel(spark, d)[0], "ret").where("ret > 0")


@query("c14_theme_index", "basket:s date:d level:f", f"""{MB}, {THEME.replace("WHERE basket LIKE 'U%'", '')}, out AS (SELECT basket, date, ln(level) AS level FROM tl)""")
def c14(spark, d):
    return S.theme_levels(market(spark, d, "members")).withColumn("level", F.ln("level"))


def sql_windows(freq: str, window: int, panel: str) -> str:
    """Returns of the trailing window of each basket and stamp; ``panel`` has a basket column."""
    return f"""st AS (SELECT date AS stamp, pos AS sp FROM cal WHERE {freq}_stamp),
wn AS (SELECT b.basket, stamp, b.series_id, b.pos, b.ret FROM st JOIN {panel} b ON b.pos BETWEEN sp - {window - 1} AND sp AND b.ret IS NOT NULL
 SEMI JOIN (SELECT series_id, date FROM px WHERE mask) lv ON lv.series_id = b.series_id AND lv.date = st.stamp),
en AS (SELECT * FROM wn QUALIFY count(*) OVER (PARTITION BY basket, stamp, series_id) >= {max(21, window // 2)}),
cv AS (SELECT a.basket, a.stamp, a.series_id AS a, b.series_id AS b, count(*) AS n, covar_samp(a.ret, b.ret) AS cov, corr(a.ret, b.ret) AS corr
 FROM en a JOIN en b ON a.basket = b.basket AND a.stamp = b.stamp AND a.pos = b.pos AND a.series_id <= b.series_id GROUP BY ALL HAVING count(*) >= 2)"""


def sql_equal_risk(freq: str, panel: str, name: str) -> str:
    """Sixty rounds on lists: each stamp's weights and rows of its matrix."""
    return f"""sy AS (SELECT basket, stamp, a, b, CASE WHEN a = b THEN cov ELSE 0.9e0 * cov END AS c FROM cv UNION ALL SELECT basket, stamp, b, a, 0.9e0 * cov FROM cv WHERE a <> b),
mr AS (SELECT basket, stamp, a, list(c ORDER BY b) AS r FROM sy GROUP BY ALL),
mx AS MATERIALIZED (SELECT basket, stamp, list(a ORDER BY a) AS ids, list(r ORDER BY a) AS m, CAST(count(*) AS BIGINT) AS n FROM mr GROUP BY ALL HAVING count(*) >= 2 AND min(len(r)) = count(*) AND bool_and(len(list_filter(r, lambda x: x IS NULL OR NOT isfinite(x))) = 0)),
er AS (SELECT 0 AS k, basket, stamp, [1e0 / n FOR x IN range(n)] AS w, [1e0 / n FOR x IN range(n)] AS pw, FALSE AS still FROM mx UNION ALL
 SELECT k + 1, basket, stamp, CASE WHEN still THEN w WHEN ok THEN nw ELSE [1e0 / n FOR x IN range(n)] END, CASE WHEN still OR ok THEN w ELSE [1e0 / n FOR x IN range(n)] END, still OR NOT ok OR list_max(list_transform(range(1, n + 1), lambda i: abs(nw[i] - w[i]))) < 1e-8
 FROM (SELECT *, coalesce(list_sum(raw) > 0 AND isfinite(list_sum(raw)), FALSE) AS ok, list_transform(raw, lambda x: x / list_sum(raw)) AS nw
  FROM (SELECT er.*, n, list_transform(range(1, n + 1), lambda i: w[i] / CASE WHEN abs(list_dot_product(m[i], w)) < 1e-14 THEN 1e-14 ELSE list_dot_product(m[i], w) END) AS raw
   FROM er JOIN mx USING (basket, stamp) WHERE k < 60))),
sv AS (SELECT mx.basket, unnest(ids) AS series_id, mx.stamp AS date, unnest(w) AS w, list_max(list_transform(range(1, n + 1), lambda i: abs(w[i] - pw[i]))) < {SETTLED} AS settled FROM er JOIN mx USING (basket, stamp) WHERE k = 60),
{name} AS (SELECT * FROM sv UNION ALL SELECT b.basket, b.series_id, b.date, 1e0 / count(*) OVER (PARTITION BY b.basket, b.date), TRUE FROM {panel} b
 WHERE b.mask AND b.{freq}_stamp AND (b.basket, b.date) NOT IN (SELECT (basket, date) FROM sv))"""


SETTLED = AL.STILL
IN_BASKETS = "pb AS (SELECT px.*, basket FROM px JOIN members USING (series_id))"


def in_baskets(m):
    return m.panel.join(m.members, "series_id")


@query("c15_trailing_covariance", "basket:s stamp:d a:s b:s n:i cov:f corr:f", f"{MB}, {IN_BASKETS}, {sql_windows('qe', 52, 'pb')}, out AS (SELECT * FROM cv)")
def c15(spark, d):
    m = market(spark, d, "members")
    return AL.trailing_covariance(in_baskets(m), m.cal, "qe", 52, ("basket",))


# Where the rule does not stand still its last weights may depend on the order of sums, so engines need not agree on them; such dates are told apart.
@query("c16_equal_risk_contribution", "basket:s series_id:s date:d settled:b w:f",
       f"{MB}, {IN_BASKETS}, {sql_windows('qe', 52, 'pb')}, {sql_equal_risk('qe', 'pb', 'eq')}, out AS (SELECT basket, series_id, date, settled, CASE WHEN settled THEN w END AS w FROM eq)")
def c16(spark, d):
    m = market(spark, d, "members")
    w = AL.equal_risk_weights(in_baskets(m), m.cal, "qe", 52, ("basket",))
    w = w.withColumn("settled", F.max("step").over(Window.partitionBy("basket", "date")) < SETTLED)
    return w.withColumn("w", F.when(F.col("settled"), F.col("w")))


ORACLES["g32_equal_risk"] = shape_sql(f"""{MB}, pb AS (SELECT px.*, basket FROM px JOIN members USING (series_id) WHERE basket = 'T1'), {sql_windows('me', 26, 'pb')}, {sql_equal_risk('me', 'pb', 'w0')}, {sql_cap('w0', 0.25)}""", "series_id:s date:d w:f")


for new, old in (("c8_cap_weight_by_size", "g3_cap_weight"), ("c17_two_books", "g34_market_neutral_momentum"), ("c18_beta_hedge", "g35_beta_hedged_basket")):
    QUERIES[new], ORACLES[new] = QUERIES[old], ORACLES[old]


# ------------------------------------------------------------------ recursive filters
def sql_ewm(name: str, src: str, x: str, alpha: float, minp: int = 1) -> str:
    """Recursive twin: one step per calendar row, the old weight decaying once per row since the last value."""
    f, a = repr(1.0 - alpha), repr(alpha)
    return f"""{name}_s AS MATERIALIZED (SELECT series_id, pos, CAST({x} AS DOUBLE) AS x FROM {src}),
{name}_r AS (SELECT series_id, pos, x AS y, 0 AS since, CASE WHEN x IS NULL THEN 0 ELSE 1 END AS n FROM {name}_s WHERE pos = 0 UNION ALL
 SELECT s.series_id, s.pos, CASE WHEN s.x IS NULL THEN e.y WHEN e.y IS NULL THEN s.x ELSE (pow({f}, e.since + 1) * e.y + {a} * s.x) / (pow({f}, e.since + 1) + {a}) END,
 CASE WHEN s.x IS NULL THEN e.since + 1 ELSE 0 END, e.n + CASE WHEN s.x IS NULL THEN 0 ELSE 1 END FROM {name}_r e JOIN {name}_s s ON s.series_id = e.series_id AND s.pos = e.pos + 1),
{name} AS (SELECT series_id, pos, CASE WHEN n >= {max(minp, 1)} THEN y END AS {name}_y FROM {name}_r)"""


TR = f"""tr0 AS MATERIALIZED (SELECT *, greatest(abs(high - low), abs(high - {lagx('adj_close')}), abs(low - {lagx('adj_close')})) AS tr FROM px)"""
ATR = lambda n: f"{TR}, {sql_ewm('tra', 'tr0', 'tr', 1.0 / n, n)}"


def sql_gauss(src: str, x: str, period: int, poles: int) -> str:
    a = REC.gaussian_alpha(period, poles)
    out, prev, col = [], src, x
    for k in range(poles):
        out.append(sql_ewm(f"g{k}", prev, col, a))
        prev, col = f"g{k}", f"g{k}_y"
    return ", ".join(out)


@query("w15_ewm", "series_id:s date:d y:p", f"{MK}, {sql_ewm('e', 'px', 'adj_close', 1 / 14, 5)}, out AS (SELECT px.series_id, px.date, e_y AS y FROM px JOIN e USING (series_id, pos))")
def w15(spark, d):
    return REC.ewm(T.market_panel(spark, d)[0], "adj_close", 1 / 14, "y", 5)


@query("w16_atr", "series_id:s date:d atr:p", f"{MK}, {ATR(22)}, out AS (SELECT px.series_id, px.date, tra_y AS atr FROM px JOIN tra USING (series_id, pos))")
def w16(spark, d):
    return REC.atr(T.market_panel(spark, d)[0], 22)


@query("w17_gaussian", "series_id:s date:d centre:p", f"{MK}, {sql_gauss('px', 'adj_close', 20, 4)}, out AS (SELECT px.series_id, px.date, g3_y AS centre FROM px JOIN g3 USING (series_id, pos))")
def w17(spark, d):
    return REC.gaussian(T.market_panel(spark, d)[0], "adj_close", 20, 4)


def sql_adx(n: int, k: int) -> str:
    return f"""{TR}, mv AS MATERIALIZED (SELECT *, high - {lagx('high')} AS up, {lagx('low')} - low AS dn FROM tr0),
dm AS MATERIALIZED (SELECT *, CASE WHEN up > coalesce(dn, 'inf'::DOUBLE) AND up > 0 THEN up ELSE 0e0 END AS pdm, CASE WHEN dn > coalesce(up, 'inf'::DOUBLE) AND dn > 0 THEN dn ELSE 0e0 END AS mdm FROM mv),
{sql_ewm('tra', 'dm', 'tr', 1 / n, n)}, {sql_ewm('ps', 'dm', 'pdm', 1 / n, n)}, {sql_ewm('ms', 'dm', 'mdm', 1 / n, n)},
di AS MATERIALIZED (SELECT series_id, pos, 100 * ps_y / nullif(tra_y, 0) AS plus_di, 100 * ms_y / nullif(tra_y, 0) AS minus_di FROM tra JOIN ps USING (series_id, pos) JOIN ms USING (series_id, pos)),
dx AS MATERIALIZED (SELECT *, 100 * abs(plus_di - minus_di) / nullif(plus_di + minus_di, 0) AS dx FROM di), {sql_ewm('ad', 'dx', 'dx', 1 / k, k)}"""


@query("w18_adx", "series_id:s date:d plus_di:f minus_di:f adx:f", f"{MK}, {sql_adx(14, 14)}, out AS (SELECT px.series_id, px.date, plus_di, minus_di, ad_y AS adx FROM px JOIN di USING (series_id, pos) JOIN ad USING (series_id, pos))")
def w18(spark, d):
    return REC.adx(T.market_panel(spark, d)[0], 14, 14)


@query("w20_hysteresis", "date:d exposure:f", f"{MK}, {GATE}, out AS (SELECT date, e AS exposure FROM gt)")
def w20(spark, d):
    return S.hysteresis_gate(market(spark, d), 40, 0.02, 0.2)


SQL_MH = f"""{MK}, t AS MATERIALIZED (SELECT *, coalesce((adj_close - {sma(10)}) / nullif({roll('stddev_samp', 'adj_close', 10)}, 0) < -0.5, FALSE) AS en,
 coalesce((adj_close - {sma(10)}) / nullif({roll('stddev_samp', 'adj_close', 10)}, 0) > 0.3, FALSE) AS ex FROM px),
mh AS (SELECT series_id, pos, date, en AS held, 0 AS age FROM t WHERE pos = 0 UNION ALL
 SELECT t.series_id, t.pos, t.date, CASE WHEN NOT m.held THEN t.en ELSE NOT (t.ex AND NOT t.en AND m.age + 1 >= 4) END, CASE WHEN m.held THEN m.age + 1 ELSE 0 END
 FROM mh m JOIN t ON t.series_id = m.series_id AND t.pos = m.pos + 1)"""


@query("w21_min_hold_latch", "series_id:s date:d held:b", f"{SQL_MH}, out AS (SELECT * FROM mh)")
def w21(spark, d):
    panel, _ = masked_panel(spark, d)
    x = panel.withColumn("z", R.bollinger_z("adj_close", 10)).withColumns({"en": F.coalesce(F.col("z") < -0.5, F.lit(False)), "ex": F.coalesce(F.col("z") > 0.3, F.lit(False))})
    return ST.min_hold_latch(x, "en", "ex", 4)


@query("w22_drawdown_exposure", "date:d exposure:f", f"""{BT1}, eq AS (SELECT date, exp(sum(ln(1 + g)) OVER (ORDER BY date)) AS e FROM own), dd AS (SELECT date, e / max(e) OVER (ORDER BY date) - 1 AS d FROM eq),
out AS (SELECT date, least(greatest((d + 0.3e0) / 0.2e0, 0e0), 1e0) AS exposure FROM dd)""")
def w22(spark, d):
    m = market(spark, d, "members")
    return S.drawdown_exposure(m, S._masked_equal(m.basket("T1")), -0.10, -0.30)


@query("w23_vol_target_scale", "series_id:s date:d w:f", f"{BT1}, {VT}, out AS (SELECT series_id, date, w * s AS w FROM w0 JOIN sc USING (date))")
def w23(spark, d):
    m = market(spark, d, "members")
    return B.vol_target(S._masked_equal(m.basket("T1")), m.panel, m.cal, "day", 0.9, 13)


@query("w27_macro_regime_flags", "date:d ix_above:f ix_change:f rate:f level:p rates_rising:f level_high:f rate_negative:f stress:f breadth_raw:f", f"""{MK}, {SQL_MACRO}, {IXT}, {MACD}, {BRD}, n AS (SELECT TRUE AS y),
out AS (SELECT c.date, CAST(up AS INTEGER) AS ix_above, ic AS ix_change, rate, level, CAST(rising AS INTEGER) AS rates_rising, CAST(high AS INTEGER) AS level_high, CAST(neg AS INTEGER) AS rate_negative,
 CAST(stress AS INTEGER) AS stress, breadth AS breadth_raw FROM cal c LEFT JOIN ixt USING (date) LEFT JOIN mac USING (date) LEFT JOIN mf USING (date) LEFT JOIN br USING (date))""")
def w27(spark, d):
    return S.regime_flags(market(spark, d, "macro"), 40, 13, high=250000.0)


# ------------------------------------------------------------------ chart rules on the recursive filters
def sig(key, name, sql=None, **params):
    @query(key, "series_id:s date:d w:f", sql)
    def run(spark, d):
        return SIGNALS[name](market(spark, d, stored=name not in SINGLE_PASS), **params)


GA = f"{sql_gauss('px', 'adj_close', 12, 4)}, {ATR(8)}, ga AS MATERIALIZED (SELECT px.*, g3_y AS centre, tra_y AS atr FROM px JOIN g3 USING (series_id, pos) JOIN tra USING (series_id, pos))"
sig("g41_gaussian_bands", "gaussian_bands", f"{MK}, {GA}, h AS (SELECT *, {latch('coalesce(adj_close > centre + 0.3 * atr, FALSE) AND mask', 'coalesce(adj_close < centre - 0.1 * atr, FALSE)')} AS held FROM ga), {HELD}",
    period=12, atr_window=8, band=0.3, exit_band=0.1)
sig("g42_gaussian_hold", "gaussian_hold", f"""{MK}, {GA}, gb AS (SELECT *, coalesce(centre > {lagx('centre', 3)}, FALSE) AS rising FROM ga),
h AS (SELECT *, {latch('coalesce(adj_close > centre, FALSE) AND rising AND mask', 'coalesce(adj_close < centre - 0.5 * atr, FALSE)')} AS held FROM gb), {HELD}""", period=12, atr_window=8, band=0.5, confirm=3)
sig("g43_supertrend", "supertrend", f"""{MK}, {ATR(10)}, bd AS MATERIALIZED (SELECT px.*, (high + low) / 2 - 0.6 * tra_y AS rl, (high + low) / 2 + 0.6 * tra_y AS rh FROM px JOIN tra USING (series_id, pos)),
st AS (SELECT series_id, pos, date, adj_close AS c, rl AS lo, rh AS hi, FALSE AS lng, FALSE AS held FROM bd WHERE pos = 0 UNION ALL
 SELECT b.series_id, b.pos, b.date, b.adj_close, CASE WHEN s.c > s.lo THEN greatest(b.rl, s.lo) ELSE b.rl END, CASE WHEN s.c < s.hi THEN least(b.rh, s.hi) ELSE b.rh END,
 CASE WHEN b.adj_close > s.hi THEN TRUE WHEN s.lng AND b.adj_close < s.lo THEN FALSE ELSE s.lng END,
 (CASE WHEN b.adj_close > s.hi THEN TRUE WHEN s.lng AND b.adj_close < s.lo THEN FALSE ELSE s.lng END) AND b.mask
 FROM st s JOIN bd b ON b.series_id = s.series_id AND b.pos = s.pos + 1),
out AS (SELECT series_id, date, 1e0 / count(*) OVER (PARTITION BY date) AS w FROM st WHERE held)""", atr_window=10, mult=0.6)
sig("g44_adx_strength", "adx_strength", f"""{MK}, {sql_adx(8, 8)}, aa AS (SELECT px.*, coalesce(plus_di > minus_di, FALSE) AS up, ad_y AS adx FROM px JOIN di USING (series_id, pos) JOIN ad USING (series_id, pos)),
h AS (SELECT *, {latch('up AND coalesce(adx >= 15, FALSE) AND mask', 'NOT up OR coalesce(adx < 10, FALSE)')} AS held FROM aa), {HELD}""", di_window=8, adx_window=8, floor=15.0, exit_floor=10.0)
sig("g46_atr_trailing_stop", "atr_trailing_stop", f"""{MK}, {ATR(8)}, bk AS MATERIALIZED (SELECT px.*, tra_y AS atr, coalesce(adj_close > {roll('max', 'adj_close', 10, None, 1)}, FALSE) AS br FROM px JOIN tra USING (series_id, pos)),
ts AS (SELECT series_id, pos, date, br AND mask AS held, CASE WHEN br AND mask THEN adj_close END AS peak FROM bk WHERE pos = 0 UNION ALL
 SELECT series_id, pos, date, (stay OR (br AND mask)) AND mask, CASE WHEN stay THEN greatest(peak, adj_close) WHEN br AND mask THEN adj_close END FROM (
 SELECT b.*, t.peak, t.held AND NOT coalesce(b.adj_close < t.peak - 0.5 * b.atr, FALSE) AS stay FROM ts t JOIN bk b ON b.series_id = t.series_id AND b.pos = t.pos + 1)),
out AS (SELECT series_id, date, 1e0 / count(*) OVER (PARTITION BY date) AS w FROM ts WHERE held)""", entry_window=10, atr_window=8, mult=0.5)
