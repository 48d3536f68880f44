"""Projections, filters, calendars and masks."""

from pyspark.sql import functions as F

from ..functions import rolling as R
from ..operators import panel as P
from ..session import materialize
from ..sources import tables as T
from .base import SQL_CAL, SQL_LINES, SQL_PANEL, WEEK, WK, W, query, roll, sql_bars, sql_panel

PW = sql_panel("w")
SQL_MACRO = f"""macro AS (SELECT date, unnest(['RATE', 'LEVEL']) AS series, unnest([rate, level]) AS value FROM (
 SELECT max(wk) AS date, avg(CASE WHEN o_orderstatus = 'F' THEN 1e0 ELSE 0e0 END) * 5 AS rate, avg(o_totalprice) AS level
 FROM (SELECT {WEEK.format(d='o_orderdate')} AS wk, * FROM orders) GROUP BY date_trunc('month', wk)))"""
SQL_LISTING = f"""listing AS (SELECT series_id, ipo,
 CASE WHEN CAST(substr(series_id, 7) AS INTEGER) % 5 = 0 THEN ipo + CAST(floor((last - ipo) * 0.7e0) AS INTEGER) END AS delisted
 FROM (SELECT series_id, min({WK}) AS ipo, max({WK}) AS last FROM lines GROUP BY 1))"""
SQL_MEMBERS = """members AS (SELECT DISTINCT unnest(['T' || CAST(n % 3 AS VARCHAR), 'U' || CAST(n % 4 AS VARCHAR)]) AS basket, series_id
 FROM (SELECT p_brand AS series_id, CAST(substr(p_brand, 7) AS INTEGER) AS n FROM part))"""
SQL_MASK_T = """{name} AS (SELECT series_id, date, adj_close IS NOT NULL
 AND sum(CASE WHEN adj_close IS NOT NULL THEN 1 ELSE 0 END) {all} > 26
 AND coalesce({liquid} > 5e4, FALSE) AND coalesce({price} > 100e0, FALSE) AS mask FROM {src})"""


def sql_mask(src: str = "panel", name: str = "mask") -> str:
    return SQL_MASK_T.format(name=name, src=src, all=W(None), liquid=roll("median", "dollar_volume", 13, 5), price=roll("min", "close", 5, 1))


def masked_panel(spark, sf_dir, series="brand", stored=False):
    """Weekly panel with returns and the investability mask (26-week seasoning, 13-week liquidity, 5-week price floor).

    Plans that read the panel more than once take it ``stored``: series x dates rows, a small fraction of the order lines, are
    written to the shared folder, so the lines are scanned and reduced once.
    """
    panel, cal = T.market_panel(spark, sf_dir, "w", series, stored)
    panel = P.investable(panel, seasoning=26, dv_window=13, dv_min=5, dv_floor=5e4, price_window=5, price_floor=100.0)
    panel = panel.withColumn("ret", R.pct_change("adj_close"))
    # The opening price needs an ordered minimum per bar, which costs a sort of the lines; stored panels leave it out.
    return (materialize(panel.drop("open"), "panel") if stored else panel), cal


@query("p1_ratio_adjust", "series_id:s date:d open:p high:p low:p dollar_volume:p", f"""{SQL_LINES}, {sql_bars()},
out AS (SELECT series_id, date, open * adj_close / nullif(close, 0) AS open, high * adj_close / nullif(close, 0) AS high,
 low * adj_close / nullif(close, 0) AS low, volume * close AS dollar_volume FROM bars)""")
def p1(spark, d):
    return P.ratio_adjust(T.bars(spark, d))


@query("p2_densify", "series_id:s date:d pos:i adj_close:p", f"{PW}, out AS (SELECT * FROM panel)")
def p2(spark, d):
    return T.market_panel(spark, d)[0]


@query("p2_densify_daily", "series_id:s date:d pos:i open:p high:p low:p close:p volume:p",
       f"{sql_panel('d')}, out AS (SELECT * FROM panel)")
def p2d(spark, d):
    return T.market_panel(spark, d, "d")[0]


@query("p3_calendar_align", "series:s date:d value:p", f"""{SQL_LINES}, {sql_bars()}, {SQL_CAL}, {SQL_MACRO},
out AS (SELECT s.series, c.date, last_value(m.value IGNORE NULLS) {W(None, part='s.series', order='c.date')} AS value
 FROM (SELECT DISTINCT series FROM macro) s CROSS JOIN cal c LEFT JOIN macro m ON m.series = s.series AND m.date = c.date)""")
def p3(spark, d):
    return P.calendar_align(T.macro(spark, d), T.market_calendar(spark, d))


@query("p3_ffill_limit", "series_id:s date:d filled:p", f"""{PW},
out AS (SELECT series_id, date, last_value(adj_close IGNORE NULLS) {W(6)} AS filled FROM panel)""")
def p3l(spark, d):
    panel, _ = T.market_panel(spark, d)
    return panel.withColumn("filled", R.ffill("adj_close", 5))


@query("p4_dev_holdout", "split:s n:i first:d last:d v:f", f"""{SQL_LINES}, {sql_bars()},
out AS (SELECT CASE WHEN date < (SELECT CAST(max(date) - INTERVAL 24 MONTH AS DATE) FROM bars) THEN 'dev' ELSE 'holdout' END AS split,
 count(*) AS n, min(date) AS first, max(date) AS last, sum(volume) AS v FROM bars GROUP BY 1)""")
def p4(spark, d):
    b = T.bars(spark, d)
    return P.dev_holdout(b, T.market_calendar(spark, d), 24).groupBy("split").agg(
        F.count("*").alias("n"), F.min("date").alias("first"), F.max("date").alias("last"), F.sum("volume").alias("v"))


@query("p4_date_slice", "series_id:s n:i", f"""{SQL_LINES}, {sql_bars()},
out AS (SELECT series_id, count(*) AS n FROM bars WHERE date BETWEEN DATE '1996-01-05' AND DATE '1998-12-25' GROUP BY 1)""")
def p4s(spark, d):
    return P.date_slice(T.bars(spark, d), "1996-01-05", "1998-12-25").groupBy("series_id").agg(F.count("*").alias("n"))


@query("p5_trim_listing", "series_id:s rows_outside_listing:i", f"""{SQL_LINES}, {sql_bars()}, {SQL_LISTING},
out AS (SELECT b.series_id, count(*) AS rows_outside_listing FROM bars b JOIN listing l USING (series_id)
 WHERE b.date < l.ipo OR b.date > l.delisted GROUP BY 1)""")
def p5(spark, d):
    return P.trim_listing_window(T.bars(spark, d), T.listing(spark, d))[1]


@query("p6_investable_mask", "series_id:s date:d mask:b", f"""{PW}, {SQL_LISTING}, {sql_mask(name='m0')},
out AS (SELECT m0.series_id, m0.date, mask AND coalesce(m0.date <= l.delisted, TRUE) AS mask FROM m0 JOIN listing l USING (series_id))""")
def p6(spark, d):
    panel, _ = T.market_panel(spark, d)
    panel = panel.join(T.listing(spark, d).select("series_id", "delisted"), "series_id", "left")
    return P.investable(panel, seasoning=26, dv_window=13, dv_min=5, dv_floor=5e4, price_window=5, price_floor=100.0, delisted="delisted")


@query("p7_basket_mask", "date:d n:i", f"""{PW}, {SQL_MEMBERS}, {sql_mask()},
out AS (SELECT date, count_if(mask) AS n FROM mask SEMI JOIN (SELECT series_id FROM members WHERE basket = 'T1') USING (series_id) GROUP BY 1)""")
def p7(spark, d):
    panel, _ = masked_panel(spark, d)
    return P.in_basket(panel, T.members(spark, d), "T1").groupBy("date").agg(F.count_if("mask").alias("n"))


SQL_HOLIDAYS = """holidays AS (SELECT date, n < 3 AS early_close FROM (SELECT CAST(o_orderdate AS DATE) AS date, count(*) AS n,
 min(count(*)) OVER () AS least FROM orders GROUP BY 1) WHERE n <= least + 1),
days AS (SELECT DISTINCT CAST(o_orderdate AS DATE) AS date FROM orders)"""


def _days_and_holidays(spark, d):
    n = T.table(spark, d, "orders").groupBy(F.col("o_orderdate").cast("date").alias("date")).agg(F.count("*").alias("n"))
    least = n.agg(F.min("n").alias("least"))
    hol = n.join(F.broadcast(least)).where("n <= least + 1").select("date", (F.col("n") < 3).alias("early_close"))
    return n.select("date"), hol


@query("p8_sessions", "date:d pos:i early_close:b", f"""{SQL_HOLIDAYS},
s AS (SELECT date FROM days WHERE isodow(date) < 6 AND date NOT IN (SELECT date FROM holidays WHERE NOT early_close)),
out AS (SELECT s.date, row_number() OVER (ORDER BY s.date) - 1 AS pos, coalesce(h.early_close, FALSE) AS early_close
 FROM s LEFT JOIN holidays h USING (date))""")
def p8(spark, d):
    days, hol = _days_and_holidays(spark, d)
    s = P.calendar(P.sessions(days, hol)).select("date", "pos")
    return s.join(hol, "date", "left").withColumn("early_close", F.coalesce("early_close", F.lit(False)))


@query("p8_next_session", "date:d next_session:d is_session:b", f"""{SQL_HOLIDAYS},
s AS (SELECT date FROM days WHERE isodow(date) < 6 AND date NOT IN (SELECT date FROM holidays WHERE NOT early_close)),
out AS (SELECT d.date, (SELECT min(s.date) FROM s WHERE s.date > d.date) AS next_session, d.date IN (SELECT date FROM s) AS is_session FROM days d)""")
def p8n(spark, d):
    days, hol = _days_and_holidays(spark, d)
    return P.next_session(days, P.sessions(days, hol))


@query("p8_business_days", "month:d n:i first:d last:d", """m AS (SELECT CAST(date_trunc('month', o_orderdate) AS DATE) AS month, min(CAST(o_orderdate AS DATE)) AS lo,
 max(CAST(o_orderdate AS DATE)) AS hi FROM orders GROUP BY 1),
g AS (SELECT month, CAST(unnest(generate_series(lo, hi, INTERVAL 1 DAY)) AS DATE) AS date FROM m),
out AS (SELECT month, count(*) AS n, min(date) AS first, max(date) AS last FROM g WHERE isodow(date) < 6 GROUP BY 1)""")
def p8b(spark, d):
    o = T.table(spark, d, "orders").select(F.col("o_orderdate").cast("date").alias("date"))
    m = o.groupBy(F.trunc("date", "month").alias("month")).agg(F.min("date").alias("lo"), F.max("date").alias("hi"))
    return m.select("month", F.explode(P.business_days("lo", "hi")).alias("date")).groupBy("month").agg(
        F.count("*").alias("n"), F.min("date").alias("first"), F.max("date").alias("last"))


@query("p10_elementwise", "series_id:s date:d clipped:p masked:p filled:p ratio:p", f"""{PW},
out AS (SELECT series_id, date, CASE WHEN adj_close IS NOT NULL THEN least(greatest(adj_close, 30000e0), 60000e0) END AS clipped, CASE WHEN volume > 500 THEN adj_close END AS masked,
 coalesce(adj_close, 0e0) AS filled, high / nullif(volume - 100, 0) AS ratio FROM panel)""")
def p10(spark, d):
    panel, _ = T.market_panel(spark, d)
    c = F.col("adj_close")
    return panel.select("series_id", "date", F.when(c.isNotNull(), F.least(F.greatest(c, F.lit(30000.0)), F.lit(60000.0))).alias("clipped"),
                        F.when(F.col("volume") > 500, c).alias("masked"), F.coalesce(c, F.lit(0.0)).alias("filled"),
                        F.try_divide("high", F.col("volume") - 100).alias("ratio"))
