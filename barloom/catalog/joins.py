"""Join operators (J1-J15, P9) and fundamentals windows."""

from pyspark.sql import functions as F

from ..functions import rolling as R
from ..operators import asof as A
from ..operators import panel as P
from ..operators import xsection as X
from ..sources import tables as T
from .base import SQL_CAL, SQL_LINES, WK, W, lagx, query, roll, sql_bars, sql_panel
from .panel import SQL_MEMBERS
from .signals import SQL_FUND, sql_asof, sql_trailing
from .windows import BASE, SQL_BENCH, px, with_bench

PF = f"{sql_panel('w')}, {SQL_FUND}"


@query("j1_align_inner", "series_id:s n:i active:f", f"""{BASE}, {SQL_BENCH},
out AS (SELECT series_id, count(*) AS n, sum(ret - bret) AS active FROM pb WHERE ret IS NOT NULL AND bret IS NOT NULL GROUP BY 1)""")
def j1(spark, d):
    x = with_bench(px(spark, d)).where("ret is not null and bret is not null")
    return x.groupBy("series_id").agg(F.count("*").alias("n"), F.sum(F.col("ret") - F.col("bret")).alias("active"))


@query("j2_pit_asof", "series_id:s date:d revenue:p revenue_yoy:f", f"{PF}, {sql_trailing('revenue')}, {sql_asof(['revenue', 'revenue_yoy'], 'panel', 'out')}")
def j2(spark, d):
    panel, _ = T.market_panel(spark, d)
    return A.pit_asof(panel.select("series_id", "date"), A.trailing_filings(T.fundamentals(spark, d), "revenue"), ["revenue", "revenue_yoy"])


@query("j2_pit_asof_strict", "series_id:s date:d shares:p", f"{PF}, {sql_trailing('revenue')}, {sql_asof(['shares'], 'panel', 'out', '>')}")
def j2s(spark, d):
    panel, _ = T.market_panel(spark, d)
    return A.pit_asof(panel.select("series_id", "date"), T.fundamentals(spark, d), ["shares"], strict=True)


@query("p9_fundamentals_asof", "series_id:s n:i newest:d revenue:p", f"""{SQL_LINES}, {SQL_FUND},
out AS (SELECT series_id, count(*) AS n, max(period_end) AS newest, arg_max(revenue, period_end) AS revenue FROM fund WHERE published < DATE '1999-05-15' GROUP BY 1)""")
def p9(spark, d):
    f = A.filings_asof(T.fundamentals(spark, d), "1999-05-15")
    return f.groupBy("series_id").agg(F.count("*").alias("n"), F.max("period_end").alias("newest"), F.max_by("revenue", "period_end").alias("revenue"))


@query("w25_trailing_fundamentals", "series_id:s period_end:d revenue_ttm:p revenue_yoy:f revenue_accel:f", f"{SQL_LINES}, {SQL_FUND}, {sql_trailing('revenue')}, out AS (SELECT * FROM filed)")
def w25(spark, d):
    return A.trailing_filings(T.fundamentals(spark, d), "revenue")


@query("w26_event_decay", "series_id:s date:d surprise:f", f"""{PF}, {sql_trailing('revenue')}, {sql_asof(['revenue_yoy'], 'panel')},
t AS (SELECT *, revenue_yoy - {lagx('revenue_yoy')} AS step FROM pf),
out AS (SELECT series_id, date, last_value(CASE WHEN abs(step) > 1e-12 THEN step END IGNORE NULLS) {W(6)} AS surprise FROM t)""")
def w26(spark, d):
    panel, _ = T.market_panel(spark, d)
    x = A.pit_asof(panel.select("series_id", "date", "pos"), A.trailing_filings(T.fundamentals(spark, d), "revenue"), ["revenue_yoy"])
    x = x.withColumn("step", F.col("revenue_yoy") - R.lag("revenue_yoy")).withColumn("fresh", F.when(F.abs("step") > 1e-12, F.col("step")))
    return x.withColumn("surprise", F.last("fresh", ignorenulls=True).over(R.over(6)))


SQL_SPANS = """spans AS (SELECT sid, symbol, valid_from, valid_to FROM (SELECT DISTINCT p_brand AS sid, CAST(substr(p_brand, 7) AS INTEGER) AS no FROM part) b,
 LATERAL (SELECT 'B' || no AS symbol, DATE '1995-01-01' AS valid_from, DATE '1998-06-30' AS valid_to WHERE no BETWEEN 10 AND 19
 UNION ALL SELECT 'B' || no || 'X', DATE '1998-07-01', NULL WHERE no BETWEEN 10 AND 19
 UNION ALL SELECT 'B7', DATE '2001-01-01', NULL WHERE no = 8 UNION ALL SELECT 'B8', DATE '1995-01-01', DATE '2000-12-31' WHERE no = 8
 UNION ALL SELECT 'B7', DATE '1995-01-01', DATE '2001-03-31' WHERE no = 7
 UNION ALL SELECT 'B' || no, DATE '1995-01-01', NULL WHERE no NOT BETWEEN 10 AND 19 AND no NOT IN (7, 8)) s)"""
SQL_SYM = f"sq AS (SELECT CASE WHEN no BETWEEN 10 AND 19 AND wk > DATE '1998-06-30' THEN 'B' || no || 'X' ELSE 'B' || no END AS symbol, wk AS date, close FROM (SELECT CAST(substr(series_id, 7) AS INTEGER) AS no, date AS wk, close FROM bars))"


def _symbol_quotes(spark, d):
    b = T.bars(spark, d).withColumn("no", T.brand_no())
    sym = F.concat(F.lit("B"), F.col("no").cast("string"))
    return b.select(F.when(F.col("no").between(10, 19) & (F.col("date") > F.lit("1998-06-30").cast("date")), F.concat(sym, F.lit("X"))).otherwise(sym).alias("symbol"), "date", "close")


@query("j3_resolve_symbol", "symbol:s date:d sid:s", f"""{SQL_LINES}, {sql_bars()}, {SQL_SPANS}, {SQL_SYM},
out AS (SELECT q.symbol, q.date, s.sid FROM sq q LEFT JOIN spans s ON s.symbol = q.symbol AND q.date BETWEEN s.valid_from AND coalesce(s.valid_to, DATE '2100-01-01'))""")
def j3(spark, d):
    return A.resolve_symbol(_symbol_quotes(spark, d).select("symbol", "date"), T.ticker_spans(spark, d))


@query("j4_audit_overlaps", "symbol:s sid:s other_sid:s", f"""{SQL_SPANS},
out AS (SELECT a.symbol, a.sid, b.sid AS other_sid FROM spans a JOIN spans b ON a.symbol = b.symbol AND a.sid < b.sid
 AND a.valid_from <= coalesce(b.valid_to, DATE '2100-01-01') AND b.valid_from <= coalesce(a.valid_to, DATE '2100-01-01'))""")
def j4(spark, d):
    return A.audit_overlaps(T.ticker_spans(spark, d))


@query("j5_calendar_gaps", "series_id:s expected:i observed:i missing:i gappy:b", f"""{SQL_LINES}, {sql_bars('d')}, {SQL_CAL},
sp AS (SELECT series_id, min(date) AS lo, max(date) AS hi, count(*) AS observed FROM bars GROUP BY 1),
e AS (SELECT series_id, observed, (SELECT count(*) FROM cal WHERE date BETWEEN lo AND hi) AS expected FROM sp),
out AS (SELECT *, expected - observed AS missing, expected - observed > 0.02 * expected AS gappy FROM e)""")
def j5(spark, d):
    return A.calendar_gaps(T.bars(spark, d, "d"), T.market_calendar(spark, d, "d"))


@query("j5_missing_dates", "series_id:s date:d", f"""{SQL_LINES}, {sql_bars()}, {SQL_CAL},
sp AS (SELECT series_id, min(date) AS lo, max(date) AS hi FROM bars GROUP BY 1),
out AS (SELECT s.series_id, c.date FROM sp s JOIN cal c ON c.date BETWEEN lo AND hi ANTI JOIN bars b ON b.series_id = s.series_id AND b.date = c.date)""")
def j5m(spark, d):
    return A.missing_dates(T.bars(spark, d), T.market_calendar(spark, d))


SQL_PROV = f"""prov AS (SELECT CASE l_returnflag WHEN 'A' THEN 'alpha' WHEN 'N' THEN 'north' ELSE 'river' END AS provider, series_id, {WK} AS date,
 avg(l_extendedprice * (1 - l_discount)) AS adj_close FROM lines GROUP BY 1, 2, 3)"""
SQL_RECON = f"""{SQL_LINES}, {SQL_PROV}, rr AS (SELECT *, adj_close / nullif(lag(adj_close) OVER (PARTITION BY series_id, provider ORDER BY date), 0) - 1 AS r FROM prov),
best AS (SELECT series_id, arg_min(provider, CASE provider WHEN 'north' THEN 1 WHEN 'alpha' THEN 2 ELSE 3 END) AS chosen FROM prov GROUP BY 1),
pr AS (SELECT b.series_id, b.chosen, o.provider AS other, x.r - o.r AS diff FROM best b JOIN rr x ON x.series_id = b.series_id AND x.provider = b.chosen
 JOIN rr o ON o.series_id = x.series_id AND o.date = x.date AND o.provider <> b.chosen WHERE x.r IS NOT NULL AND o.r IS NOT NULL),
g AS (SELECT series_id, chosen, other, count(*) AS overlap, count_if(abs(diff) > 0.2) AS flagged FROM pr GROUP BY 1, 2, 3),
out AS (SELECT *, flagged / overlap AS pct_flagged, flagged / overlap > 0.5 AS warning FROM g WHERE overlap >= 20)"""


@query("j9_reconcile_providers", "series_id:s chosen:s other:s overlap:i flagged:i pct_flagged:f warning:b", SQL_RECON)
def j9(spark, d):
    return A.reconcile_providers(T.provider_bars(spark, d), ["north", "alpha"], bp=2000.0, warn_share=0.5)


@query("j11_broadcast_benchmark", "series_id:s date:d rel:f ratio:f beats:b", f"""{BASE}, {SQL_BENCH},
out AS (SELECT series_id, date, ret - bret AS rel, px / nullif(bench, 0) AS ratio, coalesce(ret > bret, FALSE) AS beats FROM pb)""")
def j11(spark, d):
    x = with_bench(px(spark, d))
    return x.select("series_id", "date", (F.col("ret") - F.col("bret")).alias("rel"), F.try_divide("px", "bench").alias("ratio"), R.above("ret", "bret").alias("beats"))


@query("j13_membership", "date:d series_id:s w:f", f"""{SQL_LINES}, {sql_bars()}, {SQL_MEMBERS},
m AS (SELECT b.date, b.series_id, basket, 1e0 / count(*) OVER (PARTITION BY basket, b.date) AS w FROM bars b JOIN members USING (series_id)),
out AS (SELECT date, series_id, sum(w) / 7 AS w FROM m GROUP BY 1, 2)""")
def j13(spark, d):
    m = X.equal_weight(T.bars(spark, d).select("series_id", "date").join(T.members(spark, d), "series_id"), ["basket", "date"])
    return m.groupBy("date", "series_id").agg((F.sum("w") / 7).alias("w"))


SQL_FUNDN = f"{SQL_LINES}, {SQL_FUND}"


@query("s18_import_fundamentals", "series_id:s n:i", f"""{SQL_FUNDN}, f2 AS (SELECT *, CASE WHEN CAST(substr(series_id, 7) AS INTEGER) % 7 = 0 AND month(period_end) = 3 THEN period_end - 1 ELSE published END AS pub FROM fund),
out AS (SELECT series_id, count(*) AS n FROM f2 WHERE series_id NOT IN (SELECT series_id FROM f2 WHERE pub < period_end) GROUP BY 1)""")
def s18(spark, d):
    from ..sources.loose import accept_filings

    f = T.fundamentals(spark, d).withColumn("published", F.when((T.brand_no() % 7 == 0) & (F.month("period_end") == 3), F.date_sub("period_end", 1)).otherwise(F.col("published")))
    kept, _ = accept_filings(f, key="series_id")
    return kept.groupBy("series_id").agg(F.count("*").alias("n"))


@query("q5_stitch_history", "sid:s n:i first:d last:d symbols:i", f"""{SQL_LINES}, {sql_bars()}, {SQL_SPANS}, {SQL_SYM},
pc AS (SELECT s.sid, q.symbol, q.date FROM sq q JOIN spans s ON s.symbol = q.symbol AND q.date BETWEEN s.valid_from AND coalesce(s.valid_to, DATE '2100-01-01')),
sp AS (SELECT sid, symbol, min(date) AS lo, max(date) AS hi FROM pc GROUP BY 1, 2), g AS (SELECT *, lag(hi) OVER (PARTITION BY sid ORDER BY lo) AS prev FROM sp),
out AS (SELECT sid, count(*) AS n, min(date) AS first, max(date) AS last, count(DISTINCT symbol) AS symbols FROM pc WHERE sid NOT IN (SELECT sid FROM g WHERE prev IS NOT NULL AND (lo <= prev OR lo - prev > 7)) GROUP BY 1)""")
def q5(spark, d):
    rows, _ = A.stitch_history(_symbol_quotes(spark, d), T.ticker_spans(spark, d))
    return rows.groupBy("sid").agg(F.count("*").alias("n"), F.min("date").alias("first"), F.max("date").alias("last"), F.count_distinct("symbol").alias("symbols"))


@query("q5_stitch_refused", "sid:s reason:s", f"""{SQL_LINES}, {sql_bars()}, {SQL_SPANS}, {SQL_SYM},
pc AS (SELECT s.sid, q.symbol, q.date FROM sq q JOIN spans s ON s.symbol = q.symbol AND q.date BETWEEN s.valid_from AND coalesce(s.valid_to, DATE '2100-01-01')),
sp AS (SELECT sid, symbol, min(date) AS lo, max(date) AS hi FROM pc GROUP BY 1, 2), g AS (SELECT *, lag(hi) OVER (PARTITION BY sid ORDER BY lo) AS prev FROM sp),
out AS (SELECT sid, min(CASE WHEN lo <= prev THEN 'overlap' ELSE 'gap' END) AS reason FROM g WHERE prev IS NOT NULL AND (lo <= prev OR lo - prev > 6) GROUP BY 1)""")
def q5r(spark, d):
    return A.stitch_history(_symbol_quotes(spark, d), T.ticker_spans(spark, d), 6)[1]


@query("q6_symbol_coverage", "series_id:s", f"""{SQL_LINES}, {sql_bars()}, {SQL_SPANS},
out AS (SELECT DISTINCT series_id FROM bars WHERE series_id NOT IN (SELECT sid FROM spans WHERE symbol NOT LIKE '%X' AND coalesce(valid_to, DATE '2100-01-01') >= DATE '2000-01-01'))""")
def q6(spark, d):
    known = T.ticker_spans(spark, d).where(~F.col("symbol").like("%X") & (F.coalesce("valid_to", F.to_date(F.lit("2100-01-01"))) >= F.to_date(F.lit("2000-01-01"))))
    return T.bars(spark, d).select("series_id").distinct().join(known.select(F.col("sid").alias("series_id")), "series_id", "left_anti")
