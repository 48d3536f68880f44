"""Sorts, set operations, scalar functions, the ridge ranking and the extension surface (K, U, X, M, F)."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import mathx as MX
from ..functions import rolling as R
from ..functions import stats as S
from ..operators import ranking as RK
from ..operators.panel import period_key, union_all
from ..operators.resample import trial_sharpes
from ..plans import ml
from ..plans.signals import SIGNALS, decisions, _masked_equal, _w
from ..sources import tables as T
from .base import SQL_LINES, WK, lagx, query, roll, sql_bars, sql_panel
from .metrics import SQL_CURVES, curves
from .returns import CAGR, SHARPE
from .signals import MK, equal, market, mom, sma, topn

BARS = f"{SQL_LINES}, {sql_bars()}"


@query("k1_head_tail", "series_id:s date:d close:p side:s", f"""{BARS}, r AS (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY date) AS a, row_number() OVER (PARTITION BY series_id ORDER BY date DESC) AS b FROM bars),
out AS (SELECT series_id, date, close, 'head' AS side FROM r WHERE a <= 3 UNION ALL SELECT series_id, date, close, 'tail' FROM r WHERE b <= 3)""")
def k1(spark, d):
    b = T.bars(spark, d)
    w = Window.partitionBy("series_id")
    x = b.withColumns({"_a": F.row_number().over(w.orderBy("date")), "_b": F.row_number().over(w.orderBy(F.col("date").desc()))}).where("_a <= 3 or _b <= 3")
    side = F.filter(F.array(F.when(F.col("_a") <= 3, "head"), F.when(F.col("_b") <= 3, "tail")), lambda s: s.isNotNull())
    return x.select("series_id", "date", "close", F.explode(side).alias("side"))


@query("k1_top_report", "series_id:s date:d dollar_volume:p", f"{BARS}, out AS (SELECT * FROM bars ORDER BY dollar_volume DESC, series_id, date LIMIT 25)")
def k1t(spark, d):
    return T.bars(spark, d).orderBy(F.col("dollar_volume").desc(), "series_id", "date").limit(25)


@query("k2_argmax", "series_id:s best_date:d worst_date:d second:p", f"""{BARS}, r AS (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY close, date) AS rn FROM bars),
out AS (SELECT series_id, arg_max(date, close) AS best_date, arg_min(date, close) AS worst_date, max(CASE WHEN rn = 2 THEN close END) AS second FROM r GROUP BY 1)""")
def k2(spark, d):
    x = T.bars(spark, d).withColumn("rn", F.row_number().over(Window.partitionBy("series_id").orderBy("close", "date")))
    return x.groupBy("series_id").agg(F.max_by("date", "close").alias("best_date"), F.min_by("date", "close").alias("worst_date"), F.max(F.when(F.col("rn") == 2, F.col("close"))).alias("second"))


@query("k3_drop_duplicates", "l_orderkey:i l_linenumber:i first_price:f last_price:f", """out AS (SELECT l_orderkey, l_linenumber, first(l_extendedprice ORDER BY l_shipdate, l_extendedprice) AS first_price, last(l_extendedprice ORDER BY l_shipdate, l_extendedprice) AS last_price
 FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1)""")
def k3(spark, d):
    k = F.struct("l_shipdate", "l_extendedprice")
    g = T.table(spark, d, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.count("*").alias("n"), F.min_by("l_extendedprice", k).alias("first_price"), F.max_by("l_extendedprice", k).alias("last_price"))
    return g.where("n > 1")


@query("u1_union_by_name", "series_id:s date:d close:p share:f", f"""{BARS}, out AS (SELECT series_id, date, close, CAST(NULL AS DOUBLE) AS share FROM bars WHERE date < DATE '1997-01-01' UNION ALL SELECT series_id, date, NULL, volume / 1000 FROM bars WHERE date >= DATE '1997-01-01')""")
def u1(spark, d):
    b = T.bars(spark, d)
    return union_all([b.where("date < '1997-01-01'").select("series_id", "date", "close"), b.where("date >= '1997-01-01'").select("date", "series_id", (F.col("volume") / 1000).alias("share"))])


@query("u2_set_operations", "date:d kind:s", f"""w AS (SELECT DISTINCT {WK} AS date FROM lineitem), o AS (SELECT DISTINCT CAST(o_orderdate AS DATE) AS date FROM orders),
out AS (SELECT date, 'difference' AS kind FROM (SELECT * FROM o EXCEPT SELECT * FROM w) UNION ALL SELECT date, 'intersection' FROM (SELECT * FROM o INTERSECT SELECT * FROM w) UNION ALL SELECT date, 'union' FROM (SELECT * FROM o UNION SELECT * FROM w))""")
def u2(spark, d):
    w = T.table(spark, d, "lineitem").select(T.week_of().alias("date")).distinct()
    o = T.table(spark, d, "orders").select(F.col("o_orderdate").cast("date").alias("date")).distinct()
    tag = lambda x, k: x.select("date", F.lit(k).alias("kind"))
    # One grouped pass over both sides instead of three set operations.
    s = o.select("date", F.lit(1).alias("o"), F.lit(0).alias("w")).unionByName(w.select("date", F.lit(0).alias("o"), F.lit(1).alias("w"))).groupBy("date").agg(F.max("o").alias("o"), F.max("w").alias("w"))
    kinds = F.filter(F.array(F.when((F.col("o") == 1) & (F.col("w") == 0), "difference"), F.when((F.col("o") == 1) & (F.col("w") == 1), "intersection"), F.lit("union")), lambda k: k.isNotNull())
    return s.select("date", F.explode(kinds).alias("kind"))


@query("u3_common_columns", "series_id:s n:i", f"{BARS}, out AS (SELECT series_id, count(*) AS n FROM bars WHERE series_id IN (SELECT p_brand FROM part WHERE p_size > 45 AND p_type = 'SMALL') GROUP BY 1)")
def u3(spark, d):
    have = T.table(spark, d, "part").where("p_size > 45 and p_type = 'SMALL'").select(F.col("p_brand").alias("series_id"))
    return T.bars(spark, d).join(have, "series_id", "left_semi").groupBy("series_id").agg(F.count("*").alias("n"))


@query("x1_string_functions", "p_partkey:i a:s b:s c:s d:b e:b", "out AS (SELECT p_partkey, upper(trim(' ' || p_name || ' ')) AS a, lower(p_type) AS b, split_part(p_brand, '#', 1) AS c, contains(p_name, 'red') AS d, starts_with(p_name, 'blue') AS e FROM part)")
def x1(spark, d):
    return T.table(spark, d, "part").select("p_partkey", F.upper(F.trim(F.concat(F.lit(" "), "p_name", F.lit(" ")))).alias("a"), F.lower("p_type").alias("b"), F.split_part("p_brand", F.lit("#"), F.lit(1)).alias("c"),
                                            F.contains("p_name", F.lit("red")).alias("d"), F.startswith("p_name", F.lit("blue")).alias("e"))


@query("x2_regex", "p_partkey:i full:b no:s", "out AS (SELECT p_partkey, regexp_full_match(p_brand, 'Brand#\\d{2}') AS \"full\", regexp_extract(p_brand, '#(\\d+)', 1) AS no FROM part)")
def x2(spark, d):
    return T.table(spark, d, "part").select("p_partkey", F.col("p_brand").rlike(r"^Brand#\d{2}$").alias("full"), F.regexp_extract("p_brand", r"#(\d+)", 1).alias("no"))


@query("x3_strategy_name", "p_partkey:i name:s", "out AS (SELECT p_partkey, 'Pick(basket=' || p_brand || ',size=' || p_size || ',type=' || p_type || ')' AS name FROM part)")
def x3(spark, d):
    m = F.create_map(F.lit("type"), F.col("p_type"), F.lit("size"), F.col("p_size").cast("string"), F.lit("basket"), F.col("p_brand"))
    return T.table(spark, d, "part").select("p_partkey", RK.strategy_name("Pick", m).alias("name"))


@query("x4_stable_hash", "p_partkey:i h:s", """out AS (SELECT p_partkey, left(sha256('{"p_brand":"' || p_brand || '","p_size":' || p_size || '}'), 10) AS h FROM part)""")
def x4(spark, d):
    return T.table(spark, d, "part").select("p_partkey", RK.stable_hash(F.struct("p_brand", "p_size")).alias("h"))


@query("x5_dates", "o_orderkey:i d:d stamp:s back:d day:d", "out AS (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS d, strftime(o_orderdate, '%Y%m%d') AS stamp, CAST(strptime(strftime(o_orderdate, '%d/%m/%Y'), '%d/%m/%Y') AS DATE) AS back, CAST(o_orderdate + INTERVAL 17 HOUR AS DATE) AS day FROM orders)")
def x5(spark, d):
    t = F.col("o_orderdate")
    return T.table(spark, d, "orders").select("o_orderkey", t.cast("date").alias("d"), F.date_format(t, "yyyyMMdd").alias("stamp"), F.to_date(F.date_format(t, "dd/MM/yyyy"), "dd/MM/yyyy").alias("back"),
                                              (t + F.expr("interval 17 hours")).cast("date").alias("day"))


@query("x6_period_buckets", "date:d me:d qe:d ye:d wf:d plus:d eom:d", """dts AS (SELECT DISTINCT CAST(l_shipdate AS DATE) AS date FROM lineitem), out AS (SELECT date, date_trunc('month', date) AS me, date_trunc('quarter', date) AS qe, date_trunc('year', date) AS ye,
 date_trunc('week', date + 2) AS wf, CAST(date + INTERVAL 5 MONTH AS DATE) AS plus, last_day(date) AS eom FROM dts)""")
def x6(spark, d):
    x = T.table(spark, d, "lineitem").select(T.day_of().alias("date")).distinct()
    return x.select("date", *[period_key(f).alias(f) for f in ("me", "qe", "ye", "wf")], F.add_months("date", 5).alias("plus"), F.last_day("date").alias("eom"))


@query("x6_month_starts", "o_custkey:i step:d", """c AS (SELECT o_custkey, min(o_orderdate) AS lo, max(o_orderdate) AS hi FROM orders GROUP BY 1),
out AS (SELECT o_custkey, CAST(unnest(generate_series(date_trunc('month', lo), hi, INTERVAL 12 MONTH)) AS DATE) AS step FROM c)""")
def x6m(spark, d):
    c = T.table(spark, d, "orders").groupBy("o_custkey").agg(F.min("o_orderdate").cast("date").alias("lo"), F.max("o_orderdate").cast("date").alias("hi"))
    return c.select("o_custkey", F.explode(F.sequence(F.trunc("lo", "month"), F.col("hi"), F.expr("interval 12 months"))).alias("step"))


@query("x7_date_parts", "date:d dom:i y:i wd:i since:i", "dts AS (SELECT DISTINCT CAST(l_shipdate AS DATE) AS date FROM lineitem), out AS (SELECT date, day(date) AS dom, year(date) AS y, isodow(date) - 1 AS wd, date - DATE '1995-01-01' AS since FROM dts)")
def x7(spark, d):
    x = T.table(spark, d, "lineitem").select(T.day_of().alias("date")).distinct()
    return x.select("date", F.dayofmonth("date").alias("dom"), F.year("date").alias("y"), F.weekday("date").alias("wd"), F.datediff("date", F.to_date(F.lit("1995-01-01"))).alias("since"))


@query("x8_numeric", "s_suppkey:i a:f b:f c:f d:f e:f f:f", "out AS (SELECT s_suppkey, sqrt(abs(s_acctbal)) AS a, exp(s_acctbal / 1e4) AS b, ln(1 + abs(s_acctbal)) AS c, pow(abs(s_acctbal), 0.3e0) AS d, cos(s_acctbal) AS e, least(greatest(s_acctbal, 0e0), 5000e0) AS f FROM supplier)")
def x8(spark, d):
    b = F.col("s_acctbal")
    return T.table(spark, d, "supplier").select("s_suppkey", F.sqrt(F.abs(b)).alias("a"), F.exp(b / 1e4).alias("b"), F.log1p(F.abs(b)).alias("c"), F.pow(F.abs(b), F.lit(0.3)).alias("d"), F.cos(b).alias("e"), F.least(F.greatest(b, F.lit(0.0)), F.lit(5000.0)).alias("f"))


@query("x9_finite_default", "p_partkey:i v:f w:f", "out AS (SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN -1e0 ELSE p_retailprice END AS v, CASE WHEN p_size % 3 = 0 THEN NULL ELSE p_retailprice END AS w FROM part)")
def x9(spark, d):
    z = F.col("p_size") % 6
    v = F.when(z == 0, F.lit(float("nan"))).when(z == 3, F.lit(float("inf"))).otherwise(F.col("p_retailprice"))
    return T.table(spark, d, "part").select("p_partkey", MX.safe(v, -1.0).alias("v"), MX.safe(v).alias("w"))


@query("x10_normal_cdf", "l_orderkey:i n:i s:f", f"z AS (SELECT l_orderkey, (l_extendedprice - 5e4) / 6e3 AS x FROM lineitem), out AS (SELECT l_orderkey, count(*) AS n, sum({MX.norm_cdf_sql('x')}) AS s FROM z GROUP BY 1)")
def x10(spark, d):
    z = T.table(spark, d, "lineitem").withColumn("x", (F.col("l_extendedprice") - 5e4) / 6e3)
    return z.groupBy("l_orderkey").agg(F.count("*").alias("n"), F.sum(MX.norm_cdf("x")).alias("s"))


@query("x11_normal_quantile", "l_orderkey:i s:f", f"z AS (SELECT l_orderkey, (l_discount * 100 + 0.5e0) / 11.5 AS p FROM lineitem), out AS (SELECT l_orderkey, sum({MX.norm_ppf_sql('p')}) AS s FROM z GROUP BY 1)")
def x11(spark, d):
    z = T.table(spark, d, "lineitem").withColumn("p", (F.col("l_discount") * 100 + 0.5) / 11.5)
    return z.groupBy("l_orderkey").agg(F.sum(MX.norm_ppf("p")).alias("s"))


@query("x12_json_get", "event_type:s n:i s:i", "out AS (SELECT event_type, count(*) AS n, sum(CAST(json_extract_string(props, '$.k') AS BIGINT)) AS s FROM events GROUP BY 1)")
def x12(spark, d):
    e = T.table(spark, d, "events").withColumn("j", F.from_json("props", "k bigint"))
    return e.groupBy("event_type").agg(F.count("*").alias("n"), F.sum("j.k").alias("s"))


@query("x13_arrays_maps", "p_brand:s n:i has:b k:s", "a AS (SELECT p_brand, count(DISTINCT p_type) AS n, bool_or(p_type = 'SMALL') AS has FROM part GROUP BY 1), b AS (SELECT DISTINCT p_brand, p_type AS k FROM part), out AS (SELECT a.*, k FROM a JOIN b USING (p_brand))")
def x13(spark, d):
    g = T.table(spark, d, "part").groupBy("p_brand").agg(F.collect_set("p_type").alias("t"))
    m = g.withColumn("m", F.map_from_arrays("t", F.transform("t", lambda x: F.length(x))))
    return m.select("p_brand", F.size("t").alias("n"), F.array_contains("t", "SMALL").alias("has"), F.explode(F.map_keys("m")).alias("k"))


# ------------------------------------------------------------------ ridge ranking
FEATURES = {"f_dist": f"adj_close / nullif({sma(40)}, 0) - 1", "f_mom_h": mom(26, 0), "f_mom_m": mom(13, 0), "f_mom_s": mom(4, 0), "f_mom_ys": mom(52, 4), "f_rev": f"-({mom(1, 0)})", "f_vol": f"({roll('stddev_samp', 'ret', 13)}) * sqrt(252e0)"}
P = len(FEATURES)
# Each refit standardises and solves its own rows; the system is reduced column by column.
SQL_RIDGE = f"""{MK}, fe AS (SELECT series_id, date, pos, mask, me_stamp, lead(adj_close, 4) OVER (PARTITION BY series_id ORDER BY pos) / nullif(adj_close, 0) - 1 AS y, {', '.join(f'{x} AS {n}' for n, x in FEATURES.items())} FROM px),
s0 AS (SELECT CAST(CASE WHEN day(m) = 1 THEN m ELSE date_trunc('month', m) + INTERVAL 1 MONTH END AS DATE) AS s0 FROM (SELECT min(date) AS m FROM cal)),
cl AS (SELECT date, pos, CASE WHEN date < s0 THEN 0 ELSE CAST(floor(((year(date) - year(s0)) * 12 + month(date) - month(s0)) / 12e0) AS INTEGER) + 1 END AS k FROM cal, s0),
cb AS (SELECT *, lead(k, 5) OVER (ORDER BY pos) + 1 AS bucket FROM cl),
fx AS (SELECT fe.*, k, bucket FROM fe JOIN cb USING (date) WHERE {' AND '.join(f'{n} IS NOT NULL' for n in FEATURES)}),
tr AS MATERIALIZED (SELECT row_number() OVER (ORDER BY series_id, date) AS rid, * FROM fx WHERE mask AND y IS NOT NULL AND bucket IS NOT NULL),
rf AS (SELECT k FROM (SELECT k, min(pos) AS start FROM cb GROUP BY 1) s WHERE k > 0 AND start - 5 >= 104 AND (SELECT count(*) FROM tr WHERE bucket <= s.k) >= 500),
tl AS MATERIALIZED (SELECT rid, bucket, y, unnest(range({P})) AS i, unnest([{', '.join(FEATURES)}]) AS v FROM tr),
ms AS MATERIALIZED (SELECT rf.k, i, avg(v) AS mu, CASE WHEN stddev_pop(v) > 0 THEN stddev_pop(v) ELSE 1 END AS sd, avg(y) AS my FROM rf JOIN tl ON tl.bucket <= rf.k GROUP BY 1, 2),
zs AS MATERIALIZED (SELECT ms.k, rid, tl.i, (v - mu) / sd AS z, y FROM ms JOIN tl ON tl.i = ms.i AND tl.bucket <= ms.k),
aq AS MATERIALIZED (SELECT a.k, a.i, b.i AS j, sum(a.z * b.z) + CASE WHEN a.i = b.i THEN 10 ELSE 0 END AS v FROM zs a JOIN zs b ON a.k = b.k AND a.rid = b.rid GROUP BY 1, 2, 3 UNION ALL SELECT k, i, {P}, sum(z * y) FROM zs GROUP BY 1, 2),
el AS (SELECT 0 AS s, k, i, j, v FROM aq UNION ALL SELECT s + 1, k, i, j, CASE WHEN i = s THEN v / piv ELSE v - vis * vsj / piv END FROM (
 SELECT *, max(CASE WHEN i = s AND j = s THEN v END) OVER (PARTITION BY k) AS piv, max(CASE WHEN j = s THEN v END) OVER (PARTITION BY k, i) AS vis, max(CASE WHEN i = s THEN v END) OVER (PARTITION BY k, j) AS vsj FROM el WHERE s < {P})),
co AS (SELECT k, i, v / sd AS b, mu, my FROM el JOIN ms USING (k, i) WHERE s = {P} AND j = {P}),
bt AS (SELECT k, max(my) - sum(b * mu) AS b0, list(b ORDER BY i) AS b FROM co GROUP BY 1),
rs AS (SELECT series_id, date, mask, me_stamp, b0 + {' + '.join(f'b[{k + 1}] * {n}' for k, n in enumerate(FEATURES))} AS pred FROM fx JOIN bt USING (k))"""


@query("m1_ridge_scores", "series_id:s date:d score:f", f"{SQL_RIDGE}, out AS (SELECT series_id, date, pred AS score FROM rs)")
def m1(spark, d):
    m = market(spark, d)
    return ml.ridge_scores(m.panel, m.cal, ml.feature_columns(week=True), 4, 10.0, 12, 104)


@query("g25_ridge_rank", "series_id:s date:d w:f", f"{SQL_RIDGE}, {topn('pred', 6, 'me', 'score > 0', src='rs')}")
def g25(spark, d):
    return ml.ridge_rank(market(spark, d), horizon=4, refit_months=12, min_train=104, week=True)


# ------------------------------------------------------------------ extension surface
def above_index(m, window: int, freq: str = "me"):
    """A user-written signal: masked names above their own average and above the index's momentum."""
    ix = m.index_series().select("date", R.pct_change("ix", window, key=[], order="date").alias("_im"))
    x = m.panel.withColumns({"_s": R.sma("adj_close", window), "_m": R.momentum("adj_close", window)}).join(F.broadcast(ix), "date")
    return _w(_masked_equal(decisions(x.where("adj_close > _s and _m > _im"), m, freq)))


@query("f1_custom_signal", "series_id:s date:d w:f", f"""{MK}, i2 AS (SELECT date, ix / nullif(lag(ix, 13) OVER (ORDER BY date), 0) - 1 AS im FROM ix), t AS (SELECT *, {roll('avg', 'adj_close', 13)} AS s, adj_close / nullif({lagx('adj_close', 13)}, 0) - 1 AS m FROM px),
u AS (SELECT t.*, im FROM t JOIN i2 USING (date)), {equal('u', 'me', 'adj_close > s AND m > im')}""")
def f1(spark, d):
    SIGNALS.setdefault("above_index", above_index)
    return SIGNALS["above_index"](market(spark, d), window=13)


@query("f2_criterion_callables", "strategy:s sharpe:f cagr:f sortino:f vol:f", f"{SQL_CURVES}, out AS (SELECT strategy, {SHARPE} AS sharpe, {CAGR} AS cagr, avg(ret) / stddev_samp(CASE WHEN ret < 0 THEN ret END) * sqrt(252e0) AS sortino, stddev_samp(ret) * sqrt(252e0) AS vol FROM cv GROUP BY 1)")
def f2(spark, d):
    crit = {"sharpe": S.sharpe, "cagr": S.cagr, "sortino": S.sortino, "vol": S.ann_vol}
    return curves(spark, d).groupBy("strategy").agg(*[f("ret").alias(n) for n, f in crit.items()])
