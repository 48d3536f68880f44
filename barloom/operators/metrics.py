"""Return and risk metrics per curve: one shuffle by curve id for the path statistics and the aggregates together."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import rolling as R
from ..functions import stats as S
from ..functions.mathx import with_probabilistic_sharpe


def drawdowns(curves: DataFrame, ids: list[str], ret: str = "ret") -> DataFrame:
    """Add ``equity``, ``drawdown`` and ``below_run`` (rows since the last peak) to the non-null rows."""
    w = R.over(key=ids, order="date")
    x = curves.where(F.col(ret).isNotNull()).withColumn("equity", R.growth_path(ret, key=ids, order="date"))
    x = x.withColumn("drawdown", F.try_divide("equity", F.max("equity").over(w)) - 1)
    x = x.withColumn("_rn", F.row_number().over(R.order_only(key=ids, order="date")))
    peak = F.last(F.when(F.coalesce(F.col("drawdown") >= -1e-12, F.lit(True)), F.col("_rn")), ignorenulls=True).over(w)
    return x.withColumn("below_run", F.col("_rn") - F.coalesce(peak, F.lit(0))).drop("_rn")


def max_drawdown() -> Column:
    return F.min("drawdown")


def resample_compound(curves: DataFrame, ids: list[str], freq: str, ret: str = "ret", out: str = "ret") -> DataFrame:
    """Compounded return per bucket, keyed by the bucket's start date."""
    from .panel import period_key

    return curves.where(F.col(ret).isNotNull()).groupBy(*ids, period_key(freq).alias("period")).agg(S.total_return(ret).alias(out))


def summary(curves: DataFrame, ids: list[str], ret: str = "ret", bench: str | None = None, turnover: str | None = None) -> DataFrame:
    """One wide row of metrics per curve."""
    x = drawdowns(curves, ids, ret)
    whole = Window.partitionBy(*ids)
    r = F.col(ret)
    x = x.withColumn("_var", F.when(F.count(r).over(whole) >= 20, F.percentile(r, F.lit(0.05)).over(whole)))
    for f, name in (("me", "month"), ("qe", "quarter"), ("ye", "year")):
        from .panel import period_key

        p = F.product(1 + r).over(Window.partitionBy(*ids, period_key(f))) - 1
        x = x.withColumn(f"_{name}", p)
    aggs = [S.total_return(ret).alias("total_return"), S.cagr(ret).alias("cagr"), S.ann_vol(ret).alias("ann_vol"), S.sharpe(ret).alias("sharpe"),
            S.sortino(ret).alias("sortino"), max_drawdown().alias("max_drawdown"),
            F.coalesce(F.avg(F.when(F.col("drawdown") < 0, F.col("drawdown"))), F.lit(0.0)).alias("avg_drawdown"),
            F.max("below_run").cast("bigint").alias("max_dd_duration"), F.max("_var").alias("var_95"),
            F.avg(F.when(r <= F.col("_var"), r)).alias("cvar_95"), S.skew_g1(ret).alias("skew"), S.kurt_g2(ret).alias("kurtosis"),
            S.win_rate(ret).alias("win_rate"), S.profit_factor(ret).alias("profit_factor"), F.count(r).alias("n_days"),
            F.max(r).alias("best_day"), F.min(r).alias("worst_day")]
    for name in ("month", "quarter", "year"):
        c = F.when(F.col(f"_{name}") != 0, F.col(f"_{name}"))
        aggs += [F.max(c).alias(f"best_{name}"), F.min(c).alias(f"worst_{name}")]
    if bench:
        aggs += [S.beta(ret, bench).alias("beta"), S.alpha(ret, bench).alias("alpha_ann"), S.correlation(ret, bench).alias("correlation"),
                 S.tracking_error(ret, bench).alias("tracking_error"), S.information_ratio(ret, bench).alias("information_ratio"),
                 S.capture(ret, bench, True).alias("upside_capture"), S.capture(ret, bench, False).alias("downside_capture")]
    if turnover:
        aggs.append((F.avg(turnover) * 252).alias("annual_turnover"))
    s = x.groupBy(*ids).agg(*aggs)
    return s.withColumn("calmar", F.when(F.col("max_drawdown") < 0, F.col("cagr") / F.abs("max_drawdown")))


def probabilistic_sharpe(curves: DataFrame, ids: list[str], ret: str = "ret", bench_ann: str | float = 0.0, carry: list[Column] = ()) -> DataFrame:
    """Probability that the true Sharpe beats ``bench_ann`` (a number or the name of a carried column), from population moments."""
    m = curves.where(F.col(ret).isNotNull()).groupBy(*ids).agg(
        F.count(ret).alias("n"), F.avg(ret).alias("_m"), F.stddev_samp(ret).alias("_sd"), F.skewness(ret).alias("_g3"),
        (F.kurtosis(ret) + 3).alias("_g4"), *carry)
    return with_probabilistic_sharpe(m, "psr", "n", "_m", "_sd", "_g3", "_g4", bench_ann)


def period_metrics(curves: DataFrame, ids: list[str], periods: list[tuple[str, str, str]], ret: str = "ret", bench: str | None = None,
                   min_rows: int = 60) -> DataFrame:
    """Growth, Sharpe and drawdown per named date interval (inclusive, possibly overlapping), when it has enough rows."""
    iv = F.array(*[F.struct(F.lit(n).alias("period"), F.to_date(F.lit(lo)).alias("lo"), F.to_date(F.lit(hi)).alias("hi")) for n, lo, hi in periods])
    x = curves.where(F.col(ret).isNotNull()).withColumn("_p", F.explode(F.filter(iv, lambda p: (F.col("date") >= p["lo"]) & (F.col("date") <= p["hi"]))))
    x = x.withColumn("period", F.col("_p.period")).drop("_p")
    x = drawdowns(x, [*ids, "period"], ret)
    aggs = [F.count("*").alias("n"), F.min("date").alias("first"), F.max("date").alias("last"), S.cagr(ret).alias("cagr"),
            S.sharpe(ret).alias("sharpe"), max_drawdown().alias("max_dd")]
    if bench:
        aggs.append(S.cagr(bench).alias("bench_cagr"))
    out = x.groupBy(*ids, "period").agg(*aggs).where(F.col("n") >= min_rows)
    return out.withColumn("excess_cagr", F.col("cagr") - F.col("bench_cagr")) if bench else out


def period_split(curves: DataFrame, ids: list[str], split: str, ret: str = "ret", min_rows: int = 60) -> DataFrame:
    """Metrics before and after a date (the date belongs to both) and whether the result depends on the later part."""
    p = period_metrics(curves, ids, [("pre", "0001-01-01", split), ("post", split, "9999-12-31")], ret, None, min_rows)
    cols = [F.max(F.when(F.col("period") == s, F.col(c))).alias(f"{s}_{c}") for s in ("pre", "post") for c in ("cagr", "sharpe", "max_dd")]
    g = p.groupBy(*ids).agg(*cols)
    return g.withColumn("late_only", F.coalesce((F.col("post_sharpe") > 0.5) & (F.col("pre_sharpe") <= 0.0), F.lit(False)))


def leave_one_year_out(curves: DataFrame, ids: list[str], ret: str = "ret") -> DataFrame:
    """Sharpe with each calendar year removed, by subtracting the year's sums from the totals (no year x row product)."""
    y = curves.where(F.col(ret).isNotNull()).groupBy(*ids, F.year("date").alias("year")).agg(
        F.count(ret).alias("n"), F.sum(ret).alias("s"), F.sum(F.col(ret) * F.col(ret)).alias("q"))
    w = Window.partitionBy(*ids)
    n, s, q = (F.sum(c).over(w) for c in "nsq")

    def stat(n, s, q):
        var = (q - s * s / n) / (n - 1)
        return F.when((n > 1) & (var > 0), s / n / F.sqrt(var) * S.ROOT)

    y = y.withColumns({"full": stat(n, s, q), "left": stat(n - F.col("n"), s - F.col("s"), q - F.col("q"))})
    g = y.groupBy(*ids).agg(F.count("*").alias("years"), F.max("full").alias("full"), F.min("left").alias("min"), F.max("left").alias("max"),
                            F.min_by("year", F.struct(-F.col("left"), "year")).alias("worst_year_removed"),
                            F.min_by("year", F.struct("left", "year")).alias("most_supportive_year"))
    return g.where("years >= 4").withColumn("range", F.col("max") - F.col("min"))


def contributions(weights: DataFrame, panel: DataFrame, cal: DataFrame, freq: str, named: str | None = None) -> DataFrame:
    """Share of the summed weight x return coming from the top 1, 3 and 5 names, a named one and the largest in size."""
    ids = [c for c in weights.columns if c not in ("series_id", "date", "w")]
    hist = panel.where("ret is not null").select("series_id", "date", "ret")
    ex = cal.select("date", F.col(f"{freq}_exec").alias("_d")).where("_d is not null")
    c = hist.join(F.broadcast(ex), "date").join(weights.withColumnRenamed("date", "_d"), ["series_id", "_d"])
    c = c.groupBy(*ids, "series_id").agg(F.sum(F.col("w") * F.col("ret")).alias("c"))
    w = Window.partitionBy(*ids).orderBy(F.col("c").desc(), "series_id")
    c = c.withColumn("_rn", F.row_number().over(w))
    tot = F.sum("c")
    share = lambda n: F.try_divide(F.sum(F.when(F.col("_rn") <= n, F.col("c"))), tot)
    top = F.min_by(F.struct("series_id", "c"), F.struct(-F.abs("c"), "series_id"))
    out = c.groupBy(*ids).agg(share(1).alias("top1_share"), share(3).alias("top3_share"), share(5).alias("top5_share"),
                              F.try_divide(F.sum(F.when(F.col("series_id") == F.lit(named), F.col("c"))), tot).alias("named_share"),
                              top["series_id"].alias("top_name"), F.try_divide(top["c"], tot).alias("top_name_share"))
    return out


def trailing_years(curves: DataFrame, ids: list[str], years: list[int], rows_per_year: int, ret: str = "ret") -> DataFrame:
    """Annualised return of the last n years of rows, NULL where the history is shorter."""
    rn = F.row_number().over(Window.partitionBy(*ids).orderBy(F.col("date").desc()))
    x = curves.where(F.col(ret).isNotNull()).withColumn("_rn", rn)
    agg = []
    for n in years:
        inside = F.col("_rn") <= n * rows_per_year
        agg.append(F.when(F.count_if(inside) >= n * rows_per_year,
                          F.pow(F.product(F.when(inside, 1 + F.col(ret)).otherwise(F.lit(1.0))), 1.0 / n) - 1).alias(f"ret_{n}y"))
    return x.groupBy(*ids).agg(*agg)
