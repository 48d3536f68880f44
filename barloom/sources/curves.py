"""Strategy return curves and registry records derived from the order lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import stats as S
from ..functions.mathx import with_probabilistic_sharpe
from ..operators import metrics as M
from ..operators.ranking import stable_hash
from ..session import materialize
from .tables import week_of, table

PERIODS = [("early", "1995-01-01", "1996-12-31"), ("mid", "1997-01-01", "1998-12-31"), ("bull", "1999-01-01", "1999-12-31"), ("ai_rally", "2000-01-01", "2001-12-31")]
STRESS = 0.0008
HOLDOUT_START = "1999-11-05"


def strategy_curves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(strategy, family, cls, line, date, ret, turnover)`` per week.

    Order lines are reduced to (flag, status, line number, week) sums first; the strategies are rollups of those few rows.
    """
    cell = table(spark, sf_dir, "lineitem").groupBy("l_returnflag", "l_linestatus", "l_linenumber", week_of().alias("date")).agg(
        F.sum("l_extendedprice").alias("p"), F.count("*").alias("n"), F.sum("l_quantity").alias("q"))
    line = F.col("l_linenumber").cast("string")
    cls = F.when(F.col("l_returnflag") == "A", "Growth").when(F.col("l_returnflag") == "N", "Value").otherwise("Rotate")
    args = F.when(F.col("l_linenumber") <= 3, F.concat(F.lit("basket=T"), (F.col("l_linenumber") % 3).cast("string"), F.lit(",line="), line)) \
        .when(F.col("l_linenumber") <= 5, F.concat(F.lit("basket=None,line="), line)).otherwise(F.concat(F.lit("line="), line, F.lit(",ticker=X"), line))
    own = F.struct(F.concat(cls, F.lit("("), args, F.lit(")")).alias("strategy"), F.lower(cls).alias("family"), cls.alias("cls"), F.col("l_linenumber").alias("line"))
    mkt = F.struct(F.when(F.col("l_linestatus") == "O", "BuyAndHold(ticker=SPY)").otherwise("EqualWeightUniverse(rebalance=ME)").alias("strategy"), F.lit("benchmark").alias("family"),
                   F.when(F.col("l_linestatus") == "O", "BuyAndHold").otherwise("EqualWeightUniverse").alias("cls"), F.lit(0).alias("line"))
    x = cell.select("date", "p", "n", "q", F.inline(F.array(own, mkt)))
    x = x.groupBy("strategy", "family", "cls", "line", "date").agg((F.sum("p") / F.sum("n")).alias("px"), F.sum("q").alias("qty"))
    w = Window.partitionBy("strategy").orderBy("date")
    x = x.withColumns({"ret": (F.try_divide("px", F.lag("px").over(w)) - 1) / 10, "turnover": F.coalesce(F.least(F.abs(F.try_divide("qty", F.lag("qty").over(w)) - 1), F.lit(1.0)) / 10, F.lit(0.0))})
    return x.select("strategy", "family", "cls", "line", "date", "ret", "turnover").where("ret is not null")


def with_benchmark(curves: DataFrame, name: str = "BuyAndHold(ticker=SPY)") -> DataFrame:
    """Attach the benchmark's return of each date (one row per date).

    The curves are written first: sums that are computed twice can differ in their last bits, and the benchmark would deviate from itself.
    """
    curves = materialize(curves, "curves")
    b = curves.where(F.col("strategy") == name).select("date", F.col("ret").alias("bench"))
    return curves.join(F.broadcast(b), "date", "left")


def scenario_curves(curves: DataFrame) -> DataFrame:
    """Base and stressed versions of every curve."""
    s = F.array(F.struct(F.lit("base").alias("scenario"), F.lit(0.0).alias("_c")), F.struct(F.lit("stressed").alias("scenario"), F.lit(STRESS).alias("_c")))
    x = curves.select("*", F.inline(s))
    return x.withColumn("ret", F.col("ret") - F.col("_c")).drop("_c")


def registry(curves: DataFrame) -> DataFrame:
    """One nested record per (strategy, scenario), two failed runs and an older cohort. ``curves`` is read twice."""
    c = scenario_curves(curves).withColumn("split", F.when(F.col("date") < F.to_date(F.lit(HOLDOUT_START)), "dev").otherwise("holdout"))
    ids = ["strategy", "family", "cls", "line", "scenario"]
    m = M.drawdowns(c, [*ids, "split"]).groupBy(*ids, "split").agg(S.sharpe("ret").alias("sharpe"), S.cagr("ret").alias("cagr"), M.max_drawdown().alias("max_drawdown"),
                                                                  (F.avg("turnover") * 252).alias("_to"), F.count("ret").alias("n"), F.avg("ret").alias("_m"), F.stddev_samp("ret").alias("_sd"),
                                                                  F.skewness("ret").alias("_g3"), (F.kurtosis("ret") + 3).alias("_g4"))
    m = with_probabilistic_sharpe(m, "psr", "n", "_m", "_sd", "_g3", "_g4")
    m = m.withColumn("calmar", F.when(F.col("max_drawdown") < 0, F.col("cagr") / F.abs("max_drawdown")))
    met = F.struct("sharpe", "cagr", "calmar", "max_drawdown")
    side = lambda s, e: F.max(F.when(F.col("split") == s, e))
    r = m.groupBy(*ids).agg(side("dev", met).alias("metrics_dev"), side("holdout", met).alias("metrics_holdout"), side("dev", F.col("psr")).alias("psr_dev"), side("dev", F.col("_to")).alias("annual_turnover"))
    p = M.period_metrics(c, ids, PERIODS, min_rows=40).groupBy(*ids).agg(F.sort_array(F.collect_list(F.struct("period", "sharpe"))).alias("subperiods"))
    r = r.join(p, ids, "left")
    failed = (F.col("cls") == "Rotate") & (F.col("line") == 5)
    share = 0.3 + 0.05 * F.col("line")
    params = F.create_map(F.lit("line"), F.col("line").cast("string"), F.lit("mode"), F.lit("weekly"), F.lit("size"), F.lit("5"), F.lit("skip"), F.lit("4"))
    base = dict(
        status=F.when(failed, "failed").otherwise("ok"), data_mode=F.lit("synthetic"), universe_hash=F.when(~failed, "u2"), freeze_version=F.when(~failed, "v2"),
        concentration=F.struct(share.alias("top_name_share")), spec=F.struct(F.col("cls").alias("class"), F.col("family").alias("family"), params.alias("params")),
        timestamp=(F.to_timestamp(F.lit("2024-03-01 00:00:00")) + F.make_interval(hours=F.col("line"), days=F.length("cls"))).cast("timestamp_ntz"))
    new = r.withColumns(base)
    new = new.withColumns({"family": F.when(~failed, F.col("family")), "metrics_dev": F.when(~failed, F.col("metrics_dev")), "metrics_holdout": F.when(~failed, F.col("metrics_holdout"))})
    old = new.where("status = 'ok' and cls = 'Growth'").withColumns({"universe_hash": F.lit("u1"), "freeze_version": F.lit("v1"), "timestamp": F.col("timestamp") - F.expr("interval 40 days")})
    x = new.unionByName(old)
    return x.withColumn("id", stable_hash(F.struct("strategy", "scenario", "universe_hash")))
