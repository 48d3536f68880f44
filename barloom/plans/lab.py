"""Strategy laboratory: pairs of the best curves, blended half and half."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import stats as S
from ..operators import metrics as M
from ..operators.ranking import class_of
from ..operators.returns import blend


def blend_report(curves: DataFrame, top: int = 6) -> DataFrame:
    """Every pair of different classes among the ``top`` best Sharpe ratios: does the blend beat both?

    The pairs come from one ``top``-sized array, so their number is fixed by the report and not by the number of curves.
    """
    s = curves.groupBy("strategy").agg(S.sharpe("ret").alias("s")).where("s is not null").withColumn("cls", class_of())
    best = s.orderBy(F.col("s").desc(), "strategy").limit(top)
    arr = best.agg(F.array_sort(F.collect_list(F.struct((-F.col("s")).alias("k"), "strategy", "cls", "s"))).alias("t"))
    arr = arr.select("t", F.posexplode("t").alias("i", "x"))
    pairs = arr.select(F.col("x").alias("a"), F.explode(F.slice("t", F.col("i") + 2, F.lit(top))).alias("b")).where("a.cls <> b.cls")
    pairs = pairs.select(F.concat(F.col("a.strategy"), F.lit(" + "), F.col("b.strategy")).alias("blend"), F.col("a.strategy").alias("a"), F.col("b.strategy").alias("b"),
                         F.col("a.s").alias("sharpe_a"), F.col("b.s").alias("sharpe_b"))
    members = pairs.select("blend", F.explode(F.array("a", "b")).alias("strategy"), F.lit(0.5).alias("weight"))
    mix = M.drawdowns(blend(curves, members), ["blend"]).groupBy("blend").agg(S.sharpe("ret").alias("sharpe_blend"), S.cagr("ret").alias("cagr_blend"), M.max_drawdown().alias("max_dd_blend"))
    mo = M.resample_compound(curves, ["strategy"], "me")
    both = members.join(pairs.select("blend", "a"), "blend").join(mo, "strategy").groupBy("blend", "period").agg(
        F.max(F.when(F.col("strategy") == F.col("a"), F.col("ret"))).alias("x"), F.max(F.when(F.col("strategy") != F.col("a"), F.col("ret"))).alias("y"))
    corr = both.where("x is not null and y is not null").groupBy("blend").agg(F.corr("x", "y").alias("corr_monthly"))
    return pairs.join(mix, "blend").join(corr, "blend").withColumn("blend_beats_both", F.col("sharpe_blend") > F.greatest("sharpe_a", "sharpe_b"))


def family_independence(curves: DataFrame, bench: str, min_classes: int = 1) -> DataFrame:
    """Monthly correlation of each class's best curve to a benchmark curve, and its median per family."""
    s = curves.groupBy("strategy", "family").agg(S.sharpe("ret").alias("s")).withColumn("cls", class_of())
    w = Window.partitionBy("cls").orderBy(F.col("s").desc_nulls_last(), "strategy")
    best = s.where("family <> 'benchmark'").withColumn("_rn", F.row_number().over(w)).where("_rn = 1").select("strategy", "cls", "family")
    mo = M.resample_compound(curves, ["strategy"], "me")
    b = mo.where(F.col("strategy") == bench).select("period", F.col("ret").alias("b"))
    c = mo.join(best, "strategy").join(F.broadcast(b), "period").groupBy("cls", "family").agg(F.corr("ret", "b").alias("corr"))
    return c.where("corr is not null").groupBy("family").agg(F.percentile("corr", F.lit(0.5)).alias("median_corr"), F.count("*").alias("classes")).where(F.col("classes") >= min_classes)
