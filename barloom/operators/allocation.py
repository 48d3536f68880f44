"""Weights from trailing covariance, computed on decision dates only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import discard, store
from .gram import mean_corr, pairwise
from .xsection import equal_weight, top_n

# Fixed values of the equal-risk rule: rounds at most, the move below which it stands still, the least marginal risk, the weight of a covariance
# beside the variances.
ROUNDS, STILL, LEAST_RISK, SHRINK = 60, 1e-8, 1e-14, 0.9
#: Rounds in one plan.
AT_ONCE = 6


def _live(panel: DataFrame, cal: DataFrame, freq: str, mask: str, by: list[str]) -> DataFrame:
    return panel.where(F.col(mask)).join(F.broadcast(cal.where(F.col(f"{freq}_stamp")).select("date")), "date", "left_semi").select(*by, "series_id", F.col("date").alias("stamp"))


def trailing_windows(panel: DataFrame, cal: DataFrame, freq: str, window: int, mask: str = "mask", ret: str = "ret", by: tuple[str, ...] = ()) -> DataFrame:
    """Rows ``(*by, stamp, series_id, pos, ret)``: the last ``window`` returns of every name live on each decision date.

    A return belongs to the decisions of the next ``window`` rows, so it is copied once per decision that reads it. ``by`` names columns of the panel
    (a basket) within which names are compared.
    """
    by = list(by)
    stamps = cal.where(F.col(f"{freq}_stamp")).select(F.col("date").alias("stamp"), F.col("pos").alias("_sp"))
    stamps = stamps.select("stamp", F.explode(F.sequence(F.greatest(F.col("_sp") - window + 1, F.lit(0)), F.col("_sp"))).alias("pos"))
    hist = panel.where(F.col(ret).isNotNull()).select(*by, "series_id", "pos", F.col(ret).alias("ret"))
    return hist.join(F.broadcast(stamps), "pos").join(_live(panel, cal, freq, mask, by), [*by, "series_id", "stamp"])


def enough_history(windows: DataFrame, window: int, by: tuple[str, ...] = ()) -> DataFrame:
    """Drop names with fewer than ``max(21, window // 2)`` returns in the window."""
    need = max(21, window // 2)
    return windows.withColumn("_n", F.count("*").over(Window.partitionBy(*by, "stamp", "series_id"))).where(F.col("_n") >= need).drop("_n")


def trailing_covariance(panel: DataFrame, cal: DataFrame, freq: str, window: int, by: tuple[str, ...] = ()) -> DataFrame:
    """Covariance and correlation of every pair of live names per decision date: ``(*by, stamp, a, b, n, cov, corr)``."""
    return pairwise(enough_history(trailing_windows(panel, cal, freq, window, by=by), window, by), [*by, "stamp"], "series_id", "pos", "ret")


def equal_marginal_risk(cov: DataFrame, keys: list[str]) -> DataFrame:
    """``(*keys, id, w, step)`` from covariance rows ``(*keys, a, b, cov)`` with a <= b: weights are divided by their marginal risks until they stand still.

    ``step`` is the last move. For some matrices the rounds swing instead of settling; their last weights then depend on the order of sums.

    A key needs two names and a finite covariance for each pair. A round joins the covariance rows with the weights and sums them up by name, so no
    task holds a matrix; what meets by key is its vector of weights. Keys that stand still, or whose round has no positive finite sum (then they get
    equal weights), keep their weights. Rounds are written now and then, so the plan stays short.
    """
    spark = cov.sparkSession
    whole = cov.groupBy(*keys).agg(F.count_if(F.col("a") == F.col("b")).alias("n"), F.count("*").alias("pairs"), F.bool_and(F.coalesce(F.abs("cov") < float("inf"), F.lit(False)) & ~F.isnan("cov")).alias("ok"))
    whole = whole.where("n >= 2 and ok and 2 * pairs = n * (n + 1)").select(*keys, "n")
    m = cov.join(whole, keys).select(*keys, "n", "a", "b", F.when(F.col("a") == F.col("b"), F.col("cov")).otherwise(F.col("cov") * SHRINK).alias("c"))
    m, m_path = store(m.union(m.where("a <> b").select(*keys, "n", F.col("b").alias("a"), F.col("a").alias("b"), "c")), "risk")
    w = m.where("a = b").select(*keys, F.col("a").alias("b"), (1 / F.col("n")).alias("w"), F.lit(None).cast("double").alias("w_before"), F.lit(True).alias("moving"))
    path, done = None, 0
    while done < ROUNDS:
        for _ in range(min(AT_ONCE, ROUNDS - done)):
            w, done = _round(m, w, keys), done + 1
        w, new = store(w, "risk-weights")
        if path:
            discard(spark, path)
        path = new
        if w.where("moving").isEmpty():
            break
    discard(spark, m_path)
    return w.select(*keys, F.col("b").alias("id"), "w", F.abs(F.col("w") - F.col("w_before")).alias("step"))


def _round(m: DataFrame, w: DataFrame, keys: list[str]) -> DataFrame:
    own = lambda c: F.max(F.when(F.col("a") == F.col("b"), F.col(c))).alias(c)
    risk = m.join(w, [*keys, "b"]).groupBy(*keys, "a").agg(F.sum(F.col("c") * F.col("w")).alias("risk"), own("w"), own("w_before"), own("moving"))
    each = Window.partitionBy(*keys)
    raw = F.col("w") / F.when(F.abs("risk") < LEAST_RISK, F.lit(LEAST_RISK)).otherwise(F.col("risk"))
    x = risk.withColumn("raw", raw).withColumns({"all": F.sum("raw").over(each), "n": F.count("*").over(each), "step": F.max(F.abs(F.col("w") - F.col("w_before"))).over(each)})
    still: Column = ~F.col("moving") | F.coalesce(F.col("step") < STILL, F.lit(False))
    bad = ~(F.coalesce((F.col("all") > 0) & (F.col("all") < float("inf")), F.lit(False)))
    nxt = F.when(still, F.col("w")).when(bad, 1 / F.col("n")).otherwise(F.col("raw") / F.col("all"))
    return x.select(*keys, F.col("a").alias("b"), nxt.alias("w"), F.when(~still & bad, nxt).otherwise(F.col("w")).alias("w_before"), (~still & ~bad).alias("moving"))


def equal_risk_weights(panel: DataFrame, cal: DataFrame, freq: str, window: int, by: tuple[str, ...] = ()) -> DataFrame:
    """Equal-risk-contribution weights ``(*by, series_id, date, w, step)`` per decision date, over all names or each basket of ``by``.

    Dates without a usable covariance fall back to equal weights of the live names. ``step`` is the rule's last move.
    """
    by = list(by)
    solved = equal_marginal_risk(trailing_covariance(panel, cal, freq, window, tuple(by)).select(*by, "stamp", "a", "b", "cov"), [*by, "stamp"])
    solved = solved.select(*by, F.col("id").alias("series_id"), F.col("stamp").alias("date"), "w", "step")
    live = _live(panel, cal, freq, "mask", by).withColumnRenamed("stamp", "date")
    rest = live.join(solved.select(*by, "date").distinct(), [*by, "date"], "left_anti")
    return solved.unionByName(equal_weight(rest, key=[*by, "date"] if by else "date").select(*by, "series_id", "date", "w", F.lit(0.0).alias("step")))


def least_correlated(panel: DataFrame, cal: DataFrame, freq: str, window: int, n: int) -> DataFrame:
    """Equal weights of the ``n`` live names with the lowest average correlation to all others, per decision date."""
    m = mean_corr(enough_history(trailing_windows(panel, cal, freq, window), window), ["stamp"], "series_id", "pos", "ret")
    m = m.select(F.col("id").alias("series_id"), F.col("stamp").alias("date"), "n_others", "mean_corr")
    picked = equal_weight(top_n(m.where("n_others > 0"), "mean_corr", n, ascending=True), few=True).select("series_id", "date", "w")
    live = panel.where("mask").join(F.broadcast(cal.where(F.col(f"{freq}_stamp")).select("date")), "date", "left_semi").select("series_id", "date")
    rest = live.join(picked.select("date").distinct(), "date", "left_anti")
    return picked.unionByName(equal_weight(rest).select("series_id", "date", "w"))
