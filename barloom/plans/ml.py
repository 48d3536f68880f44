"""Walk-forward ridge ranking: expanding refits, a purge gap and scaling fitted on the training rows only."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import rolling as R
from ..operators.resample import _month_start, step_number
from .signals import Market, _pick, signal


def feature_columns(week: bool = False) -> dict:
    """The seven features: short, middle and long momentum, 12-1 momentum, reversal, volatility and distance from trend."""
    s, m, h, y, v, t, r = (4, 13, 26, 52, 13, 40, 1) if week else (21, 63, 126, 252, 63, 200, 5)
    return {
        "f_mom_s": R.momentum("adj_close", s), "f_mom_m": R.momentum("adj_close", m), "f_mom_h": R.momentum("adj_close", h), "f_mom_ys": R.momentum("adj_close", y, s),
        "f_rev": -R.momentum("adj_close", r), "f_vol": R.realized_vol("ret", v), "f_dist": F.try_divide("adj_close", R.sma("adj_close", t)) - 1,
    }


def refit_calendar(cal: DataFrame, refit_months: int, horizon: int) -> DataFrame:
    """Each date with the refit it is predicted by (``k``) and the first refit whose training set its row enters (``bucket``).

    A row enters refit k when it lies more than ``horizon + 1`` rows before the first predicted row, so no label reaches it.
    """
    first = cal.select(_month_start(F.min("date")).alias("_s0"))
    x = cal.select("date", "pos").join(F.broadcast(first))
    x = x.withColumn("k", step_number(F.col("date"), F.col("_s0"), refit_months))
    return x.select("date", "k", F.col("pos").alias("_p"), (F.lead("k", horizon + 1).over(Window.orderBy("pos")) + 1).alias("bucket"))


def ridge_scores(panel: DataFrame, cal: DataFrame, features: dict, horizon: int, alpha: float, refit_months: int, min_train: int, min_rows: int = 500) -> DataFrame:
    """Out-of-sample predictions ``(series_id, date, mask, score)``.

    One aggregation gives the moment sums of every training bucket; their running totals are the expanding training sets, and each
    refit solves one 7 x 7 system from its totals.
    """
    names = sorted(features)
    x = panel.withColumns(features).withColumn("_y", F.try_divide(F.lead("adj_close", horizon).over(R.order_only()), F.col("adj_close")) - 1)
    x = x.select("series_id", "date", "mask", "_y", *names).join(F.broadcast(refit_calendar(cal, refit_months, horizon)), "date")
    complete = F.lit(True)
    for n in names:
        complete = complete & F.col(n).isNotNull()
    x = x.where(complete)
    train = x.where("mask and _y is not null and bucket is not null")
    sums = {"s_n": F.count("*").cast("double"), "s_y": F.sum("_y")}
    for i, a in enumerate(names):
        sums[f"s_{i}"] = F.sum(a)
        sums[f"y_{i}"] = F.sum(F.col(a) * F.col("_y"))
        for j in range(i, len(names)):
            sums[f"q_{i}_{j}"] = F.sum(F.col(a) * F.col(names[j]))
    g = train.groupBy(F.col("bucket").alias("k")).agg(*[c.alias(n) for n, c in sums.items()])
    steps = x.select("k").distinct().join(refit_calendar(cal, refit_months, horizon).groupBy("k").agg(F.min("_p").alias("_start")), "k")
    g = steps.join(g, "k", "full")
    run = Window.orderBy("k").rowsBetween(Window.unboundedPreceding, 0)
    g = g.select("k", "_start", *[F.sum(F.coalesce(n, F.lit(0.0))).over(run).alias(n) for n in sums])
    g = g.where((F.col("k") > 0) & (F.col("_start") - 1 - horizon >= min_train) & (F.col("s_n") >= min_rows))
    p = len(names)

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for r in b.to_dict("records"):
                n = r["s_n"]
                mu = np.array([r[f"s_{i}"] for i in range(p)]) / n
                q = np.array([[r[f"q_{min(i, j)}_{max(i, j)}"] for j in range(p)] for i in range(p)]) - n * np.outer(mu, mu)
                sd = np.sqrt(np.maximum(np.diag(q) / n, 0.0))
                sd[sd == 0] = 1.0
                xy = np.array([r[f"y_{i}"] for i in range(p)]) - mu * r["s_y"]
                coef = np.linalg.solve(q / np.outer(sd, sd) + alpha * np.eye(p), xy / sd) / sd
                out.append({"k": r["k"], "b0": r["s_y"] / n - float(coef @ mu), "b": coef.tolist()})
            yield pd.DataFrame(out, columns=["k", "b0", "b"])

    beta = g.mapInPandas(solve, "k int, b0 double, b array<double>")
    x = x.join(F.broadcast(beta), "k")
    score = F.col("b0")
    for i, n in enumerate(names):
        score = score + F.col("b")[i] * F.col(n)
    return x.select("series_id", "date", "mask", score.alias("score"))


@signal
def ridge_rank(m: Market, horizon: int = 21, n: int = 6, alpha: float = 10.0, refit_months: int = 12, min_train: int = 1260, freq: str = "me", week: bool = False) -> DataFrame:
    s = ridge_scores(m.panel, m.cal, feature_columns(week), horizon, alpha, refit_months, min_train)
    return _pick(m, s.withColumnRenamed("score", "_pred"), F.col("_pred"), n, freq)
