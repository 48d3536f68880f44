"""Walk-forward selection, bootstrap and permutation statistics, and multiple-testing corrections.

Draws are hashes of (seed, replicate, position), so results do not change with retries, partitions or executors. Curves are
arrays with running sums; a replicate is folded from them and never becomes rows.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import stats as S
from ..functions.mathx import draw_key, uniform_from_key, with_expected_max_sharpe, with_probabilistic_sharpe


def _month_start(c: Column) -> Column:
    """First month start on or after a date."""
    return F.when(F.dayofmonth(c) == 1, c).otherwise(F.add_months(F.trunc(c, "month"), 1))


def step_number(date: Column, start: Column, step_months: int) -> Column:
    """0 before ``start``; then the number of the step window a date falls in (windows start on month starts)."""
    months = (F.year(date) - F.year(start)) * 12 + F.month(date) - F.month(start)
    return F.when(date < start, 0).otherwise(F.floor(months / step_months) + 1).cast("int")


def walk_forward(curves: DataFrame, group: list[str], variant: str, min_train_months: int, step_months: int,
                 ret: str = "ret") -> tuple[DataFrame, DataFrame]:
    """(composite out-of-sample returns, selection log) per group.

    The score of a variant on all rows before a step is the running Sharpe at its last earlier row, so one ordered pass per
    variant replaces the join of every step with its whole past. The best score wins, the first variant on ties.
    """
    x = curves.where(F.col(ret).isNotNull()).select(*group, variant, "date", F.col(ret).alias("ret"))
    lo = x.groupBy(*group).agg(F.min("date").alias("_lo"))
    x = x.join(lo, group).withColumn("_s0", _month_start(F.add_months("_lo", min_train_months)))
    x = x.withColumn("_k", step_number(F.col("date"), F.col("_s0"), step_months))
    run = Window.partitionBy(*group, variant).orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    sd = F.stddev_samp("ret").over(run)
    x = x.withColumn("_score", F.when(sd > 0, F.avg("ret").over(run) / sd * S.ROOT))
    ends = x.groupBy(*group, variant, "_k").agg(F.max_by("_score", "date").alias("_end"), F.max("_s0").alias("_s0"))
    prior = Window.partitionBy(*group, variant).orderBy("_k")
    ends = ends.withColumn("_train", F.lag("_end").over(prior)).where("_k > 0 and _train is not null")
    pick = ends.groupBy(*group, "_k").agg(F.min_by(F.struct(F.col(variant).alias("v"), F.col("_train").alias("t")), F.struct(-F.col("_train"), F.col(variant))).alias("_b"),
                                         F.max("_s0").alias("_s0"))
    log = pick.select(*group, F.add_months("_s0", (F.col("_k") - 1) * step_months).alias("step"), F.col("_b.v").alias("selected"), F.col("_b.t").alias("train_score"), "_k")
    comp = x.join(log.select(*group, F.col("selected").alias(variant), "_k"), [*group, variant, "_k"]).select(*group, "date", variant, "ret")
    return comp, log.drop("_k")


def numbered(curves: DataFrame, ids: list[str], ret: str = "ret") -> DataFrame:
    """Non-null rows with a zero-based row number ``i`` and the row count ``n`` per curve."""
    x = curves.where(F.col(ret).isNotNull())
    return x.select(*ids, F.col(ret).alias("ret"), (F.row_number().over(Window.partitionBy(*ids).orderBy("date")) - 1).alias("i"),
                    F.count("*").over(Window.partitionBy(*ids)).cast("int").alias("n"))


def _sharpe_from_sums(n: Column, s: Column, q: Column) -> Column:
    var = (q - s * s / n) / (n - 1)
    return F.when(var > 0, s / n / F.sqrt(var) * S.ROOT)


def _interval(draws: DataFrame, ids: list[str], level: float) -> DataFrame:
    a = (1 - level) / 2
    return draws.groupBy(*ids).agg(F.percentile("stat", F.lit(a)).alias("lo"), F.percentile("stat", F.lit(1 - a)).alias("hi"), F.count("stat").alias("n_boot"))


#: Replicates that are computed from one copy of a curve.
AT_ONCE = 50


def _arrays(curves: DataFrame, ids: list[str], ret: str) -> DataFrame:
    """One row per curve: its returns in order (``_r``), their number, and running sums from 0 of them and their squares (``_s``, ``_q``).

    A curve has no more rows than the calendar, so its arrays are bounded.
    """
    x = numbered(curves, ids, ret)
    run = Window.partitionBy(*ids).orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    x = x.withColumns({"_a": F.sum("ret").over(run), "_b": F.sum(F.col("ret") * F.col("ret")).over(run)})
    x = x.groupBy(*ids).agg(S.sharpe("ret").alias("point"), F.count("ret").cast("int").alias("n"), F.sort_array(F.collect_list(F.struct("i", "ret", "_a", "_b"))).alias("_x"))
    from_zero = lambda c: F.concat(F.array(F.lit(0.0)), F.transform("_x", lambda r: r[c]))
    return x.select(*ids, "point", "n", F.transform("_x", lambda r: r["ret"]).alias("_r"), from_zero("_a").alias("_s"), from_zero("_b").alias("_q"))


def _replicates(rows: DataFrame, ids: list[str], count: int, one: Callable[[Column], Column]) -> DataFrame:
    """(ids, stat): ``one`` of each replicate number. A replicate never becomes rows; what moves is a copy of the curve for ``AT_ONCE`` of them."""
    parts = rows.withColumn("_c", F.explode(F.sequence(F.lit(0), F.lit((count - 1) // AT_ONCE)))).repartition(*ids, "_c")
    mine = F.sequence(F.col("_c") * AT_ONCE, F.least((F.col("_c") + 1) * AT_ONCE, F.lit(count)) - 1)
    return parts.select(*ids, F.explode(F.transform(mine, one)).alias("stat"))


def _draw(seed: int, tag: list[str], keys: list[str], *more: Column) -> Column:
    return uniform_from_key(F.lit(seed), *[F.lit(t) for t in tag], *[F.col(c) for c in keys], *more)


def _of_sums(z: Column) -> Column:
    return _sharpe_from_sums(F.col("n"), z["s"], z["q"])


def block_bootstrap(curves: DataFrame, ids: list[str], n_boot: int = 2000, block: int = 21, seed: int = 0, level: float = 0.90,
                    ret: str = "ret", draw: list[str] | None = None) -> DataFrame:
    """Moving-block bootstrap interval of the Sharpe ratio: ``(ids, point, lo, hi, n_boot)``; curves under two blocks get NULLs.

    A block's first and second moments are differences of running sums, so a replicate costs a step for each block; its last block is cut to the
    curve's length. ``draw`` names the columns that key the draws (``ids`` if not given).
    """
    x, keys = _arrays(curves, ids, ret), draw or ids
    blocks = F.ceil(F.col("n") / block).cast("int")
    cut = F.col("n") - (blocks - 1) * block

    def one(rep: Column) -> Column:
        def add(z: Column, k: Column) -> Column:
            a = F.floor(_draw(seed, [], keys, rep, k) * (F.col("n") - block)).cast("int")
            size = F.when(k == blocks - 1, cut).otherwise(block)
            part = lambda c: F.get(c, a + size) - F.get(c, a)
            return F.struct((z["s"] + part("_s")).alias("s"), (z["q"] + part("_q")).alias("q"))

        return F.aggregate(F.sequence(F.lit(0), blocks - 1), F.struct(F.lit(0.0).alias("s"), F.lit(0.0).alias("q")), add, _of_sums)

    long = F.col("n") >= 2 * block
    d = _replicates(x.where(long), ids, n_boot, one)
    return x.select(*ids, F.when(long, F.col("point")).alias("point")).join(_interval(d, ids, level), ids, "left")


def stationary_bootstrap(curves: DataFrame, ids: list[str], n_boot: int = 2000, mean_block: int = 21, seed: int = 0, level: float = 0.90,
                         ret: str = "ret") -> DataFrame:
    """Stationary bootstrap interval of the Sharpe ratio: geometric block lengths and wrap-around.

    A replicate is a row of stretches, each with a drawn start and a geometric length by inversion, until the curve's length is reached; a stretch's
    moments are differences of running sums.
    """
    x = _arrays(curves, ids, ret)
    n = F.col("n")

    def one(rep: Column) -> Column:
        def add(z: Column, k: Column) -> Column:
            more = 1 + F.floor(F.ln(1 - _draw(seed, ["r"], ids, rep, k)) / F.lit(math.log(1 - 1 / mean_block)))
            size = F.least(more, (n - z["t"]).cast("bigint")).cast("int")
            a = F.floor(_draw(seed, ["s"], ids, rep, k) * n).cast("int")
            whole = lambda c: F.get(c, F.least(a + size, n)) - F.get(c, a) + F.get(c, F.greatest(a + size - n, F.lit(0)))
            nxt = F.struct((z["t"] + size).alias("t"), (z["s"] + whole("_s")).alias("s"), (z["q"] + whole("_q")).alias("q"))
            return F.when(z["t"] < n, nxt).otherwise(z)

        start = F.struct(F.lit(0).alias("t"), F.lit(0.0).alias("s"), F.lit(0.0).alias("q"))
        # Twice the expected number of stretches nearly always suffices; where it doesn't, as many more follow as there can be.
        usual = F.least(n, F.ceil(n * 2 / mean_block).cast("int") + 50)
        some = F.aggregate(F.sequence(F.lit(0), usual - 1), start, add)
        return F.get(F.transform(F.array(some), lambda z: _of_sums(F.when(z["t"] < n, F.aggregate(F.sequence(usual, n), z, add)).otherwise(z))), F.lit(0))

    long = n >= 2 * mean_block
    d = _replicates(x.where(long), ids, n_boot, one)
    return x.select(*ids, F.when(long, F.col("point")).alias("point")).join(_interval(d, ids, level), ids, "left")


def permutation_drawdowns(curves: DataFrame, ids: list[str], n_paths: int = 2000, seed: int = 0, ret: str = "ret", draw: list[str] | None = None) -> DataFrame:
    """Drawdown distribution over shuffled orders of a curve: median, 5 % quantile and the share of paths better than observed.

    A path sorts the curve by drawn numbers and folds it with (growth, peak, deepest drawdown). ``draw`` names the columns that key the draws.
    """
    from .metrics import drawdowns

    x, keys = _arrays(curves, ids, ret), draw or ids

    def one(path: Column) -> Column:
        order = F.sort_array(F.transform("_r", lambda r, i: F.struct(draw_key(F.lit(seed), *[F.col(c) for c in keys], path, i).alias("u"), i.alias("i"), r.alias("r"))))

        def step(z: Column, x: Column) -> Column:
            e = z["e"] * (1 + x["r"])
            top = F.greatest(z["top"], e)
            return F.struct(e.alias("e"), top.alias("top"), F.least(z["dd"], F.try_divide(e, top) - 1).alias("dd"))

        start = F.struct(F.lit(1.0).alias("e"), F.lit(None).cast("double").alias("top"), F.lit(None).cast("double").alias("dd"))
        return F.aggregate(order, start, step, lambda z: z["dd"])

    m = _replicates(x, ids, n_paths, one).withColumnRenamed("stat", "mdd")
    seen = drawdowns(curves, ids, ret).groupBy(*ids).agg(F.min("drawdown").alias("observed"))
    return m.join(seen, ids).groupBy(*ids).agg(
        F.percentile("mdd", F.lit(0.5)).alias("mdd_median"), F.percentile("mdd", F.lit(0.05)).alias("mdd_p95"),
        F.avg((F.col("mdd") > F.col("observed")).cast("double")).alias("order_luck"), F.max("observed").alias("observed"))


def trial_sharpes(curves: DataFrame, ids: list[str], ret: str = "ret") -> DataFrame:
    return curves.where(F.col(ret).isNotNull()).groupBy(*ids).agg(S.sharpe(ret).alias("sharpe"), F.count(ret).alias("n_days"))


def battery(trials: DataFrame, group: list[str], failed: DataFrame | None = None) -> DataFrame:
    """Expected best annual Sharpe under no skill, from every trial of a group; failed trials count as zero Sharpe."""
    t = trials.select(*group, "sharpe")
    if failed is not None:
        t = t.unionByName(failed.select(*group, F.lit(0.0).alias("sharpe")))
    b = t.where("sharpe is not null").groupBy(*group).agg(F.count("*").alias("n_trials"), F.var_pop(F.col("sharpe") / S.ROOT).alias("_v"))
    return with_expected_max_sharpe(b, "expected_max", "n_trials", "_v").drop("_v")


def deflated_sharpe(curves: DataFrame, group: list[str], variant: str, failed: DataFrame | None = None, ret: str = "ret") -> DataFrame:
    """Probability that each variant's true Sharpe beats the expected best of its whole group of trials."""
    ids = [*group, variant]
    b = battery(trial_sharpes(curves, ids, ret), group, failed)
    m = curves.where(F.col(ret).isNotNull()).groupBy(*ids).agg(
        F.count(ret).alias("n"), F.avg(ret).alias("_m"), F.stddev_samp(ret).alias("_sd"), F.skewness(ret).alias("_g3"), (F.kurtosis(ret) + 3).alias("_g4"))
    x = m.join(b, group).withColumn("_bench", F.when(F.col("n_trials") < 2, 0.0).otherwise(F.col("expected_max")))
    return with_probabilistic_sharpe(x, "dsr", "n", "_m", "_sd", "_g3", "_g4", "_bench").select(*ids, "n_trials", "expected_max", "dsr")


def parameter_sensitivity(trials: DataFrame, group: list[str], variant: str, stat: str = "sharpe") -> DataFrame:
    """Rank of each variant by its statistic and the deviation over it and its two neighbours in that order."""
    w = Window.partitionBy(*group).orderBy(F.col(stat).desc_nulls_last(), F.col(variant))
    return trials.withColumns({"rank": F.row_number().over(w), "neighbor_stability": F.stddev_samp(stat).over(w.rowsBetween(-1, 1))})
