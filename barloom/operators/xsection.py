"""Cross-sectional operators: ranks, selections and weights per date.

Weight tables are sparse: ``(series_id, date, w)`` with one row per held name and decision date; a missing row is a zero.
Ranking runs on decision dates only, so the shuffle by date carries the rebalance rows and not the whole history. No task gets all names of a
date: totals are partial sums joined back, ranks are formed by value range, and only rows behind a rank limit meet in a window of their date.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TIE = "series_id"
#: Value ranges of a date; equal values that are more than one range's worth have a range of their own.
RANGES = 128


def _keys(key) -> list[str]:
    return [key] if isinstance(key, str) else list(key)


def by(key="date", *order) -> "Window":
    w = Window.partitionBy(*_keys(key))
    return w.orderBy(*order) if order else w


def with_totals(df: DataFrame, key="date", **aggs: Column) -> DataFrame:
    """Adds aggregates over all rows of the key: partial sums before the shuffle, and one row for each key joined back.

    A date's row is broadcast, since dates are bounded; for other keys Spark chooses by size.
    """
    keys = _keys(key)
    t = df.groupBy(*keys).agg(*[c.alias(n) for n, c in aggs.items()])
    return df.join(F.broadcast(t) if len(keys) == 1 else t, keys)


def value_ranges(df: DataFrame, x: str, key="date") -> DataFrame:
    """Adds the value range ``_cell`` of a row within its key, how many rows are in it (``_m``), before it (``_before``) and in all (``_n``).

    The bounds are approximate quantiles, so a range holds a bounded share of the rows. A value that is a bound has a range of its own (an odd
    number), whose rows are all tied and need no order. Results of callers don't depend on where the bounds are.
    """
    keys = _keys(key)
    bounds = df.groupBy(*keys).agg(F.array_distinct(F.percentile_approx(x, [k / RANGES for k in range(1, RANGES)], 10 * RANGES)).alias("_bounds"))
    df = df.join(F.broadcast(bounds), keys)
    below = F.size(F.filter("_bounds", lambda c: c < F.col(x)))
    df = df.withColumn("_cell", 2 * below + F.array_contains("_bounds", F.col(x)).cast("int")).drop("_bounds")
    sizes = df.groupBy(*keys, "_cell").agg(F.count("*").alias("_m"))
    sizes = sizes.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("_cell", "_m"))).alias("_all"), F.sum("_m").alias("_n"))
    before = lambda k: F.aggregate(F.slice("_all", 1, k), F.lit(0).cast("long"), lambda s, c: s + c["_m"])
    sizes = sizes.select(*keys, "_n", F.inline(F.transform("_all", lambda c, k: F.struct(c["_cell"].alias("_cell"), c["_m"].alias("_m"), before(k).alias("_before")))))
    return df.join(F.broadcast(sizes), [*keys, "_cell"])


def xs_rank(df: DataFrame, x: str, out: str = "xs_rank", key="date") -> DataFrame:
    """Average-tie percentile rank; rows with a NULL value are dropped.

    A task ranks one value range of a date; the sizes of the ranges before it are its offset.
    """
    r = value_ranges(df.where(F.col(x).isNotNull()), x, key)
    tied = F.col("_cell") % 2 == 1
    w = Window.partitionBy(*_keys(key), "_cell", F.when(tied, F.pmod(F.xxhash64(TIE), F.lit(RANGES))).otherwise(0)).orderBy(x)
    first, last = F.when(tied, 1).otherwise(F.rank().over(w)), F.when(tied, F.col("_m")).otherwise(F.count("*").over(w))
    return r.withColumn(out, (2 * F.col("_before") + first + last) / (2 * F.col("_n"))).drop("_cell", "_m", "_before", "_n")


def with_zscores(df: DataFrame, xs: list[str], key="date") -> DataFrame:
    """Adds ``z_<x>`` for each column: its standard score against the non-null values of the date."""
    t = with_totals(df, key, **{f"_a_{x}": F.avg(x) for x in xs}, **{f"_s_{x}": F.stddev_samp(x) for x in xs})
    t = t.withColumns({f"z_{x}": F.try_divide(F.col(x) - F.col(f"_a_{x}"), F.col(f"_s_{x}")) for x in xs})
    return t.drop(*[f"_{k}_{x}" for x in xs for k in "as"])


def top_n(df: DataFrame, score: str, n: int, key="date", ascending: bool = False, tie: str = TIE) -> DataFrame:
    """The ``n`` best non-null scores per date; ties go to the first series. The rank limit is applied before the shuffle."""
    order = F.col(score).asc() if ascending else F.col(score).desc()
    return df.where(F.col(score).isNotNull()).withColumn("_rn", F.row_number().over(by(key, order, F.col(tie)))) \
        .where(F.col("_rn") <= n).drop("_rn")


def _share(sel: DataFrame, x: Column, key, out: str, few: bool) -> DataFrame:
    if few:
        return sel.withColumn(out, x / F.sum(x).over(by(key)))
    return with_totals(sel, key, _all=F.sum(x)).withColumn(out, x / F.col("_all")).drop("_all")


def equal_weight(sel: DataFrame, key="date", out: str = "w", few: bool = False) -> DataFrame:
    """``few`` says that a date has only the rows that a rank limit left, so they are weighed where they were ranked."""
    return _share(sel, F.lit(1.0), key, out, few)


def score_weight(sel: DataFrame, score: str, key="date", out: str = "w", few: bool = False) -> DataFrame:
    """Positive scores normalised to one; rows without a positive score get no weight."""
    return _share(sel.where(F.col(score) > 0), F.col(score), key, out, few)


def inverse_vol_weight(sel: DataFrame, vol: str, key="date", out: str = "w", few: bool = False) -> DataFrame:
    iv = F.try_divide(F.lit(1.0), F.col(vol))
    return _share(sel.where(iv.isNotNull()), iv, key, out, few)


def cap_weights(weights: DataFrame, cap: float, key="date", w: str = "w", total: float = 1.0) -> DataFrame:
    """Cap each weight and spread the excess pro rata below the cap; what cannot be placed stays unallocated.

    Closed form: with the weights in descending order the first k are capped, where k is the smallest number for which the
    next weight, scaled up to absorb the excess, stays within the cap. A date's weights sum up to ``total`` at most (more is an
    error), so k is at most total / cap, and only so many weights of a date are put in order.
    """
    keys = _keys(key)
    sums = weights.groupBy(*keys).agg(F.sum(w).alias("_tot"))
    sums = sums.withColumn("_tot", F.when(F.col("_tot") <= total + 1e-9, F.col("_tot")).otherwise(F.raise_error(F.lit("weights of a date exceed the stated total")).cast("double")))
    order = by(key, F.col(w).desc(), F.col(TIE))
    top = top_n(weights.select(*keys, TIE, w), w, int(total / cap) + 2, key).join(F.broadcast(sums) if len(keys) == 1 else sums, keys)
    top = top.withColumns({"_rn": F.row_number().over(order), "_cum": F.sum(w).over(order.rowsBetween(Window.unboundedPreceding, 0))})
    scale = F.try_divide(F.col("_tot") - (F.col("_rn") - 1) * cap, F.col("_tot") - (F.col("_cum") - F.col(w)))
    top = top.withColumn("_s", scale)
    fits = F.coalesce(F.col("_s") * F.col(w) <= cap + 1e-12, F.lit(False))
    level = top.groupBy(*keys).agg(F.min(F.when(fits, F.struct("_rn", "_s")))["_s"].alias("_scale"))
    x = weights.join(F.broadcast(level) if len(keys) == 1 else level, keys)
    return x.withColumn(w, F.when(F.col("_scale").isNull(), F.lit(cap)).otherwise(F.least(F.lit(cap), F.col(w) * F.col("_scale")))).drop("_scale")


def two_books(sel: DataFrame, score: str, n: int, gross: float = 1.0, key="date") -> DataFrame:
    """Long the top ``n`` and short the bottom ``n``; names in both books drop out and both books must exist.

    Each book is a rank limit, so a date has 2n rows at most from there on.
    """
    x = sel.where(F.col(score).isNotNull())
    x = top_n(x, score, n, key).withColumn("_long", F.lit(True)).unionByName(top_n(x, score, n, key, ascending=True).withColumn("_long", F.lit(False)))
    x = x.withColumn("_twice", F.count("*").over(by([*_keys(key), TIE]))).where("_twice = 1")
    x = x.withColumns({"_nl": F.count_if("_long").over(by(key)), "_ns": F.count_if(~F.col("_long")).over(by(key))})
    x = x.where("_nl > 0 and _ns > 0")
    return x.withColumn("w", F.when(F.col("_long"), F.lit(gross / 2) / F.col("_nl")).otherwise(F.lit(-gross / 2) / F.col("_ns"))) \
        .drop("_long", "_twice", "_nl", "_ns")


def with_fallback(weights: DataFrame, stamps: DataFrame, quotes: DataFrame, fallback: str) -> DataFrame:
    """Give what the weights leave over on each decision date to ``fallback`` where it has a price.

    ``stamps`` holds the decision dates (one row per date) and ``quotes`` the dense panel.
    """
    used = weights.groupBy("date").agg(F.sum("w").alias("_used"))
    priced = quotes.where((F.col("series_id") == fallback) & F.col("adj_close").isNotNull()).select("date")
    rest = stamps.select("date").join(used, "date", "left").join(priced, "date", "left_semi")
    rest = rest.select(F.lit(fallback).alias("series_id"), "date",
                       F.greatest(1 - F.coalesce("_used", F.lit(0.0)), F.lit(0.0)).alias("w")).where("w > 1e-12")
    return weights.where("w <> 0").select("series_id", "date", "w").unionByName(rest)


def scale_by_date(weights: DataFrame, exposure: DataFrame, x: str) -> DataFrame:
    """Multiply the weights by a per-date exposure (one row per date, broadcast)."""
    return weights.join(F.broadcast(exposure.select("date", x)), "date").withColumn("w", F.col("w") * F.col(x)).drop(x)


def argmax_pick(df: DataFrame, score: str, key="date") -> DataFrame:
    """The best series per date by score, first series on ties."""
    best = F.struct(F.col(score).alias("s"), F.col(TIE).alias("id"))
    first = F.min_by(F.col(TIE), F.struct(-F.col(score), F.col(TIE)))
    return df.where(F.col(score).isNotNull()).groupBy(key).agg(first.alias("series_id"), F.max(best)["s"].alias(score))
