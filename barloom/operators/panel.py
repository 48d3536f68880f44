"""Calendars, dense panels, listing windows and investability masks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import rolling as R

FREQS = ("me", "qe", "wf", "ye")


def period_key(freq: str, date="date"):
    """Bucket key of a date: month, quarter or year start, or the Monday before a Friday-ending week."""
    d = F.col(date) if isinstance(date, str) else date
    if freq == "wf":
        return F.trunc(F.date_add(d, 2), "week")
    return F.trunc(d, {"me": "month", "qe": "quarter", "ye": "year"}[freq])


def week_ending_friday(date):
    return F.date_add(F.trunc(F.date_add(date, 2), "week"), 4)


def calendar(dates: DataFrame) -> DataFrame:
    """Ordered distinct dates with position, rebalance stamps and the stamp in force.

    ``<f>_stamp`` marks the last row of each bucket (the unfinished last one included), ``<f>_force`` is the newest stamp
    up to and including the row and ``<f>_exec`` the one in force a row earlier, which is when its weights are traded.
    One row per DATE: even ten thousand years are under four million rows, so one ordered task and a broadcast are safe.
    """
    w = Window.orderBy("date")
    d = dates.select("date").where("date is not null").distinct()
    d = d.select("date", (F.row_number().over(w) - 1).alias("pos"), F.lead("date").over(w).alias("_next"),
                 F.count("*").over(Window.partitionBy()).cast("int").alias("n_dates"))
    stamps = [F.coalesce(period_key(f) != period_key(f, "_next"), F.lit(True)).alias(f"{f}_stamp") for f in FREQS]
    d = d.select("date", "pos", "n_dates", *stamps)
    force = [F.last(F.when(F.col(f"{f}_stamp"), F.col("date")), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
             .alias(f"{f}_force") for f in FREQS]
    d = d.select("*", *force)
    ex = [F.lag(f"{f}_force").over(w).alias(f"{f}_exec") for f in FREQS]
    return d.select("*", *ex, F.col("date").alias("day_force"), F.lag("date").over(w).alias("day_exec"),
                    F.lit(True).alias("day_stamp"), F.lag("date").over(w).alias("prev_date"), F.lead("date").over(w).alias("next_date"))


def densify(bars: DataFrame, cal: DataFrame, values: list[str] | None = None) -> DataFrame:
    """One row per (series, calendar date); missing observations become NULL rows.

    Each observed row emits itself and the gap up to the next observation, so no calendar x series product is joined and
    the rows stay partitioned by series for the windows that follow. A series holds at most one row per date.
    """
    values = values or [c for c in bars.columns if c not in ("series_id", "date", "pos")]
    pos = cal.select("date", "pos", "n_dates")
    w = Window.partitionBy("series_id").orderBy("pos")
    x = bars.select("series_id", "date", *values).join(F.broadcast(pos), "date")
    x = x.select("series_id", "pos", *values,
                 F.when(F.lag("pos").over(w).isNull(), F.lit(0)).otherwise(F.col("pos")).alias("_lo"),
                 F.coalesce(F.lead("pos").over(w) - 1, F.col("n_dates") - 1).alias("_hi"))
    x = x.select("*", F.explode(F.sequence("_lo", "_hi")).alias("_p"))
    x = x.select("series_id", F.col("_p").alias("_pos"), *[F.when(F.col("_p") == F.col("pos"), F.col(v)).alias(v) for v in values])
    x = x.withColumnRenamed("_pos", "pos")
    return x.join(F.broadcast(cal.select("pos", "date")), "pos").select("series_id", "date", "pos", *values)


def ratio_adjust(bars: DataFrame) -> DataFrame:
    """Scale open, high and low to the adjusted close and value the volume at the raw close."""
    k = F.try_divide(F.col("adj_close"), F.col("close"))
    return bars.withColumns({c: F.col(c) * k for c in ("open", "high", "low")} | {"dollar_volume": F.col("volume") * F.col("close")})


def calendar_align(obs: DataFrame, cal: DataFrame, key: str = "series", value: str = "value", limit: int | None = None) -> DataFrame:
    """Long observations carried forward to every calendar date (at most ``limit`` rows when given).

    Observations dated between calendar dates are dropped, as a reindex does.
    """
    dense = densify(obs.select(F.col(key).alias("series_id"), "date", value), cal, [value])
    return dense.select(F.col("series_id").alias(key), "date", "pos", R.ffill(value, limit).alias(value))


def date_slice(df: DataFrame, lo=None, hi=None) -> DataFrame:
    for bound, op in ((lo, "__ge__"), (hi, "__le__")):
        if bound is not None:
            df = df.where(getattr(F.col("date"), op)(F.to_date(F.lit(bound))))
    return df


def dev_holdout(df: DataFrame, cal: DataFrame, holdout_months: int) -> DataFrame:
    """Label each row ``dev`` or ``holdout``: the last ``holdout_months`` of the calendar are held out."""
    cut = cal.select(F.add_months(F.max("date"), -holdout_months).alias("holdout_start"))
    return df.join(F.broadcast(cut)).withColumn(
        "split", F.when(F.col("date") < F.col("holdout_start"), F.lit("dev")).otherwise(F.lit("holdout")))


def trim_listing_window(bars: DataFrame, listing: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows inside [ipo, delisted], and the number of rows removed per series."""
    x = bars.join(listing, "series_id", "left")
    inside = F.coalesce((F.col("date") >= F.col("ipo")), F.lit(True)) & F.coalesce(F.col("date") <= F.col("delisted"), F.lit(True))
    kept = x.where(inside).select(*bars.columns)
    trimmed = x.groupBy("series_id").agg(F.count_if(~inside).alias("rows_outside_listing")).where("rows_outside_listing > 0")
    return kept, trimmed


def investable(panel: DataFrame, *, seasoning: int, dv_window: int, dv_min: int, dv_floor: float, price_window: int,
               price_floor: float, delisted: str | None = None, out: str = "mask") -> DataFrame:
    """Point-in-time tradeable flag: listed, seasoned, liquid, above the price floor and not past delisting."""
    listed = F.col("adj_close").isNotNull()
    seasoned = F.sum(listed.cast("int")).over(R.over()) > seasoning
    liquid = R.quantile("dollar_volume", dv_window, 0.5, dv_min) > dv_floor
    priced = R.rolling(F.min, "close", price_window, 1) > price_floor
    ok = listed & seasoned & F.coalesce(liquid, F.lit(False)) & F.coalesce(priced, F.lit(False))
    if delisted:
        ok = ok & F.coalesce(F.col("date") <= F.col(delisted), F.lit(True))
    return panel.withColumn(out, ok)


def in_basket(panel: DataFrame, members: DataFrame, basket: str) -> DataFrame:
    """Rows of the members of one basket."""
    return panel.join(members.where(F.col("basket") == basket).select("series_id"), "series_id", "left_semi")


def business_days(lo, hi) -> "F.Column":
    """Array of the Monday-to-Friday dates between two date columns."""
    return F.filter(F.sequence(lo, hi, F.expr("interval 1 day")), lambda d: F.weekday(d) < 5)


def sessions(days: DataFrame, holidays: DataFrame) -> DataFrame:
    """Weekdays that are not holidays (``holidays`` is an input table with ``date`` and optional ``early_close``)."""
    full = holidays.where(~F.coalesce(F.col("early_close"), F.lit(False))) if "early_close" in holidays.columns else holidays
    return days.where(F.weekday("date") < 5).join(full.select("date"), "date", "left_anti")


def next_session(dates: DataFrame, session_days: DataFrame) -> DataFrame:
    """The first session after each date, by one ordered pass over the union of both (dates are a bounded dimension)."""
    u = dates.select("date", F.lit(0).alias("s")).unionByName(session_days.select("date", F.lit(1).alias("s")))
    u = u.groupBy("date").agg(F.max("s").alias("s"), F.count_if(F.col("s") == 0).alias("asked"))
    # Descending, so that the frame grows with the rows and is not scanned anew for each.
    w = Window.orderBy(F.col("date").desc()).rowsBetween(Window.unboundedPreceding, -1)
    u = u.withColumn("next_session", F.min(F.when(F.col("s") == 1, F.col("date"))).over(w))
    return u.where("asked > 0").select("date", "next_session", (F.col("s") == 1).alias("is_session"))


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
