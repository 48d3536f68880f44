"""Data-quality checks: issues per series, the gate over a store and its verdict."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

PASS, LIMITED, FAIL = "PASS FOR RESEARCH", "PASS WITH LIMITATIONS", "FAIL - DO NOT BACKTEST"
COLUMNS = ("open", "high", "low", "close", "adj_close")


def validate_bars(bars: DataFrame, cal: DataFrame | None = None, max_move: float = 0.65, stale_run: int = 10, gap_share: float = 0.02) -> DataFrame:
    """Issue rows ``(series_id, kind, n, severity)``: duplicates, non-positive prices, OHLC order, jumps, stale runs and gaps.

    Everything except the calendar gaps is one ordered pass and one aggregation per series.
    """
    w = Window.partitionBy("series_id").orderBy("date", *[c for c in COLUMNS])
    x = bars.withColumns({"_pc": F.lag("close").over(w), "_pa": F.lag("adj_close").over(w), "_pd": F.lag("date").over(w), "_rn": F.row_number().over(w)})
    x = x.withColumns({"_flat": F.coalesce(F.col("close") == F.col("_pc"), F.lit(False)), "_jump": F.abs(F.try_divide("adj_close", "_pa") - 1) > max_move})
    run = F.last(F.when(~F.col("_flat"), F.col("_rn")), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    x = x.withColumn("_run", F.col("_rn") - F.coalesce(run, F.lit(0)))
    top, bottom = F.greatest("open", "close"), F.least("open", "close")
    ohlc = (F.col("high") < F.col("low")) | (F.col("high") < top * 0.999) | (F.col("low") > bottom * 1.001)
    aggs = [F.count_distinct(F.when(F.col("date") == F.col("_pd"), F.col("date"))).alias("duplicates")]
    aggs += [F.count_if(F.col(c) <= 0).alias(f"nonpositive_{c}") for c in COLUMNS]
    aggs += [F.count_if(ohlc).alias("ohlc_order"), F.count_if("_jump").alias("jump"), F.max("_run").cast("bigint").alias("stale")]
    g = x.groupBy("series_id").agg(*aggs)
    kinds = [("duplicates", "error", 1)] + [(f"nonpositive_{c}", "error", 1) for c in COLUMNS] + [("ohlc_order", "warn", 1), ("jump", "warn", 1), ("stale", "warn", stale_run)]
    rows = F.array(*[F.struct(F.lit(k).alias("kind"), F.col(k).cast("bigint").alias("n"), F.lit(s).alias("severity"), F.lit(t).alias("t")) for k, s, t in kinds])
    issues = g.select("series_id", F.inline(rows)).where("n >= t").drop("t")
    if cal is not None:
        from .asof import calendar_gaps

        gaps = calendar_gaps(bars, cal, gap_share).where("gappy")
        issues = issues.unionByName(gaps.select("series_id", F.lit("gaps").alias("kind"), F.col("missing").cast("bigint").alias("n"), F.lit("warn").alias("severity")))
    return issues


def assert_clean(issues: DataFrame) -> DataFrame:
    """One row with the numbers of issues and of warnings; the query fails while any error issue exists."""
    msg = F.concat(F.lit("price errors: "), F.count_if(F.col("severity") == "error").cast("string"))
    return issues.agg(F.count("*").alias("issues"), F.count_if(F.col("severity") == "warn").alias("warnings"),
                      F.when(F.count_if(F.col("severity") == "error") > 0, F.raise_error(msg).cast("boolean")).otherwise(F.lit(True)).alias("clean"))


def quality_gate(bars: DataFrame, cal: DataFrame, listing: DataFrame, universe: DataFrame, macro: DataFrame, filings: DataFrame, benchmarks: list[str],
                 min_names: int = 10, max_missing: float = 0.03, min_rows_for_gaps: int = 252) -> DataFrame:
    """Check rows ``(check, ok, n, fatal)`` of the whole store."""
    from .asof import calendar_gaps

    issues = validate_bars(bars)
    spans = bars.groupBy("series_id").agg(F.max("date").alias("last"), F.count("*").alias("rows"))
    row = lambda name, ok, n, fatal: [F.lit(name).alias("check") if isinstance(name, str) else name.alias("check"), ok.alias("ok"), n.cast("bigint").alias("n"), F.lit(fatal).alias("fatal")]
    have = universe.join(spans, "series_id", "left_semi").agg(F.count("*").alias("n"))
    out = have.select(*row("universe_coverage", F.col("n") >= min_names, F.col("n"), True))
    b = spans.where(F.col("series_id").isin(benchmarks)).agg(*[F.count_if(F.col("series_id") == x).alias(f"b{i}") for i, x in enumerate(benchmarks)])
    out = out.unionByName(b.select(F.inline(F.array(*[F.struct(F.lit(f"benchmark_{x}").alias("check"), (F.col(f"b{i}") > 0).alias("ok"), F.col(f"b{i}").cast("bigint").alias("n"), F.lit(True).alias("fatal"))
                                                      for i, x in enumerate(benchmarks)]))))
    err = issues.where("severity = 'error'").groupBy("series_id").agg(F.sum("n").alias("n"))
    out = out.unionByName(err.select(*row(F.concat(F.lit("prices_"), "series_id"), F.lit(False), F.col("n"), False)))
    gaps = calendar_gaps(bars, cal).join(spans, "series_id").where((F.col("rows") > min_rows_for_gaps) & (F.col("missing") > F.col("expected") * max_missing))
    out = out.unionByName(gaps.select(*row(F.concat(F.lit("gaps_"), "series_id"), F.lit(False), F.col("missing"), False)))
    late = spans.join(listing.where("delisted is not null"), "series_id").where(F.col("last") > F.date_add("delisted", 5))
    out = out.unionByName(late.select(*row(F.concat(F.lit("postdelist_"), "series_id"), F.lit(False), F.datediff("last", "delisted"), False)))
    share = spans.join(err.select("series_id", F.lit(1).alias("_e")), "series_id", "left").agg(F.count("_e").alias("n"), F.count("*").alias("_all"))
    out = out.unionByName(share.select(*row("error_series_share", F.col("n") <= F.col("_all") * 0.2, F.col("n"), True)))
    m = macro.agg(F.count_distinct("series").alias("n"))
    out = out.unionByName(m.select(*row("macro_coverage", F.col("n") > 0, F.col("n"), False)))
    leak = filings.where(F.col("published") < F.col("period_end")).groupBy("series_id").agg(F.count("*").alias("n"))
    out = out.unionByName(leak.select(*row(F.concat(F.lit("fund_leak_"), "series_id"), F.lit(False), F.col("n"), True)))
    gone = listing.where("delisted is not null").join(spans.select("series_id", F.lit(1).alias("_h")), "series_id", "left").agg(F.count("_h").alias("n"), F.count("*").alias("_all"))
    return out.unionByName(gone.select(*row("delisted_coverage", F.col("n") >= F.col("_all"), F.col("n"), False)))


def gate_verdict(checks: DataFrame, limitations: int = 0) -> DataFrame:
    """One row: the status, the number of failed checks and of fatal ones."""
    failed, fatal = F.count_if(~F.col("ok")), F.count_if(~F.col("ok") & F.col("fatal"))
    return checks.agg(F.when(fatal > 0, FAIL).when((failed > 0) | F.lit(limitations > 0), LIMITED).otherwise(PASS).alias("status"), failed.alias("failed"), fatal.alias("fatal"))


#: The names of limitations, and of the flags that tiers are assigned by.
LIMITATIONS = ("split_only_prices", "no_rate", "no_vix", "macro_revised", "fundamentals_partial", "delisted_incomplete")
FLAGS = ("delisted_incomplete", "split_only_prices", "fundamentals_partial", "macro_revised", "no_vix")


def limitations(bars: DataFrame, listing: DataFrame, universe: DataFrame, macro: DataFrame, filings: DataFrame, adjustment: DataFrame,
                rate: str, fear: str, min_filings: int = 10) -> DataFrame:
    """Rows ``(limitation, n, of)`` of what the store can't support though no check failed.

    ``adjustment`` says how each series is adjusted; ``rate`` and ``fear`` are the macro series of the cash rate and of implied volatility. ``n`` and
    ``of`` count series: adjusted for splits alone of those held, macro series, with filings of the names wanted, delisted ones held of those
    listed. Macro series are always revised data. Each table is reduced to its distinct keys before anything is joined; series without
    an adjustment row count as fully adjusted, and an empty store still gives its rows.
    """
    held = bars.select("series_id").distinct()
    have = lambda x, on="series_id": x.join(held.withColumn("_h", F.lit(1)), on, "left")
    split = adjustment.where(F.col("adjustment") == "split_only").select("series_id", F.lit(1).alias("_s")).dropDuplicates(["series_id"])
    prices = held.join(split, "series_id", "left").agg(F.count("_s").alias("a"), F.count(F.lit(1)).alias("b"))
    series = macro.agg(F.count_distinct("series").alias("b"), F.count_if(F.col("series") == rate).alias("rate"), F.count_if(F.col("series") == fear).alias("fear"))
    names = have(universe.select("series_id").distinct()).agg(F.least(F.lit(min_filings), F.count("_h")).alias("b"))
    filed = filings.agg(F.count_distinct("series_id").alias("a"))
    gone = have(listing.where("delisted IS NOT NULL").select("series_id").distinct()).agg(F.count("_h").alias("a"), F.count(F.lit(1)).alias("b"))
    row = lambda name, n, of, when: F.struct(F.lit(name).alias("limitation"), n.cast("bigint").alias("n"), of.cast("bigint").alias("of"), when.alias("_w"))
    a, b = F.col("a"), F.col("b")
    zero, one = F.lit(0), F.lit(1)
    out = prices.select(F.inline(F.array(row("split_only_prices", a, b, a > 0))))
    out = out.unionByName(series.select(F.inline(F.array(row("no_rate", zero, one, F.col("rate") == 0), row("no_vix", zero, one, F.col("fear") == 0), row("macro_revised", b, b, F.lit(True))))))
    # Both sides are one row.
    both = filed.withColumn("_k", one).join(names.withColumn("_k", one), "_k")
    out = out.unionByName(both.select(F.inline(F.array(row("fundamentals_partial", a, b, a < b)))))
    return out.unionByName(gone.select(F.inline(F.array(row("delisted_incomplete", a, b, a < b))))).where("_w").drop("_w")


def gate_status(checks: DataFrame, limits: DataFrame) -> DataFrame:
    """One row: the status under checks and limitations, and how many failed, were fatal and limit."""
    rows = checks.select("ok", "fatal", F.lit(0).alias("limit")).unionByName(limits.select(F.lit(True).alias("ok"), F.lit(False).alias("fatal"), F.lit(1).alias("limit")))
    failed, fatal, limited = F.count_if(~F.col("ok")), F.count_if(~F.col("ok") & F.col("fatal")), F.count_if(F.col("limit") == 1)
    return rows.agg(F.when(fatal > 0, FAIL).when((failed > 0) | (limited > 0), LIMITED).otherwise(PASS).alias("status"), failed.alias("failed"), fatal.alias("fatal"), limited.alias("limitations"))


def gate_flags(limits: DataFrame) -> DataFrame:
    """One row of flags for :func:`~barloom.operators.ranking.assign_tier`: whether each limitation holds."""
    return limits.agg(*[(F.count_if(F.col("limitation") == x) > 0).alias(x) for x in FLAGS])
