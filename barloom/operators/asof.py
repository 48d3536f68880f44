"""Point-in-time joins: as-of values, symbol spans, gaps, reconciliation and stitched histories."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

FAR = "2100-01-01"


def trailing_filings(f: DataFrame, field: str, prefix: str | None = None) -> DataFrame:
    """Add trailing-four-quarter sum, its year-on-year growth and the change of that growth, per series by period end."""
    p = prefix or field
    w = Window.partitionBy("series_id").orderBy("period_end")
    w4 = w.rowsBetween(-3, 0)
    f = f.withColumn(f"{p}_ttm", F.when(F.count(field).over(w4) >= 4, F.sum(field).over(w4)))
    f = f.withColumn(f"{p}_yoy", F.try_divide(f"{p}_ttm", F.lag(f"{p}_ttm", 4).over(w)) - 1)
    return f.withColumn(f"{p}_accel", F.col(f"{p}_yoy") - F.lag(f"{p}_yoy").over(w))


def pit_asof(panel: DataFrame, filings: DataFrame, fields: list[str], strict: bool = False) -> DataFrame:
    """Attach to every panel row the newest non-null value of each field already published on its date.

    Panel rows and filings are merged in one ordering per series and carried forward, so the join costs one shuffle and no
    range comparison. ``strict`` requires publication before the date; otherwise the publication day counts.
    """
    left = panel.withColumns({"_k": F.lit(0 if strict else 1), "_p": F.lit(None).cast("date")})
    left = left.withColumns({f: F.lit(None).cast("double") for f in fields})
    right = filings.select("series_id", F.col("published").alias("date"), F.lit(1 if strict else 0).alias("_k"),
                           F.col("period_end").alias("_p"), *fields).withColumn("_filing", F.lit(True))
    u = left.withColumn("_filing", F.lit(False)).unionByName(right, allowMissingColumns=True)
    w = Window.partitionBy("series_id").orderBy("date", "_k", "_p").rowsBetween(Window.unboundedPreceding, 0)
    u = u.withColumns({f: F.last(f, ignorenulls=True).over(w) for f in fields})
    return u.where(~F.col("_filing")).select(*panel.columns, *fields)


def filings_asof(filings: DataFrame, asof) -> DataFrame:
    """Filings published strictly before a date."""
    return filings.where(F.col("published") < F.to_date(F.lit(asof)))


def resolve_symbol(asked: DataFrame, spans: DataFrame) -> DataFrame:
    """The security a symbol denoted on a date (inclusive spans, open end)."""
    s = spans.select("symbol", "sid", "valid_from", F.coalesce("valid_to", F.to_date(F.lit(FAR))).alias("_to"))
    return asked.join(s, (asked["symbol"] == s["symbol"]) & (asked["date"] >= s["valid_from"]) & (asked["date"] <= s["_to"]), "left") \
        .select(asked["*"], "sid")


def audit_overlaps(spans: DataFrame) -> DataFrame:
    """Pairs of securities claiming one symbol at the same time.

    A running maximum of earlier ends and a minimum of later starts mark the spans that overlap at all; only those are paired.
    """
    s = spans.select("symbol", "sid", "valid_from", F.coalesce("valid_to", F.to_date(F.lit(FAR))).alias("to"))
    w = Window.partitionBy("symbol").orderBy("valid_from", "to", "sid")
    s = s.withColumns({"_before": F.max("to").over(w.rowsBetween(Window.unboundedPreceding, -1)), "_after": F.lead("valid_from").over(w)})
    hit = s.where((F.col("_before") >= F.col("valid_from")) | (F.col("_after") <= F.col("to")))
    a, b = hit.alias("a"), hit.alias("b")
    return a.join(b, (F.col("a.symbol") == F.col("b.symbol")) & (F.col("a.sid") < F.col("b.sid"))
                  & (F.col("a.valid_from") <= F.col("b.to")) & (F.col("b.valid_from") <= F.col("a.to"))) \
        .select("a.symbol", F.col("a.sid").alias("sid"), F.col("b.sid").alias("other_sid"))


def calendar_gaps(bars: DataFrame, cal: DataFrame, share: float = 0.02) -> DataFrame:
    """Calendar dates missing inside each series' own span, from calendar positions and counts."""
    x = bars.select("series_id", "date").join(F.broadcast(cal.select("date", "pos")), "date")
    g = x.groupBy("series_id").agg((F.max("pos") - F.min("pos") + 1).alias("expected"), F.count_distinct("pos").alias("observed"))
    return g.withColumn("missing", F.col("expected") - F.col("observed")) \
        .withColumn("gappy", F.col("missing") > F.col("expected") * share)


def missing_dates(bars: DataFrame, cal: DataFrame) -> DataFrame:
    """The missing calendar dates themselves, unrolled from the jumps between observed positions."""
    x = bars.select("series_id", "date").distinct().join(F.broadcast(cal.select("date", "pos")), "date")
    w = Window.partitionBy("series_id").orderBy("pos")
    x = x.withColumn("_next", F.lead("pos").over(w)).where("_next > pos + 1")
    x = x.select("series_id", F.explode(F.sequence(F.col("pos") + 1, F.col("_next") - 1)).alias("pos"))
    return x.join(F.broadcast(cal.select("date", "pos")), "pos").select("series_id", "date")


def reconcile_providers(quotes: DataFrame, preference: list[str], min_overlap: int = 20, bp: float = 50.0, warn_share: float = 0.02) -> DataFrame:
    """Compare the returns of each series' preferred provider with every other provider's, date by date.

    All providers of one (series, date) meet in a single grouped map, so there is no self-join of the quotes.
    """
    pref = F.coalesce(F.array_position(F.array(*[F.lit(p) for p in preference]), F.col("provider")), F.lit(0))
    pref = F.when(pref > 0, pref).otherwise(F.lit(len(preference) + 1))
    best = Window.partitionBy("series_id")
    q = quotes.withColumn("_pref", pref).withColumn("_best", F.min(F.struct("_pref", "provider")).over(best)["provider"])
    q = q.withColumn("_r", F.try_divide("adj_close", F.lag("adj_close").over(Window.partitionBy("series_id", "provider").orderBy("date"))) - 1)
    q = q.withColumn("_base", F.max(F.when(F.col("provider") == F.col("_best"), F.col("_r"))).over(Window.partitionBy("series_id", "date")))
    d = q.where((F.col("provider") != F.col("_best")) & F.col("_r").isNotNull() & F.col("_base").isNotNull())
    out = d.groupBy("series_id", F.col("_best").alias("chosen"), F.col("provider").alias("other")).agg(
        F.count("*").alias("overlap"), F.count_if(F.abs(F.col("_r") - F.col("_base")) > bp / 1e4).alias("flagged"))
    return out.where(F.col("overlap") >= min_overlap).withColumn("pct_flagged", F.col("flagged") / F.col("overlap")) \
        .withColumn("warning", F.col("pct_flagged") > warn_share)


def stitch_history(quotes: DataFrame, spans: DataFrame, max_gap_days: int = 7) -> tuple[DataFrame, DataFrame]:
    """Join per-symbol quotes into one history per security.

    Returns (rows of the securities that stitch cleanly, refused securities with the reason): overlapping pieces and gaps of
    more than ``max_gap_days`` between consecutive pieces are refused, never bridged.
    """
    s = spans.select("sid", "symbol", "valid_from", F.coalesce("valid_to", F.to_date(F.lit(FAR))).alias("_to"))
    x = quotes.join(s, "symbol").where((F.col("date") >= F.col("valid_from")) & (F.col("date") <= F.col("_to")))
    piece = x.groupBy("sid", "symbol", "valid_from").agg(F.min("date").alias("lo"), F.max("date").alias("hi"))
    w = Window.partitionBy("sid").orderBy("lo")
    piece = piece.withColumn("_prev", F.lag("hi").over(w))
    bad = piece.where(F.col("_prev").isNotNull()).withColumn(
        "reason", F.when(F.col("lo") <= F.col("_prev"), F.lit("overlap")).when(F.datediff("lo", "_prev") > max_gap_days, F.lit("gap")))
    bad = bad.where("reason is not null").groupBy("sid").agg(F.min("reason").alias("reason"))
    return x.join(bad, "sid", "left_anti").drop("valid_from", "_to"), bad
