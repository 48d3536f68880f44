"""Panels derived from the order tables: bars, macro, filings, short volume, listings and members.

Raw rows are reduced by one hash aggregation per panel (partial sums before the shuffle, so a brand that holds most of
the rows costs no more than the others); every panel afterwards is bounded by series x calendar dates.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.panel import calendar, densify, week_ending_friday
from ..session import materialize


def day_of():
    return F.col("l_shipdate").cast("date")


def week_of():
    return week_ending_friday(day_of())



# Declared schemas spare every read the footer job that schema inference runs.
SCHEMAS = {
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, l_extendedprice double, "
                "l_discount double, l_tax double, l_returnflag string, l_linestatus string, l_shipdate timestamp_ntz",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, o_orderdate timestamp_ntz, o_orderpriority string",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    reader = spark.read.schema(SCHEMAS[name]) if name in SCHEMAS else spark.read
    return reader.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines with the brand of their part as ``series_id``."""
    part = table(spark, sf_dir, "part").select("p_partkey", F.col("p_brand").alias("series_id"))
    return table(spark, sf_dir, "lineitem").join(part, F.col("l_partkey") == F.col("p_partkey"))


def bars(spark: SparkSession, sf_dir: str, freq: str = "w", series: str = "brand") -> DataFrame:
    """Open, high, low, close, adjusted close, volume and dollar volume per series and day or Friday-ending week."""
    if series == "brand":
        src = lines(spark, sf_dir)
    elif series == "supplier":
        src = table(spark, sf_dir, "lineitem").withColumn("series_id", F.concat(F.lit("S"), F.lpad(F.col("l_suppkey").cast("string"), 9, "0")))
    else:
        src = table(spark, sf_dir, "lineitem").withColumn("series_id", F.concat("l_returnflag", "l_linestatus"))
    key = F.struct("l_shipdate", "l_orderkey", "l_linenumber", "l_extendedprice")
    price = F.col("l_extendedprice")
    close = F.avg(price) if freq == "w" else F.max_by(price, key)
    return src.groupBy("series_id", (week_of() if freq == "w" else day_of()).alias("date")).agg(
        F.min_by(price, key).alias("open"), F.max(price).alias("high"), F.min(price).alias("low"), close.alias("close"),
        F.avg(price * (1 - F.col("l_discount"))).alias("adj_close"),
        F.sum("l_quantity").alias("volume"), F.sum(price).alias("dollar_volume"))


def market_calendar(spark: SparkSession, sf_dir: str, freq: str = "w") -> DataFrame:
    """Calendar of the bars, from a scan of the ship-date column alone."""
    return calendar(table(spark, sf_dir, "lineitem").select((week_of() if freq == "w" else day_of()).alias("date")))


def market_panel(spark: SparkSession, sf_dir: str, freq: str = "w", series: str = "brand", stored: bool = False) -> tuple[DataFrame, DataFrame]:
    """The dense bar panel and its calendar; ``stored`` writes the calendar once, for plans that join it many times."""
    cal = market_calendar(spark, sf_dir, freq)
    if stored:
        cal = materialize(cal, "calendar")
    return densify(bars(spark, sf_dir, freq, series), cal), cal


def bench(panel: DataFrame) -> DataFrame:
    """Benchmark level per date: the mean adjusted close of the series that have one."""
    return panel.groupBy("date", "pos").agg(F.avg("adj_close").alias("bench"))


def macro(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Monthly macro observations, dated on the month's last Friday-ending week: RATE and LEVEL."""
    o = table(spark, sf_dir, "orders").select(week_ending_friday(F.col("o_orderdate").cast("date")).alias("week"), "o_orderstatus", "o_totalprice")
    m = o.groupBy(F.trunc("week", "month").alias("month")).agg(
        F.max("week").alias("date"), (F.avg(F.when(F.col("o_orderstatus") == "F", 1.0).otherwise(0.0)) * 5).alias("RATE"),
        F.avg("o_totalprice").alias("LEVEL"))
    return m.select("date", F.expr("stack(2, 'RATE', RATE, 'LEVEL', LEVEL) as (series, value)"))


def fundamentals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quarterly filings per brand with a publication date 40 to 60 days after the period end."""
    q = lines(spark, sf_dir).groupBy("series_id", F.trunc(day_of(), "quarter").alias("q")).agg(
        F.sum("l_extendedprice").alias("revenue"), F.sum(F.col("l_extendedprice") * F.col("l_discount")).alias("fcf"),
        F.sum("l_quantity").alias("shares"), F.sum(F.col("l_extendedprice") * F.col("l_tax")).alias("rnd"))
    no = F.regexp_extract("series_id", r"(\d+)", 1).cast("int")
    end = F.last_day(F.add_months("q", 2))
    return q.select("series_id", end.alias("period_end"), F.date_add(end, 40 + no % 21).alias("published"), "revenue", "fcf", "shares",
                    (F.col("revenue") * 4).alias("assets"), (F.col("fcf") * 2 - F.col("rnd") * 1.5).alias("net_income"), "rnd",
                    (F.col("revenue") - F.col("rnd") * 6).alias("gross_profit"))


def short_volume(spark: SparkSession, sf_dir: str, freq: str = "w") -> DataFrame:
    return lines(spark, sf_dir).groupBy("series_id", (week_of() if freq == "w" else day_of()).alias("date")).agg(
        F.sum(F.when(F.col("l_linestatus") == "O", F.col("l_quantity")).otherwise(0.0)).alias("short_volume"),
        F.sum("l_quantity").alias("total_volume"))


def brand_no(c="series_id"):
    return F.regexp_extract(c, r"(\d+)", 1).cast("int")


def listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Listing window per brand; every fifth brand is delisted after 70 % of its own span."""
    s = lines(spark, sf_dir).groupBy("series_id").agg(F.min(week_of()).alias("ipo"), F.max(week_of()).alias("last"))
    cut = F.date_add("ipo", F.floor(F.datediff("last", "ipo") * 0.7).cast("int"))
    return s.select("series_id", "ipo", F.when(brand_no() % 5 == 0, cut).alias("delisted"))


def members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Overlapping baskets: brands by number mod 3 (T0..T2) and by number mod 4 (U0..U3)."""
    b = table(spark, sf_dir, "part").select(F.col("p_brand").alias("series_id")).distinct()
    return b.select(F.explode(F.array(F.concat(F.lit("T"), (brand_no() % 3).cast("string")), F.concat(F.lit("U"), (brand_no() % 4).cast("string")))).alias("basket"), "series_id")


def provider_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Adjusted close per provider (the return flag), series and week."""
    names = F.create_map(F.lit("A"), F.lit("alpha"), F.lit("N"), F.lit("north"), F.lit("R"), F.lit("river"))
    return lines(spark, sf_dir).groupBy(names[F.col("l_returnflag")].alias("provider"), "series_id", week_of().alias("date")).agg(
        F.avg(F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("adj_close"))


def ticker_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Symbol validity per brand: brands 10 to 19 change symbol on 1998-06-30, brand 7's old symbol is reused by 8."""
    b = table(spark, sf_dir, "part").select(F.col("p_brand").alias("sid")).distinct().withColumn("no", brand_no("sid"))
    d = lambda s: F.to_date(F.lit(s))
    span = lambda sym, lo, hi: F.struct(sym.alias("symbol"), lo.alias("valid_from"), hi.alias("valid_to"))
    none = F.lit(None).cast("date")
    sym = F.concat(F.lit("B"), F.col("no").cast("string"))
    spans = F.when(F.col("no").between(10, 19), F.array(span(sym, d("1995-01-01"), d("1998-06-30")), span(F.concat(sym, F.lit("X")), d("1998-07-01"), none))) \
        .when(F.col("no") == 8, F.array(span(F.lit("B7"), d("2001-01-01"), none), span(sym, d("1995-01-01"), d("2000-12-31")))) \
        .when(F.col("no") == 7, F.array(span(sym, d("1995-01-01"), d("2001-03-31")))) \
        .otherwise(F.array(span(sym, d("1995-01-01"), none)))
    return b.select("sid", F.inline(spans))
