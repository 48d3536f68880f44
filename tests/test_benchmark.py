"""A benchmark against itself."""

import random

from pyspark.sql import functions as F

from barloom.functions import stats as S
from barloom.operators import metrics as M
from barloom.sources import curves as C


NAME = "BuyAndHold(ticker=SPY)"


def noisy(spark):
    """Stands for curves whose last bits differ each time that they are computed."""
    noise = F.udf(lambda: random.gauss(0, 0.01), "double").asNondeterministic()
    days = spark.range(80).select(F.date_add(F.to_date(F.lit("2020-01-01")), F.col("id").cast("int")).alias("date"))
    return days.select(F.explode(F.array(F.lit(NAME), F.lit("other"))).alias("strategy"), "date").withColumn("ret", noise())


def test_benchmark_never_deviates_from_itself(spark):
    got = {r["strategy"]: r["x"] for r in C.with_benchmark(noisy(spark)).groupBy("strategy").agg(S.information_ratio("ret", "bench").alias("x")).collect()}
    assert got[NAME] is None and got["other"] is not None


def test_summary_of_the_benchmark_against_itself(spark):
    got = {r["strategy"]: r for r in M.summary(C.with_benchmark(noisy(spark)), ["strategy"], bench="bench").collect()}
    own = got[NAME]
    assert own["information_ratio"] is None and own["tracking_error"] == 0 and abs(own["beta"] - 1) < 1e-12 and got["other"]["information_ratio"] is not None
