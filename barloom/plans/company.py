"""Per-series history report: buy-and-hold metrics, trailing returns and a trend overlay."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import rolling as R
from ..functions import stats as S
from ..operators import metrics as M
from ..sources.tables import bench


def company_analysis(panel: DataFrame, trend: int = 200, min_rows: int = 504, rows_per_year: int = 252, years: tuple[int, ...] = (1, 3, 5, 10)) -> DataFrame:
    """One row per series with enough rows. The overlay holds the series only above its average, a row later."""
    from pyspark.sql import Window

    b = bench(panel)
    b = b.select("date", (F.try_divide("bench", F.lag("bench").over(Window.orderBy("pos"))) - 1).alias("bret"))
    x = panel.withColumns({"ret": R.pct_change("adj_close"), "up": R.above("adj_close", R.sma("adj_close", trend))})
    x = x.withColumn("_hold", F.coalesce(R.lag("up"), F.lit(False))).join(F.broadcast(b), "date")
    cover = x.where("adj_close is not null").groupBy("series_id").agg(F.min("date").alias("first_data"), F.max("date").alias("last_data"), F.count("*").alias("n")).where(F.col("n") >= min_rows)
    c = x.where("ret is not null").withColumn("overlay", F.when(F.col("_hold"), F.col("ret")).otherwise(0.0))
    m = M.drawdowns(c, ["series_id"]).groupBy("series_id").agg(
        S.cagr("ret").alias("bh_cagr"), S.ann_vol("ret").alias("bh_vol"), S.sharpe("ret").alias("bh_sharpe"), M.max_drawdown().alias("bh_max_dd"), F.corr("ret", "bret").alias("corr_bench"),
        S.cagr("overlay").alias("overlay_cagr"), S.sharpe("overlay").alias("overlay_sharpe"))
    t = M.trailing_years(c, ["series_id"], list(years), rows_per_year)
    out = cover.join(m, "series_id").join(t, "series_id")
    return out.withColumn("timing_adds_value", F.coalesce((F.col("overlay_sharpe") > F.col("bh_sharpe")) & (F.col("overlay_cagr") > 0), F.lit(False)))


