"""Small deterministic panels and conversions for the tests."""

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from barloom.functions import rolling as R
from barloom.operators.panel import calendar


def frame(spark, wide: pd.DataFrame, name: str = "adj_close"):
    """A wide date x series frame as dense long rows with ``pos``; missing values become NULL."""
    long = wide.rename_axis("date").reset_index().melt("date", var_name="series_id", value_name=name)
    long["pos"] = long["date"].map({d: i for i, d in enumerate(wide.index)})
    long["date"] = long["date"].dt.date
    long[name] = long[name].astype(object).where(long[name].notna(), None)
    return spark.createDataFrame(list(long.itertuples(index=False, name=None)), f"date date, series_id string, {name} double, pos int")


def wide(df, value: str) -> pd.DataFrame:
    p = df.select("date", "series_id", value).toPandas()
    p["date"] = pd.to_datetime(p["date"])
    return p.pivot(index="date", columns="series_id", values=value).sort_index()


def prices(n=160, k=4, seed=3, holes=0.0) -> pd.DataFrame:
    rng = np.random.default_rng(seed)
    px = 50 * np.exp(np.cumsum(rng.normal(0.001, 0.03, (n, k)), axis=0))
    w = pd.DataFrame(px, index=pd.bdate_range("2020-01-01", periods=n), columns=[f"S{i}" for i in range(k)])
    if holes:
        w = w.mask(rng.random(w.shape) < holes)
    return w


def toy_market(spark, w: pd.DataFrame):
    """Panel with quotes around the close, huge liquidity and everything investable."""
    from barloom.plans.signals import Market

    x = frame(spark, w)
    c = F.col("adj_close")
    x = x.withColumns({"open": c * 0.999, "high": c * 1.01, "low": c * 0.99, "close": c, "volume": c * 0 + 1e6, "dollar_volume": c * 0 + 1e12})
    x = x.withColumns({"ret": R.pct_change("adj_close"), "mask": c.isNotNull()})
    return Market(x, calendar(x.select("date")), fallback=w.columns[-1], index=w.columns[0])
