import numpy as np
import pandas as pd
import pytest
from helpers import frame, prices, wide
from pyspark.sql import functions as F

from barloom.functions import rolling as R
from barloom.operators import recursive as REC
from barloom.operators import stateful as ST
from barloom.operators import xsection as X


def same(a: pd.DataFrame, b: pd.DataFrame, tol=1e-9):
    b = b.reindex_like(a)
    assert (a.isna() == b.isna()).all().all()
    np.testing.assert_allclose(a.fillna(0).to_numpy(float), b.fillna(0).to_numpy(float), rtol=tol, atol=tol)


@pytest.mark.parametrize("holes", [0.0, 0.1])
def test_trailing_features_match_pandas(spark, holes):
    w = prices(holes=holes)
    r = w / w.shift(1) - 1
    x = frame(spark, w).withColumn("ret", R.pct_change("adj_close")).cache()
    cases = {
        "mom": (R.momentum("adj_close", 20, 5), w.shift(5) / w.shift(20) - 1),
        "sma": (R.sma("adj_close", 10), w.rolling(10).mean()),
        "vol": (R.realized_vol("ret", 12), r.rolling(12).std() * np.sqrt(252)),
        "hi": (R.prior_max("adj_close", 9), w.shift(1).rolling(9).max()),
        "q": (R.quantile("adj_close", 15, 0.75, 8), w.rolling(15, min_periods=8).quantile(0.75)),
        "rk": (R.percentile_rank("adj_close", 15, 8), w.rolling(15, min_periods=8).rank(pct=True)),
        "adv": (R.rolling_adv("adj_close", 21, 5), w.rolling(21, min_periods=5).mean().shift(1)),
        "ff": (R.ffill("adj_close", 2), w.ffill(limit=2)),
    }
    y = x.withColumns({k: c for k, (c, _) in cases.items()})
    for k, (_, want) in cases.items():
        same(want, wide(y, k))


@pytest.mark.parametrize("alpha", [1 / 14, 0.6, 0.95])
@pytest.mark.parametrize("holes", [0.0, 0.15])
def test_ewm_matches_pandas_over_many_blocks(spark, alpha, holes):
    w = prices(n=900, k=2, holes=holes)
    got = wide(REC.ewm(frame(spark, w), "adj_close", alpha, "y", 5), "y")
    same(w.ewm(alpha=alpha, adjust=False, min_periods=5).mean(), got, 1e-9)


def test_gaussian_step_response_is_causal_and_settles(spark):
    w = pd.DataFrame({"S0": [0.0] * 150 + [1.0] * 150}, index=pd.bdate_range("2020-01-01", periods=300))
    g = wide(REC.gaussian(frame(spark, w), "adj_close", 20, 4), "centre")["S0"]
    assert g.iloc[:150].abs().max() == 0
    assert (g.diff().iloc[150:].dropna() >= -1e-12).all() and abs(g.iloc[-1] - 1) < 1e-6


def test_latch_equals_loop_and_min_hold_zero(spark):
    rng = np.random.default_rng(7)
    idx = pd.bdate_range("2020-01-01", periods=400)
    en, ex = (pd.DataFrame(rng.random((400, 3)) < p, index=idx, columns=["A", "B", "C"]) for p in (0.08, 0.1))
    ex |= en & (rng.random((400, 3)) < 0.5)
    x = frame(spark, en.astype(float), "en").join(frame(spark, ex.astype(float), "ex").drop("pos"), ["date", "series_id"])
    x = x.withColumns({"en": F.col("en") > 0, "ex": F.col("ex") > 0}).cache()
    want = pd.DataFrame(False, index=idx, columns=en.columns)
    for c in en:
        state = False
        for t in idx:
            state = bool(en.loc[t, c] or (state and not ex.loc[t, c]))
            want.loc[t, c] = state
    assert (wide(x.withColumn("h", R.latch("en", "ex")), "h") == want).all().all()
    assert (wide(ST.min_hold_latch(x, "en", "ex", 0), "held") == want).all().all()
    late = wide(ST.min_hold_latch(x, "en", "ex", 10), "held")
    runs = [len(g) for c in late for _, g in late[c].groupby((late[c] != late[c].shift()).cumsum()) if g.iloc[0] and g.index[-1] != idx[-1]]
    assert min(runs) >= 10


def test_trailing_stop_uses_peak_since_entry(spark):
    px = pd.DataFrame({"S0": [10, 11, 12, 13, 12.5, 11.4, 12, 14.0]}, index=pd.bdate_range("2020-01-01", periods=8))
    x = frame(spark, px).withColumns({"atr": F.lit(0.5), "br": F.col("pos").isin(1, 7), "mask": F.lit(True)})
    held = wide(ST.trailing_stop(x, "br", "atr", 3.0), "held")["S0"].tolist()
    assert held == [False, True, True, True, True, False, False, True]


def test_rank_cap_and_books(spark):
    rows = [("2020-01-31", f"S{i}", v) for i, v in enumerate([5.0, 3.0, 3.0, 1.0, None])]
    d = spark.createDataFrame(rows, "date string, series_id string, s double").withColumn("date", F.to_date("date"))
    r = {x["series_id"]: x["xs_rank"] for x in X.xs_rank(d, "s").collect()}
    assert r == {"S0": 1.0, "S1": 0.625, "S2": 0.625, "S3": 0.25}
    assert [x["series_id"] for x in X.top_n(d, "s", 2).orderBy("series_id").collect()] == ["S0", "S1"]
    w = X.cap_weights(X.score_weight(d, "s").select("series_id", "date", "w"), 0.3)
    got = {x["series_id"]: round(x["w"], 9) for x in w.collect()}
    assert got == {"S0": 0.3, "S1": 0.3, "S2": 0.3, "S3": 0.1}
    tight = X.cap_weights(X.score_weight(d, "s").select("series_id", "date", "w"), 0.2)
    assert {round(x["w"], 9) for x in tight.collect()} == {0.2}
    b = X.two_books(d, "s", 1).collect()
    assert sorted((x["series_id"], x["w"]) for x in b) == [("S0", 0.5), ("S3", -0.5)]
    assert X.two_books(d, "s", 4).count() == 0
