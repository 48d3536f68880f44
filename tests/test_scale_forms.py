"""Operators in the form that holds for large tables: against pandas, and by their plans."""

import datetime

import numpy as np
import pandas as pd
import pytest
from helpers import frame, prices

from barloom.operators import ranking as RK
from barloom.operators import stateful as ST
from barloom.operators import xsection as X
from barloom.operators.order_stats import expanding_quantile


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def ranked(spark):
    rng = np.random.default_rng(2)
    n = 6000
    x = np.where(rng.random(n) < 0.35, 7.0, np.round(rng.normal(0, 50, n), 1))
    pdf = pd.DataFrame({"series_id": [f"s{k:05d}" for k in range(n)], "date": np.where(np.arange(n) % 3 == 0, "a", "b"), "x": x})
    pdf.loc[::97, "x"] = np.nan
    return spark.createDataFrame(pdf.replace({np.nan: None}), "series_id string, date string, x double"), pdf


def test_ranks_by_value_range_with_a_value_that_a_third_of_the_rows_share(ranked):
    df, pdf = ranked
    want = pdf.dropna().assign(r=lambda d: d.groupby("date")["x"].rank(pct=True)).set_index("series_id")["r"]
    got = X.xs_rank(df, "x", "r").toPandas().set_index("series_id")["r"]
    np.testing.assert_allclose(got.reindex(want.index), want, atol=1e-12)


def test_no_window_of_all_rows_of_a_date(ranked):
    df, _ = ranked
    w = X.score_weight(df, "x").select("series_id", "date", "w")
    for out in (X.xs_rank(df, "x"), X.with_zscores(df, ["x"]), X.equal_weight(df), X.score_weight(df, "x"), X.inverse_vol_weight(df.where("x > 0"), "x")):
        assert "Window [" not in plan(out) or "_cell" in plan(out)
    for out in (X.cap_weights(w, 0.2), X.two_books(df, "x", 5)):
        assert "WindowGroupLimit" in plan(out)
    with pytest.raises(Exception, match="exceed"):
        X.cap_weights(w.withColumn("w", w["w"] * 2), 0.2).collect()


def test_capping_equals_rounds_of_clipping(spark):
    rng = np.random.default_rng(4)
    for cap in (0.05, 0.2, 0.4):
        raw = pd.DataFrame([(f"s{k}", f"d{j}", v) for j in range(30) for k, v in enumerate(rng.dirichlet(np.full(1 + j % 12, 0.4)))], columns=["series_id", "date", "w"])
        got = X.cap_weights(spark.createDataFrame(raw), cap).toPandas().set_index(["date", "series_id"])["w"]

        def clip(w):
            w = w.to_numpy().copy()
            for _ in range(200):
                over, free = np.maximum(w - cap, 0).sum(), w < cap - 1e-12
                w = np.minimum(w, cap)
                if over <= 0 or not free.any() or w[free].sum() <= 0:
                    break
                w[free] += over * w[free] / w[free].sum()
            return np.minimum(w, cap)

        want = pd.concat([pd.Series(clip(g["w"]), index=pd.MultiIndex.from_frame(g[["date", "series_id"]])) for _, g in raw.groupby("date")])
        np.testing.assert_allclose(got.reindex(want.index), want, atol=1e-9)


def test_expanding_quantile_of_many_dates(spark):
    rng = np.random.default_rng(1)
    n = 100_000
    x = np.round(rng.normal(0, 5, n), 2)
    x[rng.random(n) < 0.1] = np.nan
    pdf = pd.DataFrame({"date": np.arange(n), "x": x})
    got = expanding_quantile(spark.createDataFrame(pdf.replace({np.nan: None}), "date long, x double"), "x", 0.6, "q", 52).toPandas().sort_values("date")["q"]
    np.testing.assert_allclose(got.astype(float).to_numpy(), pdf["x"].expanding(52).quantile(0.6).to_numpy(), atol=1e-9)


def test_expanding_quantile_by_key(spark):
    w = prices(n=120, k=3, holes=0.2)
    got = expanding_quantile(frame(spark, w, "x"), "x", 0.25, "q", 5, ("series_id",)).toPandas().pivot(index="date", columns="series_id", values="q")
    np.testing.assert_allclose(got.to_numpy(float), w.expanding(5).quantile(0.25).to_numpy(), atol=1e-9)


@pytest.mark.parametrize("seed", range(4))
def test_folds_equal_loops(spark, seed):
    rng = np.random.default_rng(seed)
    n = 300
    px = np.round(np.exp(np.cumsum(rng.normal(0, 0.03, n))) * 50, 2)
    px[rng.random(n) < 0.05] = np.nan
    pdf = pd.DataFrame({"series_id": "s", "date": [datetime.date(2020, 1, 1) + datetime.timedelta(days=k) for k in range(n)], "pos": range(n), "adj_close": px, "high": px * 1.01, "low": px * 0.99,
                        "atr": np.where(np.arange(n) < 10, np.nan, 1.0), "mask": rng.random(n) < 0.95, "br": rng.random(n) < 0.2, "en": rng.random(n) < 0.2, "ex": rng.random(n) < 0.3})
    df = spark.createDataFrame(pdf.astype(object).where(pdf.notna(), None), "series_id string, date date, pos int, adj_close double, high double, low double, atr double, mask boolean, br boolean, en boolean, ex boolean")
    read = lambda x: x.orderBy("pos").toPandas()["held"].tolist()

    held, age, want = False, 0, []
    for en, ex in zip(pdf["en"], pdf["ex"]):
        age = age + 1 if held else 0
        held = (not (ex and not en and age >= 3)) if held else bool(en)
        want.append(held)
    x = ST.min_hold_latch(df, "en", "ex", 3)
    assert read(x) == want and "Python" not in plan(x) and "Pandas" not in plan(x)

    held, top, want = False, np.nan, []
    for r in pdf.itertuples():
        stay = held and not r.adj_close < top - 0.5 * r.atr
        enter = not stay and r.br and r.mask
        top = np.fmax(top, r.adj_close) if stay else r.adj_close
        held = bool((stay or enter) and r.mask)
        want.append(held)
    assert read(ST.trailing_stop(df, "br", "atr", 0.5)) == want

    long, lo, hi, last, age, want = False, np.nan, np.nan, np.nan, 0, []
    for r in pdf.itertuples():
        mid = (r.high + r.low) / 2
        up, down = r.adj_close > hi, r.adj_close < lo
        age += long
        if up and not long:
            age = 0
        long = True if up else False if long and down and age >= 2 else long
        lo, hi = (np.fmax(mid - r.atr, lo) if last > lo else mid - r.atr), (np.fmin(mid + r.atr, hi) if last < hi else mid + r.atr)
        last = r.adj_close
        want.append(bool(long and r.mask))
    assert read(ST.ratchet_band(df, "atr", 1.0, 2)) == want


def test_sub_periods_without_a_ratio_stay_in_the_denominators(spark):
    met = "struct<sharpe:double,calmar:double,max_drawdown:double,cagr:double>"
    schema = f"strategy string, family string, metrics_dev {met}, metrics_holdout {met}, psr_dev double, annual_turnover double, concentration struct<top_name_share:double>, spec struct<params:map<string,string>>, subperiods array<struct<period:string,sharpe:double>>"
    one = (1.0, 1.0, -0.2, 0.1)
    rows = [(name, "f", one, one, 0.9, 1.0, (0.3,), ({},), [(f"p{k}", v) for k, v in enumerate(subs)])
            for name, subs in (("all", [1.0, 2.0, 1.5, 0.5]), ("some", [1.0, None, float("nan"), 0.5]), ("low", [-1.0, -1.0, -1.0, None]), ("lost", [-1.0, -1.0, None, None]))]
    got = {r["strategy"]: (r["stability"], r["fails_early"]) for r in RK.score(spark.createDataFrame(rows, schema)).collect()}
    assert got == {"all": (1.0, False), "some": (0.5, False), "low": (0.0, True), "lost": (0.0, False)}


def test_limitations_of_a_store(spark):
    from barloom.operators import quality as Q

    one = lambda names, **more: spark.createDataFrame([(n, *more.values()) for n in names], "series_id string" + "".join(f", {k} string" for k in more))
    macro = spark.createDataFrame([("RATE", 1.0), ("RATE", 2.0), ("VIX", 1.0)], "series string, value double")
    none = macro.where("false")
    bars = one(["A", "A", "B", "B"])
    full = Q.limitations(bars, one(["A"], delisted="1999-01-01"), one(["A", "B"]), macro, one(["A", "B", "B"]), one(["A", "B"], adjustment="total_return"), "RATE", "VIX")
    assert [tuple(r) for r in full.collect()] == [("macro_revised", 2, 2)]
    thin = Q.limitations(bars, one(["A", "C"], delisted="1999-01-01"), one(["A", "B"]), none, one(["A", "A"]), one(["B", "B", "C"], adjustment="split_only"), "RATE", "VIX")
    assert {r["limitation"]: (r["n"], r["of"]) for r in thin.collect()} == {"split_only_prices": (1, 2), "no_rate": (0, 1), "no_vix": (0, 1), "macro_revised": (0, 0), "fundamentals_partial": (1, 2), "delisted_incomplete": (1, 2)}
    assert Q.gate_flags(full).first().asDict() == {"delisted_incomplete": False, "split_only_prices": False, "fundamentals_partial": False, "macro_revised": True, "no_vix": False}
    checks = spark.createDataFrame([("x", True, 1, True)], "check string, ok boolean, n bigint, fatal boolean")
    assert tuple(Q.gate_status(checks, thin).first()) == ("PASS WITH LIMITATIONS", 0, 0, 6)
    assert tuple(Q.gate_status(checks, thin.where("false")).first()) == ("PASS FOR RESEARCH", 0, 0, 0)
    empty = Q.limitations(bars.where("false"), one([], delisted=""), one([]), none, one([]), one([], adjustment=""), "RATE", "VIX")
    assert sorted(r["limitation"] for r in empty.collect()) == ["macro_revised", "no_rate", "no_vix"]
