import math
from statistics import NormalDist

import numpy as np
import pandas as pd
import pytest
from helpers import frame, prices, toy_market, wide
from pyspark.sql import functions as F

from barloom.functions import mathx as MX
from barloom.functions import rolling as R
from barloom.operators import gram
from barloom.operators import metrics as M
from barloom.operators import ranking as RK
from barloom.operators import resample as V
from barloom.operators import returns as B
from barloom.operators.allocation import equal_marginal_risk
from barloom.operators.panel import calendar
from barloom.plans import ml
from barloom.plans.signals import SIGNALS


def curve(spark, r, start="2015-01-02", **ids):
    d = pd.bdate_range(start, periods=len(r)).date
    ids = ids or {"strategy": "s"}
    return spark.createDataFrame([(*ids.values(), a, float(b)) for a, b in zip(d, r)], ", ".join(f"{k} string" for k in ids) + ", date date, ret double")


def test_normal_functions(spark):
    xs = [-9.0, -4.2, -1.0, -0.1, 0.0, 0.5, 2.3, 6.0, 8.5]
    got = spark.createDataFrame([(x,) for x in xs], "x double").select("x", MX.norm_cdf("x").alias("p")).collect()
    for r in got:
        assert abs(r["p"] - 0.5 * math.erfc(-r["x"] / math.sqrt(2))) < 1e-14 + 1e-9 * min(r["p"], 1 - r["p"])
    ps = [1e-6, 0.01, 0.024, 0.3, 0.5, 0.9, 0.99, 0.9999]
    for r in spark.createDataFrame([(p,) for p in ps], "p double").select("p", MX.norm_ppf("p").alias("z")).collect():
        assert abs(r["z"] - NormalDist().inv_cdf(r["p"])) < 1e-7


def test_known_drawdown_and_metrics(spark):
    c = curve(spark, [0.10, -0.50] + [0.0] * 58)
    s = M.summary(c, ["strategy"]).first()
    assert abs(s["max_drawdown"] + 0.5) < 1e-12 and s["max_dd_duration"] == 59 and abs(s["total_return"] - (1.1 * 0.5 - 1)) < 1e-12
    rng = np.random.default_rng(0)
    r = pd.Series(rng.normal(0.0005, 0.01, 800), index=pd.bdate_range("2015-01-02", periods=800))
    s = M.summary(curve(spark, r), ["strategy"]).first()
    assert abs(s["skew"] - r.skew()) < 1e-10 and abs(s["kurtosis"] - r.kurt()) < 1e-9
    assert abs(s["var_95"] - np.quantile(r, 0.05)) < 1e-12
    assert abs(s["sharpe"] - r.mean() / r.std() * np.sqrt(252)) < 1e-10
    years = (r.index[-1] - r.index[0]).days / 365.25
    assert abs(s["cagr"] - ((1 + r).prod() ** (1 / years) - 1)) < 1e-10
    assert abs(s["best_month"] - ((1 + r).resample("ME").prod() - 1).max()) < 1e-12


def test_leave_one_year_out_matches_direct(spark):
    rng = np.random.default_rng(1)
    r = pd.Series(rng.normal(0.0005, 0.01, 1300), index=pd.bdate_range("2015-01-02", periods=1300))
    sh = lambda x: x.mean() / x.std() * np.sqrt(252)
    vals = {y: sh(r[r.index.year != y]) for y in sorted(set(r.index.year))}
    got = M.leave_one_year_out(curve(spark, r), ["strategy"]).first()
    assert abs(got["min"] - min(vals.values())) < 1e-9 and abs(got["max"] - max(vals.values())) < 1e-9
    assert got["most_supportive_year"] == min(vals, key=vals.get) and got["worst_year_removed"] == max(vals, key=vals.get)


@pytest.mark.parametrize("block", [3, 256])
def test_blocked_correlation_matches_pandas_with_gaps(spark, block):
    w = prices(n=80, k=11, holes=0.2).pct_change(fill_method=None)
    x = frame(spark, w, "x").where("x is not null").withColumn("g", F.lit(1))
    p = gram.pairwise(x, ["g"], "series_id", "pos", "x", block=block).toPandas()
    corr, cov = w.corr(), w.cov()
    assert len(p) == 11 * 12 / 2
    for r in p.itertuples():
        assert abs(r.corr - corr.loc[r.a, r.b]) < 1e-9 and abs(r.cov - cov.loc[r.a, r.b]) < 1e-12
    m = gram.mean_corr(x, ["g"], "series_id", "pos", "x", block=block).toPandas().set_index("id")["mean_corr"]
    want = (corr.sum(axis=1) - 1) / 10
    np.testing.assert_allclose(m.reindex(want.index), want, atol=1e-9)
    few = gram.pairwise(x, ["g"], "series_id", "pos", "x", min_corr=0.1, block=block).toPandas()
    assert set(zip(few.a, few.b)) == {(a, b) for a in corr for b in corr if a < b and corr.loc[a, b] > 0.1}


def test_equal_risk_on_diagonal_correlated_and_unusable_covariance(spark):
    def rows(g, m):
        return [(g, f"s{i}", f"s{j}", float(m[i][j])) for i in range(len(m)) for j in range(i, len(m))]

    two = np.array([[1.0, 0.2], [0.2, 2.0]])
    cov = rows("diag", np.diag([1.0, 4.0, 9.0])) + rows("two", two) + rows("one", [[1.0]]) + rows("nan", np.full((3, 3), np.nan)) + rows("gap", np.eye(3))[:-2] + rows("sunk", -np.eye(2))
    got = equal_marginal_risk(spark.createDataFrame(cov, "g string, a string, b string, cov double"), ["g"]).toPandas().set_index(["g", "id"])["w"]
    assert set(got.index.get_level_values(0)) == {"diag", "two", "sunk"}
    np.testing.assert_allclose(got["diag"].sort_index(), np.array([1, 1 / 4, 1 / 9]) / (1 + 1 / 4 + 1 / 9), atol=1e-9)
    np.testing.assert_allclose(got["sunk"], 0.5)
    m = two.copy()
    m[0, 1] = m[1, 0] = 0.9 * 0.2
    risk = m @ got["two"].sort_index().to_numpy()
    assert abs(risk[0] - risk[1]) < 1e-6


def test_walk_forward_matches_loop(spark):
    rng = np.random.default_rng(5)
    idx = pd.bdate_range("2015-01-02", periods=900)
    panel = pd.DataFrame(rng.normal(0.0003, 0.01, (900, 4)), index=idx, columns=list("abcd"))
    c = None
    for v in panel:
        x = curve(spark, panel[v], family="f", strategy=v)
        c = x if c is None else c.unionByName(x)
    comp, log = V.walk_forward(c, ["family"], "strategy", 12, 3)
    steps = pd.date_range(idx[0] + pd.DateOffset(months=12), idx[-1], freq="3MS")
    sh = lambda x: x.mean() / x.std() * np.sqrt(252)
    want = {s.date(): max(panel, key=lambda v: sh(panel[v].loc[: s - pd.Timedelta(days=1)])) for s in steps}
    got = {r["step"]: r["selected"] for r in log.collect()}
    assert got == want
    assert comp.count() == len(idx[idx >= steps[0]])


def test_bootstraps_bracket_the_point_and_ignore_partitioning(spark):
    rng = np.random.default_rng(6)
    c = curve(spark, rng.normal(0.001, 0.01, 500))
    a = V.block_bootstrap(c, ["strategy"], 200, 21, 1).first()
    b = V.block_bootstrap(c.repartition(7), ["strategy"], 200, 21, 1).first()
    assert abs(a["lo"] - b["lo"]) < 1e-9 and a["lo"] < a["point"] < a["hi"]
    s = V.stationary_bootstrap(c, ["strategy"], 100, 21, 1).first()
    assert s["lo"] < s["point"] < s["hi"]
    short = V.block_bootstrap(curve(spark, [0.01, 0.02] * 10), ["strategy"], 10, 21).first()
    assert short["point"] is None and short["lo"] is None


def test_deflated_sharpe_falls_with_trials(spark):
    rng = np.random.default_rng(8)
    c = None
    for i in range(6):
        x = curve(spark, rng.normal(0.0004 + 0.0001 * i, 0.01, 600), family="f", strategy=f"v{i}")
        c = x if c is None else c.unionByName(x)
    failed = spark.range(60).select(F.lit("f").alias("family"))
    few = {r["strategy"]: r["dsr"] for r in V.deflated_sharpe(c, ["family"], "strategy").collect()}
    many = {r["strategy"]: r["dsr"] for r in V.deflated_sharpe(c, ["family"], "strategy", failed).collect()}
    psr = {r["strategy"]: r["psr"] for r in M.probabilistic_sharpe(c, ["family", "strategy"]).collect()}
    for k in few:
        assert few[k] < psr[k]
    assert sum(many.values()) != sum(few.values())


def test_costs_lag_and_neutrality(spark):
    m = toy_market(spark, prices(n=260, k=8))
    w = SIGNALS["market_neutral_momentum"](m, lookback=60, skip=5, n=3).cache()
    tot = w.groupBy("date").agg(F.sum("w").alias("s"), F.sum(F.abs("w")).alias("g")).collect()
    assert all(abs(r["s"]) < 1e-12 and abs(r["g"] - 1) < 1e-12 for r in tot)
    net = B.net_curves(w, m.panel, m.cal, "me", capitals=[1e6]).groupBy("scenario").agg(F.sum("ret").alias("r"), F.sum("cost").alias("c"), F.sum("borrow").alias("b")).collect()
    by = {r["scenario"]: r for r in net}
    assert by["zero"]["r"] > by["low"]["r"] > by["base"]["r"] > by["stressed"]["r"] and by["zero"]["c"] == 0 and by["base"]["b"] > 0
    first = w.agg(F.min("date")).first()[0]
    held = B.held_weights(w, m.cal, "me", lagged=True).agg(F.min("date")).first()[0]
    assert held > first


def test_perfect_foresight_gains_nothing_from_its_own_bar(spark):
    w = prices(n=120, k=3)
    m = toy_market(spark, w)
    best = m.panel.where("ret is not null").groupBy("date").agg(F.max_by("series_id", "ret").alias("series_id")).withColumn("w", F.lit(1.0))
    g = B.portfolio_returns(best, m.panel, m.cal, "day").agg(F.avg("gross")).first()[0]
    assert g < float((w / w.shift(1) - 1).max(axis=1).mean()) * 0.5


@pytest.mark.parametrize("name,kw", [
    ("xs_momentum", {"lookback": 30, "skip": 5, "n": 3}), ("residual_momentum", {"lookback": 30, "skip": 5, "beta_window": 40, "n": 3}), ("donchian_breakout", {"entry_window": 20, "exit_window": 10, "index_trend": 30}),
    ("gaussian_bands", {"period": 20, "atr_window": 10, "band": 0.5}), ("supertrend", {"atr_window": 10, "mult": 1.0}), ("trend_follow_cash", {"window": 30}), ("min_correlation", {"window": 42, "n": 3}),
    ("quiet_trend", {"trend": 20, "vol_window": 10, "q": 0.75, "lookback": 60, "min_history": 30}), ("high_proximity", {"window": 60, "n": 3, "floor": 0.8}),
])
def test_truncation_does_not_change_the_past(spark, name, kw):
    full = prices(n=220, k=6)
    a, b = (SIGNALS[name](toy_market(spark, w), **kw).toPandas() for w in (full, full.iloc[:170]))
    cut = full.index[120].date()
    key = lambda d: d[d.date < cut].set_index(["date", "series_id"])["w"].sort_index()
    x, y = key(a), key(b)
    assert len(x) and x.index.equals(y.index)
    np.testing.assert_allclose(x, y, atol=1e-10)


def test_ridge_scores_match_numpy(spark):
    w = prices(n=420, k=7, seed=11)
    m = toy_market(spark, w)
    horizon, alpha, min_train = 3, 10.0, 150
    got = wide(ml.ridge_scores(m.panel, m.cal, ml.feature_columns(week=True), horizon, alpha, 6, min_train, 100), "score")
    r = w / w.shift(1) - 1
    mom = lambda lb, sk=0: w.shift(sk) / w.shift(lb) - 1
    f = {"f_mom_s": mom(4), "f_mom_m": mom(13), "f_mom_h": mom(26), "f_mom_ys": mom(52, 4), "f_rev": -mom(1), "f_vol": r.rolling(13).std() * np.sqrt(252), "f_dist": w / w.rolling(40).mean() - 1}
    names, cal, y = sorted(f), w.index, w.shift(-horizon) / w - 1
    refits = pd.date_range(cal[0], cal[-1], freq="6MS")
    checked = 0
    for i, d in enumerate(refits):
        start = cal.searchsorted(d)
        end = start - 1 - horizon
        stop = cal.searchsorted(refits[i + 1]) if i + 1 < len(refits) else len(cal)
        x = np.column_stack([f[n].iloc[:max(end, 0)].to_numpy().ravel() for n in names])
        t = y.iloc[:max(end, 0)].to_numpy().ravel()
        ok = np.isfinite(x).all(1) & np.isfinite(t) if len(t) else np.array([], bool)
        if end < min_train or ok.sum() < 100:
            continue
        x, t = x[ok], t[ok]
        mu, sd = x.mean(0), x.std(0)
        z = (x - mu) / sd
        beta = np.linalg.solve(z.T @ z + alpha * np.eye(len(names)), z.T @ (t - t.mean()))
        for s in w.columns:
            for p in range(start, stop):
                v = np.array([f[n][s].iloc[p] for n in names])
                assert abs(got.loc[cal[p], s] - (t.mean() + ((v - mu) / sd) @ beta)) < 1e-9
                checked += 1
    assert checked > 100 and checked == got.notna().sum().sum()


def test_blend_drifts_inside_the_month_and_tax_orders(spark):
    rng = np.random.default_rng(9)
    a, b = rng.normal(0.001, 0.02, 60), rng.normal(0.0, 0.02, 60)
    c = curve(spark, a, strategy="a").unionByName(curve(spark, b, strategy="b"))
    mem = spark.createDataFrame([("m", "a", 0.5), ("m", "b", 0.5)], "blend string, strategy string, weight double")
    got = B.blend(c, mem).toPandas().sort_values("date")["ret"].to_numpy()
    idx = pd.bdate_range("2015-01-02", periods=60)
    want = []
    for _, m in pd.DataFrame({"a": a, "b": b}, index=idx).groupby(pd.Grouper(freq="ME")):
        v = (1 + m).cumprod().mean(axis=1)
        want += list(v / v.shift(1).fillna(1.0) - 1)
    np.testing.assert_allclose(got, want, atol=1e-12)
    up = curve(spark, np.full(900, 0.0005)).withColumn("turnover", F.lit(0.001))
    lo, hi = (B.tax_overlay(up.withColumn("turnover", F.lit(t)), ["strategy"]).first() for t in (0.0005, 0.01))
    deferred = B.tax_overlay(up, ["strategy"], deferred=True).first()
    assert hi["after_tax_cagr"] < lo["after_tax_cagr"] < lo["pre_tax_cagr"]
    assert hi["after_tax_cagr"] < deferred["after_tax_cagr"] < deferred["pre_tax_cagr"]


def test_rank_refuses_mixed_modes(spark):
    met = "struct<sharpe:double,cagr:double,calmar:double,max_drawdown:double>"
    schema = f"strategy string, family string, scenario string, status string, data_mode string, universe_hash string, freeze_version string, timestamp timestamp, metrics_dev {met}, metrics_holdout {met}, psr_dev double, annual_turnover double, concentration struct<top_name_share:double>, spec struct<params:map<string,string>>, subperiods array<struct<period:string,sharpe:double>>"
    import datetime as dt

    row = lambda s, mode, sh: (s, "xsmom", "base", "ok", mode, "u", "v", dt.datetime(2024, 1, 1), (sh, 0.1, 0.5, -0.2), (sh, 0.1, 0.5, -0.2), 0.9, 1.0, (0.2,), ({"a": "1"},), [])
    ok = spark.createDataFrame([row("a", "real", 1.0), row("b", "real", 2.0)], schema)
    assert [r["strategy"] for r in RK.rank(ok).orderBy(F.col("score").desc()).collect()] == ["b", "a"]
    mixed = spark.createDataFrame([row("a", "real", 1.0), row("b", "synthetic", 2.0)], schema)
    with pytest.raises(Exception, match="several data modes"):
        RK.rank(mixed).collect()


def test_focus_takes_the_higher_score_of_equal_sharpes_and_a_zero_mean_as_zero(spark):
    schema = "strategy string, family string, score double, dev_sharpe double, max_drawdown double, verdict string"
    row = lambda name, sharpe, score, family="growth": (name, family, score, sharpe, -0.1, f"verdict of {name}")
    rows = [row("A(basket=T1)", 0.1, 0.2), row("B(basket=T1)", 0.1, 0.9), row("C(basket=T1)", 0.1, 0.5),
            row("A(ticker=X1)", 0.1, 0.0), row("B(ticker=X1)", 0.2, 0.0), row("C(ticker=X1)", -0.3, 0.0),
            row("A(ticker=X2)", None, 9.0), row("B(ticker=X2)", 0.3, 0.1), row("C(ticker=X2)", 0.2, 0.1, None), row("D(ticker=X2)", 0.4, 9.0, "benchmark")]
    for order in (rows, rows[::-1]):
        got = {r["key"]: r for r in RK.focus(spark.createDataFrame(order, schema).coalesce(1)).collect()}
        assert (got["T1"]["best_strategy"], got["T1"]["best_verdict"]) == ("B(basket=T1)", "verdict of B(basket=T1)")
        assert got["X1"]["dispersion"] == 0.0
        assert (got["X2"]["n_trials"], got["X2"]["best_sharpe"], got["X2"]["best_strategy"]) == (2, 0.3, "B(ticker=X2)")


def test_calendar_marks_unfinished_bucket(spark):
    c = calendar(spark.createDataFrame([("2020-01-30",), ("2020-01-31",), ("2020-02-03",), ("2020-02-04",)], "d string").select(F.to_date("d").alias("date"))).orderBy("pos").collect()
    assert [r["me_stamp"] for r in c] == [False, True, False, True]
    assert [str(r["me_exec"]) for r in c] == ["None", "None", "2020-01-31", "2020-01-31"]
