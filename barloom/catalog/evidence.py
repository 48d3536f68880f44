"""Resampling, multiple testing, ranking and evidence tables."""

from pyspark.sql import functions as F

from ..functions import stats as S
from ..functions.mathx import expected_max_sharpe_sql, probabilistic_sharpe_sql
from ..operators import metrics as M
from ..operators import ranking as RK
from ..operators import resample as V
from ..plans import study
from ..plans.lab import family_independence
from ..session import materialize
from ..sources import curves as C
from .base import ORACLES, QUERIES, query
from .metrics import ID, SQL_CORR, SQL_CURVES, SQL_MONTHLY, SQL_PER, sql_dd
from .metrics import stored_curves as curves
from .returns import CAGR, SHARPE

G1 = "CASE WHEN count(ret) > 2 THEN skewness(ret) * (count(ret) - 2) / sqrt(count(ret) * (count(ret) - 1e0)) END"
U = lambda *k: f"(CAST('0x' || substr(md5(concat_ws('|', {', '.join(k)})), 1, 12) AS BIGINT) / 281474976710656e0)"
VR = ["family", "strategy"]

# ------------------------------------------------------------------ walk-forward and resampling
SQL_WF = f"""c1 AS (SELECT *, min(date) OVER (PARTITION BY family) AS lo FROM cv WHERE family <> 'benchmark'),
s0 AS (SELECT family, min(lo) AS lo, max(date) AS hi, (SELECT min(CAST(x AS DATE)) FROM (SELECT unnest(generate_series(CAST(date_trunc('month', min(lo) + INTERVAL 24 MONTH) AS TIMESTAMP), CAST(max(date) AS TIMESTAMP), INTERVAL 1 MONTH)) AS x) WHERE x >= CAST(min(lo) + INTERVAL 24 MONTH AS DATE)) AS st FROM c1 GROUP BY 1),
stp AS (SELECT family, CAST(unnest(generate_series(CAST(st AS TIMESTAMP), CAST(hi AS TIMESTAMP), INTERVAL 6 MONTH)) AS DATE) AS step FROM s0),
nx AS (SELECT *, lead(step) OVER (PARTITION BY family ORDER BY step) AS nxt FROM stp),
sc AS (SELECT nx.family, step, nxt, strategy, avg(ret) / stddev_samp(ret) * sqrt(252e0) AS s FROM nx JOIN c1 ON c1.family = nx.family AND c1.date < step GROUP BY 1, 2, 3, 4),
pk AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY family, step ORDER BY s DESC, strategy) AS rn FROM sc) WHERE rn = 1),
wf AS (SELECT c1.family, c1.date, c1.strategy, c1.ret FROM pk JOIN c1 ON c1.family = pk.family AND c1.strategy = pk.strategy AND c1.date >= step AND (nxt IS NULL OR c1.date < nxt))"""


def active(spark, d):
    return curves(spark, d).where("family <> 'benchmark'")


@query("v1_walk_forward_log", "family:s step:d selected:s train_score:f", f"{SQL_CURVES}, {SQL_WF}, out AS (SELECT family, step, strategy AS selected, s AS train_score FROM pk)")
def v1l(spark, d):
    return V.walk_forward(active(spark, d), ["family"], "strategy", 24, 6)[1]


@query("v1_walk_forward_returns", "family:s date:d strategy:s ret:f", f"{SQL_CURVES}, {SQL_WF}, out AS (SELECT * FROM wf)")
def v1(spark, d):
    return V.walk_forward(active(spark, d), ["family"], "strategy", 24, 6)[0]


@query("j8_walk_forward_sharpe", "family:s n:i sharpe:f", f"{SQL_CURVES}, {SQL_WF}, out AS (SELECT family, count(*) AS n, {SHARPE} AS sharpe FROM wf GROUP BY 1)")
def j8(spark, d):
    return V.walk_forward(active(spark, d), ["family"], "strategy", 24, 6)[0].groupBy("family").agg(F.count("*").alias("n"), S.sharpe("ret").alias("sharpe"))


NUM = "nm AS (SELECT strategy, ret, row_number() OVER (PARTITION BY strategy ORDER BY date) - 1 AS i, count(*) OVER (PARTITION BY strategy) AS n FROM cv)"


def sql_boot(n_boot: int, block: int) -> str:
    return f"""{NUM}, ln AS (SELECT strategy, max(n) AS n, CAST(ceil(max(n) / {block}e0) AS BIGINT) AS nb FROM nm GROUP BY 1 HAVING max(n) >= {2 * block}),
rp AS (SELECT strategy, n, nb, rep, unnest(generate_series(0, nb - 1)) AS k FROM (SELECT *, unnest(generate_series(0, {n_boot - 1})) AS rep FROM ln)),
dr AS (SELECT *, CAST(floor({U("'7'", 'strategy', 'rep', 'k')} * (n - {block})) AS BIGINT) AS i0 FROM rp),
ob AS (SELECT strategy, rep, i0 + o AS i FROM (SELECT *, unnest(generate_series(0, {block - 1})) AS o FROM dr) WHERE k * {block} + o < n),
bt AS (SELECT ob.strategy, rep, {SHARPE} AS stat FROM ob JOIN nm ON nm.strategy = ob.strategy AND nm.i = ob.i GROUP BY 1, 2),
bci AS (SELECT strategy, quantile_cont(stat, 0.05) AS lo, quantile_cont(stat, 0.95) AS hi, count(stat) AS n_boot FROM bt GROUP BY 1)"""


PT = f"pt AS (SELECT strategy, CASE WHEN count(*) >= {{need}} THEN {SHARPE} END AS point FROM cv GROUP BY 1)"


@query("v2_block_bootstrap", "strategy:s point:f lo:f hi:f n_boot:i", f"{SQL_CURVES}, {sql_boot(2000, 21)}, {PT.format(need=42)}, out AS (SELECT pt.strategy, point, lo, hi, n_boot FROM pt LEFT JOIN bci USING (strategy))")
def v2(spark, d):
    return V.block_bootstrap(curves(spark, d), ID, 2000, 21, 7)


@query("v3_stationary_bootstrap", "strategy:s point:f lo:f hi:f n_boot:i", f"""{SQL_CURVES}, {NUM}, ln AS (SELECT strategy, max(n) AS n FROM nm GROUP BY 1 HAVING max(n) >= 42),
rp AS (SELECT strategy, n, rep, unnest(generate_series(0, least(n, 200) - 1)) AS k FROM (SELECT *, unnest(generate_series(0, 1999)) AS rep FROM ln)),
dr AS (SELECT *, CAST(1 + floor(ln(1 - {U("'7'", "'r'", 'strategy', 'rep', 'k')}) / ln(1 - 1e0 / 21)) AS BIGINT) AS len, CAST(floor({U("'7'", "'s'", 'strategy', 'rep', 'k')} * n) AS BIGINT) AS s0 FROM rp),
sg AS (SELECT *, CAST(sum(len) OVER (PARTITION BY strategy, rep ORDER BY k) - len AS BIGINT) AS t0 FROM dr),
ix AS (SELECT strategy, rep, (s0 + unnest(range(least(len, n - t0)))) % n AS i FROM sg WHERE t0 < n),
bt AS (SELECT ix.strategy, rep, {SHARPE} AS stat FROM ix JOIN nm ON nm.strategy = ix.strategy AND nm.i = ix.i GROUP BY 1, 2),
ci AS (SELECT strategy, quantile_cont(stat, 0.05) AS lo, quantile_cont(stat, 0.95) AS hi, count(stat) AS n_boot FROM bt GROUP BY 1), {PT.format(need=42)},
out AS (SELECT pt.strategy, point, lo, hi, n_boot FROM pt LEFT JOIN ci USING (strategy))""")
def v3(spark, d):
    return V.stationary_bootstrap(curves(spark, d), ID, 2000, 21, 7)


def sql_perm(n: int) -> str:
    return f"""pp AS (SELECT strategy, path, ret, i, {U("'7'", 'strategy', 'path', 'i')} AS u FROM (SELECT *, unnest(generate_series(0, {n - 1})) AS path FROM nm)),
pe AS (SELECT strategy, path, u, i, exp(sum(ln(1 + ret)) OVER (PARTITION BY strategy, path ORDER BY u, i)) AS e FROM pp),
pd AS (SELECT strategy, path, min(dd) AS mdd FROM (SELECT *, e / max(e) OVER (PARTITION BY strategy, path ORDER BY u, i) - 1 AS dd FROM pe) GROUP BY 1, 2),
{sql_dd('cv', 'strategy', 'od')}, ob2 AS (SELECT strategy, min(drawdown) AS observed FROM od GROUP BY 1),
mc AS (SELECT strategy, median(mdd) AS mdd_median, quantile_cont(mdd, 0.05) AS mdd_p95, avg(CASE WHEN mdd > observed THEN 1e0 ELSE 0e0 END) AS order_luck, max(observed) AS observed FROM pd JOIN ob2 USING (strategy) GROUP BY 1)"""


@query("v4_permutation_drawdowns", "strategy:s mdd_median:f mdd_p95:f order_luck:f observed:f", f"{SQL_CURVES}, {NUM}, {sql_perm(2000)}, out AS (SELECT * FROM mc)")
def v4(spark, d):
    return V.permutation_drawdowns(curves(spark, d), ID, 2000, 7)


MOM = f"count(ret) AS n, avg(ret) AS m, stddev_samp(ret) AS sd, {G1} AS g3, kurtosis_pop(ret) + 3 AS g4"


@query("v5_probabilistic_sharpe", "strategy:s n:i psr:f", f"{SQL_CURVES}, q AS (SELECT strategy, {MOM} FROM cv GROUP BY 1), out AS (SELECT strategy, n, {probabilistic_sharpe_sql('n', 'm', 'sd', 'g3', 'g4', '0.3e0')} AS psr FROM q)")
def v5(spark, d):
    return M.probabilistic_sharpe(curves(spark, d), ID, bench_ann=0.3)


SQL_TR = f"tr AS (SELECT family, strategy, {SHARPE} AS sharpe, count(*) AS n_days FROM cv GROUP BY 1, 2)"
SQL_BAT = f"ba AS (SELECT family, count(*) AS n_trials, var_pop(sharpe / sqrt(252e0)) AS v FROM {{src}} WHERE sharpe IS NOT NULL GROUP BY 1), be AS (SELECT family, n_trials, {expected_max_sharpe_sql('n_trials', 'v')} * sqrt(252e0) AS expected_max FROM ba)"


@query("v6_expected_max_sharpe", "family:s n_trials:i expected_max:f", f"{SQL_CURVES}, {SQL_TR}, {SQL_BAT.format(src='tr')}, out AS (SELECT * FROM be)")
def v6(spark, d):
    return V.battery(V.trial_sharpes(curves(spark, d), VR), ["family"])


SQL_DSR = f"q AS (SELECT family, strategy, {MOM} FROM cv GROUP BY 1, 2), dj AS (SELECT *, CASE WHEN n_trials < 2 THEN 0e0 ELSE expected_max END AS bench FROM q JOIN be USING (family)), ds AS (SELECT family, strategy, n_trials, expected_max, {probabilistic_sharpe_sql('n', 'm', 'sd', 'g3', 'g4', 'bench')} AS dsr FROM dj)"


@query("v7_deflated_sharpe", "family:s strategy:s n_trials:i expected_max:f dsr:f", f"{SQL_CURVES}, {SQL_TR}, {SQL_BAT.format(src='tr')}, {SQL_DSR}, out AS (SELECT * FROM ds)")
def v7(spark, d):
    return V.deflated_sharpe(curves(spark, d), ["family"], "strategy")


@query("v9_parameter_sensitivity", "family:s strategy:s sharpe:f n_days:i rank:i neighbor_stability:f", f"""{SQL_CURVES}, {SQL_TR}, out AS (SELECT *, row_number() OVER (PARTITION BY family ORDER BY sharpe DESC, strategy) AS rank,
 stddev_samp(sharpe) OVER (PARTITION BY family ORDER BY sharpe DESC, strategy ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS neighbor_stability FROM tr)""")
def v9(spark, d):
    return V.parameter_sensitivity(V.trial_sharpes(curves(spark, d), VR), ["family"], "strategy")


@query("w28_neighbour_stability", "family:s strategy:s neighbor_stability:f", f"""{SQL_CURVES}, {SQL_TR}, out AS (SELECT *, stddev_samp(sharpe) OVER (PARTITION BY family ORDER BY sharpe DESC, strategy ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS neighbor_stability FROM tr)""")
def w28(spark, d):
    return V.parameter_sensitivity(V.trial_sharpes(curves(spark, d), VR), ["family"], "strategy")


# ------------------------------------------------------------------ registry
SQL_REG = f"""{SQL_PER}, cs AS (SELECT cv.* EXCLUDE (ret), ret - c AS ret, scenario, CASE WHEN date < DATE '1999-11-05' THEN 'dev' ELSE 'holdout' END AS split FROM cv CROSS JOIN (VALUES ('base', 0e0), ('stressed', 0.0008e0)) s(scenario, c)),
{sql_dd('cs', 'strategy, scenario, split', 'rd')},
ms AS (SELECT strategy, family, cls, line, scenario, split, {SHARPE} AS sharpe, {CAGR} AS cagr, min(drawdown) AS mdd, avg(turnover) * 252 AS tov, {MOM} FROM rd GROUP BY 1, 2, 3, 4, 5, 6),
mm AS (SELECT *, CASE WHEN mdd < 0 THEN cagr / abs(mdd) END AS calmar, {probabilistic_sharpe_sql('n', 'm', 'sd', 'g3', 'g4')} AS psr FROM ms),
rp0 AS (SELECT strategy, scenario, cs.date, cs.ret, period FROM cs JOIN per ON date BETWEEN lo AND hi),
sp AS (SELECT strategy, scenario, period, {SHARPE} AS s FROM rp0 GROUP BY 1, 2, 3 HAVING count(*) >= 40),
sa AS (SELECT strategy, scenario, count(*) AS n_sub, avg(CASE WHEN s > 0 THEN 1e0 ELSE 0e0 END) AS stab, stddev_samp(s) AS spread, count(*) FILTER (WHERE period <> 'ai_rally') AS n_early,
 avg(CASE WHEN period <> 'ai_rally' THEN CASE WHEN s <= 0 THEN 1e0 ELSE 0e0 END END) AS early_bad FROM sp GROUP BY 1, 2),
r0 AS (SELECT strategy, family, cls, line, scenario, """ + ", ".join(f"max(CASE WHEN split = '{s}' THEN {c} END) AS {s}_{c}" for s in ("dev", "holdout") for c in ("sharpe", "cagr", "calmar", "mdd", "psr", "tov")) + """ FROM mm GROUP BY 1, 2, 3, 4, 5),
rn AS (SELECT r0.*, n_sub, stab, spread, n_early, early_bad, cls = 'Rotate' AND line = 5 AS failed, 0.3e0 + 0.05e0 * line AS top_share,
 TIMESTAMP '2024-03-01 00:00:00' + to_hours(line) + to_days(CAST(length(cls) AS INTEGER)) AS ts, 'u2' AS uh FROM r0 LEFT JOIN sa USING (strategy, scenario)),
reg AS (SELECT * FROM rn UNION ALL SELECT * REPLACE (ts - INTERVAL 40 DAY AS ts, 'u1' AS uh) FROM rn WHERE cls = 'Growth')"""
RG = f"{SQL_CURVES}, {SQL_REG}"


def registry(spark, d, c=None):
    """The registry as a written table, built from the stored curves."""
    return materialize(C.registry(curves(spark, d) if c is None else c), "registry")


@query("r1_current_cohort", "strategy:s scenario:s family:s", f"{RG}, out AS (SELECT strategy, scenario, family FROM reg WHERE uh = 'u2' AND NOT failed)")
def r1(spark, d):
    return RK.current_cohort(registry(spark, d))


SQL_SCORE = """ok AS (SELECT * FROM reg WHERE uh = 'u2' AND NOT failed),
s1 AS (SELECT *, coalesce(dev_sharpe, 0) AS ds, coalesce(holdout_sharpe, 0) AS hs, coalesce(dev_calmar, 0) AS cal, coalesce(dev_mdd, -1) AS dd, coalesce(dev_psr, 0.5e0) AS ps, coalesce(dev_tov, 0) AS tv,
 CASE WHEN n_sub >= 3 THEN stab ELSE 0.5e0 END AS st, CASE WHEN n_sub >= 3 THEN spread ELSE 1e0 END AS spr, coalesce(n_sub >= 3 AND n_early >= 2 AND early_bad > 0.6, FALSE) AS fails FROM ok),
s2 AS (SELECT *, greatest(ds - hs, 0) AS deg FROM s1),
s3 AS (SELECT *, round(2 * hs + ds + 0.5e0 * least(cal, 3) + st + (ps - 0.5e0) - deg - 0.3e0 * least(tv / 5, 2) - greatest(top_share - 0.5e0, 0) - 0.1e0 * 1 - 0.3e0 * least(spr / 2, 1) + 0.5e0 * dd - CASE WHEN fails THEN 1 ELSE 0 END, 3) AS score FROM s2),
sc AS (SELECT strategy, family, cls, scenario, score, round(ds, 2) AS dev_sharpe, round(hs, 2) AS holdout_sharpe, round(dev_cagr, 4) AS dev_cagr, round(holdout_cagr, 4) AS holdout_cagr, round(dd, 3) AS max_drawdown, round(cal, 2) AS calmar,
 round(ps, 3) AS psr, round(tv, 2) AS annual_turnover, round(top_share, 2) AS top_name_share, round(st, 2) AS stability, round(deg, 2) AS degradation, fails AS fails_early, ds AS raw_ds, line, dev_psr FROM s3)"""


@query("r2_score_record", "strategy:s family:s score:f dev_sharpe:f holdout_sharpe:f dev_cagr:f holdout_cagr:f max_drawdown:f calmar:f psr:f annual_turnover:f top_name_share:f stability:f degradation:f fails_early:b",
       f"{RG}, {SQL_SCORE}, out AS (SELECT * FROM sc WHERE scenario = 'base')")
def r2(spark, d):
    return RK.score(RK.current_cohort(registry(spark, d)).where("status = 'ok' and scenario = 'base'"))


SQL_RANK = f"""{SQL_SCORE}, rk0 AS (SELECT b.*, s.raw_ds AS stressed_sharpe, coalesce(b.dev_sharpe > 0.5 AND s.raw_ds < 0.25 * b.dev_sharpe, FALSE) AS cost_fragile FROM sc b LEFT JOIN (SELECT strategy, raw_ds FROM sc WHERE scenario = 'stressed') s USING (strategy) WHERE scenario = 'base'),
rk1 AS (SELECT * REPLACE (round(score - CASE WHEN cost_fragile THEN 1 ELSE 0 END, 3) AS score) FROM rk0),
rk AS (SELECT *, (SELECT coalesce(max(score), 0) FROM rk1 WHERE family = 'benchmark' AND (strategy NOT LIKE 'BuyAndHold(%' OR strategy IN ('BuyAndHold(ticker=SPY)', 'BuyAndHold(ticker=QQQ)'))) AS hurdle FROM rk1),
ranked AS (SELECT *, CASE WHEN family = 'benchmark' THEN 'benchmark' WHEN score > hurdle + 0.25 AND holdout_sharpe > 0 AND NOT cost_fragile THEN 'robust_candidate' WHEN score > hurdle - 1 AND holdout_sharpe > 0 THEN 'inconclusive' ELSE 'rejected' END AS verdict FROM rk)"""


@query("r3_rank_experiments", "strategy:s family:s score:f stressed_sharpe:f cost_fragile:b", f"{RG}, {SQL_RANK}, out AS (SELECT * FROM ranked)")
def r3(spark, d):
    return RK.rank(registry(spark, d))


@query("r4_hurdle_and_verdict", "strategy:s score:f hurdle:f verdict:s", f"{RG}, {SQL_RANK}, out AS (SELECT * FROM ranked)")
def r4(spark, d):
    return RK.rank(registry(spark, d))


@query("j14_stressed_vs_base", "strategy:s dev_sharpe:f stressed_sharpe:f", f"{RG}, {SQL_RANK}, out AS (SELECT * FROM ranked)")
def j14(spark, d):
    return RK.rank(registry(spark, d))


def mapped_family():
    return F.when(F.col("family") == "growth", "xsmom").when(F.col("family") == "value", "regime").when(F.col("family") == "rotate", "unknown").otherwise(F.col("family"))


SQL_TIER = """tiers AS (SELECT *, CASE WHEN failed THEN 'C' WHEN family = 'rotate' THEN 'B' WHEN family = 'value' THEN 'B' WHEN family = 'growth' THEN 'B' ELSE 'A' END AS tier,
 CASE WHEN failed THEN 'not run' WHEN family = 'rotate' THEN 'unrecognised family' WHEN family = 'value' THEN 'macro inputs are revised' WHEN family = 'growth' THEN 'universe lacks delisted names' ELSE 'complete adjusted histories' END AS tier_reason FROM reg WHERE uh = 'u2' AND scenario = 'base')"""


def tiered(reg):
    r = reg.where("scenario = 'base' and coalesce(universe_hash, 'u2') = 'u2'").withColumn("family", mapped_family())
    return RK.assign_tier(r, {"delisted_incomplete": True})


@query("r5_assign_tier", "strategy:s tier:s tier_reason:s", f"{RG}, {SQL_TIER}, out AS (SELECT * FROM tiers)")
def r5(spark, d):
    return tiered(registry(spark, d))


SQL_FAMS = f"{SQL_TR}, bv AS (SELECT family, strategy AS best_variant, sharpe - 1.5 AS ci_lo FROM (SELECT *, row_number() OVER (PARTITION BY family ORDER BY sharpe DESC, strategy) AS rn FROM tr) WHERE rn = 1)"


def best_variants(c):
    t = V.trial_sharpes(c, VR)
    return t.groupBy("family").agg(F.min_by("strategy", F.struct(-F.col("sharpe"), "strategy")).alias("best_variant"), (F.max("sharpe") - 1.5).alias("ci_lo"))


def capacities(c):
    return c.groupBy("strategy").agg(F.pow(F.lit(10.0), 5 + F.max("line") % 3).alias("capacity"))


@query("r6_decision_checks", "strategy:s family:s score:f tier_a:b robust_verdict:b not_concentrated:b not_late_only:b ci_positive:b capacity_ok:b passed:b", f"""{RG}, {SQL_RANK}, {SQL_TIER}, {SQL_FAMS},
k AS (SELECT r.strategy, r.family, r.score, coalesce(t.tier = 'A', FALSE) AS tier_a, verdict = 'robust_candidate' AS robust_verdict, top_name_share < 0.5 AS not_concentrated, NOT fails_early AS not_late_only, coalesce(ci_lo > 0, FALSE) AS ci_positive,
 coalesce(pow(10, 5 + r.line % 3) >= 1e6, FALSE) AS capacity_ok FROM ranked r LEFT JOIN (SELECT strategy, tier FROM tiers) t USING (strategy) LEFT JOIN bv ON bv.best_variant = r.strategy WHERE r.family <> 'benchmark'),
out AS (SELECT *, tier_a AND robust_verdict AND not_concentrated AND not_late_only AND ci_positive AND capacity_ok AS passed FROM k)""")
def r6(spark, d):
    c = curves(spark, d)
    reg = registry(spark, d, c)
    rk = RK.rank(reg).join(tiered(reg).select("strategy", "tier"), "strategy", "left")
    return RK.decision_checks(rk, best_variants(c), capacities(c))


@query("j15_best_variant_lookup", "strategy:s verdict:s ci_lo:f capacity:f", f"{RG}, {SQL_RANK}, {SQL_FAMS}, out AS (SELECT r.strategy, verdict, ci_lo, pow(10e0, 5 + r.line % 3) AS capacity FROM ranked r LEFT JOIN bv ON bv.best_variant = r.strategy)")
def j15(spark, d):
    c = curves(spark, d)
    rk = RK.rank(registry(spark, d, c))
    return rk.join(best_variants(c).select(F.col("best_variant").alias("strategy"), "ci_lo"), "strategy", "left").join(capacities(c), "strategy", "left")


@query("r7_review_suggestions", "kind:s subject:s value:f", f"""{RG}, {SQL_MONTHLY}, {SQL_CORR}, {SQL_TR}, okb AS (SELECT * FROM reg WHERE NOT failed AND scenario = 'base' AND uh = 'u2'),
sn AS (SELECT *, row_number() OVER (PARTITION BY family ORDER BY sharpe DESC, strategy) AS rank, stddev_samp(sharpe) OVER (PARTITION BY family ORDER BY sharpe DESC, strategy ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS ns, count(*) OVER (PARTITION BY family) AS n FROM tr WHERE family <> 'rotate'),
out AS (SELECT 'weak_evidence' AS kind, strategy AS subject, dev_psr AS value FROM okb WHERE dev_sharpe > 0.5 AND dev_psr < 0.9 UNION ALL SELECT 'degradation', strategy, dev_sharpe - holdout_sharpe FROM okb WHERE dev_sharpe <> 0 AND dev_sharpe - holdout_sharpe > 1
 UNION ALL SELECT 'duplicate', a || ' ~ ' || b, corr FROM pc WHERE corr > 0.2 AND split_part(a, '(', 1) <> split_part(b, '(', 1) UNION ALL SELECT 'missing_test', 'rotate', NULL
 UNION ALL SELECT 'parameter_instability', family, ns FROM sn WHERE rank = 1 AND n > 3 AND family <> 'benchmark' AND coalesce(ns, 0) > 0.5 * abs(sharpe))""")
def r7(spark, d):
    c = curves(spark, d)
    sens = V.parameter_sensitivity(V.trial_sharpes(c, VR), ["family"], "strategy").where("family <> 'rotate'")
    return RK.review(RK.current_cohort(registry(spark, d, c)), M.resample_compound(c, ID, "me"), sens, corr_threshold=0.2)


@query("r9_scorecard", "cls:s n:i statistical_confidence:f robustness:f interpretability:f capacity:f overall:f", f"""{RG}, okb AS (SELECT * FROM reg WHERE NOT failed AND scenario = 'base' AND uh = 'u2'),
g AS (SELECT cls, count(*) AS n, round(least(greatest(5 * avg(dev_psr), 0), 5), 1) AS statistical_confidence, round(least(greatest(4.5 - 2 * least(avg(greatest(dev_sharpe - holdout_sharpe, 0)), 2), 0), 5), 1) AS robustness, 4.2e0 AS interpretability,
 CASE WHEN bool_or(family = 'benchmark') THEN 3.5e0 ELSE 2.5e0 END AS capacity FROM okb GROUP BY 1), out AS (SELECT *, round((statistical_confidence + robustness + interpretability + capacity) / 4, 2) AS overall FROM g)""")
def r9(spark, d):
    return RK.scorecard(RK.current_cohort(registry(spark, d)).where("status = 'ok' and scenario = 'base'"))


@query("r10_best_per_class", "cls:s strategy:s dev_sharpe:f", f"""{RG}, b AS (SELECT *, row_number() OVER (PARTITION BY cls ORDER BY dev_sharpe DESC, strategy) AS rn FROM reg WHERE NOT failed AND scenario = 'base' AND uh = 'u2'),
out AS (SELECT * FROM b WHERE rn = 1 ORDER BY dev_sharpe DESC, strategy LIMIT 4)""")
def r10(spark, d):
    return RK.best_per_class(RK.current_cohort(registry(spark, d)), 4)


@query("r11_dedupe_registry", "strategy:s scenario:s n:i", f"{RG}, out AS (SELECT strategy, scenario, 1 AS n FROM reg GROUP BY strategy, scenario)")
def r11(spark, d):
    r = registry(spark, d).withColumn("id", F.concat_ws("|", "strategy", "scenario"))
    return RK.dedupe(r).groupBy("strategy", "scenario").agg(F.count("*").alias("n"))


@query("r12_experiment_records", "strategy:s scenario:s dev_sharpe:f holdout_cagr:f n_subperiods:i psr_dev:f annual_turnover:f n_trade_days:i", f"""{RG}, td AS (SELECT strategy, scenario, avg(turnover) * 252 AS annual_turnover, count_if(turnover > 0) AS n_trade_days FROM cs GROUP BY 1, 2),
out AS (SELECT r.strategy, r.scenario, dev_sharpe, holdout_cagr, n_sub AS n_subperiods, dev_psr AS psr_dev, annual_turnover, n_trade_days FROM rn r JOIN td USING (strategy, scenario))""")
def r12(spark, d):
    x = study.experiment_records(C.scenario_curves(curves(spark, d)), ["strategy", "scenario"], C.HOLDOUT_START, C.PERIODS, 40)
    return x.select("strategy", "scenario", F.col("metrics_dev.sharpe").alias("dev_sharpe"), F.col("metrics_holdout.cagr").alias("holdout_cagr"), F.size("subperiods").alias("n_subperiods"), "psr_dev", "annual_turnover", "n_trade_days")


@query("r13_experiment_id", "strategy:s scenario:s id:s", f"""{SQL_CURVES}, out AS (SELECT DISTINCT strategy, scenario, left(sha256('{{"strategy":"' || strategy || '","scenario":"' || scenario || '"}}'), 10) AS id FROM cv CROSS JOIN (VALUES ('base'), ('stressed')) s(scenario))""")
def r13(spark, d):
    return C.scenario_curves(curves(spark, d)).select("strategy", "scenario").distinct().withColumn("id", RK.stable_hash(F.struct("strategy", "scenario")))


@query("v8_failed_trials_in_battery", "family:s n_trials:i expected_max:f", f"{RG}, {SQL_TR}, tf AS (SELECT family, sharpe FROM tr UNION ALL SELECT family, 0 FROM reg WHERE failed), {SQL_BAT.format(src='tf')}, out AS (SELECT * FROM be)")
def v8(spark, d):
    c = curves(spark, d)
    reg = registry(spark, d, c)
    failed = RK.recovered_failures(reg, RK.current_cohort(reg))
    return V.battery(V.trial_sharpes(c, VR), ["family"], failed)


@query("v10_family_summary", "family:s n_variants:i best_variant:s best_dev_sharpe:f ci_lo:f ci_hi:f dsr:f wf_sharpe:f mdd_median:f mdd_p95:f", f"""{SQL_CURVES.replace('cv AS (', 'cva0 AS (')}, cv AS (SELECT * FROM cva0 WHERE date < DATE '1999-11-05' AND family <> 'benchmark'), {SQL_TR}, {SQL_WF}, {SQL_BAT.format(src='tr')}, {SQL_DSR}, {sql_boot(2000, 21)}, {sql_perm(2000)},
bst AS (SELECT family, n_variants, strategy, sharpe FROM (SELECT *, count(*) OVER (PARTITION BY family) AS n_variants, row_number() OVER (PARTITION BY family ORDER BY sharpe DESC, strategy) AS rn FROM tr) WHERE rn = 1),
ws AS (SELECT family, {SHARPE} AS wf_sharpe FROM wf GROUP BY 1),
out AS (SELECT b.family, n_variants, b.strategy AS best_variant, sharpe AS best_dev_sharpe, lo AS ci_lo, hi AS ci_hi, dsr, wf_sharpe, mdd_median, mdd_p95 FROM bst b JOIN bci ON bci.strategy = b.strategy JOIN ds ON ds.strategy = b.strategy JOIN ws ON ws.family = b.family JOIN mc ON mc.strategy = b.strategy)""")
def v10(spark, d):
    dev = curves(spark, d).where(F.col("date") < F.to_date(F.lit(C.HOLDOUT_START)))
    # The draws are keyed by strategy alone, so the twin can number the same replicates.
    return study.family_summary(dev, min_train_months=24, step_months=6, seed=7, draw=["strategy"])


QUERIES["v10_family_summary_plan"], ORACLES["v10_family_summary_plan"] = QUERIES["v10_family_summary"], ORACLES["v10_family_summary"]


# ------------------------------------------------------------------ rollups
@query("a26_platform_stats", "experiments_total:i ok:i failed:i first_experiment:d last_experiment:d superseded:i", f"""{RG}, c AS (SELECT * FROM reg WHERE uh = 'u2' AND NOT failed), out AS (SELECT count(*) AS experiments_total, count(*) AS ok, 0 AS failed, CAST(min(ts) AS DATE) AS first_experiment,
 CAST(max(ts) AS DATE) AS last_experiment, (SELECT count(*) FROM reg) - count(*) AS superseded FROM c)""")
def a26(spark, d):
    return RK.platform_stats(registry(spark, d))


@query("a26_experiments_by_day", "day:d n:i", f"{RG}, out AS (SELECT CAST(ts AS DATE) AS day, count(*) AS n FROM reg GROUP BY 1)")
def a26d(spark, d):
    return RK.experiments_by_day(registry(spark, d))


@query("a27_class_rollup", "cls:s n:i n_robust_candidate:i n_inconclusive:i n_rejected:i n_benchmark:i best_verdict:s median_dev_sharpe:f median_holdout_sharpe:f median_max_drawdown:f n_fragile:i", f"""{RG}, {SQL_RANK},
rr AS (SELECT *, row_number() OVER (PARTITION BY cls ORDER BY score DESC, strategy) AS rn FROM ranked),
out AS (SELECT cls, count(*) AS n, count_if(verdict = 'robust_candidate') AS n_robust_candidate, count_if(verdict = 'inconclusive') AS n_inconclusive, count_if(verdict = 'rejected') AS n_rejected, count_if(verdict = 'benchmark') AS n_benchmark,
 max(CASE WHEN rn = 1 THEN verdict END) AS best_verdict, median(dev_sharpe) AS median_dev_sharpe, median(holdout_sharpe) AS median_holdout_sharpe, median(max_drawdown) AS median_max_drawdown, count_if(cost_fragile) AS n_fragile FROM rr GROUP BY 1)""")
def a27(spark, d):
    return RK.class_rollup(RK.rank(registry(spark, d)))


@query("a28_family_independence", "family:s median_corr:f classes:i", f"""{SQL_CURVES}, {SQL_MONTHLY}, {SQL_TR}, b AS (SELECT *, row_number() OVER (PARTITION BY split_part(strategy, '(', 1) ORDER BY sharpe DESC, strategy) AS rn FROM tr WHERE family <> 'benchmark'),
c AS (SELECT b.family, split_part(b.strategy, '(', 1) AS cls, corr(x.ret, y.ret) AS c FROM b JOIN mo x ON x.strategy = b.strategy JOIN mo y ON y.strategy = 'BuyAndHold(ticker=SPY)' AND y.period = x.period WHERE rn = 1 GROUP BY 1, 2),
out AS (SELECT family, median(c) AS median_corr, count(*) AS classes FROM c GROUP BY 1)""")
def a28(spark, d):
    return family_independence(curves(spark, d), "BuyAndHold(ticker=SPY)")


@query("a29_cost_sensitivity", "strategy:s base_sharpe:f stressed_sharpe:f base_cagr:f stressed_cagr:f", f"""{SQL_CURVES}, cs AS (SELECT strategy, date, ret - c AS ret, scenario FROM cv CROSS JOIN (VALUES ('base', 0e0), ('stressed', 0.0008e0)) s(scenario, c)),
m AS (SELECT strategy, scenario, {SHARPE} AS s, {CAGR} AS c FROM cs GROUP BY 1, 2), out AS (SELECT b.strategy, b.s AS base_sharpe, x.s AS stressed_sharpe, b.c AS base_cagr, x.c AS stressed_cagr FROM m b JOIN m x USING (strategy) WHERE b.scenario = 'base' AND x.scenario = 'stressed')""")
def a29(spark, d):
    m = C.scenario_curves(curves(spark, d)).groupBy("strategy").pivot("scenario", ["base", "stressed"]).agg(S.sharpe("ret").alias("sharpe"), S.cagr("ret").alias("cagr"))
    return m


@query("a30_pivot_table", "cls:s l1:f l2:f l3:f l4:f l5:f l6:f l7:f", f"""{SQL_CURVES}, t AS (SELECT cls, line, strategy, {SHARPE} AS s FROM cv WHERE family <> 'benchmark' GROUP BY 1, 2, 3), out AS (SELECT cls, {', '.join(f'avg(CASE WHEN line = {k} THEN s END) AS l{k}' for k in range(1, 8))} FROM t GROUP BY 1)""")
def a30(spark, d):
    t = active(spark, d).groupBy("cls", "line", "strategy").agg(S.sharpe("ret").alias("s"))
    return t.groupBy("cls").pivot("line", list(range(1, 8))).agg(F.avg("s")).select("cls", *[F.col(str(k)).alias(f"l{k}") for k in range(1, 8)])


SQL_FOCUS = f"""{SQL_RANK}, tg AS (SELECT *, regexp_extract(strategy, 'basket=([^,)]+)', 1) AS bk, regexp_extract(strategy, 'ticker=([^,)]+)', 1) AS tk FROM ranked WHERE family <> 'benchmark'),
tk AS (SELECT *, CASE WHEN bk NOT IN ('', 'None') THEN 'cluster' WHEN tk <> '' THEN 'company' END AS kind, CASE WHEN bk NOT IN ('', 'None') THEN bk WHEN tk <> '' THEN tk END AS "key" FROM tg),
fo0 AS (SELECT kind, "key", count(*) AS n_trials, max(dev_sharpe) AS best_sharpe, median(dev_sharpe) AS median_sharpe, arg_max(strategy, dev_sharpe) AS best_strategy, min(max_drawdown) AS worst_drawdown, stddev_samp(dev_sharpe) AS sd, avg(dev_sharpe) AS m,
 var_pop(dev_sharpe / sqrt(252e0)) AS v FROM tk WHERE kind IS NOT NULL GROUP BY 1, 2 HAVING count(*) >= 2),
fo1 AS (SELECT *, {expected_max_sharpe_sql('n_trials', 'v')} * sqrt(252e0) AS expected_best, CASE WHEN n_trials > 1 AND m <> 0 THEN sd / abs(m) ELSE 0 END AS dispersion FROM fo0),
fo2 AS (SELECT *, best_sharpe - expected_best AS excess, n_trials >= 5 AND dispersion < 0.25 AS weak_correction FROM fo1),
fo AS (SELECT *, CASE WHEN n_trials < 3 THEN 'too few trials' WHEN excess <= 0 THEN 'luck' WHEN weak_correction THEN 'near-duplicate trials' WHEN excess < 0.15 THEN 'marginal' ELSE 'clears luck' END AS reading FROM fo2)"""


@query("a31_focus_targets", "kind:s key:s n_trials:i best_sharpe:f median_sharpe:f best_strategy:s worst_drawdown:f expected_best:f excess:f dispersion:f weak_correction:b reading:s", f"{RG}, {SQL_FOCUS}, out AS (SELECT * FROM fo)")
def a31(spark, d):
    return RK.focus(RK.rank(registry(spark, d)))


@query("a31_focus_summary", "n_targets:i n_clusters:i n_companies:i total_trials:i n_beating_luck:i n_indistinguishable:i n_weak_correction:i", f"""{RG}, {SQL_FOCUS}, out AS (SELECT count(*) AS n_targets, count_if(kind = 'cluster') AS n_clusters, count_if(kind = 'company') AS n_companies, sum(n_trials) AS total_trials,
 count_if(excess > 0 AND n_trials >= 3) AS n_beating_luck, count_if(NOT (excess > 0 AND n_trials >= 3)) AS n_indistinguishable, count_if(weak_correction) AS n_weak_correction FROM fo)""")
def a31s(spark, d):
    return RK.focus_summary(RK.focus(RK.rank(registry(spark, d))))


@query("p11_target_extraction", "strategy:s basket:s ticker:s", f"{SQL_CURVES}, out AS (SELECT DISTINCT strategy, nullif(nullif(regexp_extract(strategy, 'basket=([^,)]+)', 1), ''), 'None') AS basket, nullif(regexp_extract(strategy, 'ticker=([^,)]+)', 1), '') AS ticker FROM cv)")
def p11(spark, d):
    s = curves(spark, d).select("strategy").distinct()
    g = lambda k: F.nullif(F.nullif(F.regexp_extract("strategy", rf"{k}=([^,)]+)", 1), F.lit("")), F.lit("None"))
    return s.select("strategy", g("basket").alias("basket"), g("ticker").alias("ticker"))


@query("p12_compare_patterns", "strategy:s scenario:s dev_sharpe:f holdout_sharpe:f max_drawdown:f psr:f", f"{RG}, out AS (SELECT DISTINCT strategy, scenario, dev_sharpe, holdout_sharpe, dev_mdd AS max_drawdown, dev_psr AS psr FROM reg WHERE NOT failed AND (strategy LIKE '%Growth%' OR strategy LIKE '%basket=T1%'))")
def p12(spark, d):
    # Rounded first: the older cohort repeats the same values and is dropped as a duplicate.
    c = RK.compare(registry(spark, d), ["Growth", "basket=T1"])
    return c.select("strategy", "scenario", *[F.round(x, 9).alias(x) for x in ("dev_sharpe", "holdout_sharpe", "max_drawdown", "psr")]).distinct()


@query("j6_resume_anti_join", "strategy:s scenario:s", f"{SQL_CURVES}, out AS (SELECT DISTINCT strategy, s.scenario FROM cv CROSS JOIN (VALUES ('zero'), ('low'), ('base'), ('stressed')) s(scenario) WHERE NOT (s.scenario IN ('base', 'stressed') AND cls <> 'Rotate'))")
def j6(spark, d):
    src = curves(spark, d)
    plan = src.select("strategy", "cls").distinct().select("strategy", F.explode(F.array(*[F.lit(s) for s in ("zero", "low", "base", "stressed")])).alias("scenario")).withColumn("id", RK.stable_hash(F.struct("strategy", "scenario")))
    done = C.scenario_curves(src).where("cls <> 'Rotate'").select(RK.stable_hash(F.struct("strategy", "scenario")).alias("id"))
    return study.pending(plan, done)


@query("j7_outer_align", "line:i date:d growth:f value:f rotate:f n:i", f"""{SQL_CURVES}, x AS (SELECT line, date, family, ret FROM cv WHERE family <> 'benchmark'), out AS (SELECT line, date, max(CASE WHEN family = 'growth' THEN ret END) AS growth, max(CASE WHEN family = 'value' THEN ret END) AS value,
 max(CASE WHEN family = 'rotate' THEN ret END) AS rotate, count(*) AS n FROM x GROUP BY 1, 2)""")
def j7(spark, d):
    x = active(spark, d)
    at = lambda f: F.max(F.when(F.col("family") == f, F.col("ret"))).alias(f)
    return x.groupBy("line", "date").agg(at("growth"), at("value"), at("rotate"), F.count("*").alias("n"))


@query("j12_grid_scenarios", "strategy:s scenario:s fixed_bps:f n:i", f"""{SQL_CURVES}, g AS (SELECT DISTINCT strategy FROM cv), s AS (SELECT * FROM (VALUES ('zero', 0e0), ('low', 2e0), ('base', 5.5e0), ('stressed', 16e0)) v(scenario, fixed_bps)),
c AS (SELECT strategy, count(*) AS n FROM cv GROUP BY 1), out AS (SELECT c.strategy, scenario, fixed_bps, n FROM c CROSS JOIN s)""")
def j12(spark, d):
    from ..operators.returns import SCENARIOS, scenario_structs

    c = curves(spark, d).groupBy("strategy").agg(F.count("*").alias("n")).withColumn("s", F.explode(scenario_structs(SCENARIOS)))
    return c.select("strategy", F.col("s.name").alias("scenario"), (F.col("s.commission_bps") + F.col("s.half_spread_bps") + F.col("s.slippage_bps")).alias("fixed_bps"), "n")
