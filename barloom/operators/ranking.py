"""Registry records to scores, verdicts, tiers, review suggestions and rollups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.mathx import safe, with_expected_max_sharpe

# The diversified index funds that may set the benchmark hurdle.
DIVERSIFIED = ["SPY", "QQQ", "XLK", "SOXX", "SMH", "IGV", "VGT", "IWM", "ARKK", "SKYY", "CIBR", "BOTZ"]
LATE_PERIOD = "ai_rally"
UNIVERSE_FAMILIES = ["xsmom", "meanrev", "breakout", "ml"]
MACRO_FAMILIES = ["regime"]
FILING_FAMILIES = ["fundamental"]
OTHER_FAMILIES = ["benchmark", "tsmom", "riskmanaged", "target_holdings"]
LOW_CAPACITY_RISK = ["riskmanaged", "benchmark", "tsmom", "regime"]


def strategy_name(cls: str, params: Column) -> Column:
    """Canonical name of a class with a parameter map: ``Class(a=1,b=2)`` with the keys in order."""
    parts = F.transform(F.array_sort(F.map_entries(params)), lambda e: F.concat(e["key"], F.lit("="), F.coalesce(e["value"], F.lit("None"))))
    return F.concat(F.lit(cls), F.lit("("), F.array_join(parts, ","), F.lit(")"))


def class_of(strategy: str = "strategy") -> Column:
    return F.split_part(F.col(strategy), F.lit("("), F.lit(1))


def stable_hash(value: Column, length: int = 10) -> Column:
    return F.substring(F.sha2(F.to_json(value), 256), 1, length)


def current_cohort(registry: DataFrame) -> DataFrame:
    """Rows of the newest (universe, freeze); the newest timestamp with a known universe decides."""
    newest = registry.where("universe_hash is not null").agg(F.max_by(F.struct("universe_hash", "freeze_version"), "timestamp").alias("_c"))
    x = registry.join(F.broadcast(newest))
    same = (F.col("universe_hash") == F.col("_c.universe_hash")) & (F.col("_c.freeze_version").isNull() | (F.col("freeze_version") == F.col("_c.freeze_version")))
    return x.where(F.col("_c").isNull() | same).select(*registry.columns)


def dedupe(registry: DataFrame, key: str = "id") -> DataFrame:
    """First write per id."""
    w = Window.partitionBy(key).orderBy("timestamp")
    return registry.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def _mean(arr: Column) -> Column:
    return F.aggregate(arr, F.lit(0.0), lambda a, v: a + v) / F.size(arr)


def _std(arr: Column) -> Column:
    m = _mean(arr)
    return F.sqrt(F.aggregate(arr, F.lit(0.0), lambda a, v: a + (v - m) * (v - m)) / F.nullif(F.size(arr) - 1, F.lit(0)))


def score(records: DataFrame, carry: list[str] = ()) -> DataFrame:
    """Composite score of each record.

    Rewards holdout and development Sharpe, Calmar, stability over sub-periods and confidence; charges degradation, turnover,
    concentration, parameter count, regime spread, drawdown and failure before the late period.
    """
    # A sub-period without a Sharpe ratio counts as one that is neither above nor below zero; only the spread leaves it out.
    known = lambda p: F.when(~F.isnan(p["sharpe"]), p["sharpe"])
    s = F.transform(F.coalesce("subperiods", F.array()), known)
    early = F.transform(F.filter(F.coalesce("subperiods", F.array()), lambda p: p["period"] != LATE_PERIOD), known)
    held = F.filter(s, lambda v: v.isNotNull())
    share = lambda arr, f: F.size(F.filter(arr, f)) / F.size(arr)
    enough = F.size(F.coalesce("subperiods", F.array())) >= 3
    r = records.withColumns({
        "_ds": safe("metrics_dev.sharpe", 0.0), "_hs": safe("metrics_holdout.sharpe", 0.0), "_cal": safe("metrics_dev.calmar", 0.0),
        "_dd": safe("metrics_dev.max_drawdown", -1.0), "_psr": safe("psr_dev", 0.5), "_to": safe("annual_turnover", 0.0),
        "_top": safe("concentration.top_name_share", 1.0), "_np": F.coalesce(F.greatest(F.size("spec.params"), F.lit(0)), F.lit(0)),
        "_stab": F.when(enough & (F.size(s) > 0), share(s, lambda v: v > 0)).otherwise(0.5),
        "_spread": F.when(enough & (F.size(held) > 1), _std(held)).otherwise(1.0),
        "_fails": F.when(enough & (F.size(early) >= 2), share(early, lambda v: v <= 0) > 0.6).otherwise(False)})
    r = r.withColumn("_deg", F.greatest(F.col("_ds") - F.col("_hs"), F.lit(0.0)))
    d = lambda v: F.lit(float(v))
    total = (2.0 * F.col("_hs") + F.col("_ds") + 0.5 * F.least("_cal", d(3)) + F.col("_stab") + (F.col("_psr") - 0.5) - F.col("_deg")
             - 0.3 * F.least(F.col("_to") / 5.0, d(2)) - F.greatest(F.col("_top") - 0.5, d(0)) - 0.1 * F.greatest(F.col("_np") - 3, F.lit(0))
             - 0.3 * F.least(F.col("_spread") / 2.0, d(1)) + 0.5 * F.col("_dd") - F.when(F.col("_fails"), 1.0).otherwise(0.0))
    rd = lambda c, n: F.round(c, n)
    return r.select("strategy", "family", rd(total, 3).alias("score"), rd("_ds", 2).alias("dev_sharpe"), rd("_hs", 2).alias("holdout_sharpe"),
                    rd(safe("metrics_dev.cagr", 0.0), 4).alias("dev_cagr"), rd(safe("metrics_holdout.cagr", 0.0), 4).alias("holdout_cagr"), rd("_dd", 3).alias("max_drawdown"),
                    rd("_cal", 2).alias("calmar"), rd("_psr", 3).alias("psr"), rd("_to", 2).alias("annual_turnover"), rd("_top", 2).alias("top_name_share"),
                    rd("_stab", 2).alias("stability"), rd("_deg", 2).alias("degradation"), F.col("_fails").alias("fails_early"), *carry)


def rank(registry: DataFrame, scenario: str = "base") -> DataFrame:
    """Scored, penalised and judged records of the newest cohort under one scenario.

    Mixed data modes are refused at run time. A strategy that keeps under a quarter of its Sharpe under stressed costs loses a
    point; verdicts compare with the best diversified benchmark.
    """
    one_mode = registry.agg(F.expr("assert_true(count(distinct data_mode) <= 1, 'records of several data modes cannot be ranked together')").alias("_ok"))
    one_mode = one_mode.select(F.coalesce(F.col("_ok").cast("string"), F.lit("")).alias("_ok")).where("_ok = ''")
    ok = current_cohort(registry.where("status = 'ok'"))
    worst = F.max_by(F.when(F.col("scenario") == "stressed", safe("metrics_dev.sharpe", 0.0)), F.when(F.col("scenario") == "stressed", F.col("timestamp")))
    ok = ok.withColumn("stressed_sharpe", worst.over(Window.partitionBy("strategy")))
    s = score(ok.where(F.col("scenario") == scenario), ["stressed_sharpe"]).join(F.broadcast(one_mode)).drop("_ok")
    s = s.withColumn("cost_fragile", F.coalesce((F.col("dev_sharpe") > 0.5) & (F.col("stressed_sharpe") < 0.25 * F.col("dev_sharpe")), F.lit(False)))
    s = s.withColumn("score", F.round(F.col("score") - F.when(F.col("cost_fragile"), 1.0).otherwise(0.0), 3))
    return verdicts(s)


def verdicts(scored: DataFrame, margin: float = 0.25, near: float = 1.0) -> DataFrame:
    funds = [f"BuyAndHold(ticker={t})" for t in DIVERSIFIED]
    fair = (F.col("family") == "benchmark") & (~F.col("strategy").startswith("BuyAndHold(") | F.col("strategy").isin(funds))
    hurdle = scored.agg(F.coalesce(F.max(F.when(fair, F.col("score"))), F.lit(0.0)).alias("hurdle"))
    x = scored.join(F.broadcast(hurdle))
    alive = F.col("holdout_sharpe") > 0
    v = F.when(F.col("family") == "benchmark", "benchmark") \
        .when((F.col("score") > F.col("hurdle") + margin) & alive & ~F.col("cost_fragile"), "robust_candidate") \
        .when((F.col("score") > F.col("hurdle") - near) & alive, "inconclusive").otherwise("rejected")
    return x.withColumn("verdict", v)


def assign_tier(records: DataFrame, flags: dict[str, bool]) -> DataFrame:
    """Evidence tier A, B or C with its reason; unknown metadata never promotes."""
    fam = F.coalesce("family", F.lit(""))
    flag = lambda k: F.lit(bool(flags.get(k, False)))
    cases = [
        (F.col("status").isNull() | F.col("status").isin("failed", "deprecated"), "C", "not run"),
        (~fam.isin(UNIVERSE_FAMILIES + MACRO_FAMILIES + FILING_FAMILIES + OTHER_FAMILIES), "B", "unrecognised family"),
        (fam.isin(MACRO_FAMILIES) & flag("no_vix"), "C", "macro series absent"),
        (fam.isin(MACRO_FAMILIES), "B", "macro inputs are revised"),
        (fam.isin(FILING_FAMILIES) & flag("fundamentals_partial"), "B", "filings cover part of the universe"),
        (fam.isin(FILING_FAMILIES), "B", "filings not independently audited"),
        (fam.isin(UNIVERSE_FAMILIES) & flag("delisted_incomplete"), "B", "universe lacks delisted names"),
        (flag("split_only_prices"), "B", "prices lack dividends"),
    ]
    tier = reason = None
    for cond, t, why in cases:
        tier = F.when(cond, t) if tier is None else tier.when(cond, t)
        reason = F.when(cond, why) if reason is None else reason.when(cond, why)
    return records.withColumns({"tier": tier.otherwise("A"), "tier_reason": reason.otherwise("complete adjusted histories")})


def decision_checks(ranking: DataFrame, families: DataFrame, capacity: DataFrame) -> DataFrame:
    """Advancement checks per active strategy; anything unknown fails."""
    x = ranking.where("family <> 'benchmark'")
    x = x.join(families.select(F.col("best_variant").alias("strategy"), F.col("ci_lo")).groupBy("strategy").agg(F.min("ci_lo").alias("ci_lo")), "strategy", "left")
    x = x.join(capacity.groupBy("strategy").agg(F.min("capacity").alias("capacity")), "strategy", "left")
    no = lambda c: F.coalesce(c, F.lit(False))
    checks = {"tier_a": no(F.col("tier") == "A"), "robust_verdict": no(F.col("verdict") == "robust_candidate"), "not_concentrated": no(safe("top_name_share") < 0.5),
              "not_late_only": ~no(F.col("fails_early")), "ci_positive": no(safe("ci_lo") > 0), "capacity_ok": no(safe(F.col("capacity").cast("double")) >= 1e6)}
    x = x.withColumns(checks)
    allp = F.lit(True)
    for c in checks:
        allp = allp & F.col(c)
    return x.withColumn("passed", allp).select("strategy", "family", "score", *checks, "passed")


def review(records: DataFrame, monthly: DataFrame, sensitivity: DataFrame, corr_threshold: float = 0.95, min_months: int = 25) -> DataFrame:
    """Suggestions ``(kind, subject, value)``: weak evidence, degradation, duplicates, missing tests and unstable peaks.

    ``monthly`` holds monthly returns ``(strategy, period, ret)``; only pairs above the threshold are ever formed as rows.
    """
    from .gram import pairwise

    ok = records.where("status = 'ok' and scenario = 'base'")
    ds, hs = safe("metrics_dev.sharpe"), safe("metrics_holdout.sharpe")
    weak = ok.where((ds > 0.5) & (F.col("psr_dev") < 0.90)).select(F.lit("weak_evidence").alias("kind"), F.col("strategy").alias("subject"), F.col("psr_dev").alias("value"))
    degr = ok.where((ds != 0) & (ds - hs > 1.0)).select(F.lit("degradation").alias("kind"), F.col("strategy").alias("subject"), (ds - hs).alias("value"))
    p = pairwise(monthly.withColumn("_all", F.lit(1)), ["_all"], "strategy", "period", "ret", min_rows=min_months, min_corr=corr_threshold)
    dup = p.where(class_of("a") != class_of("b")).select(F.lit("duplicate").alias("kind"), F.concat_ws(" ~ ", "a", "b").alias("subject"), F.col("corr").alias("value"))
    fams = ok.where("family <> 'benchmark'").select("family").distinct()
    miss = fams.join(sensitivity.select("family").distinct(), "family", "left_anti").select(F.lit("missing_test").alias("kind"), F.col("family").alias("subject"), F.lit(None).cast("double").alias("value"))
    n = sensitivity.groupBy("family").agg(F.count("*").alias("n"), F.max_by(F.struct("sharpe", "neighbor_stability"), -F.col("rank")).alias("t"))
    uns = n.join(fams, "family", "left_semi").where((F.col("n") > 3) & (F.coalesce("t.neighbor_stability", F.lit(0.0)) > 0.5 * F.abs(F.coalesce("t.sharpe", F.lit(1.0))))) \
        .select(F.lit("parameter_instability").alias("kind"), F.col("family").alias("subject"), F.col("t.neighbor_stability").alias("value"))
    return weak.unionByName(degr).unionByName(dup).unionByName(miss).unionByName(uns)


def scorecard(records: DataFrame) -> DataFrame:
    """Quality dimensions from 0 to 5 per class that recorded metrics can support, and their mean."""
    cut = lambda c: F.round(F.greatest(F.lit(0.0), F.least(F.lit(5.0), c)), 1)
    g = records.withColumn("cls", class_of()).groupBy("cls").agg(
        F.avg("psr_dev").alias("_p"), F.avg(F.greatest(safe("metrics_dev.sharpe", 0.0) - safe("metrics_holdout.sharpe", 0.0), F.lit(0.0))).alias("_m"),
        F.max(F.size("spec.params")).alias("_np"), F.max(F.col("family").isin(LOW_CAPACITY_RISK)).alias("_big"), F.count("*").alias("n"))
    g = g.withColumns({"statistical_confidence": cut(F.coalesce(5 * F.col("_p"), F.lit(0.5))), "robustness": cut(4.5 - 2 * F.least("_m", F.lit(2.0))),
                       "interpretability": cut(5.0 - 0.4 * F.greatest(F.col("_np") - 2, F.lit(0))), "capacity": F.when(F.col("_big"), 3.5).otherwise(2.5)})
    dims = ["statistical_confidence", "robustness", "interpretability", "capacity"]
    return g.withColumn("overall", F.round(sum((F.col(c) for c in dims[1:]), F.col(dims[0])) / len(dims), 2)).select("cls", "n", *dims, "overall")


def best_per_class(records: DataFrame, limit: int = 40) -> DataFrame:
    """The highest development Sharpe of each class, the best ``limit`` classes."""
    x = records.where("status = 'ok' and scenario = 'base'").withColumns({"cls": class_of(), "dev_sharpe": safe("metrics_dev.sharpe")})
    w = Window.partitionBy("cls").orderBy(F.col("dev_sharpe").desc_nulls_last(), "strategy")
    x = x.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")
    return x.orderBy(F.col("dev_sharpe").desc_nulls_last(), "strategy").limit(limit)


def focus(ranking: DataFrame, min_trials: int = 2) -> DataFrame:
    """Results grouped by the basket or ticker a variant aims at, against the best of as many worthless trials.

    Of equal best Sharpes the one with the higher score is named, as it comes first in the ranking; equal scores go by name.
    """
    b = F.regexp_extract("strategy", r"basket=([^,)]+)", 1)
    t = F.regexp_extract("strategy", r"ticker=([^,)]+)", 1)
    aimed = ~b.isin("", "None", "null")
    x = ranking.withColumns({"kind": F.when(aimed, "cluster").when(t != "", "company"), "key": F.when(aimed, b).when(t != "", t)})
    x = x.where("kind is not null and family is distinct from 'benchmark'")
    best = F.when(F.col("dev_sharpe").isNotNull(), F.struct(-F.col("dev_sharpe"), -F.col("score"), "strategy"))
    per = F.col("dev_sharpe") / F.sqrt(F.lit(252.0))
    g = x.groupBy("kind", "key").agg(F.count("*").alias("_rows"), F.count("dev_sharpe").alias("n_trials"), F.max("dev_sharpe").alias("best_sharpe"), F.percentile("dev_sharpe", F.lit(0.5)).alias("median_sharpe"),
                                     F.min_by("strategy", best).alias("best_strategy"), F.min_by("verdict", best).alias("best_verdict"),
                                     F.min("max_drawdown").alias("worst_drawdown"), F.stddev_samp("dev_sharpe").alias("_sd"), F.avg("dev_sharpe").alias("_m"), F.avg(F.abs("dev_sharpe")).alias("_size"), F.var_pop(per).alias("_v"))
    g = g.where((F.col("_rows") >= min_trials) & (F.col("n_trials") > 0))
    g = with_expected_max_sharpe(g, "expected_best", "n_trials", "_v")
    # Sharpes that cancel leave the last bits of their sum, which hang on the order of rows; such a mean is zero.
    g = g.withColumns({"excess": F.col("best_sharpe") - F.col("expected_best"),
                       "dispersion": F.when((F.col("n_trials") > 1) & (F.abs("_m") > 1e-12 * F.col("_size")), F.col("_sd") / F.abs("_m")).otherwise(0.0)})
    weak = (F.col("n_trials") >= 5) & (F.col("dispersion") < 0.25)
    reading = F.when(F.col("n_trials") < 3, "too few trials").when(F.col("excess") <= 0, "luck").when(weak, "near-duplicate trials").when(F.col("excess") < 0.15, "marginal").otherwise("clears luck")
    return g.withColumns({"weak_correction": weak, "reading": reading}).drop("_rows", "_sd", "_m", "_size", "_v")


def focus_summary(targets: DataFrame) -> DataFrame:
    beat = (F.col("excess") > 0) & (F.col("n_trials") >= 3)
    return targets.agg(F.count("*").alias("n_targets"), F.count_if(F.col("kind") == "cluster").alias("n_clusters"), F.count_if(F.col("kind") == "company").alias("n_companies"),
                       F.coalesce(F.sum("n_trials"), F.lit(0)).alias("total_trials"), F.count_if(beat).alias("n_beating_luck"), F.count_if(~beat).alias("n_indistinguishable"), F.count_if("weak_correction").alias("n_weak_correction"))


def recovered_failures(registry: DataFrame, cohort: DataFrame) -> DataFrame:
    """Failed runs inside the cohort's time span, with the family read back from their specification."""
    lo = cohort.agg(F.min("timestamp").alias("_lo"))
    return registry.where("status = 'failed'").join(F.broadcast(lo)).where(F.col("_lo").isNull() | (F.col("timestamp") >= F.col("_lo"))) \
        .withColumn("family", F.col("spec.family")).drop("_lo")


def compare(registry: DataFrame, patterns: list[str]) -> DataFrame:
    """Chosen metrics of the strategies whose name contains any pattern, one row each."""
    hit = F.lit(False)
    for p in patterns:
        hit = hit | F.col("strategy").contains(p)
    return registry.where(hit & (F.col("status") == "ok")).select("strategy", "scenario", F.col("metrics_dev.sharpe").alias("dev_sharpe"), F.col("metrics_holdout.sharpe").alias("holdout_sharpe"),
                                                                 F.col("metrics_dev.max_drawdown").alias("max_drawdown"), F.col("psr_dev").alias("psr")).dropDuplicates()


def class_rollup(ranking: DataFrame) -> DataFrame:
    """Verdict counts, best verdict and medians per class."""
    x = ranking.withColumn("cls", class_of())
    med = lambda c: F.percentile(c, F.lit(0.5)).alias(f"median_{c}")
    return x.groupBy("cls").agg(F.count("*").alias("n"), *[F.count_if(F.col("verdict") == v).alias(f"n_{v}") for v in ("robust_candidate", "inconclusive", "rejected", "benchmark")],
                                F.min_by("verdict", F.struct(-F.col("score"), "strategy")).alias("best_verdict"), med("dev_sharpe"), med("holdout_sharpe"), med("max_drawdown"), F.count_if("cost_fragile").alias("n_fragile"))


def platform_stats(registry: DataFrame) -> DataFrame:
    """Counts of the newest cohort by status and of what it supersedes."""
    cohort = current_cohort(registry)
    a = cohort.agg(F.count("*").alias("experiments_total"), F.count_if(F.col("status") == "ok").alias("ok"), F.count_if(F.col("status") == "failed").alias("failed"),
                   F.min(F.to_date("timestamp")).alias("first_experiment"), F.max(F.to_date("timestamp")).alias("last_experiment"))
    n = registry.agg(F.count("*").alias("_all"))
    return a.join(F.broadcast(n)).withColumn("superseded", F.greatest(F.col("_all") - F.col("experiments_total"), F.lit(0))).drop("_all")


def experiments_by_day(registry: DataFrame) -> DataFrame:
    return registry.groupBy(F.to_date("timestamp").alias("day")).agg(F.count("*").alias("n"))
