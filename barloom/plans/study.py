"""Whole-study plans: parameter grids, experiment records and the per-family robustness table."""

from __future__ import annotations

from itertools import product

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import stats as S
from ..operators import metrics as M
from ..operators import resample as V
from ..operators.panel import union_all
from ..operators.ranking import stable_hash, strategy_name
from ..operators.returns import SCENARIOS, net_curves, scenario_structs
from .signals import SIGNALS, Market


def grid(spark: SparkSession, cls: str, params: dict[str, list]) -> DataFrame:
    """Every combination of the parameter lists with its canonical name and identifier, under every cost scenario."""
    x = spark.range(1).select(F.lit(cls).alias("cls"))
    for k, vals in sorted(params.items()):
        x = x.withColumn(k, F.explode(F.array(*[F.lit(str(v)) for v in vals])))
    m = F.create_map(*[c for k in sorted(params) for c in (F.lit(k), F.col(k))])
    x = x.select("cls", m.alias("params")).withColumn("scen", F.explode(scenario_structs(SCENARIOS)))
    x = x.select("cls", "params", F.col("scen.name").alias("scenario"), strategy_name(cls, F.col("params")).alias("strategy"))
    return x.withColumn("id", stable_hash(F.struct("strategy", "scenario")))


def pending(plan: DataFrame, registry: DataFrame) -> DataFrame:
    """Planned experiments that have no record yet."""
    return plan.join(registry.select("id").distinct(), "id", "left_anti")


def run_grid(market: Market, name: str, params: dict[str, list], freq: str = "me", scenarios=SCENARIOS, capital: float = 1e6) -> DataFrame:
    """Net curves of every variant of one signal: one weight table for the whole grid, priced once under all scenarios."""
    books = []
    for combo in product(*[params[k] for k in sorted(params)]):
        kw = dict(zip(sorted(params), combo))
        label = f"{name}({','.join(f'{k}={v}' for k, v in kw.items())})"
        books.append(SIGNALS[name](market, **kw, **({"freq": freq} if freq != "me" else {})).withColumn("strategy", F.lit(label)))
    return net_curves(union_all(books), market.panel, market.cal, freq, scenarios, [capital])


def family_summary(curves: DataFrame, failed: DataFrame | None = None, n_boot: int = 2000, block: int = 21, n_paths: int = 2000,
                   min_train_months: int = 60, step_months: int = 12, seed: int = 0, draw: list[str] | None = None) -> DataFrame:
    """Best variant per family with its bootstrap interval, deflated Sharpe, walk-forward Sharpe and drawdown distribution.

    ``curves`` holds development rows ``(family, strategy, date, ret)``.
    """
    c = curves.where("family <> 'benchmark'")
    t = V.trial_sharpes(c, ["family", "strategy"])
    best = t.groupBy("family").agg(F.count("*").alias("n_variants"), F.min_by("strategy", F.struct(-F.col("sharpe"), "strategy")).alias("strategy")).where("n_variants >= 2")
    top = c.join(best.select("family", "strategy"), ["family", "strategy"], "left_semi")
    ids = ["family", "strategy"]
    boot = V.block_bootstrap(top, ids, n_boot, block, seed, draw=draw)
    dsr = V.deflated_sharpe(c, ["family"], "strategy", failed).select("family", "strategy", "dsr")
    comp, _ = V.walk_forward(c, ["family"], "strategy", min_train_months, step_months)
    wf = comp.groupBy("family").agg(S.sharpe("ret").alias("wf_sharpe"))
    mc = V.permutation_drawdowns(top, ids, n_paths, seed, draw=draw)
    out = best.join(boot, ids).join(dsr, ids, "left").join(wf, "family", "left").join(mc, ids, "left")
    return out.select("family", "n_variants", F.col("strategy").alias("best_variant"), F.col("point").alias("best_dev_sharpe"), F.col("lo").alias("ci_lo"), F.col("hi").alias("ci_hi"),
                      "dsr", "wf_sharpe", "mdd_median", "mdd_p95")


def experiment_records(curves: DataFrame, ids: list[str], holdout_start: str, periods: list[tuple[str, str, str]], min_rows: int = 60) -> DataFrame:
    """Nested records per curve: development and holdout summaries, sub-periods, confidence and trading totals."""
    x = curves.withColumn("_s", F.when(F.col("date") < F.to_date(F.lit(holdout_start)), "dev").otherwise("holdout"))
    s = M.summary(x, [*ids, "_s"], turnover="turnover")
    body = F.struct(*[c for c in s.columns if c not in (*ids, "_s")])
    side = lambda n: F.max(F.when(F.col("_s") == n, F.col("_b"))).alias(f"metrics_{n}")
    r = s.select(*ids, "_s", body.alias("_b")).groupBy(*ids).agg(side("dev"), side("holdout"))
    p = M.period_metrics(curves, ids, periods, min_rows=min_rows).groupBy(*ids).agg(F.sort_array(F.collect_list(F.struct("period", "cagr", "sharpe", "max_dd"))).alias("subperiods"))
    psr = M.probabilistic_sharpe(x.where("_s = 'dev'"), ids).select(*ids, F.col("psr").alias("psr_dev"))
    tot = curves.groupBy(*ids).agg((F.avg("turnover") * 252).alias("annual_turnover"), F.count_if(F.col("turnover") > 0).alias("n_trade_days"))
    return r.join(p, ids, "left").join(psr, ids, "left").join(tot, ids).withColumn("id", stable_hash(F.struct(*ids)))
