"""Normal distribution as column expressions, and the same expressions as SQL text.

Neither Spark nor DuckDB has ``erf``; both sides evaluate the published rational forms below.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

EULER_GAMMA = 0.5772156649015329
ANN = 252.0

# Hart's rational approximation of the normal tail, as printed by West (2005).
HART_NUM = [3.52624965998911e-02, 0.700383064443688, 6.37396220353165, 33.912866078383,
            112.079291497871, 221.213596169931, 220.206867912376]
HART_DEN = [8.83883476483184e-02, 1.75566716318264, 16.064177579207, 86.7807322029461,
            296.564248779674, 637.333633378831, 793.826512519948, 440.413735824752]
HART_SPLIT = 7.07106781186547
SQRT_2PI = 2.506628274631

# Acklam's rational approximation of the normal quantile.
ACKLAM_A = [-3.969683028665376e+01, 2.209460984245205e+02, -2.759285104469687e+02,
            1.383577518672690e+02, -3.066479806614716e+01, 2.506628277459239e+00]
ACKLAM_B = [-5.447609879822406e+01, 1.615858368580409e+02, -1.556989798598866e+02,
            6.680131188771972e+01, -1.328068155288572e+01]
ACKLAM_C = [-7.784894002430293e-03, -3.223964580411365e-01, -2.400758277161838e+00,
            -2.549732539343734e+00, 4.374664141464968e+00, 2.938163982698783e+00]
ACKLAM_D = [7.784695709041462e-03, 3.224671290700398e-01, 2.445134137142996e+00,
            3.754408661907416e+00]
ACKLAM_LOW = 0.02425


def _horner(x: str, coef: list[float]) -> str:
    text = repr(coef[0])
    for c in coef[1:]:
        text = f"(({text}) * {x} + ({c!r}))"
    return text


def _e(text: str) -> str:
    """Write every float literal with an exponent, so both engines read DOUBLE and not DECIMAL."""
    import re

    return re.sub(r"(?<![\w.])(\d+\.\d+)(?![\w.])", r"\1e0", text)


def norm_cdf_sql(x: str) -> str:
    """SQL text of the normal CDF of ``x`` (valid in Spark SQL and DuckDB)."""
    a = f"abs({x})"
    core = f"exp(-{a} * {a} / 2.0) * {_horner(a, HART_NUM)} / {_horner(a, HART_DEN)}"
    tail = f"exp(-{a} * {a} / 2.0) / ({a} + 1.0 / ({a} + 2.0 / ({a} + 3.0 / ({a} + 4.0 / ({a} + 0.65))))) / {SQRT_2PI!r}"
    upper = f"(CASE WHEN {a} > 37.0 THEN 0.0 WHEN {a} < {HART_SPLIT!r} THEN {core} ELSE {tail} END)"
    return _e(f"(CASE WHEN ({x}) > 0.0 THEN 1.0 - {upper} ELSE {upper} END)")


def norm_ppf_sql(p: str) -> str:
    """SQL text of the normal quantile of ``p``; NULL outside (0, 1)."""

    def tail(q: str) -> str:
        return f"({_horner(q, ACKLAM_C)}) / (({_horner(q, ACKLAM_D)}) * {q} + 1.0)"

    lo = tail(f"sqrt(-2.0 * ln({p}))")
    hi = tail(f"sqrt(-2.0 * ln(1.0 - ({p})))")
    q = f"(({p}) - 0.5)"
    r = f"({q} * {q})"
    mid = f"({_horner(r, ACKLAM_A)}) * {q} / (({_horner(r, ACKLAM_B)}) * {r} + 1.0)"
    return _e(
        f"(CASE WHEN ({p}) <= 0.0 OR ({p}) >= 1.0 THEN NULL "
        f"WHEN ({p}) < {ACKLAM_LOW!r} THEN {lo} WHEN ({p}) > {1 - ACKLAM_LOW!r} THEN -({hi}) ELSE {mid} END)"
    )


def norm_cdf(name: str) -> Column:
    """Normal CDF of the column called ``name``."""
    return F.expr(norm_cdf_sql(name))


def norm_ppf(name: str) -> Column:
    """Normal quantile of the column called ``name``."""
    return F.expr(norm_ppf_sql(name))


def expected_max_sharpe_sql(n: str, var: str) -> str:
    """Expected best Sharpe among ``n`` zero-skill trials whose Sharpes have variance ``var`` (per period)."""
    return (
        f"(CASE WHEN {n} <= 1 OR {var} <= 0e0 THEN 0e0 ELSE sqrt({var}) * ("
        f"{1 - EULER_GAMMA!r}e0 * {norm_ppf_sql(f'(1e0 - 1e0 / {n})')} + "
        f"{EULER_GAMMA!r}e0 * {norm_ppf_sql(f'(1e0 - 1e0 / ({n} * exp(1e0)))')}) END)"
    )


def probabilistic_sharpe_sql(n: str, mean: str, sd: str, skew: str, kurt: str, bench_ann: str = "0e0") -> str:
    """Probability that the true Sharpe exceeds ``bench_ann``; ``skew`` and ``kurt`` (non-excess) are population moments."""
    sr = f"({mean} / {sd})"
    denom = f"sqrt(greatest(1e0 - {skew} * {sr} + ({kurt} - 1e0) / 4e0 * {sr} * {sr}, 1e-12))"
    z = f"(({sr} - ({bench_ann}) / sqrt(252e0)) * sqrt({n} - 1e0) / {denom})"
    return f"(CASE WHEN {n} < 60 OR NOT ({sd} > 0e0) THEN NULL ELSE {norm_cdf_sql(z)} END)"


def with_probabilistic_sharpe(df: DataFrame, out: str, n: str, mean: str, sd: str, skew: str, kurt: str, bench_ann: str | float = 0.0) -> DataFrame:
    """Add the probabilistic Sharpe; the z value is its own column, so the long CDF expression refers to a name only."""
    sr = F.when(F.col(sd) > 0, F.col(mean) / F.col(sd))
    b = F.col(bench_ann) if isinstance(bench_ann, str) else F.lit(float(bench_ann))
    df = df.withColumn("_sr", sr)
    v = 1 - F.col(skew) * F.col("_sr") + (F.col(kurt) - 1) / 4 * F.col("_sr") * F.col("_sr")
    df = df.withColumn("_z", (F.col("_sr") - b / ANN**0.5) * F.sqrt(F.col(n) - 1.0) / F.sqrt(F.greatest(v, F.lit(1e-12))))
    return df.withColumn(out, F.when((F.col(n) >= 60) & F.col("_z").isNotNull(), norm_cdf("_z"))).drop("_sr", "_z")


def with_expected_max_sharpe(df: DataFrame, out: str, n: str, var: str) -> DataFrame:
    """Add the expected best annual Sharpe among ``n`` zero-skill trials with per-period variance ``var``."""
    df = df.withColumns({"_p1": 1 - F.lit(1.0) / F.greatest(F.col(n), F.lit(2)), "_p2": 1 - F.lit(1.0) / (F.greatest(F.col(n), F.lit(2)) * F.exp(F.lit(1.0)))})
    df = df.withColumns({"_q1": norm_ppf("_p1"), "_q2": norm_ppf("_p2")})
    x = F.sqrt(F.col(var)) * ((1 - EULER_GAMMA) * F.col("_q1") + EULER_GAMMA * F.col("_q2")) * ANN**0.5
    return df.withColumn(out, F.when((F.col(n) <= 1) | (F.col(var) <= 0), F.lit(0.0)).otherwise(x)).drop("_p1", "_p2", "_q1", "_q2")


def safe(x: Column | str, default: float | None = None) -> Column:
    """Finite value of ``x`` or ``default`` (NULL, NaN and infinities all count as missing)."""
    c = F.col(x) if isinstance(x, str) else x
    fin = F.when(~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))), c)
    return fin if default is None else F.coalesce(fin, F.lit(default))


def draw_key(*parts: Column | str) -> Column:
    """The draw of :func:`uniform_from_key` as 12 hexadecimal digits, which sort as the numbers do."""
    key = F.concat_ws("|", *[p.cast("string") if isinstance(p, Column) else F.col(p).cast("string") for p in parts])
    return F.substring(F.md5(key), 1, 12)


def uniform_from_key(*parts: Column | str) -> Column:
    """A reproducible uniform draw in [0, 1): the first 48 bits of the MD5 of the joined key parts.

    It depends only on the key, so it survives task retries and any repartitioning.
    """
    return F.conv(draw_key(*parts), 16, 10).cast("double") / F.lit(float(2**48))
