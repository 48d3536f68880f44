"""Pairwise-complete covariance and correlation between many series, as a blocked matrix product.

Series are hashed into blocks; one task handles one pair of blocks of one group, so its memory is two blocks of one window
whatever the number of series. Pairs come out only where the caller keeps them, and ``mean_corr`` never forms them as rows.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BLOCK = 256


def _matrix(pdf: pd.DataFrame, ids, times) -> np.ndarray:
    m = np.full((len(times), len(ids)), np.nan)
    m[pd.Index(times).get_indexer(pdf["_t"]), pd.Index(ids).get_indexer(pdf["_id"])] = pdf["_x"].to_numpy(float)
    return m


def _moments(a: np.ndarray, b: np.ndarray):
    """Counts, covariances and correlations of the columns of ``a`` and ``b`` over rows where both are present."""
    ma, mb = ~np.isnan(a), ~np.isnan(b)
    # Shift by the column means: pairwise means stay small and the sums of squares lose no digits.
    za = np.where(ma, a - np.nanmean(np.where(ma.any(0), a, 0.0), axis=0), 0.0)
    zb = np.where(mb, b - np.nanmean(np.where(mb.any(0), b, 0.0), axis=0), 0.0)
    fa, fb = ma.astype(float), mb.astype(float)
    n = fa.T @ fb
    sa, sb = za.T @ fb, fa.T @ zb
    with np.errstate(invalid="ignore", divide="ignore"):
        cov = (za.T @ zb - sa * sb / n) / (n - 1)
        va = ((za**2).T @ fb - sa**2 / n) / (n - 1)
        vb = (fa.T @ (zb**2) - sb**2 / n) / (n - 1)
        corr = cov / np.sqrt(va * vb)
    return n, cov, corr


def _replicate(df: DataFrame, group: list[str], id_col: str, t_col: str, x_col: str, block: int) -> DataFrame:
    sized = df.select(*group, F.col(id_col).alias("_id"), F.col(t_col).alias("_t"), F.col(x_col).cast("double").alias("_x"))
    n = sized.agg(F.greatest(F.ceil(F.count_distinct("_id") / block), F.lit(1)).cast("int").alias("_nb"))
    x = sized.join(F.broadcast(n)).withColumn("_b", F.pmod(F.xxhash64("_id"), F.col("_nb")).cast("int"))
    x = x.withColumn("_o", F.explode(F.sequence(F.lit(0), F.col("_nb") - 1)))
    return x.withColumns({"_bi": F.least("_b", "_o"), "_bj": F.greatest("_b", "_o")}).drop("_nb", "_o")


def pairwise(df: DataFrame, group: list[str], id_col: str, t_col: str, x_col: str, *, min_rows: int = 2,
             min_corr: float | None = None, block: int = BLOCK) -> DataFrame:
    """Rows ``(*group, a, b, n, cov, corr)`` with ``a < b`` (and ``a = b`` for the variances when no ``min_corr`` is set).

    With ``min_corr`` only pairs above it are emitted.
    """
    schema = ", ".join([f"`{g}` {df.schema[g].dataType.simpleString()}" for g in group] + ["a string, b string, n bigint, cov double, corr double"])

    def run(key, pdf):
        bi, bj = key[-2], key[-1]
        times = np.unique(pdf["_t"])
        left, right = pdf[pdf["_b"] == bi], pdf[pdf["_b"] == bj]
        ia, ib = np.unique(left["_id"]), np.unique(right["_id"])
        empty = {g: pd.Series(dtype=object) for g in group} | {c: pd.Series(dtype=object) for c in ("a", "b", "n", "cov", "corr")}
        if not len(ia) or not len(ib):
            return pd.DataFrame(empty)
        n, cov, corr = _moments(_matrix(left, ia, times), _matrix(right, ib, times))
        keep = n >= min_rows
        if bi == bj:
            keep &= ia[:, None] <= ib[None, :]
        if min_corr is not None:
            keep &= (ia[:, None] != ib[None, :]) & (corr > min_corr)
        i, j = np.nonzero(keep)
        a, b = ia[i], ib[j]
        lo, hi = np.where(a <= b, a, b), np.where(a <= b, b, a)
        out = {g: [k] * len(i) for g, k in zip(group, key)}
        return pd.DataFrame(out | {"a": lo, "b": hi, "n": n[i, j].astype("int64"), "cov": cov[i, j], "corr": corr[i, j]})

    return _replicate(df, group, id_col, t_col, x_col, block).groupBy(*group, "_bi", "_bj").applyInPandas(run, schema)


def mean_corr(df: DataFrame, group: list[str], id_col: str, t_col: str, x_col: str, *, block: int = BLOCK) -> DataFrame:
    """Average correlation of each series to all others: ``(*group, id, n_others, mean_corr)``.

    The divisor is the number of other series in the group, as in a sum over a correlation row.
    """
    schema = ", ".join([f"`{g}` {df.schema[g].dataType.simpleString()}" for g in group] + ["id string, s double, k bigint"])

    def run(key, pdf):
        bi, bj = key[-2], key[-1]
        times = np.unique(pdf["_t"])
        left, right = pdf[pdf["_b"] == bi], pdf[pdf["_b"] == bj]
        ia, ib = np.unique(left["_id"]), np.unique(right["_id"])
        rows = []
        if len(ia) and len(ib):
            _, _, corr = _moments(_matrix(left, ia, times), _matrix(right, ib, times))
            if bi == bj:
                np.fill_diagonal(corr, np.nan)
            rows.append(pd.DataFrame({"id": ia, "s": np.nansum(corr, axis=1), "k": np.full(len(ia), len(ib) - (bi == bj))}))
            if bi != bj:
                rows.append(pd.DataFrame({"id": ib, "s": np.nansum(corr, axis=0), "k": np.full(len(ib), len(ia))}))
        out = pd.concat(rows) if rows else pd.DataFrame({"id": pd.Series(dtype=object), "s": pd.Series(dtype=float), "k": pd.Series(dtype="int64")})
        for g, k in zip(group, key):
            out[g] = k
        return out[[*group, "id", "s", "k"]]

    part = _replicate(df, group, id_col, t_col, x_col, block).groupBy(*group, "_bi", "_bj").applyInPandas(run, schema)
    return part.groupBy(*group, "id").agg(F.sum("k").alias("n_others"), F.try_divide(F.sum("s"), F.sum("k")).alias("mean_corr"))
