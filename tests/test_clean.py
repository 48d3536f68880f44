"""The warnings of a store with issues and of one without any."""

import duckdb
import pytest

from barloom.catalog import load
from barloom.operators import quality as Q


@pytest.mark.parametrize("prices", [(10.0, 11.0, 12.0), (10.0, 30.0, 12.0)])
def test_assert_clean_equals_sql(spark, tmp_path, prices):
    con = duckdb.connect()
    con.execute(f"COPY (SELECT 1::BIGINT AS p_partkey, '' AS p_name, 'Brand#1' AS p_brand, '' AS p_type, 1::INTEGER AS p_size, 1e0 AS p_retailprice) TO '{tmp_path}/part.parquet'")
    rows = ", ".join(f"({k}, {p}, TIMESTAMP '1998-01-0{1 + k} 00:00:00' + INTERVAL {7 * k} DAY)" for k, p in enumerate(prices))
    con.execute(f"""COPY (SELECT k::BIGINT AS l_orderkey, 1::BIGINT AS l_partkey, 1::BIGINT AS l_suppkey, 1::INTEGER AS l_linenumber, 1e0 AS l_quantity, p::DOUBLE AS l_extendedprice,
        0e0 AS l_discount, 0e0 AS l_tax, 'N' AS l_returnflag, 'O' AS l_linestatus, d AS l_shipdate FROM (VALUES {rows}) v(k, p, d)) TO '{tmp_path}/lineitem.parquet'""")
    for t in ("part", "lineitem"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet'")
    queries, oracles = load()
    assert [tuple(r) for r in queries["q2_assert_clean"](spark, str(tmp_path)).select("warnings", "clean").collect()] == con.execute(f"SELECT warnings, clean FROM ({oracles['q2_assert_clean']})").fetchall()


def test_no_issues_are_no_warnings(spark):
    r = Q.assert_clean(spark.createDataFrame([], "series_id string, kind string, n bigint, severity string")).first()
    assert r["issues"] == 0 and r["warnings"] == 0 and r["clean"]
