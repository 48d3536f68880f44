"""Registered queries against their SQL twins on the smallest tables."""

import duckdb
import pytest

import __spark_entry__ as entry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SAMPLE = ["p2_densify", "p6_investable_mask", "w13_percentile_rank", "w15_ewm", "j2_pit_asof", "c7_cap_weights", "g9_xs_momentum_inverse_vol", "g43_supertrend", "a16_summary", "b5_borrow_and_interest", "v2_block_bootstrap",
          "r4_hurdle_and_verdict", "q1_validate_bars", "s25_quarter_rows", "t1_stream_sessions", "t2_stream_bars", "x10_normal_cdf"]


@pytest.fixture(scope="module")
def con(sf):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return c


@pytest.mark.parametrize("key", SAMPLE)
def test_matches_sql(spark, sf, con, key):
    df = entry.queries()[key](spark, sf)
    cur = con.execute(entry.oracle_sql()[key])
    names = [c[0] for c in cur.description]
    assert sorted(names) == sorted(df.columns)
    want = sorted(map(repr, cur.fetchall()))
    got = sorted(repr(tuple(r[n] for n in names)) for r in df.collect())
    assert got == want


def test_entry_and_keys(spark):
    assert entry.entry(spark).count() == 4
    assert set(entry.oracle_sql()) <= set(entry.queries())
