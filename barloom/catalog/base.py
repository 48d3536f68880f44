"""Registration of queries with their SQL twins.

``spec`` lists the output columns as ``name:kind`` with kind s(tring), d(ate), f(loat, rounded to 6 places), p(rice level,
rounded to 4 places), i(nteger) or b(oolean). The same list shapes the Spark result and the SQL result, so both sides have the same names and types.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

# Averages of two-decimal prices often end in an exact decimal half, which engines round differently after their last-bit
# differences; shifting levels by a fixed amount far below a half keeps both sides on the same side of the tie.
LEVEL_SHIFT = 1.37e-6
_SPARK = {"s": "string", "d": "date", "f": "double", "p": "double", "i": "bigint", "b": "boolean"}
_SQL = {"s": "VARCHAR", "d": "DATE", "f": "DOUBLE", "p": "DOUBLE", "i": "BIGINT", "b": "BOOLEAN"}


def parse(spec: str) -> list[tuple[str, str]]:
    return [tuple(p.split(":")) for p in spec.split()]


def shape(df: DataFrame, spec: str, digits: int = 6) -> DataFrame:
    cols = []
    for name, kind in parse(spec):
        c = F.col(name).cast(_SPARK[kind])
        if kind == "f":
            c = F.round(c, digits) + F.lit(0.0)
        elif kind == "p":
            c = F.round(c + F.lit(LEVEL_SHIFT), 4)
        cols.append(c.alias(name))
    return df.select(*cols)


def shape_sql(ctes: str, spec: str, digits: int = 6, final: str = "out") -> str:
    cols = []
    for name, kind in parse(spec):
        c = f'CAST("{name}" AS {_SQL[kind]})'
        if kind == "f":
            c = f"round({c}, {digits}) + 0.0e0"
        elif kind == "p":
            c = f"round({c} + {LEVEL_SHIFT!r}, 4)"
        cols.append(f'{c} AS "{name}"')
    return f"WITH RECURSIVE {ctes} SELECT {', '.join(cols)} FROM {final}"


def query(key: str, spec: str, sql: str | None = None, digits: int = 6):
    """Register a query. ``sql`` is a list of common table expressions whose last one is called ``out``."""

    def wrap(fn: Callable[[SparkSession, str], DataFrame]):
        if key in QUERIES:
            raise ValueError(f"duplicate query {key}")
        QUERIES[key] = lambda spark, sf_dir: shape(fn(spark, sf_dir), spec, digits)
        if sql is not None:
            ORACLES[key] = shape_sql(sql.strip().rstrip(","), spec, digits)
        return fn

    return wrap


# Shared SQL text: the derived tables of ``sources.tables``, written independently with a calendar x series product.
WEEK = "(CAST(date_trunc('week', CAST({d} AS DATE) + 2) AS DATE) + 4)"
WK = WEEK.format(d="l_shipdate")
SQL_LINES = "lines AS (SELECT l.*, p_brand AS series_id FROM lineitem l JOIN part ON l_partkey = p_partkey)"


def sql_bars(freq: str = "w", src: str = "lines", series: str = "series_id") -> str:
    d = WK if freq == "w" else "CAST(l_shipdate AS DATE)"
    close = "avg(l_extendedprice)" if freq == "w" else "last(l_extendedprice ORDER BY l_shipdate, l_orderkey, l_linenumber, l_extendedprice)"
    return f"""bars AS (SELECT {series} AS series_id, {d} AS date,
 first(l_extendedprice ORDER BY l_shipdate, l_orderkey, l_linenumber, l_extendedprice) AS open,
 max(l_extendedprice) AS high, min(l_extendedprice) AS low, {close} AS close,
 avg(l_extendedprice * (1 - l_discount)) AS adj_close, sum(l_quantity) AS volume, sum(l_extendedprice) AS dollar_volume
 FROM {src} GROUP BY 1, 2)"""


def sql_period(freq: str, d: str = "date") -> str:
    if freq == "wf":
        return f"date_trunc('week', {d} + 2)"
    return f"date_trunc('{ {'me': 'month', 'qe': 'quarter', 'ye': 'year'}[freq] }', {d})"


SQL_CAL = f"""cal AS (SELECT date, row_number() OVER (ORDER BY date) - 1 AS pos,
 lag(date) OVER (ORDER BY date) AS prev_date,
 date = max(date) OVER (PARTITION BY {sql_period('me')}) AS me_stamp,
 date = max(date) OVER (PARTITION BY {sql_period('qe')}) AS qe_stamp,
 date = max(date) OVER (PARTITION BY {sql_period('wf')}) AS wf_stamp, TRUE AS day_stamp
 FROM (SELECT DISTINCT date FROM bars))"""
SQL_PANEL = """panel AS (SELECT s.series_id, c.date, c.pos, b.open, b.high, b.low, b.close, b.adj_close, b.volume, b.dollar_volume,
 c.me_stamp, c.qe_stamp, c.wf_stamp, c.day_stamp
 FROM (SELECT DISTINCT series_id FROM bars) s CROSS JOIN cal c LEFT JOIN bars b ON b.series_id = s.series_id AND b.date = c.date)"""


def sql_panel(freq: str = "w", series: str = "brand") -> str:
    if series == "supplier":
        return ", ".join([sql_bars(freq, "lineitem", "'S' || lpad(CAST(l_suppkey AS VARCHAR), 9, '0')"), SQL_CAL, SQL_PANEL])
    if series == "flag":
        return ", ".join([sql_bars(freq, "lineitem", "l_returnflag || l_linestatus"), SQL_CAL, SQL_PANEL])
    return ", ".join([SQL_LINES, sql_bars(freq), SQL_CAL, SQL_PANEL])


def W(n: int | None, end: int = 0, part: str = "series_id", order: str = "date") -> str:
    lo = "UNBOUNDED PRECEDING" if n is None else (f"{n - 1 + end} PRECEDING" if n - 1 + end else "CURRENT ROW")
    hi = f"{end} PRECEDING" if end else "CURRENT ROW"
    return f"OVER (PARTITION BY {part} ORDER BY {order} ROWS BETWEEN {lo} AND {hi})"


def roll(agg: str, x: str, n: int | None, minp: int | None = None, end: int = 0, part: str = "series_id", order: str = "date") -> str:
    need = minp if minp is not None else (n or 1)
    w = W(n, end, part, order)
    call = agg.replace("{x}", x) if "{x}" in agg else f"{agg}({x})"
    return f"CASE WHEN count({x}) {w} >= {need} THEN {call} {w} END"


def lagx(x: str, n: int = 1, part: str = "series_id", order: str = "date") -> str:
    return f"lag({x}, {n}) OVER (PARTITION BY {part} ORDER BY {order})"
