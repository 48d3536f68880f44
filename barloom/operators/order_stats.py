"""Order statistics of growing prefixes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The tree of value ranges: children of a node, and levels; a key has at most FANOUT ** LEVELS values.
FANOUT, LEVELS = 32, 4


def expanding_quantile(df: DataFrame, x: str, q: float, out: str = "q", need: int = 1, key: tuple[str, ...] = (), order: str = "date") -> DataFrame:
    """Adds the ``q`` quantile (linear between neighbours) of all values of the key up to and including the row; NULL before ``need`` values.

    Values are ranked once. A tree of rank ranges is then walked level by level: within a node, running counts over the rows' order tell how many
    values of each child were seen by then, and so in which child the wanted one is. Each level is one window with sums that grow by one row at a time,
    so the cost is the number of rows times the logarithm. ``order`` is unique within a key.
    """
    keys = list(key)
    all_ = Window.partitionBy(*keys)
    seen_so_far = F.count(x).over(all_.orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    v = df.select(*keys, F.col(order).alias("_t"), F.col(x).cast("double").alias("_x"), seen_so_far.alias("_m"))
    number = (F.row_number().over(all_.orderBy("_x", "_t")) - 1).cast("long")
    number = F.when(number < FANOUT**LEVELS, number).otherwise(F.raise_error(F.lit("too many values in one key")).cast("long"))
    items = v.where(F.col("_x").isNotNull()).select(*keys, "_t", "_x", number.alias("_v"))
    at = F.lit(q) * (F.col("_m") - 1)
    asks = v.where(F.col("_m") >= max(need, 1)).select(*keys, "_t", at.alias("_at"), F.explode(F.array_distinct(F.array(F.floor(at), F.ceil(at)))).alias("_k"))
    asks = asks.withColumn("_node", F.lit(0).cast("long"))
    for level in range(LEVELS):
        asks = _descend(items, asks, keys, FANOUT ** (LEVELS - 1 - level))
    got = asks.join(items.select(*keys, F.col("_v").alias("_node"), "_x"), [*keys, "_node"]).groupBy(*keys, "_t").agg(F.min("_x").alias("_lo"), F.max("_x").alias("_hi"), F.max("_at").alias("_at"))
    got = got.select(*keys, F.col("_t").alias(order), (F.col("_lo") + (F.col("_hi") - F.col("_lo")) * (F.col("_at") - F.floor("_at"))).alias(out))
    return df.join(got, [*keys, order], "left")


def _descend(items: DataFrame, asks: DataFrame, keys: list[str], width: int) -> DataFrame:
    """One level: each question moves to the child that holds the value it asks for; ``width`` is the number of ranks of a child."""
    part = lambda c, n: F.expr(f"{c} div {n}")
    none: Column = F.lit(None)
    rows = items.select(*keys, "_t", part("_v", width * FANOUT).alias("_node"), F.lit(0).alias("_ask"), (part("_v", width) % FANOUT).cast("int").alias("_d"), none.cast("long").alias("_k"), none.cast("double").alias("_at"))
    rows = rows.unionByName(asks.withColumns({"_ask": F.lit(1), "_d": none.cast("int")}))
    sofar = Window.partitionBy(*keys, "_node").orderBy("_t", "_ask").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("_upto", F.array(*[F.count_if(F.col("_d") <= d).over(sofar) for d in range(FANOUT)])).where("_ask = 1")
    child = F.size(F.filter("_upto", lambda c: c <= F.col("_k")))
    rows = rows.withColumn("_d", child).withColumn("_k", F.col("_k") - F.when(F.col("_d") > 0, F.get("_upto", F.col("_d") - 1)).otherwise(0))
    return rows.select(*keys, "_t", "_at", "_k", (F.col("_node") * FANOUT + F.col("_d")).alias("_node"))
