"""Mixing sources to target weights by Sainte-Laguë apportionment of equal-token blocks.

Targets share all words by weight, no source above ``passes`` times its size. The words are dealt out in blocks: highest quotients
votes / (2 seats + 1) give every source an integer number of blocks, and again every shard of the source. Within a shard the
documents lie in seeded order on a ring of words, cut into blocks; the quota takes whole rounds and then the blocks from a seeded one on. What a shard's
limit cuts off is shared by the shards of its source that have room.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.session import materialize

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5, 2, 1)
BLOCK, SHARD_WORDS, PASSES, SEED = 16, 1_000_000, 3, "mix-1"


def draw(*parts: Column | str) -> Column:
    """32 hexadecimal digits that depend on the seed and the parts only, so that reruns and retries agree."""
    return F.md5(F.concat_ws("|", *[F.lit(p) if isinstance(p, str) else F.coalesce(p.cast("string"), F.lit("")) for p in parts]).cast("binary"))


def number(digest: Column) -> Column:
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, passes: int = PASSES) -> DataFrame:
    """(source, k, source_size, target) for ``sizes`` (source, size): source number k in the order of code points, null last.

    A source is capped where the level (words for a unit of weight) passes its own limit; in the order of limits, the level that holds is
    the highest among those with the sources before capped. One row for each source goes through the window.
    """
    s = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    s = s.withColumn("k", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())))
    s = s.withColumn("w", F.get(F.array(*map(F.lit, weights)), (F.col("k") - 1) % len(weights)))
    every = Window.partitionBy()
    by_limit = Window.orderBy(passes * F.col("source_size") / F.col("w"), "k")
    capped = F.coalesce(F.sum(passes * F.col("source_size")).over(by_limit.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    level = (F.sum("source_size").over(every) - capped) / F.sum("w").over(by_limit.rowsBetween(0, Window.unboundedFollowing))
    s = s.withColumn("level", level).withColumn("level", F.max("level").over(every))
    return s.select("source", "k", "source_size", F.least((passes * F.col("source_size")).cast("double"), F.col("level") * F.col("w")).alias("target"))


def apportion(rows: DataFrame, group: list[str], name: str, votes: str, seats: str) -> DataFrame:
    """Adds ``quota``: the seats of each row of its group by highest quotients, ties to the smaller ``name``.

    For a divisor d, a row has v / d seats, give or take a half; so of n rows in a group, the sum of votes over d is the seats give or take n / 2.
    Each row starts with what this leaves it at least, and competes with its quotients up to what it allows at most: some three a row in all.
    """
    w = Window.partitionBy(*group)
    share = lambda by: F.coalesce(F.try_divide(F.col(votes) * (F.col(seats) + by * F.count(F.lit(1)).over(w) / 2), F.sum(votes).over(w)), F.lit(0.0))
    # One more on each side than the bounds, for rounding.
    r = rows.withColumns({"had": F.greatest(F.floor(share(-1) - 1.5), F.lit(0)), "most": F.ceil(share(1) + 1.5)})
    r = r.withColumn("open", F.col(seats) - F.sum("had").over(w)).withColumn("j", F.explode(F.sequence(F.lit(0).cast("long"), F.col("most") - F.col("had"))))
    r = r.withColumn("place", F.row_number().over(w.orderBy((F.col(votes) / (2 * (F.col("had") + F.col("j")) + 1)).desc(), name)))
    won = F.count_if((F.col("place") <= F.col("open")) & (F.col(votes) > 0))
    return r.groupBy(*rows.columns).agg((F.first("had") + won).alias("quota"))


def _reshared(cells: DataFrame, block: int, passes: int) -> DataFrame:
    """Adds ``due``: a cell's quota in words within its limit, and its part of what the limits of its source's other cells cut off, by room."""
    every, upto = Window.partitionBy("k"), Window.partitionBy("k").orderBy("shard").rowsBetween(Window.unboundedPreceding, 0)
    limit = passes * F.col("cell_size")
    c = cells.withColumn("due", F.least(F.col("quota") * block, limit)).withColumn("room", limit - F.col("due"))
    c = c.withColumns({"rooms": F.sum("room").over(every), "filled": F.sum("room").over(upto), "cut": F.sum(F.col("quota") * block - F.col("due")).over(every)})
    upto_here = lambda filled: F.expr(f"CAST(CAST(least(cut, rooms) AS DECIMAL(19, 0)) * CAST({filled} AS DECIMAL(19, 0)) / greatest(rooms, 1) AS DECIMAL(38, 6))")
    more = F.floor(upto_here("filled")) - F.floor(upto_here("(filled - room)"))
    return c.withColumn("due", (F.col("due") + more).cast("long")).drop("room", "rooms", "filled", "cut")


def mix(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", weights: tuple[int, ...] = WEIGHTS, block: int = BLOCK, shard_words: int = SHARD_WORDS, passes: int = PASSES, seed: str = SEED, keep: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, source, shard, size, source_size, target, taken, *keep) of each row; ``taken`` words, repeats counted, at most ``passes`` times the size.

    A null source is a source of its own; null and wordless texts have size 0 and give nothing; rows with the same id and text are documents of their
    own; other columns are ignored unless named in ``keep``; an empty table gives no rows. A row's shard and place are drawn from its id and text, so rows
    without id spread as others do. The number of shards of a source follows its words, some ``shard_words`` each (or one longer text). Every source is
    within a block of its target.
    """
    words = F.regexp_count(F.coalesce(F.col(text), F.lit("")), F.lit(WORD)).cast("long")
    key = draw(seed, F.col(doc_id), F.md5(F.coalesce(F.col(text), F.lit("")).cast("binary"))).alias("draw")
    sizes = materialize(docs.select(F.col(doc_id).alias("doc_id"), F.col(source).cast("string").alias("source"), words.alias("size"), key, *keep), "sizes")
    goal = materialize(targets(sizes, weights, passes), "targets")
    total = goal.agg(F.coalesce(F.sum("source_size"), F.lit(0))).first()[0]
    quota = apportion(goal.withColumn("seats", F.lit((2 * total + block) // (2 * block))), [], "k", "target", "seats").select("source", "k", "source_size", "target", F.col("quota").alias("blocks"))

    # One row for each source; Spark broadcasts it where it is small.
    shards = goal.select(F.col("source").alias("of"), F.greatest(F.lit(1), F.ceil(F.col("source_size") / shard_words)).cast("long").alias("shards"))
    dealt = sizes.join(shards, F.col("source").eqNullSafe(F.col("of"))).withColumn("shard", number(F.col("draw")) % F.col("shards")).drop("of", "shards")
    cells = dealt.groupBy("source", "shard").agg(F.sum("size").alias("cell_size"))
    cells = cells.join(quota.withColumnRenamed("source", "named"), F.col("source").eqNullSafe(F.col("named"))).drop("named")
    cells = _reshared(apportion(cells, ["k"], "shard", "cell_size", "blocks"), block, passes)
    ring = cells.select(F.col("source").alias("named"), F.col("shard").alias("in_shard"), "source_size", "target", "cell_size", "due", (number(draw(seed, "from", F.col("k"), F.col("shard"))) % F.greatest(F.lit(1), F.ceil(F.col("cell_size") / block)) * block).alias("from"))
    upto = F.sum("size").over(Window.partitionBy("source", "shard").orderBy("draw", "size", *keep).rowsBetween(Window.unboundedPreceding, 0))
    laid = dealt.withColumn("end", upto).join(ring, F.col("source").eqNullSafe(F.col("named")) & (F.col("shard") == F.col("in_shard")))
    rounds = F.coalesce(F.floor(F.try_divide("due", "cell_size")), F.lit(0))
    to = F.col("from") + F.col("due") - rounds * F.col("cell_size")
    shared = lambda a, b: F.greatest(F.least(F.col("end"), b) - F.greatest(F.col("end") - F.col("size"), a), F.lit(0))
    taken = rounds * F.col("size") + shared(F.col("from"), F.least(to, F.col("cell_size"))) + shared(F.lit(0), to - F.col("cell_size"))
    return laid.select("doc_id", "source", "shard", "size", "source_size", "target", taken.cast("long").alias("taken"), *keep)
