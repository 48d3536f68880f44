"""Chat formatting of logged conversations, after snapshots that a longer log contains are folded into it.

Chat logs often hold the same conversation several times, once for each turn reached. A hash of every turn prefix is carried
along each conversation; a conversation whose whole hash is a proper prefix of another one goes (anti-join), of equal
conversations the smallest id stays. What remains is rendered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

OPEN, CLOSE = "<|im_start|>", "<|im_end|>"


def _key(pos: Column, seed: int, *cols: str) -> Column:
    """Position-bound hash of a turn; nulls differ from every text."""
    return F.xxhash64(F.lit(seed), pos, *[F.coalesce(c, F.lit("")) for c in map(F.col, cols)], *[F.col(c).isNull() for c in cols])


def prefixes(turns: DataFrame) -> DataFrame:
    """(conv_id, pos, a, b, last): 128 bits that name the first ``pos`` turns of the conversation.

    A turn's hash is bound to its position, so the running exclusive-or names the sequence. A row without conv_id is a conversation of one turn.
    """
    named = turns.select("conv_id", "turn", "role", "text", F.xxhash64(F.lit(1), "text").alias("t1"), F.xxhash64(F.lit(2), "text").alias("t2"), F.col("text").isNull().alias("tn"))
    w = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    alone = named.where(F.col("conv_id").isNull()).withColumns({"pos": F.lit(1), "last": F.lit(True)})
    numbered = named.where(F.col("conv_id").isNotNull()).withColumn("pos", F.row_number().over(w)).withColumn("last", F.lead(F.lit(1)).over(w).isNull())
    role = (F.coalesce("role", F.lit("")), F.col("role").isNull(), F.col("tn"))
    run = w.rowsBetween(Window.unboundedPreceding, 0)
    turn = {"a": F.xxhash64(F.lit(3), "pos", *role, "t1", "t2"), "b": F.xxhash64(F.lit(4), "pos", *role, "t2", "t1")}
    many = numbered.select("conv_id", "pos", "last", *[F.bit_xor(h).over(run).alias(c) for c, h in turn.items()])
    return many.union(alone.select("conv_id", "pos", "last", *[h.alias(c) for c, h in turn.items()]))


def maximal(turns: DataFrame) -> DataFrame:
    """(conv_id, a, b) of every conversation that no longer one starts with; the smallest id of equal ones, null only where none has an id.

    Prefix hashes become distinct before the join (partial sums first), so a first turn or a whole conversation that is logged
    a million times is one row in it.
    """
    p = prefixes(turns)
    inner = p.where(~F.col("last")).groupBy("pos", "a", "b").agg(F.lit(1).alias("one"))
    whole = p.where("last").groupBy("pos", "a", "b").agg(F.min("conv_id").alias("conv_id"))
    return whole.join(inner, ["pos", "a", "b"], "left_anti").select("conv_id", "a", "b")


def render(turns: DataFrame) -> DataFrame:
    """(conv_id, n_turns, chat): turns in order of turn, role and text between the markers; a marker inside a text is broken by a blank.

    Null roles read ``unknown``, null texts are empty. One conversation is one row, so it must fit into memory as a text does.
    """
    turn = F.struct("turn", "role", "text")
    got = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list(turn)).alias("all"))
    return got.select("conv_id", F.size("all").cast("long").alias("n_turns"), F.array_join(F.transform("all", _body), "").alias("chat"))


def _alone(turns: DataFrame, keep: DataFrame) -> DataFrame:
    """The kept rows without conv_id, rendered; ``turns`` are all such rows, ``keep`` names some by their hashes."""
    one = turns.groupBy("role", "text").agg(F.min("turn").alias("turn"))
    t1, t2, tn = F.xxhash64(F.lit(1), "text"), F.xxhash64(F.lit(2), "text"), F.col("text").isNull()
    role = (F.coalesce("role", F.lit("")), F.col("role").isNull(), tn)
    named = one.select("*", F.xxhash64(F.lit(3), F.lit(1), *role, t1, t2).alias("a"), F.xxhash64(F.lit(4), F.lit(1), *role, t2, t1).alias("b"))
    kind = turns.schema["conv_id"].dataType
    kept = named.join(keep, ["a", "b"], "left_semi").withColumn("conv_id", F.lit(None).cast(kind))
    return kept.select("conv_id", F.lit(1).cast("long").alias("n_turns"), _body(F.struct("turn", "role", "text")).alias("chat"))


def _body(x: Column) -> Column:
    return F.concat(F.lit(OPEN), F.coalesce(x["role"], F.lit("unknown")), F.lit("\n"), F.replace(F.coalesce(x["text"], F.lit("")), F.lit("<|im_"), F.lit("< |im_")), F.lit(CLOSE + "\n"))


def format_chats(conversations: DataFrame) -> DataFrame:
    """(conv_id, n_turns, chat) of every maximal conversation.

    Repeated rows are turns of their own, equal turn numbers go by role and text, null first. A row without a conv_id is a conversation of its own, of equal
    ones one stays. Extra columns are ignored; an empty table gives no rows.
    """
    turns = conversations.select(*[F.col(c) for c in ("conv_id", "turn", "role", "text")])
    keep = maximal(turns)
    some = render(turns.join(keep.where(F.col("conv_id").isNotNull()).select("conv_id"), "conv_id", "left_semi"))
    # Equal rows without an id become one before anything is joined, with partial sums first.
    alone = turns.where(F.col("conv_id").isNull())
    return some.unionByName(_alone(alone, keep.where(F.col("conv_id").isNull()).select("a", "b")))
