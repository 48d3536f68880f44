"""Path-dependent states: the state of a row depends on the series' own earlier state.

There is no set-based form, so each series is one sorted array that a higher-order function folds with a struct as its state. A series never has more
rows than the calendar, so an array is bounded, and series run in parallel. The fold notes only the rows where the held flag turns; the rows come back
from the stretches between.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

State = dict[str, Column]


def _let(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then(value)`` with the value computed once."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def _fold(df: DataFrame, cols: dict[str, Column], start: State, step: Callable[[Column, Column], State], out: str) -> DataFrame:
    """(series_id, date, pos, out). ``start`` is the state before the first row, ``step`` the next state from state and row; both have ``held``."""
    rows = df.select("series_id", F.struct("pos", "date", *[c.alias(n) for n, c in cols.items()]).alias("_r"))
    rows = rows.groupBy("series_id").agg(F.sort_array(F.collect_list("_r")).alias("_r"))
    none = F.array().cast("array<int>")
    begin = F.struct(*[c.alias(n) for n, c in start.items()], F.lit(0).alias("_i"), none.alias("_turns"))

    def merge(s: Column, r: Column) -> Column:
        new = F.struct(*[c.alias(n) for n, c in step(s, r).items()])
        turns = lambda n: F.when(n["held"] != s["held"], F.concat(s["_turns"], F.array(s["_i"]))).otherwise(s["_turns"])
        return _let(new, lambda n: F.struct(*[n[c].alias(c) for c in start], (s["_i"] + 1).alias("_i"), turns(n).alias("_turns")))

    turns = rows.select("series_id", "_r", F.aggregate("_r", begin, merge)["_turns"].alias("_t"))
    cut = turns.select("series_id", "_r", F.posexplode(F.arrays_zip(F.concat(F.array(F.lit(0)), "_t").alias("a"), F.concat("_t", F.array(F.size("_r"))).alias("b"))).alias("_k", "_c"))
    cut = cut.where("_c.b > _c.a").select("series_id", (F.col("_k") % 2 == 1).alias(out), F.explode(F.slice("_r", F.col("_c.a") + 1, F.col("_c.b") - F.col("_c.a"))).alias("_r"))
    return cut.select("series_id", "_r.date", "_r.pos", out)


def _true(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


def _number(c: str) -> Column:
    return F.col(c).cast("double")


def _none() -> Column:
    return F.lit(None).cast("double")


def min_hold_latch(df: DataFrame, entry: str, exit_: str, min_hold: int, out: str = "held") -> DataFrame:
    """Latch that refuses to leave until ``min_hold`` rows after entering; an entry on the same row wins."""

    def step(s: Column, r: Column) -> State:
        age = F.when(s["held"], s["age"] + 1).otherwise(0)
        return {"held": F.when(s["held"], ~(r["leave"] & ~r["enter"] & (age >= min_hold))).otherwise(r["enter"]), "age": age}

    return _fold(df, {"enter": _true(F.col(entry)), "leave": _true(F.col(exit_))}, {"held": F.lit(False), "age": F.lit(0)}, step, out)


def trailing_stop(df: DataFrame, breakout: str, atr: str, mult: float, close: str = "adj_close", mask: str = "mask", out: str = "held") -> DataFrame:
    """Enter on a breakout, leave once the close falls ``mult`` ATRs below the highest close since entry."""

    def step(s: Column, r: Column) -> State:
        stays = s["held"] & ~_true(r["px"] < s["top"] - F.lit(mult) * r["atr"])
        enters = ~stays & r["enter"]
        return {"held": (stays | enters) & r["ok"], "top": F.when(stays, F.greatest(s["top"], r["px"])).when(enters, r["px"])}

    ok = _true(F.col(mask))
    cols = {"px": _number(close), "atr": _number(atr), "enter": _true(F.col(breakout)) & ok, "ok": ok}
    return _fold(df, cols, {"held": F.lit(False), "top": _none()}, step, out)


def ratchet_band(df: DataFrame, atr: str, mult: float, min_hold: int = 0, close: str = "adj_close", mask: str = "mask", out: str = "held") -> DataFrame:
    """Flip long above the upper band and out below the lower one; a band only tightens while its side holds.

    The comparison uses the band of the previous row, the only one known when the row's close prints; so nothing is long on the first row.
    """

    def step(s: Column, r: Column) -> State:
        up, down = _true(r["px"] > s["high"]), _true(r["px"] < s["low"])
        age = s["age"] + s["long"].cast("int")
        long = F.when(up, True).when(s["long"] & down & (age >= min_hold), False).otherwise(s["long"])
        return {
            "held": long & r["ok"],
            "long": long,
            "age": F.when(up & ~s["long"], 0).otherwise(age),
            "px": r["px"],
            "low": F.when(s["px"] > s["low"], F.greatest(r["low"], s["low"])).otherwise(r["low"]),
            "high": F.when(s["px"] < s["high"], F.least(r["high"], s["high"])).otherwise(r["high"]),
        }

    mid, wide = (_number("high") + _number("low")) / 2, F.lit(mult) * _number(atr)
    cols = {"px": _number(close), "low": mid - wide, "high": mid + wide, "ok": _true(F.col(mask))}
    return _fold(df, cols, {"held": F.lit(False), "long": F.lit(False), "age": F.lit(0), "px": _none(), "low": _none(), "high": _none()}, step, out)
