"""Quality rules: an ordered decision list of threshold conjunctions, learned by sequential covering from labelled statistics.

A rule for junk is grown condition by condition on two thirds of the labelled rows (information gain) and pruned on the other
third; the rows it covers go, and the next rule is grown. All counting is Spark aggregation over binned statistics; the driver
sees counts by statistic and bin only. The list becomes one conditional expression that Spark evaluates on the statistics.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.session import materialize

WORD = r"[^\x20\x09-\x0D]+"
SYMBOL = r"[#*$%&|<>]"
FEATURES = ["n_words", "word_length", "symbol_rate", "upper_rate", "mark_rate", "distinct_rate", "repeat_rate", "dup_line_rate"]
#: Beyond so many different repeated windows a sorted copy replaces the search in a list; both are exact.
FEW = 32


def statistics(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, ``keep``, the five base counts, ``base_failed`` and the rates of FEATURES, for each row; all within the row.

    Null texts have no words and fail the base rule. Windows of three words are told apart by 64-bit hashes. Repeated rows
    stay repeated, other columns are ignored unless kept (by names of no statistic), an empty table stays empty.
    """
    t = docs.select(F.col(doc_id).alias("doc_id"), *keep, F.coalesce(F.col(text), F.lit("")).alias("t"))
    t = t.select(
        "doc_id", *keep, F.length("t").alias("n_chars"), F.regexp_extract_all("t", F.lit(WORD), F.lit(0)).alias("w"), F.filter(F.split("t", "\n", -1), lambda x: x.rlike(WORD)).alias("lines"),
        F.regexp_count("t", F.lit(SYMBOL)).alias("n_symbols"), F.regexp_count("t", F.lit("[A-Z]")).alias("n_upper"), F.regexp_count("t", F.lit("[!?]")).alias("n_marks"),
    )
    none = F.array().cast("array<bigint>")
    window = lambda i: F.xxhash64(F.get("w", i), F.get("w", i + 1), F.get("w", i + 2))
    t = t.withColumn("h", F.when(F.size("w") >= 3, F.transform(F.sequence(F.lit(0), F.size("w") - 3), window)).otherwise(none))
    t = t.withColumn("s", F.sort_array("h"))
    t = t.withColumn("twice", F.array_distinct(F.filter("s", lambda x, i: x == F.get("s", i - 1))))
    t = t.withColumn("order", F.when(F.size("twice") > FEW, F.sort_array(F.transform("h", lambda x, i: F.struct(x.alias("h"), i.alias("i"))))))
    listed = F.filter(F.transform("h", lambda x, i: F.when(F.array_contains("twice", x), i)), lambda i: i.isNotNull())
    beside = F.filter("order", lambda x, k: (x["h"] == F.get("order", k - 1)["h"]) | (x["h"] == F.get("order", k + 1)["h"]))
    t = t.withColumn("at", F.when(F.size("twice") == 0, F.array().cast("array<int>")).when(F.size("twice") <= FEW, listed).otherwise(F.sort_array(F.transform(beside, lambda x: x["i"]))))
    # A window covers its three words, less what the next window covers.
    covered = F.transform("at", lambda p, k: F.least(F.lit(3), F.coalesce(F.get("at", k + 1) - p, F.lit(3))))
    t = t.select(
        "doc_id", *keep, "n_chars", F.size("w").cast("long").alias("n_words"), F.aggregate("w", F.lit(0).cast("long"), lambda a, x: a + F.length(x)).alias("word_chars"), F.col("n_symbols").cast("long"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"), F.aggregate(covered, F.lit(0).cast("long"), lambda a, x: a + x).alias("n_repeat_words"),
        F.size("lines").alias("n_lines"), F.size(F.array_distinct("w")).alias("n_distinct"), "n_upper", "n_marks",
    )
    per = lambda x, y: F.coalesce(F.try_divide(F.col(x), F.col(y)), F.lit(0.0))
    return t.select(
        "doc_id", *keep, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        ((F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))).alias("base_failed"),
        per("word_chars", "n_words").alias("word_length"), per("n_symbols", "n_words").alias("symbol_rate"), per("n_upper", "n_chars").alias("upper_rate"), per("n_marks", "n_words").alias("mark_rate"),
        per("n_distinct", "n_words").alias("distinct_rate"), per("n_repeat_words", "n_words").alias("repeat_rate"), per("n_dup_lines", "n_lines").alias("dup_line_rate"),
    )


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    cut: float

    def column(self) -> Column:
        return F.col(self.feature) > self.cut if self.above else F.col(self.feature) <= self.cut

    def __str__(self) -> str:
        return f"{self.feature} {'>' if self.above else '<='} {self.cut:g}"


Rule = tuple[Condition, ...]


def _all(rule: Rule) -> Column:
    return reduce(lambda a, b: a & b, (c.column() for c in rule), F.lit(True))


def _cuts(rows: DataFrame, parts: int) -> dict[str, list[float]]:
    """Cuts halfway between neighbouring quantiles of each statistic."""
    grid = [k / parts for k in range(parts + 1)]
    got = rows.agg(*[F.percentile_approx(F.col(f).cast("double"), grid, 10_000).alias(f) for f in FEATURES]).first()
    values = {f: sorted(set(got[f] or [])) for f in FEATURES}
    return {f: [(a + b) / 2 for a, b in zip(v, v[1:], strict=False)] for f, v in values.items()}


def _gain(p: int, n: int, p0: int, n0: int) -> float:
    return p * (math.log2(p / (p + n)) - math.log2(p0 / (p0 + n0))) if p else 0.0


def learn(stats: DataFrame, labels: DataFrame, doc_id: str = "doc_id", label: str = "quality", sample: int = 20_000, parts: int = 100, precision: float = 0.97, cover: int = 5, rules: int = 20, conditions: int = 4) -> list[Rule]:
    """The decision list for junk (label 0).

    ``sample`` bounds the labelled rows it is fitted on, those with the smallest hash of their id; labels that are null or not 0 or 1 and
    ids that have both are left out. A rule must be right on ``precision`` of the rows that prune it and cover ``cover`` junk rows. No
    junk or nothing else among the labels: an empty list.
    """
    known = labels.select(F.col(doc_id).alias("doc_id"), F.col(label).alias("y")).where(F.col("y").isin(0, 1)).groupBy("doc_id").agg(F.min("y").alias("y"), F.max("y").alias("z")).where("y = z").select("doc_id", (F.col("y") == 0).alias("junk"))
    once = stats.select("doc_id", *FEATURES).join(known, "doc_id")
    chosen = once.orderBy(F.xxhash64("doc_id"), "doc_id", *FEATURES).limit(sample).withColumn("grow", F.pmod(F.xxhash64("doc_id", F.lit("part")), F.lit(3)) > 0)
    rows = materialize(chosen, "rules")
    cuts = _cuts(rows, parts)
    left, out = rows.withColumn("bins", F.array(*[_bin(f, cuts[f]) for f in FEATURES])), []
    while len(out) < rules:
        rule: Rule = ()
        pure = False
        while not pure and len(rule) < conditions and (best := _best(left.where("grow").where(_all(rule)), cuts, cover)):
            rule, pure = (*rule, best[0]), best[1]
        if not (rule := _pruned(left, rule, precision, cover)):
            break
        out.append(rule)
        left = left.where(~_all(rule))
    return out


def _bin(feature: str, cuts: list[float]) -> Column:
    """How many cuts lie below the value."""
    return F.size(F.filter(F.split(F.lit(" ".join(map(repr, cuts))), " ").cast("array<double>"), lambda c: c < F.col(feature))) if cuts else F.lit(0)


def _best(rows: DataFrame, cuts: dict[str, list[float]], cover: int) -> tuple[Condition, bool] | None:
    """The condition of the highest gain among all statistics and cuts, and whether no good row is left under it; None without any gain."""
    counted = rows.select("junk", F.posexplode("bins").alias("f", "bin")).groupBy("f", "bin").agg(F.count_if("junk").alias("p"), F.count_if(~F.col("junk")).alias("n")).collect()
    by: dict[int, dict[int, tuple[int, int]]] = {}
    for r in counted:
        by.setdefault(r["f"], {})[r["bin"]] = (r["p"], r["n"])
    found = None
    for f, of_bin in sorted(by.items()):
        p0, n0 = (sum(x[k] for x in of_bin.values()) for k in (0, 1))
        if not p0 or not n0:
            continue
        below_p = below_n = 0
        for k, cut in enumerate(cuts[FEATURES[f]]):
            p, n = of_bin.get(k, (0, 0))
            below_p, below_n = below_p + p, below_n + n
            for above, p, n in ((False, below_p, below_n), (True, p0 - below_p, n0 - below_n)):
                if p >= cover and (gain := _gain(p, n, p0, n0)) > 1e-9 and (found is None or gain > found[0] + 1e-9):
                    found = gain, Condition(FEATURES[f], above, cut), n == 0
    return found and found[1:]


def _pruned(rows: DataFrame, rule: Rule, precision: float, cover: int) -> Rule:
    """The beginning of the rule that separates the pruning rows best; empty if it isn't right often enough."""
    if not rule:
        return ()
    starts = [rule[: k + 1] for k in range(len(rule))]
    got = rows.where(~F.col("grow")).agg(*[F.count_if(_all(s) & (F.col("junk") == j)).alias(f"{'np'[j]}{k}") for k, s in enumerate(starts) for j in (False, True)]).first()
    worth = lambda k: ((got[f"p{k}"] - got[f"n{k}"]) / max(1, got[f"p{k}"] + got[f"n{k}"]), got[f"p{k}"], -k)
    k = max(range(len(rule)), key=worth)
    return starts[k] if got[f"p{k}"] >= max(1, cover // 2) and got[f"p{k}"] >= precision * (got[f"p{k}"] + got[f"n{k}"]) else ()


def apply(stats: DataFrame, rules: list[Rule]) -> DataFrame:
    """Adds ``rule`` (number of the first rule that holds, from 1; null: none) and ``kept``: neither the base rule nor any of these."""
    first = F.lit(None).cast("long")
    for k, rule in reversed(list(enumerate(rules, 1))):
        first = F.when(_all(rule), F.lit(k).cast("long")).otherwise(first)
    return stats.withColumn("rule", first).withColumn("kept", ~F.col("base_failed") & F.col("rule").isNull())


def judge(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", keep: tuple[str, ...] = (), **fit) -> DataFrame:
    """Statistics and verdict of every row; texts are read once, their statistics are kept in the shared folder."""
    stats = materialize(statistics(docs, doc_id, text, keep), "stats")
    return apply(stats, learn(stats, labels, **fit))
