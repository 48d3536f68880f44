"""Line dedup against a plain count of lines."""

from __future__ import annotations

import random
import re
from collections import defaultdict

import pytest

from barloom.llm import lines

LONG = ["A line that is long enough to count", "the SECOND line of twenty and more", "Ä line with letters outside of ascii İ", "twenty code points!!", "nineteen code point"]


def key(line: str) -> str:
    return re.sub(r"[A-Z]", lambda m: chr(ord(m[0]) + 32), line.strip(" \t\n\x0b\x0c\r"))


def plain(rows: list[tuple[int | None, str | None]]) -> list[tuple]:
    held = defaultdict(set)
    for d, t in rows:
        for x in (t or "").split("\n"):
            held[key(x)].add(d)
    top = {k: max((d for d in ds if d is not None), default=None) for k, ds in held.items()}
    out = []
    for d, t in rows:
        some = (t or "").split("\n")
        gone = [len(key(x)) >= 20 and len(held[key(x)]) >= 3 and d != top[key(x)] for x in some]
        out.append((d, len(some), sum(gone), "\n".join(x for x, g in zip(some, gone, strict=True) if not g)))
    return sorted(out, key=repr)


def found(spark, rows):
    docs = spark.createDataFrame([(*r, 1, 2, "x") for r in rows], "doc_id long, text string, pos int, key_a int, lines string")
    return sorted([(r.doc_id, r.n_lines, r.n_dropped, r.kept) for r in lines.dedup(docs).collect()], key=repr)


def corpus(seed: int, n: int) -> list[tuple[int | None, str | None]]:
    rng = random.Random(seed)
    pool = LONG + [f"some line number {k} that comes again" for k in range(30)]
    blank = lambda: rng.choice(["", " ", "\t", "  \x0b", "\r", "\x85"])
    line = lambda: rng.choice(["", "short", blank() + rng.choice(pool) + blank(), rng.choice(pool).upper(), f"only here {rng.random()} and not again"])
    rows = [(rng.choice([k, k, k, None, 7]), "\n".join(line() for _ in range(rng.randrange(0, 9)))) for k in range(n)]
    return [*rows, (None, None), (3, ""), (n + 5, "\n".join(line() for _ in range(400))), rows[0], rows[0]]


@pytest.mark.parametrize("seed", [1, 2])
def test_against_a_plain_count(spark, seed):
    rows = corpus(seed, 120)
    got = found(spark, rows)
    assert got == plain(rows)
    assert sum(r[2] > 0 for r in got) > 30


def test_hot_lines_take_the_other_way_to_the_same_result(spark, monkeypatch):
    rows = [(k, f"{LONG[0]}\nown line of document number {k}\n{LONG[1] if k < 2 else ''}\n{LONG[0]} ") for k in range(1500)] + [(None, LONG[0]), (9, None)]
    used = []
    hot = lines._hot
    monkeypatch.setattr(lines, "_hot", lambda x: used.append(hot(x)) or used[-1])
    assert found(spark, rows) == plain(rows)
    assert used[0] is not None and used[0].count() == 1


def test_bits_of_long_texts(spark):
    one = "\n".join(LONG[0] if k in (0, 59, 60, 61, 400) else f"this is line {k} of the text" for k in range(500))
    rows = [(1, one), (2, LONG[0]), (3, LONG[0])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    of = {r.n_dropped: [(x.word, bin((1 << 60) - 1 - x.bits).count("1")) for x in r.keep] for r in lines.bitmaps(docs).collect()}
    assert of == {5: [(0, 2), (1, 2), (6, 1)], 1: [(0, 1)]}
    assert found(spark, rows) == plain(rows)


def test_empty_table(spark):
    assert found(spark, []) == []


def test_one_range_exchange_and_no_python(spark):
    docs = spark.createDataFrame(corpus(3, 50), "doc_id long, text string")
    plan = lines._dropped(docs.select(F_hash("key_a"), F_hash("key_b"), "doc_id", F_hash("row_a"), F_hash("row_b"), F_hash("pos")))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange rangepartitioning") == 1 and "hashpartitioning" not in plan
    assert "Python" not in lines.dedup(docs)._jdf.queryExecution().executedPlan().toString()


def F_hash(name):
    from pyspark.sql import functions as F

    return F.xxhash64("text").alias(name)
