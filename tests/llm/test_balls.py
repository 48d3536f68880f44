"""Ranked search in ball trees against scoring every document."""

from __future__ import annotations

import math
import random
import re

import numpy as np
import pytest

from barloom.llm import balls


def terms(text: str | None) -> list[str]:
    low = re.sub("[A-Z]", lambda m: chr(ord(m[0]) + 32), text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", low)


def plain(docs: list[tuple], items: list[tuple], k: int = 10) -> list[tuple]:
    words = [(d, terms(t)) for d, t in docs]
    held = [(d, w) for d, w in words if w]
    n_docs, length = len(held), sum(len(w) for _, w in held)
    out = []
    for item, text in items:
        scores = []
        for d, w in held:
            m, s = 100 - 90 + (90 * len(w) * n_docs) // length, 0
            for t in set(terms(text)):
                tf = w.count(t)
                df = sum(t in set(x) for _, x in held)
                s += math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1))) * ((1000000000 * tf) // (1000 * tf + 8 * m))
            if s > 0:
                scores.append((-s, d is None, d or 0))
        out += [(item, r + 1, None if null else d, -s) for r, (s, null, d) in enumerate(sorted(scores)[:k])]
    return sorted(out, key=repr)


def found(spark, docs, items, **more):
    d = spark.createDataFrame([(*r, 1, 0.5) for r in docs], "doc_id long, text string, n int, score double")
    i = spark.createDataFrame([(*r, "x") for r in items], "item_id long, text string, terms string")
    return sorted(map(tuple, balls.top(d, i, **more).collect()), key=repr)


def corpus(seed: int, n: int = 90) -> tuple[list, list]:
    rng = random.Random(seed)
    pool = [f"w{k}" for k in range(60)] + ["Été", "ÉTÉ", "x-y", "A1", "a1"]
    some = lambda k: " ".join(rng.choices(pool, [1 / (j + 1) for j in range(len(pool))], k=k))
    docs = [(k, some(rng.randrange(0, 40))) for k in range(n)] + [(None, "w1 w2 w3"), (None, None), (n, ""), (n + 1, "--- \x00"), (5, "w1 W2 w3"), (6, "w1 w2 w3"), (4, "w1 w2 w3")]
    items = [(k, some(rng.randrange(1, 9))) for k in range(12)] + [(100, None), (101, ""), (102, "nowhere else"), (1, "w3"), (103, some(300))]
    return docs, items


@pytest.mark.parametrize("seed", [1, 2])
def test_against_scoring_all(spark, monkeypatch, seed):
    monkeypatch.setattr(balls, "LEAF", 4)
    monkeypatch.setattr(balls, "CHUNK", 25)
    monkeypatch.setattr(balls, "SAMPLE", 30)
    docs, items = corpus(seed)
    assert found(spark, docs, items) == plain(docs, items)


def test_blocks_of_items_and_copies(spark, monkeypatch):
    docs, items = corpus(4, 40)
    docs += [(k, "w0 w1 w0 w9") for k in range(200, 260)]
    monkeypatch.setattr(balls, "BLOCK_BYTES", 400)
    assert found(spark, docs, items, k=3) == plain(docs, items, k=3)


def test_empty_tables(spark):
    assert found(spark, [], [(1, "w1")]) == found(spark, [(1, "w1")], []) == found(spark, [(1, None)], [(1, "w1")]) == []


def test_bounds_hold_and_prune():
    rng = np.random.default_rng(7)
    width, rows = 50, []
    for _ in range(800):
        cols = np.sort(rng.choice(width, rng.integers(1, 9), replace=False))
        rows.append((cols, rng.integers(1, 1000, cols.size)))
    for cols in ([1, 2, 3], [4, 5, 6, 7]):
        rows += [(np.array(cols), np.full(len(cols), 10**9 + k)) for k in range(20)]
    x = balls.Sparse.of(rows)
    root, sorted_, order = balls.build(x, width)
    queries = balls.Sparse.of([(np.array(q), np.ones(len(q), dtype=np.int64)) for q in ([1, 2, 3], [4, 5, 6, 7], [0, 9], list(range(width)))])
    scores = x.times(queries.by_column(width), len(queries))

    def walk(node):
        mine = scores[order[node.first : node.last]]
        dot = node.centre.times(balls.Sparse(*[getattr(queries.by_column(width), c) for c in ("ptr", "cols")], queries.by_column(width).vals.astype(float)), len(queries))[0]
        assert (mine <= (dot + np.sqrt(queries.sizes()) * node.radius) * (1 + balls.SLACK) + 1).all()
        for child in node.below:
            walk(child)

    walk(root)
    best = balls.Best(1, 10, np.zeros(1))
    leaves = balls.search(x, [(False, k) for k in range(len(rows))], queries.slice(0, 1), best, width)
    assert [s for s, _ in best.rows[0]] == sorted(scores[:, 0], reverse=True)[:10]
    assert leaves <= 3
