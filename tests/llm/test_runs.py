"""Periodic runs against a plain search over all periods."""

from __future__ import annotations

import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from barloom.llm import runs


def plain(words: list[str]) -> list[tuple[int, int, int]]:
    n, out = len(words), []
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            size = j + q - i
            smaller = any(all(words[x] == words[x + p] for x in range(i, i + size - p)) for p in range(1, q) if q % p == 0)
            if size >= max(6, 4 * q) and not smaller:
                out.append((i, size, q))
            i = j + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def plain_digest(doc_id: int | None, text: str | None) -> tuple:
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n = len(words)
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    found = plain(words)
    gone = {i for s, m, q in found for i in range(s + q, s + m)}
    best = max(found, key=lambda r: (r[1] / r[2], -r[0], -r[2]), default=None)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    one = (*best[:2], best[2], 1000 * best[1] // best[2]) if best else (None,) * 4
    return (doc_id, len(found), *one, sha("".join(f"{s},{m},{q}\n" for s, m, q in found)), sha(" ".join(w for i, w in enumerate(words) if i not in gone)))


def test_successor_against_sorting():
    rng = np.random.default_rng(3)
    values = rng.permutation(500)
    lo = rng.integers(0, 500, 400)
    hi = np.minimum(500, lo + rng.integers(1, 200, 400))
    above = rng.integers(0, 500, 400)
    got = runs.Wavelet(values).successor(lo, hi, above)
    for a, b, x, y in zip(lo, hi, above, got, strict=True):
        assert y == min((v for v in values[a:b] if v > x), default=-1)


@pytest.mark.parametrize("seed", range(60))
def test_runs_of_random_sequences(seed):
    rng = random.Random(seed)
    words: list[int] = []
    while len(words) < rng.choice([0, 5, 30, 200]):
        period = [rng.randrange(1 + seed % 4) for _ in range(rng.randrange(1, 14))]
        words += (period * rng.randrange(1, 9))[: rng.randrange(1, 90)]
    seq = np.array([*words, 99], dtype=np.int64)
    got = list(zip(*[x.tolist() for x in runs.runs(seq, len(words))], strict=True))
    assert got == plain(words)


def test_each_period_and_offset_alone():
    for q in (1, 2, 3, 4, 5, 7, 8, 9, 15, 16, 17, 31, 32, 33):
        for off in range(0, 70, 3):
            size = max(6, 4 * q)
            words = [*range(1000, 1000 + off), *[k % q for k in range(size)], *range(2000, 2010)]
            got = list(zip(*[x.tolist() for x in runs.runs(np.array([*words, 5000]), len(words))], strict=True))
            assert got == [(off, size, q)]


def test_digest_of_odd_rows(spark, monkeypatch):
    rng = random.Random(5)
    some = lambda k: " ".join(rng.choice("abé") for _ in range(k))
    rows = [(k, some(rng.randrange(0, 90))) for k in range(150)]
    rows += [(500, None), (501, ""), (502, "  \t\n"), (None, "x " * 9), (None, None), (7, "y " * 40), (7, "y " * 40), (503, "a\x0bb\x0ca\rb a b a b a b")]
    rows += [(k, " ".join(f"w{i}" for i in range(200))) for k in range(600, 640)]
    rows += [(900, "the same few words again and " * 900)]
    monkeypatch.setattr(runs, "AT_ONCE", 300)
    docs = spark.createDataFrame([(*r, 1, "z") for r in rows], "doc_id long, text string, n_words int, runs string")
    got = sorted(map(tuple, runs.digest(runs.find(docs, planted=True)).collect()), key=repr)
    assert got == sorted([plain_digest(*r) for r in rows], key=repr)
    assert sum(r[1] > 0 for r in got) > 10


def test_empty_table(spark):
    assert runs.digest(runs.find(spark.createDataFrame([], "doc_id long, text string"))).count() == 0


def test_query_equals_the_plain_search(spark):
    from barloom.llm.catalog import QUERIES, table

    sf = "/root/testdata/sf0.001"
    got = {r[0]: tuple(r) for r in QUERIES["op13_runs"](spark, sf).collect()}
    short = [r for r in table(spark, sf, "documents").select("doc_id", "text").collect() if len(r[1] or "") < 6000]
    assert len(got) == 200 and len(short) > 150
    for r in short:
        assert got[r[0]] == plain_digest(*r)
