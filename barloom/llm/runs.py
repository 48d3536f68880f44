"""Periodic runs of words by internal pattern matching.

Words become numbers, the texts of a batch one sequence with a mark of its own behind each text. Prefix doubling names all blocks of 2^k words
and sorts the suffixes. A block of L words asks for its next occurrence: the successor of its place among the values of its range of
the suffix array, which a wavelet matrix answers. Occurrences no farther than L apart form one progression, so the distance to the next one is its
difference and a candidate period; the names of blocks then extend it to both sides, exactly.

Why nothing is missed: a run of period q and four periods holds a block of L words, q <= L < 2q, on the grid of :func:`step`, and that block again q words
on. Were there an occurrence between, all would be steps of one progression, so its difference would divide q and be a period of the block, which holds a
whole period of the run; then q would not be the smallest. The same shows that a candidate is the smallest period of the run it extends to.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A run has at least this many words and this many periods.
LEAST, PERIODS = 6, 4
#: Words of the texts that share a suffix array; a longer text has its own.
AT_ONCE = 1 << 17


def step(length: int) -> int:
    """How far apart blocks of ``length`` words start: a run of four periods q (at least six words), length < 2q, holds a block and its shift by q."""
    return 4 if length == 2 else length // 2 + 4


def names(seq: np.ndarray, levels: int) -> tuple[list[np.ndarray], np.ndarray]:
    """For k = 0 .. levels the name of the 2^k words at each place, and the suffix array; a name is the first row of its range in that array."""
    n = seq.size
    out, key = [], seq.astype(np.int64)
    for k in range(levels + 1):
        if k:
            far = np.zeros(n, dtype=np.int64)
            half = 1 << (k - 1)
            far[: max(n - half, 0)] = out[-1][half:].astype(np.int64) + 1
            key = out[-1].astype(np.int64) * (n + 1) + far
        order = np.argsort(key, kind="stable")
        sorted_ = key[order]
        new = np.r_[True, sorted_[1:] != sorted_[:-1]]
        first = np.maximum.accumulate(np.where(new, np.arange(n), 0))
        name = np.empty(n, dtype=np.int32)
        name[order] = first
        out.append(name)
    return out, order


class Wavelet:
    """Wavelet matrix over numbers below their count."""

    def __init__(self, values: np.ndarray) -> None:
        self.bits = max(1, int(values.size).bit_length())
        self.before: list[np.ndarray] = []
        for b in range(self.bits - 1, -1, -1):
            low = ((values >> b) & 1) == 0
            self.before.append(np.r_[0, np.cumsum(low)].astype(np.int32))
            values = np.r_[values[low], values[~low]]

    def successor(self, lo: np.ndarray, hi: np.ndarray, above: np.ndarray) -> np.ndarray:
        """The smallest value above ``above`` among rows lo .. hi - 1 for each query, -1 where there is none."""
        x, size = above + 1, hi - lo
        a, b, less = lo, hi, np.zeros(lo.size, dtype=np.int64)
        for k, zeros in enumerate(self.before):
            one = ((x >> (self.bits - 1 - k)) & 1) == 1
            za, zb = zeros[a], zeros[b]
            less += np.where(one, zb - za, 0)
            a, b = np.where(one, zeros[-1] + a - za, za), np.where(one, zeros[-1] + b - zb, zb)
        found = less < size
        a, b, rank = lo[found], hi[found], less[found]
        value = np.zeros(a.size, dtype=np.int64)
        for k, zeros in enumerate(self.before):
            za, zb = zeros[a], zeros[b]
            one = rank >= zb - za
            rank = np.where(one, rank - (zb - za), rank)
            a, b = np.where(one, zeros[-1] + a - za, za), np.where(one, zeros[-1] + b - zb, zb)
            value |= one.astype(np.int64) << (self.bits - 1 - k)
        out = np.full(lo.size, -1, dtype=np.int64)
        out[found] = value
        return out


def _extend(name: list[np.ndarray], x: np.ndarray, y: np.ndarray, back: bool) -> np.ndarray:
    """How many words agree from x and y > x on, or before them where ``back``."""
    n, got = name[0].size, np.zeros(x.size, dtype=np.int64)
    for k in range(len(name) - 1, -1, -1):
        size = 1 << k
        live = np.arange(x.size)
        while live.size:
            p = x[live] - got[live] - size if back else x[live] + got[live]
            q = y[live] - got[live] - size if back else y[live] + got[live]
            inside = (p >= 0) & (q + size <= n)
            live, p, q = live[inside], p[inside], q[inside]
            live = live[name[k][p] == name[k][q]]
            got[live] += size
            if k < len(name) - 1:
                break
    return got


def runs(seq: np.ndarray, longest: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, length, period) of all runs of ``seq`` by start and period; ``longest`` is the size of its longest text."""
    none = np.zeros(0, dtype=np.int64)
    if longest < LEAST:
        return none, none, none
    # The longest period asked for is a quarter of a text, its block less than twice as long.
    levels = max(1, (longest // PERIODS - 1).bit_length())
    name, suffixes = names(seq, levels)
    tree = Wavelet(suffixes)
    at, period = [none], [none]
    for k in range(1, levels + 1):
        length = 1 << k
        s = np.arange(0, seq.size, step(length), dtype=np.int64)
        many = np.bincount(name[k], minlength=seq.size)
        lo = name[k][s].astype(np.int64)
        again = many[lo] > 1
        s, lo = s[again], lo[again]
        d = tree.successor(lo, lo + many[lo], s) - s
        near = (d > 0) & (d <= length)
        at.append(s[near])
        period.append(d[near])
    x, q = np.concatenate(at), np.concatenate(period)
    left = _extend(name, x, x + q, back=True)
    start, size = x - left, left + q + _extend(name, x, x + q, back=False)
    held = size >= np.maximum(LEAST, PERIODS * q)
    found = np.unique(np.stack([start[held], q[held], size[held]], axis=1), axis=0)
    return found[:, 0], found[:, 2], found[:, 1]


def repeated_tail(n: int, doc_id: int | None) -> np.ndarray | None:
    """Which original word stands at each place of a text whose tail is made periodic (one id in ten); None where the text stays as it is."""
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 or not n:
        return None
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    place = np.arange(n)
    return np.where(place >= a, a + (place - a) % p, place)


def _rows(texts: list[tuple[int | None, list[bytes]]], planted: bool) -> Iterator[tuple]:
    """One result row for each (doc_id, words)."""
    sizes = np.array([len(w) for _, w in texts], dtype=np.int64)
    flat = pa.array([w for _, words in texts for w in words], pa.binary()).dictionary_encode()
    numbers = flat.indices.to_numpy().astype(np.int64)
    ends = np.cumsum(sizes)
    seq = np.empty(int(ends[-1]) + len(texts), dtype=np.int64)
    begin = ends - sizes + np.arange(len(texts))
    order: list[np.ndarray | None] = []
    for k, (doc_id, _) in enumerate(texts):
        own = numbers[ends[k] - sizes[k] : ends[k]]
        order.append(repeated_tail(int(sizes[k]), doc_id) if planted else None)
        seq[begin[k] : begin[k] + sizes[k]] = own if order[k] is None else own[order[k]]
        seq[begin[k] + sizes[k]] = len(flat.dictionary) + k
    start, length, period = runs(seq, int(sizes.max()))
    of = np.searchsorted(begin, start, "right") - 1
    bounds = np.searchsorted(of, np.arange(len(texts) + 1))
    for k, (doc_id, words) in enumerate(texts):
        if order[k] is not None:
            words = [words[i] for i in order[k]]
        rows = slice(bounds[k], bounds[k + 1])
        found = list(zip((start[rows] - begin[k]).tolist(), length[rows].tolist(), period[rows].tolist(), strict=True))
        best: tuple[int, int, int] | None = None
        drop = np.zeros(len(words) + 1, dtype=np.int64)
        for s, n, q in found:
            # By start and period, so that the first of equals stays.
            if best is None or n * best[2] > best[1] * q:
                best = (s, n, q)
            drop[s + q] += 1
            drop[s + n] -= 1
        if found:
            words = [words[i] for i in np.flatnonzero(np.cumsum(drop[:-1]) == 0)]
        yield doc_id, len(drop) - 1, found, best, b" ".join(words)


SCHEMA = "n_words long, runs array<struct<start:bigint,length:bigint,period:bigint>>, best struct<start:bigint,length:bigint,period:bigint>, collapsed string"


def find(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", planted: bool = False) -> DataFrame:
    """(doc_id, n_words, runs, best, collapsed) of each row: its runs by start and period, the one of the greatest exponent (then smallest start
    and period; null without runs), and the words without those that repeat an earlier period of a run.

    Rows are handled in place: nothing is shuffled, a task holds the suffix array of one batch of texts or of one longer text, some 40 numbers of 32 bits for
    each word. ``planted`` makes the tails of one id in ten periodic first (:func:`repeated_tail`). Null and empty texts have no words and no runs; a row
    without id is as any other, but its tail stays; repeated rows stay repeated; other columns are ignored; an empty table gives no rows.
    """
    kind = docs.schema[doc_id].dataType.simpleString()

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        run = pa.struct([(c, pa.int64()) for c in ("start", "length", "period")])
        as_run = lambda r: dict(zip(("start", "length", "period"), r, strict=True))

        def table(texts: list, id_type: pa.DataType) -> pa.RecordBatch:
            ids, n, found, best, left = zip(*_rows(texts, planted), strict=True)
            cols = [pa.array(ids, id_type), pa.array(n, pa.int64()), pa.array([[as_run(r) for r in f] for f in found], pa.list_(run)), pa.array([b and as_run(b) for b in best], run), pa.array(left, pa.binary()).cast(pa.string())]
            return pa.RecordBatch.from_arrays(cols, ["doc_id", "n_words", "runs", "best", "collapsed"])

        for batch in batches:
            held, size = [], 0
            for key, said in zip(batch.column(0), batch.column(1).cast(pa.binary()), strict=True):
                words = (said.as_py() or b"").split()
                if held and size + len(words) > AT_ONCE:
                    yield table(held, batch.schema.field(0).type)
                    held, size = [], 0
                held.append((key.as_py(), words))
                size += len(words) + 1
            if held:
                yield table(held, batch.schema.field(0).type)

    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).mapInArrow(each, f"doc_id {kind}, {SCHEMA}")


def digest(found: DataFrame) -> DataFrame:
    """One line for each row of :func:`find`: the best run and hashes of all runs and of the collapsed text."""
    line = lambda r: F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string"))
    listed = F.concat(F.lit(""), F.array_join(F.transform("runs", lambda r: F.concat(line(r), F.lit("\n"))), ""))
    return found.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        F.col("best.start").alias("start"),
        F.col("best.length").alias("length"),
        F.col("best.period").alias("period"),
        F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(listed, 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
