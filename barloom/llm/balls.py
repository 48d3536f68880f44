"""Ranked lexical search as an exact inner-product search in ball trees.

A document is a sparse vector over the terms that the queries ask for: an integer impact for each. A query is the sum of its terms, so a score is an inner
product. Documents are dealt by the nearest of some pivots and sorted by them; each task cuts its sorted rows into chunks of bounded size
and builds a ball tree over each: a node is a centroid and the radius around it. No document below a node scores more than the product of query and
centroid and, on top, the radius times the query's length (Cauchy and Schwarz). Nodes are visited best first; one whose bound, rounded up by more than
its error, is below the tenth score so far is left out with all below it. Leaves are scored in integers.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barloom.session import materialize

#: Documents in a leaf; documents and vector entries in a tree.
LEAF, CHUNK, ENTRIES = 32, 4096, 1 << 20
#: Documents (some by their hashes) among which pivots are chosen and first thresholds are found, and how many pivots. Results don't depend on them.
SAMPLE, PIVOTS = 4096, 64
#: Vector entries that meet the pivots at once.
AT_ONCE = 1 << 15
#: Bytes of query text and queries that one pass over the documents answers, on average; more queries take more passes.
BLOCK_BYTES, BLOCK_ITEMS = 8 << 20, 1024
#: Relative error allowed to a bound; sums of n doubles err by less than n * 2^-53.
SLACK = 1e-6

_WORDS = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))


def terms_of(text: str | None) -> list[bytes]:
    """Maximal runs of ASCII letters and digits and of all other characters outside ASCII, with small letters for A to Z."""
    return (text or "").encode().translate(_WORDS).split()


@dataclass(frozen=True)
class Sparse:
    """Rows of (column, value); row i has entries ptr[i] .. ptr[i + 1] - 1."""

    ptr: np.ndarray
    cols: np.ndarray
    vals: np.ndarray

    @staticmethod
    def of(rows: list[tuple[np.ndarray, np.ndarray]]) -> Sparse:
        ptr = np.r_[0, np.cumsum([c.size for c, _ in rows])].astype(np.int64)
        none = [np.zeros(0, dtype=np.int64)]
        return Sparse(ptr, np.concatenate([c for c, _ in rows] or none), np.concatenate([v for _, v in rows] or none))

    def __len__(self) -> int:
        return self.ptr.size - 1

    def sizes(self) -> np.ndarray:
        return np.diff(self.ptr)

    def take(self, rows: np.ndarray) -> Sparse:
        size = self.sizes()[rows]
        ptr = np.r_[0, np.cumsum(size)]
        at = np.repeat(self.ptr[rows] - ptr[:-1], size) + np.arange(ptr[-1])
        return Sparse(ptr, self.cols[at], self.vals[at])

    def slice(self, a: int, b: int) -> Sparse:
        p, q = self.ptr[a], self.ptr[b]
        return Sparse(self.ptr[a : b + 1] - p, self.cols[p:q], self.vals[p:q])

    def by_column(self, width: int) -> Sparse:
        """The transposed rows."""
        order = np.argsort(self.cols, kind="stable")
        ptr = np.r_[0, np.cumsum(np.bincount(self.cols, minlength=width))].astype(np.int64)
        return Sparse(ptr, np.repeat(np.arange(len(self)), self.sizes())[order], self.vals[order])

    def times(self, other: Sparse, width: int) -> np.ndarray:
        """Dense product (rows, width) with ``other``, whose rows are these columns; integers stay exact integers."""
        size = other.sizes()[self.cols]
        ends = np.cumsum(size)
        at = np.repeat(other.ptr[self.cols] - ends + size, size) + np.arange(ends[-1] if size.size else 0)
        row = np.repeat(np.repeat(np.arange(len(self)), self.sizes()), size)
        product = np.repeat(self.vals, size) * other.vals[at]
        place = row * width + other.cols[at]
        if product.dtype == np.float64:
            return np.bincount(place, product, len(self) * width).reshape(len(self), width)
        out = np.zeros(len(self) * width, dtype=np.int64)
        np.add.at(out, place, product)
        return out.reshape(len(self), width)

    def squares(self) -> np.ndarray:
        return self.row_sums(self.vals.astype(np.float64) ** 2)

    def row_sums(self, vals: np.ndarray) -> np.ndarray:
        return np.bincount(np.repeat(np.arange(len(self)), self.sizes()), vals, len(self))


@dataclass
class Node:
    centre: Sparse
    radius: float
    first: int
    last: int
    below: tuple[Node, ...] = ()


def build(x: Sparse, width: int) -> tuple[Node, Sparse, np.ndarray]:
    """The ball tree over the rows, the rows in the order of its leaves, and their old numbers."""
    order = np.arange(len(x))
    room = np.zeros(width)

    def far_from(rows: Sparse, squares: np.ndarray, cols: np.ndarray, vals: np.ndarray) -> np.ndarray:
        """Distances of the rows from one vector, rounded up."""
        room[cols] = vals
        dot = rows.row_sums(rows.vals * room[rows.cols])
        room[cols] = 0
        own = float(vals @ vals)
        return np.sqrt(np.maximum(squares - 2 * dot + own, 0) + SLACK * (squares + own))

    def grow(rows: Sparse, mine: np.ndarray, first: int) -> Node:
        n, squares = len(rows), rows.squares()
        cols, place = np.unique(rows.cols, return_inverse=True)
        mean = np.bincount(place, rows.vals, cols.size) / n
        away = far_from(rows, squares, cols, mean)
        node = Node(Sparse(np.array([0, cols.size]), cols, mean), float(away.max()), first, first + n)
        order[first : first + n] = mine
        if n <= LEAF:
            return node
        pole = rows.slice(int(away.argmax()), int(away.argmax()) + 1)
        a = far_from(rows, squares, pole.cols, pole.vals.astype(np.float64))
        pole = rows.slice(int(a.argmax()), int(a.argmax()) + 1)
        b = far_from(rows, squares, pole.cols, pole.vals.astype(np.float64))
        left = a <= b
        if left.all() or not left.any():
            left = np.arange(n) < n // 2
        # A side of a few rows would make a chain; then the median of the difference divides.
        elif min(left.sum(), n - left.sum()) * 16 < n:
            left = np.argsort(np.argsort(a - b, kind="stable"), kind="stable") < n // 2
        some, rest = np.flatnonzero(left), np.flatnonzero(~left)
        node.below = (grow(rows.take(some), mine[some], first), grow(rows.take(rest), mine[rest], first + some.size))
        return node

    root = grow(x, order.copy(), 0)
    return root, x.take(order), order


class Best:
    """For each query the ``k`` best (score, row key) so far; equal scores by the smaller key."""

    def __init__(self, queries: int, k: int, floor: np.ndarray) -> None:
        self.k, self.floor = k, floor.astype(np.int64)
        self.rows: list[list[tuple[int, tuple]]] = [[] for _ in range(queries)]

    def due(self, q: int) -> int:
        """A row below this score can't be in the result."""
        kept = self.rows[q]
        return max(int(self.floor[q]), kept[-1][0] if len(kept) == self.k else 1)

    def add(self, q: int, found: list[tuple[int, tuple]]) -> None:
        self.rows[q] = sorted(self.rows[q] + found, key=lambda r: (-r[0], r[1]))[: self.k]


def search(x: Sparse, keys: list[tuple], queries: Sparse, best: Best, width: int) -> int:
    """Visit the tree over the rows for every query, best node first; how many leaves were scored."""
    root, x, order = build(x, width)
    asked, count = queries.by_column(width), len(queries)
    lengths = np.sqrt(queries.sizes())
    bounds: dict[int, np.ndarray] = {}
    scores: dict[int, np.ndarray] = {}

    def bound(node: Node) -> np.ndarray:
        if id(node) not in bounds:
            dot = node.centre.times(Sparse(asked.ptr, asked.cols, asked.vals.astype(np.float64)), count)[0]
            bounds[id(node)] = (dot + lengths * node.radius) * (1 + SLACK) + 1
        return bounds[id(node)]

    for q in range(count):
        if not queries.ptr[q + 1] - queries.ptr[q]:
            continue
        heap = [(-bound(root)[q], 0, root)]
        pushed = 1
        while heap:
            top, _, node = heapq.heappop(heap)
            if -top < best.due(q):
                break
            if node.below:
                for child in node.below:
                    if (high := bound(child)[q]) >= best.due(q):
                        heapq.heappush(heap, (-high, pushed, child))
                        pushed += 1
                continue
            if id(node) not in scores:
                scores[id(node)] = x.slice(node.first, node.last).times(asked, count)
            mine = scores[id(node)][:, q]
            hits = np.flatnonzero(mine >= best.due(q))
            best.add(q, [(int(mine[i]), keys[order[node.first + i]]) for i in hits])
    return len(scores)


def _features(docs: DataFrame, vocabulary, kind: str) -> DataFrame:
    """(doc_id, n, terms, tfs): the number of all terms of a row, and those that are asked for with their counts, by number."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = vocabulary.value
        for batch in batches:
            size, ptr, terms, tfs = [], [0], [], []
            for said in batch.column(1):
                words = terms_of(said.as_py())
                held: dict[int, int] = {}
                for t in map(number.get, words):
                    if t is not None:
                        held[t] = held.get(t, 0) + 1
                size.append(len(words))
                terms.extend(held)
                tfs.extend(held.values())
                ptr.append(len(terms))
            lists = lambda v, t: pa.ListArray.from_arrays(pa.array(ptr, pa.int32()), pa.array(v, t))  # noqa: E731, B023
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(size, pa.int64()), lists(terms, pa.int32()), lists(tfs, pa.int64())], ["doc_id", "n", "terms", "tfs"])

    return docs.mapInArrow(each, f"doc_id {kind}, n bigint, terms array<int>, tfs array<bigint>")


def _sparse(batch: pa.RecordBatch, terms: str, vals: str) -> Sparse:
    t, v = batch.column(terms), batch.column(vals)
    size = t.value_lengths().to_numpy(zero_copy_only=False)
    return Sparse(np.r_[0, np.cumsum(size)].astype(np.int64), t.flatten().to_numpy().astype(np.int64), v.flatten().to_numpy().astype(np.int64))


def impacts(n: np.ndarray, tf: Sparse, weight: np.ndarray, docs: int, length: int) -> Sparse:
    """Each entry's part of a score: w * (10^9 tf div (1000 tf + 8 m)), m = 10 + (90 n N) div L; entries without weight go."""
    m = np.array([10 + 90 * int(k) * docs // length for k in n], dtype=np.int64)
    part = weight[tf.cols] * ((1_000_000_000 * tf.vals) // (1000 * tf.vals + 8 * np.repeat(m, tf.sizes())))
    held = part > 0
    ptr = np.r_[0, np.cumsum(held)][tf.ptr]
    return Sparse(ptr, tf.cols[held], part[held])


def _pivots(x: Sparse, width: int) -> Sparse:
    """Rows far from each other: each next one is the farthest from those before."""
    squares, near, chosen = x.squares(), None, [int(x.squares().argmin())]
    room = np.zeros(width)
    while True:
        p = x.slice(chosen[-1], chosen[-1] + 1)
        room[p.cols] = p.vals
        away = squares - 2 * x.row_sums(x.vals * room[x.cols]) + squares[chosen[-1]]
        room[p.cols] = 0
        near = away if near is None else np.minimum(near, away)
        if len(chosen) == PIVOTS or near.max() <= SLACK * squares.max():
            return x.take(np.array(chosen))
        chosen.append(int(near.argmax()))


def _block(docs: DataFrame, items: list, k: int, kinds: tuple[str, str]) -> DataFrame:
    """(item_id, item, doc_id, score): the candidates of each item of a block, ``k`` at most from each task."""
    spark = docs.sparkSession
    wanted = [sorted(set(terms_of(i.text))) for i in items]
    number = {t: j for j, t in enumerate(sorted({t for w in wanted for t in w}))}
    width, count = len(number), len(items)
    queries = Sparse.of([(np.array([number[t] for t in w], dtype=np.int64), np.ones(len(w), dtype=np.int64)) for w in wanted])
    rows = materialize(_features(docs, spark.sparkContext.broadcast(number), kinds[0]), "features")
    n_docs, length, met = rows.where("n > 0").agg(F.count(F.lit(1)), F.sum("n"), F.count_if(F.size("terms") > 0)).first()
    schema = f"item int, doc_id {kinds[0]}, score bigint"
    if not n_docs or not width:
        return spark.createDataFrame([], schema)
    weight = np.zeros(width, dtype=np.int64)
    for t, df in rows.select(F.explode("terms").alias("t")).groupBy("t").agg(F.count(F.lit(1)).alias("df")).toLocalIterator():
        weight[t] = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))
    rows = rows.where(F.size("terms") > 0)
    sample = pa.Table.from_pylist([r.asDict() for r in rows.where(F.pmod(F.xxhash64("doc_id", "n", "terms", "tfs"), F.lit(max(met, 1))) < SAMPLE).limit(SAMPLE).select("n", "terms", "tfs").collect()], pa.schema([("n", pa.int64()), ("terms", pa.list_(pa.int64())), ("tfs", pa.list_(pa.int64()))]))
    sample = sample.combine_chunks().to_batches()
    floor, near = np.zeros(count, dtype=np.int64), Sparse.of([(np.zeros(0, dtype=np.int64),) * 2])
    if sample:
        some = impacts(sample[0].column("n").to_numpy(), _sparse(sample[0], "terms", "tfs"), weight, n_docs, length)
        near = _pivots(some, width)
        if len(some) >= k:
            asked = queries.by_column(width)
            parts = [some.slice(a, min(a + LEAF, len(some))).times(asked, count) for a in range(0, len(some), LEAF)]
            floor = np.partition(np.concatenate(parts), len(some) - k, axis=0)[len(some) - k]
    shared = spark.sparkContext.broadcast((weight, near, queries, floor))

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weight, near, *_ = shared.value
        by_term, own = near.by_column(weight.size), near.squares()
        for batch in batches:
            x = impacts(batch.column("n").to_numpy(), _sparse(batch, "terms", "tfs"), weight, n_docs, length)
            pivot, a = np.empty(len(x), dtype=np.int32), 0
            while a < len(x):
                b = max(a + 1, int(np.searchsorted(x.ptr, x.ptr[a] + AT_ONCE, "right")) - 1)
                pivot[a:b] = (own - 2.0 * x.slice(a, b).times(by_term, own.size)).argmin(axis=1)
                a = b
            lists = lambda v, t: pa.ListArray.from_arrays(pa.array(x.ptr, pa.int32()), pa.array(v, t))  # noqa: E731, B023
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(pivot), lists(x.cols, pa.int32()), lists(x.vals, pa.int64())], ["doc_id", "pivot", "terms", "parts"])

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weight, _, queries, floor = shared.value
        best = Best(len(queries), k, floor)
        held: list[pa.RecordBatch] = []
        kind = None

        def visit() -> None:
            t = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            ids = t.column("doc_id").to_pylist()
            search(_sparse(t, "terms", "parts"), [(d is None, d if d is not None else 0) for d in ids], queries, best, weight.size)

        rows = entries = 0
        for batch in batches:
            kind = batch.schema.field("doc_id").type
            ends = np.cumsum(batch.column("terms").value_lengths().to_numpy(zero_copy_only=False))
            at = 0
            while at < batch.num_rows:
                before = int(ends[at - 1]) if at else 0
                to = min(at + CHUNK - rows, max(at + 1, int(np.searchsorted(ends, before + ENTRIES - entries, "right"))))
                held.append(batch.slice(at, to - at))
                rows, entries, at = rows + to - at, entries + int(ends[to - 1]) - before, to
                if rows >= CHUNK or entries >= ENTRIES:
                    visit()
                    held, rows, entries = [], 0, 0
        if held:
            visit()
        out = [(q, key[1] if not key[0] else None, score) for q, some in enumerate(best.rows) for score, key in some]
        if out:
            item, doc, score = zip(*out, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(item, pa.int32()), pa.array(doc, kind), pa.array(score, pa.int64())], ["item", "doc_id", "score"])

    parts = materialize(rows.mapInArrow(dealt, f"doc_id {kinds[0]}, pivot int, terms array<int>, parts array<bigint>"), "impacts").where(F.size("terms") > 0)
    tasks = 1 + n_docs // (4 * CHUNK)
    # Rows of a large pivot are spread by hash; a range holds neighbours.
    parts = parts.repartitionByRange(tasks, "pivot", F.xxhash64("doc_id", "terms")).sortWithinPartitions("pivot")
    return parts.mapInArrow(found, schema)


def top(docs: DataFrame, items: DataFrame, k: int = 10, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """(item_id, rank, doc_id, score): the ``k`` rows of ``docs`` with the highest scores above 0 for each row of ``items``; equal scores by doc_id, null last.

    A term counts once for an item. Rows without terms (null or empty texts) are in no result and don't count; repeated documents are ranked each by
    itself, repeated items answered each by itself. Items are answered in blocks of some
    ``BLOCK_BYTES`` of text and ``BLOCK_ITEMS`` items, by one pass over the documents each; what is broadcast is a block's terms and items. Other columns are ignored; empty tables give no rows.
    """
    spark = docs.sparkSession
    kinds = (docs.schema[doc_id].dataType.simpleString(), items.schema[item_id].dataType.simpleString())
    docs = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    asked = items.select(F.col(item_id).alias("item_id"), F.col(item_text).alias("text"))
    size, count = asked.agg(F.sum(F.octet_length("text")), F.count(F.lit(1))).first()
    blocks = 1 + max((size or 0) // BLOCK_BYTES, count // BLOCK_ITEMS)
    out = None
    for b in range(blocks):
        mine = asked.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b).collect()
        if not mine:
            continue
        names = spark.createDataFrame([(j, i.item_id) for j, i in enumerate(mine)], f"item int, item_id {kinds[1]}")
        got = _block(docs, mine, k, kinds)
        order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
        got = got.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).join(F.broadcast(names), "item").select("item_id", "rank", "doc_id", "score")
        out = got if out is None else out.union(got)
    return out if out is not None else spark.createDataFrame([], f"item_id {kinds[1]}, rank int, doc_id {kinds[0]}, score bigint")
