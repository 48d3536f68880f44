"""Near-duplicate embeddings by cross-polytope hashing.

A hash of a unit vector is the nearest of the 2d signed axes after a random rotation, which is three rounds of random signs and a fast
Hadamard transform. A table's bucket is named by a few such hashes. Every vector resides in its bucket of each table and visits the
next likeliest ones (those whose axes are least farther); residents are compared with visitors by the exact cosine.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barloom.session import materialize

from .components import components
from .groups import merged, pairs, starts, whole_groups

COSINE, TABLES, HASHES, PROBES, SEED = 0.93, 5, 2, 6, 11
AXES = 4  # nearest axes of a hash that probes choose among
AT_ONCE = 1 << 22  # components of vectors that are compared at once
SALTS = 32


def hadamard(x: np.ndarray) -> np.ndarray:
    """Fast Walsh-Hadamard transform of each row, scaled to keep lengths."""
    n, d = x.shape
    h = 1
    while h < d:
        y = x.reshape(n, d // (2 * h), 2, h)
        x = np.stack([y[:, :, 0] + y[:, :, 1], y[:, :, 0] - y[:, :, 1]], axis=2).reshape(n, d)
        h *= 2
    return x / np.sqrt(d)


def codes(unit: np.ndarray) -> np.ndarray:
    """(rows, tables, probes) bucket numbers; the first probe is where the vector resides."""
    n, dim = unit.shape
    d = 1 << max(1, (dim - 1).bit_length())
    x = np.zeros((n, d))
    x[:, :dim] = unit
    signs = np.random.default_rng([SEED, d]).choice([-1.0, 1.0], size=(TABLES, HASHES, 3, d))
    out = np.empty((n, TABLES, PROBES), dtype=np.int64)
    axes = min(AXES, d)
    for t in range(TABLES):
        number, loss = np.zeros((n, 1), dtype=np.int64), np.zeros((n, 1))
        for h in range(HASHES):
            y = x
            for s in signs[t, h]:
                y = hadamard(y * s)
            near = np.argsort(-np.abs(y), axis=1, kind="stable")[:, :axes]
            value = np.take_along_axis(y, near, axis=1)
            far = (np.abs(value[:, :1]) - np.abs(value)) ** 2
            number = (number[:, :, None] * (2 * d) + (2 * near + (value > 0))[:, None, :]).reshape(n, -1)
            loss = (loss[:, :, None] + far[:, None, :]).reshape(n, -1)
        best = np.argsort(loss, axis=1, kind="stable")
        best = best[:, np.arange(PROBES) % best.shape[1]]  # of very few dimensions there are fewer, so they repeat
        out[:, t] = np.take_along_axis(number, best, axis=1)
    return out


def _units(packed: list[bytes], kind: str) -> tuple[np.ndarray, np.ndarray]:
    v = np.frombuffer(b"".join(packed), dtype=kind).reshape(len(packed), -1).astype(np.float64)
    return v, np.sqrt(np.einsum("ij,ij->i", v, v))


def _able() -> Column:
    """Whether a row of (lab, vector) can link: null labels, null vectors, null or non-finite components and zero vectors can't."""
    finite = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(F.col("label").isNotNull() & F.col("vector").isNotNull() & finite & F.exists("vector", lambda x: x != 0), F.lit(False))


def links(points: DataFrame, cosine: float = COSINE) -> DataFrame:
    """(node, links, root) rows: for a vector, copies of others linked to it, and a smaller or equal one that it is connected with.

    ``points`` (node, copies, lab, vector) are distinct in (lab, vector). A pair is counted at the first table, and there at the smaller
    bucket, in which it meets, so sums over rows are exact for every pair that meets at all. A task holds one bucket; pairs are formed
    some at a time and never leave it.
    """
    numeric = "f4" if isinstance(points.schema["vector"].dataType.elementType, T.FloatType) else "f8"

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for first in range(0, whole.num_rows, 2048):
                batch = whole.slice(first, 2048)
                size = np.array([len(v) for v in batch.column(3)])
                for dim in np.unique(size):
                    rows = batch.filter(pa.array(size == dim))
                    v = np.stack([np.asarray(x, dtype=numeric) for x in rows.column(3).to_pylist()])
                    length = np.sqrt(np.einsum("ij,ij->i", v.astype(np.float64), v.astype(np.float64)))
                    of = codes(v / length[:, None])
                    bucket = (int(dim) << 40) + (np.arange(TABLES, dtype=np.int64)[None, :, None] << 32) + of
                    new = np.ones(of.shape, dtype=bool)
                    for k in range(1, PROBES):
                        new[:, :, k] = (of[:, :, :k] != of[:, :, k : k + 1]).all(axis=2)
                    new = np.flatnonzero(new)
                    at = pa.array(new // (TABLES * PROBES))
                    packed = [pa.array([x.tobytes() for x in what], pa.binary()).take(at) for what in (v, of)]
                    yield pa.RecordBatch.from_arrays([rows.column(2).take(at), pa.array(bucket.reshape(-1)[new]), rows.column(0).take(at), rows.column(1).take(at), *packed], ["lab", "bucket", "node", "copies", "v", "of"])

    def met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in whole_groups(batches, 2):
            lab, bucket, node, copies = (rows.column(k).to_numpy() for k in range(4))
            dims = bucket >> 40
            for dim in np.unique(dims):
                of_dim = np.flatnonzero(dims == dim)
                part = rows.take(pa.array(of_dim))
                yield from compared(lab[of_dim], bucket[of_dim], node[of_dim], copies[of_dim], part.column(4).to_pylist(), part.column(5).to_pylist())

    def compared(lab, bucket, node, copies, packed, packed_codes):
        v, length = _units(packed, numeric)
        of = np.frombuffer(b"".join(packed_codes), dtype=np.int64).reshape(len(packed), TABLES, PROBES)
        table, code = (bucket >> 32) & 255, bucket & 0xFFFFFFFF
        resident = of[np.arange(len(v)), table, 0] == code
        start, size = starts(lab, bucket)
        for x, y in pairs(start, size, np.flatnonzero(resident), max(1, AT_ONCE // v.shape[1])):
            near = (np.einsum("ij,ij->i", v[x], v[y]) >= cosine * length[x] * length[y]) & (node[x] != node[y])
            x, y = x[near], y[near]
            if not x.size:
                continue
            home_x, home_y, t = of[x, :, 0], of[y, :, 0], table[x]
            at_x, at_y = (of[y] == home_x[:, :, None]).any(axis=2), (of[x] == home_y[:, :, None]).any(axis=2)
            k = np.arange(x.size)
            first = (np.argmax(at_x | at_y, axis=1) == t) & ~(at_y[k, t] & (home_y[k, t] < home_x[k, t]))
            visitor = first & (home_y[k, t] != home_x[k, t])
            to, inverse = np.unique(np.r_[node[x], node[y]], return_inverse=True)
            a, b = inverse[: x.size], inverse[x.size :]
            n = np.bincount(a[first], copies[y[first]], to.size) + np.bincount(b[visitor], copies[x[visitor]], to.size)
            yield pa.RecordBatch.from_arrays([pa.array(to), pa.array(n.astype(np.int64)), pa.array(to[merged(a, b, to.size)])], ["node", "links", "root"])

    spread = points.select("node", "copies", "lab", "vector").mapInArrow(hashed, "lab bigint, bucket bigint, node bigint, copies bigint, v binary, of binary")
    return spread.repartition("lab", "bucket").sortWithinPartitions("lab", "bucket").mapInArrow(met, "node bigint, links bigint, root bigint")


def _named(of: DataFrame, names: DataFrame) -> DataFrame:
    """Adds each component's name (node, component, name). The names of components are copied for a few salts, so that a large component isn't one task."""
    roots = of.where("node = component").select("component").join(names.withColumnRenamed("node", "component"), "component")
    roots = roots.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))).select("component", "name", F.col("salt").cast("long").alias("salt"))
    return of.withColumn("salt", F.pmod(F.xxhash64("node"), F.lit(SALTS))).join(roots, ["component", "salt"]).select("node", "component", "name")


def near_duplicates(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", label: str = "label", cosine: float = COSINE) -> DataFrame:
    """(vec_id, n_links, component_id) of each row, for vectors of equal labels; ``vec_id`` is a whole number.

    Equal vectors of a label are one point with a number of copies, however many rows share it; points are numbered in the order of their smallest id.
    Rows that can't link stand alone. Repeated rows are vectors of their own, also where ids repeat or are null; a null id is no smallest id unless the
    component has no other. Other columns are ignored; an empty table gives no rows.
    """
    rows = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(embedding).alias("vector"), F.col(label).alias("label"))
    lab = F.col("label").cast("long") if isinstance(rows.schema["label"].dataType, T.IntegralType) else F.xxhash64("label")
    good = rows.where(_able()).select("vec_id", lab.alias("lab"), "vector", F.xxhash64(F.lit(1), "vector").alias("a"), F.xxhash64(F.lit(2), "vector").alias("b"))
    points = good.groupBy("lab", "a", "b").agg(F.min("vec_id").alias("name"), F.count(F.lit(1)).alias("copies"), F.first("vector").alias("vector"))
    order = [F.asc_nulls_last("name"), F.asc("a")]
    points = materialize(points.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("node", F.monotonically_increasing_id()), "vectors")
    found = materialize(links(points, cosine).groupBy("node", "root").agg(F.sum("links").alias("links")), "links")
    count = found.groupBy("node").agg(F.sum("links").alias("links"))
    of = _named(components(found.select(F.col("node").alias("a"), F.col("root").alias("b"))), points.select("node", "name"))
    point = points.select("lab", "a", "b", "node", "copies", F.col("name").alias("own")).join(count, "node", "left").join(of, "node", "left")
    name = F.when(F.col("component").isNull(), F.col("own")).otherwise(F.col("name"))
    point = point.select("lab", "a", "b", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), name.alias("component_id"))
    linked = good.select("vec_id", "lab", "a", "b").join(point, ["lab", "a", "b"]).select("vec_id", "n_links", "component_id")
    return linked.union(rows.where(~_able()).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id")))
