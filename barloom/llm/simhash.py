"""Near-duplicates by SimHash fingerprints that meet at the anchors of a covering code.

The 64 bits fall into blocks with thresholds of their own: if two fingerprints differ in at most ``THRESHOLD`` bits, in some block
they differ in at most that block's threshold, as the thresholds plus one sum to more. In a block, anchors are the words of a
covering code: a Hamming code on the first fifteen bits (radius 1, perfect) and all words on the others (radius 0). Every point
has one nearest anchor, its home. A fingerprint visits every anchor that is the home of a point within the threshold, that is, all
within covering radius plus threshold that can matter; at an anchor, residents are compared with visitors.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.session import materialize

from .components import components
from .groups import pairs, starts, whole_groups

THRESHOLD = 4
SHINGLE = 4
#: (first bit, bits, threshold) of each block.
BLOCKS = ((0, 21, 1), (21, 21, 1), (42, 22, 0))
#: Pairs compared at once, and the shingles of one text whose bits are summed at once.
AT_ONCE, SHINGLES_AT_ONCE = 1 << 20, 1 << 16


def fingerprint(text: str | None, words: int = SHINGLE) -> int:
    """SimHash of the text's word shingles (XXH64, seed 42), as a signed long; A-Z count as a-z; no words: zero."""
    w = (text or "").encode().lower().split()
    if not w:
        return 0
    if len(w) < words:
        h = [xxhash.xxh64_intdigest(b" ".join(w), 42)]
    else:
        digest = xxhash.xxh64_intdigest
        h = [digest(b" ".join(s), 42) for s in zip(*[w[k:] for k in range(words)], strict=False)]
    bits = np.zeros(64, dtype=np.int64)
    for k in range(0, len(h), SHINGLES_AT_ONCE):
        bits += np.unpackbits(np.array(h[k : k + SHINGLES_AT_ONCE], dtype=">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * bits > len(h)).view(">i8")[0])


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, fp, *keep) of each row."""

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([fingerprint(t.as_py()) for t in batch.column(1)], pa.int64()), *batch.columns[2:]], ["doc_id", "fp", *keep])

    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("t"), *keep)
    return rows.mapInArrow(hashed, ", ".join([f"doc_id {dict(rows.dtypes)['doc_id']}, fp bigint", *[f"{c} {kind}" for c, kind in rows.dtypes[2:]]]))


def home(points: np.ndarray) -> np.ndarray:
    """Nearest anchor: bits 1 to 15 of the Hamming code are numbered from 1, and the exclusive-or of the set ones' numbers names the bit to flip."""
    syndrome = np.zeros_like(points)
    for k in range(15):
        syndrome ^= ((points >> k) & 1) * (k + 1)
    return np.where(syndrome > 0, points ^ (1 << np.maximum(syndrome - 1, 0)), points)


def anchored(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Keys of anchors, the fingerprint's position, and whether the anchor is its home."""
    keys, at, homes = [], [], []
    for b, (first, bits, threshold) in enumerate(BLOCKS):
        point = (fps >> first) & ((1 << bits) - 1)
        near = [point] if threshold == 0 else [point, *[point ^ (1 << k) for k in range(bits)]]
        if threshold > 1:
            near += [point ^ (1 << k) ^ (1 << j) for k in range(bits) for j in range(k)]
        own = home(point)
        to = np.sort(np.stack([home(p) for p in near], axis=1), axis=1)
        new = np.ones(to.shape, dtype=bool)
        new[:, 1:] = to[:, 1:] != to[:, :-1]
        row, col = np.nonzero(new)
        keys.append(to[row, col] | (b << 32))
        at.append(row)
        homes.append(to[row, col] == own[row])
    return np.concatenate(keys), np.concatenate(at), np.concatenate(homes)


def differing(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Number of differing bits; of signed numbers numpy counts the bits of the absolute value."""
    return np.bitwise_count((a ^ b).view(np.uint64))


def spanning(fps: np.ndarray, threshold: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Links that connect what the links within ``threshold`` connect, one for each fingerprint at most.

    Whoever is reached leaves the set still to be compared with, so a dense group costs about its size, not its square.
    """
    left = fps
    while left.size:
        front, left = [left[0]], left[1:]
        while front and left.size:
            f = front.pop()
            hit = differing(left, f) <= threshold
            if hit.any():
                new, left = left[hit], left[~hit]
                front.extend(new)
                yield np.full(new.size, f), new


def compared(key: np.ndarray, fp: np.ndarray, resident: np.ndarray, threshold: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Links between residents and visitors of each anchor; rows are sorted by anchor and anchors are whole."""
    start, size = starts(key)
    dense = np.add.reduceat(resident.astype(np.int64), start) * size > AT_ONCE
    for g in np.flatnonzero(dense):
        yield from spanning(np.unique(fp[start[g] : start[g] + size[g]]), threshold)
    for x, y in pairs(start, size, np.flatnonzero(resident & ~np.repeat(dense, size)), AT_ONCE):
        a, b = fp[x], fp[y]
        near = (differing(a, b) <= threshold) & (a != b)
        yield a[near], b[near]


def links(fps: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """(a, b): links that connect exactly the distinct fingerprints ``fp`` that differ in at most ``threshold`` bits.

    A task holds the fingerprints of one anchor (8 bytes each) besides a batch.
    """
    if sum(t + 1 for _, _, t in BLOCKS) <= threshold:
        raise ValueError("the blocks' thresholds don't cover this one")

    def replicated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 1 << 14):
                fp = batch.column(0).slice(k, 1 << 14).to_numpy(zero_copy_only=False)
                key, at, own = anchored(fp)
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(fp[at]), pa.array(own)], ["anchor", "fp", "resident"])

    def met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in whole_groups(batches, 1):
            for a, b in compared(*[c.to_numpy() for c in rows.columns], threshold):
                if a.size:
                    yield pa.RecordBatch.from_arrays([pa.array(np.maximum(a, b)), pa.array(np.minimum(a, b))], ["a", "b"])

    rows = fps.select("fp").mapInArrow(replicated, "anchor bigint, fp bigint, resident boolean")
    return rows.repartition("anchor").sortWithinPartitions("anchor").mapInArrow(met, "a bigint, b bigint")


def _grouped(found: DataFrame, first: Column, threshold: int) -> tuple[DataFrame, DataFrame]:
    """(fp, first, component) of each fingerprint and (component, first); ``first`` is an aggregate, its least value counts."""
    points = found.groupBy("fp").agg(first.alias("first"))
    of = components(links(points, threshold)).select(F.col("node").alias("fp"), "component")
    member = points.join(of, "fp", "left").select("fp", "first", F.coalesce("component", "fp").alias("component"))
    return member, member.groupBy("component").agg(F.min("first").alias("first"))


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", threshold: int = THRESHOLD) -> DataFrame:
    """(doc_id, fp, component_id) of each row; the component is the smallest id that links lead to.

    Equal fingerprints are one point from the start, however many rows share them; null and wordless texts have fingerprint zero.
    Repeated rows stay repeated, other columns are ignored, an empty table gives no rows.
    """
    found = materialize(fingerprints(docs, doc_id, text), "fingerprints")
    member, named = _grouped(found, F.min("doc_id"), threshold)
    named = named.withColumnRenamed("first", "component_id")
    return found.join(member.join(named, "component").select("fp", "component_id"), "fp").select("doc_id", "fp", "component_id")


def firsts(docs: DataFrame, key: tuple[str, ...], doc_id: str = "doc_id", text: str = "text", threshold: int = THRESHOLD) -> DataFrame:
    """The ``key`` columns of one row of each component: the smallest id, null last, and of rows that share it the smallest key."""
    found = materialize(fingerprints(docs, doc_id, text, key), "fingerprints")
    _, named = _grouped(found, F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", *key)), threshold)
    return named.select(*[F.col("first")[c].alias(c) for c in key])
