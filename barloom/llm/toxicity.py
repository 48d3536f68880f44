"""Toxicity by weak supervision.

1. Voters: words and word beginnings that are frequent in toxic and rare in clean rows of a bounded sample of labelled rows.
2. All texts are read once; each row keeps which voters vote for toxic and a few plain statistics.
3. A generative label model (latent class, voters with a hit rate in toxic and in clean texts) is estimated by expectation
   maximisation over the vote patterns of all rows; correlations of voters within the two classes discount those that repeat others.
4. A linear (logistic) classifier is trained on the posterior labels of rows that aren't held out; it scores every row.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.session import materialize

WORDS = re.compile(r"[^\W\d_]+")
BEGINNINGS = (4, 5, 6)
#: Voters, labelled rows that choose them, rows that the classifier is fitted on; the least toxic rows that a voter must hit.
LEXICON, PATTERNS, SAMPLE, FIT, SUPPORT = 96, 48, 20_000, 50_000, 4
#: At most this share of a voter's hits among labelled rows may be clean ones.
CLEAN = 0.05
ROUNDS, THRESHOLD = 10, 0.3


def held_out(doc_id: str) -> Column:
    """Rows whose labels are never used."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % 4 == 2


def words_of(text: str | None) -> list[str]:
    return WORDS.findall((text or "").lower())


def candidates(words: set[str]) -> set[str]:
    """A word itself, and as ``abcd*`` its beginnings."""
    return words | {w[:n] + "*" for w in words for n in BEGINNINGS if len(w) > n}


def known(labels: DataFrame, doc_id: str, label: str) -> DataFrame:
    """(doc_id, toxic) of usable labels: not held out, 0 or 1, the same wherever the id is repeated."""
    rows = labels.where(~held_out(doc_id) & F.col(label).isin(0, 1)).groupBy(F.col(doc_id).alias("doc_id")).agg(F.min(label).alias("toxic"), F.max(label).alias("z"))
    return rows.where("toxic = z").select("doc_id", "toxic")


def voters(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "toxic", sample: int = SAMPLE) -> tuple[list[str], np.ndarray, np.ndarray, float]:
    """Words and beginnings that vote, their hit rates in toxic and clean rows, and the share of toxic rows; ``sample`` bounds the labelled rows, those of the smallest hash of their id.

    A beginning that hits just what a chosen shorter one hits is left out.
    """
    some = known(labels, doc_id, label).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("t")).join(F.broadcast(some), "doc_id").select("t", "toxic")

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                seen: tuple[Counter, Counter] = Counter(), Counter()
                for t, y in zip(batch.column(0).slice(k, 256), batch.column(1).slice(k, 256).to_pylist(), strict=True):
                    seen[y].update(candidates(set(words_of(t.as_py()))))
                keys = list(seen[0] | seen[1])
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array([seen[1][x] for x in keys], pa.int64()), pa.array([seen[0][x] for x in keys], pa.int64())], ["key", "p", "n"])

    sizes = {r["toxic"]: r["count"] for r in some.groupBy("toxic").count().collect()}
    if len(sizes) < 2:
        return [], np.zeros(0), np.zeros(0), 0.0
    hits = rows.mapInArrow(counted, "key string, p bigint, n bigint").groupBy("key").agg(F.sum("p").alias("p"), F.sum("n").alias("n"))
    # Weight of evidence times support; the rows that come to the driver are bounded by the number of voters.
    worth = F.col("p") * F.log2((F.col("p") + 0.5) / sizes[1] / ((F.col("n") + 0.5) / sizes[0]))
    good = hits.where((F.col("p") >= SUPPORT) & (F.col("n") <= CLEAN * (F.col("p") + F.col("n")))).withColumn("worth", worth)
    chosen = good.where("key NOT LIKE '%*'").orderBy(F.desc("worth"), "key").limit(LEXICON).collect()
    patterns: list = []
    for r in good.where("key LIKE '%*'").orderBy(F.desc("worth"), F.length("key"), "key").limit(8 * PATTERNS).collect():
        same = any(r["key"].startswith(p["key"][:-1]) and r["p"] <= 1.02 * p["p"] or p["key"].startswith(r["key"][:-1]) for p in patterns)
        if len(patterns) < PATTERNS and not same:
            patterns.append(r)
    chosen += patterns
    rates = [np.array([(r[x] + 0.5) / (sizes[y] + 1) for r in chosen]) for x, y in (("p", 1), ("n", 0))]
    return [r["key"] for r in chosen], *rates, sizes[1] / sum(sizes.values())


def votes(docs: DataFrame, keys: list[str], doc_id: str = "doc_id", text: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, hits, hit_words, n_words, *keep): numbers of the voters that vote, words that made them vote, words in all."""
    index = {key: k for k, key in enumerate(keys)}
    lengths = sorted({len(k) - 1 for k in keys if k.endswith("*")})

    def voted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo: dict[str, tuple[int, ...]] = {}

        def of(word: str) -> tuple[int, ...]:
            got = [index[x] for x in (word, *[word[:n] + "*" for n in lengths if len(word) > n]) if x in index]
            if len(memo) > 300_000:
                memo.clear()
            memo[word] = got = tuple(got)
            return got

        for batch in batches:
            hits, hit_words, n_words = [], [], []
            for t in batch.column(1):
                words = words_of(t.as_py())
                found = [v for w in words if (v := memo[w] if w in memo else of(w))]
                hits.append(sorted({k for v in found for k in v}))
                hit_words.append(len(found))
                n_words.append(len(words))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(hits, pa.list_(pa.int32())), pa.array(hit_words, pa.int64()), pa.array(n_words, pa.int64()), *batch.columns[2:]], ["doc_id", "hits", "hit_words", "n_words", *keep])

    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("t"), *keep)
    return rows.mapInArrow(voted, ", ".join([f"doc_id {dict(rows.dtypes)['doc_id']}, hits array<int>, hit_words bigint, n_words bigint", *[f"{c} {kind}" for c, kind in rows.dtypes[2:]]]))


def _dense(lists: list[list[int]], m: int) -> np.ndarray:
    v = np.zeros((len(lists), m))
    for k, hits in enumerate(lists):
        v[k, hits] = 1.0
    return v


@dataclass(frozen=True)
class LabelModel:
    """Vote rates of the voters in toxic and clean texts, the weight of each after its correlations, how often all are silent (clean, toxic), and the share of toxic texts.

    A voter that doesn't vote abstains; only the silence of all of them speaks for a clean text.
    """

    toxic: np.ndarray
    clean: np.ndarray
    weight: np.ndarray
    silent: tuple[float, float]
    share: float

    def posterior(self, v: np.ndarray) -> np.ndarray:
        quiet = v.sum(axis=1) == 0
        logit = np.log(self.share / (1 - self.share)) + v @ (self.weight * np.log(self.toxic / self.clean)) + np.where(quiet, np.log(self.silent[1] / self.silent[0]), 0.0)
        return 1 / (1 + np.exp(-np.clip(logit, -50, 50)))


def _moments(patterns: DataFrame, model: LabelModel) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sums over all rows in clean and toxic texts: co-votes of every two voters, silent rows, rows. A task hands on sums, not rows."""
    m = len(model.weight)

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both, silent, rows = np.zeros((2, m, m)), np.zeros(2), np.zeros(2)
        for batch in batches:
            for k in range(0, batch.num_rows, 4096):
                part = batch.slice(k, 4096)
                v, n = _dense(part.column(0).to_pylist(), m), part.column(1).to_numpy().astype(float)
                p = model.posterior(v)
                for y, w in enumerate((n * (1 - p), n * p)):
                    both[y] += (v * w[:, None]).T @ v
                    silent[y] += w[v.sum(axis=1) == 0].sum()
                    rows[y] += w.sum()
        i, j = np.nonzero(both.sum(axis=0))
        clean, toxic = (np.r_[both[y][i, j], silent[y], rows[y]] for y in (0, 1))
        yield pa.RecordBatch.from_arrays([pa.array(np.r_[i, -1, -2]), pa.array(np.r_[j, -1, -2]), pa.array(clean), pa.array(toxic)], ["i", "j", "clean", "toxic"])

    got = patterns.mapInArrow(summed, "i bigint, j bigint, clean double, toxic double").groupBy("i", "j").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic")).collect()
    both, other = np.zeros((2, m, m)), {-1: np.zeros(2), -2: np.zeros(2)}
    for r in got:
        if r["i"] < 0:
            other[r["i"]] = np.array([r["clean"], r["toxic"]])
        else:
            both[:, r["i"], r["j"]] = r["clean"], r["toxic"]
    return both, other[-1], other[-2]


def label_model(patterns: DataFrame, toxic: np.ndarray, clean: np.ndarray, share: float, rounds: int = ROUNDS) -> LabelModel:
    """Estimated from ``patterns`` (hits, rows) of all texts, starting at the rates in the labelled rows.

    Voters that keep company in toxic texts (correlation above a half, as a word and its beginning do) share the weight of their
    evidence. A voter's rate in clean texts stays within four times the labelled one, so the classes can't change places.
    """
    model, most = LabelModel(toxic, clean, np.ones(len(toxic)), (0.99, 0.01), share), 4 * clean
    for _ in range(rounds):
        both, silent, rows = _moments(patterns, model)
        a, b = ((np.diag(both[y]) + 0.05) / (rows[y] + 1) for y in (1, 0))
        mean = np.diag(both[1]) / max(rows[1], 1e-9)
        sd = np.sqrt(np.maximum(mean * (1 - mean), 1e-9))
        rho = (both[1] / max(rows[1], 1e-9) - np.outer(mean, mean)) / np.outer(sd, sd)
        np.fill_diagonal(rho, 0)
        weight = 1 / (1 + np.where(rho > 0.5, np.minimum(rho, 1), 0).sum(axis=1))
        quiet = tuple(np.clip((silent + 0.05) / (rows + 1), 1e-4, 1 - 1e-4))
        new = LabelModel(np.clip(a, 1e-5, 0.99), np.clip(b, 1e-6, most), weight, quiet, float(np.clip(rows[1] / max(rows.sum(), 1e-9), 1e-4, 0.9)))
        moved = np.abs(new.toxic - model.toxic).max() + abs(new.share - model.share)
        model = new
        if moved < 1e-4:
            break
    return model


def features(v: np.ndarray, hit_words: np.ndarray, n_words: np.ndarray) -> np.ndarray:
    """Inputs of the classifier: the votes, how many, how many words made them, how dense they stand, and one."""
    return np.column_stack([v, np.log1p(v.sum(axis=1)), np.log1p(hit_words), np.sqrt(hit_words / np.maximum(n_words, 1)), np.ones(len(v))])


def train(x: np.ndarray, target: np.ndarray, rows: np.ndarray, ridge: float = 0.1, steps: int = 30) -> np.ndarray:
    """Logistic regression on soft labels by Newton's method; ``rows`` is how often each line counts."""
    w, penalty = np.zeros(x.shape[1]), np.full(x.shape[1], ridge)
    penalty[-1] = 1e-6
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -50, 50)))
        step = np.linalg.solve((x * (rows * p * (1 - p) + 1e-9)[:, None]).T @ x + np.diag(penalty), x.T @ (rows * (p - target)) + penalty * w)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w


def classify(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "toxic", fit: int = FIT, keep: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, held_out, score, predicted, *keep) of each row.

    ``fit`` bounds the rows that the classifier is fitted on, those of the smallest hash of the id. Null and empty texts have no votes and score low; repeated rows stay repeated; other columns are
    ignored unless named in ``keep``; an empty table gives no rows. Without usable labels of both kinds every score is zero.
    """
    keys, toxic, clean, share = voters(docs, labels, doc_id, text, label)
    m = len(keys)
    cast = materialize(votes(docs, keys, doc_id, text, keep), "votes")
    out = cast.withColumn("held_out", held_out("doc_id"))
    if not m:
        return out.select("doc_id", "held_out", F.lit(0.0).alias("score"), F.lit(0).alias("predicted"), *keep)
    patterns = materialize(cast.groupBy("hits").agg(F.count(F.lit(1)).alias("rows")), "patterns")
    model = label_model(patterns, toxic, clean, share)
    rows = out.where("NOT held_out").orderBy(F.xxhash64("doc_id"), "doc_id").limit(fit).groupBy("hits", "hit_words", "n_words").count().collect()
    v = _dense([r["hits"] for r in rows], m)
    n = np.array([r["count"] for r in rows], dtype=float)
    x = features(v, np.array([r["hit_words"] for r in rows], dtype=float), np.array([r["n_words"] for r in rows], dtype=float))
    w = train(x, model.posterior(v), n)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s = []
            for k in range(0, batch.num_rows, 4096):
                part = batch.slice(k, 4096)
                s.append(1 / (1 + np.exp(-np.clip(features(_dense(part.column(1).to_pylist(), m), part.column(2).to_numpy().astype(float), part.column(3).to_numpy().astype(float)) @ w, -50, 50))))
            score = np.concatenate(s) if s else np.zeros(0)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(4), pa.array(score), pa.array((score >= THRESHOLD).astype(np.int32)), *batch.columns[5:]], ["doc_id", "held_out", "score", "predicted", *keep])

    kinds = dict(out.dtypes)
    return out.select("doc_id", "hits", "hit_words", "n_words", "held_out", *keep).mapInArrow(scored, ", ".join([f"doc_id {kinds['doc_id']}, held_out boolean, score double, predicted int", *[f"{c} {kinds[c]}" for c in keep]]))
