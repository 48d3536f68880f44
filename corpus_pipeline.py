"""Corpus pipeline: documents are cleaned, deduplicated, mixed and encoded; every stage is written and read again as the next one's input.

Verdicts are on rows: each carries 128 bits that name all its columns, and by these rejected rows go and copies are told apart, whatever ids
repeat or are null. No stage is expressible in SQL as a whole
(the first two learn their models), so ORACLE_SQL is None and the tests compare the stages with plain versions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.llm import mixing, pieces, rules, simhash, toxicity
from barloom.llm.catalog import table, tokenizer_file
from barloom.session import materialize

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: Frequent units, and parts of others, in the broadcast dictionary of the encoding; all others take its exact other way.
FREQUENT = 100_000
ORACLE_SQL = None


KEY = ("row_a", "row_b")


def _keyed(docs: DataFrame) -> DataFrame:
    """Adds the row's name; only rows that agree in every column share it, and a null differs from every value."""
    every = [x for c in COLUMNS for x in (F.col(c), F.col(c).isNull())]
    return docs.select(*COLUMNS, *[F.xxhash64(F.lit(k), *every).alias(c) for k, c in enumerate(KEY)])


def _without(docs: DataFrame, bad: DataFrame) -> DataFrame:
    return docs.join(bad.select(*KEY).distinct(), list(KEY), "left_anti").select(*COLUMNS)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity classifier doesn't reject."""
    docs = _keyed(docs)
    return _without(docs, toxicity.classify(docs, table(spark, sf_dir, "labels"), keep=KEY).where("predicted = 1"))


def drop_junk(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that neither the base rule nor the learned rules reject."""
    docs = _keyed(docs)
    return _without(docs, rules.judge(docs, table(spark, sf_dir, "labels"), keep=KEY).where("NOT kept"))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates one row: the smallest id, null last. Rows equal in every column become one before the join, map-side first."""
    docs = _keyed(docs)
    return docs.dropDuplicates(list(KEY)).join(simhash.firsts(docs, KEY), list(KEY), "left_semi").select(*COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it, in whole copies: its taken words over its size, to the nearest (0 to 3)."""
    docs = _keyed(docs)
    mixed = mixing.mix(docs, keep=KEY).where("taken > 0").select(*KEY, F.round(F.col("taken") / F.col("size")).cast("int").alias("copies")).where("copies > 0").groupBy(*KEY).agg(F.max("copies").alias("copies"))
    taken = docs.join(mixed, list(KEY))
    return taken.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies")))).select(*COLUMNS)


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of each row of the mix, their number and digest, and whether they decode to the text."""
    return pieces.trip(docs, pieces.load(tokenizer_file("piece_bpe_32k.model")), keep=("lang", "source", "n_chars"), frequent=FREQUENT, joined=True)


STAGES = [
    ("toxicity", drop_toxic),
    ("quality rules", drop_junk),
    ("SimHash near-dedup", drop_copies),
    ("source mixing", mix_sources),
    ("SentencePiece encoding", encode_pieces),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
