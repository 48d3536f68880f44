"""The pipeline decides row by row, also where ids repeat or are null."""

from pyspark.sql import functions as F

import corpus_pipeline
from barloom.llm import catalog, mixing, rules, toxicity

SF = "/root/testdata/sf0.01"


def sorted_rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_filters_keep_clean_rows_beside_rejected_ones(spark):
    docs, labels = catalog.table(spark, SF, "documents").select(*corpus_pipeline.COLUMNS), catalog.table(spark, SF, "labels")
    # All texts come again under a null id, and under twenty ids without labels.
    docs = docs.union(docs.withColumn("doc_id", F.lit(None).cast("long"))).union(docs.withColumn("doc_id", -1 - F.col("doc_id") % 20))
    for stage, judged, verdict in ((corpus_pipeline.drop_toxic, toxicity.classify, F.col("predicted") == 0), (corpus_pipeline.drop_junk, rules.judge, F.col("kept"))):
        each = [tuple(r) for r in judged(docs, labels, keep=("text",)).select("doc_id", "text", verdict).collect()]
        # Some null-id row is rejected and some are kept, and so with a repeated id.
        assert {v for k, _, v in each if k is None} == {True, False}
        assert {k for k, _, v in each if k is not None and v} & {k for k, _, v in each if not v}
        assert sorted_rows(stage(spark, docs, SF).select("doc_id", "text")) == sorted([(k, t) for k, t, v in each if v], key=repr)


def test_one_row_of_each_group_of_copies(spark):
    text = {k: " ".join(f"{k}{j}" for j in range(60)) for k in "abcde"}
    rows = [(1, text["a"]), (1, text["a"]), (None, text["a"]), (1, text["b"]), (None, text["c"]), (None, text["c"]), (None, text["d"]), (2, text["d"].upper()), (2, text["d"]), (3, text["e"]), (None, None)]
    docs = spark.createDataFrame([(k, t, "en", "s", 1) for k, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = corpus_pipeline.drop_copies(spark, docs, SF).collect()
    assert sorted(((r.doc_id, (r.text or "").lower()) for r in got), key=repr) == sorted([(1, text["a"]), (1, text["b"]), (None, text["c"]), (2, text["d"]), (3, text["e"]), (None, "")], key=repr)


def test_mix_copies_each_null_id_row_by_its_own_share(spark):
    texts = [(None, " ".join(f"w{k}x{j}" for j in range(40 + k)), "en", f"s{k % 2}", 1) for k in range(40)]
    docs = spark.createDataFrame(texts, "doc_id long, text string, lang string, source string, n_chars long")
    want = {(r.source, r.size): round(r.taken / r.size) for r in mixing.mix(docs).collect()}
    got = {}
    for r in corpus_pipeline.mix_sources(spark, docs, SF).collect():
        got[r.source, len(r.text.split())] = got.get((r.source, len(r.text.split())), 0) + 1
    assert got == {k: n for k, n in want.items() if n}
