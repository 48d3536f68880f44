import duckdb
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from barloom.llm import catalog, rules, simhash, toxicity

SF = "/root/testdata/sf0.01"


def test_stages_keep_what_their_operators_decide(spark):
    docs = catalog.table(spark, SF, "documents")
    labels = catalog.table(spark, SF, "labels")
    for stage, kept in zip(corpus_pipeline.STAGES[:3], (lambda d: toxicity.classify(d, labels).where("predicted = 0"), lambda d: rules.judge(d, labels).where("kept"), lambda d: simhash.near_duplicates(d).where("doc_id = component_id")), strict=True):
        out = stage[1](spark, docs, SF)
        assert out.columns == corpus_pipeline.COLUMNS
        assert {r.doc_id for r in out.collect()} == {r.doc_id for r in kept(docs).collect()}
        docs = spark.createDataFrame(out.toPandas(), "doc_id long, text string, lang string, source string, n_chars long")
    assert 300 < docs.count() < 900


def test_mix_repeats_documents(spark):
    docs = catalog.table(spark, SF, "documents")
    out = corpus_pipeline.mix_sources(spark, docs, SF).groupBy("doc_id").count().collect()
    assert out and max(r["count"] for r in out) <= 3


def test_run(spark):
    out = corpus_pipeline.run(spark, SF)
    assert out.where("NOT round_trip").count() == 0 and out.agg(F.sum("n_tokens")).first()[0] > 100_000


@pytest.mark.parametrize("key", sorted(catalog.ORACLES))
def test_twin(spark, key):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "labels", "conversations", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    cur = con.execute(catalog.ORACLES[key])
    names = [c[0] for c in cur.description]
    want = sorted(map(repr, cur.fetchall()))
    got = catalog.QUERIES[key](spark, SF).select(*names)
    assert sorted(repr(tuple(r)) for r in got.collect()) == want
