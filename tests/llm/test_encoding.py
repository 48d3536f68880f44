"""The registered queries encode and decode every text as the library does."""

import ctypes
import os
import subprocess
import sys
from pathlib import Path

import pytest

import corpus_pipeline
from barloom.llm import catalog, pieces

SF = "/root/testdata/sf0.001"


def test_query_and_stage_return_ids_of_every_text(spark, monkeypatch):
    import sentencepiece

    lib = sentencepiece.SentencePieceProcessor(model_file=catalog.tokenizer_file("piece_bpe_32k.model"))
    docs = catalog.table(spark, SF, "documents").select(*corpus_pipeline.COLUMNS)
    text = {r.doc_id: r.text or "" for r in docs.collect()}
    monkeypatch.setattr(pieces, "COUNTED", 64)
    for got in (catalog.QUERIES["op8_pieces"](spark, SF).collect(), corpus_pipeline.encode_pieces(spark, docs.union(docs.limit(20)), SF).collect()):
        assert {r.doc_id for r in got} == set(text)
        for r in got:
            want = lib.encode(text[r.doc_id])
            assert r.ids == want and (r.n_tokens, r.id_sum) == (len(want), sum(want))
            assert r.round_trip == ("▁" not in text[r.doc_id])
    assert len(got) == len(text) + 20


def test_rare_units_and_long_texts_keep_their_order(spark):
    import sentencepiece

    path = catalog.tokenizer_file("piece_bpe_32k.model")
    lib, model = sentencepiece.SentencePieceProcessor(model_file=path), pieces.load(path)
    texts = ["the " * 20_000 + "qzxv" + " end" * 9000, "a" * 200 + " the", "é漢🙂 the", "", None, "▁▁x", "the there", "the there"]
    docs = spark.createDataFrame([(None if k > 5 else k, t) for k, t in enumerate(texts)], "doc_id long, text string")
    # Three units are known; all others are set aside.
    got = pieces._encoded(docs, model, "doc_id", "text", ["text"], frequent=3).collect()
    assert len(got) == len(texts) and all(r.ids == lib.encode(r.text or "") for r in got)
    assert [r.round_trip for r in pieces.trip(docs, model).where("doc_id = 5 OR doc_id IS NULL OR doc_id = 4").orderBy("doc_id").collect()] == [True, True, True, False]


def test_the_models_table_stands_once_in_the_plan(spark):
    model = pieces.load(catalog.tokenizer_file("piece_bpe_32k.model"))
    docs = spark.createDataFrame([(1, [5000, 6000]), (2, []), (3, None)], "doc_id long, ids array<int>")
    got = pieces.decode(docs, model)
    assert len(got._jdf.queryExecution().analyzed().toString()) < 1.5 * len(",".join(model.reads))
    said = [bytes.fromhex("".join(model.reads[k] for k in r.ids or [])).decode() for r in got.collect()]
    assert [r.text for r in got.collect()] == [x[1:] if x[:1] == " " else x for x in said]


def test_parts_stay_with_their_row_and_nothing_is_moved(spark):
    import sentencepiece

    path = catalog.tokenizer_file("piece_bpe_32k.model")
    lib, model = sentencepiece.SentencePieceProcessor(model_file=path), pieces.load(path)
    docs = catalog.table(spark, SF, "documents").selectExpr("nullif(doc_id, 3) AS doc_id", "text").unionAll(spark.createDataFrame([(None, "qz xv " * 3000), (None, None)], "doc_id long, text string"))
    batch = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    try:
        # Units, and the parts of a row, go on over many batches.
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "61")
        out = pieces._encoded(docs, model, "doc_id", "text", ["text"], frequent=20)
        got = out.collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    assert len(got) == docs.count() and all(r.ids == lib.encode(r.text or "") for r in got)
    # The ids that are known already are neither written nor shuffled on the way to their text.
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hashpartitioning" not in plan and "SortMergeJoin" not in plan and sum("documents.parquet" in f for f in out.inputFiles()) == len(out.inputFiles())


def test_many_texts_are_cut_as_one_and_their_other_parts_stand_once(spark):
    import numpy as np
    import pyarrow as pa

    model = pieces.load(catalog.tokenizer_file("piece_bpe_32k.model"))
    texts = ["the qzxv", "the qzxv qzxv", "", None, "  a  b ", "a▁b▁▁c", "\n\n\tx\n y", "▁", " ", "é漢🙂 the", "a\r\nb", "x  \n\n  y"]
    cutter = pieces.Cutter(model)
    for some in (texts, [*texts, "x\x00y \x01"]):
        many, units = cutter.all_units(pa.array(["cut off", *some]).slice(1))
        assert [cutter.units(t) for t in some] == [x.tolist() for x in np.split(np.array(units.to_pylist(), object), np.cumsum(many)[:-1])]
    each = [u for t in texts for u in cutter.units(t)]
    many, parts = cutter.all_parts(each)
    assert (many.tolist(), parts) == ([len(cutter.parts(u)) for u in each], [p for u in each for p in cutter.parts(u)])
    none = pa.ListArray.from_arrays(pa.array([0], pa.int32()), pa.array([], pa.int32()))
    placer = pieces.BatchPlacer(model, pa.array([], pa.string()), none, np.zeros(0, np.uint32))
    _, _, ends, holes = placer.place(pa.array(texts))
    assert len(ends) == len(texts) + 1 and len(holes) == len(set(holes))
    # What a task has seen once is named by its parts for the dictionary.
    assert set(cutter.often({"▁qzxv": 1, "▁the": 2}, 1)) == {"▁the"} | {p for p in cutter.parts("▁qzxv") if len(p) > 1}
    got = pieces._encoded(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1), model, "doc_id", "text", ["text"], frequent=0)
    import sentencepiece

    lib = sentencepiece.SentencePieceProcessor(model_file=catalog.tokenizer_file("piece_bpe_32k.model"))
    assert all(r.ids == lib.encode(r.text or "") for r in got.collect())


@pytest.mark.skipif(not hasattr(ctypes.CDLL(None), "malloc_trim"), reason="no glibc")
def test_a_worker_gives_back_what_it_no_longer_uses():
    code = """
import re
import numpy as np
from barloom.llm.pieces import _give_back
used = lambda: int(re.search(r"Pss_Anon: +([0-9]+)", open("/proc/self/smaps_rollup").read())[1])
before = used()
some = [np.ones(100_000, np.uint8) for _ in range(1_000)]
del some[:-1]
kept = used() - before
_give_back()
print(kept, used() - before)
"""
    root = str(Path(pieces.__file__).resolve().parents[2])
    kept, left = map(int, subprocess.run([sys.executable, "-c", code], env=os.environ | {"PYTHONPATH": root}, capture_output=True, text=True, check=True).stdout.split())
    assert kept > 80_000 and left < 10_000
