"""Repeated and null ids, ties, and limits: the cases that once went wrong."""

from __future__ import annotations

import random

import numpy as np
import pytest

from barloom.llm import chat, mixing, vectors


def test_vectors_with_null_and_repeated_ids(spark):
    one, other = [1.0, 0.0, 0.0], [0.0, 1.0, 0.0]
    near = [0.99, 0.05, 0.0]
    rows = [(5, one), (5, near), (7, other), (None, near), (None, [0.0, 0.0, 1.0]), (7, [0.0, 0.0, -1.0]), (None, None)]
    got = vectors.near_duplicates(spark.createDataFrame([(i, v, 1, "x") for i, v in rows], "vec_id long, embedding array<double>, label int, node string"))
    assert sorted(map(tuple, got.collect()), key=repr) == sorted([(5, 2, 5), (5, 2, 5), (7, 0, 7), (None, 2, 5), (None, 0, None), (7, 0, 7), (None, 0, None)], key=repr)


def test_vectors_of_one_component_keep_the_smallest_id_in_any_order(spark):
    rng = np.random.default_rng(1)
    base = rng.normal(size=(4, 16))
    rows = [(int(k), [float(x) for x in base[k % 4] + rng.normal(0, 0.02, 16)], 1) for k in rng.permutation(200)]
    got = vectors.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int"))
    assert {(r[0], r[2]) for r in got.collect()} == {(k, k % 4) for k in range(200)}


def test_turns_with_ties_go_by_text(spark):
    rows = [(1, 0, "user", t) for t in "ecbda"] + [(2, 0, "user", t) for t in "abc"] + [(3, 0, None, "z"), (3, 0, "user", None), (3, 0, "user", "a")]
    got = {r.conv_id: r.chat for r in chat.format_chats(spark.createDataFrame(rows, "conv_id long, turn int, role string, text string")).collect()}
    assert set(got) == {1, 3}
    assert [x.split("\n")[1][0] for x in got[1].split(chat.OPEN)[1:]] == list("abcde")
    assert [x.split("\n")[:2] for x in got[3].split(chat.OPEN)[1:]] == [["unknown", "z<|im_end|>"], ["user", "<|im_end|>"], ["user", "a<|im_end|>"]]


def test_rows_without_conv_id_are_conversations_of_their_own(spark):
    rows = [(None, 0, "user", "hello"), (None, 4, "user", "hello"), (None, 0, "user", "other"), (None, 1, None, None), (1, 0, "user", "hello"), (1, 1, "bot", "hi"), (2, 0, "user", "single"), (None, 0, "user", "single")]
    got = sorted(((r.conv_id, r.n_turns, r.chat.count("hello")) for r in chat.format_chats(spark.createDataFrame(rows, "conv_id long, turn int, role string, text string")).collect()), key=repr)
    assert got == [(1, 2, 1), (2, 1, 0), (None, 1, 0), (None, 1, 0)]


def test_a_long_conversation_in_order(spark):
    rows = [(1, k, "user", f"turn {k}") for k in range(3000)]
    random.Random(1).shuffle(rows)
    one = chat.format_chats(spark.createDataFrame(rows, "conv_id long, turn int, role string, text string")).first()
    assert one.n_turns == 3000
    assert one.chat == "".join(f"{chat.OPEN}user\nturn {k}{chat.CLOSE}\n" for k in range(3000))


def mixed(spark, rows, **more):
    return mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string"), **more).collect()


def test_small_sources_of_short_texts_reach_their_target_with_many_shards(spark):
    rows = [(k, "a b c", "a") for k in range(1000)] + [(k, "word " * 400, "b") for k in range(1000, 1100)]
    for words in (50, 200, 1000):
        got = [r for r in mixed(spark, rows, shard_words=words) if r.source == "a"]
        assert abs(sum(r.taken for r in got) - got[0].target) <= mixing.BLOCK
        assert all(r.taken <= 3 * r.size for r in got)


def test_rows_without_id_spread_over_shards(spark):
    rows = [(None if k % 2 else k, f"word{k} " * 30, "a") for k in range(2000)]
    got = mixed(spark, rows, shard_words=3000)
    sizes = {}
    for r in got:
        sizes[r.shard] = sizes.get(r.shard, 0) + r.size
    assert len(sizes) == 20 and max(sizes.values()) < 6000
    again = mixed(spark, rows[::-1], shard_words=3000)
    assert sorted(map(tuple, got), key=repr) == sorted(map(tuple, again), key=repr)


def test_licence_templates_by_the_hundred(spark):
    """Many templates in one index; both rare words of a template must name the same start, and then its keys must stand."""
    from barloom.llm import licenses

    ts = [licenses._t(f"l{k}", f"covered by licence number n{k} of series s{k % 7}", f"licence number n{k} of series s{k % 7}") for k in range(200)] + licenses.BASE
    said = ["covered by licence number n5 of series s5", "n5 s5 licence number n5 of series s4", "x licence number N199 of series S3 licence number n8 of series s1", "s5 licence n5", "", None, "licence number n5 of series s5 " * 300]
    docs = spark.createDataFrame(list(enumerate(said)), "doc_id int, text string")
    got = {r["doc_id"]: r for r in licenses.scan(docs, templates=ts).collect()}
    place = lambda k, at: (f"l{k}", False, at)
    want = {0: [place(5, 0)], 1: [], 2: [place(8, 5), place(199, -1)], 3: [], 4: [], 5: [], 6: [place(5, 6 * j - 2) for j in range(300)]}
    assert {k: sorted(map(tuple, r["places"])) for k, r in got.items()} == {k: sorted(v) for k, v in want.items()}
    assert got[0]["coverage"] == pytest.approx(1.0) and got[3]["coverage"] == 0.0


def test_tokens_of_characters_newer_than_python():
    import unicodedata

    import tokenizers

    from barloom.llm import catalog, token_counts

    with open(catalog.tokenizer_file("word_bpe_49k.json"), encoding="utf-8") as f:
        text = f.read()
    merges, library = token_counts.Merges(text), tokenizers.Tokenizer.from_str(text)
    odd = token_counts.odd_characters(text, merges)
    counter = token_counts.Counter(merges, merges.whole(), odd)
    back = {c: b for b, c in enumerate(merges.letters)}
    some = {0xA7CB, 0xA7DC, 0x558, 0x323B0, 0x11DE0, *range(0x250), *(k for k in range(0x250, 0x40000) if unicodedata.category(chr(k)) == "Cn" and (k < 0x3000 or 0xA000 < k < 0xB000 or k % 64 == 0))}
    for k in some:
        for said in (f"a{chr(k)}b", f"1{chr(k)}2", f".{chr(k)}."):
            ours = [w.encode() for w in counter.words(said)]
            assert ours == [bytes(back[c] for c in w) for w, _ in library.pre_tokenizer.pre_tokenize_str(library.normalizer.normalize_str(said))], hex(k)
    for said in ("a\ua7cbb", "\ua7dc", "x\U00032808y \ua7cb\ua7dc"):
        assert counter.count(said) == len(library.encode(said, add_special_tokens=False).ids)
