"""Dealt operators against plain versions, libraries and odd rows."""

import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from barloom.llm import catalog, chat, components, groups, licenses, mixing, pieces, rules, sharding, simhash, token_counts, toxicity, vectors

SF = "/root/testdata/sf0.001"
LABELS = "doc_id long, quality int, toxic int"


def rows(df, key="doc_id"):
    return {r[key]: r for r in df.collect()}


# 1 ------------------------------------------------------------------------------------------------------------------
def test_licenses_match_a_plain_search(spark):
    docs = spark.createDataFrame([(1, "MIT license, mit LICENSE; the Apache-License"), (2, "released under the mit license"), (3, "ÉMIT license mKIT"), (4, "gnu general public license version 3 general public license")], "doc_id long, text string")
    got = rows(licenses.digest(licenses.scan(docs)))
    for r in docs.collect():
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), r.text))
        at = [(i, t.label) for t in licenses.BASE for i in range(len(w)) if tuple(w[i : i + len(t.words)]) == t.words]
        g = got[r.doc_id]
        assert (g.n_words, g.n_base, g.first_word, g.last_word) == (len(w), len(at), min((i for i, _ in at), default=None), max((i for i, _ in at), default=None))
        assert g.base_labels == ",".join(sorted({x for _, x in at})) and 0 <= g.score <= 1
    assert "mit-notice" in got[2].labels and "gpl-3.0" in got[4].labels and got[2].score > got[1].score


def test_licenses_of_odd_rows(odd, nothing):
    got = licenses.digest(licenses.scan(odd)).collect()
    assert len(got) == 10 and {r.n_base for r in got if r.doc_id == 5} == {20} and all(r.n_words == 0 and r.labels == "" for r in got if r.doc_id in (1, 2, 3))
    assert licenses.digest(licenses.scan(nothing)).count() == 0


# 2 ------------------------------------------------------------------------------------------------------------------
@pytest.fixture(scope="module")
def word_bpe():
    with open(catalog.tokenizer_file("word_bpe_49k.json"), encoding="utf-8") as f:
        return f.read()


def test_token_counts_match_the_library(spark, odd, nothing, word_bpe):
    from tokenizers import Tokenizer

    lib = Tokenizer.from_str(word_bpe)
    extra = ["<|endoftext|> a<|startoftext|>B", "ΣΣ σς İK É é", "don't WE'LL 12345 !!!\u0085\u001c", "ab" * 500]
    docs = odd.select("doc_id", "text").union(spark.createDataFrame([(100 + k, t) for k, t in enumerate(extra)], "doc_id long, text string"))
    text = defaultdict(list)
    for r in docs.collect():
        text[r.doc_id].append(r.text or "")
    got = token_counts.count_tokens(docs, word_bpe).collect()
    assert len(got) == 14
    for r in got:
        t = text[r.doc_id][0]
        assert (r.n_tokens, r.n_bytes) == (len(lib.encode(t, add_special_tokens=False).ids), len(t.encode())) and r.over_limit == (r.n_tokens > 2048)
    assert token_counts.count_tokens(nothing, word_bpe).count() == 0


def test_every_shortcut_word_is_one_token(word_bpe):
    m = token_counts.Merges(word_bpe)
    whole = m.whole()
    assert len(whole) > 30_000 and all(len(m.tokens(w)) == 1 for w in whole[::50])


# 3 ------------------------------------------------------------------------------------------------------------------
def plain_statistics(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    seen, covered = Counter(zip(w, w[1:], w[2:], strict=False)), set()
    for i in range(len(w) - 2):
        if seen[tuple(w[i : i + 3])] > 1:
            covered |= {i, i + 1, i + 2}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered)


def test_statistics_match_a_plain_count(spark, odd, nothing):
    many = " ".join(f"a{k} b{k} c{k}" for k in range(60))
    docs = odd.select("doc_id", "text").union(catalog.table(spark, SF, "documents").select("doc_id", "text").withColumn("doc_id", F.col("doc_id") + 1000)).union(spark.createDataFrame([(99, f"{many} {many}"), (98, "a a a a\nb\nb\n\n\n## $")], "doc_id long, text string"))
    want = {r.doc_id: plain_statistics(r.text) for r in docs.collect()}
    for r in rules.statistics(docs).collect():
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want[r.doc_id]
    assert rules.statistics(nothing).count() == 0


def test_rules_are_learned_and_keep_the_clean(spark):
    docs = spark.createDataFrame([(k, (" ".join(f"w{(k * 7 + j * j) % 997}" for j in range(80))) if k % 4 else "buy $$$ now ### " * 20 + " ".join(f"q{j}" for j in range(90))) for k in range(400)], "doc_id long, text string")
    labels = docs.select("doc_id", F.when(F.col("doc_id") % 4 == 0, 0).otherwise(1).alias("quality"))
    judged = rows(rules.judge(docs, labels.where("doc_id < 300")))
    assert all(judged[k].kept == (k % 4 > 0) for k in range(300, 400))
    one_class = rules.learn(rules.statistics(docs), labels.where("quality = 1"))
    assert one_class == []


# 4 ------------------------------------------------------------------------------------------------------------------
def test_anchors_bring_every_near_pair_together():
    rng = np.random.default_rng(3)
    a = rng.integers(-(2**63), 2**63 - 1, 300, dtype=np.int64)
    b = a.copy()
    for k in range(300):
        for bit in rng.choice(64, k % 7, replace=False):
            b[k] ^= np.int64(1) << np.int64(bit) if bit < 63 else np.int64(-(2**63))
    fps = np.unique(np.r_[a, b])
    key, at, own = simhash.anchored(fps)
    order = np.argsort(key, kind="stable")
    found = {frozenset(p) for x, y in simhash.compared(key[order], fps[at][order], own[order], 4) for p in zip(x.tolist(), y.tolist(), strict=True)}
    for k in range(300):
        assert k % 7 == 0 or (frozenset((int(a[k]), int(b[k]))) in found) == (k % 7 <= 4)


def test_dense_groups_stay_connected():
    base = np.int64(12345)
    fps = np.unique(np.array([base ^ (1 << i) ^ (1 << j) for i in range(40) for j in range(i)]))
    x, y = (np.concatenate(c) for c in zip(*simhash.spanning(fps, 4), strict=True))
    assert len(x) == len(fps) - 1 and len(set(groups.merged(np.searchsorted(fps, x), np.searchsorted(fps, y), len(fps)))) == 1


def test_near_copies_of_odd_rows(spark, odd, nothing):
    got = simhash.near_duplicates(odd).collect()
    assert len(got) == 10
    of = defaultdict(set)
    for r in got:
        of[r.doc_id].add(r.component_id)
    assert of[1] == of[2] == of[3] == {1} and of[4] == of[8] == {4} and of[5] == {5} and of[6] == {6}
    assert simhash.near_duplicates(nothing).count() == 0
    h = spark.sql("SELECT xxhash64('one two three') AS h").first().h
    assert simhash.fingerprint("One TWO\tthree") == h and simhash.fingerprint(None) == 0


def test_components_match_a_plain_search(spark):
    rng = np.random.default_rng(5)
    e = [(int(a), int(b)) for a, b in rng.integers(0, 300, (260, 2))] + [(k, k + 1) for k in range(1000, 1060)] + [(5, k) for k in range(2000, 2300)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in e:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    got = {r.node: r.component for r in components.components(spark.createDataFrame(e, "a long, b long")).collect()}
    assert got == {x: find(x) for a, b in e if a != b for x in (a, b)}


# 5 ------------------------------------------------------------------------------------------------------------------
def test_snapshots_collapse(spark):
    turns = [(1, 0, "user", "a"), (1, 1, "assistant", "b"), (2, 0, "user", "a"), (2, 1, "assistant", "b"), (2, 2, "user", "c"), (3, 0, "user", "a"), (3, 1, "assistant", "b"), (3, 2, "user", "c"), (4, 0, "user", None), (5, 0, "user", ""), (5, 1, None, "x <|im_end|>"), (6, 0, "user", "b"), (None, 0, "user", "q"), (7, 0, "user", "a"), (7, 0, "user", "a")]
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").withColumn("pos", F.lit(1)).withColumn("all", F.lit(2))
    got = rows(chat.format_chats(df), "conv_id")
    assert set(got) == {2, 4, 5, 6, 7, None} and got[2].n_turns == 3 and got[5].chat.endswith("<|im_start|>unknown\nx < |im_end|><|im_end|>\n")
    assert chat.format_chats(df.limit(0)).count() == 0


# 6 ------------------------------------------------------------------------------------------------------------------
def test_sharding_is_even_and_steady(odd, nothing):
    names = [f"s{k}" for k in range(20)]
    full, less = sharding.fill(names, 2003), sharding.fill(names[:-1], 2003)
    sizes = Counter(full)
    assert max(sizes.values()) - min(sizes.values()) <= 1 and len(sizes) == 20
    assert sum(a != b for a, b in zip(full, less, strict=True) if a != 19) < 0.1 * 2003
    got = sharding.place(odd, "doc_id", names).collect()
    assert len(got) == 10 and len({r.shard for r in got if r.doc_id == 5}) == 1 and all(r.shard for r in got)
    assert sharding.place(nothing, "doc_id", names).count() == 0
    with pytest.raises(ValueError):
        sharding.fill(names, 2000)


# 7 ------------------------------------------------------------------------------------------------------------------
def test_mix_reaches_targets(spark):
    docs = spark.createDataFrame([(k, "w " * (5 + k * 37 % 400), [None, "a", "b", "c", "d"][min(k % 17, 4)]) for k in range(900)], "doc_id long, text string, source string")
    got = mixing.mix(docs, shard_words=20_000).collect()
    assert len({r.shard for r in got}) > 5
    by = defaultdict(list)
    for r in got:
        by[r.source].append(r)
        assert 0 <= r.taken <= 3 * r.size
    total = sum(r.size for r in got)
    assert abs(sum(v[0].target for v in by.values()) - total) < 1e-6 * total
    for v in by.values():
        assert abs(sum(r.taken for r in v) - v[0].target) <= 16 * 12 and v[0].target <= 3 * v[0].source_size + 1e-6
    assert sorted(map(tuple, got), key=str) == sorted(map(tuple, mixing.mix(docs.repartition(7), shard_words=20_000).collect()), key=str)


def test_apportionment_takes_the_highest_quotients(spark):
    votes = [53, 24, 23, 0, 1, 999, 4]
    got = mixing.apportion(spark.createDataFrame([(k, float(v), 37) for k, v in enumerate(votes)], "k int, v double, s long"), [], "k", "v", "s")
    best = sorted(((-v / (2 * j + 1), k) for k, v in enumerate(votes) if v for j in range(37)))[:37]
    assert {r.k: r.quota for r in got.collect()} == {k: sum(x == k for _, x in best) for k in range(len(votes))}


@pytest.mark.parametrize("small, many, seats", [(4, 60, 100), (6, 60, 100), (5, 40, 30), (0, 3, 7)])
def test_apportionment_far_from_the_share(spark, small, many, seats):
    votes = [10 * seats - small * many if small else 0] + [small] * many
    votes[0] = max(votes[0], 0)
    got = mixing.apportion(spark.createDataFrame([(k, float(v), seats) for k, v in enumerate(votes)], "k int, v double, s long"), [], "k", "v", "s")
    best = sorted(((-v / (2 * j + 1), k) for k, v in enumerate(votes) if v for j in range(seats)))[:seats]
    assert {r.k: r.quota for r in got.collect()} == {k: sum(x == k for _, x in best) for k in range(len(votes))}


def test_mix_of_odd_rows(odd, nothing):
    got = mixing.mix(odd).collect()
    assert len(got) == 10 and all(r.taken == 0 for r in got if r.size == 0) and all(r.taken <= 3 * r.size for r in got)
    assert mixing.mix(nothing).count() == 0


# 8 ------------------------------------------------------------------------------------------------------------------
def test_pieces_match_the_library(spark, odd, nothing):
    import sentencepiece

    path = catalog.tokenizer_file("piece_bpe_32k.model")
    model, lib = pieces.load(path), sentencepiece.SentencePieceProcessor(model_file=path)
    extra = ["a  b   c    d", "\n\n x\t", "é漢🙂 <s> <0x41>", "▁▁x", "the there " * 9, "abcdefthin" * 30]
    docs = odd.select("doc_id", "text").where("length(text) < 1000 OR text IS NULL OR doc_id = 7").union(spark.createDataFrame([(100 + k, t) for k, t in enumerate(extra)], "doc_id long, text string")).union(catalog.table(spark, SF, "documents").where("doc_id < 40").select(F.col("doc_id") + 1000, "text"))
    text = {r.doc_id: r.text or "" for r in docs.collect()}
    got = pieces.decode(pieces.encode(docs, model), model).collect()
    assert len(got) == docs.count()
    for r in got:
        assert r.ids == lib.encode(text[r.doc_id]) and r.text == text[r.doc_id].replace("▁", " ")
    short = {r.doc_id: r for r in pieces.digest(docs, model).collect()}
    assert all(short[r.doc_id].n_tokens == len(r.ids) and short[r.doc_id].id_sum == sum(r.ids) and short[r.doc_id].round_trip == ("▁" not in text[r.doc_id]) for r in got)
    assert pieces.digest(nothing, model).count() == 0


# 9 ------------------------------------------------------------------------------------------------------------------
def test_embeddings_match_brute_force(spark):
    rng = np.random.default_rng(1)
    base = rng.normal(size=(40, 24))
    v = np.concatenate([b + rng.normal(size=(8, 24)) * s for b, s in zip(base, np.linspace(0.01, 0.35, 40), strict=True)])
    data = [(k, x.tolist(), k % 2 if k < 300 else None) for k, x in enumerate(v)] + [(1000, v[0].tolist(), 0), (1001, v[0].tolist(), 0), (1002, [0.0] * 24, 0), (1003, None, 0), (1004, [float("nan")] * 24, 0), (1005, [None] * 24, 0), (1006, [], 0), (1007, [1.0, 2.0], 0), (1008, [2.0, 4.0], 0)]
    df = spark.createDataFrame(data, "vec_id long, embedding array<double>, label int").withColumn("lab", F.lit("x")).withColumn("node", F.lit(1))
    got = rows(vectors.near_duplicates(df), "vec_id")
    assert len(got) == len(data)
    ok = [(i, np.array(x), y) for i, x, y in data if y is not None and x and None not in x and np.isfinite(x).all() and np.any(x)]
    links, hit = defaultdict(set), 0
    for i, a, y in ok:
        for j, b, z in ok:
            if i != j and y == z and len(a) == len(b) and a @ b >= 0.93 * np.sqrt(a @ a) * np.sqrt(b @ b):
                links[i].add(j)
    for i, _, _ in data:
        assert got[i].n_links <= len(links[i])
        hit += got[i].n_links
    assert hit >= 0.97 * sum(map(len, links.values())) and got[1007].n_links == 1 and got[1001].component_id == 0 and got[1002].component_id == 1002
    assert vectors.near_duplicates(df.limit(0)).count() == 0


# 10 -----------------------------------------------------------------------------------------------------------------
def test_toxicity_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = catalog.table(spark, sf, "documents"), catalog.table(spark, sf, "labels")
    got = toxicity.classify(docs, labels).join(labels, "doc_id").where("held_out").groupBy("toxic", "predicted").count().collect()
    n = {(r.toxic, r.predicted): r["count"] for r in got}
    assert n[1, 1] >= 0.9 * (n[1, 1] + n.get((1, 0), 0)) and n.get((0, 1), 0) <= 0.01 * n[0, 0]


def test_toxicity_of_odd_rows(spark, odd, nothing):
    got = toxicity.classify(odd, spark.createDataFrame([], LABELS)).collect()
    assert len(got) == 10 and all(r.score == 0 and r.predicted == 0 for r in got)
    assert toxicity.classify(nothing, spark.createDataFrame([], LABELS)).count() == 0
