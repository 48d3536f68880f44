"""Licence scan by a positional index of rare words.

The templates (short phrases and longer notices) are indexed by word: a posting is a template and the word's offset in it. A template is posted
under the two rarest words of its key phrases (rarity is the inverse document frequency over all files), a word that several templates share
holds several postings. In a file, the places of the posted words that it holds are looked up; a place less its posting's offset is where the
template would start, and the starts that both words of a template name, the intersection of their postings by relative position, are
verified: all key phrases must stand word by word. The rest of a notice may differ: the weight of its words that match, in place,
is the score. Index, keys and weights are constant tables, so the plan doesn't grow with the number of templates.
"""

from __future__ import annotations

import json
import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
# What separates words once A-Z are lower-case; here texts keep their case and A-Z belong to words.
WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


@dataclass(frozen=True)
class Template:
    """``words`` of a notice; ``keys`` are the phrases in it that must stand at their places. ``base``: the words are the key."""

    label: str
    words: tuple[str, ...]
    keys: tuple[tuple[str, ...], ...]
    base: bool = False

    def key_places(self) -> list[tuple[int, str]]:
        out = set()
        for key in self.keys:
            at = next(i for i in range(len(self.words)) if self.words[i : i + len(key)] == key)
            out |= {(at + j, w) for j, w in enumerate(key)}
        return sorted(out)


def _t(label: str, text: str, *keys: str, base: bool = False) -> Template:
    return Template(label, tuple(text.split()), tuple(tuple(k.split()) for k in keys or (text,)), base)


# Public licence names and the notices that carry them.
BASE = [_t("mit", "mit license", base=True), _t("apache", "apache license", base=True), _t("gpl", "general public license", base=True)]
NOTICES = [
    _t("mit-notice", "released under the mit license", "the mit license"),
    _t("mit-text", "permission is hereby granted free of charge to any person obtaining a copy of this software", "hereby granted free of charge", "obtaining a copy"),
    _t("apache-2.0", "licensed under the apache license version 2 0", "apache license version 2 0"),
    _t("gpl-2.0", "licensed under the gnu general public license version 2", "gnu general public license version 2"),
    _t("gpl-3.0", "licensed under the gnu general public license version 3", "gnu general public license version 3"),
    _t("lgpl", "under the terms of the gnu lesser general public license", "gnu lesser general public license"),
    _t("agpl", "under the terms of the gnu affero general public license", "gnu affero general public license"),
    _t("cc-by-nc-4.0", "licensed under cc by nc 4 0", "cc by nc 4 0"),
    _t("cc-by-4.0", "licensed under cc by 4 0", "cc by 4 0"),
    _t("cc-by-sa-4.0", "licensed under cc by sa 4 0", "cc by sa 4 0"),
    _t("cc0", "dedicated to the public domain under cc0 1 0 universal", "cc0 1 0"),
    _t("bsd", "redistribution and use in source and binary forms with or without modification are permitted", "source and binary forms", "with or without modification"),
    _t("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", "use copy modify", "with or without fee"),
    _t("mpl-2.0", "subject to the terms of the mozilla public license v 2 0", "mozilla public license"),
    _t("unlicense", "this is free and unencumbered software released into the public domain", "free and unencumbered software"),
]
TEMPLATES = BASE + NOTICES


def words_of(text: Column) -> Column:
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(WORD), F.lit(0))


def lowered(word: Column) -> Column:
    return F.translate(word, UPPER, LOWER)


def rarity(docs: DataFrame, text: str = "text", templates: list[Template] = TEMPLATES) -> dict[str, float]:
    """ln((files + 1) / (files with the word + 1)) + 1 of every template word, counted over all files; a number for each template word, no more."""
    vocabulary = sorted({w for t in templates for w in t.words})
    words = docs.select(words_of(F.col(text)).alias("w"))
    met = F.array_intersect(F.transform(F.filter("w", lambda x: F.lower(x).isin(vocabulary)), lowered), F.array(*map(F.lit, vocabulary)))
    # An empty text stands for the file itself, so one pass counts both.
    counts = words.select(F.explode(F.concat(met, F.array(F.lit("")))).alias("word")).groupBy("word").count()
    df = {r["word"]: r["count"] for r in counts.collect()}
    return {w: math.log((df.get("", 0) + 1) / (df.get(w, 0) + 1)) + 1 for w in vocabulary}


def anchors(t: Template, idf: dict[str, float]) -> list[tuple[int, str]]:
    """(offset, word) of the two rarest different key words, one if there is no other: what the template is posted under."""
    best: list[tuple[int, str]] = []
    for offset, word in sorted(t.key_places(), key=lambda p: (-idf[p[1]], p[1], p[0])):
        if word not in [w for _, w in best]:
            best.append((offset, word))
    return best[:2]


def _index(templates: list[Template], idf: dict[str, float]) -> tuple[Column, Column, list[str]]:
    """Postings by word, what is verified and weighed of each template, and the posted words."""
    postings: dict[str, list[dict]] = {}
    entries = []
    for k, t in enumerate(templates):
        posted, total = anchors(t, idf), sum(idf[w] for w in t.words)
        for offset, word in posted:
            postings.setdefault(word, []).append({"t": k, "j": offset})
        weighed = [] if t.base else [{"j": j, "w": w, "x": idf[w] / total} for j, w in enumerate(t.words)]
        entries.append({"label": t.label, "base": t.base, "n": len(posted), "keys": [{"j": j, "w": w} for j, w in t.key_places()], "words": weighed})
    word = "array<struct<j:int,w:string%s>>"
    of = F.from_json(F.lit(json.dumps(postings)), "map<string,array<struct<t:int,j:int>>>")
    what = F.from_json(F.lit(json.dumps(entries)), f"array<struct<label:string,base:boolean,n:int,keys:{word % ''},words:{word % ',x:double'}>>")
    return of, what, sorted(postings)


def scan(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", templates: list[Template] = TEMPLATES) -> DataFrame:
    """One row for each row of ``docs``: its id, ``n_words``, ``places`` (label, base, start) of every template found, ``coverage`` (of the best notice).

    Texts are scanned whole, null texts are empty, repeated rows stay repeated and other columns are ignored. Everything
    happens in the row: nothing but one count for each template word is shuffled. Starts are grouped by sorting them, so a text costs
    about its words and its postings, however many templates there are.
    """
    postings, entries, posted = _index(templates, rarity(docs, text, templates))
    words = docs.select(F.col(doc_id).alias("doc_id"), words_of(F.col(text)).alias("w"))
    spots = F.filter(F.transform("w", lambda x, i: F.struct(i.alias("i"), F.lower(x).alias("w"))), lambda x: x["w"].isin(posted))
    # A start in one number, template first; a start before the text is moved along with all others and fails the verification.
    longest = max((len(t.words) for t in templates), default=0)
    start = lambda p, i: p["t"].cast("long") * (1 << 32) + (i - p["j"] + longest).cast("long")
    named = F.sort_array(F.flatten(F.transform("spots", lambda x: F.transform(F.element_at(postings, x["w"]), lambda p: start(p, x["i"])))))
    template = lambda c: F.get(entries, F.shiftright(c, 32).cast("int"))
    # Different posted words name a start once each: it is in the intersection if it comes as often as its template has posted words.
    both = F.filter("named", lambda c, k: F.get("named", k + template(c)["n"] - 1) == c)
    first = F.array_distinct(both)
    begin = lambda c: (c.bitwiseAND(F.lit((1 << 32) - 1)) - longest).cast("int")
    stands = lambda c: F.forall(template(c)["keys"], lambda k: lowered(F.get("w", begin(c) + k["j"])) == k["w"])
    weight = lambda c: F.aggregate(template(c)["words"], F.lit(0.0), lambda a, x: a + F.when(lowered(F.get("w", begin(c) + x["j"])) == x["w"], x["x"]).otherwise(0.0))
    place = lambda c: F.struct(template(c)["label"].alias("label"), template(c)["base"].alias("base"), begin(c).cast("long").alias("start"), weight(c).alias("weight"))
    found = words.select("doc_id", "w", spots.alias("spots")).select("doc_id", "w", named.alias("named")).select("doc_id", "w", first.alias("starts"))
    found = found.select("doc_id", F.size("w").cast("long").alias("n_words"), F.transform(F.filter("starts", stands), place).alias("found"))
    plain = F.transform("found", lambda p: F.struct(p["label"], p["base"], p["start"]))
    return found.select("doc_id", "n_words", plain.alias("places"), F.coalesce(F.array_max(F.transform("found", lambda p: p["weight"])), F.lit(0.0)).alias("coverage"))


def digest(found: DataFrame) -> DataFrame:
    """Counts and labels of :func:`scan`. The score is the best notice's share of matched weight; phrases alone score a half."""
    base = F.transform(F.filter("places", lambda p: p["base"]), lambda p: p["start"])
    names = lambda some: F.array_join(F.array_sort(F.array_distinct(F.transform(some, lambda p: p["label"]))), ",")
    return found.select(
        "doc_id", "n_words", F.size(base).cast("long").alias("n_base"), F.array_min(base).alias("first_word"), F.array_max(base).alias("last_word"),
        names(F.filter("places", lambda p: p["base"])).alias("base_labels"), names(F.col("places")).alias("labels"),
        F.round(F.greatest(F.least("coverage", F.lit(1.0)), F.when(F.size(base) > 0, 0.5).otherwise(0.0)), 6).alias("score"),
    )
