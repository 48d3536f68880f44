"""Token counts by a whole-token shortcut, for byte-level BPE with word ends (a ``tokenizers`` .json file).

Offline, every vocabulary string with a word end is put through the merges; those that come out as one token are the shortcut.
A pre-token in it counts one; only the others are merged, once for each worker and different pre-token.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Counts that a worker remembers besides the shortcut; then it forgets them and starts anew.
REMEMBERED = 400_000
NO_RANK = 1 << 60


def byte_letters() -> list[str]:
    """The printable character that stands for each byte: itself where it is visible, else the next free one from 256 on."""
    visible = {*range(33, 127), *range(161, 173), *range(174, 256)}
    hidden = [b for b in range(256) if b not in visible]
    return [chr(b) if b in visible else chr(256 + hidden.index(b)) for b in range(256)]


class Merges:
    """Vocabulary and merges of a tokenizer file whose steps are those that :meth:`check` asks for."""

    def __init__(self, text: str):
        spec = json.loads(text)
        model = spec["model"]
        self.check(spec)
        self.end = model["end_of_word_suffix"]
        self.rank = {tuple(m.split(" ") if isinstance(m, str) else m): k for k, m in enumerate(model["merges"])}
        self.vocab = model["vocab"]
        self.letters = byte_letters()
        self.added = [t["content"] for t in spec["added_tokens"]]
        self.pattern = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]

    @staticmethod
    def check(spec: dict) -> None:
        steps = [n["type"] for n in spec["normalizer"]["normalizers"]]
        split, level = spec["pre_tokenizer"]["pretokenizers"]
        model = spec["model"]
        if steps != ["NFC", "Replace", "Lowercase"] or (split["behavior"], split["invert"], level["add_prefix_space"], level["use_regex"]) != ("Removed", True, False, False):
            raise ValueError("another normalizer or pre-tokenizer than this operator knows")
        if model["type"] != "BPE" or not model["end_of_word_suffix"] or model["continuing_subword_prefix"] or model["dropout"] or model["ignore_merges"]:
            raise ValueError("BPE with word ends is needed")
        if any(t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"] for t in spec["added_tokens"]):
            raise ValueError("added tokens must match as they stand")

    def tokens(self, word: str) -> list[str]:
        """Merge the pair of the lowest rank, the leftmost first, as long as one has a rank."""
        parts = [self.letters[b] for b in word.encode()]
        parts[-1] += self.end
        if len(parts) > 64:
            return self._queued(parts)
        rank = self.rank.get
        ranks = [rank(pair, NO_RANK) for pair in zip(parts, parts[1:], strict=False)]
        while ranks and (best := min(ranks)) != NO_RANK:
            at = ranks.index(best)
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
            del ranks[at]
            if at:
                ranks[at - 1] = rank((parts[at - 1], parts[at]), NO_RANK)
            if at < len(ranks):
                ranks[at] = rank((parts[at], parts[at + 1]), NO_RANK)
        return parts

    def _queued(self, parts: list[str]) -> list[str]:
        """The same with a queue of pairs, for pre-tokens so long that looking for the next pair would take their square."""
        size = len(parts)
        after, before = list(range(1, size + 1)), list(range(-1, size - 1))
        queue = [(r, k, parts[k], parts[k + 1]) for k in range(size - 1) if (r := self.rank.get((parts[k], parts[k + 1]))) is not None]
        heapq.heapify(queue)
        while queue:
            _, k, left, right = heapq.heappop(queue)
            n = after[k]
            if parts[k] != left or n >= size or parts[n] != right:
                continue
            parts[k], parts[n], after[k] = left + right, "", after[n]
            if after[n] < size:
                before[after[n]] = k
            for i, j in ((before[k], k), (k, after[k])):
                if i >= 0 and j < size and (r := self.rank.get((parts[i], parts[j]))) is not None:
                    heapq.heappush(queue, (r, i, parts[i], parts[j]))
        return [p for p in parts if p]

    def whole(self) -> list[str]:
        """Vocabulary strings that encode alone as one token."""
        back = {c: b for b, c in enumerate(self.letters)}
        out = []
        for piece in self.vocab:
            if piece.endswith(self.end) and len(piece) > len(self.end) and all(c in back for c in piece[: -len(self.end)]):
                raw = bytes(back[c] for c in piece[: -len(self.end)])
                try:
                    word = raw.decode()
                except UnicodeDecodeError:
                    continue
                if self.tokens(word) == [piece]:
                    out.append(word)
        return sorted(out)


def splitter(pattern: str) -> regex.Pattern:
    return regex.compile(pattern.replace(r"\s", r"\p{White_Space}"), regex.V0)


def odd_characters(text: str, merges: Merges) -> dict[int, tuple[str, str]]:
    """Characters newer than Python's tables: what the library makes of their case, and a letter, digit or point of the same kind for it.

    The library, Python and the pattern engine follow different editions of Unicode, so the library is asked about every character that Python
    doesn't know, in the planes that have letters; here are those where it and this module differ.
    """
    import tokenizers

    library, split = tokenizers.Tokenizer.from_str(text), splitter(merges.pattern)
    out = {}
    for k in range(0x40000):
        c = chr(k)
        if unicodedata.category(c) != "Cn":
            continue
        low = library.normalizer.normalize_str(c)
        pieces = lambda s: len(library.pre_tokenizer.pre_tokenize_str(s))
        kind = "a" if pieces("a" + low) == 1 else "." if pieces("." + low) == 1 else "1"
        mine = "a" if len(split.findall("a" + c)) == 1 else "." if len(split.findall("." + c)) == 1 else "1"
        if low != c or kind != mine:
            out[k] = (low, kind * len(low))
    return out


class Counter(dict):
    """Pre-token to its number of tokens."""

    def __init__(self, merges: Merges, whole: list[str], odd: dict[int, tuple[str, str]] | None = None):
        super().__init__(dict.fromkeys(whole, 1))
        self.merges, self.whole = merges, whole
        # Beyond the first plane the mapping alone tells: a class of thousands of such characters would be tried one by one.
        self.odd = re.compile("[" + "".join(chr(k) for k in odd if k < 0x10000) + "\U00010000-\U0003ffff]") if odd else None
        self.lowers, self.kinds = ({k: x[j] for k, x in (odd or {}).items()} for j in (0, 1))
        self.split = splitter(merges.pattern)
        self.special = regex.compile("|".join(map(regex.escape, sorted(merges.added, key=len, reverse=True)))) if merges.added else None

    def __missing__(self, word: str) -> int:
        if len(self) > len(self.whole) + REMEMBERED:
            self.clear()
            self.update(dict.fromkeys(self.whole, 1))
        self[word] = n = len(self.merges.tokens(word))
        return n

    def words(self, text: str) -> list[str]:
        # NFC, then lower case code point by code point: a final sigma stays an ordinary one.
        text = unicodedata.normalize("NFC", text) if not text.isascii() else text
        text = text.replace("Σ", "σ").lower()
        if self.odd is None or text.isascii() or not self.odd.search(text):
            return self.split.findall(text)
        kinds, text = text.translate(self.kinds), text.translate(self.lowers)
        return [text[m.start() : m.end()] for m in self.split.finditer(kinds)]

    def count(self, text: str) -> int:
        if self.special is None or not self.special.search(text):
            return sum(map(self.__getitem__, self.words(text)))
        parts = self.special.split(text)
        return len(parts) - 1 + sum(sum(map(self.__getitem__, self.words(p))) for p in parts)


_COUNTERS: dict[str, Counter] = {}


def _counter(digest: str, shared: Broadcast) -> Counter:
    """The worker's counter; it outlives a task."""
    if digest not in _COUNTERS:
        _COUNTERS.clear()
        spec, whole, odd = shared.value
        _COUNTERS[digest] = Counter(Merges(spec), whole, odd)
    return _COUNTERS[digest]


def count_tokens(docs: DataFrame, tokenizer: str, doc_id: str = "doc_id", text: str = "text", limit: int = 2048) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit (more than ``limit`` tokens) of each row; ``tokenizer`` is the .json text.

    Special strings inside texts are their tokens, as is the library's default; none are added. Null texts are empty (no tokens),
    repeated rows stay repeated, other columns are ignored. Nothing is shuffled; what is broadcast is the vocabulary. A worker
    holds one batch of texts and REMEMBERED counts.
    """
    merges = Merges(tokenizer)
    shared = docs.sparkSession.sparkContext.broadcast((tokenizer, merges.whole(), odd_characters(tokenizer, merges)))
    digest = hashlib.md5(tokenizer.encode()).hexdigest()

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _counter(digest, shared)
        for batch in batches:
            n = [counter.count(t.as_py()) if t.is_valid else 0 for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(n, pa.int64()), pa.array([x > limit for x in n], pa.bool_())], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("t"), F.coalesce(F.octet_length(F.col(text)), F.lit(0)).cast("long").alias("n_bytes"))
    return rows.mapInArrow(counted, f"doc_id {dict(rows.dtypes)['doc_id']}, n_bytes bigint, n_tokens bigint, over_limit boolean")
