"""SentencePiece encoding and decoding as a relational lattice, for BPE models.

Texts fall into units (blanks with the word after them) that no piece crosses. The different units of all texts are the words of the
lattice: their substrings of bounded length are exploded and joined to the piece table, the edges are grouped by unit, and a fold over
them gives the pieces. A BPE model's best path is not the one of the highest score but what its merges make, so the fold
takes the edges by rank and joins an edge's two symbols where exactly two are left between its ends; the state is one bit for each place
between characters. Strings too long for the bits of a long are merged by a queue. Frequent units pass the lattice once and reach their places
by a broadcast of bounded size. The others are cut where no piece holds the two characters that meet, which no merge can cross; frequent parts
are in the broadcast too, and every other part passes the lattice where it stands, as a row before that of its texts.
"""

from __future__ import annotations

import ctypes
import heapq
import re
import uuid
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain
from operator import add

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barloom.session import discard, materialize, store

BLANK = "\u2581"
LONGEST = 61
#: Units and parts in the broadcast dictionary; each other part goes through the lattice where it stands.
FREQUENT = 1_000_000
#: Different units that a task counts at once, and how often it must see a string to name it for the dictionary.
COUNTED, SEEN = 100_000, 2
#: Strings whose edges a task sorts.
UNITS_IN_TASK = 30_000
#: Characters of the texts whose parts become rows at once; their ids make a row of some 400 KB.
TEXT_AT_ONCE = 500_000
#: Stands among ids for a part whose ids come from the lattice later.
HOLE = np.array([-1], dtype="<i4").tobytes()


@dataclass(frozen=True)
class Pieces:
    """A model: (piece, id, rank) that merges may make, the id of byte 0, how each id reads in hexadecimal, characters that no piece holds."""

    rows: tuple[tuple[str, int, int], ...]
    byte_zero: int
    reads: tuple[str, ...]
    apart: str
    dummy: bool

    @property
    def longest(self) -> int:
        return max(len(p) for p, _, _ in self.rows)

    @property
    def singles(self) -> tuple[str, list[int]]:
        """The characters that are pieces, in the order of rank, and their ids."""
        some = sorted((r, k, p) for p, k, r in self.rows if len(p) == 1)
        return "".join(p for _, _, p in some), [k for _, k, _ in some]


def load(path: str) -> Pieces:
    """Read a .model file; only BPE models with byte fallback and no normalization rules are known here."""
    from sentencepiece import sentencepiece_model_pb2

    m = sentencepiece_model_pb2.ModelProto()
    with open(path, "rb") as f:
        m.ParseFromString(f.read())
    if m.trainer_spec.model_type != 2 or not m.trainer_spec.byte_fallback or m.normalizer_spec.precompiled_charsmap or m.normalizer_spec.remove_extra_whitespaces or any(p.type in (4, 5) for p in m.pieces):
        raise ValueError("a BPE model with byte fallback, without normalization, user-defined and unused pieces is needed")
    order = {s: k for k, s in enumerate(sorted({p.score for p in m.pieces if p.type == 1}, reverse=True))}
    rows = tuple((p.piece, k, order[p.score]) for k, p in enumerate(m.pieces) if p.type == 1)
    if any(BLANK in p.lstrip(BLANK) for p, _, _ in rows):
        raise ValueError("a piece crosses units")
    byte_zero = next(k for k, p in enumerate(m.pieces) if p.piece == "<0x00>")
    reads = tuple(p.piece[3:5] if p.type == 6 else p.piece.replace(BLANK, " ").encode().hex() if p.type == 1 else "" for p in m.pieces)
    held = {c for p, _, _ in rows for c in p}
    return Pieces(rows, byte_zero, reads, "".join(c for c in "\n\r\t" if c not in held), m.normalizer_spec.add_dummy_prefix)


def table(spark: SparkSession, pieces: Pieces) -> DataFrame:
    return spark.createDataFrame(list(pieces.rows), "piece string, id int, rank int")


class Cutter:
    """Cuts texts into units, and units between characters that stand side by side in no piece."""

    def __init__(self, pieces: Pieces):
        stop = re.escape(BLANK + pieces.apart)
        self.find = re.compile(f"{BLANK}+[^{stop}]*|[^{stop}]+" + (f"|[{re.escape(pieces.apart)}]+" if pieces.apart else "")).findall
        self.first = BLANK if pieces.dummy else ""
        self.apart, self.held = pieces.apart, {p[k : k + 2] for p, _, _ in pieces.rows for k in range(len(p) - 1)}
        # Characters of pieces by number, 0 for all others, and which numbers stand side by side.
        chars = sorted({c for pair in self.held for c in pair})
        self.number = np.zeros(0x110000, np.int32)
        self.number[list(map(ord, chars))] = np.arange(1, len(chars) + 1)
        self.count = len(chars) + 1
        self.beside = np.zeros(self.count * self.count, bool)
        for a, b in self.held:
            self.beside[int(self.number[ord(a)]) * self.count + int(self.number[ord(b)])] = True

    def units(self, text: str | None) -> list[str]:
        return self.find(self.first + text.replace(" ", BLANK)) if text else []

    def parts(self, unit: str) -> list[str]:
        held = self.held
        ends = [k for k, pair in enumerate(map(add, unit, unit[1:]), 1) if pair not in held]
        return [unit[i:j] for i, j in zip([0, *ends], [*ends, len(unit)], strict=True)] if ends else [unit]

    def all_units(self, texts: pa.Array) -> tuple[np.ndarray, pa.Array]:
        """Number of units of each text, and the units of all as :meth:`units` gives them."""
        marks = pc.match_substring_regex(texts, "[\\x00-\\x02]")
        if pc.any(marks).as_py():
            cut = [self.units(t) for t in texts.to_pylist()]
            return np.fromiter(map(len, cut), np.int64, len(cut)), pa.array(chain.from_iterable(cut), pa.string())
        put = lambda x, a, b: pc.replace_substring(x, a, b)
        # Empty texts become null; in pyarrow, if_else on a slice of strings gives wrong ones.
        none = pc.fill_null(pc.equal(texts, ""), True).to_numpy(zero_copy_only=False)
        texts = texts.take(pa.array(np.arange(len(texts)), mask=none))
        found = put(pc.binary_join_element_wise(self.first, texts, ""), " ", BLANK)
        found = put(put(found, BLANK, "\x02" + BLANK), BLANK + "\x02", BLANK)
        for c in self.apart:
            found = put(found, c, f"\x00{c}\x01")
        for a, b in (("\x01\x00", ""), ("\x01", "\x00"), ("\x02", "\x00")):
            found = put(found, a, b)
        lists = pc.split_pattern(found, "\x00")
        units, ends = lists.flatten(), _ends(lists)
        some = pc.not_equal(units, "")
        before = np.r_[0, np.cumsum(some.to_numpy(zero_copy_only=False), dtype=np.int64)]
        return np.diff(before[ends]), units.filter(some)

    def all_parts(self, units: list[str]) -> tuple[np.ndarray, list[str]]:
        """Number of parts of each unit, and the parts of all as :meth:`parts` gives them."""
        whole, ends = "".join(units), np.cumsum(np.fromiter(map(len, units), np.int64, len(units)))
        if not whole:
            return np.zeros(0, np.int64), []
        code = self.number[np.frombuffer(whole.encode("utf-32-le", "surrogatepass"), "<u4")]
        cut = np.r_[~self.beside[code[:-1].astype(np.int64) * self.count + code[1:]], True]
        cut[ends - 1] = True
        at, places = np.flatnonzero(cut) + 1, np.r_[0, np.cumsum(cut)]
        return np.diff(np.r_[0, places[ends]]), [whole[i:j] for i, j in zip(np.r_[0, at[:-1]].tolist(), at.tolist(), strict=True)]

    def often(self, seen: dict[str, int], least: int = SEEN) -> Counter[str]:
        """Of counted units those seen often, and the parts of the others that were seen ``least`` times."""
        fit = lambda u, n, least: n >= least and 1 < len(u) <= LONGEST
        parts: dict[str, int] = {}
        rest = [(unit, n) for unit, n in seen.items() if not fit(unit, n, SEEN)]
        many, found = self.all_parts([unit for unit, _ in rest])
        for part, n in zip(found, np.repeat(np.array([n for _, n in rest], np.int64), many).tolist(), strict=True):
            parts[part] = parts.get(part, 0) + n
        out = Counter({u: n for u, n in seen.items() if fit(u, n, SEEN)})
        out.update({u: n for u, n in parts.items() if fit(u, n, least)})
        return out


class Placer(Cutter):
    """Puts the dictionary's ids at their places in a text."""

    def __init__(self, pieces: Pieces, units: pa.Array, ids: pa.ListArray, _: np.ndarray):
        super().__init__(pieces)
        ends, packed = 4 * ids.offsets.to_numpy(), ids.values.to_numpy().tobytes()
        self.known = {u: packed[i:j] for u, i, j in zip(_objects(units), ends[:-1].tolist(), ends[1:].tolist(), strict=True)}
        self.ranks, self.byte_zero = {p: (r, k) for p, k, r in pieces.rows}, pieces.byte_zero

    def part(self, part: str, holes: list[str]) -> bytes:
        if (ids := self.known.get(part)) is not None:
            return ids
        # One character has no edges; a part with too many characters for the fold has its own way.
        if len(part) == 1 or len(part) > LONGEST:
            return np.array([k for k, _ in merge(part, self.ranks, self.byte_zero)], dtype="<i4").tobytes()
        holes.append(part)
        return HOLE

    def place(self, text: str | None) -> tuple[int, np.ndarray, np.ndarray, list[str]]:
        """Number of units, the ids that are known, and of the other parts how many of these stand before them."""
        units, holes = self.units(text), []
        found = list(map(self.known.get, units))
        if None in found:
            found = [b"".join([self.part(p, holes) for p in self.parts(u)]) if ids is None else ids for u, ids in zip(units, found, strict=True)]
        ids = np.frombuffer(b"".join(found), dtype="<i4")
        at = np.flatnonzero(ids < 0)
        return len(units), ids[ids >= 0], at - np.arange(at.size), holes


class BatchPlacer(Cutter):
    """Puts the dictionary's ids at their places in many texts at once. The dictionary stays in Arrow, in order of the strings' CRC-32."""

    def __init__(self, pieces: Pieces, units: pa.Array, ids: pa.ListArray, codes: np.ndarray):
        super().__init__(pieces)
        self.known, self.ids, self.codes = units, ids, codes
        self.ranks, self.byte_zero = {p: (r, k) for p, k, r in pieces.rows}, pieces.byte_zero

    def at(self, strings: pa.Array) -> pa.Array:
        """The place of each string in the dictionary or null; one whose code comes first with another string isn't found."""
        if not len(self.known):
            return pa.nulls(len(strings), pa.int64())
        codes = np.fromiter(map(zlib.crc32, _objects(strings.cast(pa.binary()))), np.uint32, len(strings))
        at = np.minimum(np.searchsorted(self.codes, codes), len(self.known) - 1)
        return pa.array(at, mask=~pc.equal(self.known.take(pa.array(at)), strings).to_numpy(zero_copy_only=False))

    def place(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[str]]:
        """Number of units of each text, the ids of all, where each text's begin and end, and the different other parts; -1 - k stands for the part k."""
        many, each = self.all_units(texts)
        each = each.dictionary_encode()
        at = self.at(each.dictionary)
        rest = each.dictionary.filter(at.is_null())
        sizes, parts = self.all_parts(_objects(rest))
        some = pa.array(parts, pa.string()).dictionary_encode()
        where, holes, own = self.at(some.dictionary), [], []
        for part, known in zip(_objects(some.dictionary), where.is_valid().to_numpy(zero_copy_only=False).tolist(), strict=True):
            # One character has no edges; a part with too many characters for the fold has its own way.
            if not known and (len(part) == 1 or len(part) > LONGEST):
                own.append([k for k, _ in merge(part, self.ranks, self.byte_zero)])
            elif not known:
                holes.append(part)
                own.append([-len(holes)])
        # The ids of the different parts, then of the different units, then of all units.
        of_parts = self.mixed(where, pa.array(own, pa.list_(pa.int32()))).take(some.indices)
        of_rest = pa.ListArray.from_arrays(pa.array(_ends(of_parts)[np.r_[0, np.cumsum(sizes)]].astype(np.int32)), of_parts.flatten())
        of_all = self.mixed(at, of_rest).take(each.indices)
        return many, of_all.flatten().to_numpy(), _ends(of_all)[np.r_[0, np.cumsum(many)]], holes

    def mixed(self, at: pa.Array, others: pa.ListArray) -> pa.ListArray:
        """The dictionary's ids at ``at``; for its nulls the lists ``others``, in order."""
        both = pa.concat_arrays([self.ids.take(at.drop_null()), others])
        missing = at.is_null().to_numpy(zero_copy_only=False)
        order = np.empty(len(at), np.int64)
        order[~missing], order[missing] = np.arange(len(at) - missing.sum()), np.arange(len(at) - missing.sum(), len(at))
        return both.take(pa.array(order))


def _objects(strings: pa.Array) -> list[str] | list[bytes]:
    """Python's strings, faster than by ``to_pylist``."""
    return strings.to_numpy(zero_copy_only=False).tolist()


def _ends(lists: pa.ListArray) -> np.ndarray:
    """Where each list begins and ends among the values of all."""
    return np.r_[0, np.cumsum(pc.fill_null(lists.value_lengths(), 0).to_numpy(zero_copy_only=False), dtype=np.int64)]


def _give_back() -> None:
    """Returns a worker's unused memory to the system, which it otherwise keeps for its next task, beside the workers of that stage."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


_PLACERS: dict[str, Placer | BatchPlacer] = {}


def _placer(name: str, shared: Broadcast, kind: type[Placer | BatchPlacer]) -> Placer | BatchPlacer:
    """The worker's dictionary; it outlives a task, unless the worker is given one that needs none."""
    if name not in _PLACERS:
        _PLACERS.clear()
        _PLACERS[name] = kind(*shared.value)
    return _PLACERS[name]


def _shift(a: Column, n: Column) -> Column:
    return F.call_function("shiftleft", a, n.cast("int"))


def _back(a: Column, n: Column) -> Column:
    return F.call_function("shiftright", a, n.cast("int"))


def edges(rows: DataFrame, pieces: Pieces) -> DataFrame:
    """Adds to each row's ``unit`` the pieces of two and more characters in it, one row for each ``edge``, and before them one row without an edge;
    one number holds rank, start, length and id. Rows without a unit pass once.

    The piece table is broadcast, as large as the model, and joined by a hash of 64 bits before pieces are compared; rows stay where they are, in their order.
    """
    model = table(rows.sparkSession, pieces).where(F.length("piece") > 1).select(F.xxhash64("piece").alias("key"), F.col("piece").alias("held"), "id", "rank")
    size = lambda c: F.coalesce(F.length(c), F.lit(1))
    at = rows.select("*", F.explode(F.sequence(F.lit(1), size("unit"))).alias("from"))
    at = at.select("*", F.substring("unit", F.col("from"), F.lit(pieces.longest)).alias("tail")).where((F.col("from") == 1) | (F.length("tail") > 1))
    cut = at.select("*", F.explode(F.sequence(F.when(F.col("from") == 1, 1).otherwise(2), size("tail"))).alias("n")).select("*", F.substring("tail", F.lit(1), F.col("n")).alias("piece"))
    found = cut.withColumn("key", F.xxhash64("piece")).join(F.broadcast(model), "key", "left")
    # What is no piece goes here, but for one row of each unit.
    found = found.where((F.col("held") == F.col("piece")) | (F.col("n") == 1))
    one = lambda x, by: x.cast("long") * (1 << by)
    edge = F.when(F.col("n") > 1, one(F.col("rank"), 42) + one(F.col("from") - 1, 36) + one(F.col("n"), 30) + F.col("id"))
    return found.select(*rows.columns, "n", edge.alias("edge"))


def lattice(rows: DataFrame, pieces: Pieces, by: list[str]) -> DataFrame:
    """(*by, edges): :func:`edges` of each row, sorted by rank, start and length; of each the bits it spans, those at its ends, and start, length and id.

    ``by`` names a row and holds the unit; rows that are already partitioned by some of it stay where they are. Rows are numbered in place, so that
    the sort by which they are grouped finds them in order.
    """
    found = edges(rows.select(F.monotonically_increasing_id().alias("row"), *by), pieces)
    long = lambda x: F.lit(x).cast("long")
    start, length = lambda e: _back(e, F.lit(36)).bitwiseAND(long(63)), lambda e: _back(e, F.lit(30)).bitwiseAND(long(63))
    span = lambda e: F.struct(_shift(_shift(long(2), length(e)) - 1, start(e)).alias("all"), _shift(_shift(long(1), length(e)) + 1, start(e)).alias("ends"), e.bitwiseAND(long((1 << 42) - 1)).alias("e"))
    return found.groupBy("row", *by).agg(F.sort_array(F.collect_list("edge")).alias("edges")).select(*by, F.transform("edges", span).alias("edges"))


def _in_runs(rows: DataFrame, pieces: Pieces, held: list[str]) -> DataFrame:
    """(*held, unit, edges) as :func:`lattice`, of rows (*held, unit): a unit's edges stand one after another, so they are gathered where they are, some at a time."""
    found = edges(rows, pieces).select(*held, F.when(F.col("edge").isNull(), F.col("unit")).alias("unit"), "edge")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def gathered(batch: pa.RecordBatch, first: np.ndarray) -> pa.RecordBatch:
            edge = batch.column("edge")
            before = np.r_[0, np.cumsum(edge.is_valid().to_numpy(zero_copy_only=False))][np.r_[first, batch.num_rows]]
            e = edge.drop_null().to_numpy()
            e = e[np.lexsort((e, np.repeat(np.arange(first.size), np.diff(before))))]
            start, n = e >> 36 & 63, e >> 30 & 63
            spans = pa.StructArray.from_arrays([pa.array(((2 << n) - 1) << start), pa.array(((1 << n) + 1) << start), pa.array(e & ((1 << 42) - 1))], ["all", "ends", "e"])
            return pa.RecordBatch.from_arrays([*batch.select([*held, "unit"]).take(pa.array(first)).columns, pa.ListArray.from_arrays(pa.array(before.astype(np.int32)), spans)], [*held, "unit", "edges"])

        _PLACERS.clear()
        _give_back()
        rest = None
        for batch in batches:
            if batch.num_rows:
                batch = batch if rest is None else pa.concat_batches([rest, batch])
                # A unit's first row has no edge; the last unit may go on in the next batch.
                first = np.flatnonzero(batch.column("edge").is_null().to_numpy(zero_copy_only=False))
                if first.size > 1:
                    yield gathered(batch.slice(0, first[-1]), first[:-1])
                rest = batch.slice(first[-1])
        if rest is not None:
            yield gathered(rest, np.array([0]))
        _give_back()

    fields = [found.schema[c] for c in [*held, "unit"]]
    return found.mapInArrow(run, T.StructType([*fields, *T.StructType.fromDDL("edges array<struct<all: bigint, ends: bigint, e: bigint>>").fields]))


def fold(edges: DataFrame, pieces: Pieces, by: list[str]) -> DataFrame:
    """(*by, ids) from :func:`lattice`; ids are (id, start) in order, the bytes of a character that is no piece have its start.

    The state is one bit for each place between characters. An edge joins its two symbols where its ends and just one place between are set;
    it is in the result where only its ends are left.
    """
    long = lambda x: F.lit(x).cast("long")
    start, size = lambda e: _back(e, F.lit(36)).bitwiseAND(long(63)), F.length("unit")

    def join(m: Column, x: Column) -> Column:
        joins = (F.bit_count(m.bitwiseAND(x["all"])) == 3) & (m.bitwiseAND(x["ends"]) == x["ends"])
        return F.when(joins, m.bitwiseAND(F.bitwise_not(x["all"])).bitwiseOR(x["ends"])).otherwise(m)

    done = edges.select(*by, "edges", F.aggregate("edges", _shift(long(1), size + 1) - 1, join).alias("cut"))
    done = done.select(*by, "cut", F.sort_array(F.transform(F.filter("edges", lambda x: F.col("cut").bitwiseAND(x["all"]) == x["ends"]), lambda x: x["e"])).alias("left"))
    token = lambda i, at: F.struct(i.cast("int").alias("id"), at.cast("int").alias("start"))
    ident = lambda e: e.bitwiseAND(long((1 << 30) - 1))
    # In order of place and byte: start, byte and id in one number.
    code = lambda k, j, i: _shift(k.cast("long"), F.lit(40)) + _shift(j.cast("long"), F.lit(32)) + i.cast("long")
    chars, numbers = pieces.singles
    numbers = F.split(F.lit(",".join(map(str, numbers))), ",").cast("array<int>")

    def symbol(k: Column) -> Column:
        char = F.substring("unit", k + 1, F.lit(1))
        letters = F.filter(F.split(F.hex(char), "(?<=\\G..)"), lambda h: h != "")
        found = F.call_function("instr", F.lit(chars), char)
        return F.when(found > 0, F.array(code(k, F.lit(0), F.get(numbers, found - 1)))).otherwise(F.transform(letters, lambda h, j: code(k, j, F.conv(h, 16, 10).cast("int") + pieces.byte_zero)))

    single = F.filter(F.sequence(F.lit(0), size - 1), lambda k: _back(F.col("cut"), k).bitwiseAND(long(3)) == 3)
    mixed = F.sort_array(F.concat(F.transform("left", lambda e: code(start(e), F.lit(0), ident(e))), F.flatten(F.transform(single, symbol))))
    whole = F.size("left") == F.bit_count("cut") - 1
    return done.select(*by, F.when(whole, F.transform("left", lambda e: token(ident(e), start(e)))).otherwise(F.transform(mixed, lambda c: token(c.bitwiseAND(long((1 << 32) - 1)), _back(c, F.lit(40))))).alias("ids"))


def merge(unit: str, ranks: dict[str, tuple[int, int]], byte_zero: int) -> list[tuple[int, int]]:
    """(id, start) of a unit of any length by a queue of the pairs that make a piece, the best rank and then the leftmost first."""
    parts, size = list(unit), len(unit)
    after, before = list(range(1, size + 1)), list(range(-1, size - 1))
    queue: list[tuple[int, int, str, str]] = []

    def offer(i: int, j: int) -> None:
        if i >= 0 and j < size and (made := ranks.get(parts[i] + parts[j])):
            heapq.heappush(queue, (made[0], i, parts[i], parts[j]))

    for k in range(size - 1):
        offer(k, k + 1)
    while queue:
        _, k, left, right = heapq.heappop(queue)
        n = after[k]
        if parts[k] != left or n >= size or parts[n] != right:
            continue
        parts[k], parts[n], after[k] = left + right, "", after[n]
        if after[n] < size:
            before[after[n]] = k
        offer(before[k], k)
        offer(k, after[k])
    return [(i, k) for k, p in enumerate(parts) if p for i in ([ranks[p][1]] if p in ranks else [byte_zero + b for b in p.encode()])]


def reading(ids: Column, pieces: Pieces) -> Column:
    """The text that ids stand for, before the leading blank goes."""
    reads = F.split(F.lit(",".join(pieces.reads)), ",")
    return F.decode(F.unhex(F.array_join(F.transform(ids, lambda k: F.get(reads, k)), "")), "UTF-8")


def _in_slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """The batch cut into some rows each, by the characters of its last column."""
    if batch.num_rows:
        sizes = np.cumsum(pc.fill_null(pc.utf8_length(batch.columns[-1]), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
        ends = np.flatnonzero(np.diff(sizes // TEXT_AT_ONCE, append=-1)) + 1
        for k, n in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True):
            yield batch.slice(k, n - k)


def _frequent(texts: DataFrame, pieces: Pieces, frequent: int, least: int) -> DataFrame:
    """(unit): at most ``frequent`` units and parts, from the most frequent down, of one column of texts.

    A task counts its units, at most COUNTED at once, and names those it sees often and the parts of the others that it sees ``least`` times. Only which
    strings are in the dictionary depends on it, never the ids; what is named once in all would gain nothing there. Frequencies come in steps of an eighth of a power of two, each in 64 by hash, of which whole
    ones are taken; nothing is sorted, and what reaches the driver are the steps.
    """
    spark = texts.sparkSession
    shared = spark.sparkContext.broadcast(pieces)

    def named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _PLACERS.clear()
        _give_back()
        cutter, seen = Cutter(shared.value), {}
        rows = lambda found: pa.RecordBatch.from_arrays([pa.array(found.keys(), pa.string()), pa.array(found.values(), pa.int64())], ["unit", "many"])
        for batch in chain.from_iterable(map(_in_slices, batches)):
            units = cutter.all_units(batch.column(0))[1].dictionary_encode()
            for unit, n in zip(_objects(units.dictionary), np.bincount(units.indices.to_numpy()).tolist(), strict=True):
                seen[unit] = seen.get(unit, 0) + n
            if len(seen) > COUNTED:
                found, seen = cutter.often(seen, least), {}
                yield rows(found)
                del found
                _give_back()
        found, seen = cutter.often(seen, least), {}
        yield rows(found)
        _give_back()

    counts = texts.mapInArrow(named, "unit string, many bigint").groupBy("unit").agg(F.sum("many").alias("many")).where("many > 1")
    step = F.floor(F.log2("many") * 8) * 64 + F.pmod(F.xxhash64("unit"), F.lit(64))
    counts, path = store(counts.select("unit", step.alias("step")), "units")
    left, least = frequent, None
    for r in counts.groupBy("step").count().orderBy(F.desc("step")).collect():
        left -= r["count"]
        if left < 0:
            break
        least = r["step"]
    taken = materialize(counts.where(F.col("step") >= F.lit(least)).select("unit"), "frequent")
    discard(spark, path)
    return taken


def _dictionary(docs: DataFrame, pieces: Pieces, text: str, frequent: int, least: int = SEEN) -> Broadcast:
    """The arguments of a placer; the frequent units and parts pass the lattice."""
    spark = docs.sparkSession
    once = _frequent(docs.select(F.col(text).alias("text")), pieces, frequent, least)
    words = fold(_in_runs(once.repartition(1 + frequent // UNITS_IN_TASK, "unit"), pieces, []), pieces, ["unit"])
    words = words.select("unit", F.col("ids")["id"].alias("ids"), F.crc32(F.col("unit").cast("binary")).alias("code")).toArrow().combine_chunks().sort_by("code")
    units, ids, codes = (c.chunk(0) if c.num_chunks else pa.array([], c.type) for c in words.combine_chunks().columns)
    ids = pa.ListArray.from_arrays(pa.array(_ends(ids).astype(np.int32)), ids.flatten())
    return spark.sparkContext.broadcast((pieces, units, ids, codes.to_numpy().astype(np.uint32)))


def _encoded(docs: DataFrame, pieces: Pieces, doc_id: str, text: str, keep: list[str], frequent: int = FREQUENT) -> DataFrame:
    """(doc_id, *keep, said, n_units, ids) of each row; ``said`` is the MD5 of its text, of an empty one for null.

    One pass over the texts, in which nothing is moved or written: the dictionary's ids are put at their places, the other parts of some texts stand as
    rows before the row of these texts, pass the lattice and are put at theirs. Copies are rows like all others, so no key is hot.
    """
    shared = _dictionary(docs, pieces, text, frequent, 1)
    name = uuid.uuid4().hex
    rows = docs.select(F.col(doc_id).alias("doc_id"), *[F.col(c) for c in keep], F.md5(F.coalesce(F.col(text), F.lit("")).cast("binary")).alias("said"), F.col(text).alias("whole"))
    fields = [T.StructField(f.name, f.dataType) for f in rows.schema.fields[:-1]] + T.StructType.fromDDL("n_units bigint").fields
    held, narrow = [f.name for f in fields], len(pieces.reads) <= 1 << 15
    numbers = lambda a: a.to_numpy(zero_copy_only=False)

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        placer = _placer(name, shared, BatchPlacer)
        for batch in chain.from_iterable(map(_in_slices, batches)):
            n, ids, ends, holes = placer.place(batch.columns[-1])
            ids = ids.astype(np.int16) if narrow and len(holes) <= 1 << 15 else ids
            texts = pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(n), pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(ids))], [*held, "ids"])
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, texts.schema) as out:
                out.write_batch(texts)
            # Rows of parts have nothing but their part, the row of the texts has no part.
            none = [None] * len(holes)
            yield pa.RecordBatch.from_arrays([pa.array([*none, sink.getvalue().to_pybytes()], pa.binary()), pa.array([*holes, None], pa.string())], ["row", "unit"])
        _give_back()

    parts = rows.mapInArrow(placed, "row binary, unit string")
    done = fold(_in_runs(parts, pieces, ["row"]), pieces, ["row", "unit"]).select("row", F.col("ids")["id"].alias("filled"))

    def filled(texts: pa.RecordBatch, values: np.ndarray, cuts: np.ndarray) -> pa.RecordBatch:
        """Texts with the ids of their other parts, of which part k has values[cuts[k] : cuts[k + 1]]."""
        ids, ends = numbers(texts.column("ids").values), numbers(texts.column("ids").offsets)
        at = np.flatnonzero(ids < 0)
        part = -1 - ids[at]
        if cuts.size - 1 != part.max(initial=-1) + 1:
            raise ValueError("parts don't stand before their row")
        size = np.diff(cuts)[part]
        many = np.ones(ids.size, np.int64)
        many[at] = size
        to = np.r_[0, np.cumsum(many)]
        out, within = np.repeat(ids.astype(np.int32), many), np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
        out[np.repeat(to[at], size) + within] = values[np.repeat(cuts[part], size) + within]
        return pa.RecordBatch.from_arrays([*texts.columns[:-1], pa.ListArray.from_arrays(pa.array(to[ends].astype(np.int32)), pa.array(out))], [*held, "ids"])

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _PLACERS.clear()
        _give_back()
        left = []
        for batch in batches:
            ends = np.flatnonzero(numbers(batch.column("row").is_valid()))
            if not ends.size:
                left += [batch.column("filled")] if batch.num_rows else []
                continue
            before = sum(map(len, left))
            all_ids, row = pa.concat_arrays([*left, batch.column("filled")]), batch.column("row")
            values, cuts = numbers(all_ids.flatten()), _ends(all_ids)
            for first, last in zip([0, *(before + ends[:-1] + 1).tolist()], ends.tolist(), strict=True):
                with pa.ipc.open_stream(row[last].as_buffer()) as texts:
                    yield filled(texts.read_next_batch(), values, cuts[first : before + last + 1])
            left = [batch.column("filled").slice(ends[-1] + 1)]
        if any(map(len, left)):
            raise ValueError("parts without their row")
        _give_back()

    return done.mapInArrow(whole, T.StructType(fields + T.StructType.fromDDL("ids array<int>").fields))


def _joined(docs: DataFrame, pieces: Pieces, doc_id: str, text: str, keep: list[str], frequent: int = FREQUENT) -> DataFrame:
    """As :func:`_encoded`, by a written table of known ids and a join of the rows that have other parts: more disk, one Python worker for each task.

    Rows are numbered in the table; parts pass the lattice dealt out by row.
    """
    shared = _dictionary(docs, pieces, text, frequent)
    name, kind = uuid.uuid4().hex, "<u2" if len(pieces.reads) <= 1 << 16 else "<u4"
    rows = docs.select(F.monotonically_increasing_id().alias("of"), F.col(doc_id).alias("doc_id"), *[F.col(c) for c in keep], F.md5(F.coalesce(F.col(text), F.lit("")).cast("binary")).alias("said"), F.col(text).alias("whole"))
    held = rows.columns[:-1]

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        placer = _placer(name, shared, Placer)
        lists = lambda rows, values: pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum([len(x) for x in rows])].astype(np.int32)), values)
        for batch in batches:
            if batch.num_rows:
                n, got, at, holes = zip(*[placer.place(t.as_py()) for t in batch.column(len(held))], strict=True)
                known = pa.array([x.astype(kind).tobytes() for x in got], pa.binary())
                after, units = pa.array(np.concatenate(at).astype(np.int32)), pa.array([u for some in holes for u in some], pa.string())
                yield pa.RecordBatch.from_arrays([*batch.columns[: len(held)], pa.array(n, pa.int64()), known, lists(at, after), lists(holes, units)], [*held, "n_units", "known", "at", "holes"])

    more = T.StructType.fromDDL("n_units bigint, known binary, at array<int>, holes array<string>")
    met = materialize(rows.mapInArrow(placed, T.StructType([*rows.schema.fields[:-1], *more.fields])), "met")
    some, by = met.where(F.size("holes") > 0), ["of", "k", "unit"]
    count = some.agg(F.sum(F.size("holes"))).first()[0] or 0
    # Whole lists are dealt out, which are shorter than their rows.
    rest = some.select("of", "holes").repartition(1 + count // UNITS_IN_TASK, "of").select("of", F.posexplode("holes").alias("k", "unit"))
    filled = fold(lattice(rest, pieces, by), pieces, by).groupBy("of").agg(F.sort_array(F.collect_list(F.struct("k", F.col("ids")["id"].alias("ids")))).alias("filled"))
    out = [*held[1:], "n_units", "known", "at"]
    both = some.select("of", *out).join(filled, "of").select(*out, F.transform("filled", lambda x: x["ids"]).alias("filled"))
    both = met.where(F.size("holes") == 0).select(*out, F.array().cast("array<array<int>>").alias("filled")).union(both)

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers = lambda a: a.to_numpy(zero_copy_only=False)
        for batch in batches:
            known, at, filled = batch.columns[-3:]
            ends, starts, values = numbers(at.offsets), numbers(filled.offsets), numbers(filled.values.values)
            after, cuts = numbers(at.values), numbers(filled.values.offsets)
            got = []
            for k, x in enumerate(known):
                ids = np.frombuffer(x.as_buffer(), dtype=kind).astype(np.int32)
                if ends[k] < ends[k + 1]:
                    lo = cuts[starts[k] : starts[k + 1] + 1]
                    ids = np.insert(ids, np.repeat(after[ends[k] : ends[k + 1]], np.diff(lo)), values[lo[0] : lo[-1]])
                got.append(ids)
            if got:
                lists = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum([x.size for x in got])].astype(np.int32)), pa.array(np.concatenate(got)))
                yield pa.RecordBatch.from_arrays([*batch.columns[:-3], lists], [*out[:-2], "ids"])

    return both.mapInArrow(whole, T.StructType([*both.schema.fields[:-3], *T.StructType.fromDDL("ids array<int>").fields]))


def encode(docs: DataFrame, pieces: Pieces, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, ids) of each row. Null and empty texts have no ids; repeated rows stay repeated."""
    return _encoded(docs, pieces, doc_id, text, []).select("doc_id", "ids")


def trip(docs: DataFrame, pieces: Pieces, doc_id: str = "doc_id", text: str = "text", keep: tuple[str, ...] = (), frequent: int = FREQUENT, joined: bool = False) -> DataFrame:
    """(doc_id, *keep, ids, n_units, n_tokens, id_sum, digest, round_trip) of each row, all but ``n_units`` from its ids.

    ``digest`` is a hash of the ids in order; ``round_trip`` says that the decoded ids are the text, by 128 bits of hash, which a text that
    holds the blank's own mark can't be. Null texts pass with no ids; repeated rows stay repeated; other columns are ignored unless named in ``keep``. ``joined`` takes
    more disk and less memory (:func:`_joined`).
    """
    back = decode((_joined if joined else _encoded)(docs, pieces, doc_id, text, list(keep), frequent), pieces, into="decoded")
    summed = F.aggregate("ids", F.lit(0).cast("long"), lambda s, x: s + x)
    return back.select("doc_id", *keep, "ids", "n_units", F.size("ids").cast("long").alias("n_tokens"), summed.alias("id_sum"), F.xxhash64("ids").alias("digest"), (F.md5(F.col("decoded").cast("binary")) == F.col("said")).alias("round_trip"))


def decode(encoded: DataFrame, pieces: Pieces, ids: str = "ids", into: str = "text") -> DataFrame:
    """Adds the text as ``into``; nothing is shuffled. Null ids read as an empty text, ids outside the model as nothing."""
    said = reading(F.coalesce(F.col(ids), F.array().cast("array<int>")), pieces)
    # Named by a lambda, so that the model's table stands once in the plan, whose text the driver makes at each step.
    bare = lambda x: F.when(F.startswith(x, F.lit(" ")), F.substring(x, 2, 1 << 30)).otherwise(x)
    return encoded.withColumn(into, F.get(F.transform(F.array(said), bare), F.lit(0)) if pieces.dummy else said)


def digest(docs: DataFrame, pieces: Pieces, doc_id: str = "doc_id", text: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """:func:`trip` without the ids."""
    return trip(docs, pieces, doc_id, text, keep).drop("ids")
