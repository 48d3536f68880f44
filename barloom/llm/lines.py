"""Repeated lines across documents, as keep bitmaps.

Each line becomes a row of hashes: its key, its document, its place. The rows are partitioned by ranges of the key's hash and sorted behind it by document
(largest first) and place, so one pass over a sorted partition meets a key's first document, its second and its third in order. Only places of
dropped lines go on; they come together as bits of each text, and texts don't move until the bits are applied.

A key that holds a notable share of all lines would fill a range by itself. Such keys are few by their definition; they are summed up with partial
aggregates and their lines are judged against a broadcast, in place.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.session import materialize

LENGTH, DOCUMENTS = 20, 3
#: Lines of a word of the bitmap.
WORD = 60
#: Hash classes in which keys with a large share are looked for. A key is hot if it has more lines than ``HEAVY`` average classes, so there are fewer hot
#: keys than classes.
CLASSES, HEAVY = 1 << 14, 4
BLANKS = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
ROW, KEY = ["row_a", "row_b"], ["key_a", "key_b"]


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n")


def key_of(line: Column) -> Column:
    """A line without blanks at its ends and with small letters for A to Z; lines of ASCII alone take the quicker way to the same."""
    bare = F.btrim(line, F.lit(BLANKS))
    return F.when(F.octet_length(bare) == F.char_length(bare), F.lower(bare)).otherwise(F.translate(bare, UPPER, LOWER))


def _named(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """(doc_id, text, row_a, row_b): 128 bits name a row; rows that agree in id and text are judged alike and share the name."""
    d, t = F.col(doc_id), F.col(text)
    return docs.select(d.alias("doc_id"), t.alias("text"), *[F.xxhash64(F.lit(k), d, d.isNull(), t, t.isNull()).alias(c) for k, c in enumerate(ROW)])


def _dropped(lines: DataFrame) -> DataFrame:
    """(row_a, row_b, pos) of the lines to drop, by the sorted stream of each key."""
    by = Window.partitionBy(*KEY).orderBy(F.desc_nulls_last("doc_id"))
    ranged = lines.repartitionByRange(*KEY)
    place = ranged.withColumn("nth", F.dense_rank().over(by)).where("nth > 1")
    # Of the second document nothing goes unless the third comes; the stream is still in order, so no row moves.
    last = place.withColumn("most", F.max("nth").over(Window.partitionBy(*KEY)))
    return last.where(F.col("most") >= DOCUMENTS).select(*ROW, "pos")


def _hot(lines: DataFrame) -> DataFrame | None:
    """(*key, n, top) of the hot keys: in how many documents they are, and the largest; None if there are none.

    A smaller class can't hold such a key, so only the rows of the few large classes are counted by key. All counts have a partial step before the
    shuffle.
    """
    which = F.pmod("key_a", F.lit(CLASSES))
    sizes = lines.groupBy(which.alias("class")).agg(F.count(F.lit(1)).alias("n")).collect()
    due = max(HEAVY * sum(r.n for r in sizes) / CLASSES, 1000)
    large = [r["class"] for r in sizes if r.n > due]
    if not large:
        return None
    some = lines.where(which.isin(large))
    keys = some.groupBy(*KEY).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > due).select(*KEY)
    keys = materialize(keys, "hot-keys")
    each = some.join(F.broadcast(keys), KEY, "left_semi").select(*KEY, "doc_id").distinct()
    return materialize(each.groupBy(*KEY).agg(F.count(F.lit(1)).alias("n"), F.max("doc_id").alias("top")), "hot")


def bitmaps(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(row_a, row_b, n_dropped, keep) of the texts that lose lines; ``keep`` is their bitmap, as (word, bits) of the words of ``WORD`` lines that are not
    all kept, in order; bit i of word w stands for line ``w * WORD + i``.

    A line goes if its key has ``LENGTH`` code points, at least ``DOCUMENTS`` ids have it, and its id isn't the largest of them. Rows with one id are one
    document; rows without id are one too, smaller than all others. Null and empty texts are one empty line. Repeated rows share their bits.
    """
    named = _named(docs, doc_id, text)
    at = named.select("doc_id", *ROW, F.posexplode(F.transform(lines_of(F.col("text")), key_of)).alias("pos", "key"))
    long = at.where(F.char_length("key") >= LENGTH).select(*[F.xxhash64(F.lit(k), "key").alias(c) for k, c in enumerate(KEY)], "doc_id", *ROW, "pos")
    lines = materialize(long, "lines")
    hot = _hot(lines)
    if hot is None:
        gone = _dropped(lines)
    else:
        gone = _dropped(lines.join(F.broadcast(hot.select(*KEY)), KEY, "left_anti"))
        top = hot.where(F.col("n") >= DOCUMENTS).select(*KEY, "top")
        gone = gone.union(lines.join(F.broadcast(top), KEY).where(~F.col("doc_id").eqNullSafe(F.col("top"))).select(*ROW, "pos"))
    one = lambda k: F.call_function("shiftleft", F.lit(1).cast("long"), k.cast("int"))
    full = F.lit((1 << WORD) - 1)
    words = gone.groupBy(*ROW, F.expr(f"pos div {WORD}").cast("int").alias("word")).agg(F.bit_or(one(F.col("pos") % WORD)).alias("bits"))
    of = words.groupBy(*ROW).agg(F.sum(F.bit_count("bits")).cast("long").alias("n_dropped"), F.sort_array(F.collect_list(F.struct("word", full.bitwiseXOR(F.col("bits")).alias("bits")))).alias("keep"))
    return of


def apply(docs: DataFrame, keep: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, text, n_lines, n_dropped, kept) of each row: what is left of its text by :func:`bitmaps`, lines joined by a line feed."""
    full, size = F.lit((1 << WORD) - 1), F.array_size("keep")
    # The words between two that are listed are all kept; with them every word has its place in the array.
    gap = lambda x, k: x["word"] - F.when(k > 0, F.get("keep", k - 1)["word"]).otherwise(-1) - 1
    every = F.flatten(F.transform("keep", lambda x, k: F.concat(F.array_repeat(full, gap(x, k)), F.array(x["bits"]))))
    bit = lambda w, k: F.call_function("shiftright", F.coalesce(F.get(w, F.floor(k / WORD).cast("int")), full), k % WORD).bitwiseAND(F.lit(1).cast("long"))
    joined = _named(docs, doc_id, text).join(keep, ROW, "left").withColumn("words", F.when(size > 0, every))
    split = joined.select("doc_id", "text", F.coalesce("n_dropped", F.lit(0).cast("long")).alias("n_dropped"), "words", lines_of(F.col("text")).alias("lines"))
    left = F.array_join(F.filter("lines", lambda x, k: bit(F.col("words"), k) == 1), "\n")
    return split.select("doc_id", "text", F.size("lines").cast("long").alias("n_lines"), "n_dropped", F.when(F.col("words").isNull(), F.coalesce("text", F.lit(""))).otherwise(left).alias("kept"))


def dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, text, n_lines, n_dropped, kept) of each row; see :func:`bitmaps` for what goes. Other columns are ignored; an empty table gives no rows."""
    return apply(docs, bitmaps(docs, doc_id, text), doc_id, text)
