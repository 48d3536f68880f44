"""Incremental ingest and tumbling bars as Structured Streaming jobs.

Nothing is dropped for being late: both jobs keep their state in tables that a batch adds to, not in windows behind a watermark. A batch that is run
again after a failure changes nothing: session rows are compared with the stored ones, and a batch of partial bars replaces its own earlier try.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..sources.loose import parse_session_files, regroup_sessions

SESSION_SCHEMA = "date date, series_id string, short_volume double, short_exempt_volume double, total_volume double, month date"


def stored_sessions(spark: SparkSession, out: str) -> DataFrame:
    return spark.read.schema(SESSION_SCHEMA).parquet(out)


def add_sessions(rows: DataFrame, out: str) -> None:
    """Append the rows whose (series, date) isn't stored yet. The table is partitioned by month, and only months of the batch are read."""
    spark = rows.sparkSession
    rows = rows.withColumn("month", F.trunc("date", "month"))
    key = ["month", "series_id", "date"]
    rows.limit(0).write.mode("append").partitionBy("month").parquet(out)
    rows.join(stored_sessions(spark, out).select(*key), key, "left_anti").write.mode("append").partitionBy("month").parquet(out)


def ingest_sessions(spark: SparkSession, path: str, out: str, checkpoint: str, files_per_trigger: int | None = None) -> StreamingQuery:
    """Add every unseen session file to a Parquet table and stop when caught up.

    Of several rows of a (series, date) in a batch the last in its file wins (the larger one among files); a row that comes after it was stored is
    left out, however late either is.
    """
    r = spark.readStream.format("text")
    if files_per_trigger:
        r = r.option("maxFilesPerTrigger", files_per_trigger)

    def add(batch: DataFrame, _: int) -> None:
        add_sessions(regroup_sessions(parse_session_files(batch)[0]), out)

    lines = r.load(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"))
    return lines.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


EPOCH = "timestamp_ntz'1970-01-01 00:00:00'"


def utc_day(c: str) -> Column:
    """UTC calendar day of a timestamp, whatever the session's time zone."""
    return F.date_from_unix_date(F.floor(F.unix_seconds(c) / 86400).cast("int"))


def partial_bars(events: DataFrame, width: str = "1 day", key: str = "event_type", ts: str = "ts", value: str = "value") -> DataFrame:
    """Mergeable bars of some events: (series_id, start, end, first, high, low, last, volume, n), where ``first`` and ``last`` hold
    (time, event, value). Zone-less times are taken as UTC; events without a time are in no bar."""
    if events.schema[ts].dataType.typeName() == "timestamp_ntz":
        events = events.withColumn(ts, F.timestamp_micros(F.expr(f"timestampdiff(MICROSECOND, {EPOCH}, {ts})")))
    at = F.struct(F.col(ts).alias("ts"), F.col("event_id").alias("event_id"), F.col(value).alias("value"))
    g = events.groupBy(F.window(ts, width).alias("w"), F.col(key).alias("series_id"))
    g = g.agg(F.min(at).alias("first"), F.max(value).alias("high"), F.min(value).alias("low"), F.max(at).alias("last"), F.sum(value).alias("volume"), F.count("*").alias("n"))
    return g.select("series_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "first", "high", "low", "last", "volume", "n")


def merge_bars(parts: DataFrame) -> DataFrame:
    """Partial bars of one window and series as one; merging merged bars with others is the same as merging all."""
    return parts.groupBy("series_id", "start", "end").agg(F.min("first").alias("first"), F.max("high").alias("high"), F.min("low").alias("low"), F.max("last").alias("last"), F.sum("volume").alias("volume"), F.sum("n").alias("n"))


def finish_bars(bars: DataFrame) -> DataFrame:
    """Open, high, low, close, sum and count per series and window."""
    return bars.select("series_id", "start", "end", F.col("first.value").alias("open"), "high", "low", F.col("last.value").alias("close"), "volume", "n")


def tumbling_bars(events: DataFrame, width: str = "1 day", key: str = "event_type", ts: str = "ts", value: str = "value") -> DataFrame:
    """Bars of a table of events."""
    return finish_bars(partial_bars(events, width, key, ts, value))


def read_bars(spark: SparkSession, out: str) -> DataFrame:
    """All bars so far, open windows and late events included."""
    return finish_bars(merge_bars(spark.read.option("basePath", out).parquet(f"{out}/batch=*").drop("batch")))


def run_bars(spark: SparkSession, path: str, out: str, checkpoint: str, width: str = "1 day", files_per_trigger: int | None = None, merge_every: int = 20) -> StreamingQuery:
    """Add the partial bars of an event folder's unseen files to a Parquet table, a folder for each batch, and stop when caught up; see :func:`read_bars`.

    After every ``merge_every`` batches the folder of the last one takes the place of those before it, so the table stays near the number of windows.
    """
    folder, name = path.rstrip("/").rsplit("/", 1)
    source = spark.readStream.schema(spark.read.parquet(path).schema)
    if files_per_trigger:
        source = source.option("maxFilesPerTrigger", files_per_trigger)
    # A single file is addressed through its folder: the file stream lists folders.
    events = source.option("pathGlobFilter", name).parquet(folder) if name.endswith(".parquet") else source.parquet(path)

    def add(batch: DataFrame, number: int) -> None:
        partial_bars(batch, width).write.mode("overwrite").parquet(f"{out}/batch={number:09d}")
        if merge_every and number % merge_every == merge_every - 1:
            compact_bars(batch.sparkSession, out, number)

    return events.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def compact_bars(spark: SparkSession, out: str, upto: int) -> None:
    """Merge the batches up to ``upto`` into a folder of their own and let it take the place of theirs.

    The merged folder is written beside the table and moved in as the last batch's after the older ones are gone; :func:`settle` completes a move that
    was cut off, before anything else is done.
    """
    fs, at = _files(spark, out)
    settle(spark, out)
    old = [n for n in _batches(fs, at, out) if n <= upto]
    if len(old) < 2:
        return
    merged = f"{out}/_merged-{upto:09d}"
    merge_bars(spark.read.parquet(*[f"{out}/batch={n:09d}" for n in old])).write.mode("overwrite").parquet(merged)
    fs.rename(at(merged), at(f"{out}/_ready-{upto:09d}"))
    settle(spark, out)


def settle(spark: SparkSession, out: str) -> None:
    """Finish a merge whose result is complete: the batches it covers go, and it becomes the last of them."""
    fs, at = _files(spark, out)
    for s in fs.globStatus(at(f"{out}/_ready-*")) or []:
        upto = int(s.getPath().getName().rsplit("-", 1)[1])
        for n in _batches(fs, at, out):
            if n <= upto:
                fs.delete(at(f"{out}/batch={n:09d}"), True)
        fs.rename(s.getPath(), at(f"{out}/batch={upto:09d}"))


def _files(spark: SparkSession, out: str):
    at = spark._jvm.org.apache.hadoop.fs.Path
    return at(out).getFileSystem(spark._jsc.hadoopConfiguration()), at


def _batches(fs, at, out: str) -> list[int]:
    return sorted(int(s.getPath().getName().split("=")[1]) for s in fs.globStatus(at(f"{out}/batch=*")) or [])
