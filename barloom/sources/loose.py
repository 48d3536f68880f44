"""Loose price files, vendor payloads, session files and macro files to canonical tables."""

from __future__ import annotations


from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# Accepted source names per canonical column, in order of preference.
ALIASES = {
    "open": ["open", "o"],
    "high": ["high", "h"],
    "low": ["low", "l"],
    "close": ["close", "c", "price"],
    "adj_close": ["adj_close", "adjclose", "adj close", "adjusted_close", "adjusted close", "adjusted"],
    "volume": ["volume", "vol", "v"],
}
DATE_ALIASES = ["date", "timestamp", "time", "day"]
FILING_COLUMNS = ["ticker", "period_end", "published", "revenue", "eps", "fcf", "shares"]
PRICES = ["open", "high", "low", "close", "adj_close", "volume"]


def normalize_bars(df: DataFrame, key: str = "series_id", order: list[str] | None = None) -> DataFrame:
    """Canonical bars from any accepted column names: coerced numbers, missing prices filled from the close, first row per date.

    ``order`` says which of several rows of one date comes first; without it, the row with the smallest values does.
    """
    names = {c.strip().lower(): c for c in df.columns}
    find = lambda cands: next((names[a] for a in cands if a in names), None)
    date = find(DATE_ALIASES)
    if date is None:
        raise ValueError(f"no date column among {DATE_ALIASES}")
    if find(ALIASES["close"]) is None:
        raise ValueError("no close column")
    col = lambda name: F.col(f"`{name}`")
    text = col(date).cast("string")
    d = F.coalesce(F.try_to_timestamp(text).cast("date"), F.substring(text, 1, 10).try_cast("date"))
    num = {c: col(find(a)).cast("string").try_cast("double") if find(a) else None for c, a in ALIASES.items()}
    extra = [c for c in ("dividend", "split") if c in names]
    out = df.select(*([F.col(key)] if key in df.columns else []), d.alias("date"),
                    num["close"].alias("close"), *[(num[c] if num[c] is not None else num["close"]).alias(c) for c in ("open", "high", "low", "adj_close")],
                    (num["volume"] if num["volume"] is not None else F.lit(None).cast("double")).alias("volume"),
                    *[col(names[c]).cast("string").try_cast("double").alias(c) for c in extra], *([F.col(o) for o in order] if order else []))
    keys = [key] if key in df.columns else []
    w = Window.partitionBy(*keys, "date").orderBy(*(order or PRICES))
    out = out.where("date is not null").withColumn("_rn", F.row_number().over(w)).where("_rn = 1")
    return out.select(*keys, "date", *PRICES, *extra)


def read_loose(spark: SparkSession, path: str, fmt: str) -> DataFrame:
    """Every file of a folder; the upper-cased file stem is the series. Unreadable rows are kept in ``_corrupt_record``."""
    reader = spark.read.option("mode", "PERMISSIVE")
    if fmt == "csv":
        df = reader.option("header", "true").csv(path)
    elif fmt == "json":
        df = reader.json(path)
    else:
        df = spark.read.parquet(path)
    return df.withColumn("series_id", _series_of(F.input_file_name()))


def flatten_chart(payload: DataFrame, body: str = "body") -> DataFrame:
    """Parallel arrays of a chart payload (timestamps, quotes, adjusted close) to rows; rows without a close are dropped.

    Dates are UTC days of the epoch seconds, whatever the session's time zone.
    """
    schema = ("timestamp array<bigint>, quote struct<open array<double>, high array<double>, low array<double>, close array<double>, volume array<double>>, "
              "adjclose array<double>")
    p = payload.withColumn("_p", F.from_json(body, schema))
    q = "_p.quote."
    z = F.arrays_zip(F.col("_p.timestamp"), F.col(q + "open"), F.col(q + "high"), F.col(q + "low"), F.col(q + "close"), F.col(q + "volume"),
                     F.coalesce(F.col("_p.adjclose"), F.transform(F.col(q + "close"), lambda _: F.lit(None).cast("double"))))
    names = ["ts", "open", "high", "low", "close", "volume", "adj"]
    z = z.cast("array<struct<" + ",".join(f"{n}:{'bigint' if n == 'ts' else 'double'}" for n in names) + ">>")
    r = p.select("series_id", F.inline(z)).where("close is not null")
    return r.select("series_id", F.date_from_unix_date(F.floor(F.col("ts") / 86400).cast("int")).alias("date"), "open", "high", "low", "close",
                    F.coalesce("adj", "close").alias("adj_close"), "volume")


def flatten_dated_map(payload: DataFrame, body: str = "body", lo: str | None = None, hi: str | None = None) -> DataFrame:
    """A ``{date: {field: text}}`` payload to typed rows, cut to [lo, hi]; entries whose key is no date are dropped."""
    m = payload.select("series_id", F.explode(F.from_json(body, "map<string, map<string, string>>")).alias("_d", "_v"))
    num = lambda k: F.element_at("_v", k).try_cast("double")
    r = m.select("series_id", F.col("_d").try_cast("date").alias("date"), *[num(f"{i}. {n}").alias(c) for i, n, c in (
        (1, "open", "open"), (2, "high", "high"), (3, "low", "low"), (4, "close", "close"), (5, "adjusted close", "adj_close"), (6, "volume", "volume"))],
        F.coalesce(num("7. dividend amount"), F.lit(0.0)).alias("dividend"), F.coalesce(num("8. split coefficient"), F.lit(1.0)).alias("split"))
    r = r.where("date IS NOT NULL")
    if lo:
        r = r.where(F.col("date") >= F.to_date(F.lit(lo)))
    return r.where(F.col("date") <= F.to_date(F.lit(hi))) if hi else r


def flatten_bar_list(payload: DataFrame, body: str = "body") -> DataFrame:
    """A list of bar objects to rows, dividends defaulting to 0 and splits to 1; objects without a readable date are dropped."""
    schema = "array<struct<date string, open double, high double, low double, close double, adjClose double, volume double, divCash double, splitFactor double>>"
    r = payload.select("series_id", F.inline(F.from_json(body, schema)))
    return r.select("series_id", F.substring("date", 1, 10).try_cast("date").alias("date"), "open", "high", "low", "close", F.col("adjClose").alias("adj_close"), "volume",
                    F.coalesce("divCash", F.lit(0.0)).alias("dividend"), F.coalesce("splitFactor", F.lit(1.0)).alias("split")).where("date IS NOT NULL")


def read_macro_csv(spark: SparkSession, path: str, lo: str | None = None, hi: str | None = None) -> DataFrame:
    """Two-column macro files where a lone dot means missing; missing rows are dropped."""
    r = spark.read.schema("date date, value double").option("header", "true").option("nullValue", ".").csv(path).where("value is not null")
    if lo:
        r = r.where(F.col("date") >= F.to_date(F.lit(lo)))
    return r.where(F.col("date") <= F.to_date(F.lit(hi))) if hi else r


SESSION_COLUMNS = ["Date", "Symbol", "ShortVolume", "TotalVolume"]


def placed_lines(spark: SparkSession, path: str) -> DataFrame:
    """(value, file, block): the lines of text files and the file and block they are from."""
    return spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"))


def with_headers(lines: DataFrame) -> DataFrame:
    """Adds ``at`` (file, block, line: sorts lines as they stand in their file) and ``head``, the first line of the line's own file that isn't blank.

    A block of a file is read by one task from its start, so numbers that grow within the task order its lines. A file's header is found with a partial
    step in each task and joined back; files of any size and number are read in parallel.
    """
    x = lines.where(F.trim("value") != "").select("value", F.struct("file", "block", F.monotonically_increasing_id().alias("line")).alias("at"))
    heads = x.groupBy(F.col("at.file").alias("_f")).agg(F.min(F.struct("at", "value"))["value"].alias("head"))
    return x.join(heads, F.col("at.file") == F.col("_f")).drop("_f")


def _body(x: DataFrame) -> DataFrame:
    """Without the header lines."""
    first = x.groupBy(F.col("at.file").alias("_f")).agg(F.min("at").alias("_first"))
    return x.join(first, F.col("at.file") == F.col("_f")).where(F.col("at") != F.col("_first")).drop("_f", "_first")


def parse_session_files(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Pipe-delimited session lines (value, file, block) to rows, and the refused files with the reason.

    Columns are found by each file's own header; a file whose header lacks one of the four required columns is refused. Headers, trailers, blank
    symbols, unreadable dates and rows without volume are dropped.
    """
    x = with_headers(lines).withColumns({"_names": F.transform(F.split("head", r"\|"), lambda c: F.trim(c)), "_part": F.split("value", r"\|")})
    wanted = F.array(*[F.lit(c) for c in SESSION_COLUMNS])
    lacks = F.array_except(wanted, "_names")
    refused = x.where(F.size(lacks) > 0).groupBy(F.col("at.file").alias("file")).agg(F.first(F.concat(F.lit("missing columns: "), F.array_join(lacks, ", "))).alias("reason"))
    at = lambda c: F.get("_part", F.nullif(F.array_position("_names", c), F.lit(0)).cast("int") - 1)
    num = lambda c: at(c).try_cast("double")
    r = x.where(F.size(lacks) == 0).select(F.trim(at("Date")).alias("_d"), F.upper(F.trim(at("Symbol"))).alias("series_id"), num("ShortVolume").alias("short_volume"),
                                           num("ShortExemptVolume").alias("short_exempt_volume"), num("TotalVolume").alias("total_volume"), "at")
    r = r.where(F.col("_d").rlike(r"^\d{8}$") & (F.coalesce("series_id", F.lit("")) != "") & (F.col("total_volume") > 0))
    day = F.concat_ws("-", F.substring("_d", 1, 4), F.substring("_d", 5, 2), F.substring("_d", 7, 2)).try_cast("date")
    return r.select(day.alias("date"), "series_id", "short_volume", "short_exempt_volume", "total_volume", "at").where("date IS NOT NULL"), refused


def regroup_sessions(rows: DataFrame) -> DataFrame:
    """One row per (series, date): the last of the last file wins. Raw counts are kept, the ratio is derived at read time."""
    kept = ["short_volume", "short_exempt_volume", "total_volume"]
    g = rows.groupBy("series_id", "date").agg(F.max_by(F.struct(*kept), "at").alias("_v"))
    return g.select("date", "series_id", *[F.col(f"_v.{c}").alias(c) for c in kept])


def import_loose_csv(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(bars, rejects) of a folder of CSV files, each read by its own header: ``(series_id, date, open .. volume)`` and ``(file, series_id, reason)``.

    The upper-cased file stem (or ``series_key`` folder) is the series. A file that is empty, lacks a date or a close column or has a date that can't be
    read is rejected as a whole. Prices that a file lacks are filled from the close, and the first row of a date in its file wins. Fields don't hold
    line feeds.
    """
    x = with_headers(placed_lines(spark, path))
    width = x.agg(F.max(F.size(F.split("head", ",")))).first()[0] or 1
    fields = lambda c: F.array(*[F.from_csv(c, F.lit(", ".join(f"c{k} string" for k in range(width))))[f"c{k}"] for k in range(width)])
    x = x.withColumn("_names", F.transform(fields(F.col("head")), lambda c: F.lower(F.trim(c))))
    where = lambda names: F.coalesce(*[F.nullif(F.array_position("_names", n), F.lit(0)) for n in names]).cast("int") - 1
    x = x.withColumns({f"_at_{c}": where(a) for c, a in {**ALIASES, "date": DATE_ALIASES}.items()})
    file = F.col("at.file")
    bad_head = F.when(F.col("_at_date").isNull(), "no date column").when(F.col("_at_close").isNull(), "no close column")
    body = _body(x).withColumn("_part", fields(F.col("value")))
    text = F.get("_part", F.col("_at_date"))
    body = body.withColumn("date", F.coalesce(F.try_to_timestamp(text).cast("date"), F.substring(text, 1, 10).try_cast("date")))
    rejects = x.where(bad_head.isNotNull()).groupBy(file.alias("file")).agg(F.first(bad_head).alias("reason"))
    undated = body.where(bad_head.isNull()).groupBy(file.alias("file")).agg(F.bool_or(F.col("date").isNull()).alias("_bad")).where("_bad")
    # A file without a line is in no scan, so it is known from the listing alone.
    plain = lambda c: F.regexp_replace(c, "^file:/+", "/")
    listed = spark.createDataFrame([(f,) for f in spark.read.text(path).inputFiles()], "file string")
    empty = listed.join(x.select(plain(file).alias("_f")).distinct(), plain("file") == F.col("_f"), "left_anti").withColumn("reason", F.lit("empty file"))
    rejects = rejects.unionByName(undated.select("file", F.lit("unreadable date").alias("reason"))).unionByName(empty)
    num = lambda c: F.get("_part", F.col(f"_at_{c}")).try_cast("double")
    close = num("close")
    # A column that the file lacks is the close; a cell that can't be read stays empty.
    price = lambda c: F.when(F.col(f"_at_{c}").isNull(), close).otherwise(num(c))
    rows = body.where(bad_head.isNull()).join(rejects.select(F.col("file").alias("_f")), file == F.col("_f"), "left_anti")
    rows = rows.select(_series_of(file).alias("series_id"), "date", "at", F.struct(*[(close if c == "close" else num(c) if c == "volume" else price(c)).alias(c) for c in PRICES]).alias("_v"))
    bars = rows.groupBy("series_id", "date").agg(F.min_by("_v", "at").alias("_v"))
    return bars.select("series_id", "date", *[F.col(f"_v.{c}").alias(c) for c in PRICES]), rejects.select("file", _series_of(F.col("file")).alias("series_id"), "reason")


def _series_of(file: Column) -> Column:
    stem = F.upper(F.regexp_extract(file, r"([^/]+?)(?:\.[A-Za-z0-9]+)?$", 1))
    folder = F.upper(F.regexp_extract(file, r"series_key=([^/]+)/", 1))
    return F.when(folder != "", folder).otherwise(stem)


def short_share() -> Column:
    return F.try_divide("short_volume", "total_volume")


def short_panel(rows: DataFrame, series: list[str]) -> DataFrame:
    """Short share as a date x series display table for a named list of series."""
    r = rows.where(F.col("series_id").isin(series)).withColumn("share", short_share())
    return r.groupBy("date").pivot("series_id", series).agg(F.last("share"))


def level_to_yoy(obs: DataFrame, lag: int = 12, level_above: float = 30.0, series: list[str] | None = None) -> DataFrame:
    """Series (of those named, if any are) whose median exceeds ``level_above`` are index levels and become percent changes over ``lag`` rows."""
    x = obs.where("value is not null")
    med = F.percentile("value", F.lit(0.5)).over(Window.partitionBy("series"))
    prev = F.lag("value", lag).over(Window.partitionBy("series").orderBy("date"))
    x = x.withColumns({"_m": med, "_p": prev})
    x = x.withColumn("value", F.when((F.col("_m") > level_above) & (F.col("series").isin(series) if series else F.lit(True)), (F.try_divide("value", "_p") - 1) * 100).otherwise(F.col("value")))
    return x.where("value is not null").drop("_m", "_p")


def accept_filings(f: DataFrame, key: str = "ticker", required: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """Filings of sources that never publish before the period ends, and the refused sources with the reason."""
    missing = [c for c in (required or []) if c not in f.columns]
    if missing:
        raise ValueError(f"missing columns {missing}")
    bad = f.groupBy(key).agg(F.bool_or(F.col("published") < F.col("period_end")).alias("_leak")).where("_leak")
    bad = bad.select(key, F.lit("published before period_end").alias("reason"))
    return f.join(bad, key, "left_anti"), bad


def tail_after(new: DataFrame, stored: DataFrame, key: str = "series_id") -> DataFrame:
    """Rows newer than the newest stored date of their series (all rows of unknown series)."""
    last = stored.groupBy(key).agg(F.max("date").alias("_last"))
    return new.join(last, key, "left").where(F.col("_last").isNull() | (F.col("date") > F.col("_last"))).select(*new.columns)


def checksum_report(files: DataFrame, manifest: DataFrame) -> DataFrame:
    """Compare file contents (``path, content``) with a manifest (``path, sha256``): missing, mismatch or unlisted."""
    got = files.select("path", F.sha2("content", 256).alias("_got"))
    x = manifest.join(got, "path", "full")
    why = F.when(F.col("_got").isNull(), F.lit("missing")).when(F.col("sha256").isNull(), F.lit("unlisted")).when(F.col("_got") != F.col("sha256"), F.lit("mismatch"))
    return x.select("path", why.alias("problem")).where("problem is not null")
