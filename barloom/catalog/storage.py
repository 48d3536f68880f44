"""Sources and sinks (S1-S25), streaming (T1, T2). Files are written from the given tables and read back by the sources."""

from pyspark.sql import Window
from pyspark.sql import functions as F
from pyspark.sql import types as TY

from ..session import workspace
from ..sources import filings as FI
from ..sources import loose as L
from ..sources import store as ST
from ..sources import tables as T
from ..streaming import jobs
from .base import SQL_LINES, WK, query, sql_bars, sql_panel
from .evidence import RG, SQL_RANK, registry
from .metrics import SQL_CURVES, curves
from .panel import SQL_MACRO
from .signals import SQL_SHORT

BARS = f"{SQL_LINES}, {sql_bars()}"
COLS = ["open", "high", "low", "close", "adj_close", "volume", "dollar_volume"]
SPEC = "series_id:s date:d open:p high:p low:p close:p adj_close:p volume:p"


def stored(spark, d):
    root = workspace(spark, "store")
    ST.write_dataset(T.bars(spark, d).select("series_id", "date", *COLS), root, "prices", "alpha")
    ST.write_dataset(T.short_volume(spark, d), root, "short_volume", "sessions")
    return root


@query("s1_read_dataset", SPEC, f"{BARS}, out AS (SELECT * FROM bars WHERE series_id IN ('Brand#3', 'Brand#14'))")
def s1(spark, d):
    return ST.read_dataset(spark, stored(spark, d), "prices", ST.BAR_SCHEMA, ["Brand#3", "Brand#14"])


@query("s2_write_dataset", "kind:s n:i series:i v:p", f"{BARS}, {SQL_SHORT}, out AS (SELECT 'prices' AS kind, count(*) AS n, count(DISTINCT series_id) AS series, sum(volume) AS v FROM bars UNION ALL SELECT 'short_volume', count(*), count(DISTINCT series_id), sum(total_volume) FROM sv)")
def s2(spark, d):
    x = spark.read.option("mergeSchema", "true").parquet(f"{stored(spark, d)}/data")
    return x.groupBy("kind").agg(F.count("*").alias("n"), F.count_distinct("series_id").alias("series"), F.sum(F.coalesce("volume", "total_volume")).alias("v"))


@query("s3_coverage_summary", "kind:s key:s first:d last:d rows:i provider:s", f"{BARS}, {SQL_SHORT}, out AS (SELECT 'prices' AS kind, series_id AS \"key\", min(date) AS first, max(date) AS last, count(*) AS rows, 'alpha' AS provider FROM bars GROUP BY 2 UNION ALL SELECT 'short_volume', series_id, min(date), max(date), count(*), 'sessions' FROM sv GROUP BY 2)")
def s3(spark, d):
    return ST.coverage_summary(spark, stored(spark, d))


@query("s4_fingerprint_stable", "same:b changed:b datasets:i", f"{BARS}, {SQL_SHORT}, out AS (SELECT TRUE AS same, TRUE AS changed, (SELECT count(DISTINCT series_id) FROM bars) + (SELECT count(DISTINCT series_id) FROM sv) AS datasets)")
def s4(spark, d):
    c = ST.coverage_summary(spark, stored(spark, d))
    a = ST.dataset_fingerprint(c)
    b = ST.dataset_fingerprint(c.repartition(3, "last")).select(F.col("fingerprint").alias("again"))
    x = ST.dataset_fingerprint(c.withColumn("rows", F.col("rows") + 1)).select(F.col("fingerprint").alias("other"))
    return a.join(F.broadcast(b)).join(F.broadcast(x)).select((F.col("fingerprint") == F.col("again")).alias("same"), (F.col("fingerprint") != F.col("other")).alias("changed"), "datasets")


def csv_folder(spark, d, **rename):
    path = workspace(spark, "csv")
    b = T.bars(spark, d).select(F.concat(F.lit("b"), T.brand_no().cast("string")).alias("series_key"), F.date_format("date", "yyyy-MM-dd").alias("Date"), F.col("open").alias("O"), F.col("close").alias("Price"),
                                F.col("adj_close").alias("Adj Close"), F.when(F.month("date") == 2, F.lit("n/a")).otherwise(F.col("volume").cast("string")).alias("Vol"))
    b.repartition("series_key").write.partitionBy("series_key").option("header", "true").csv(path)
    return path


def loose_folder(spark, d):
    """CSV files with two column orders, a repeated last date, and files without a close or date column or with a date that is none."""
    path = workspace(spark, "loose")
    no, last = T.brand_no(), F.max("date").over(Window.partitionBy("series_id"))
    b = T.bars(spark, d).withColumns({"no": no, "last": last, "vol": F.when(F.month("date") == 2, F.lit("n/a")).otherwise(F.col("volume").cast("string")), "day": F.date_format("date", "yyyy-MM-dd")})
    row = lambda day, close: F.when(F.col("no") % 2 == 0, F.concat_ws(",", day, "open", close, "adj_close", "vol")).otherwise(F.concat_ws(",", "vol", close, "adj_close", F.concat(F.lit('"'), "open", F.lit('"')), F.concat(day, F.lit("T00:00:00"))))
    some = lambda n, text, other: F.when(F.col("no") % 7 == n, F.lit(text)).otherwise(other)
    head = F.when(F.col("no") % 2 == 0, F.concat_ws(",", some(2, "Dat", F.lit("Date")), F.lit("O"), some(0, "Prize", F.lit("Price")), F.lit("Adj Close"), F.lit("Vol"))) \
        .otherwise(F.concat_ws(",", F.lit("VOLUME"), some(0, "Clse", F.lit(" close")), F.lit("Adjusted"), F.lit("Open"), some(2, "Dei", F.lit("Day"))))
    day = F.when((F.col("no") % 7 == 1) & (F.col("date") == F.col("last")), F.lit("soon")).otherwise(F.col("day"))
    lines = b.select(F.concat(F.lit("b"), F.col("no").cast("string")).alias("series_key"), F.explode(F.array(
        F.struct(F.lit(None).cast("date").alias("o"), F.lit(0).alias("p"), head.alias("value")), F.struct(F.col("date").alias("o"), F.lit(1).alias("p"), row(day, "close").alias("value")),
        F.struct(F.when(F.col("date") == F.col("last"), F.col("date")).alias("o"), F.lit(2).alias("p"), row(F.col("day"), F.lit("1")).alias("value")))).alias("x")).select("series_key", "x.*")
    lines = lines.where("p = 0 or o is not null").dropDuplicates().repartition("series_key").sortWithinPartitions("series_key", F.col("p") > 0, "o", "p")
    lines.select("series_key", "value").write.partitionBy("series_key").text(path)
    return path


@query("s5_import_loose", SPEC, f"{BARS}, out AS (SELECT 'B' || substr(series_id, 7) AS series_id, date, open, close AS high, close AS low, close, adj_close, CASE WHEN month(date) <> 2 THEN volume END AS volume FROM bars WHERE CAST(substr(series_id, 7) AS INTEGER) % 7 > 2)")
def s5(spark, d):
    return L.import_loose_csv(spark, loose_folder(spark, d) + "/*/*.txt")[0]


@query("s5_loose_rejects", "series_id:s reason:s", """b AS (SELECT DISTINCT CAST(substr(p_brand, 7) AS INTEGER) AS n FROM lineitem JOIN part ON l_partkey = p_partkey),
out AS (SELECT 'B' || n AS series_id, CASE n % 7 WHEN 0 THEN 'no close column' WHEN 1 THEN 'unreadable date' ELSE 'no date column' END AS reason FROM b WHERE n % 7 <= 2)""")
def s5r(spark, d):
    return L.import_loose_csv(spark, loose_folder(spark, d) + "/*/*.txt")[1]


@query("s6_normalize_bars", SPEC, f"{BARS}, out AS (SELECT series_id, date, close AS open, high, close AS low, close, close AS adj_close, NULL AS volume FROM bars)")
def s6(spark, d):
    b = T.bars(spark, d)
    raw = b.select("series_id", F.date_format("date", "yyyy-MM-dd'T'00:00:00").alias(" Timestamp "), F.col("high").cast("string").alias("H"), F.col("close").cast("string").alias("PRICE"), F.lit(1).alias("o_rank"))
    again = raw.withColumns({"PRICE": F.lit("1"), "o_rank": F.lit(2)})
    return L.normalize_bars(raw.unionByName(again), order=["o_rank"])


@query("s7_verify_checksums", "path:s problem:s", """b AS (SELECT DISTINCT p_brand AS s, CAST(substr(p_brand, 7) AS INTEGER) AS n FROM part),
out AS (SELECT 'b' || n AS path, CASE WHEN n % 5 = 0 THEN 'mismatch' ELSE 'unlisted' END AS problem FROM b WHERE n % 5 = 0 OR n % 7 = 0 UNION ALL SELECT 'gone' || n, 'missing' FROM b WHERE n % 9 = 0)""")
def s7(spark, d):
    f = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.csv").load(csv_folder(spark, d))
    f = f.select(F.regexp_extract("path", r"series_key=([^/]+)/", 1).alias("path"), "content")
    n = F.regexp_extract("path", r"(\d+)", 1).cast("int")
    man = f.select("path", F.when(n % 5 == 0, F.lit("0")).otherwise(F.sha2("content", 256)).alias("sha256"), n.alias("n"))
    listed = man.where("n % 5 = 0 or n % 7 <> 0").select("path", "sha256")
    gone = man.where("n % 9 = 0").select(F.concat(F.lit("gone"), F.col("n").cast("string")).alias("path"), "sha256")
    return L.checksum_report(f, listed.unionByName(gone))


@query("s8_flatten_chart", SPEC, f"{BARS}, out AS (SELECT series_id, date, open, high, low, close, coalesce(CASE WHEN CAST(substr(series_id, 7) AS INTEGER) % 2 = 0 THEN adj_close END, close) AS adj_close, volume FROM bars WHERE month(date) <> 3)")
def s8(spark, d):
    b = T.bars(spark, d).withColumns({"year": F.year("date"), "c": F.when(F.month("date") != 3, F.col("close"))})
    s = F.array_sort(F.collect_list(F.struct(F.unix_date("date").cast("bigint").alias("k"), "open", "high", "low", "c", "volume", "adj_close")))
    p = b.groupBy("series_id", "year").agg(s.alias("s"))
    pick = lambda f: F.transform("s", lambda x: x[f])
    body = F.struct(F.transform("s", lambda x: x["k"] * 86400).alias("timestamp"), F.struct(*[pick(f).alias(n) for f, n in (("open", "open"), ("high", "high"), ("low", "low"), ("c", "close"), ("volume", "volume"))]).alias("quote"),
                    F.when(T.brand_no() % 2 == 0, pick("adj_close")).alias("adjclose"))
    return L.flatten_chart(p.select("series_id", F.to_json(body, {"ignoreNullFields": "false"}).alias("body")))


@query("s9_flatten_dated_map", "series_id:s date:d close:p adj_close:p dividend:f split:f", f"{BARS}, out AS (SELECT series_id, date, close, adj_close, 0 AS dividend, 1 AS split FROM bars WHERE date BETWEEN DATE '1996-01-01' AND DATE '1999-12-31')")
def s9(spark, d):
    b = T.bars(spark, d).withColumn("year", F.year("date"))
    v = F.create_map(F.lit("1. open"), F.col("open").cast("string"), F.lit("4. close"), F.col("close").cast("string"), F.lit("5. adjusted close"), F.col("adj_close").cast("string"))
    m = b.groupBy("series_id", "year").agg(F.map_from_entries(F.collect_list(F.struct(F.col("date").cast("string"), v))).alias("m"))
    return L.flatten_dated_map(m.select("series_id", F.to_json("m").alias("body")), lo="1996-01-01", hi="1999-12-31")


@query("s10_flatten_bar_list", "series_id:s date:d close:p dividend:f split:f", f"{BARS}, out AS (SELECT series_id, date, close, CASE WHEN month(date) = 6 THEN 0.25 ELSE 0 END AS dividend, 1 AS split FROM bars)")
def s10(spark, d):
    b = T.bars(spark, d).withColumn("year", F.year("date"))
    r = F.struct(F.concat(F.col("date").cast("string"), F.lit("T00:00:00Z")).alias("date"), "close", F.when(F.month("date") == 6, 0.25).alias("divCash"))
    return L.flatten_bar_list(b.groupBy("series_id", "year").agg(F.to_json(F.collect_list(r)).alias("body")))


@query("s11_read_bar_csv", "series_id:s date:d close:p adj_close:p", f"{BARS}, out AS (SELECT 'B' || substr(series_id, 7) AS series_id, date, close, close AS adj_close FROM bars)")
def s11(spark, d):
    raw = L.read_loose(spark, csv_folder(spark, d) + "/*/*.csv", "csv").drop("Adj Close", "Vol", "O")
    return L.normalize_bars(raw)


@query("s12_read_macro_csv", "date:d value:p", f"{SQL_MACRO}, out AS (SELECT date, value FROM macro WHERE series = 'LEVEL' AND month(date) <> 4 AND date >= DATE '1996-01-01')")
def s12(spark, d):
    path = workspace(spark, "macro")
    m = T.macro(spark, d).where("series = 'LEVEL'").select(F.col("date").alias("DATE"), F.when(F.month("date") == 4, F.lit(".")).otherwise(F.col("value").cast("string")).alias("VALUE"))
    m.write.option("header", "true").csv(path)
    return L.read_macro_csv(spark, path, lo="1996-01-01")


def session_files(spark, d, dup=False):
    """A file of pipe-delimited session text for each year, with trailers, lower-case symbols and zero-volume rows; odd years have another column
    order, the file of 1995 lacks the total. ``dup`` puts rows to be replaced before some of the rows."""
    path = workspace(spark, "sessions")
    s = T.short_volume(spark, d).withColumns({"no": T.brand_no(), "y": F.year("date")})
    sym, day = F.concat(F.lit(" b"), F.col("no").cast("string"), F.lit(" ")), F.date_format("date", "yyyyMMdd")
    total = F.when((F.col("no") == 4) & (F.month("date") == 1), 0.0).otherwise(F.col("total_volume"))
    odd = F.col("y") % 2 == 1
    line = lambda short, total: F.when(odd, F.concat_ws("|", sym, total, day, short, F.lit("0"))).otherwise(F.concat_ws("|", day, sym, short, F.lit("0"), total, F.lit("Q")))
    head = F.when(F.col("y") == 1995, "Symbol|Total|Date|ShortVolume|ShortExemptVolume").when(odd, "Symbol|TotalVolume|Date|ShortVolume|ShortExemptVolume").otherwise("Date|Symbol|ShortVolume|ShortExemptVolume|TotalVolume|Market")
    at = lambda k, v: F.struct(F.lit(k).alias("p"), v.alias("value"))
    out = [at(0, head), at(2, line(F.col("short_volume").cast("string"), total.cast("string"))), at(3, F.concat(F.lit("Records: "), F.col("no").cast("string")))]
    if dup:
        out.append(at(1, F.when((F.col("no") % 3 == 0) & (total > 0), line(F.lit("1"), F.lit("2")))))
    x = s.select("y", F.explode(F.array(*out)).alias("x")).select("y", "x.*").where("value is not null").dropDuplicates()
    x.repartition("y").sortWithinPartitions("y", "p").select("y", "value").write.partitionBy("y").text(path)
    return path


SV = f"{SQL_LINES}, {SQL_SHORT}, sq AS (SELECT date, 'B' || substr(series_id, 7) AS series_id, short_volume, total_volume FROM sv WHERE NOT (series_id = 'Brand#4' AND month(date) = 1) AND year(date) <> 1995)"


@query("s13_read_sessions", "date:d series_id:s short_volume:f short_exempt_volume:f total_volume:f", f"{SV}, out AS (SELECT *, 0 AS short_exempt_volume FROM sq)")
def s13(spark, d):
    return L.parse_session_files(L.placed_lines(spark, session_files(spark, d)))[0]


@query("s13_session_rejects", "y:i reason:s", f"{SV}, out AS (SELECT DISTINCT year(date) AS y, 'missing columns: TotalVolume' AS reason FROM sv WHERE year(date) = 1995)")
def s13r(spark, d):
    refused = L.parse_session_files(L.placed_lines(spark, session_files(spark, d)))[1]
    return refused.select(F.regexp_extract("file", r"y=(\d+)/", 1).cast("int").alias("y"), "reason")


@query("s14_short_share", "series_id:s date:d share:f", f"{SQL_LINES}, {SQL_SHORT}, out AS (SELECT series_id, date, short_volume / nullif(total_volume, 0) AS share FROM sv)")
def s14(spark, d):
    return T.short_volume(spark, d).withColumn("share", L.short_share())


@query("s14_short_panel", "date:d b1:f b2:f", f"{SQL_LINES}, {SQL_SHORT}, out AS (SELECT date, max(CASE WHEN series_id = 'Brand#1' THEN short_volume / total_volume END) AS b1, max(CASE WHEN series_id = 'Brand#2' THEN short_volume / total_volume END) AS b2 FROM sv WHERE series_id IN ('Brand#1', 'Brand#2') GROUP BY 1)")
def s14p(spark, d):
    p = L.short_panel(T.short_volume(spark, d), ["Brand#1", "Brand#2"])
    return p.select("date", F.col("`Brand#1`").alias("b1"), F.col("`Brand#2`").alias("b2"))


@query("s15_regroup_sessions", "series_id:s n:i s:f t:f", f"{SV}, out AS (SELECT series_id, count(*) AS n, sum(short_volume) AS s, sum(total_volume) AS t FROM sq GROUP BY 1)")
def s15(spark, d):
    r = L.regroup_sessions(L.parse_session_files(L.placed_lines(spark, session_files(spark, d, dup=True)))[0])
    return r.groupBy("series_id").agg(F.count("*").alias("n"), F.sum("short_volume").alias("s"), F.sum("total_volume").alias("t"))


@query("s16_incremental_tail", "series_id:s n:i first:d", f"{BARS}, out AS (SELECT series_id, count(*) AS n, min(date) AS first FROM bars WHERE CAST(substr(series_id, 7) AS INTEGER) % 4 = 0 OR date > DATE '1999-06-30' GROUP BY 1)")
def s16(spark, d):
    b = T.bars(spark, d)
    stored_part = b.where((F.col("date") <= F.to_date(F.lit("1999-06-30"))) & (T.brand_no() % 4 != 0))
    return L.tail_after(b, stored_part).groupBy("series_id").agg(F.count("*").alias("n"), F.min("date").alias("first"))


@query("s17_level_to_yoy", "series:s date:d value:f", f"""{SQL_MACRO}, m AS (SELECT *, median(value) OVER (PARTITION BY series) AS md, lag(value, 12) OVER (PARTITION BY series ORDER BY date) AS pv FROM macro),
o AS (SELECT series, date, CASE WHEN md > 30 THEN (value / nullif(pv, 0) - 1) * 100 ELSE value END AS value FROM m), out AS (SELECT * FROM o WHERE value IS NOT NULL)""")
def s17(spark, d):
    return L.level_to_yoy(T.macro(spark, d))


@query("s17_level_to_yoy_named", "series:s date:d value:f", f"""{SQL_MACRO}, m AS (SELECT *, lag(value, 12) OVER (PARTITION BY series ORDER BY date) AS pv FROM macro),
o AS (SELECT series, date, CASE WHEN series = 'LEVEL' THEN (value / nullif(pv, 0) - 1) * 100 ELSE value END AS value FROM m), out AS (SELECT * FROM o WHERE value IS NOT NULL)""")
def s17n(spark, d):
    # Both medians are above zero, but only the named series is a level.
    return L.level_to_yoy(T.macro(spark, d), level_above=0.0, series=["LEVEL"])


@query("s19_registry_append", "strategy:s scenario:s status:s dev_sharpe:f", f"{RG}, out AS (SELECT strategy, scenario, CASE WHEN failed THEN 'failed' ELSE 'ok' END AS status, CASE WHEN NOT failed THEN dev_sharpe END AS dev_sharpe FROM reg)")
def s19(spark, d):
    path = workspace(spark, "registry")
    r = registry(spark, d)
    for u in ("universe_hash = 'u1'", "coalesce(universe_hash, 'u2') = 'u2'"):
        ST.append_registry(r.where(u), path)
    x = ST.load_registry(spark, path, r.schema)
    return x.select("strategy", "scenario", "status", F.col("metrics_dev.sharpe").alias("dev_sharpe"))


@query("s20_curve_store", "strategy:s n:i growth:f", f"{SQL_CURVES}, out AS (SELECT strategy, count(*) AS n, sum(ret) AS growth FROM cv WHERE line = 2 GROUP BY 1)")
def s20(spark, d):
    path = workspace(spark, "curves")
    c = curves(spark, d)
    ST.write_curves(c, path)
    return ST.load_curves(spark, path, c.where("line = 2").select("strategy")).groupBy("strategy").agg(F.count("*").alias("n"), F.sum("ret").alias("growth"))


@query("s21_result_sinks", "strategy:s verdict:s score:f", f"{RG}, {SQL_RANK}, out AS (SELECT * FROM ranked)")
def s21(spark, d):
    from ..operators.ranking import rank

    path = workspace(spark, "report")
    ST.write_report(rank(registry(spark, d)).select("strategy", "verdict", "score"), path)
    csv = spark.read.schema("strategy string, verdict string, score double").option("header", "true").csv(f"{path}/csv")
    return csv.join(spark.read.parquet(f"{path}/parquet").select("strategy"), "strategy")


# ------------------------------------------------------------------ filings from company-facts payloads
SQL_FACTS = """qf AS (SELECT series_id AS cik, CAST(substr(series_id, 7) AS INTEGER) AS no, CAST(date_trunc('quarter', l_shipdate) AS DATE) AS st, CAST(last_day(date_trunc('quarter', l_shipdate) + INTERVAL 2 MONTH) AS DATE) AS en,
 sum(l_extendedprice) AS rev, sum(l_extendedprice * l_discount) AS cash, sum(l_quantity) AS shr FROM lines GROUP BY ALL),
yt AS (SELECT *, sum(cash) OVER (PARTITION BY cik, year(st) ORDER BY st) AS ytd, CAST(date_trunc('year', st) AS DATE) AS ys FROM qf),
facts AS (SELECT cik, CASE WHEN no % 2 = 0 THEN 'Revenues' ELSE 'SalesRevenueNet' END AS concept, 'USD' AS unit, st AS start, en AS "end", rev AS val, '10-Q' AS form, en + 40 AS filed FROM qf
 UNION ALL SELECT cik, 'SalesRevenueNet', 'USD', st, en, rev * 2, '10-Q', en + 41 FROM qf WHERE no % 2 = 0 UNION ALL SELECT cik, CASE WHEN no % 2 = 0 THEN 'Revenues' ELSE 'SalesRevenueNet' END, 'USD', st, en, rev + 1, '10-Q/A', en + 90 FROM qf
 UNION ALL SELECT cik, CASE WHEN no % 2 = 0 THEN 'Revenues' ELSE 'SalesRevenueNet' END, 'USD', st, en, rev + 5, '8-K', en + 10 FROM qf
 UNION ALL SELECT cik, 'NetCashProvidedByUsedInOperatingActivities', 'USD', CASE WHEN no % 3 = 0 THEN ys ELSE st END, en, CASE WHEN no % 3 = 0 THEN ytd ELSE cash END, '10-Q', en + 40 FROM yt WHERE no % 3 <> 0 OR month(st) > 1
 UNION ALL SELECT cik, 'PaymentsToAcquirePropertyPlantAndEquipment', 'USD', st, en, cash / 4, '10-K', en + 40 FROM qf WHERE no % 5 <> 0
 UNION ALL SELECT cik, 'WeightedAverageNumberOfDilutedSharesOutstanding', 'shares', st, en, shr, '10-Q', en + 40 FROM qf UNION ALL SELECT cik, 'Assets', 'USD', NULL, en, rev * 4, '10-Q', en + 40 FROM qf WHERE no % 4 <> 0)"""


def fact_payload(spark, d):
    """One JSON document per filer with the facts that the SQL text above lists."""
    q = T.lines(spark, d).groupBy(F.col("series_id").alias("cik"), F.trunc(T.day_of(), "quarter").alias("st")).agg(
        F.sum("l_extendedprice").alias("rev"), F.sum(F.col("l_extendedprice") * F.col("l_discount")).alias("cash"), F.sum("l_quantity").alias("shr"))
    from pyspark.sql import Window

    q = q.withColumns({"no": T.brand_no("cik"), "en": F.last_day(F.add_months("st", 2)), "ys": F.trunc("st", "year")})
    q = q.withColumn("ytd", F.sum("cash").over(Window.partitionBy("cik", "ys").orderBy("st")))
    rev = F.when(F.col("no") % 2 == 0, "Revenues").otherwise("SalesRevenueNet")

    def fact(concept, unit, start, val, form, lag, cond):
        s = F.struct((concept if not isinstance(concept, str) else F.lit(concept)).alias("concept"), F.lit(unit).alias("unit"), start.alias("start"), F.col("en").alias("end"), val.cast("double").alias("val"),
                     F.lit(form).alias("form"), F.date_add("en", lag).alias("filed"))
        return F.when(cond, s)

    st, yes, no = F.col("st"), F.lit(True), F.col("no")
    ocf = "NetCashProvidedByUsedInOperatingActivities"
    fs = [fact(rev, "USD", st, F.col("rev"), "10-Q", 40, yes), fact("SalesRevenueNet", "USD", st, F.col("rev") * 2, "10-Q", 41, no % 2 == 0), fact(rev, "USD", st, F.col("rev") + 1, "10-Q/A", 90, yes),
          fact(rev, "USD", st, F.col("rev") + 5, "8-K", 10, yes), fact(ocf, "USD", F.when(no % 3 == 0, F.col("ys")).otherwise(st), F.when(no % 3 == 0, F.col("ytd")).otherwise(F.col("cash")), "10-Q", 40, (no % 3 != 0) | (F.month("st") > 1)),
          fact("PaymentsToAcquirePropertyPlantAndEquipment", "USD", st, F.col("cash") / 4, "10-K", 40, no % 5 != 0), fact("WeightedAverageNumberOfDilutedSharesOutstanding", "shares", st, F.col("shr"), "10-Q", 40, yes),
          fact("Assets", "USD", F.lit(None).cast("date"), F.col("rev") * 4, "10-Q", 40, no % 4 != 0)]
    f = q.select("cik", F.inline(F.filter(F.array(*fs), lambda x: x.isNotNull())))
    u = f.groupBy("cik", "concept", "unit").agg(F.collect_list(F.struct("start", "end", "val", "form", "filed")).alias("fs"))
    c = u.groupBy("cik", "concept").agg(F.struct(F.map_from_entries(F.collect_list(F.struct("unit", "fs"))).alias("units")).alias("c"))
    return c.groupBy("cik").agg(F.to_json(F.map_from_entries(F.collect_list(F.struct("concept", "c")))).alias("body"))


SQL_PREF = "pref AS (SELECT * FROM (VALUES ('revenue', 'RevenueFromContractWithCustomerExcludingAssessedTax', 0), ('revenue', 'Revenues', 1), ('revenue', 'SalesRevenueNet', 2), ('ocf', 'NetCashProvidedByUsedInOperatingActivities', 0), ('capex', 'PaymentsToAcquirePropertyPlantAndEquipment', 0), ('shares', 'WeightedAverageNumberOfDilutedSharesOutstanding', 0), ('assets', 'Assets', 0)) v(field, concept, p)), c1 AS (SELECT f.*, field FROM facts f JOIN pref USING (concept) QUALIFY p = min(p) OVER (PARTITION BY cik, field))"
SQL_ORIG = "c2 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY cik, field, \"end\" ORDER BY filed, start, val) AS rn FROM c1 WHERE form IN ('10-Q', '10-K', '10-Q/A', '10-K/A')) WHERE rn = 1)"
SQL_QV = """c3 AS (SELECT *, start IS NULL OR "end" - start BETWEEN 75 AND 100 AS isq, count_if(start IS NULL OR "end" - start BETWEEN 75 AND 100) OVER (PARTITION BY cik, field) AS nq FROM c2),
c4 AS (SELECT cik, field, "end", filed, CASE WHEN nq >= 4 OR start IS NULL THEN val ELSE coalesce(val - lag(val) OVER (PARTITION BY cik, field, year(start) ORDER BY "end"), val) END AS val, isq, nq FROM c3), qv AS (SELECT * FROM c4 WHERE nq < 4 OR isq)"""
FX = f"{SQL_LINES}, {SQL_FACTS}, {SQL_PREF}"


@query("s22_coalesce_concepts", "cik:s field:s concept:s unit:s n:i v:p", f"{FX}, out AS (SELECT cik, field, concept, unit, count(*) AS n, sum(val) AS v FROM c1 GROUP BY ALL)")
def s22(spark, d):
    x = FI.coalesce_concepts(FI.explode_facts(fact_payload(spark, d)))
    return x.groupBy("cik", "field", "concept", "unit").agg(F.count("*").alias("n"), F.sum("val").alias("v"))


@query("s23_original_values", "cik:s field:s end:d val:p form:s filed:d", f"{FX}, {SQL_ORIG}, out AS (SELECT * FROM c2)")
def s23(spark, d):
    return FI.original_values(FI.coalesce_concepts(FI.explode_facts(fact_payload(spark, d))))


@query("s24_quarter_values", "cik:s field:s end:d val:p", f"{FX}, {SQL_ORIG}, {SQL_QV}, out AS (SELECT * FROM qv)")
def s24(spark, d):
    return FI.quarter_values(FI.original_values(FI.coalesce_concepts(FI.explode_facts(fact_payload(spark, d)))))


@query("s25_quarter_rows", "cik:s period_end:d published:d revenue:p fcf:p shares:p assets:p rnd:p", f"""{FX}, {SQL_ORIG}, {SQL_QV}, wd AS (SELECT cik, "end" AS period_end, {', '.join(f"max(CASE WHEN field = '{f}' THEN val END) AS {f}" for f in ('revenue', 'ocf', 'capex', 'shares', 'assets'))},
 max(CASE WHEN field = 'revenue' THEN filed END) AS published FROM qv GROUP BY 1, 2), out AS (SELECT *, ocf - coalesce(capex, 0) AS fcf, NULL AS rnd FROM wd WHERE revenue IS NOT NULL)""")
def s25(spark, d):
    return FI.quarter_rows(FI.quarter_values(FI.original_values(FI.coalesce_concepts(FI.explode_facts(fact_payload(spark, d))))))


# ------------------------------------------------------------------ streaming
@query("t1_stream_sessions", "date:d series_id:s short_volume:f total_volume:f", f"{SV}, out AS (SELECT * FROM sq)")
def t1(spark, d):
    root = workspace(spark, "stream")
    jobs.ingest_sessions(spark, session_files(spark, d, dup=True), f"{root}/out", f"{root}/ck", files_per_trigger=3).awaitTermination()
    return jobs.stored_sessions(spark, f"{root}/out")


@query("t2_stream_bars", "series_id:s day:d open:f high:f low:f close:f volume:f n:i", """out AS (SELECT event_type AS series_id, CAST(ts AS DATE) AS day, first(value ORDER BY ts, event_id) AS open, max(value) AS high, min(value) AS low, last(value ORDER BY ts, event_id) AS close, sum(value) AS volume, count(*) AS n FROM events GROUP BY 1, 2)""")
def t2(spark, d):
    root = workspace(spark, "stream")
    jobs.run_bars(spark, f"{d.rstrip('/')}/events.parquet", f"{root}/out", f"{root}/ck").awaitTermination()
    return jobs.read_bars(spark, f"{root}/out").withColumn("day", jobs.utc_day("start"))


@query("t2_batch_bars", "series_id:s day:d open:f high:f low:f close:f volume:f n:i", """out AS (SELECT event_type AS series_id, CAST(ts AS DATE) AS day, first(value ORDER BY ts, event_id) AS open, max(value) AS high, min(value) AS low, last(value ORDER BY ts, event_id) AS close, sum(value) AS volume, count(*) AS n FROM events GROUP BY 1, 2)""")
def t2b(spark, d):
    return jobs.tumbling_bars(T.table(spark, d, "events")).withColumn("day", jobs.utc_day("start"))
