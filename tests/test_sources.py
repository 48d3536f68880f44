import datetime
import os

import pytest
from pyspark.sql import functions as F

from barloom.operators import quality as Q
from barloom.session import workspace
from barloom.sources import loose as L
from barloom.sources import store as ST
from barloom.sources import tables as T
from barloom.streaming import jobs


def write_files(spark, tag, files):
    root = workspace(spark, tag).removeprefix("file:")
    os.makedirs(root)
    for name, text in files.items():
        with open(f"{root}/{name}", "w", newline="") as f:
            f.write(text)
    return root


OLD = "Date|Symbol|ShortVolume|ShortExemptVolume|TotalVolume|Market\n"


def test_session_files_are_read_by_their_own_header(spark):
    root = write_files(spark, "sessions", {
        "a.txt": OLD + "20200103| aapl |10|0|40|Q\n20200103|ZERO|0|0|0|Q\n20200103||5|0|9|Q\n20201399|X|1|0|2|Q\nRecords: 3\n",
        "b.txt": "\nSymbol|TotalVolume|Date|ShortVolume\nAAPL|50|20200106|11\nAAPL|60|20200106|12\n",
        "c.txt": "Date|Symbol|ShortVolume\n20200107|AAPL|1\n", "d.txt": ""})
    rows, refused = L.parse_session_files(L.placed_lines(spark, root))
    got = sorted((str(r["date"]), r["series_id"], r["short_volume"], r["short_exempt_volume"], r["total_volume"]) for r in L.regroup_sessions(rows).collect())
    assert got == [("2020-01-03", "AAPL", 10.0, 0.0, 40.0), ("2020-01-06", "AAPL", 12.0, None, 60.0)]
    assert [(r["file"][-5:], r["reason"]) for r in refused.collect()] == [("c.txt", "missing columns: TotalVolume")]


def test_loose_files_keep_their_columns_and_bad_files_are_told(spark):
    root = write_files(spark, "loose", {
        "abc.csv": "Date,Open,Close,Vol\n2020-01-02,1,2,n/a\n2020-01-03,3,\"4\",5\n2020-01-03,9,9,9\n",
        "xyz.csv": "close,adj close,timestamp,o\r\n7,6,2020-01-02T00:00:00,8\r\n,1,2020-01-03,2\r\n",
        "bad.csv": "Date,Close\n2020-01-02,1\nsoon,2\n", "nodate.csv": "Open,Close\n1,2\n", "noclose.csv": "Date,Open\n2020-01-02,2\n", "empty.csv": ""})
    bars, rejects = L.import_loose_csv(spark, f"{root}/*.csv")
    got = sorted((r["series_id"], str(r["date"]), r["open"], r["high"], r["close"], r["adj_close"], r["volume"]) for r in bars.collect())
    assert got == [("ABC", "2020-01-02", 1.0, 2.0, 2.0, 2.0, None), ("ABC", "2020-01-03", 3.0, 4.0, 4.0, 4.0, 5.0), ("XYZ", "2020-01-02", 8.0, 7.0, 7.0, 6.0, None), ("XYZ", "2020-01-03", 2.0, None, None, 1.0, None)]
    assert {r["series_id"]: r["reason"] for r in rejects.collect()} == {"BAD": "unreadable date", "NODATE": "no date column", "NOCLOSE": "no close column", "EMPTY": "empty file"}


def test_bad_dates_in_payloads_are_left_out(spark):
    p = spark.createDataFrame([("A", '{"2020-01-02": {"4. close": "1"}, "soon": {"4. close": "2"}}')], "series_id string, body string")
    assert [str(r["date"]) for r in L.flatten_dated_map(p).collect()] == ["2020-01-02"]
    p = spark.createDataFrame([("A", '[{"date": "2020-01-02T00", "close": 1}, {"date": "x", "close": 2}, {"close": 3}]')], "series_id string, body string")
    assert [str(r["date"]) for r in L.flatten_bar_list(p).collect()] == ["2020-01-02"]


def test_late_session_files_are_kept_and_batches_can_be_run_again(spark):
    root, out = write_files(spark, "late", {"1.txt": OLD + "20200601|A|1|0|2|Q\n"}), workspace(spark, "late-out")
    run = lambda ck: jobs.ingest_sessions(spark, root, out, f"{out}-{ck}").awaitTermination()
    run("ck")
    with open(f"{root}/2.txt", "w") as f:
        f.write(OLD + "20200330|A|3|0|4|Q\n20200601|A|9|0|9|Q\n20200601|B|5|0|6|Q\n")
    run("ck")
    want = [("2020-03-30", "A", 3.0), ("2020-06-01", "A", 1.0), ("2020-06-01", "B", 5.0)]
    read = lambda: sorted((str(r["date"]), r["series_id"], r["short_volume"]) for r in jobs.stored_sessions(spark, out).collect())
    assert read() == want
    # A job that has lost its checkpoint reads all files again.
    run("other")
    assert read() == want


def test_bars_of_late_events_and_open_windows(spark):
    root, out = workspace(spark, "events"), workspace(spark, "bars")
    add = lambda rows: spark.createDataFrame(rows, "event_id long, event_type string, ts timestamp_ntz, value double").coalesce(1).write.mode("append").parquet(root)
    day = lambda d, h: datetime.datetime(2020, 1, d, h)
    batches = [[(1, "a", day(5, 3), 1.0), (2, "a", day(5, 9), 5.0)], [(3, "a", day(9, 1), 2.0)], [(4, "a", day(5, 1), 3.0), (5, "b", day(1, 1), 7.0)], [(6, "a", day(5, 20), 0.5)]]
    for rows in batches:
        add(rows)
        jobs.run_bars(spark, root, out, f"{out}-ck", merge_every=3).awaitTermination()
    want = jobs.tumbling_bars(spark.read.parquet(root))
    got = jobs.read_bars(spark, out)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    # The third batch has merged the ones before it.
    assert sorted(f for f in os.listdir(out.removeprefix("file:")) if "=" in f) == ["batch=000000002", "batch=000000003"]


def test_normalize_needs_date_and_close(spark):
    with pytest.raises(ValueError, match="date"):
        L.normalize_bars(spark.createDataFrame([(1.0,)], "close double"))
    with pytest.raises(ValueError, match="close"):
        L.normalize_bars(spark.createDataFrame([("2020-01-01",)], "date string"))


def test_store_round_trip_and_missing_key(spark, sf):
    root = workspace(spark, "test-store")
    b = T.bars(spark, sf).select("series_id", "date", "open", "high", "low", "close", "adj_close", "volume", "dollar_volume")
    ST.write_dataset(b, root, "prices", "alpha")
    assert ST.read_dataset(spark, root, "prices", ST.BAR_SCHEMA).exceptAll(b).count() == 0
    assert ST.read_dataset(spark, root, "prices", ST.BAR_SCHEMA, ["Brand#1"]).select("series_id").distinct().count() == 1
    with pytest.raises(Exception, match="missing datasets"):
        ST.read_dataset(spark, root, "prices", ST.BAR_SCHEMA, ["Brand#1", "Nope"]).collect()


def test_assert_clean_raises(spark, sf):
    b = T.bars(spark, sf)
    assert Q.assert_clean(Q.validate_bars(b)).first()["clean"]
    with pytest.raises(Exception, match="price errors"):
        Q.assert_clean(Q.validate_bars(b.withColumn("open", -F.col("open")))).collect()


def test_leaky_filings_are_refused(spark, sf):
    f = T.fundamentals(spark, sf)
    kept, bad = L.accept_filings(f.withColumn("published", F.when(F.col("series_id") == "Brand#2", F.date_sub("period_end", 1)).otherwise(F.col("published"))), "series_id")
    assert [r["series_id"] for r in bad.collect()] == ["Brand#2"] and kept.where("series_id = 'Brand#2'").count() == 0
    with pytest.raises(ValueError, match="missing columns"):
        L.accept_filings(f, "series_id", L.FILING_COLUMNS)


def test_checksums(spark):
    f = spark.createDataFrame([("a", b"1"), ("b", b"2")], "path string, content binary")
    m = f.select("path", F.sha2("content", 256).alias("sha256")).where("path = 'a'").unionByName(spark.createDataFrame([("b", "00"), ("c", "11")], "path string, sha256 string"))
    assert sorted(tuple(r) for r in L.checksum_report(f, m).collect()) == [("b", "mismatch"), ("c", "missing")]
