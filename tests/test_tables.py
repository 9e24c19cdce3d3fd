"""Cleaning, latest/snapshot, history operators on hand-made fixtures."""

import datetime as dt
import gzip
import os

import pytest
from pyspark.sql import functions as F

from haze.operators import clean, history, latest
from haze.schemas import HISTORY_SCHEMA


def test_clean_parameter(spark):
    names = [" PM2.5 ", "pm2_5", "\tPM10\n", "Temperature", " relativehumidity", "CO", "weird"]
    df = spark.createDataFrame([(n,) for n in names], "p string")
    got = [r[0] for r in df.select(clean.clean_parameter("p")).collect()]
    assert got == ["pm25", "pm25", "pm10", "temperature", "relativehumidity", "co", "weird"]


def test_read_raw_csv_partitions_and_bad_cells(spark, tmp_dir):
    for month, rows in {"2025-01": ["1,2025-01-01T10:00:00+07:00,pm2.5,12.5,21.0,105.8",
                                    "1,2025-01-01T10:00:00+07:00,PM2_5 ,13.5,21.0,105.8",
                                    "x,2025-01-01T11:00:00+07:00,pm10,oops,21.0,105.8"],
                        "2025-02": ["2, 2025-02-01T10:00:00+07:00 ,pm10,40,21.0,105.8",
                                    "2,not-a-date,pm10,41,21.0,105.8"]}.items():
        d = os.path.join(tmp_dir, f"month={month}")
        os.makedirs(d)
        with gzip.open(os.path.join(d, "location-1.csv.gz"), "wt") as fh:
            fh.write("location_id,datetime,parameter,value,lat,lon\n" + "\n".join(rows) + "\n")
    raw = clean.read_raw_readings(spark, os.path.join(tmp_dir, "month=*", "location-*.csv.gz"))
    assert raw.count() == 5
    bad = raw.where(F.col("value").isNull() | F.col("location_id").isNull()).count()
    assert bad == 1
    # partition column discovered from the folder names when reading the root
    root = clean.read_raw_readings(spark, tmp_dir)
    assert "month" in root.columns
    assert root.where(F.col("month") == "2025-02").count() == 2
    cleaned = clean.clean_long(raw)
    good, quarantined = clean.split_quarantine(cleaned)
    assert quarantined.count() == 1 and good.count() == 4
    wide = clean.pivot_mean(good, ("location_id", "ts"), None)
    row = wide.where(F.col("location_id") == 1).where(F.col("pm25").isNotNull()).first()
    assert row.pm25 == pytest.approx(13.0)
    assert row.ts == dt.datetime(2025, 1, 1, 3, 0)


def test_strict_datetime_fails(spark):
    df = spark.createDataFrame([("garbage", "pm10")], "datetime string, parameter string")
    with pytest.raises(Exception):
        clean.clean_long(df, on_bad_datetime="fail").collect()


def test_align_to_schema(spark):
    old = spark.createDataFrame([("2024-01-01T00:00:00+00:00", 12.5, 50, "Tốt (Good)")],
                                "datetime string, pm25 double, aqi int, quality string")
    out = clean.align_to_schema(old, HISTORY_SCHEMA)
    assert out.schema == HISTORY_SCHEMA
    r = out.first()
    assert r.pm25 == 12.5 and r.location_id is None and r.aqi_pm10 is None
    assert clean.select_available(old, ["aqi", "missing", "pm25"]).columns == ["aqi", "pm25"]


def _rows(spark, rows):
    return spark.createDataFrame(
        rows, "location_id long, datetime string, event_ts timestamp, pm25 double, aqi int, "
              "processed_at timestamp")


T0 = dt.datetime(2024, 1, 1, 0, 0)


def test_latest_ties_nulls_no_regress(spark):
    rows = [(1, "a", T0, 10.0, 5, T0), (1, "b", T0, 20.0, 7, T0),          # tie on event_ts
            (1, "c", T0 - dt.timedelta(hours=1), 99.0, 300, T0),
            (None, "d", T0, 1.0, 1, T0), (2, None, None, 3.0, 2, T0),
            (2, "e", T0, 4.0, 3, T0)]
    got = {r.location_id: r for r in latest.latest_per_key(_rows(spark, rows)).collect()}
    assert got[1].datetime == "b"         # deterministic tie-break on the next key
    assert got[2].datetime == "e"         # a null instant never wins
    assert got[None].datetime == "d"      # null id is its own key


def test_snapshot_merge_never_regresses(spark, tmp_dir):
    from haze.streaming.job import merge_snapshot
    path = os.path.join(tmp_dir, "snap")
    new = _rows(spark, [(1, "new", T0, 50.0, 80, T0)])
    old = _rows(spark, [(1, "old", T0 - dt.timedelta(days=1), 1.0, 1, T0)])
    merge_snapshot(spark, new, path)
    merge_snapshot(spark, old, path)   # an older reading arriving later
    snap = spark.read.parquet(path)
    assert [r.datetime for r in snap.collect()] == ["new"]


def test_ttl_and_kv_roundtrip(spark):
    base = _rows(spark, [(1, "2024-01-01T00:00:00+00:00", T0, 12.5, 50, T0),
                         (2, None, T0, None, None, T0 - dt.timedelta(hours=2))])
    alive = latest.fresh(base, T0 + dt.timedelta(minutes=30))
    assert [r.location_id for r in alive.collect()] == [1]
    kv = latest.to_kv(base)
    rows = {r.key: r.fields for r in kv.collect()}
    assert rows["location:2"]["aqi"] == "0" and rows["location:2"]["quality"] == "N/A"
    assert rows["location:2"]["pm25"] == "" and rows["location:1"]["pm25"] == "12.5"
    assert rows["location:1"]["processed_at"] == "2024-01-01 00:00:00"
    back = {r.location_id: r for r in latest.from_kv(kv).collect()}
    assert back[1].pm25 == 12.5 and back[2].aqi == 0 and back[2].pm25 is None
    weird = spark.createDataFrame([("location:7", {"aqi": "7.9", "pm25": " ", "quality": "x"})],
                                  "key string, fields map<string,string>")
    w = latest.from_kv(weird).first()
    assert w.aqi == 7 and w.pm25 is None and w.location_id == 7 and w.processed_at == ""


def test_fallback_branches(spark):
    hist = _rows(spark, [(1, "h", T0, 1.0, 1, T0)])
    empty = hist.where(F.lit(False))
    cols = ["location_id", "datetime"]
    assert [r.source for r in latest.latest_or_history(empty, hist, cols).collect()] == ["history"]
    assert [r.source for r in latest.latest_or_history(hist, hist, cols).collect()] == ["snapshot"]


def test_upsert_idempotent_and_partition_local(spark, tmp_dir):
    path = os.path.join(tmp_dir, "hist")
    day1 = _rows(spark, [(1, "d1", T0, 1.0, 1, T0), (2, "d1", T0, 2.0, 2, T0)])
    day2 = _rows(spark, [(1, "d2", T0 + dt.timedelta(days=1), 3.0, 3, T0)])
    history.upsert_history(spark, day1, path)
    history.upsert_history(spark, day2, path)
    history.upsert_history(spark, day2, path)          # retried batch: no duplicate
    assert spark.read.parquet(path).count() == 3
    newer = _rows(spark, [(1, "d2", T0 + dt.timedelta(days=1), 9.0, 9, T0 + dt.timedelta(1))])
    history.upsert_history(spark, newer, path)
    t = spark.read.parquet(path)
    assert t.count() == 3
    assert t.where(F.col("datetime") == "d2").first().pm25 == 9.0
    assert t.where(F.col("datetime") == "d1").count() == 2     # other day untouched


def test_latest_history_bounds(spark):
    df = _rows(spark, [(i, str(i), T0 + dt.timedelta(seconds=i), 1.0, 1, T0) for i in range(5)])
    top = history.latest_history(df, 2).collect()
    assert [r.location_id for r in top] == [4, 3]
    for n in (0, 10_001):
        with pytest.raises(ValueError):
            history.latest_history(df, n)
    plan = history.latest_history(df, 2)._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan


def test_append_read_history_and_write_wide(spark, tmp_dir):
    rows = _rows(spark, [(1, "a", T0, 1.0, 1, T0),
                         (2, "b", T0 + dt.timedelta(days=2), 2.0, 2, T0)])
    path = os.path.join(tmp_dir, "h")
    history.append_history(rows, path)
    history.append_history(rows, path)
    back = history.read_history(spark, path)
    assert back.count() == 4 and "event_date" in back.columns
    proj = history.read_history(spark, path, columns=["datetime", "aqi", "nope"])
    assert proj.columns == ["datetime", "aqi"]
    looked = history.history_query(back, station=2, since="2024-01-02 00:00:00")
    assert looked.count() == 2
    plan = looked._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "event_date" in plan
    wide = spark.createDataFrame([(1, T0, 3.0), (1, T0 + dt.timedelta(days=1), 4.0)],
                                 "location_id long, datetime timestamp, pm25 double")
    clean.write_wide(wide, os.path.join(tmp_dir, "w"))
    w = spark.read.parquet(os.path.join(tmp_dir, "w"))
    assert w.count() == 2 and sorted(str(r.date) for r in w.collect()) == ["2024-01-01",
                                                                           "2024-01-02"]


def test_newest_partitions_prune_and_keep_answer(spark, tmp_dir):
    rows = [(i % 3, f"t{i}", T0 + dt.timedelta(hours=7 * i), float(i), i, T0) for i in range(40)]
    path = os.path.join(tmp_dir, "h")
    history.append_history(_rows(spark, rows), path)
    table = spark.read.parquet(path)
    for n in (1, 5, 17, 40):
        got = [r.datetime for r in history.latest_history(table, n).collect()]
        plain = table.orderBy(F.col("event_ts").desc(), F.col("location_id").desc()).limit(n)
        assert got == [r.datetime for r in plain.collect()]
    plan = history.latest_history(table, 5)._jdf.queryExecution().executedPlan().toString()
    pf = [ln for ln in plan.split("\n") if "PartitionFilters: [(isnull(event_date" in ln]
    assert pf and "Subquery" in pf[0]
    # the snapshot guard becomes a partition filter on the history scan
    snap = _rows(spark, [(1, "s", T0, 1.0, 1, T0)])
    out = latest.latest_or_history(snap, table, ["location_id", "datetime"], 5)
    assert [r.source for r in out.collect()] == ["snapshot"]
    scans = [ln for ln in out._jdf.queryExecution().executedPlan().toString().split("\n")
             if "event_date" in ln and "PartitionFilters" in ln]
    assert scans and all("isnull" in ln for ln in scans)


def test_hourly_granularity_upsert_and_pruning(spark, tmp_dir):
    path = os.path.join(tmp_dir, "hh")
    rows = [(i % 2, f"t{i}", T0 + dt.timedelta(minutes=25 * i), float(i), i, T0)
            for i in range(12)]
    history.upsert_history(spark, _rows(spark, rows), path, granularity="hour")
    again = [(0, "t0", T0, 99.0, 99, T0 + dt.timedelta(hours=1))]
    history.upsert_history(spark, _rows(spark, again), path, granularity="hour")
    t = spark.read.parquet(path)
    assert "event_hour" in t.columns and t.count() == 12
    assert t.where(F.col("datetime") == "t0").first().pm25 == 99.0
    q = history.history_query(t, since="2024-01-01 02:00:00", until="2024-01-01 03:00:00")
    assert sorted(r.datetime for r in q.collect()) == ["t5", "t6", "t7"]
    plan = q._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(event_hour" in plan
    top = [r.datetime for r in history.latest_history(t, 3).collect()]
    assert top == ["t11", "t10", "t9"]


def test_kv_and_ratio_overflow_is_null_not_error(spark):
    from haze.functions.values import pm25_share
    weird = spark.createDataFrame([("location:1", {"aqi": "1e20", "aqi_pm25": "nan"})],
                                  "key string, fields map<string,string>")
    r = latest.from_kv(weird).first()
    assert r.aqi == 0 and r.aqi_pm25 is None
    df = spark.createDataFrame([(100.0, 1e-300), (5.0, 10.0), (5.0, 0.0), (5.0, -1.0)],
                               "pm25 double, pm10 double")
    assert [x[0] for x in df.select(pm25_share("pm25", "pm10")).collect()] == [None, 50, None, 0]


def test_keyed_merge_files_follow_partition_size(spark, tmp_dir, monkeypatch):
    monkeypatch.setattr(history, "ROWS_PER_FILE", 4)
    big = [(i, f"b{i}", T0 + dt.timedelta(minutes=i), 1.0, 1, T0) for i in range(40)]
    small = [(1, "s", T0 + dt.timedelta(days=3), 1.0, 1, T0)]
    path = os.path.join(tmp_dir, "sized")
    history.upsert_history(spark, _rows(spark, big + small), path)
    counts = {}
    for d, _, files in os.walk(path):
        n = len([f for f in files if f.endswith(".parquet")])
        if n:
            counts[os.path.basename(d)] = n
    assert counts["event_date=2024-01-04"] == 1
    assert 5 <= counts["event_date=2024-01-01"] <= 10        # 40 rows / 4 per file, hashed
    assert spark.read.parquet(path).count() == 41


def test_align_and_score_tolerate_bad_text(spark):
    from haze.functions import aqi
    old = spark.createDataFrame([("2024-01-01T00:00:00+00:00", "N/A", "12.5")],
                                "datetime string, aqi string, pm25 string")
    r = clean.align_to_schema(old, HISTORY_SCHEMA).first()
    assert r.aqi is None and r.pm25 == 12.5
    s = old.select(aqi.aqi_pm25("aqi").alias("a"), aqi.aqi_pm25("pm25").alias("b")).first()
    assert (s.a, s.b) == (0, 25)


def test_from_kv_malformed_keys(spark):
    df = spark.createDataFrame([("garbage", {"aqi": "5"}), (None, {"aqi": "1"}),
                                ("location:x", {})], "key string, fields map<string,string>")
    got = [(r.location_id, r.aqi) for r in latest.from_kv(df).collect()]
    assert got == [(None, 5), (None, 1), (None, 0)]
