import datetime as dt
import json
import os

import pytest
from pyspark.sql import functions as F

from haze.streaming import job, source

DIRTY = [
    '{"datetime":"2024-01-01T00:00:00.123456+00:00","location_id":1,"pm25":"x","pm10":3.5}',
    'plain garbage',
    '{"datetime":"2024-01-01T00:00:00+07:00","location_id":2,"pm25":null,"pm10":1.0}',
    '{"datetime":"2024-01-01T00:00:00Z","location_id":3,"pm25":12.5,"co":9.0}',
    '{"datetime":"2024-01-01T00:00:00+00:00","location_id":4,"pm25":NaN}',
    '{"datetime":"2024-01-01T00:00:00+00:00","location_id":null,"pm25":50.1}',
    '{"datetime":null,"location_id":6,"pm25":100.1}',
    '{"datetime":"2024-01-01 00:00:00","location_id":7,"pm25":25.1}',
]


def test_decode_dirty_lines(spark):
    df = spark.createDataFrame([(x,) for x in DIRTY] + [(None,)], "value string")
    dec = source.decode_readings(df)
    rows = dec.collect()
    by_id = {r.location_id: r for r in rows if r.location_id is not None}
    assert by_id[1].pm25 is None and by_id[1].pm10 == 3.5 and by_id[1].decode_status == "partial"
    assert by_id[1].event_ts == dt.datetime(2024, 1, 1, 0, 0, 0, 123456)
    assert by_id[2].event_ts == dt.datetime(2023, 12, 31, 17, 0)
    assert by_id[3].decode_status == "ok"
    assert by_id[6].event_ts is None and by_id[7].event_ts == dt.datetime(2024, 1, 1)
    good, bad = source.split_decoded(dec)
    assert bad.count() == 2 and good.count() == len(DIRTY) - 1
    scored = job.score_stream(good, clock=F.lit("2024-01-01 00:00:05").cast("timestamp"),
                              watermark=None)
    s = {r.location_id: r for r in scored.collect()}
    assert s[4].aqi_pm25 == 0                    # NaN scores 0, not 500
    assert s[None].aqi_pm25 == 0                 # 50.1 as float32 falls into the gap
    assert s[6].aqi_pm25 == 0                    # 100.1f too
    assert s[7].aqi_pm25 == 51                   # 25.1f stays inside


def _write(spark, path, items):
    spark.createDataFrame([(json.dumps(x),) for x in items], "value string") \
        .coalesce(1).write.mode("append").text(path)


def test_stream_dedup_fixture(spark, tmp_dir):
    inp, out, ck = (os.path.join(tmp_dir, p) for p in ("in", "out", "ck"))

    def msg(hhmm, pm):
        return {"datetime": f"2024-01-01T{hhmm}:00+00:00", "location_id": 1, "pm25": pm}

    def run():
        good, _ = source.split_decoded(source.decode_readings(
            source.readings_stream(spark, "text", inp)))
        s = job.dedup_stream(good.withWatermark("event_ts", "10 minutes")) \
            .select("location_id", "datetime", "pm25")
        job.run_to_completion(s, ck, fmt="parquet", path=out)

    _write(spark, inp, [msg("00:00", 1.0), msg("00:00", 1.0), msg("01:00", 2.0)])
    run()
    _write(spark, inp, [msg("00:10", 3.0), msg("00:55", 4.0), msg("01:00", 2.0)])
    run()                                          # restart from the same checkpoint
    got = sorted(r.datetime[11:16] for r in spark.read.parquet(out).collect())
    assert got == ["00:00", "00:55", "01:00"]


class _Boom(Exception):
    pass


def test_dual_sink_history_failure_fails_batch_and_retry_is_clean(spark, tmp_dir):
    inp, ck = os.path.join(tmp_dir, "in"), os.path.join(tmp_dir, "ck")
    hist, snap, alerts = (os.path.join(tmp_dir, p) for p in ("h", "s", "a"))
    _write(spark, inp, [{"datetime": "2024-01-01T00:00:00+00:00", "location_id": 1,
                         "pm25": 300.0, "pm10": 10.0},
                        {"datetime": "2024-01-01T00:05:00+00:00", "location_id": 2,
                         "pm25": 10.0, "pm10": 10.0}])

    def stream():
        good, _ = source.split_decoded(source.decode_readings(
            source.readings_stream(spark, "text", inp)))
        return job.score_stream(good)

    class Failing(job.DualSink):
        def __call__(self, batch, epoch_id):
            super().__call__(batch, epoch_id)
            raise _Boom("after the writes, before the commit")

    with pytest.raises(Exception):
        job.run_to_completion(stream(), ck, sink=Failing(spark, hist, snap, alerts))
    # The batch was not committed: it runs again and the keyed writes converge.
    job.run_to_completion(stream(), ck, sink=job.DualSink(spark, hist, snap, alerts))
    assert spark.read.parquet(hist).count() == 2
    assert spark.read.parquet(snap).count() == 2
    a = spark.read.parquet(alerts).collect()
    assert [(r.location_id, r.aqi) for r in a] == [(1, 350)]


def test_console_sink_and_progress(spark, tmp_dir):
    from haze.streaming.progress import ProgressLog
    inp = os.path.join(tmp_dir, "in")
    _write(spark, inp, [{"datetime": "2024-01-01T00:00:00+00:00", "location_id": 1,
                         "pm25": 1.0}])
    log = ProgressLog()
    spark.streams.addListener(log)
    try:
        good, _ = source.split_decoded(source.decode_readings(
            source.readings_stream(spark, "text", inp)))
        job.run_to_completion(job.score_stream(good, watermark=None),
                              os.path.join(tmp_dir, "ck"), fmt="console")
        import time
        time.sleep(1.0)
    finally:
        spark.streams.removeListener(log)
    rows = log.drain(spark).collect()
    assert sum(r.rows for r in rows) == 1


def test_encode_decode_roundtrip(spark):
    df = spark.createDataFrame([(1, dt.datetime(2024, 1, 1, 0, 0, 7, 5), 12.5, None)],
                               "location_id long, datetime timestamp, pm25 double, pm10 double")
    enc = source.encode_readings(df)
    v = json.loads(enc.first().value)
    assert v["datetime"] == "2024-01-01T00:00:07.000005+00:00" and v["pm25"] == 12.5
    back = source.decode_readings(enc).first()
    assert back.event_ts == dt.datetime(2024, 1, 1, 0, 0, 7, 5) and back.pm10 is None


def test_scoring_job_dual_mode(spark, tmp_dir):
    inp = os.path.join(tmp_dir, "in")
    _write(spark, inp, [{"datetime": "2024-01-01T00:00:00+00:00", "location_id": 5,
                         "pm25": 260.0, "pm10": 20.0}, "not json at all"])
    q = job.scoring_job(spark, source.readings_stream(spark, "text", inp), mode="dual",
                        checkpoint=os.path.join(tmp_dir, "ck"),
                        history_path=os.path.join(tmp_dir, "h"),
                        snapshot_path=os.path.join(tmp_dir, "s"),
                        alerts_path=os.path.join(tmp_dir, "a"),
                        trigger={"availableNow": True})
    q.awaitTermination()
    h = spark.read.parquet(os.path.join(tmp_dir, "h")).collect()
    assert [(r.location_id, r.aqi) for r in h] == [(5, 311)]
    assert spark.read.parquet(os.path.join(tmp_dir, "a")).count() == 1


def test_append_job_exactly_once_and_current_view(spark, tmp_dir):
    inp = os.path.join(tmp_dir, "in")
    hist, snap = os.path.join(tmp_dir, "h"), os.path.join(tmp_dir, "s")
    msg = {"datetime": "2024-01-01T00:00:00+00:00", "location_id": 1, "pm25": 30.0}
    _write(spark, inp, [msg, {**msg, "location_id": 2}])
    for q in job.scoring_job_append(spark, source.readings_stream(spark, "text", inp), hist,
                                    snap, checkpoint=os.path.join(tmp_dir, "ck"),
                                    trigger={"availableNow": True}):
        q.awaitTermination()
    _write(spark, inp, [msg])                     # the same reading delivered again
    for q in job.scoring_job_append(spark, source.readings_stream(spark, "text", inp), hist,
                                    snap, checkpoint=os.path.join(tmp_dir, "ck"),
                                    trigger={"availableNow": True}):
        q.awaitTermination()
    stored = spark.read.parquet(hist)
    assert stored.count() == 3 and "event_date" in stored.columns
    assert job.current_history(stored).count() == 2
    assert spark.read.parquet(snap).count() == 2


def test_kafka_source_without_connector_says_so(spark):
    with pytest.raises(RuntimeError, match="Kafka connector"):
        source.readings_stream(spark, "kafka", options={
            "kafka.bootstrap.servers": "localhost:9092", "subscribe": "t"})


def test_compact_append_history(spark, tmp_dir):
    inp = os.path.join(tmp_dir, "in")
    hist, compacted = os.path.join(tmp_dir, "h"), os.path.join(tmp_dir, "c")
    msg = {"datetime": "2024-01-01T00:00:00+00:00", "location_id": 1, "pm25": 30.0}
    for items in ([msg, {**msg, "location_id": 2}], [msg]):
        _write(spark, inp, items)
        for q in job.scoring_job_append(spark, source.readings_stream(spark, "text", inp), hist,
                                        checkpoint=os.path.join(tmp_dir, "ck"),
                                        trigger={"availableNow": True}):
            q.awaitTermination()
    assert spark.read.parquet(hist).count() == 3
    job.compact_history(spark, hist, compacted)
    job.compact_history(spark, hist, compacted)          # idempotent
    c = spark.read.parquet(compacted)
    assert c.count() == 2 and sorted(r.location_id for r in c.collect()) == [1, 2]
