"""Streams with state per station, live rules, late rows and pushed changes on small fixtures."""

import datetime as dt
import os
import random

import pytest
from pyspark.sql import functions as F

from haze.operators.latest import replay_deltas, snapshot_delta
from haze.operators.snapshot_log import SnapshotLog
from haze.operators.windows import alert_edges, apply_rules, live_rules, rules_frame
from haze.streaming.job import DeltaPush, LateSplit, LiveRules, batch_writer, run_to_completion
from haze.streaming.state import expiring_snapshot, present_state, rocksdb_state, stream_edges

T0 = dt.datetime(2025, 1, 1, 0, 0, 0)
ROWS = "location_id long, event_ts timestamp, datetime string, aqi int, processed_at timestamp"
RULES = "priority int, column string, op string, threshold double, severity string"


def reading(station, minutes, aqi):
    at = None if minutes is None else T0 + dt.timedelta(minutes=minutes)
    return station, at, str(at), aqi, at


def deliver(spark, root, n, rows):
    spark.createDataFrame([reading(*r) for r in rows], ROWS).coalesce(1).write.parquet(f"{root}/in/d={n}")


def stream(spark, root, delay="10 minutes"):
    return spark.readStream.schema(ROWS).parquet(f"{root}/in/*").withWatermark("event_ts", delay)


def minutes(ts):
    return int((ts - T0).total_seconds() // 60)


# ---------------------------------------------------------------- expiry

def test_entries_expire_revive_and_survive_a_restart(spark, tmp_dir):
    root = tmp_dir
    seen = []
    for n, rows in enumerate([
            [(1, 0, 10), (1, 5, 11), (2, 30, 20), (None, 1, 5), (4, None, 5)],
            [(2, 80, 21), (3, 100, 30)],          # watermark 90: station 1 (5 + 60) is over
            [(1, 20, 99), (1, 200, 12)],          # 20 is behind the watermark: revives nothing
            [(9, 400, 1)]]):
        deliver(spark, root, n, rows)
        changes = expiring_snapshot(stream(spark, root), ["aqi"], ttl_seconds=3600)
        with rocksdb_state(spark):
            run_to_completion(changes, f"{root}/ckpt", mode="update", sink=batch_writer(spark, f"{root}/out"))
        state = present_state(spark.read.parquet(f"{root}/out")).collect()
        seen.append({(r.location_id, r.aqi, r.expired) for r in state})
    assert seen == [{(1, 11, False), (2, 20, False)},
                    {(1, 11, True), (2, 21, False), (3, 30, False)},
                    {(1, 12, False), (2, 21, True), (3, 30, True)},
                    {(1, 12, True), (2, 21, True), (3, 30, True), (9, 1, False)}]
    all_changes = spark.read.parquet(f"{root}/out").where("location_id = 1").orderBy("event_ts", F.desc("change")).collect()
    assert [(r.change, r.aqi) for r in all_changes] == [("set", 11), ("expired", 11), ("set", 12), ("expired", 12)]


def test_one_row_a_station_reaches_the_processor(spark, tmp_dir, monkeypatch):
    from pyspark.sql import Row
    from pyspark.sql.streaming import StatefulProcessor

    from haze.streaming import state

    class Counting(StatefulProcessor):
        """Emits a station's newest reading with the number of its rows in place of ``aqi``."""

        def __init__(self, schema, columns, ttl_ms):
            self.columns = columns

        def init(self, handle):
            pass

        def handleInputRows(self, key, rows, timerValues):
            rows = [r.asDict() for r in rows]
            yield Row(location_id=key[0], change="set", **{c: rows[-1][c] for c in self.columns} | {"aqi": len(rows)})

        def close(self):
            pass

    monkeypatch.setattr(state, "ExpiringLatest", Counting)
    for n in range(2):
        deliver(spark, f"{tmp_dir}/in/d={n}", n, [(i % 7, i // 7 + n, i) for i in range(700)])
    rows = spark.readStream.schema(ROWS).parquet(f"{tmp_dir}/in/*/in/*").withWatermark("event_ts", "10 minutes")
    with rocksdb_state(spark):
        run_to_completion(expiring_snapshot(rows, ["aqi"]), f"{tmp_dir}/ckpt", mode="update",
                          sink=batch_writer(spark, f"{tmp_dir}/out"))
    got = spark.read.parquet(f"{tmp_dir}/out").collect()
    assert {(r.location_id, r.aqi, minutes(r.event_ts)) for r in got} == {(i, 1, 100) for i in range(7)}
    assert len(got) == 7


@pytest.mark.parametrize("limit", [40, 1_000_000])
def test_thinned_rows_hold_the_newest_of_each_station(monkeypatch, limit):
    import pyarrow as pa

    from haze.streaming import state
    monkeypatch.setattr(state, "THIN_ROWS", limit)
    rng = random.Random(5)
    rows = [{"location_id": rng.randrange(30), "event_us": rng.randrange(40), "datetime": rng.choice([None, "a", "b"]),
             "processed_us": rng.choice([None, 0, 7]), "n": n} for n in range(900)]
    schema = pa.schema([("location_id", pa.int64()), ("event_us", pa.int64()), ("datetime", pa.string()),
                        ("processed_us", pa.int64()), ("n", pa.int64())])
    parts = [rows[i:i + 25] for i in range(0, 900, 25)] + [[]]
    out = [r for b in state._thinned(pa.RecordBatch.from_pylist(p, schema) for p in parts) for r in b.to_pylist()]

    def newest(found):
        best = {}
        for r in found:
            held = best.get(r["location_id"])
            if held is None or state._sort_key(r) > state._sort_key(held):
                best[r["location_id"]] = r
        return best
    assert newest(out) == newest(rows)
    assert len(out) < 900 and all(r in rows for r in out)
    if limit > 900:
        assert len(out) == 30
    assert list(state._thinned(iter([]))) == []


def test_a_delivery_keeps_its_partitions(spark, tmp_dir):
    from haze.plans.stream_trips import _deliver
    _deliver(spark.range(0, 100, 1, 5), tmp_dir, 0)
    files = spark.read.parquet(f"{tmp_dir}/in").select(F.input_file_name().alias("f")).distinct().count()
    assert files == 5 and spark.read.parquet(f"{tmp_dir}/in").count() == 100


# ---------------------------------------------------------------- edges and rules

@pytest.mark.parametrize("seed", [1, 2])
def test_stream_edges_equal_batch_edges(spark, tmp_dir, seed):
    rng = random.Random(seed)
    rows = [(rng.randrange(4), m, rng.choice([10, 160, 170, 250, None])) for m in rng.sample(range(600), 300)]
    cut = sorted(rng.sample(range(300), 2))
    parts = [rows[:cut[0]], rows[cut[0]:cut[1]], rows[cut[1]:], [(-1, 100_000, 0)]]
    for n, part in enumerate(parts):
        deliver(spark, tmp_dir, n, part)
        judged = apply_rules(stream(spark, tmp_dir, "1 day"), rules_frame(spark))
        with rocksdb_state(spark):
            run_to_completion(stream_edges(judged), f"{tmp_dir}/ckpt", path=f"{tmp_dir}/out")
    batch = alert_edges(spark.createDataFrame([reading(*r) for r in rows], ROWS), rules_frame(spark))
    want = {(r.location_id, minutes(r.event_ts), r.severity) for r in batch.collect()}
    got = [(r.location_id, minutes(r.event_ts), r.severity) for r in spark.read.parquet(f"{tmp_dir}/out").collect()]
    assert len(got) == len(want) and set(got) == want


def test_late_rows_take_no_part_in_edges(spark, tmp_dir):
    for n, part in enumerate([[(1, 0, 250), (1, 100, 10)], [(1, 50, 250), (1, 120, 160)], [(-1, 9999, 0)]]):
        deliver(spark, tmp_dir, n, part)
        judged = apply_rules(stream(spark, tmp_dir), rules_frame(spark))
        with rocksdb_state(spark):
            run_to_completion(stream_edges(judged), f"{tmp_dir}/ckpt", path=f"{tmp_dir}/out")
    got = sorted((minutes(r.event_ts), r.severity) for r in spark.read.parquet(f"{tmp_dir}/out").collect())
    assert got == [(0, "danger"), (120, "warning")]


def test_rules_change_while_the_stream_runs(spark, tmp_dir):
    def rules(rows):
        spark.createDataFrame(rows, RULES).write.mode("overwrite").parquet(f"{tmp_dir}/rules")

    rules([(1, "aqi", ">", 100.0, "high")])
    deliver(spark, tmp_dir, 0, [(1, 0, 150), (2, 0, 50)])
    sink = LiveRules(spark, f"{tmp_dir}/rules", f"{tmp_dir}/alerts")
    q = stream(spark, tmp_dir).writeStream.foreachBatch(sink).option("checkpointLocation", f"{tmp_dir}/ckpt").start()
    try:
        q.processAllAvailable()
        rules([(1, "aqi", "<", 100.0, "low")])
        deliver(spark, tmp_dir, 1, [(1, 1, 150), (2, 1, 50)])
        q.processAllAvailable()
    finally:
        q.stop()
    got = {(r.location_id, minutes(r.event_ts), r.severity) for r in spark.read.parquet(f"{tmp_dir}/alerts").collect()}
    assert got == {(1, 0, "high"), (2, 1, "low")}


def test_many_rules_and_odd_ones(spark):
    rules = [(i, "aqi", "=", float(i), f"s{i}") for i in range(1500)]
    rules += [(None, "aqi", ">=", 0.0, "last"), (0, "nothing", ">", 0.0, "x"), (0, "aqi", "like", 0.0, "x"), (0, "aqi", ">", None, "x")]
    df = spark.createDataFrame([(1, 7), (2, 1499), (3, 5000), (4, None)], "i int, aqi int")
    got = {r.i: r.severity for r in live_rules(df, spark.createDataFrame(rules, RULES)).collect()}
    assert got == {1: "s7", 2: "s1499", 3: "last", 4: None}
    empty = live_rules(df, spark.createDataFrame([], RULES))
    assert {r.severity for r in empty.collect()} == {None}
    with pytest.raises(ValueError):
        live_rules(df, rules_frame(spark))


# ---------------------------------------------------------------- late rows

def test_on_time_and_late_add_up(spark, tmp_dir):
    sink = LateSplit(spark, f"{tmp_dir}/rows")
    counts = []
    for n, part in enumerate([[(1, 0, 1), (1, 100, 2)], [(1, 89, 3), (1, 90, 4), (2, None, 5)], [(1, 95, 6), (3, 10, 7)]]):
        deliver(spark, tmp_dir, n, part)
        run_to_completion(stream(spark, tmp_dir), f"{tmp_dir}/ckpt", sink=sink)
        counts.append(dict(sink.counts))
    assert counts == [{"delivered": 2, "late_rows": 0}, {"delivered": 3, "late_rows": 1}, {"delivered": 2, "late_rows": 1}]
    got = {r.aqi: r.late for r in sink.rows().collect()}
    assert got == {1: False, 2: False, 3: True, 4: False, 5: False, 6: False, 7: True}
    marks = sink.marks().agg(F.sum("delivered"), F.sum("late_rows")).first()
    assert tuple(marks) == (7, 2)


def test_late_split_of_a_retried_batch(spark, tmp_dir):
    sink = LateSplit(spark, f"{tmp_dir}/rows")
    first = spark.createDataFrame([reading(1, 100, 1)], ROWS)
    second = spark.createDataFrame([reading(1, 500, 2), reading(1, 20, 3)], ROWS)
    sink(first, 0)
    for _ in range(2):
        sink(second, 1)   # the retry must not take its own newest instant for an earlier one
    assert {r.aqi: r.late for r in sink.rows().collect()} == {1: False, 2: False, 3: True}
    assert sink.rows().count() == 3


# ---------------------------------------------------------------- deltas

def test_snapshot_delta_kinds(spark):
    schema = "location_id long, aqi int"
    old = spark.createDataFrame([(1, 10), (2, 20), (3, None), (None, 5)], schema)
    new = spark.createDataFrame([(1, 10, "n"), (2, 21, None), (4, 40, None), (None, 6, None)], schema + ", note string")
    got = {(r.location_id, r.change, r.aqi, r.note) for r in snapshot_delta(old, new).collect()}
    assert got == {(1, "changed", 10, "n"), (2, "changed", 21, None), (3, "expired", None, None),
                   (4, "added", 40, None), (None, "changed", 6, None)}
    assert snapshot_delta(old, old).count() == 0
    log = snapshot_delta(old.limit(0), old).withColumn("batch_id", F.lit(0)).unionByName(
        snapshot_delta(old, new.drop("note")).withColumn("batch_id", F.lit(1)))
    assert {tuple(r) for r in replay_deltas(log).select("location_id", "aqi").collect()} == {(1, 10), (2, 21), (4, 40), (None, 6)}


def test_retried_push_publishes_the_same_changes(spark, tmp_dir):
    push = DeltaPush(spark, f"{tmp_dir}/snapshot", f"{tmp_dir}/deltas", shards=2)
    rows = lambda *r: spark.createDataFrame([reading(*x) for x in r], ROWS)
    push(rows((1, 0, 10), (2, 0, 20)), 0)
    for _ in range(2):
        push(rows((1, 5, 11), (2, -5, 99), (3, 1, 30)), 1)
    got = sorted((r.batch_id, r.location_id, r.change, r.aqi) for r in spark.read.parquet(f"{tmp_dir}/deltas").collect())
    assert got == [(0, 1, "added", 10), (0, 2, "added", 20), (1, 1, "changed", 11), (1, 3, "added", 30)]
    state = {tuple(r) for r in push.state(1).select("location_id", "aqi").collect()}
    assert state == {(1, 11), (2, 20), (3, 30)}


# ---------------------------------------------------------------- snapshot log

def _files(folder):
    return {os.path.join(d, f): os.stat(os.path.join(d, f)).st_mtime_ns for d, _, fs in os.walk(folder) for f in fs}


def test_snapshot_log_follows_its_size(spark, tmp_dir):
    log = SnapshotLog(spark, f"{tmp_dir}/snap")
    with pytest.raises(ValueError):
        log.read()
    stations = lambda lo, hi, m, a: spark.createDataFrame([reading(i, m, a) for i in range(lo, hi)], ROWS)
    log.append(stations(0, 200, 0, 1), 0)
    assert log.compact(4) == 4 and log.shards == 4
    log.append(stations(100, 2000, 5, 2), 1)
    assert log.compact(64) == 64 and log.read().count() == 2000
    base = _files(f"{tmp_dir}/snap/base")
    assert len({os.path.dirname(f) for f in base if "/g2/shard=" in f}) == 64
    log.append(stations(0, 40, 9, 3), 2)
    log.append(stations(0, 40, -9, 4), 3)     # older readings regress nothing
    assert _files(f"{tmp_dir}/snap/base") == base
    got = {r.location_id: r.aqi for r in log.read().collect()}
    assert len(got) == 2000 and all(got[i] == (3 if i < 40 else 1 if i < 100 else 2) for i in got)
    # changes appended while a compaction ran lie in the generation before: they count
    gen = log._current()[0]
    assert log.compact() == 1
    log._current = lambda: (gen, 64)
    log.append(stations(50, 51, 20, 7), 9)
    del log._current
    assert {r.location_id: r.aqi for r in log.read().collect()}[50] == 7
    alive = log.read(as_of=T0 + dt.timedelta(minutes=65), ttl_seconds=3600)
    assert {r.aqi for r in alive.collect()} == {3, 7}
