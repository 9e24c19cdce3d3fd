"""Densify / forward fill / jitter and pipeline metrics against brute force."""

import datetime as dt
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from haze.operators import densify as D
from haze.operators import metrics as M

T0 = dt.datetime(2024, 1, 1, 0, 0, 0)


def _fixture_rows():
    rng = random.Random(3)
    rows = []
    # station 1: irregular 5..45 s gaps on a 5 s grid, random nulls, leading and
    # trailing nulls, plus one off-grid reading
    t = 0
    for i in range(60):
        a = None if (i < 2 or i > 56 or rng.random() < 0.2) else rng.uniform(1, 100)
        b = None if rng.random() < 0.3 else rng.uniform(-5, 40)
        rows.append((1, T0 + dt.timedelta(seconds=t), a, b))
        t += rng.choice([5, 10, 15, 20, 45])
    rows.append((1, T0 + dt.timedelta(seconds=12), 777.0, 777.0))      # off grid
    # station 2: starts later, crosses midnight (a chunk boundary)
    t = 86_400 - 60
    for i in range(30):
        rows.append((2, T0 + dt.timedelta(seconds=t), rng.uniform(1, 9) if i % 4 else None,
                     float(i)))
        t += rng.choice([5, 30, 60])
    rows.append((3, T0 + dt.timedelta(seconds=7), 5.0, None))          # single-row station
    return rows


def _brute_densify(rows, step):
    """Per station: reindex on the grid from its first reading, drop
    off-grid rows, interpolate linearly in time inside known values only."""
    pdf = pd.DataFrame(rows, columns=["location_id", "datetime", "a", "b"])
    pdf[["a", "b"]] = pdf[["a", "b"]].astype(float)
    out = []
    for sid, g in pdf.groupby("location_id"):
        t0 = g.datetime.min()
        g = g[((g.datetime - t0).dt.total_seconds() % step) == 0].set_index("datetime")
        grid = pd.date_range(t0, g.index.max(), freq=f"{step}s")
        r = g.reindex(grid)
        for c in ("a", "b"):
            r[c] = r[c].interpolate(method="time", limit_area="inside")
        r["location_id"] = sid
        out.append(r.rename_axis("datetime").reset_index())
    return pd.concat(out)


def test_densify_matches_brute_force(spark):
    rows = _fixture_rows()
    df = spark.createDataFrame(rows, "location_id long, datetime timestamp, a double, b double")
    want = _brute_densify(rows, 5).sort_values(["location_id", "datetime"]).reset_index(drop=True)
    for chunk, spread in ((D.DAY_SECONDS, False), (60, False), (60, True), (D.DAY_SECONDS, True)):
        # the result must not depend on the chunking or on spreading gaps
        got = D.densify(df, values=["a", "b"], step_seconds=5, chunk_seconds=chunk,
                        spread_gaps=spread, off_grid="drop").toPandas()
        got = got.sort_values(["location_id", "datetime"]).reset_index(drop=True)
        assert len(got) == len(want)
        assert (got.datetime.values == want.datetime.values).all()
        for c in ("a", "b"):
            assert (got[c].isna().values == want[c].isna().values).all()
            np.testing.assert_allclose(got[c].fillna(0), want[c].fillna(0), rtol=1e-12)


def test_densify_snap_mode(spark):
    df = spark.createDataFrame([(1, T0, 1.0), (1, T0 + dt.timedelta(seconds=7), 3.0),
                                (1, T0 + dt.timedelta(seconds=9), 5.0),
                                (1, T0 + dt.timedelta(seconds=20), 10.0)],
                               "location_id long, datetime timestamp, a double")
    got = D.densify(df, values=["a"], step_seconds=5, off_grid="snap").orderBy("datetime")
    assert [r.a for r in got.collect()] == [1.0, 4.0, 6.0, 8.0, 10.0]


def test_forward_fill(spark):
    rows = [(1, T0 + dt.timedelta(hours=h), v) for h, v in
            [(0, None), (1, 2.0), (2, None), (30, None), (50, 7.0), (51, None)]]
    rows += [(2, T0, None)]
    df = spark.createDataFrame(rows, "location_id long, datetime timestamp, a double")
    got = D.forward_fill(df, ["a"]).orderBy("location_id", "datetime").collect()
    assert [r.a for r in got] == [None, 2.0, 2.0, 2.0, 7.0, 7.0, None]


def test_jitter_properties(spark):
    df = spark.range(200_000).select(F.col("id").alias("location_id"),
                                     F.lit(10.0).alias("a"), F.lit(20.0).alias("b"))
    for keys in (("location_id",), None):
        out = D.jitter(df, ["a", "b"], std=0.02, seed=1, key_cols=keys)
        s = out.select(F.avg(F.col("a") / 10).alias("m"), F.stddev(F.col("a") / 10).alias("s"),
                       F.corr("a", "b").alias("c")).first()
        assert abs(s.m - 1) < 1e-3 and abs(s.s - 0.02) < 1e-3 and abs(s.c) < 0.02
    # keyed noise does not depend on the partitioning
    one = D.jitter(df.repartition(1), ["a"], seed=3, key_cols=("location_id",))
    many = D.jitter(df.repartition(7, "a"), ["a"], seed=3, key_cols=("location_id",))
    assert one.exceptAll(many).count() == 0


def test_jitter_draws_are_md5_of_seed_salt_and_key(spark):
    import hashlib
    import math
    columns = [f"c{i}" for i in range(6)]            # salts of one digit and of two
    keys = [(1, "x"), (None, "y"), (2, None), (3, ""), (4, "é" * 9), (5, "k" * 46), (6, "k" * 47), (7, "k" * 90)]
    df = spark.createDataFrame([(*k, *[10.0 + i for i in range(6)]) for k in keys],
                               "location_id long, datetime string, " + ", ".join(f"{c} double" for c in columns))
    out = D.jitter(df, columns, std=0.5, seed=42)
    # all hashes of a batch at once, outside the JVM's hex texts
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "conv(" not in plan and plan.count("ArrowEvalPython") == 1

    def draw(salt, key):
        text = "|".join(["42", str(salt), *["" if k is None else str(k) for k in key]])
        return (int(hashlib.md5(text.encode()).hexdigest()[:12], 16) + 0.5) / 2 ** 48
    got = {(r.location_id, r.datetime): r for r in out.collect()}
    assert len(got) == len(keys) and out.columns == df.columns
    for key in keys:
        for i, c in enumerate(columns):
            z = math.sqrt(-2 * math.log(draw(2 * i, key))) * math.cos(2 * math.pi * draw(2 * i + 1, key))
            assert got[key][c] == pytest.approx((10.0 + i) * (1 + 0.5 * z), rel=1e-12)


def test_md5_bits_of_any_length():
    import hashlib

    import pyarrow as pa

    from haze.functions.uniform import CHUNK, md5_bits
    prefixes = [b"", b"4|", b"42|10|", b"p" * 60]
    texts = ["", *["x" * n for n in range(1, 130)], *[f"é{n}" for n in range(CHUNK + 9)]]
    want = [[int(hashlib.md5(p + t.encode()).hexdigest()[:12], 16) for t in texts] for p in prefixes]
    assert md5_bits(pa.array(texts), prefixes).tolist() == want
    assert md5_bits(pa.array(texts).slice(5, 90), prefixes).tolist() == [w[5:95] for w in want]
    assert md5_bits(pa.array([], pa.string()), prefixes).shape == (4, 0)


def test_exact_ranks_vs_sorted_array(spark):
    rng = np.random.default_rng(5)
    for n in (1, 2, 7, 101, 5000):
        vals = rng.integers(0, 300_000_000, size=n)
        vals[: n // 3] = vals[0]            # heavy duplicates
        if n > 10:
            vals[5] = (1 << 14) * 3          # exactly on a bucket boundary
        df = spark.createDataFrame([(int(v),) for v in vals], "v long")
        got = dict(M.exact_ranks(df, "v", {"p95": 0.95, "p50": "median", "p0": 0.0,
                                           "p100": 1.0}).collect())
        s = np.sort(vals)
        near = lambda q: s[int(np.floor((n - 1) * q + 0.5))]
        assert got["p95"] == near(0.95) and got["p0"] == s[0] and got["p100"] == s[-1]
        assert got["p50#lo"] == s[(n - 1) // 2] and got["p50#hi"] == s[-(-(n - 1) // 2)]


def test_histogram_edges(spark):
    same = spark.createDataFrame([(2.0,)] * 5, "x double")
    h = M.histogram(same, "x", 50).collect()
    assert len(h) == 50 and h[0]["count"] == 5 and sum(r["count"] for r in h) == 5
    vals = spark.createDataFrame([(float(v),) for v in [0, 1, 2, 3, 10]], "x double")
    h = {r.bin: r["count"] for r in M.histogram(vals, "x", 5).collect()}
    assert h == {1: 2, 2: 2, 3: 0, 4: 0, 5: 1}     # the maximum lands in the last bin


@pytest.mark.parametrize("age,status", [(29.9, "OK"), (30, "WARNING"), (119.9, "WARNING"),
                                        (120, "ERROR")])
def test_freshness_levels(spark, age, status):
    as_of = T0 + dt.timedelta(hours=1)
    df = spark.createDataFrame([(as_of - dt.timedelta(seconds=age),)], "event_ts timestamp")
    r = M.freshness(df, as_of).first()
    assert r.status == status and r.age_s == pytest.approx(age)


def test_freshness_empty(spark):
    df = spark.createDataFrame([], "event_ts timestamp")
    r = M.freshness(df, T0).first()
    assert r["count"] == 0 and r.status == "WARNING"


def test_latency_dispositions_and_csv(spark, tmp_dir):
    as_of = dt.datetime(2024, 1, 1, 12, 0)
    rows = [("2024-01-01T11:59:00+00:00", as_of),                     # 60 s: valid
            ("2024-01-01T18:59:59.5+07:00", as_of),                   # 0.5 s: valid
            ("2024-01-01T10:00:00+00:00", as_of),                     # older than 60 min
            ("2024-01-01T12:00:01+00:00", as_of),                     # negative
            ("2024-01-01T11:54:00+00:00", as_of),                     # 360 s: invalid
            ("nonsense", as_of), (None, as_of), ("2024-01-01T11:59:00+00:00", None)]
    df = spark.createDataFrame(rows, "datetime string, processed_at timestamp")
    s = M.latency_samples(df, as_of, 60)
    c = M.disposition_counts(s).first()
    assert (c.raw, c.valid, c.old, c.invalid) == (8, 2, 1, 3)
    summ = M.latency_summary(s).first()
    assert summ["count"] == 2 and summ.p50 == pytest.approx(30.25) and summ.p99 == 60.0
    assert summ.overloaded and summ.unstable
    M.write_latency_csv(s, tmp_dir + "/lat")
    back = M.read_latency_csv(spark, tmp_dir + "/lat").collect()
    assert [r.latency for r in back] == [60.0, 0.5]


def test_lag_and_recent(spark):
    produced = spark.createDataFrame([(0, 4), (1, 9), (2, 0)], "partition int, offset long")
    p = M.end_offsets(produced)
    assert p.first().produced == 5 + 10 + 1
    stored = spark.range(20)
    assert M.ingest_lag(p, stored).first().lag == 0
    assert M.ingest_lag(p, spark.range(3)).first().lag == 13
    df = spark.createDataFrame([(T0 - dt.timedelta(seconds=s),) for s in (1, 29, 31, 100)],
                               "processed_at timestamp")
    r = M.recent_rows(df, T0, 30).first()
    assert (r.total, r.recent) == (4, 2)


def test_left_join_grid_agrees_on_known_points(spark):
    rows = _fixture_rows()
    df = spark.createDataFrame(rows, "location_id long, datetime timestamp, a double, b double")
    grid = D.left_join_grid(df.where("location_id = 2"), step_seconds=5)
    dense = D.densify(df.where("location_id = 2"), values=["a", "b"], step_seconds=5, off_grid="drop")
    assert grid.count() == dense.count()
    known = grid.where("a IS NOT NULL").select("datetime", "a")
    assert known.exceptAll(dense.select("datetime", "a")).count() == 0


def test_latency_series_chunk_invariant(spark):
    rows = [(s, T0 + dt.timedelta(minutes=37 * i), T0 + dt.timedelta(minutes=37 * i, seconds=2))
            for s in (1, 2) for i in range(120)]
    df = spark.createDataFrame(rows, "location_id long, event_time timestamp, "
                                     "processed_at timestamp") \
        .withColumn("latency", F.lit(2.0)).withColumn("disposition", F.lit("valid"))
    a = M.latency_series(df).orderBy("location_id", "idx").collect()
    b = M.latency_series(df, chunk_seconds=3600).orderBy("location_id", "idx").collect()
    assert a == b and [r.idx for r in a[:120]] == list(range(1, 121))


def test_exact_ranks_adaptive_width(spark):
    rng = np.random.default_rng(11)
    vals = np.concatenate([rng.integers(-10**9, 10**9, size=3000), [-10**9, 10**9]])
    df = spark.createDataFrame([(int(v),) for v in vals], "v long")
    got = dict(M.exact_ranks(df, "v", {"p10": 0.1, "p90": 0.9}).collect())
    s = np.sort(vals)
    n = len(s)
    assert got["p10"] == s[int(np.floor((n - 1) * 0.1 + 0.5))]
    assert got["p90"] == s[int(np.floor((n - 1) * 0.9 + 0.5))]
    lo, hi = -(1 << 63), (1 << 63) - 1
    for values in ([0, 1 << 50], [lo, 0, hi], [lo, hi], [hi]):
        wide = spark.createDataFrame([(v,) for v in values], "v long")
        got = dict(M.exact_ranks(wide, "v", {"p0": 0.0, "p50": 0.5, "p100": 1.0}).collect())
        middle = values[int(np.floor((len(values) - 1) * 0.5 + 0.5))]
        assert got == {"p0": values[0], "p50": middle, "p100": values[-1]}


def test_rules_priority_and_edges(spark):
    from haze.operators import windows as W
    rules = spark.createDataFrame(
        [(2, "aqi", ">", 150.0, "warning"), (1, "aqi", ">", 200.0, "danger")],
        "priority int, column string, op string, threshold double, severity string")
    rows = [(1, T0 + dt.timedelta(hours=h), a) for h, a in
            enumerate([10, 160, 170, 250, 240, 90, 210])]
    rows += [(2, T0 + dt.timedelta(days=d), 300) for d in range(3)]   # crosses day chunks
    df = spark.createDataFrame(rows, "location_id long, event_ts timestamp, aqi int")
    got = W.alert_edges(df, rules).orderBy("location_id", "event_ts").collect()
    assert [(r.location_id, r.aqi, r.severity) for r in got] == [
        (1, 160, "warning"), (1, 250, "danger"), (1, 210, "danger"), (2, 300, "danger")]


def test_hot_station_is_spread_over_tasks(spark):
    """A station with most of the rows is split by (station, day) in every
    per-row window, so its work lands in several tasks, not one."""
    from haze.operators import windows as W
    rows = [(1, T0 + dt.timedelta(minutes=30 * i), float(i % 17), 100 + i % 150)
            for i in range(20 * 48)]
    rows += [(2, T0 + dt.timedelta(hours=h), 1.0, 10) for h in range(5)]
    df = spark.createDataFrame(rows, "location_id long, datetime timestamp, a double, aqi int")
    prev = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        dense = D.densify(df, values=["a"], step_seconds=1800, off_grid="drop")
        filled = D.forward_fill(df, ["a"])
        edges = W.previous_value(df.withColumnRenamed("datetime", "event_ts"), "aqi")
        series_in = df.select("location_id", F.col("datetime").alias("event_time"),
                              F.col("datetime").alias("processed_at"), F.lit(0.0).alias("latency"),
                              F.lit("valid").alias("disposition"))
        for out in (dense, filled, edges, M.latency_series(series_in)):
            parts = out.where("location_id = 1").select(F.spark_partition_id().alias("p")) \
                .distinct().count()
            assert parts > 1
        assert dense.where("location_id = 1").count() == 20 * 48
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", prev)


def test_long_gap_spread_over_tasks(spark):
    rows = [(1, T0, 1.0), (1, T0 + dt.timedelta(days=30), 31.0)]     # one 30-day gap
    df = spark.createDataFrame(rows, "location_id long, datetime timestamp, a double")
    prev = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        out = D.densify(df, values=["a"], step_seconds=3600, spread_gaps=True, off_grid="drop")
        assert out.count() == 30 * 24 + 1
        parts = out.select(F.spark_partition_id()).distinct().count()
        assert parts > 1
        mid = out.where(F.col("datetime") == T0 + dt.timedelta(days=15)).first()
        assert mid.a == pytest.approx(16.0)
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", prev)


def test_latency_summary_edge_sizes(spark):
    as_of = dt.datetime(2024, 1, 1, 12, 0)
    one = spark.createDataFrame([("2024-01-01T11:59:00+00:00", as_of)],
                                "datetime string, processed_at timestamp")
    r = M.latency_summary(M.latency_samples(one, as_of, 60)).first()
    assert (r.raw, r.valid, r["count"], r.min, r.p50, r.p99) == (1, 1, 1, 60.0, 60.0, 60.0)
    assert r.std_dev is None and r.unstable is None
    empty = spark.createDataFrame([], "datetime string, processed_at timestamp")
    r = M.latency_summary(M.latency_samples(empty, as_of, 60)).first()
    assert (r.raw, r.valid, r.old, r.invalid, r["count"]) == (0, 0, 0, 0, 0)
    assert r.avg is None and r.p50 is None


def test_grid_left_join_in_chunks(spark):
    """Weeks between readings, a station without a name, two readings at once, one off the grid."""
    at = lambda s: T0 + dt.timedelta(seconds=s)
    week = 7 * 86_400
    rows = [(1, at(0), 1.0), (1, at(3600), 2.0), (1, at(3600), 3.0), (1, at(5000), 9.0), (1, at(3 * week), 4.0),
            (None, at(7), 5.0), (None, at(7 + 7200), None), (2, None, 6.0), (3, at(1), 7.0)]
    df = spark.createDataFrame(rows, "location_id long, datetime timestamp, v double").withColumn("_g", F.lit("x"))
    out = D.left_join_grid(df, step_seconds=3600)
    assert out.columns == df.columns
    got = sorted(((r.location_id or 0, int((r.datetime - T0).total_seconds()), r.v) for r in out.collect()),
                 key=lambda r: (r[0], r[1], r[2] or 0))
    want = [(0, 7, 5.0), (0, 3607, None), (0, 7207, None), (3, 1, 7.0)]
    known = {0: [1.0], 3600: [2.0, 3.0], 3 * week: [4.0]}
    want += [(1, s, v) for s in range(0, 3 * week + 1, 3600) for v in known.get(s, [None])]
    assert got == sorted(want, key=lambda r: (r[0], r[1], r[2] or 0))
    assert D.left_join_grid(df.limit(0)).count() == 0
