"""Property tests (hypothesis) for scoring: bounds, monotonicity inside a
bracket, overall >= parts, agreement with the plain-Python formula."""

from hypothesis import given, settings
from hypothesis import strategies as st

from haze.functions import aqi
from test_aqi import _half, exact_index

values = st.lists(st.one_of(st.none(), st.just(float("nan")),
                            st.floats(min_value=-50, max_value=900)),
                  min_size=1, max_size=60)


@settings(max_examples=15, deadline=None)
@given(values)
def test_scoring_properties(spark, xs):
    df = spark.createDataFrame([(x,) for x in xs], "c double")
    rows = df.select("c", aqi.aqi_pm25("c").alias("a"), aqi.aqi_pm10("c").alias("b"),
                     aqi.overall(aqi.aqi_pm25("c"), aqi.aqi_pm10("c")).alias("o")).collect()
    for r in rows:
        assert 0 <= r.a <= 500 and 0 <= r.b <= 500
        assert r.o >= r.a and r.o >= r.b and r.o in (r.a, r.b)
        c = None if r.c is None or r.c != r.c else r.c
        assert abs(r.a - exact_index(c, "pm25")) <= _half(c, "pm25")
        assert abs(r.b - exact_index(c, "pm10")) <= _half(c, "pm10")


@settings(max_examples=10, deadline=None)
@given(st.sampled_from(list(aqi.PM25.brackets) + list(aqi.PM10.brackets)),
       st.lists(st.floats(min_value=0, max_value=1), min_size=2, max_size=20))
def test_monotone_inside_bracket(spark, bracket, fracs):
    xs = sorted(bracket.c_low + f * (bracket.c_high - bracket.c_low) for f in fracs)
    std = aqi.PM25 if bracket in aqi.PM25.brackets else aqi.PM10
    df = spark.createDataFrame([(i, x) for i, x in enumerate(xs)], "i int, c double")
    got = [r.a for r in df.orderBy("i").select(aqi.sub_index("c", std).alias("a")).collect()]
    assert got == sorted(got)
    assert all(bracket.i_low <= a <= bracket.i_high for a in got)


@settings(max_examples=8, deadline=None)
@given(st.lists(st.tuples(st.integers(1, 3), st.integers(0, 400),
                          st.one_of(st.none(), st.floats(-50, 50)),
                          st.booleans()), min_size=1, max_size=40),
       st.booleans())
def test_densify_matches_brute_force(spark, points, spread):
    """Random stations, gaps, nulls and off-grid rows: densify equals a
    per-station pandas reindex + time interpolation."""
    import datetime as dt

    import numpy as np

    from haze.operators import densify as D
    from test_series import _brute_densify

    t0 = dt.datetime(2024, 1, 1)
    seen, rows = set(), []
    for station, k, v, off in points:
        secs = k * 5 + (2 if off else 0)
        if (station, secs) in seen:
            continue
        seen.add((station, secs))
        rows.append((station, t0 + dt.timedelta(seconds=secs), v, None if v is None else -v))
    df = spark.createDataFrame(rows, "location_id long, datetime timestamp, a double, b double")
    got = D.densify(df, values=["a", "b"], step_seconds=5, chunk_seconds=300,
                    spread_gaps=spread, off_grid="drop").toPandas().sort_values(["location_id", "datetime"])
    want = _brute_densify(rows, 5).sort_values(["location_id", "datetime"])
    assert len(got) == len(want)
    assert (got.datetime.values == want.datetime.values).all()
    for c in ("a", "b"):
        g, w = got[c].astype(float), want[c].astype(float)
        assert (g.isna().values == w.isna().values).all()
        np.testing.assert_allclose(g.fillna(0).values, w.fillna(0).values, rtol=1e-9, atol=1e-9)


@settings(max_examples=8, deadline=None)
@given(st.lists(st.tuples(st.integers(1, 3), st.integers(0, 5000), st.integers(0, 300)),
                min_size=1, max_size=60, unique_by=lambda t: (t[0], t[1])))
def test_previous_value_and_latest_match_pandas(spark, points):
    import datetime as dt

    import pandas as pd

    from haze.operators.latest import latest_per_key
    from haze.operators.windows import previous_value

    t0 = dt.datetime(2024, 1, 1)
    rows = [(s, t0 + dt.timedelta(minutes=m), a) for s, m, a in points]
    df = spark.createDataFrame(rows, "location_id long, event_ts timestamp, aqi int")
    got = previous_value(df, "aqi", chunk_seconds=3600).toPandas() \
        .sort_values(["location_id", "event_ts"]).reset_index(drop=True)
    pdf = pd.DataFrame(rows, columns=["location_id", "event_ts", "aqi"]) \
        .sort_values(["location_id", "event_ts"]).reset_index(drop=True)
    want = pdf.groupby("location_id")["aqi"].shift(1)
    assert [None if pd.isna(x) else int(x) for x in got["prev_aqi"]] == \
        [None if pd.isna(x) else int(x) for x in want]
    latest = {r.location_id: (r.event_ts, r.aqi) for r in latest_per_key(df).collect()}
    newest = pdf.loc[pdf.groupby("location_id")["event_ts"].idxmax()]
    assert latest == {int(r.location_id): (r.event_ts.to_pydatetime(), int(r.aqi))
                      for r in newest.itertuples()}


@settings(max_examples=8, deadline=None)
@given(st.lists(st.floats(-1000, 1000), min_size=1, max_size=80), st.integers(1, 12))
def test_histogram_matches_numpy(spark, xs, bins):
    import math

    from haze.operators.metrics import histogram

    df = spark.createDataFrame([(x,) for x in xs], "x double")
    got = {r.bin: r["count"] for r in histogram(df, "x", bins).collect()}
    lo, hi = min(xs), max(xs)
    want = {b: 0 for b in range(1, bins + 1)}
    for x in xs:
        b = 1 if hi == lo else min(int(math.floor(bins * (x - lo) / (hi - lo))) + 1, bins)
        want[b] += 1
    assert got == want


@settings(max_examples=6, deadline=None)
@given(st.lists(st.tuples(st.integers(1, 3), st.integers(0, 3),
                          st.sampled_from([" PM2.5 ", "pm2_5", "PM10", "Temperature", "co"]),
                          st.floats(0, 100)), min_size=1, max_size=50))
def test_pivot_mean_matches_pandas(spark, points):
    import pandas as pd

    from haze.operators.clean import clean_parameter, pivot_mean

    df = spark.createDataFrame(points, "location_id long, hour int, parameter string, value double")
    got = pivot_mean(df.withColumn("parameter", clean_parameter("parameter")),
                     ("location_id", "hour"), ["pm25", "pm10", "temperature", "co"]).toPandas()
    pdf = pd.DataFrame(points, columns=["location_id", "hour", "parameter", "value"])
    pdf["parameter"] = pdf["parameter"].str.strip().str.lower().replace(
        {"pm2.5": "pm25", "pm2_5": "pm25"})
    want = pdf.pivot_table(index=["location_id", "hour"], columns="parameter", values="value",
                           aggfunc="mean").reset_index()
    got = got.set_index(["location_id", "hour"]).sort_index()
    want = want.set_index(["location_id", "hour"]).sort_index()
    assert list(got.index) == list(want.index)
    for c in want.columns:
        assert ((got[c] - want[c]).abs().fillna(0) < 1e-9).all()
        assert (got[c].isna() == want[c].isna()).all()


@settings(max_examples=6, deadline=None)
@given(st.lists(st.tuples(st.integers(1, 3), st.integers(0, 3000), st.integers(0, 500)),
                min_size=1, max_size=60))
def test_window_stats_match_pandas(spark, points):
    import datetime as dt

    import pandas as pd

    from haze.operators.windows import window_stats

    t0 = dt.datetime(2024, 1, 1)
    rows = [(s, t0 + dt.timedelta(minutes=m), a) for s, m, a in points]
    df = spark.createDataFrame(rows, "location_id long, event_ts timestamp, aqi int")
    got = window_stats(df, every="6 hours").toPandas()
    pdf = pd.DataFrame(rows, columns=["location_id", "event_ts", "aqi"])
    pdf["window_start"] = pdf["event_ts"].dt.floor("6h")
    want = pdf.groupby(["window_start", "location_id"]).agg(
        n=("aqi", "size"), avg_aqi=("aqi", "mean"), max_aqi=("aqi", "max")).reset_index()
    key = ["window_start", "location_id"]
    got = got.sort_values(key).reset_index(drop=True)
    want = want.sort_values(key).reset_index(drop=True)
    assert len(got) == len(want)
    assert (got["window_start"].values == want["window_start"].values).all()
    assert (got["n"].values == want["n"].values).all()
    assert (got["max_aqi"].values == want["max_aqi"].values).all()
    assert ((got["avg_aqi"] - want["avg_aqi"]).abs() < 1e-9).all()
    assert ((got["window_end"] - got["window_start"]) == pd.Timedelta(hours=6)).all()


@settings(max_examples=6, deadline=None)
@given(st.lists(st.tuples(st.integers(1, 3), st.integers(0, 5000)), min_size=1, max_size=60,
                unique_by=lambda t: t))
def test_latency_series_numbering_matches_pandas(spark, points):
    import datetime as dt

    import pandas as pd
    from pyspark.sql import functions as F

    from haze.operators.metrics import latency_series

    t0 = dt.datetime(2024, 1, 1)
    rows = [(s, t0 + dt.timedelta(minutes=m)) for s, m in points]
    df = spark.createDataFrame(rows, "location_id long, event_time timestamp") \
        .withColumns({"processed_at": F.col("event_time"), "latency": F.lit(0.0),
                      "disposition": F.lit("valid")})
    got = latency_series(df, chunk_seconds=3600).toPandas() \
        .sort_values(["location_id", "event_time"]).reset_index(drop=True)
    pdf = pd.DataFrame(rows, columns=["location_id", "event_time"]) \
        .sort_values(["location_id", "event_time"]).reset_index(drop=True)
    want = pdf.groupby("location_id").cumcount() + 1
    assert list(got["idx"]) == list(want)
