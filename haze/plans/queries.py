"""Registered queries: name -> (spark, sf_dir) -> DataFrame.

Each query reads the driver tables through :mod:`haze.sources.tables` and
runs the library operators over the whole tables.  Its DuckDB twin lives
in :mod:`haze.plans.oracle_queries`.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from haze.functions import aqi
from haze.sources import tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(name: str):
    def deco(fn):
        QUERIES[name] = fn
        return fn
    return deco


SCORE_COLUMNS = ["location_id", "datetime", "pm25", "pm10",
                 "aqi_pm25", "aqi_pm10", "aqi", "quality"]


@query("aqi_score")
def aqi_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aqi.score(tables.readings(spark, sf_dir)).select(*SCORE_COLUMNS)


@query("quality_distribution")
def quality_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    from haze.operators.dashboard import level_distribution
    return level_distribution(aqi.score(tables.readings(spark, sf_dir)))


@query("aqi_by_breakpoint_table")
def aqi_by_breakpoint_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    from haze.operators.score import breakpoint_frame, score_by_table
    bp = breakpoint_frame(spark)
    df = tables.readings(spark, sf_dir).select("location_id", "datetime", "pm25", "pm10")
    df = score_by_table(df, "pm25", "pm25", bp)
    df = score_by_table(df, "pm10", "pm10", bp)
    return df.withColumn("aqi", aqi.overall("aqi_pm25", "aqi_pm10"))


@query("sql_function_score")
def sql_function_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    aqi.register_sql_functions(spark)
    tables.readings(spark, sf_dir).createOrReplaceTempView("haze_readings")
    return spark.sql("""
        SELECT location_id, datetime, aqi_pm25(pm25) AS aqi_pm25, aqi_pm10(pm10) AS aqi_pm10,
               aqi_overall(aqi_pm25(pm25), aqi_pm10(pm10)) AS aqi,
               aqi_quality(aqi_overall(aqi_pm25(pm25), aqi_pm10(pm10))) AS quality
        FROM haze_readings""")


@query("clean_pivot")
def clean_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    from haze.operators.clean import WIDE_PARAMETERS, hourly_wide
    wide = hourly_wide(tables.raw_long(spark, sf_dir))
    return wide.select("location_id", "datetime",
                       *[F.round(p, 6).alias(p) for p in WIDE_PARAMETERS])


def _latest(spark, sf_dir):
    from haze.operators.latest import latest_per_key
    return latest_per_key(tables.history(spark, sf_dir))


LATEST_COLUMNS = ["location_id", "datetime", "event_ts", "pm25", "pm10",
                  "aqi", "aqi_pm25", "aqi_pm10", "quality", "processed_at"]


@query("latest_per_station")
def latest_per_station(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _latest(spark, sf_dir).select(*LATEST_COLUMNS)


@query("snapshot_ttl")
def snapshot_ttl(spark: SparkSession, sf_dir: str) -> DataFrame:
    from haze.operators.latest import fresh
    return fresh(_latest(spark, sf_dir), tables.SNAPSHOT_AS_OF).select(*LATEST_COLUMNS)


@query("snapshot_kv")
def snapshot_kv(spark: SparkSession, sf_dir: str) -> DataFrame:
    from haze.operators.latest import from_kv, to_kv
    kv = to_kv(_latest(spark, sf_dir))
    back = from_kv(kv)
    return back.withColumn("key", F.concat(F.lit("location:"), F.col("location_id")))


HISTORY_OUT = ["datetime", "location_id", "event_ts", "pm25", "pm10", "aqi",
               "aqi_pm25", "aqi_pm10", "quality", "processed_at"]


@query("latest_history")
def latest_history_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    from haze.operators.history import latest_history
    return latest_history(tables.history(spark, sf_dir), 1000).select(*HISTORY_OUT)


def _stored_snapshot(spark, sf_dir) -> str:
    """The snapshot table of all history rows, written as the serving job does."""
    from haze.session import scratch_path
    from haze.streaming.job import merge_snapshot
    path = scratch_path(spark, "snapshot")
    merge_snapshot(spark, tables.history(spark, sf_dir), path, shards=4)
    return path


def _served(spark, sf_dir, as_of):
    from haze.operators.latest import latest_or_history, read_snapshot
    snap = read_snapshot(spark, _stored_snapshot(spark, sf_dir), as_of)
    return latest_or_history(snap, tables.history(spark, sf_dir), HISTORY_OUT, ranked=True)


@query("latest_or_history")
def latest_or_history_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Serving query over the stored snapshot; rank is the order served."""
    return _served(spark, sf_dir, tables.SNAPSHOT_AS_OF)


@query("latest_or_history_fallback")
def latest_or_history_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Same serving query after every snapshot entry has expired."""
    return _served(spark, sf_dir, "2024-02-02 00:00:00")


@query("serving_counts")
def serving_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows per source of the serving result (the envelope's count)."""
    return latest_or_history_q(spark, sf_dir).groupBy("source").agg(
        F.count(F.lit(1)).alias("count"))


@query("history_lookup")
def history_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from haze.operators.history import history_query
    df = history_query(tables.history(spark, sf_dir), quality=aqi.QUALITY_FULL[1],
                       since="2024-01-10 00:00:00", until="2024-01-20 00:00:00")
    return df.select(*HISTORY_OUT)


@query("history_upsert")
def history_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Write all history rows, then upsert a second delivery of the rows with
    pm10 < 325 processed 60 s later; last write per (station, datetime) wins."""
    from haze.operators.history import upsert_history
    from haze.session import scratch_path
    path = scratch_path(spark, "history-upsert")
    hist = tables.history(spark, sf_dir)
    upsert_history(spark, hist, path)
    again = hist.where(F.col("pm10") < 325).withColumn(
        "processed_at", F.col("processed_at") + F.expr("INTERVAL 60 SECONDS"))
    upsert_history(spark, again, path)
    return spark.read.parquet(path).select(*HISTORY_OUT)


@query("align_schema")
def align_schema(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Old rows with only five columns, aligned to the 13-column schema."""
    from haze.operators.clean import align_to_schema
    from haze.schemas import HISTORY_SCHEMA
    old = tables.history(spark, sf_dir).select("datetime", "pm25", "aqi", "quality",
                                               "processed_at")
    return align_to_schema(old, HISTORY_SCHEMA)


@query("null_defaults")
def null_defaults(spark: SparkSession, sf_dir: str) -> DataFrame:
    from haze.functions.values import default_if_missing, falsy_to_null
    from haze.operators.clean import select_available
    h = select_available(tables.history(spark, sf_dir),
                         ["location_id", "datetime", "aqi", "aqi_pm25", "pm25", "pm1",
                          "temperature", "not_a_column"])
    return h.select(
        "location_id", "datetime",
        default_if_missing("pm1").alias("pm1_or_0"),
        default_if_missing("temperature", 25.0).alias("temperature_or_25"),
        falsy_to_null("aqi").alias("aqi_or_null"),
        falsy_to_null("aqi_pm25").alias("aqi_pm25_or_null"),
        falsy_to_null("pm25").alias("pm25_or_null"))


@query("display_rows")
def display_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    from haze.functions.timefmt import display_time
    from haze.operators.history import latest_history
    top = latest_history(tables.history(spark, sf_dir), 100)
    return top.select(display_time("event_ts").alias("updated"), "location_id", "aqi",
                      "quality", "pm25", "pm10", "temperature", "relativehumidity")


def _samples(spark, sf_dir):
    from haze.operators.metrics import latency_samples
    return latency_samples(tables.latency_source(spark, sf_dir), tables.LATENCY_AS_OF,
                           window_minutes=10 * 24 * 60)


@query("latency_summary")
def latency_summary_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    from haze.operators.metrics import latency_summary
    s = latency_summary(_samples(spark, sf_dir))
    return s.select(*[F.round(c, 6).alias(c) if c in ("min", "max", "avg", "std_dev", "p50",
                                                        "p95", "p99") else F.col(c)
                      for c in s.columns])


@query("latency_histogram")
def latency_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    from haze.operators.metrics import histogram
    valid = _samples(spark, sf_dir).where(F.col("disposition") == "valid")
    h = histogram(valid, "latency", 50)
    return h.select("bin", F.round("bin_lo", 6).alias("bin_lo"),
                    F.round("bin_hi", 6).alias("bin_hi"), "count")


@query("latency_series")
def latency_series_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    from haze.operators.metrics import latency_series
    return latency_series(_samples(spark, sf_dir))


@query("throughput")
def throughput_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    from haze.operators.metrics import throughput
    t = throughput(tables.history(spark, sf_dir), "processed_at")
    return t.withColumn("rows_per_s", F.round("rows_per_s", 9))


@query("throughput_by_hour")
def throughput_by_hour(spark: SparkSession, sf_dir: str) -> DataFrame:
    from haze.operators.metrics import throughput_by_window
    return throughput_by_window(tables.history(spark, sf_dir), "processed_at", "1 hour")


@query("recent_rows")
def recent_rows_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    from haze.operators.metrics import recent_rows
    return recent_rows(tables.history(spark, sf_dir), tables.SNAPSHOT_AS_OF, seconds=3600)


@query("freshness")
def freshness_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    from haze.operators.metrics import freshness
    return freshness(tables.history(spark, sf_dir), tables.LATENCY_AS_OF)


@query("ingest_lag")
def ingest_lag_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages produced (all events) vs rows stored by the snapshot instant."""
    from haze.operators.metrics import ingest_lag
    produced = tables.table(spark, sf_dir, "events").agg(F.count(F.lit(1)).alias("produced"))
    stored = tables.history(spark, sf_dir).where(
        F.col("processed_at") <= F.lit(tables.SNAPSHOT_AS_OF).cast("timestamp"))
    return ingest_lag(produced, stored)


def _wide(spark, sf_dir):
    from haze.operators.clean import WIDE_PARAMETERS, hourly_wide
    return hourly_wide(tables.raw_long(spark, sf_dir), WIDE_PARAMETERS)


@query("densify_linear")
def densify_linear(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly wide readings densified to an hourly grid per station."""
    from haze.operators.densify import densify
    return densify(_wide(spark, sf_dir), step_seconds=3600, off_grid="drop")


@query("forward_fill")
def forward_fill_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    from haze.operators.densify import forward_fill
    return forward_fill(_wide(spark, sf_dir), ["pm25", "temperature"])


@query("jitter")
def jitter_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Densified hourly grid with 2 % multiplicative noise drawn from the key's md5."""
    from haze.operators.densify import densify, jitter
    dense = densify(_wide(spark, sf_dir), step_seconds=3600, off_grid="drop")
    columns = ["pm25", "pm10", "temperature", "relativehumidity"]
    return jitter(dense, columns).withColumns({c: F.round(c, 6) for c in columns})


# ------------------------------------------------------------------ streaming

STREAM_SPLIT = "2024-01-16 00:00:00"


def _messages(spark, sf_dir, before: bool | None):
    from haze.streaming.source import encode_readings
    r = tables.readings(spark, sf_dir)
    split = F.lit(STREAM_SPLIT).cast("timestamp")
    if before is True:
        r = r.where(F.col("event_ts") < split)
    elif before is False:
        r = r.where(F.col("event_ts") >= split)
    return encode_readings(r).select("value")


def _decoded_stream(spark, inp):
    from haze.streaming.source import decode_readings, readings_stream, split_decoded
    good, _ = split_decoded(decode_readings(readings_stream(spark, "text", inp)))
    return good


@query("json_decode")
def json_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Readings encoded as JSON messages and decoded back (float32 fields)."""
    from haze.streaming.source import decode_readings
    dec = decode_readings(_messages(spark, sf_dir, None))
    return dec.select("datetime", "location_id", "pm25", "pm10", "pm1", "event_ts",
                      "decode_status")


@query("stream_score")
def stream_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two deliveries of JSON files through the streaming job (same
    checkpoint, restarted between them) into the keyed history table."""
    from haze.session import scratch_path
    from haze.streaming.job import DualSink, run_to_completion, score_stream
    root = scratch_path(spark, "stream-score")
    for before in (True, False):
        _messages(spark, sf_dir, before).write.mode("append").text(f"{root}/in")
        scored = score_stream(_decoded_stream(spark, f"{root}/in"))
        run_to_completion(scored, f"{root}/ckpt",
                          sink=DualSink(spark, f"{root}/history", f"{root}/snapshot"))
    return spark.read.parquet(f"{root}/history").select(
        "datetime", "location_id", "event_ts", "pm25", "pm10", "aqi_pm25", "aqi_pm10", "aqi",
        "quality")


@query("stream_latest")
def stream_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stateful latest-per-station stream; the older half arrives second and
    must not regress the snapshot."""
    from haze.session import scratch_path
    from haze.streaming.job import score_stream, snapshot_stream
    root = scratch_path(spark, "stream-latest")
    snap = f"{root}/snapshot"
    for before in (False, True):
        _messages(spark, sf_dir, before).write.mode("append").text(f"{root}/in")
        q = snapshot_stream(score_stream(_decoded_stream(spark, f"{root}/in")), snap,
                            f"{root}/ckpt", trigger={"availableNow": True})
        q.awaitTermination()
    return spark.read.parquet(snap).select(
        "location_id", "datetime", "event_ts", "pm25", "pm10", "aqi", "aqi_pm25", "aqi_pm10",
        "quality")


@query("stream_dedup")
def stream_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First delivery: the first half; second delivery: everything again.
    Keyed dedup within a 10-minute watermark keeps each reading once."""
    from haze.session import scratch_path
    from haze.streaming.job import dedup_stream, run_to_completion
    root = scratch_path(spark, "stream-dedup")
    for before in (True, None):
        _messages(spark, sf_dir, before).write.mode("append").text(f"{root}/in")
        stream = _decoded_stream(spark, f"{root}/in").withWatermark("event_ts", "10 minutes")
        out = dedup_stream(stream).select("location_id", "datetime", "event_ts", "pm25")
        run_to_completion(out, f"{root}/ckpt", fmt="parquet", path=f"{root}/out")
    return spark.read.parquet(f"{root}/out")


@query("datetime_parse")
def datetime_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ISO text in two spellings (UTC with fraction; +07:00 without) and the
    space form, each parsed back to an instant."""
    from haze.functions.timefmt import iso_format, parse_instant
    r = tables.readings(spark, sf_dir).select("location_id", "event_ts")
    local = F.concat(F.date_format(F.from_utc_timestamp("event_ts", "+07:00"),
                                   "yyyy-MM-dd'T'HH:mm:ss"), F.lit("+07:00"))
    spaced = F.date_format("event_ts", "yyyy-MM-dd HH:mm:ss")
    return r.select(
        "location_id", "event_ts",
        iso_format("event_ts").alias("iso_utc"),
        local.alias("iso_local"),
        parse_instant(iso_format("event_ts")).alias("parsed_utc"),
        parse_instant(local).alias("parsed_local"),
        parse_instant(spaced).alias("parsed_spaced"),
        parse_instant(F.concat(F.lit("x"), spaced)).alias("parsed_bad"))


# ------------------------------------------------------------------ dashboard

@query("alerts")
def alerts_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    from haze.operators.dashboard import alerts
    return alerts(tables.history(spark, sf_dir))


@query("dashboard_means")
def dashboard_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    from haze.operators.dashboard import means
    m = means(tables.history(spark, sf_dir))
    return m.select(*[F.round(c, 6).alias(c) for c in m.columns])


@query("pm_ratio")
def pm_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    from haze.operators.dashboard import ratios
    return ratios(_latest(spark, sf_dir)).select(
        "location_id", "pm25", "pm10", "pm25_share_pct", "coarse_pm",
        aqi.aqi_color("aqi").alias("color"), aqi.quality("aqi", "short").alias("level"))


@query("window_aqi")
def window_aqi(spark: SparkSession, sf_dir: str) -> DataFrame:
    from haze.operators.windows import window_stats
    w = window_stats(tables.history(spark, sf_dir), every="6 hours")
    return w.withColumn("avg_aqi", F.round("avg_aqi", 6))


@query("window_aqi_sliding")
def window_aqi_sliding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from haze.operators.windows import window_stats
    w = window_stats(tables.history(spark, sf_dir), every="2 hours", slide="1 hour")
    return w.withColumn("avg_aqi", F.round("avg_aqi", 6))


@query("alert_edges")
def alert_edges_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    from haze.operators.windows import alert_edges, rules_frame
    e = alert_edges(tables.history(spark, sf_dir), rules_frame(spark))
    return e.select("location_id", "event_ts", "datetime", "aqi", "severity", "prev_severity")


@query("multi_pollutant")
def multi_pollutant(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly means scored through the generic many-pollutant API."""
    scored = aqi.score_many(_wide(spark, sf_dir), {"pm25": aqi.PM25, "pm10": aqi.PM10})
    return scored.select("location_id", "datetime", "aqi_pm25", "aqi_pm10", "aqi", "quality")


@query("aqi_histogram")
def aqi_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distribution of the overall index over 50 equal bins (RM-4)."""
    from haze.operators.metrics import histogram
    h = histogram(tables.history(spark, sf_dir), "aqi", 50)
    return h.select("bin", F.round("bin_lo", 6).alias("bin_lo"),
                    F.round("bin_hi", 6).alias("bin_hi"), "count")


# ------------------------------------------------------------------ variants

@query("aqi_score_continuous")
def aqi_score_continuous(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scoring with ``gap_policy="continuous"``: a value between two brackets
    uses the lower bracket's line instead of scoring 0."""
    r = tables.readings(spark, sf_dir)
    return r.select("location_id", "datetime",
                    aqi.aqi_pm25("pm25", gap_policy="continuous").alias("aqi_pm25"),
                    aqi.aqi_pm10("pm10", gap_policy="continuous").alias("aqi_pm10"))


@query("clean_pivot_discovered")
def clean_pivot_discovered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long -> wide with the parameter names discovered from the data."""
    from haze.operators.clean import clean_parameter, pivot_mean
    long = tables.raw_long(spark, sf_dir).withColumns({
        "parameter": clean_parameter("parameter"), "datetime": F.date_trunc("hour", "ts")})
    wide = pivot_mean(long, ("location_id", "datetime"), None)
    return wide.select("location_id", "datetime",
                       *[F.round(c, 6).alias(c) for c in wide.columns[2:]])


@query("densify_snap")
def densify_snap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Irregular raw readings snapped down to an hourly grid from each
    station's first reading, averaged, then densified."""
    from haze.operators.densify import densify
    r = tables.readings(spark, sf_dir).select("location_id", F.col("event_ts").alias("datetime"),
                                              "pm25", "pm10")
    return densify(r, values=["pm25", "pm10"], step_seconds=3600, off_grid="snap")


@query("history_station_lookup")
def history_station_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from haze.operators.history import history_query
    h = tables.history(spark, sf_dir)
    return history_query(h, station=42).select(*HISTORY_OUT)


@query("stream_window")
def stream_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """6-hour AQI windows per station on the stream (watermark 10 minutes,
    append mode): only windows closed by the watermark are emitted."""
    from haze.operators.windows import window_stats
    from haze.session import scratch_path
    from haze.streaming.job import run_to_completion, score_stream
    root = scratch_path(spark, "stream-window")
    for before in (True, False):
        _messages(spark, sf_dir, before).write.mode("append").text(f"{root}/in")
        scored = score_stream(_decoded_stream(spark, f"{root}/in"))
        w = window_stats(scored, every="6 hours")
        run_to_completion(w, f"{root}/ckpt", fmt="parquet", path=f"{root}/out")
    out = spark.read.parquet(f"{root}/out")
    return out.withColumn("avg_aqi", F.round("avg_aqi", 6))


@query("alerts_latest_only")
def alerts_latest_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Danger alerts (> 200) on each station's newest reading only."""
    from haze.operators.dashboard import alerts
    return alerts(tables.history(spark, sf_dir), threshold=aqi.SEVERITY_DANGER,
                  latest_only=True).select("location_id", "datetime", "aqi", "severity")


@query("sql_station_summary")
def sql_station_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Plain SQL over the registered views: per station, readings, mean and
    peak index, and the share of readings above the warning level."""
    from haze.plans.views import register_views
    register_views(spark, sf_dir)
    return spark.sql("""
        SELECT location_id, count(*) AS n, round(avg(aqi), 6) AS avg_aqi, max(aqi) AS max_aqi,
               round(count_if(aqi > 150) / count(*), 6) AS share_unhealthy,
               max_by(aqi_quality(aqi), event_ts) AS latest_quality
        FROM aq_history GROUP BY location_id""")


@query("stream_history_append")
def stream_history_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Append-mode job: the first half is delivered, then everything again;
    the exactly-once file sink stores every delivery and the key view reads
    one row per (station, datetime)."""
    from haze.session import scratch_path
    from haze.streaming.job import current_history, scoring_job_append
    from haze.streaming.source import readings_stream
    root = scratch_path(spark, "stream-append")
    for before in (True, None):
        _messages(spark, sf_dir, before).write.mode("append").text(f"{root}/in")
        for q in scoring_job_append(spark, readings_stream(spark, "text", f"{root}/in"),
                                    f"{root}/history", checkpoint=f"{root}/ckpt",
                                    trigger={"availableNow": True}):
            q.awaitTermination()
    return current_history(spark.read.parquet(f"{root}/history")).select(
        "datetime", "location_id", "event_ts", "pm25", "pm10", "aqi", "quality")


@query("grid_left_join")
def grid_left_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The literal hourly grid per station left-joined with the hourly wide
    readings (values only where a reading exists)."""
    from haze.operators.densify import left_join_grid
    g = left_join_grid(_wide(spark, sf_dir), step_seconds=3600)
    return g.select("location_id", "datetime", F.round("pm25", 6).alias("pm25"),
                    F.round("pm10", 6).alias("pm10"))


@query("aqi_quantiles")
def aqi_quantiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact nearest-rank quantiles of the overall index over all readings,
    through the generic two-level histogram (bucket width from the data)."""
    from haze.operators.metrics import exact_ranks
    qs = {"p10": 0.1, "p50": 0.5, "p90": 0.9, "p99": 0.99, "max": 1.0}
    r = exact_ranks(tables.history(spark, sf_dir), "aqi", qs)
    return r.select(F.col("name").alias("quantile"), F.col("v").cast("int").alias("aqi"))


@query("densify_spread")
def densify_spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``densify_linear`` with gaps cut at day boundaries and spread over
    tasks before the grid is generated (same result)."""
    from haze.operators.densify import densify
    return densify(_wide(spark, sf_dir), step_seconds=3600, spread_gaps=True, off_grid="drop")


from haze.plans import stream_trips  # noqa: E402, F401
from haze.plans.round_trips import ROUND_TRIPS  # noqa: E402

QUERIES |= ROUND_TRIPS
