"""DuckDB oracle SQL for each registered query (same column names)."""

from __future__ import annotations

from haze.plans.oracle import (COLORS, INDEX, LEVEL_BOUNDS, NO_COLOR, NO_LABEL, SHORT_LABELS,
                               index_sql, level_sql, with_views)

ORACLE: dict[str, str] = {}

ORACLE["aqi_score"] = with_views("""
SELECT location_id, datetime, pm25, pm10, aqi_pm25, aqi_pm10, aqi, quality
FROM history""", "history")

ORACLE["quality_distribution"] = with_views("""
SELECT quality, count(*) AS n, round(avg(aqi), 6) AS avg_aqi,
       min(aqi) AS min_aqi, max(aqi) AS max_aqi,
       round(count(*) / sum(count(*)) OVER (), 6) AS share
FROM history GROUP BY quality""", "history")


def _bp_values() -> str:
    return ", ".join(f"('{name}', {lo}E0, {hi}E0, {a}, {b}, {cap}E0, 500)"
                     for name, (rows, cap) in INDEX.items() for lo, hi, a, b in rows)


ORACLE["aqi_by_breakpoint_table"] = with_views("""
SELECT *, greatest(coalesce(aqi_pm25, 0), coalesce(aqi_pm10, 0)) AS aqi FROM s""", "readings", extra={
    "bp": f"""SELECT * FROM (VALUES {_bp_values()})
              AS t(pollutant, c_low, c_high, i_low, i_high, cap_above, index_cap)""",
    "s": """
  SELECT r.location_id, r.datetime, r.pm25, r.pm10,
    CASE WHEN r.pm25 IS NULL OR isnan(r.pm25) THEN 0
         WHEN b25.c_low IS NOT NULL THEN CAST(round_even((b25.i_high - b25.i_low) / (b25.c_high - b25.c_low) * (r.pm25 - b25.c_low) + b25.i_low, 0) AS INTEGER)
         WHEN r.pm25 > 500.0E0 THEN 500 ELSE 0 END AS aqi_pm25,
    CASE WHEN r.pm10 IS NULL OR isnan(r.pm10) THEN 0
         WHEN b10.c_low IS NOT NULL THEN CAST(round_even((b10.i_high - b10.i_low) / (b10.c_high - b10.c_low) * (r.pm10 - b10.c_low) + b10.i_low, 0) AS INTEGER)
         WHEN r.pm10 > 600.0E0 THEN 500 ELSE 0 END AS aqi_pm10
  FROM readings r
  LEFT JOIN bp b25 ON b25.pollutant = 'pm25' AND r.pm25 BETWEEN b25.c_low AND b25.c_high
  LEFT JOIN bp b10 ON b10.pollutant = 'pm10' AND r.pm10 BETWEEN b10.c_low AND b10.c_high"""})

ORACLE["sql_function_score"] = with_views("""
SELECT location_id, datetime, aqi_pm25, aqi_pm10, aqi, quality FROM history""", "history")


def _clean_param_sql(expr: str) -> str:
    from haze.schemas import PARAMETER_NAMES
    blank = "[\\s\\x{0B}\\x{85}\\x{A0}\\x{1680}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}]"
    name = f"lower(regexp_replace({expr}, '^{blank}+|{blank}+$', '', 'g'))"
    whens = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in PARAMETER_NAMES.items())
    return f"coalesce(CASE {name} {whens} END, {name})"


ORACLE["clean_pivot"] = with_views(f"""
SELECT location_id, date_trunc('hour', ts) AS datetime,
       round(avg(value) FILTER (WHERE p = 'pm25'), 6) AS pm25,
       round(avg(value) FILTER (WHERE p = 'pm10'), 6) AS pm10,
       round(avg(value) FILTER (WHERE p = 'temperature'), 6) AS temperature,
       round(avg(value) FILTER (WHERE p = 'relativehumidity'), 6) AS relativehumidity
FROM (SELECT *, {_clean_param_sql('parameter')} AS p FROM raw_long)
WHERE p IN ('pm25', 'pm10', 'temperature', 'relativehumidity')
GROUP BY 1, 2""", "raw_long")

LATEST = """
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY location_id
                 ORDER BY event_ts DESC, datetime DESC, processed_at DESC) AS rn FROM history)
  WHERE rn = 1"""
LATEST_COLS = ("location_id, datetime, event_ts, pm25, pm10, aqi, aqi_pm25, aqi_pm10, "
               "quality, processed_at")
HIST_COLS = ("datetime, location_id, event_ts, pm25, pm10, aqi, aqi_pm25, aqi_pm10, "
             "quality, processed_at")
TTL = "processed_at > TIMESTAMP '{as_of}' - INTERVAL 3600 SECOND"


def _with_latest(body: str) -> str:
    return with_views(body, "history", extra={"latest": LATEST})


ORACLE["latest_per_station"] = _with_latest(f"\nSELECT {LATEST_COLS} FROM latest")

ORACLE["snapshot_ttl"] = _with_latest(
    f"\nSELECT {LATEST_COLS} FROM latest WHERE {TTL.format(as_of='2024-01-30 23:00:00')}")

TS_TEXT = ("CASE WHEN microsecond(processed_at) % 1000000 = 0 "
           "THEN strftime(processed_at, '%Y-%m-%d %H:%M:%S') "
           "ELSE strftime(processed_at, '%Y-%m-%d %H:%M:%S.%f') END")

ORACLE["snapshot_kv"] = _with_latest(f"""
SELECT datetime, location_id, pm25, pm10, pm1, temperature, relativehumidity, um003,
       aqi, aqi_pm25, aqi_pm10, quality, {TS_TEXT} AS processed_at,
       'location:' || CAST(location_id AS VARCHAR) AS key
FROM latest""")

ORACLE["latest_history"] = with_views(f"""
SELECT {HIST_COLS} FROM history ORDER BY event_ts DESC, location_id DESC LIMIT 1000""",
                                      "history")

_FALLBACK = """
SELECT *, CAST(row_number() OVER (ORDER BY event_ts DESC, location_id DESC) AS INTEGER) AS rank FROM (
SELECT {cols}, 'snapshot' AS source FROM latest WHERE {ttl}
UNION ALL
SELECT * FROM (SELECT {cols}, 'history' AS source FROM history
               ORDER BY event_ts DESC, location_id DESC LIMIT 1000)
WHERE NOT EXISTS (SELECT 1 FROM latest WHERE {ttl}))"""

ORACLE["latest_or_history"] = _with_latest(
    _FALLBACK.format(cols=HIST_COLS, ttl=TTL.format(as_of="2024-01-30 23:00:00")))

ORACLE["latest_or_history_fallback"] = _with_latest(
    _FALLBACK.format(cols=HIST_COLS, ttl=TTL.format(as_of="2024-02-02 00:00:00")))

ORACLE["serving_counts"] = _with_latest(
    "\nSELECT source, count(*) AS count FROM ("
    + _FALLBACK.format(cols=HIST_COLS, ttl=TTL.format(as_of="2024-01-30 23:00:00"))
    + ") GROUP BY source")

ORACLE["history_lookup"] = with_views(f"""
SELECT {HIST_COLS} FROM history
WHERE quality = 'Trung bình (Moderate)'
  AND event_ts >= TIMESTAMP '2024-01-10 00:00:00' AND event_ts < TIMESTAMP '2024-01-20 00:00:00'""",
                                      "history")

ORACLE["history_upsert"] = with_views(f"""
SELECT {HIST_COLS} FROM (
  SELECT *, row_number() OVER (PARTITION BY location_id, datetime ORDER BY processed_at DESC) AS rn
  FROM (SELECT {HIST_COLS} FROM history
        UNION ALL
        SELECT datetime, location_id, event_ts, pm25, pm10, aqi, aqi_pm25, aqi_pm10, quality,
               processed_at + INTERVAL 60 SECOND FROM history WHERE pm10 < 325))
WHERE rn = 1""", "history")

ORACLE["align_schema"] = with_views("""
SELECT datetime, CAST(NULL AS BIGINT) AS location_id, CAST(pm25 AS REAL) AS pm25,
       CAST(NULL AS REAL) AS pm10, CAST(NULL AS REAL) AS pm1, CAST(NULL AS REAL) AS temperature,
       CAST(NULL AS REAL) AS relativehumidity, CAST(NULL AS REAL) AS um003,
       aqi, CAST(NULL AS INTEGER) AS aqi_pm25, CAST(NULL AS INTEGER) AS aqi_pm10,
       quality, processed_at
FROM history""", "history")

ORACLE["null_defaults"] = with_views("""
SELECT location_id, datetime,
       coalesce(CASE WHEN isnan(pm1) THEN NULL ELSE pm1 END, 0.0E0) AS pm1_or_0,
       coalesce(CASE WHEN isnan(temperature) THEN NULL ELSE temperature END, 25.0E0) AS temperature_or_25,
       nullif(aqi, 0) AS aqi_or_null, nullif(aqi_pm25, 0) AS aqi_pm25_or_null,
       nullif(pm25, 0) AS pm25_or_null
FROM history""", "history")

ORACLE["display_rows"] = with_views("""
SELECT coalesce(strftime(event_ts, '%H:%M:%S %d/%m/%Y'), 'N/A') AS updated, location_id, aqi,
       quality, pm25, pm10, temperature, relativehumidity
FROM history ORDER BY event_ts DESC, location_id DESC LIMIT 100""", "history")


SAMPLES = """
  SELECT location_id, event_time, processed_at, latency, latency_us,
    CASE WHEN datetime IS NULL OR trim(datetime) = '' OR processed_at IS NULL THEN 'missing'
         WHEN event_time IS NULL THEN 'invalid'
         WHEN event_time < TIMESTAMP '2024-01-31 00:00:00' - INTERVAL 14400 MINUTE THEN 'old'
         WHEN latency_us >= 0 AND latency_us < 300000000 THEN 'valid'
         ELSE 'invalid' END AS disposition
  FROM (SELECT *, epoch_us(processed_at) - epoch_us(event_time) AS latency_us,
               (epoch_us(processed_at) - epoch_us(event_time)) / 1e6 AS latency
        FROM latency_source)"""

ORACLE["latency_summary"] = with_views("""
SELECT c.*, s.*, q.*, s.avg > 1.0 AS overloaded, s.std_dev > 0.5 AS unstable
FROM (SELECT count(*) AS raw, count(*) FILTER (WHERE disposition = 'valid') AS valid,
             count(*) FILTER (WHERE disposition = 'old') AS old,
             count(*) FILTER (WHERE disposition = 'invalid') AS invalid FROM samples) c,
     (SELECT count(*) AS count, round(min(latency), 6) AS min, round(max(latency), 6) AS max,
             round(avg(latency), 6) AS avg, round(stddev_samp(latency), 6) AS std_dev
      FROM v) s,
     (SELECT round(max(x) FILTER (WHERE rk = floor((n - 1) * 0.5))
                   + (max(x) FILTER (WHERE rk = ceil((n - 1) * 0.5))
                      - max(x) FILTER (WHERE rk = floor((n - 1) * 0.5))) * 0.5, 6) AS p50,
             round(max(x) FILTER (WHERE rk = floor((n - 1) * 0.95 + 0.5)), 6) AS p95,
             round(max(x) FILTER (WHERE rk = floor((n - 1) * 0.99 + 0.5)), 6) AS p99
      FROM (SELECT latency_us / 1e6 AS x, row_number() OVER (ORDER BY latency_us) - 1 AS rk,
                   count(*) OVER () AS n FROM v)) q""", "latency_source",
                                       extra={"samples": SAMPLES,
                                              "v": "SELECT * FROM samples WHERE disposition = 'valid'"})

ORACLE["latency_histogram"] = with_views("""
SELECT b.bin, round(mn + (b.bin - 1) * (mx - mn) / 50, 6) AS bin_lo,
       round(mn + b.bin * (mx - mn) / 50, 6) AS bin_hi, coalesce(h.count, 0) AS count
FROM (SELECT CAST(range AS INTEGER) AS bin FROM range(1, 51)) b
CROSS JOIN mm
LEFT JOIN (SELECT CAST(CASE WHEN mx = mn THEN 1
                   ELSE least(floor(50 * (latency - mn) / (mx - mn)) + 1, 50) END AS INTEGER) AS bin,
                  count(*) AS count
           FROM v, mm GROUP BY 1) h ON h.bin = b.bin""", "latency_source", extra={
    "samples": SAMPLES,
    "v": "SELECT * FROM samples WHERE disposition = 'valid'",
    "mm": "SELECT min(latency) AS mn, max(latency) AS mx FROM v"})

ORACLE["latency_series"] = with_views("""
SELECT location_id, row_number() OVER (PARTITION BY location_id ORDER BY event_time, processed_at) AS idx,
       event_time, processed_at, latency
FROM samples WHERE disposition = 'valid'""", "latency_source", extra={"samples": SAMPLES})

ORACLE["throughput"] = with_views("""
SELECT rows, first, last, elapsed_s,
       round(CASE WHEN elapsed_s > 0 THEN rows / elapsed_s END, 9) AS rows_per_s
FROM (SELECT count(*) AS rows, min(processed_at) AS first, max(processed_at) AS last,
             (epoch_us(max(processed_at)) - epoch_us(min(processed_at))) / 1e6 AS elapsed_s
      FROM history)""", "history")

ORACLE["throughput_by_hour"] = with_views("""
SELECT date_trunc('hour', processed_at) AS window_start,
       date_trunc('hour', processed_at) + INTERVAL 1 HOUR AS window_end, count(*) AS rows
FROM history GROUP BY 1, 2""", "history")

ORACLE["recent_rows"] = with_views("""
SELECT count(*) AS total,
       count(*) FILTER (WHERE processed_at >= TIMESTAMP '2024-01-30 23:00:00' - INTERVAL 3600 SECOND
                          AND processed_at <= TIMESTAMP '2024-01-30 23:00:00') AS recent
FROM history""", "history")

ORACLE["freshness"] = with_views("""
SELECT count, newest, age_s,
       CASE WHEN count = 0 THEN 'WARNING' WHEN age_s < 30 THEN 'OK'
            WHEN age_s < 120 THEN 'WARNING' ELSE 'ERROR' END AS status
FROM (SELECT count(*) AS count, max(event_ts) AS newest,
             (epoch_us(TIMESTAMP '2024-01-31 00:00:00') - epoch_us(max(event_ts))) / 1e6 AS age_s
      FROM history)""", "history")

ORACLE["ingest_lag"] = with_views("""
SELECT produced, stored, greatest(produced - stored, 0) AS lag
FROM (SELECT count(*) AS produced FROM events),
     (SELECT count(*) AS stored FROM history
      WHERE processed_at <= TIMESTAMP '2024-01-30 23:00:00')""", "history")


WIDE = f"""
  SELECT location_id, date_trunc('hour', ts) AS datetime,
         avg(value) FILTER (WHERE p = 'pm25') AS pm25,
         avg(value) FILTER (WHERE p = 'pm10') AS pm10,
         avg(value) FILTER (WHERE p = 'temperature') AS temperature,
         avg(value) FILTER (WHERE p = 'relativehumidity') AS relativehumidity
  FROM (SELECT *, {_clean_param_sql('parameter')} AS p FROM raw_long)
  WHERE p IN ('pm25', 'pm10', 'temperature', 'relativehumidity')
  GROUP BY 1, 2"""

_DCOLS = ["pm25", "pm10", "temperature", "relativehumidity"]


def _interp(c: str) -> str:
    return (f"CASE WHEN p_{c}_t = g THEN p_{c}_v "
            f"WHEN p_{c}_t IS NOT NULL AND n_{c}_t IS NOT NULL THEN p_{c}_v + (n_{c}_v - p_{c}_v) * "
            f"(CAST(epoch_us(g) - epoch_us(p_{c}_t) AS DOUBLE) / "
            f"CAST(epoch_us(n_{c}_t) - epoch_us(p_{c}_t) AS DOUBLE)) END AS {c}")


def _neighbours(c: str) -> str:
    w_p = "OVER (PARTITION BY location_id ORDER BY g ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
    w_n = "OVER (PARTITION BY location_id ORDER BY g ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING)"
    known_t = f"CASE WHEN {c} IS NOT NULL AND NOT isnan({c}) THEN g END"
    known_v = f"CASE WHEN {c} IS NOT NULL AND NOT isnan({c}) THEN {c} END"
    return (f"last_value({known_t} IGNORE NULLS) {w_p} AS p_{c}_t, "
            f"last_value({known_v} IGNORE NULLS) {w_p} AS p_{c}_v, "
            f"first_value({known_t} IGNORE NULLS) {w_n} AS n_{c}_t, "
            f"first_value({known_v} IGNORE NULLS) {w_n} AS n_{c}_v")


ORACLE["densify_linear"] = with_views(f"""
SELECT location_id, g AS datetime, {", ".join(_interp(c) for c in _DCOLS)}
FROM (SELECT *, {", ".join(_neighbours(c) for c in _DCOLS)} FROM j)""", "raw_long", extra={
    "wide": WIDE,
    "bounds": "SELECT location_id, min(datetime) AS t0, max(datetime) AS t1 FROM wide GROUP BY 1",
    "grid": "SELECT location_id, unnest(generate_series(t0, t1, INTERVAL 1 HOUR)) AS g FROM bounds",
    "j": """SELECT grid.location_id, grid.g, w.pm25, w.pm10, w.temperature, w.relativehumidity
            FROM grid LEFT JOIN wide w ON w.location_id = grid.location_id AND w.datetime = grid.g""",
})

ORACLE["forward_fill"] = with_views("""
SELECT location_id, datetime,
       coalesce(pm25, last_value(pm25 IGNORE NULLS) OVER w) AS pm25, pm10,
       coalesce(temperature, last_value(temperature IGNORE NULLS) OVER w) AS temperature,
       relativehumidity
FROM wide
WINDOW w AS (PARTITION BY location_id ORDER BY datetime
             ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""", "raw_long", extra={"wide": WIDE})


_F32 = f"""
  SELECT location_id, event_ts, datetime, CAST(pm25 AS REAL) AS pm25, CAST(pm10 AS REAL) AS pm10,
         CAST(NULL AS REAL) AS pm1
  FROM readings"""
_F32_SCORED = f"""
  SELECT *, {level_sql('aqi')} AS quality FROM (
    SELECT *, greatest(coalesce(aqi_pm25, 0), coalesce(aqi_pm10, 0)) AS aqi FROM (
      SELECT *, {index_sql('pm25', 'pm25')} AS aqi_pm25,
                {index_sql('pm10', 'pm10')} AS aqi_pm10
      FROM f32))"""

ORACLE["json_decode"] = with_views("""
SELECT datetime, location_id, pm25, pm10, pm1, event_ts, 'ok' AS decode_status FROM f32""",
                                   "readings", extra={"f32": _F32})

ORACLE["stream_score"] = with_views("""
SELECT datetime, location_id, event_ts, pm25, pm10, aqi_pm25, aqi_pm10, aqi, quality FROM s""",
                                    "readings", extra={"f32": _F32, "s": _F32_SCORED})

ORACLE["stream_latest"] = with_views("""
SELECT location_id, datetime, event_ts, pm25, pm10, aqi, aqi_pm25, aqi_pm10, quality
FROM (SELECT *, row_number() OVER (PARTITION BY location_id ORDER BY event_ts DESC, datetime DESC) AS rn
      FROM s) WHERE rn = 1""", "readings", extra={"f32": _F32, "s": _F32_SCORED})

ORACLE["stream_dedup"] = with_views("""
SELECT location_id, datetime, event_ts, pm25 FROM f32""", "readings", extra={"f32": _F32})

ORACLE["datetime_parse"] = with_views("""
SELECT location_id, event_ts,
       CASE WHEN microsecond(event_ts) % 1000000 = 0
            THEN strftime(event_ts, '%Y-%m-%dT%H:%M:%S') || '+00:00'
            ELSE strftime(event_ts, '%Y-%m-%dT%H:%M:%S.%f') || '+00:00' END AS iso_utc,
       strftime(event_ts + INTERVAL 7 HOUR, '%Y-%m-%dT%H:%M:%S') || '+07:00' AS iso_local,
       event_ts AS parsed_utc,
       date_trunc('second', event_ts) AS parsed_local,
       date_trunc('second', event_ts) AS parsed_spaced,
       CAST(NULL AS TIMESTAMP) AS parsed_bad
FROM readings""", "readings")


def _level_sql(expr: str, labels, null_value) -> str:
    whens = " ".join(f"WHEN {expr} <= {b} THEN '{lab}'" for b, lab in zip(LEVEL_BOUNDS, labels))
    return f"CASE WHEN {expr} IS NULL THEN '{null_value}' {whens} ELSE '{labels[-1]}' END"


ORACLE["alerts"] = with_views(f"""
SELECT location_id, datetime, aqi, quality,
       CASE WHEN aqi > 200 THEN 'danger' WHEN aqi > 150 THEN 'warning' END AS severity,
       {_level_sql('aqi', COLORS, NO_COLOR)} AS color,
       {_level_sql('aqi', SHORT_LABELS, NO_LABEL)} AS level,
       CASE WHEN pm25 < 50 THEN 'Tốt' WHEN pm25 > 150 THEN 'Nguy hại'
            WHEN pm25 IS NOT NULL THEN 'Trung bình' END AS pm25_status,
       printf('Station %d: AQI %d (%s)', location_id, aqi, quality) AS message
FROM history WHERE aqi > 150""", "history")

ORACLE["dashboard_means"] = with_views("""
SELECT round(avg(aqi), 6) AS avg_aqi, round(avg(pm25), 6) AS avg_pm25,
       round(avg(pm10), 6) AS avg_pm10, round(avg(temperature), 6) AS avg_temperature
FROM history""", "history")

_D = "coalesce(CASE WHEN isnan({c}) THEN NULL ELSE {c} END, 0.0E0)"
ORACLE["pm_ratio"] = _with_latest(f"""
SELECT location_id, pm25, pm10,
       CASE WHEN {_D.format(c='pm10')} = 0 THEN NULL
            WHEN {_D.format(c='pm10')} > 0
            THEN CAST(trunc({_D.format(c='pm25')} / {_D.format(c='pm10')} * 100) AS INTEGER)
            ELSE 0 END AS pm25_share_pct,
       greatest(0.0E0, {_D.format(c='pm10')} - {_D.format(c='pm25')}) AS coarse_pm,
       {_level_sql('aqi', COLORS, NO_COLOR)} AS color,
       {_level_sql('aqi', SHORT_LABELS, NO_LABEL)} AS level
FROM latest""")

ORACLE["window_aqi"] = with_views("""
SELECT make_timestamp(CAST((floor(epoch(event_ts) / 21600) * 21600) * 1000000 AS BIGINT)) AS window_start,
       make_timestamp(CAST((floor(epoch(event_ts) / 21600) * 21600 + 21600) * 1000000 AS BIGINT)) AS window_end,
       location_id, count(*) AS n, round(avg(aqi), 6) AS avg_aqi, max(aqi) AS max_aqi
FROM history GROUP BY 1, 2, 3""", "history")

ORACLE["window_aqi_sliding"] = with_views("""
SELECT make_timestamp(CAST((ws) * 1000000 AS BIGINT)) AS window_start, make_timestamp(CAST((ws + 7200) * 1000000 AS BIGINT)) AS window_end,
       location_id, count(*) AS n, round(avg(aqi), 6) AS avg_aqi, max(aqi) AS max_aqi
FROM (SELECT *, floor(epoch(event_ts) / 3600) * 3600 - 3600 * k AS ws
      FROM history, (VALUES (0), (1)) t(k))
GROUP BY ws, location_id""", "history")

ORACLE["alert_edges"] = with_views("""
SELECT location_id, event_ts, datetime, aqi, severity, prev_severity FROM (
  SELECT *, lag(severity) OVER (PARTITION BY location_id ORDER BY event_ts, severity) AS prev_severity
  FROM (SELECT *, CASE WHEN aqi > 200 THEN 'danger' WHEN aqi > 150 THEN 'warning' END AS severity
        FROM history))
WHERE severity IS NOT NULL AND (prev_severity IS NULL OR prev_severity <> severity)""", "history")

ORACLE["multi_pollutant"] = with_views(f"""
SELECT location_id, datetime, aqi_pm25, aqi_pm10, aqi, {level_sql('aqi')} AS quality
FROM (SELECT *, greatest(coalesce(aqi_pm25, 0), coalesce(aqi_pm10, 0)) AS aqi
      FROM (SELECT *, {index_sql('pm25', 'pm25')} AS aqi_pm25,
                      {index_sql('pm10', 'pm10')} AS aqi_pm10
            FROM wide))""", "raw_long", extra={"wide": WIDE})

ORACLE["aqi_histogram"] = with_views("""
SELECT b.bin, round(mn + (b.bin - 1) * (mx - mn) / 50, 6) AS bin_lo,
       round(mn + b.bin * (mx - mn) / 50, 6) AS bin_hi, coalesce(h.count, 0) AS count
FROM (SELECT CAST(range AS INTEGER) AS bin FROM range(1, 51)) b
CROSS JOIN mm
LEFT JOIN (SELECT CAST(CASE WHEN mx = mn THEN 1
                   ELSE least(floor(50 * (aqi - mn) / (mx - mn)) + 1, 50) END AS INTEGER) AS bin,
                  count(*) AS count
           FROM history, mm WHERE aqi IS NOT NULL GROUP BY 1) h ON h.bin = b.bin""", "history",
                                     extra={"mm": "SELECT CAST(min(aqi) AS DOUBLE) AS mn, "
                                                  "CAST(max(aqi) AS DOUBLE) AS mx FROM history"})


ORACLE["aqi_score_continuous"] = with_views(f"""
SELECT location_id, datetime, {index_sql('pm25', 'pm25', True)} AS aqi_pm25,
       {index_sql('pm10', 'pm10', True)} AS aqi_pm10
FROM readings""", "readings")

ORACLE["clean_pivot_discovered"] = ORACLE["clean_pivot"]

_SNAP_WIDE = """
  SELECT r.location_id, make_timestamp(CAST((o.t0 + floor((epoch_us(r.event_ts) - o.t0) / 3600000000)
                                      * 3600000000) AS BIGINT)) AS datetime,
         avg(r.pm25) AS pm25, avg(r.pm10) AS pm10
  FROM readings r JOIN (SELECT location_id, min(epoch_us(event_ts)) AS t0 FROM readings
                        GROUP BY 1) o ON o.location_id = r.location_id
  GROUP BY 1, 2"""

ORACLE["densify_snap"] = with_views(f"""
SELECT location_id, g AS datetime, {_interp('pm25')}, {_interp('pm10')}
FROM (SELECT *, {_neighbours('pm25')}, {_neighbours('pm10')} FROM j)""", "readings", extra={
    "wide": _SNAP_WIDE,
    "bounds": "SELECT location_id, min(datetime) AS t0, max(datetime) AS t1 FROM wide GROUP BY 1",
    "grid": "SELECT location_id, unnest(generate_series(t0, t1, INTERVAL 1 HOUR)) AS g FROM bounds",
    "j": """SELECT grid.location_id, grid.g, w.pm25, w.pm10
            FROM grid LEFT JOIN wide w ON w.location_id = grid.location_id AND w.datetime = grid.g""",
})

ORACLE["history_station_lookup"] = with_views(f"""
SELECT {HIST_COLS} FROM history WHERE location_id = 42""", "history")

ORACLE["stream_window"] = with_views("""
SELECT make_timestamp(CAST((floor(epoch(event_ts) / 21600) * 21600) * 1000000 AS BIGINT)) AS window_start,
       make_timestamp(CAST((floor(epoch(event_ts) / 21600) * 21600 + 21600) * 1000000 AS BIGINT)) AS window_end,
       location_id, count(*) AS n, round(avg(aqi), 6) AS avg_aqi, max(aqi) AS max_aqi
FROM s GROUP BY 1, 2, 3
HAVING make_timestamp(CAST((floor(epoch(min(event_ts)) / 21600) * 21600 + 21600) * 1000000 AS BIGINT))
       <= (SELECT max(event_ts) FROM s) - INTERVAL 10 MINUTE""",
                                     "readings", extra={"f32": _F32, "s": _F32_SCORED})

ORACLE["alerts_latest_only"] = _with_latest("""
SELECT location_id, datetime, aqi, 'danger' AS severity FROM latest WHERE aqi > 200""")

ORACLE["sql_station_summary"] = with_views("""
SELECT location_id, count(*) AS n, round(avg(aqi), 6) AS avg_aqi, max(aqi) AS max_aqi,
       round(count(*) FILTER (WHERE aqi > 150) / count(*), 6) AS share_unhealthy,
       arg_max(quality, event_ts) AS latest_quality
FROM history GROUP BY location_id""", "history")

ORACLE["stream_history_append"] = with_views("""
SELECT datetime, location_id, event_ts, pm25, pm10, aqi, quality FROM s""",
                                             "readings", extra={"f32": _F32, "s": _F32_SCORED})

ORACLE["grid_left_join"] = with_views("""
SELECT grid.location_id, grid.g AS datetime, round(w.pm25, 6) AS pm25, round(w.pm10, 6) AS pm10
FROM grid LEFT JOIN wide w ON w.location_id = grid.location_id AND w.datetime = grid.g""",
                                      "raw_long", extra={
    "wide": WIDE,
    "bounds": "SELECT location_id, min(datetime) AS t0, max(datetime) AS t1 FROM wide GROUP BY 1",
    "grid": "SELECT location_id, unnest(generate_series(t0, t1, INTERVAL 1 HOUR)) AS g FROM bounds",
})

ORACLE["aqi_quantiles"] = with_views("""
SELECT q.name AS quantile, CAST(r.aqi AS INTEGER) AS aqi
FROM (VALUES ('p10', 0.1), ('p50', 0.5), ('p90', 0.9), ('p99', 0.99), ('max', 1.0)) q(name, p)
JOIN (SELECT aqi, row_number() OVER (ORDER BY aqi) - 1 AS rk, count(*) OVER () AS n FROM history) r
  ON r.rk = CAST(floor((r.n - 1) * CAST(q.p AS DOUBLE) + 0.5) AS BIGINT)""", "history")

ORACLE["densify_spread"] = ORACLE["densify_linear"]


def _draw(column: int) -> str:
    """The normal draw of one column: Box-Muller over two md5 hashes of the key."""
    u = [f"((CAST('0x' || substr(md5('42|{salt}|' || location_id || '|' || datetime), 1, 12) AS BIGINT)) + 0.5E0) / 281474976710656.0E0"
         for salt in (2 * column, 2 * column + 1)]
    return f"sqrt(-2.0E0 * ln({u[0]})) * cos(2 * 3.141592653589793E0 * {u[1]})"


ORACLE["jitter"] = (f"SELECT location_id, datetime, {', '.join(f'round({c} * (1.0E0 + 0.02E0 * {_draw(i)}), 6) AS {c}' for i, c in enumerate(_DCOLS))} "
                    f"FROM ({ORACLE['densify_linear']})")

from haze.plans import stream_trips  # noqa: E402, F401
from haze.plans.round_trips import ROUND_TRIP_ORACLE  # noqa: E402

ORACLE |= ROUND_TRIP_ORACLE
