"""Queries that write tables, streams or files to the scratch folder and read them back, and
queries on spoiled input, each with its DuckDB SQL beside it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from haze.functions import aqi
from haze.plans.oracle import index_sql, level_sql, with_views
from haze.sources import tables

ROUND_TRIPS: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ROUND_TRIP_ORACLE: dict[str, str] = {}

COLUMNS = ["datetime", "location_id", "event_ts", "pm25", "pm10", "aqi", "aqi_pm25", "aqi_pm10",
           "quality", "processed_at"]
MEASURES = "pm25, pm10, temperature, relativehumidity"
SPLIT = "TIMESTAMP '2024-01-16 00:00:00'"


def query(name: str, sql: str):
    def deco(fn):
        ROUND_TRIPS[name] = fn
        ROUND_TRIP_ORACLE[name] = sql
        return fn
    return deco


def _scratch(spark: SparkSession, name: str) -> str:
    from haze.session import scratch_path
    return scratch_path(spark, name)


def _later(df: DataFrame) -> DataFrame:
    return df.withColumn("processed_at", F.col("processed_at") + F.expr("INTERVAL 60 SECONDS"))


# ---------------------------------------------------------------- keyed history

_SPOILED = """
  SELECT * REPLACE (CASE WHEN location_id % 50 = 0 THEN 'at ' || datetime ELSE datetime END AS datetime,
                    CASE WHEN location_id % 50 <> 0 THEN event_ts END AS event_ts) FROM history"""


@query("upsert_bad_datetime", with_views(f"""
SELECT {', '.join(COLUMNS)} FROM (
  SELECT *, row_number() OVER (PARTITION BY location_id, datetime ORDER BY processed_at DESC) AS rn
  FROM (SELECT {', '.join(COLUMNS)} FROM spoiled
        UNION ALL SELECT {', '.join(COLUMNS[:-1])}, processed_at + INTERVAL 60 SECOND FROM spoiled
        WHERE pm10 < 325)) WHERE rn = 1""", "history", extra={"spoiled": _SPOILED}))
def upsert_bad_datetime(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two deliveries in which every 50th station sends datetimes that do not parse."""
    from haze.operators.history import read_history, upsert_history
    path = _scratch(spark, "upsert-bad")
    bad = F.col("location_id") % 50 == 0
    hist = tables.history(spark, sf_dir).withColumns({
        "datetime": F.when(bad, F.concat(F.lit("at "), "datetime")).otherwise(F.col("datetime")),
        "event_ts": F.when(~bad, F.col("event_ts"))})
    upsert_history(spark, hist, path)
    upsert_history(spark, _later(hist.where("pm10 < 325")), path)
    return read_history(spark, path, COLUMNS)


@query("upsert_new_column", with_views("""
SELECT datetime, location_id, event_ts, pm25,
       CASE WHEN pm10 < 325 THEN NULL ELSE quality END AS quality,
       CASE WHEN pm10 < 325 THEN pm25 * 2 END AS doubled
FROM (SELECT *, row_number() OVER (PARTITION BY location_id, datetime
                                   ORDER BY pm10 < 325 DESC, processed_at DESC) AS rn FROM history)
WHERE rn = 1""", "history"))
def upsert_new_column(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The second delivery has a new column and lacks an old one."""
    from haze.operators.history import read_history, upsert_history
    path = _scratch(spark, "upsert-column")
    hist = tables.history(spark, sf_dir)
    base = hist.select("datetime", "location_id", "event_ts", "pm25", "quality", "processed_at")
    upsert_history(spark, base, path)
    more = hist.where("pm10 < 325").select("datetime", "location_id", "event_ts", "pm25",
                                           (F.col("pm25") * 2).alias("doubled"), "processed_at")
    more = more.withColumn("processed_at", F.col("processed_at") + F.expr("INTERVAL 365 DAYS"))
    upsert_history(spark, more, path)
    return read_history(spark, path, ["datetime", "location_id", "event_ts", "pm25", "quality",
                                      "doubled"])


_WIDER = ["datetime", "location_id", "event_ts", "pm25", "aqi", "quality", "processed_at"]
_WIDER_SQL = """
SELECT datetime, CAST(location_id AS BIGINT) AS location_id, event_ts,
       CASE WHEN {later} THEN pm25 ELSE CAST(CAST(pm25 AS REAL) AS DOUBLE) END AS pm25,
       CASE WHEN {later} THEN 'aqi ' || aqi ELSE CAST(aqi AS VARCHAR) END AS aqi,
       CASE WHEN {later} THEN NULL ELSE quality END AS quality, processed_at FROM {rows}"""


def _types(hist: DataFrame, wide: bool) -> DataFrame:
    """The delivery of an early writer (int station, float measure, int index) or of a later one
    (long, double, text; no label)."""
    if wide:
        return hist.select("datetime", "location_id", "event_ts", "pm25",
                           F.concat(F.lit("aqi "), F.col("aqi").cast("string")).alias("aqi"),
                           F.lit(None).alias("quality"), "processed_at")
    return hist.select("datetime", F.col("location_id").cast("int").alias("location_id"), "event_ts",
                       F.col("pm25").cast("float").alias("pm25"), "aqi", "quality", "processed_at")


@query("append_wider_type", with_views(_WIDER_SQL.format(later="pm10 < 325", rows="history"), "history"))
def append_wider_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Appends of two writers whose types differ: int and long, float and double, int and text."""
    from haze.operators.history import append_history, read_history
    path = _scratch(spark, "append-wider")
    hist = tables.history(spark, sf_dir)
    append_history(_types(hist.where("not (pm10 < 325)"), False), path)
    append_history(_types(hist.where("pm10 < 325"), True), path)
    return read_history(spark, path, _WIDER)


@query("upsert_wider_type", with_views(_WIDER_SQL.format(later="pm10 < 325", rows="""(
  SELECT *, row_number() OVER (PARTITION BY location_id, datetime ORDER BY pm10 < 325 DESC, processed_at DESC) AS rn FROM history) WHERE rn = 1"""), "history"))
def upsert_wider_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole history of an early writer, then keyed deliveries of a later one: twice the days
    after the split, then the others, so partitions of both kinds of files lie side by side."""
    from haze.operators.history import read_history, upsert_history
    path = _scratch(spark, "upsert-wider")
    hist = tables.history(spark, sf_dir)
    upsert_history(spark, _types(hist, False), path)
    later = hist.where("pm10 < 325").withColumn("processed_at", F.col("processed_at") + F.expr("INTERVAL 365 DAYS"))
    early = F.col("event_ts") < F.expr(SPLIT)
    for rows in (later.where(~early), later.where(~early), later.where(early)):
        upsert_history(spark, _types(rows, True), path)
    out = read_history(spark, path, _WIDER)
    return out.withColumn("processed_at", F.when(F.col("aqi").startswith("aqi"), F.col("processed_at") - F.expr("INTERVAL 365 DAYS")).otherwise(F.col("processed_at")))


@query("history_append_read", with_views(f"SELECT {', '.join(COLUMNS)} FROM history", "history"))
def history_append_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two appends to the day-partitioned history, read back with its recorded schema."""
    from haze.operators.history import append_history, read_history
    path = _scratch(spark, "append")
    hist = tables.history(spark, sf_dir)
    early = F.col("event_ts") < F.expr(SPLIT)
    append_history(hist.where(early), path)
    append_history(hist.where(~early), path)
    return read_history(spark, path, COLUMNS)


@query("history_clustered_lookup", with_views(f"""
SELECT {', '.join(COLUMNS)} FROM history WHERE location_id % 30 = 7 AND quality = {level_sql('60')}
UNION ALL SELECT {', '.join(COLUMNS)} FROM history WHERE location_id = 11
UNION ALL SELECT {', '.join(COLUMNS)} FROM history WHERE quality = {level_sql('400')} AND event_ts >= {SPLIT}""", "history"))
def history_clustered_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lookups by station and by label over history laid out along a z-order curve."""
    from haze.operators.history import clustered_write, history_query, read_history
    path = _scratch(spark, "clustered")
    clustered_write(tables.history(spark, sf_dir), path)
    hist = read_history(spark, path)
    both = history_query(hist, quality=aqi.QUALITY_FULL[1]).where("location_id % 30 = 7")
    found = both.unionByName(history_query(hist, station=11)).unionByName(
        history_query(hist, quality=aqi.QUALITY_FULL[5], since="2024-01-16 00:00:00"))
    return found.select(*COLUMNS)


# ---------------------------------------------------------------- files

_RAW_HEADS = (["location_id", "sensors_id", "location", "datetime", "lat", "lon", "parameter", "units", "value"],
              ["units", "value", "parameter", "datetime", "note", "location_id"])


@query("csv_ingest", with_views("""
SELECT location_id, CAST(month AS INTEGER) AS month, ts AS datetime,
       avg(value) FILTER (WHERE parameter ILIKE '%2%5%') AS pm25, count(*) AS cells
FROM (SELECT *, CASE WHEN ts < TIMESTAMP '2024-01-16 00:00:00' THEN 1 ELSE 2 END AS month FROM raw_long)
GROUP BY 1, 2, 3""", "raw_long"))
def csv_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw readings as gzip CSV under ``month=``, each month with its own column order."""
    from haze.operators.clean import clean_long, read_raw_readings
    root = _scratch(spark, "csv")
    raw = tables.raw_long(spark, sf_dir).withColumns({c: F.lit(c) for c in (
        "sensors_id", "location", "lat", "lon", "units", "note")})
    early = F.col("ts") < F.expr(SPLIT)
    for month, (rows, head) in enumerate(zip((raw.where(early), raw.where(~early)), _RAW_HEADS), 1):
        rows.select(*head).write.option("header", True).option("compression", "gzip") \
            .csv(f"{root}/month={month}")
    read = clean_long(read_raw_readings(spark, root), on_bad_datetime="drop")
    return read.groupBy("location_id", F.col("month").cast("int").alias("month"),
                        F.col("ts").alias("datetime")).agg(
        F.avg(F.when(F.col("parameter") == "pm25", F.col("value"))).alias("pm25"),
        F.count("value").alias("cells"))


@query("clean_drop", with_views("""
SELECT location_id, ts, value FROM raw_long WHERE location_id % 50 <> 0""", "raw_long"))
def clean_drop(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Readings whose datetime does not parse are dropped on request."""
    from haze.operators.clean import clean_long
    raw = tables.raw_long(spark, sf_dir).drop("ts")
    bad = F.when(F.col("location_id") % 50 == 0, F.lit("yesterday")).otherwise(F.col("datetime"))
    return clean_long(raw.withColumn("datetime", bad), on_bad_datetime="drop").select(
        "location_id", "ts", "value")


@query("wide_table", with_views("""
SELECT location_id, datetime, pm25, pm10, CAST(datetime AS DATE) AS date FROM (
  SELECT location_id, ts AS datetime, avg(value) FILTER (WHERE parameter ILIKE '%2%5%') AS pm25,
         avg(value) FILTER (WHERE parameter ILIKE '%10%') AS pm10
  FROM raw_long GROUP BY 1, 2) WHERE datetime >= TIMESTAMP '2024-01-16 00:00:00'""", "raw_long"))
def wide_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The wide table written whole, then replaced by its later days: earlier days are gone."""
    from haze.operators.clean import clean_parameter, pivot_mean, write_wide
    path = _scratch(spark, "wide")
    raw = tables.raw_long(spark, sf_dir).drop("datetime").withColumnRenamed("ts", "datetime")
    raw = raw.withColumn("parameter", clean_parameter("parameter"))
    wide = pivot_mean(raw, parameters=["pm25", "pm10"], index=["location_id", "datetime"])
    both = raw.select("location_id", "datetime").distinct().join(wide, ["location_id", "datetime"], "left")
    write_wide(both, path)
    write_wide(both.where(F.col("datetime") >= F.expr(SPLIT)), path)
    return spark.read.parquet(path)


_SAMPLES = """
  SELECT *, epoch_us(processed_at) - epoch_us(event_time) AS us FROM latency_source
  WHERE event_time >= TIMESTAMP '2024-01-31 00:00:00' - INTERVAL 14400 MINUTE"""
_VALID = "SELECT * FROM s WHERE us >= 0 AND us < 300000000"


def _samples(spark, sf_dir):
    from haze.operators.metrics import latency_samples
    return latency_samples(tables.latency_source(spark, sf_dir), tables.LATENCY_AS_OF, 14400)


@query("latency_csv", with_views("""
SELECT event_time, processed_at, us / 1e6 AS latency FROM v""", "latency_source",
                                 extra={"s": _SAMPLES, "v": _VALID}))
def latency_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    from haze.operators.metrics import read_latency_csv, write_latency_csv
    path = _scratch(spark, "latency-csv")
    write_latency_csv(_samples(spark, sf_dir), path)
    return read_latency_csv(spark, path).select("event_time", "processed_at", "latency")


@query("latency_linear_quantiles", with_views("""
SELECT round(quantile_cont(us, 0.1), 3) AS p10, round(quantile_cont(us, 0.5), 3) AS p50,
       round(quantile_cont(us, 0.977), 3) AS p977 FROM v""", "latency_source",
                                              extra={"s": _SAMPLES, "v": _VALID}))
def latency_linear_quantiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    from haze.operators.metrics import linear_quantiles
    valid = _samples(spark, sf_dir).where("disposition = 'valid'")
    q = linear_quantiles(valid, "latency_us", {"p10": 0.1, "p50": 0.5, "p977": 0.977})
    return q.select(*[F.round(c, 3).alias(c) for c in q.columns])


@query("latency_series_null_station", with_views("""
SELECT CASE WHEN location_id % 10 <> 0 THEN location_id END AS location_id,
       row_number() OVER (PARTITION BY CASE WHEN location_id % 10 <> 0 THEN location_id END
                          ORDER BY event_time, processed_at) AS idx, event_time, processed_at
FROM v""", "latency_source", extra={"s": _SAMPLES, "v": _VALID}))
def latency_series_null_station(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every tenth station unknown: its samples are numbered as one series."""
    from haze.operators.metrics import latency_series
    some = _samples(spark, sf_dir).withColumn(
        "location_id", F.when(F.col("location_id") % 10 != 0, F.col("location_id")))
    return latency_series(some).drop("latency")


@query("end_offsets", """
SELECT CAST(sum(n) AS BIGINT) AS produced FROM (SELECT user_id % 7 AS p, count(*) AS n FROM events GROUP BY 1)""")
def end_offsets_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as messages of seven topic partitions: the offsets' ends add up to the rows."""
    from pyspark.sql import Window

    from haze.operators.metrics import end_offsets
    ev = tables.table(spark, sf_dir, "events")
    part = F.pmod("user_id", F.lit(7))
    offset = F.row_number().over(Window.partitionBy(part).orderBy("ts", "user_id")).cast("long") - 1
    return end_offsets(ev.select(part.alias("partition"), offset.alias("offset")))


@query("producer_rate", """
SELECT ordinal, ts AS event_ts, us / 1e6 AS elapsed, CASE WHEN us > 0 THEN ordinal / (us / 1e6) END AS rate FROM (
  SELECT row_number() OVER (ORDER BY ts, event_id) AS ordinal, ts, CAST(epoch_us(ts) - (SELECT min(epoch_us(ts)) FROM events) AS DOUBLE) AS us
  FROM events) WHERE ordinal % 1000 = 0""")
def producer_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages sent and their rate at every thousandth one."""
    from haze.operators.ordinal import running_rate
    ev = tables.table(spark, sf_dir, "events").withColumn("event_ts", F.col("ts").cast("timestamp"))
    return running_rate(ev, "event_ts", tie=["event_id"])


@query("file_order", with_views("""
SELECT 'latency by time' AS stored, count(*) AS rows, true AS ordered FROM v
UNION ALL SELECT 'latency as it came', count(*), false FROM v
UNION ALL SELECT 'history by station', (SELECT count(*) FROM latency_source), true
UNION ALL SELECT 'history by measure', (SELECT count(*) FROM latency_source), false""", "latency_source", extra={"s": _SAMPLES, "v": _VALID}))
def file_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files that must be in order are, as they lie; the same rows unsorted, and another column, are not."""
    from haze.operators.history import append_history
    from haze.operators.metrics import read_latency_csv, write_latency_csv
    from haze.operators.ordinal import order_report
    root = _scratch(spark, "order")
    samples = _samples(spark, sf_dir)
    write_latency_csv(samples, f"{root}/sorted")
    samples.where("disposition = 'valid'").select("event_time", "processed_at", "latency").orderBy(F.xxhash64("event_time")) \
        .write.option("header", True).csv(f"{root}/mixed")
    append_history(tables.history(spark, sf_dir), f"{root}/history")
    history = spark.read.parquet(f"{root}/history")
    reports = [("latency by time", order_report(read_latency_csv(spark, f"{root}/sorted"), ["event_time"])),
               ("latency as it came", order_report(read_latency_csv(spark, f"{root}/mixed"), ["event_time"])),
               ("history by station", order_report(history, ["location_id", "event_ts"], across_files=False)),
               ("history by measure", order_report(history, ["pm25"], across_files=False))]
    out = [r.select(F.lit(name).alias("stored"), "rows", "ordered") for name, r in reports]
    return out[0].unionByName(out[1]).unionByName(out[2]).unionByName(out[3])


# ---------------------------------------------------------------- series

_WIDE = """
  SELECT location_id, date_trunc('hour', ts) AS datetime,
         avg(value) FILTER (WHERE parameter ILIKE '%2%5%') AS pm25
  FROM raw_long GROUP BY 1, 2"""


def _pm25(spark, sf_dir):
    from haze.operators.clean import hourly_wide
    raw = tables.raw_long(spark, sf_dir)
    hours = raw.select("location_id", F.date_trunc("hour", "ts").alias("datetime")).distinct()
    return hours.join(hourly_wide(raw, ["pm25"]), ["location_id", "datetime"], "left")


@query("forward_fill_null_station", with_views("""
SELECT location_id, datetime, coalesce(pm25, last_value(pm25 IGNORE NULLS) OVER (
  PARTITION BY location_id ORDER BY datetime ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) AS pm25
FROM w""", "raw_long", extra={"wide": _WIDE, "w": """
  SELECT CASE WHEN location_id % 10 <> 0 THEN location_id END AS location_id,
         CASE WHEN location_id % 10 <> 0 THEN datetime ELSE datetime + to_microseconds(location_id) END AS datetime,
         pm25 FROM wide"""}))
def forward_fill_null_station(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every tenth station unknown (its readings a microsecond apart): one series, no row lost."""
    from haze.operators.densify import forward_fill
    known = F.col("location_id") % 10 != 0
    apart = F.timestamp_micros(F.unix_micros("datetime") + F.col("location_id"))
    rows = _pm25(spark, sf_dir).withColumn("datetime", F.when(known, F.col("datetime")).otherwise(apart))
    return forward_fill(rows.withColumn("location_id", F.when(known, F.col("location_id"))), ["pm25"])


@query("densify_duplicates", with_views("""
SELECT location_id, g AS datetime,
       CASE WHEN pt = g THEN pv WHEN pt IS NOT NULL AND nt IS NOT NULL
            THEN pv + (nv - pv) * (CAST(epoch_us(g) - epoch_us(pt) AS DOUBLE) / CAST(epoch_us(nt) - epoch_us(pt) AS DOUBLE)) END AS pm25
FROM (SELECT *, last_value(CASE WHEN pm25 IS NOT NULL THEN g END IGNORE NULLS) OVER p AS pt,
             last_value(pm25 IGNORE NULLS) OVER p AS pv,
             first_value(CASE WHEN pm25 IS NOT NULL THEN g END IGNORE NULLS) OVER n AS nt,
             first_value(pm25 IGNORE NULLS) OVER n AS nv FROM j
      WINDOW p AS (PARTITION BY location_id ORDER BY g ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
             n AS (PARTITION BY location_id ORDER BY g ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING))""",
                                        "raw_long", extra={
    "wide": _WIDE,
    "twice": """SELECT location_id, datetime, avg(pm25) AS pm25 FROM (
                  SELECT * FROM wide UNION ALL SELECT location_id, datetime, pm25 + 2 FROM wide) GROUP BY 1, 2""",
    "grid": """SELECT location_id, unnest(generate_series(min(datetime), max(datetime), INTERVAL 1 HOUR)) AS g
               FROM wide GROUP BY 1""",
    "j": "SELECT grid.location_id, g, pm25 FROM grid LEFT JOIN twice t ON t.location_id = grid.location_id AND t.datetime = g"}))
def densify_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two readings at every instant: their mean goes onto the grid."""
    from haze.operators.densify import densify
    wide = _pm25(spark, sf_dir)
    return densify(wide.unionByName(wide.withColumn("pm25", F.col("pm25") + 2)), values=["pm25"],
                   step_seconds=3600, off_grid="drop")


@query("off_grid_rows", """
SELECT count(*) AS rows, count(*) FILTER (WHERE (epoch_us(ts) - t0) % 3600000000 = 0) AS on_grid,
       count(*) FILTER (WHERE (epoch_us(ts) - t0) % 3600000000 <> 0) AS off_grid, CAST(0 AS BIGINT) AS no_instant
FROM events e JOIN (SELECT user_id, min(epoch_us(ts)) AS t0 FROM events GROUP BY 1) o ON o.user_id = e.user_id""")
def off_grid_rows_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    from haze.operators.densify import off_grid_rows
    return off_grid_rows(tables.readings(spark, sf_dir), ts="event_ts", step_seconds=3600)


# ---------------------------------------------------------------- snapshot

_LATEST = """
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY location_id
                 ORDER BY event_ts DESC, datetime DESC, processed_at DESC) AS rn FROM history) WHERE rn = 1"""


@query("snapshot_read", with_views(f"""
SELECT {', '.join(COLUMNS)} FROM latest
WHERE processed_at > TIMESTAMP '{tables.SNAPSHOT_AS_OF}' - INTERVAL 3600 SECOND""", "history", extra={"latest": _LATEST}))
def snapshot_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Newer half, then older half into the stored snapshot; expired entries compacted out; read."""
    from haze.operators.latest import compact_snapshot, read_snapshot
    from haze.streaming.job import merge_snapshot
    path = _scratch(spark, "snapshot-read")
    hist = tables.history(spark, sf_dir)
    late = F.col("event_ts") >= F.expr(SPLIT)
    merge_snapshot(spark, hist.where(late), f"{path}/all", shards=5)
    merge_snapshot(spark, hist.where(~late), f"{path}/all", shards=9)
    compact_snapshot(spark, f"{path}/all", tables.SNAPSHOT_AS_OF, f"{path}/live")
    return read_snapshot(spark, f"{path}/live", tables.SNAPSHOT_AS_OF).select(*COLUMNS)


@query("snapshot_log", with_views(f"SELECT {', '.join(COLUMNS)} FROM latest", "history", extra={"latest": _LATEST}))
def snapshot_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four batches and one repeated, compacted into 4 and then 64 shards, and a small one after that."""
    from haze.operators.snapshot_log import SnapshotLog
    log = SnapshotLog(spark, _scratch(spark, "snapshot-log"))
    hist = tables.history(spark, sf_dir)
    part = F.pmod(F.xxhash64("datetime"), F.lit(4))
    log.append(hist.where(part == 2), 0)
    log.append(hist.where(part == 0), 1)
    log.compact(4)
    log.append(hist.where(part == 1), 2)
    log.append(hist.where(part == 1), 2)
    log.compact(64)
    log.append(hist.where((part == 3) & (F.col("location_id") % 2 == 0)), 3)
    log.append(hist.where((part == 3) & (F.col("location_id") % 2 != 0)), 4)
    return log.read().select(*COLUMNS)


_TEXT = "coalesce(CAST({} AS VARCHAR), '')"
_KV = ["aqi", "quality", "timestamp", "pm25", "pm10", "pm1", "temperature", "relativehumidity", "um003",
       "aqi_pm25", "aqi_pm10", "processed_at"]


@query("snapshot_kv_text", with_views(f"""
SELECT 'location:' || location_id AS key, CAST(coalesce(aqi, 0) AS VARCHAR) AS aqi, quality,
       datetime AS "timestamp", {', '.join(_TEXT.format(c) + ' AS ' + c for c in ('pm25', 'pm10', 'pm1', 'temperature', 'relativehumidity', 'um003', 'aqi_pm25', 'aqi_pm10'))},
       CASE WHEN microsecond(processed_at) % 1000000 = 0 THEN strftime(processed_at, '%Y-%m-%d %H:%M:%S')
            ELSE strftime(processed_at, '%Y-%m-%d %H:%M:%S.%f') END AS processed_at
FROM (SELECT * REPLACE (pm25 * scale AS pm25, pm10 * scale AS pm10) FROM (
        SELECT *, CASE location_id % 4 WHEN 0 THEN 1e-7 WHEN 1 THEN 1e5 WHEN 2 THEN 1e-5 ELSE 1e0 END AS scale FROM latest))""",
                                      "history", extra={"latest": _LATEST}))
def snapshot_kv_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The twelve texts of the key/value form, measures from very small to large."""
    from haze.operators.latest import latest_per_key, to_kv
    rows = latest_per_key(tables.history(spark, sf_dir))
    m = F.col("location_id") % 4
    scale = F.when(m == 0, 1e-7).when(m == 1, 1e5).when(m == 2, 1e-5).otherwise(1.0)
    kv = to_kv(rows.withColumns({c: F.col(c) * scale for c in ("pm25", "pm10")}))
    return kv.select("key", *[F.col("fields")[c].alias(c) for c in _KV])


# ---------------------------------------------------------------- streams

def _sent(spark, sf_dir) -> DataFrame:
    from haze.streaming.source import encode_readings
    return encode_readings(tables.readings(spark, sf_dir)).select("value", F.get_json_object("value", "$.location_id").cast("long").alias("station"))


@query("stream_quarantine", """
SELECT status, count(*) AS n FROM (
  SELECT DISTINCT user_id, ts, CASE user_id % 40 WHEN 0 THEN 'corrupt' WHEN 1 THEN 'partial' ELSE 'ok' END AS status
  FROM events) GROUP BY 1""")
def stream_quarantine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Some messages are no JSON, some have a field that does not convert: nothing is lost."""
    from haze.streaming.job import scoring_job
    from haze.streaming.source import readings_stream
    root = _scratch(spark, "quarantine")
    m = F.col("station") % 40
    text = F.when(m == 0, F.concat(F.lit("not json "), "value")).when(
        m == 1, F.regexp_replace("value", r'"pm25":[-0-9.eE]+', '"pm25":"much"')).otherwise(F.col("value"))
    _sent(spark, sf_dir).select(text.alias("value")).distinct().write.text(f"{root}/in")
    job = scoring_job(spark, readings_stream(spark, "text", f"{root}/in"), mode="dual", checkpoint=f"{root}/ckpt",
                      history_path=f"{root}/history", quarantine_path=f"{root}/bad", trigger={"availableNow": True})
    job.awaitTermination()
    good = spark.read.parquet(f"{root}/history").select(
        F.when(F.col("location_id") % 40 == 1, F.when(F.col("pm25").isNull(), "partial")).otherwise(F.lit("ok")).alias("status"))
    bad = spark.read.parquet(f"{root}/bad").select(F.lit("corrupt").alias("status"))
    return good.unionByName(bad).groupBy("status").agg(F.count(F.lit(1)).alias("n"))


@query("tail_lines", with_views("""
SELECT 'Received: ' || datetime || ' | PM2.5: ' || printf('%.2f', p) || ' -> ' ||
       CASE WHEN p < 50 THEN '🟢 Tốt' WHEN p > 150 THEN '🔴 Nguy hại' ELSE '🟡 Trung bình' END AS value
FROM (SELECT datetime, CASE location_id % 3 WHEN 0 THEN round(pm25 * 8) / 8 WHEN 1 THEN CAST(CAST(pm25 AS REAL) AS DOUBLE) ELSE coalesce(pm25, 0) END AS p FROM readings)""", "readings"))
def tail_lines_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tail reader's lines; eighths lie on ties of the second decimal."""
    from haze.streaming.source import tail_lines
    kind = F.col("location_id") % 3
    pm = F.when(kind == 0, F.round(F.col("pm25") * 8) / 8).when(kind == 1, F.col("pm25").cast("float").cast("double")).otherwise(F.col("pm25"))
    return tail_lines(tables.readings(spark, sf_dir).withColumn("pm25", pm))


_F32 = """
  SELECT location_id, event_ts, datetime, CAST(pm25 AS REAL) AS pm25, CAST(pm10 AS REAL) AS pm10 FROM readings"""


@query("stream_alerts", with_views(f"""
SELECT location_id, datetime, event_ts, aqi, {level_sql('aqi')} AS quality
FROM (SELECT *, greatest({index_sql('pm25', 'pm25')}, {index_sql('pm10', 'pm10')}) AS aqi FROM f32)
WHERE aqi > 200""", "readings", extra={"f32": _F32}))
def stream_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two deliveries, each under its own checkpoint: batch 0 of the second keeps the first's alerts."""
    from haze.streaming.job import scoring_job
    from haze.streaming.source import encode_readings, readings_stream
    root = _scratch(spark, "alerts")
    early = F.col("event_ts") < F.expr(SPLIT)
    for part, rows in enumerate((early, ~early)):
        encode_readings(tables.readings(spark, sf_dir).where(rows)).select("value").write.text(f"{root}/in{part}")
        job = scoring_job(spark, readings_stream(spark, "text", f"{root}/in{part}"), mode="dual",
                          checkpoint=f"{root}/ckpt{part}", history_path=f"{root}/history",
                          alerts_path=f"{root}/alerts", trigger={"availableNow": True})
        job.awaitTermination()
    return spark.read.parquet(f"{root}/alerts").select("location_id", "datetime", "event_ts", "aqi", "quality")


# ---------------------------------------------------------------- scoring

@query("score_null_policy", with_views(f"""
SELECT location_id, datetime, a AS aqi_pm25, b AS aqi_pm10, greatest(a, b) AS aqi,
       CASE WHEN greatest(a, b) IS NULL THEN 'N/A' ELSE {level_sql('greatest(a, b)')} END AS quality
FROM (SELECT location_id, datetime, {index_sql('p25', 'pm25', missing='NULL')} AS a,
             {index_sql('p10', 'pm10', missing='NULL')} AS b
      FROM (SELECT *, CASE WHEN location_id % 3 <> 0 THEN pm25 END AS p25,
                      CASE WHEN location_id % 2 <> 0 THEN pm10 END AS p10 FROM readings))""", "readings"))
def score_null_policy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Missing measures stay missing up to the label when asked for."""
    rows = tables.readings(spark, sf_dir).withColumns({
        "pm25": F.when(F.col("location_id") % 3 != 0, F.col("pm25")),
        "pm10": F.when(F.col("location_id") % 2 != 0, F.col("pm10"))})
    return aqi.score(rows, null_policy="null").select(
        "location_id", "datetime", "aqi_pm25", "aqi_pm10", "aqi", "quality")


#: A third table, given by the caller: index 0-100 over 0-400, 101-500 over 400.1-800.
_OWN = aqi.Standard("own", (aqi.Bracket(0.0, 400.0, 0, 100), aqi.Bracket(400.1, 800.0, 101, 500)), 800.0)


@query("three_pollutants", with_views(f"""
SELECT location_id, datetime, a AS aqi_pm25, b AS aqi_pm10, c AS aqi_both, greatest(a, b, c) AS aqi,
       {level_sql('greatest(a, b, c)')} AS quality
FROM (SELECT *, {index_sql('pm25', 'pm25')} AS a, {index_sql('pm10', 'pm10')} AS b,
             CASE WHEN s IS NULL THEN 0
                  WHEN s >= 0 AND s <= 400 THEN CAST(round_even((100 - 0) / (400.0E0 - 0.0E0) * (s - 0.0E0) + 0, 0) AS INTEGER)
                  WHEN s >= 400.1E0 AND s <= 800 THEN CAST(round_even((500 - 101) / (800.0E0 - 400.1E0) * (s - 400.1E0) + 101, 0) AS INTEGER)
                  WHEN s > 800 THEN 500 ELSE 0 END AS c
      FROM (SELECT *, pm25 + pm10 AS s FROM readings))""", "readings"))
def three_pollutants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two published tables and one of the caller's."""
    rows = tables.readings(spark, sf_dir).withColumn("both", F.col("pm25") + F.col("pm10"))
    scored = aqi.score_many(rows, {"pm25": aqi.PM25, "pm10": aqi.PM10, "both": _OWN})
    return scored.select("location_id", "datetime", "aqi_pm25", "aqi_pm10", "aqi_both", "aqi", "quality")
