"""Streams with per-station state, late rows, live rules and pushed changes, each run over several
deliveries with restarts from one checkpoint, with the DuckDB SQL of their result beside them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from haze.plans.oracle import with_views
from haze.plans.round_trips import SPLIT, _scratch, query
from haze.sources import tables

_ENTRY = ["location_id", "event_ts", "datetime", "aqi", "quality", "processed_at"]
#: An instant after all readings: a message with it moves the watermark past them.
LAST = "TIMESTAMP '2024-06-01 00:00:00'"


def _deliver(rows: DataFrame, root: str, n: int) -> None:
    """One more delivery into the stream's folder, a file for each of its partitions."""
    rows.write.parquet(f"{root}/in/d={n}")


def _delivered(spark: SparkSession, root: str, schema, delay: str) -> DataFrame:
    """The stream of all deliveries so far; their folder is no column of the rows."""
    stream = spark.readStream.schema(schema).parquet(f"{root}/in/*")
    return stream.withWatermark("event_ts", delay)


# ------------------------------------------------------------- expiring snapshot

@query("stream_snapshot_expiry", with_views("""
SELECT location_id, event_ts, datetime, aqi, quality, processed_at,
       (epoch_us(event_ts) + 999) // 1000 + 3600000 <= (SELECT max(epoch_us(event_ts)) // 1000 - 600000 FROM history) AS expired
FROM (SELECT *, row_number() OVER (PARTITION BY location_id ORDER BY event_ts DESC, datetime DESC, processed_at DESC) AS rn FROM history)
WHERE rn = 1""", "history"))
def stream_snapshot_expiry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Latest reading per station and whether its hour is over, after two deliveries and a restart.
    The second delivery repeats old readings: they are behind the watermark and revive nothing."""
    from haze.streaming.job import batch_writer, run_to_completion
    from haze.streaming.state import expiring_snapshot, present_state, rocksdb_state
    root = _scratch(spark, "expiry")
    hist = tables.history(spark, sf_dir).select(*_ENTRY)
    early = F.col("event_ts") < F.expr(SPLIT)
    old = hist.where(F.col("event_ts") < F.expr(SPLIT) - F.expr("INTERVAL 5 DAYS"))
    for n, rows in enumerate((hist.where(early), hist.where(~early).unionByName(old.withColumn("aqi", F.lit(-1))))):
        _deliver(rows, root, n)
        stream = expiring_snapshot(_delivered(spark, root, hist.schema, "10 minutes"), ["aqi", "quality"])
        with rocksdb_state(spark):
            run_to_completion(stream, f"{root}/ckpt", mode="update", sink=batch_writer(spark, f"{root}/changes"))
    return present_state(spark.read.parquet(f"{root}/changes")).select(*_ENTRY, "expired")


# ------------------------------------------------------------- alerts

@query("stream_alert_edges", with_views("""
SELECT location_id, event_ts, datetime, aqi, severity FROM (
  SELECT *, lag(severity) OVER (PARTITION BY location_id ORDER BY event_ts, severity NULLS FIRST) AS prev_severity
  FROM (SELECT *, CASE WHEN aqi > 200 THEN 'danger' WHEN aqi > 150 THEN 'warning' END AS severity FROM history))
WHERE severity IS NOT NULL AND (prev_severity IS NULL OR prev_severity <> severity)""", "history"))
def stream_alert_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries into an alert level; two deliveries whose readings interleave, a restart between
    them, and a last message that moves the watermark past all readings."""
    from haze.operators.windows import apply_rules, rules_frame
    from haze.streaming.job import run_to_completion
    from haze.streaming.state import rocksdb_state, stream_edges
    root = _scratch(spark, "edges")
    hist = tables.history(spark, sf_dir).select("location_id", "event_ts", "datetime", "aqi")
    odd = F.pmod(F.xxhash64("datetime"), F.lit(2)) == 1
    end = hist.limit(1).withColumns({"location_id": F.lit(-1).cast("long"), "event_ts": F.expr(LAST), "aqi": F.lit(0)})
    for n, rows in enumerate((hist.where(odd), hist.where(~odd), end)):
        _deliver(rows, root, n)
        judged = apply_rules(_delivered(spark, root, hist.schema, "31 days"), rules_frame(spark))
        with rocksdb_state(spark):
            run_to_completion(stream_edges(judged), f"{root}/ckpt", path=f"{root}/edges")
    return spark.read.parquet(f"{root}/edges")


@query("stream_live_rules", with_views(f"""
SELECT location_id, datetime, event_ts, aqi, severity FROM (
  SELECT *, CASE WHEN event_ts < {SPLIT} THEN CASE WHEN aqi > 200 THEN 'danger' WHEN aqi > 150 THEN 'warning' END
                 ELSE CASE WHEN pm10 >= 320 THEN 'coarse' WHEN pm25 < 2 THEN 'clean' WHEN aqi > 180 THEN 'danger' END END AS severity
  FROM history) WHERE severity IS NOT NULL""", "history"))
def stream_live_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rules table is replaced between two deliveries of one stream."""
    from haze.streaming.job import LiveRules, run_to_completion
    root = _scratch(spark, "live-rules")
    hist = tables.history(spark, sf_dir).select("location_id", "datetime", "event_ts", "aqi", "pm25", "pm10")
    early = F.col("event_ts") < F.expr(SPLIT)
    schema = "priority int, column string, op string, threshold double, severity string"
    tables_of_rules = ([(2, "aqi", ">", 150.0, "warning"), (1, "aqi", ">", 200.0, "danger")],
                       [(9, "aqi", ">", 180.0, "danger"), (2, "pm25", "<", 2.0, "clean"), (1, "pm10", ">=", 320.0, "coarse"),
                        (0, "no_such_column", ">", 0.0, "never"), (0, "aqi", "~", 0.0, "never")])
    for n, (rows, rules) in enumerate(zip((hist.where(early), hist.where(~early)), tables_of_rules)):
        spark.createDataFrame(rules, schema).write.mode("overwrite").parquet(f"{root}/rules")
        _deliver(rows, root, n)
        run_to_completion(_delivered(spark, root, hist.schema, "10 minutes"), f"{root}/ckpt",
                          sink=LiveRules(spark, f"{root}/rules", f"{root}/alerts"))
    return spark.read.parquet(f"{root}/alerts").select("location_id", "datetime", "event_ts", "aqi", "severity")


# ------------------------------------------------------------- late rows

@query("stream_late_split", with_views(f"""
SELECT location_id, datetime, event_ts, aqi,
       event_ts >= {SPLIT} - INTERVAL 3 DAY AND event_ts < {SPLIT}
         AND event_ts < (SELECT max(event_ts) FROM history WHERE event_ts < {SPLIT} - INTERVAL 3 DAY OR event_ts >= {SPLIT}) - INTERVAL 10 MINUTE AS late
FROM history""", "history"))
def stream_late_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three days of readings arrive after all others: they are kept apart, none is lost."""
    from haze.streaming.job import LateSplit, run_to_completion
    root = _scratch(spark, "late")
    hist = tables.history(spark, sf_dir).select("location_id", "datetime", "event_ts", "aqi")
    behind = (F.col("event_ts") >= F.expr(SPLIT) - F.expr("INTERVAL 3 DAYS")) & (F.col("event_ts") < F.expr(SPLIT))
    for n, rows in enumerate((hist.where(~behind), hist.where(behind))):
        _deliver(rows, root, n)
        run_to_completion(_delivered(spark, root, hist.schema, "10 minutes"), f"{root}/ckpt",
                          sink=LateSplit(spark, f"{root}/rows"))
    return LateSplit(spark, f"{root}/rows").rows().select("location_id", "datetime", "event_ts", "aqi", "late")


# ------------------------------------------------------------- pushed changes

@query("stream_snapshot_deltas", with_views("""
SELECT location_id, event_ts, datetime, aqi, quality, processed_at
FROM (SELECT *, row_number() OVER (PARTITION BY location_id ORDER BY event_ts DESC, datetime DESC, processed_at DESC) AS rn FROM history)
WHERE rn = 1 AND processed_at > (SELECT max(processed_at) FROM (
  SELECT processed_at, row_number() OVER (PARTITION BY location_id ORDER BY event_ts DESC, datetime DESC, processed_at DESC) AS rn FROM history)
  WHERE rn = 1) - INTERVAL 86400 SECOND""", "history"))
def stream_snapshot_deltas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Changes pushed after each of three deliveries; replayed they give the snapshot of a day."""
    from haze.operators.latest import replay_deltas
    from haze.streaming.job import DeltaPush, run_to_completion
    root = _scratch(spark, "deltas")
    hist = tables.history(spark, sf_dir).select(*_ENTRY)
    third = F.pmod(F.xxhash64("datetime"), F.lit(3))
    early = F.col("event_ts") < F.expr(SPLIT)
    for n, rows in enumerate((hist.where(early), hist.where(~early & (third == 0)), hist.where(~early & (third != 0)))):
        _deliver(rows, root, n)
        run_to_completion(_delivered(spark, root, hist.schema, "10 minutes"), f"{root}/ckpt",
                          sink=DeltaPush(spark, f"{root}/snapshot", f"{root}/deltas", ttl_seconds=86400, shards=4))
    return replay_deltas(spark.read.parquet(f"{root}/deltas").drop("query_id")).select(*_ENTRY)
