"""Views of the air-quality data model over the driver's parquet tables.

The ``events`` table is a long sensor feed: ``user_id`` is the station,
``ts`` the reading time, ``value`` a concentration and ``props`` a JSON
object with an integer ``k``.  Each view below is a narrow projection (no
shuffle), so filters and column pruning reach the parquet scan.  The same
definitions exist as SQL text in :mod:`haze.plans.oracle`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from haze.functions.aqi import score
from haze.functions.timefmt import ISO_MICROS

# Event type -> raw parameter spelling (two spellings of PM2.5,
# with stray blanks and mixed case, so cleaning must happen before grouping).
RAW_PARAMETER_BY_EVENT = {
    "click": " PM2.5 ",
    "error": "pm2_5",
    "view": "PM10",
    "signup": "Temperature",
    "purchase": " relativehumidity",
}

# PM10 = k * 6.5; latency = (k - 5) * 4 seconds.
PM10_PER_K = 6.5
LATENCY_K_OFFSET = 5
LATENCY_SECONDS_PER_K = 4

# Reference instants used by the metric views (deterministic "now").
LATENCY_AS_OF = "2024-01-31 00:00:00"
SNAPSHOT_AS_OF = "2024-01-30 23:00:00"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One driver table.  All instants in this library are UTC; the reading
    times are zone-less, so the session zone is pinned to UTC (a no-op on
    sessions built by :func:`haze.session.get_spark`)."""
    if spark.conf.get("spark.sql.session.timeZone") not in ("UTC", "Etc/UTC"):
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events")


def _k() -> F.Column:
    return F.col("k")


def _events_with_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``events`` plus ``k`` = ``$.k`` of ``props``, parsed once per row.

    The parse sits in a lateral view (a one-row ``inline``), not in a plain
    projection: when a filter on a score is pushed below the projections,
    Catalyst substitutes every alias into the condition, and a bracket
    expression references its input ~20 times -- with the parse inlined
    that meant ~20 JSON parses per row (7x slower, measured).  A generator's
    output is an attribute, so the substitution copies only ``k``.  Filters
    on ``ts`` still reach the parquet scan."""
    parsed = F.get_json_object("props", "$.k").try_cast("int")
    return _events(spark, sf_dir).select("*", F.inline(F.array(F.struct(parsed.alias("k")))))


def raw_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw long readings: location_id, ts, datetime (ISO text), parameter
    (dirty spelling), value."""
    mapping = F.create_map(*[F.lit(x) for kv in RAW_PARAMETER_BY_EVENT.items() for x in kv])
    ev = _events(spark, sf_dir)
    ts = F.col("ts").cast("timestamp")
    return ev.select(
        F.col("user_id").alias("location_id"),
        ts.alias("ts"),
        F.date_format(ts, ISO_MICROS).alias("datetime"),
        mapping[F.col("event_type")].alias("parameter"),
        F.col("value"),
    )


def _reading_columns() -> list[F.Column]:
    ts = F.col("ts").cast("timestamp")
    nul = F.lit(None).cast("double")
    return [
        F.col("user_id").alias("location_id"),
        ts.alias("event_ts"),
        F.date_format(ts, ISO_MICROS).alias("datetime"),
        F.col("value").alias("pm25"),
        (_k().cast("double") * F.lit(PM10_PER_K)).alias("pm10"),
        nul.alias("pm1"),
        nul.alias("temperature"),
        nul.alias("relativehumidity"),
        nul.alias("um003"),
    ]


def readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One reading per event: pm25 = value, pm10 = k * 6.5, other measures
    absent (typed nulls)."""
    return _events_with_k(spark, sf_dir).select(*_reading_columns())


def _processed_at(ts: F.Column) -> F.Column:
    secs = (_k() - F.lit(LATENCY_K_OFFSET)) * F.lit(LATENCY_SECONDS_PER_K)
    return ts + F.make_dt_interval(secs=secs.cast("decimal(18,6)"))


def latency_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """History-like rows with ``datetime`` text and ``processed_at``: the input
    of the latency analysis (processed_at = ts + (k - 5) * 4 s)."""
    ev = _events_with_k(spark, sf_dir)
    ts = F.col("ts").cast("timestamp")
    return ev.select(
        F.col("user_id").alias("location_id"),
        ts.alias("event_time"),
        F.date_format(ts, ISO_MICROS).alias("datetime"),
        _processed_at(ts).alias("processed_at"),
    )


def history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scored history rows: readings + sub-indices + label + processed_at,
    one narrow projection over ``events`` (no join, no shuffle)."""
    ev = _events_with_k(spark, sf_dir)
    rows = ev.select(*_reading_columns(),
                     _processed_at(F.col("ts").cast("timestamp")).alias("processed_at"))
    return score(rows)
