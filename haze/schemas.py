"""Schemas and column lists of the data model (raw, wide, event, history,
snapshot, latency)."""

from __future__ import annotations

from pyspark.sql import types as T

# Value columns that the reading event and the history row carry, in order.
MEASURES = ["pm25", "pm10", "pm1", "temperature", "relativehumidity", "um003"]

# Parameter spellings found in raw feeds and the column each
# one maps to.  Names not listed pass through unchanged.
PARAMETER_NAMES = {
    "pm2.5": "pm25",
    "pm2_5": "pm25",
    "pm1": "pm1",
    "pm10": "pm10",
    "relativehumidity": "relativehumidity",
    "temperature": "temperature",
    "co": "co",
    "o3": "o3",
    "so2": "so2",
    "no2": "no2",
    "um003": "um003",
}

# Raw long readings (CSV): one row per station x time x parameter.
RAW_LONG_SCHEMA = T.StructType([
    T.StructField("location_id", T.LongType()),
    T.StructField("datetime", T.StringType()),
    T.StructField("parameter", T.StringType()),
    T.StructField("value", T.DoubleType()),
    T.StructField("lat", T.DoubleType()),
    T.StructField("lon", T.DoubleType()),
])

# Reading event as it travels on the message bus (JSON).  Measures are
# float32 on purpose: the scoring compares the widened double (see aqi.py).
EVENT_SCHEMA = T.StructType(
    [T.StructField("datetime", T.StringType()), T.StructField("location_id", T.LongType())]
    + [T.StructField(m, T.FloatType()) for m in MEASURES]
)

# The 13 columns of a scored history row, in table order.
HISTORY_COLUMNS = [
    "datetime", "location_id", *MEASURES,
    "aqi", "aqi_pm25", "aqi_pm10", "quality", "processed_at",
]

HISTORY_SCHEMA = T.StructType(
    [T.StructField("datetime", T.StringType()), T.StructField("location_id", T.LongType())]
    + [T.StructField(m, T.FloatType()) for m in MEASURES]
    + [
        T.StructField("aqi", T.IntegerType()),
        T.StructField("aqi_pm25", T.IntegerType()),
        T.StructField("aqi_pm10", T.IntegerType()),
        T.StructField("quality", T.StringType()),
        T.StructField("processed_at", T.TimestampType()),
    ]
)

# Fields of the latest-per-station key/value snapshot, all strings.
SNAPSHOT_FIELDS = [
    "aqi", "quality", "timestamp", *MEASURES, "aqi_pm25", "aqi_pm10", "processed_at",
]

LATENCY_SCHEMA = T.StructType([
    T.StructField("event_time", T.TimestampType()),
    T.StructField("processed_at", T.TimestampType()),
    T.StructField("latency", T.DoubleType()),
])
