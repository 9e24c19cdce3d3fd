"""haze: air-quality analytics on Spark DataFrames and Structured Streaming.

The most used entry points, re-exported::

    from haze import score, densify, latest_per_key, latency_summary
"""

from haze.functions.aqi import aqi_pm10, aqi_pm25, overall, quality, register_sql_functions, score
from haze.operators.clean import clean_long, hourly_wide, pivot_mean, read_raw_readings
from haze.operators.densify import densify, forward_fill, jitter
from haze.operators.history import history_query, latest_history, upsert_history
from haze.operators.latest import fresh, latest_or_history, latest_per_key
from haze.operators.metrics import histogram, latency_samples, latency_summary
from haze.session import get_spark

__all__ = [
    "aqi_pm10", "aqi_pm25", "overall", "quality", "register_sql_functions", "score",
    "clean_long", "hourly_wide", "pivot_mean", "read_raw_readings",
    "densify", "forward_fill", "jitter",
    "history_query", "latest_history", "upsert_history",
    "fresh", "latest_or_history", "latest_per_key",
    "histogram", "latency_samples", "latency_summary",
    "get_spark",
]
