"""Dashboard-style summaries over scored rows (means, ratios, distributions,
alerts, display rows)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from haze.functions import aqi


def level_distribution(scored: DataFrame, label: str = "quality") -> DataFrame:
    """Rows, mean AQI and share per quality level.

    One partial+final hash aggregate on the label (six groups at most, so the
    map-side combine shrinks every task's output to <= 6 rows); the share is
    a window over that six-row result, never over the data.
    """
    per_level = scored.groupBy(label).agg(
        F.count(F.lit(1)).alias("n"),
        F.round(F.avg("aqi"), 6).alias("avg_aqi"),
        F.min("aqi").alias("min_aqi"),
        F.max("aqi").alias("max_aqi"),
    )
    total = F.sum("n").over(Window.partitionBy())
    return per_level.withColumn("share", F.round(F.col("n") / total, 6))


def means(df: DataFrame, columns=("aqi", "pm25", "pm10", "temperature")) -> DataFrame:
    """Mean of each listed column that exists (one partial+final aggregate)."""
    have = [c for c in columns if c in df.columns]
    return df.agg(*[F.avg(c).alias(f"avg_{c}") for c in have])


def ratios(df: DataFrame) -> DataFrame:
    """PM2.5 share of PM10 (truncated %) and the coarse remainder per row."""
    from haze.functions.values import coarse_remainder, pm25_share
    return df.withColumns({"pm25_share_pct": pm25_share("pm25", "pm10"),
                           "coarse_pm": coarse_remainder("pm25", "pm10")})


def alerts(df: DataFrame, threshold: int = aqi.SEVERITY_WARNING,
           latest_only: bool = False) -> DataFrame:
    """Rows above ``threshold`` with severity, level colour, raw PM2.5 status
    and a message; pushed-down filter first, then a narrow projection.
    ``latest_only`` looks at each station's newest row only (so a spike
    followed by a calmer reading is not reported), as the original job did."""
    if latest_only:
        from haze.operators.latest import latest_per_key
        df = latest_per_key(df)
    hot = df.where(F.col("aqi") > F.lit(threshold))
    return hot.select(
        "location_id", "datetime", "aqi", "quality",
        aqi.severity("aqi").alias("severity"),
        aqi.aqi_color("aqi").alias("color"),
        aqi.quality("aqi", "short").alias("level"),
        aqi.pm25_status("pm25").alias("pm25_status"),
        F.format_string("Station %d: AQI %d (%s)", "location_id", "aqi", "quality")
        .alias("message"))
