"""SQL surface: register the data-model views and the scoring functions so
SQL users query the same objects the DataFrame API builds."""

from __future__ import annotations

from pyspark.sql import SparkSession

from haze.functions.aqi import register_sql_functions
from haze.operators.clean import hourly_wide
from haze.sources import tables


def register_views(spark: SparkSession, sf_dir: str, prefix: str = "aq_") -> list[str]:
    """Temp views ``aq_readings``, ``aq_raw_long``, ``aq_history``,
    ``aq_latency_source`` and ``aq_wide`` over the tables in ``sf_dir``, plus
    the SQL functions ``aqi_pm25``, ``aqi_pm10``, ``aqi_overall`` and
    ``aqi_quality``.  Views are lazy plans: nothing is read here."""
    views = {
        "readings": tables.readings(spark, sf_dir),
        "raw_long": tables.raw_long(spark, sf_dir),
        "history": tables.history(spark, sf_dir),
        "latency_source": tables.latency_source(spark, sf_dir),
        "wide": hourly_wide(tables.raw_long(spark, sf_dir)),
    }
    for name, df in views.items():
        df.createOrReplaceTempView(prefix + name)
    register_sql_functions(spark)
    return [prefix + n for n in views]
