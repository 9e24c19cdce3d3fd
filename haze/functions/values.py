"""Small value helpers used by serving/dashboard code (all native)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def default_if_missing(c, default: float = 0.0) -> Column:
    """Null or NaN -> ``default``."""
    x = _col(c).cast("double")
    return F.coalesce(F.nanvl(x, F.lit(None).cast("double")), F.lit(float(default)))


def falsy_to_null(c) -> Column:
    """0 / 0.0 -> null (the history reader's compatibility behaviour)."""
    x = _col(c)
    return F.nullif(x, F.lit(0))


def pm25_share(pm25, pm10) -> Column:
    """PM2.5 as a truncated percentage of PM10; null when PM10 is 0 or
    missing, 0 when PM10 is negative."""
    a = default_if_missing(pm25)
    b = default_if_missing(pm10)
    return (F.when(b == 0, F.lit(None).cast("int"))
            .when(b > 0, (a / b * F.lit(100)).try_cast("int"))
            .otherwise(F.lit(0)))


def coarse_remainder(pm25, pm10) -> Column:
    """``max(0, pm10 - pm25)`` with missing values counted as 0."""
    return F.greatest(F.lit(0.0), default_if_missing(pm10) - default_if_missing(pm25))


def two_decimals(c: Column) -> Column:
    """Text of a double with two decimals, rounded as printed by C and Python: to the nearest of
    the exact binary value, a tie to the even digit (``format_string`` rounds the shortest decimal
    text, half up: 2.675 and 0.125 differ).  Exact below 1e13 in size.

    The value is split into a part of 24 bits and the rest: both times 100 are exact, and so are
    the signs of the sums that decide."""
    x = F.abs(c.cast("double"))
    high = x.cast("float").cast("double")
    parts = [high * 100, (x - high) * 100]
    a, b = (p - F.floor(p).cast("double") for p in parts)
    carry = F.when((a - 1) + b >= 0, 1.0).otherwise(0.0)
    base = F.floor(parts[0]).cast("double") + F.floor(parts[1]).cast("double") + carry
    over = (a - 0.5 - carry) + b
    up = (over > 0) | ((over == 0) & (base % 2 == 1))
    n = (base + F.when(up, 1).otherwise(0)).cast("long")
    text = F.concat(F.call_function("div", n, F.lit(100).cast("long")).cast("string"), F.lit("."),
                    F.lpad((n % 100).cast("string"), 2, "0"))
    odd = F.when(F.isnan(c.cast("double")), "nan").when(x == float("inf"), "inf").otherwise(text)
    minus = (c.cast("double") < 0) | (F.substring(c.cast("double").cast("string"), 1, 1) == "-")
    return F.when(minus, F.concat(F.lit("-"), odd)).otherwise(odd)
