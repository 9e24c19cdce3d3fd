"""Time parsing/formatting helpers (all instants are UTC, session TZ = UTC)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ISO_MICROS = "yyyy-MM-dd'T'HH:mm:ss.SSSSSSxxx"
ISO_SECONDS = "yyyy-MM-dd'T'HH:mm:ssxxx"
# Fixed value: the dashboard's display pattern and its null text.
DISPLAY = "HH:mm:ss dd/MM/yyyy"


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def parse_instant(c) -> Column:
    """Lenient instant parse: ISO-8601 with or without fraction, with ``+07:00``
    / ``+0700`` / ``Z`` offsets, and the ``yyyy-MM-dd HH:mm:ss`` form.  Text that
    matches nothing gives null instead of failing the job (ANSI-safe)."""
    return F.try_to_timestamp(F.trim(_col(c)))


def iso_format(c, always_fraction: bool = False) -> Column:
    """ISO-8601 text with offset.  Like Python's ``isoformat``, the fraction is
    omitted when the microseconds are zero unless ``always_fraction``."""
    ts = _col(c)
    if always_fraction:
        return F.date_format(ts, ISO_MICROS)
    return F.when(F.unix_micros(ts) % 1_000_000 == 0, F.date_format(ts, ISO_SECONDS)) \
        .otherwise(F.date_format(ts, ISO_MICROS))


def display_time(c) -> Column:
    """``HH:mm:ss dd/MM/yyyy``, ``N/A`` when missing."""
    return F.coalesce(F.date_format(_col(c), DISPLAY), F.lit("N/A"))


def seconds_between(later, earlier) -> Column:
    """Exact seconds (double) between two instants, microsecond precision."""
    return (F.unix_micros(_col(later)) - F.unix_micros(_col(earlier))) / F.lit(1e6)
