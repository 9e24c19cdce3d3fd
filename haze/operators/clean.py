"""Long -> wide cleaning: name normalisation, instant parsing, mean per key
and pivot on the parameter, schema alignment."""

from __future__ import annotations

import csv
from collections.abc import Iterable, Sequence
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from haze.functions.timefmt import parse_instant
from haze.schemas import PARAMETER_NAMES

# The four parameters the scoring job reads; pass them to keep only those.
WIDE_PARAMETERS = ["pm25", "pm10", "temperature", "relativehumidity"]
MAX_PARAMETERS = 1000


def strip_blank(c: Column) -> Column:
    """Strip all leading/trailing whitespace (tabs, newlines, unicode blanks)."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def clean_parameter(c: Column | str) -> Column:
    """Trim, lower-case, then map known spellings; unknown names pass through."""
    col = F.col(c) if isinstance(c, str) else c
    name = F.lower(strip_blank(col))
    mapping = F.create_map(*[F.lit(x) for kv in PARAMETER_NAMES.items() for x in kv])
    return F.coalesce(mapping[name], name)


def clean_long(df: DataFrame, datetime_col: str = "datetime", parameter_col: str = "parameter",
               ts_col: str = "ts", on_bad_datetime: str = "quarantine") -> DataFrame:
    """Parse the instant and normalise the parameter name.

    ``on_bad_datetime="quarantine"`` keeps unparseable rows with a null
    ``ts`` and ``bad_datetime = true`` so the caller can route them aside
    (``split_quarantine``); ``"drop"`` removes them; ``"fail"`` raises at the
    first bad row (ANSI ``to_timestamp``) like a strict parse.
    """
    raw = F.col(datetime_col)
    if on_bad_datetime == "fail":
        ts = F.to_timestamp(F.trim(raw))
    else:
        ts = parse_instant(raw)
    out = df.withColumns({ts_col: ts, parameter_col: clean_parameter(parameter_col)})
    if on_bad_datetime == "drop":
        return out.where(F.col(ts_col).isNotNull())
    if on_bad_datetime == "quarantine":
        return out.withColumn("bad_datetime", F.col(ts_col).isNull())
    return out


def split_quarantine(df: DataFrame, flag: str = "bad_datetime") -> tuple[DataFrame, DataFrame]:
    return df.where(~F.col(flag)).drop(flag), df.where(F.col(flag)).drop(flag)


def discover_parameters(df: DataFrame, parameter_col: str = "parameter") -> list[str]:
    """Distinct parameter names: a tiny set (one row per name reaches the
    driver).  More than ``MAX_PARAMETERS`` names means the column is not a
    parameter name at all, so we refuse instead of truncating."""
    rows = df.select(parameter_col).where(F.col(parameter_col).isNotNull()).distinct() \
        .orderBy(parameter_col).take(MAX_PARAMETERS + 1)
    if len(rows) > MAX_PARAMETERS:
        raise ValueError(f"more than {MAX_PARAMETERS} distinct parameters; pass them explicitly")
    return [r[0] for r in rows]


def pivot_mean(df: DataFrame, index: Sequence[str] = ("location_id", "datetime"),
               parameters: Iterable[str] | None = None,
               parameter_col: str = "parameter", value_col: str = "value") -> DataFrame:
    """Mean value per (index, parameter), pivoted to one column per parameter.

    Expressed as conditional averages in a single ``groupBy(index)``: one
    shuffle with map-side partial aggregation, instead of the two-phase
    aggregate (index+parameter, then index) that ``pivot().avg()`` plans.
    Nulls are ignored by ``avg``.  ``parameters=None`` (the default) takes every
    name that occurs (one extra pass over that column); a list keeps those.
    """
    names = list(parameters) if parameters is not None else discover_parameters(df, parameter_col)
    aggs = [F.avg(F.when(F.col(parameter_col) == F.lit(p), F.col(value_col))).alias(p)
            for p in names]
    return df.where(F.col(parameter_col).isin(names)).groupBy(*index).agg(*aggs)


def hourly_wide(long_df: DataFrame, parameters: Iterable[str] | None = None,
                ts_col: str = "ts", unit: str = "hour") -> DataFrame:
    """Clean parameter names, bucket time to ``unit``, pivot means."""
    df = long_df.withColumns({
        "parameter": clean_parameter("parameter"),
        "datetime": F.date_trunc(unit, F.col(ts_col)),
    })
    return pivot_mean(df, ("location_id", "datetime"), parameters)


def read_raw_readings(spark, path: str, schema: T.StructType | None = None) -> DataFrame:
    """Read raw long CSV (gzip allowed) by column NAME; cells that do not
    convert become null (``try_cast``), other columns are ignored and a
    missing one is null.  ``month=...`` folders become a partition column, so a
    filter on it prunes whole directories.

    Files under ``path`` may differ in the order of their columns: the header
    lines that occur are collected (one short row for each distinct header),
    and each group of files is read with its own header; ``enforceSchema=false``
    makes Spark compare it with every file it opens.  A gzip file is not
    splittable and is read by one task: keep files per station/month small
    upstream.  File names are URLs until here: blanks and other signs in them
    are decoded."""
    from haze.schemas import RAW_LONG_SCHEMA
    schema = schema or RAW_LONG_SCHEMA
    lines = spark.read.option("recursiveFileLookup", "false").text(path, wholetext=False) \
        .select(F.col("_metadata.file_path").alias("file"), "value", F.col("_metadata.file_block_start").alias("at"),
                F.monotonically_increasing_id().alias("line"))
    # The first line of a file is the first of its first block.
    heads = lines.where("at = 0").groupBy("file").agg(F.min_by("value", "line").alias("head"))
    groups = heads.groupBy("head").agg(F.collect_list("file").alias("files")).collect()
    out = None
    partitions = [c for c in spark.read.text(path).columns if c != "value"]
    for g in groups:
        names = next(csv.reader([g["head"].lstrip("\ufeff")]))
        # Spark does not accept a name twice; the first of equal names counts.
        unique = [n.strip() if n.strip() not in [m.strip() for m in names[:i]] else f"_again{i}"
                  for i, n in enumerate(names)]
        raw = T.StructType([T.StructField(n, T.StringType()) for n in unique])
        df = (spark.read.schema(raw).option("header", True).option("mode", "PERMISSIVE")
              .option("enforceSchema", unique != names)
              .option("basePath", _base_path(path)).csv([unquote(f) for f in g["files"]]))
        cols = [F.col(f"`{f.name}`").try_cast(f.dataType).alias(f.name) if f.name in df.columns
                else F.lit(None).cast(f.dataType).alias(f.name) for f in schema.fields]
        cols += [F.col(c) for c in partitions if c in df.columns and c not in schema.names]
        part = df.select(*cols)
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return out if out is not None else spark.createDataFrame([], schema)


def _base_path(path: str) -> str:
    """The folder below which ``key=value`` folders are partitions."""
    parts = path.rstrip("/").split("/")
    keep = next((i for i, p in enumerate(parts) if "=" in p or "*" in p or p.endswith((".csv", ".gz"))),
                len(parts))
    return "/".join(parts[:keep]) or "/"


def write_wide(df: DataFrame, path: str, time_col: str = "datetime",
               station_col: str = "location_id") -> None:
    """Snappy parquet, one folder per day, rows sorted by station and time
    inside each file.  Range-partitioning on (date, station, time) splits a
    big day -- and even one station's busy day -- across many tasks (a hash
    on date alone would put a whole day in one task).  The whole table is
    replaced: days of an earlier run do not stay."""
    (df.withColumn("date", F.to_date(time_col))
       .repartitionByRange("date", station_col, time_col)
       .sortWithinPartitions("date", station_col, time_col)
       .write.mode("overwrite").option("partitionOverwriteMode", "static")
       .option("compression", "snappy")
       .partitionBy("date").parquet(path))


def select_available(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Project the listed columns that exist, in the listed order."""
    have = set(df.columns)
    return df.select(*[c for c in columns if c in have])


def align_to_schema(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Add missing columns as typed nulls, cast present ones, order as the
    schema, drop extras.  Narrow projection, no shuffle.  Values that do not
    convert (e.g. ``'N/A'`` in a numeric column of an old table) become null
    instead of failing the job (``try_cast``)."""
    have = set(df.columns)
    cols = []
    for f in schema.fields:
        src = F.col(f.name).try_cast(f.dataType) if f.name in have \
            else F.lit(None).cast(f.dataType)
        cols.append(src.alias(f.name))
    return df.select(*cols)
