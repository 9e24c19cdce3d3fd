"""Scoring against a user-supplied breakpoint table (range join)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from haze.functions.aqi import STANDARDS, Standard

# A breakpoint table is a handful of rows per pollutant; refuse to broadcast
# anything that is not obviously a lookup table.
MAX_BREAKPOINT_ROWS = 10_000


def breakpoint_frame(spark: SparkSession, standards: dict[str, Standard] | None = None) -> DataFrame:
    """The bracket tables as a DataFrame: pollutant, c_low, c_high, i_low,
    i_high, cap_above, index_cap."""
    rows = []
    for name, std in (standards or STANDARDS).items():
        for b in std.brackets:
            rows.append((name, float(b.c_low), float(b.c_high), int(b.i_low), int(b.i_high),
                         float(std.cap_above), int(std.index_cap)))
    return spark.createDataFrame(
        rows, "pollutant string, c_low double, c_high double, i_low int, i_high int, "
              "cap_above double, index_cap int")


def score_by_table(df: DataFrame, value_col: str, pollutant: str, breakpoints: DataFrame,
                   out_col: str | None = None, id_cols: list[str] | None = None) -> DataFrame:
    """Sub-index of ``value_col`` by a range join against ``breakpoints``.

    The bracket rows for ``pollutant`` are size-checked and broadcast, so the
    join runs as a BroadcastNestedLoopJoin (LeftOuter) over the readings: no
    shuffle of the big side, ~7 comparisons per row.  A reading matching no
    bracket keeps its row and scores the cap above ``cap_above``, else 0;
    NaN and null score 0.
    """
    out_col = out_col or f"aqi_{pollutant}"
    bp = breakpoints.where(F.col("pollutant") == pollutant).drop("pollutant")
    cap = bp.agg(F.count(F.lit(1)).alias("_n"), F.max("cap_above").alias("_cap"),
                 F.max("index_cap").alias("_icap")).first()
    if cap["_n"] > MAX_BREAKPOINT_ROWS:
        raise ValueError(f"breakpoint table has {cap['_n']} rows for {pollutant}; "
                         "not a lookup table")
    x = F.col(value_col).cast("double")
    joined = df.join(F.broadcast(bp),
                     (~F.isnan(x)) & x.between(F.col("c_low"), F.col("c_high")), "left")
    # try_divide: a degenerate user bracket (c_low = c_high) scores null
    # instead of failing the job with an ANSI division by zero.
    slope = F.try_divide(F.col("i_high") - F.col("i_low"), F.col("c_high") - F.col("c_low"))
    idx = F.rint(slope * (x - F.col("c_low")) + F.col("i_low")).cast("int")
    value = (F.when(x.isNull() | F.isnan(x), F.lit(0))
             .when(F.col("c_low").isNotNull(), idx)
             .when(x > F.lit(cap["_cap"]), F.lit(cap["_icap"]))
             .otherwise(F.lit(0)))
    return joined.withColumn(out_col, value).drop(*bp.columns)
