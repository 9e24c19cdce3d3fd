"""Positions in a total order, without one task that sees all rows: numbering and order checks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: ``monotonically_increasing_id`` holds the partition above this many bits and the row below.
_ROW_BITS = 33


def global_ordinal(df: DataFrame, order: Sequence[str], out_col: str = "ordinal",
                   partitions: int | None = None) -> DataFrame:
    """``df`` with each row's position (from 1) in the order of ``order`` (nulls first).

    One range shuffle on all of ``order`` deals the rows into slices of about equal size: a
    tie on the first column is split by the next ones.  Rows are numbered inside their slice while
    it is written in order; a slice's offset is the running sum of the rows before it, over one row
    per slice.  Rows that tie on all of ``order`` are numbered in any order."""
    from haze.session import materialize
    spark = df.sparkSession
    n = int(partitions or spark.conf.get("spark.sql.shuffle.partitions"))
    by = [F.col(f"`{c}`").asc_nulls_first() for c in order]
    numbered = df.repartitionByRange(n, *by).sortWithinPartitions(*by) \
        .withColumn("_id", F.monotonically_increasing_id())
    rows = materialize(numbered, "ordinal").withColumn("_slice", F.shiftright("_id", _ROW_BITS))
    before = Window.orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = rows.groupBy("_slice").agg(F.count(F.lit(1)).alias("_n")) \
        .select("_slice", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    # one row per slice, and there are n slices
    out = rows.join(F.broadcast(offsets), "_slice")
    place = F.col("_before") + F.col("_id").bitwiseAND(F.lit((1 << _ROW_BITS) - 1)) + 1
    return out.withColumn(out_col, place.cast("long")).drop("_slice", "_id", "_before")


def running_rate(df: DataFrame, ts_col: str, every: int = 1000, tie: Sequence[str] = (),
                 partitions: int | None = None) -> DataFrame:
    """The producer's running rate: a row for every ``every``-th message in time order.

    ``ordinal`` messages were sent ``elapsed`` seconds after the first; ``rate`` is their quotient
    (null while no time has passed).  Messages without an instant are not counted; ``tie`` orders
    messages of one instant."""
    if every < 1:
        raise ValueError("every must be at least 1")
    cols = list(dict.fromkeys([ts_col, *tie]))
    sent = df.where(F.col(ts_col).isNotNull()).select(*cols)
    first = sent.agg(F.min(F.unix_micros(ts_col))).scalar()
    hits = global_ordinal(sent, cols, partitions=partitions).where(F.col("ordinal") % every == 0)
    elapsed = (F.unix_micros(ts_col) - first).cast("double") / F.lit(1e6)
    out = hits.select("ordinal", ts_col, elapsed.alias("elapsed"))
    return out.withColumn("rate", F.when(F.col("elapsed") > 0, F.col("ordinal") / F.col("elapsed")))


def order_report(files: DataFrame, order: Sequence[str], across_files: bool = True) -> DataFrame:
    """Are stored rows in the order of ``order`` (nulls first), as they lie in their files?

    ``files`` is a table as read from files, before any filter or join.  One row: ``files``,
    ``rows``, ``inside`` (rows that sort before the row above them in the same split), ``between``
    (splits that begin before the split above them ends) and ``ordered``.  With ``across_files``
    files follow each other by name, as Spark numbers them; else each file stands for itself.

    Rows are compared with their neighbour inside one split of a file (a task's worth); splits by
    their first and last row, so what goes over splits is one small row for each."""
    key = F.struct(*[F.col(f"`{c}`").alias(f"k{i}") for i, c in enumerate(order)])
    rows = files.select(key.alias("k"), F.col("_metadata.file_path").alias("file"),
                        F.col("_metadata.file_block_start").alias("split"),
                        F.monotonically_increasing_id().alias("place"))
    along = Window.partitionBy("file", "split").orderBy("place")
    back = F.col("k") < F.lag("k").over(along)
    splits = rows.withColumn("back", F.coalesce(back, F.lit(False))).groupBy("file", "split").agg(
        F.count(F.lit(1)).alias("n"), F.count_if("back").alias("inside"),
        F.min_by("k", "place").alias("first"), F.max_by("k", "place").alias("last"))
    name = F.substring_index("file", "/", -1)
    following = Window.orderBy("name", "file", "split") if across_files \
        else Window.partitionBy("file").orderBy("split")
    splits = splits.withColumn("name", name).withColumn(
        "gap", F.coalesce(F.col("first") < F.lag("last").over(following), F.lit(False)))
    report = splits.agg(F.count_distinct("file").alias("files"), F.coalesce(F.sum("n"), F.lit(0)).alias("rows"),
                        F.coalesce(F.sum("inside"), F.lit(0)).alias("inside"), F.count_if("gap").alias("between"))
    return report.withColumn("ordered", (F.col("inside") == 0) & (F.col("between") == 0))
