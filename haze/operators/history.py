"""Scored history table: append, keyed upsert, lookups, newest-n reads."""

from __future__ import annotations

import json
import uuid
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from haze.operators.latest import latest_per_key
from haze.operators.types import TypeChange, cast_columns, merged_schema, read_as

DEFAULT_KEYS = ("location_id", "datetime")
PARTITION_COL = "event_date"
HOUR_PARTITION_COL = "event_hour"
PARTITION_COLS = {"day": PARTITION_COL, "hour": HOUR_PARTITION_COL}
# A keyed merge writes about one file (and uses one task) per ROWS_PER_FILE
# rows of a touched partition.
ROWS_PER_FILE = 1_000_000
# Serving bounds on the number of history rows returned.
MIN_ROWS, MAX_ROWS, DEFAULT_ROWS = 1, 10_000, 1000


def newest_partitions(df: DataFrame, n: int, partition_col: str = PARTITION_COL) -> Column:
    """Predicate keeping the newest partitions that together hold >= ``n`` rows.

    The per-partition row counts read only the partition column (file
    footers, no data pages) and the running sum runs over one row per
    partition; the cut-off is a scalar subquery, which Spark evaluates before
    listing files, so it prunes partitions at run time.
    """
    per = df.groupBy(partition_col).agg(F.count(F.lit(1)).alias("_c"))
    newest_first = Window.orderBy(F.col(partition_col).desc()) \
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    cut = per.withColumn("_cum", F.sum("_c").over(newest_first)) \
        .where(F.col("_cum") - F.col("_c") < F.lit(int(n))) \
        .agg(F.min(partition_col)).scalar()
    # Rows without an instant sit in the null partition and sort last; keeping
    # that partition leaves the top-n identical when fewer than n are timed.
    return F.col(partition_col).isNull() | (F.col(partition_col) >= cut)


def _partition_col(df: DataFrame) -> str | None:
    """The time partition column of a history table (hourly or daily), if any."""
    for c in (HOUR_PARTITION_COL, PARTITION_COL):
        if c in df.columns:
            return c
    return None


def latest_history(df: DataFrame, n: int = DEFAULT_ROWS,
                   order: Sequence[str] = ("event_ts", "location_id"),
                   partition_col: str | None = None) -> DataFrame:
    """The newest ``n`` rows, newest first, with a full tie-break.

    ``orderBy(...).limit(n)`` plans as TakeOrderedAndProject: every task
    keeps its own top ``n`` and only ``n x tasks`` rows reach the final merge.
    On the day-partitioned table (``event_date`` = day of ``event_ts``) only
    the newest days holding >= n rows are read at all: every row of an older
    day is older than all of them, so the answer is unchanged.
    """
    if not (MIN_ROWS <= int(n) <= MAX_ROWS):
        raise ValueError(f"n must be in [{MIN_ROWS}, {MAX_ROWS}], got {n}")
    partition_col = partition_col or _partition_col(df)
    if partition_col in df.columns and order and order[0] == "event_ts":
        df = df.where(newest_partitions(df, n, partition_col))
    return df.orderBy(*[F.col(c).desc_nulls_last() for c in order]).limit(int(n))


def history_query(df: DataFrame, quality: str | None = None, station: int | None = None,
                  since=None, until=None, ts_col: str = "event_ts") -> DataFrame:
    """Lookup by quality label, station and/or time range.  Plain column
    predicates, so parquet row-group stats (and ``event_date`` partition
    pruning when a date bound is derivable) skip data before it is read."""
    cond = F.lit(True)
    part = _partition_col(df)
    bucket = (lambda c: F.to_date(c)) if part == PARTITION_COL else \
        (lambda c: F.date_trunc("hour", c))
    if quality is not None:
        cond &= F.col("quality") == quality
    if station is not None:
        cond &= F.col("location_id") == F.lit(station)
    if since is not None:
        lo = F.lit(since).cast("timestamp")
        cond &= F.col(ts_col) >= lo
        if part:
            cond &= F.col(part) >= bucket(lo)
    if until is not None:
        hi = F.lit(until).cast("timestamp")
        cond &= F.col(ts_col) < hi
        if part:
            cond &= F.col(part) <= bucket(hi)
    return df.where(cond)


def with_partition(df: DataFrame, ts_col: str = "event_ts", granularity: str = "day") -> DataFrame:
    """Add the time partition column: ``event_date`` (day) or ``event_hour``."""
    if granularity == "hour":
        return df.withColumn(HOUR_PARTITION_COL, F.date_trunc("hour", F.col(ts_col)))
    return df.withColumn(PARTITION_COL, F.to_date(F.col(ts_col)))


def append_history(df: DataFrame, path: str, ts_col: str = "event_ts",
                   on_type_change: str = "widen") -> None:
    """Append rows, one folder per event day, station-clustered files.

    The range shuffle on (day, station, instant) gives every day to a few
    tasks instead of every task a file in every day, and splits a busy day.
    Columns whose type differs from the table's are widened, see :func:`prepare`."""
    place = prepare(with_partition(df, ts_col), path, on_type_change=on_type_change)
    (place.rows.repartitionByRange(PARTITION_COL, "location_id", ts_col)
        .sortWithinPartitions(PARTITION_COL, "location_id", ts_col)
        .write.mode("append").partitionBy(PARTITION_COL).parquet(place.folder))
    place.commit()


def _quantiles(df: DataFrame, col: str, bits: int) -> tuple[Column, Column]:
    """(``col`` as a number in its order, the cuts of 2^bits parts of about equal size).
    Text counts by its first seven bytes."""
    kind = df.schema[col].dataType
    value = F.col(f"`{col}`")
    if isinstance(kind, T.StringType):
        head = F.rpad(F.hex(F.substring(F.encode(value, "UTF-8"), 1, 7)), 14, "0")
        value = F.conv(head, 16, 10).cast("long")
    else:
        value = value.cast("double")
    steps = [i / (1 << bits) for i in range(1, 1 << bits)]
    cuts = df.agg(F.percentile_approx(value, steps, 100 << bits).alias("c")).scalar()
    return value, cuts


def _rank(value: Column, cuts: Column) -> Column:
    """How many of ``cuts`` lie below ``value``; 0 for a null."""
    below = F.filter(F.coalesce(cuts, F.array().cast("array<double>")), lambda c: c < value)
    return F.coalesce(F.size(below), F.lit(0))


def clustered_write(df: DataFrame, path: str, by: Sequence[str] = ("location_id", "quality"),
                    ts_col: str = "event_ts", bits: int = 6, distinct: int = 1_000_000,
                    group_bytes: int = 32 << 20) -> None:
    """Write history for lookups by any of ``by``: inside a day, rows follow a z-order curve over
    the columns of ``by``, so the row groups' smallest and largest values are narrow in each of
    them, and Parquet Bloom filters (for up to ``distinct`` values a row group) rule out row groups
    whose range holds a value that they lack.  ``group_bytes`` bounds a row group.

    One pass for the quantiles, one range shuffle on (day, z)."""
    cols = df.columns
    dated = with_partition(df, ts_col)
    ranks = {c: _quantiles(df, c, bits) for c in by}
    wide = dated.withColumns({f"_cuts_{i}": cuts for i, (_, cuts) in enumerate(ranks.values())})
    wide = wide.withColumns({f"_rank_{i}": _rank(value, F.col(f"_cuts_{i}"))
                             for i, (value, _) in enumerate(ranks.values())})
    z = F.lit(0).cast("long")
    for bit in range(bits):
        for i in range(len(by)):
            one = F.shiftright(F.col(f"_rank_{i}"), bit).bitwiseAND(F.lit(1)).cast("long")
            z = z.bitwiseOR(F.shiftleft(one, bit * len(by) + i))
    laid = wide.withColumn("_z", z).repartitionByRange(PARTITION_COL, "_z", ts_col) \
        .sortWithinPartitions(PARTITION_COL, "_z", ts_col).select(*cols, PARTITION_COL)
    writer = laid.write.mode("append").partitionBy(PARTITION_COL).option("parquet.block.size", group_bytes)
    for c in by:
        writer = writer.option(f"parquet.bloom.filter.enabled#{c}", "true") \
            .option(f"parquet.bloom.filter.expected.ndv#{c}", distinct)
    writer.parquet(path)
    _note_table(df.sparkSession, path, dated.schema)


# ------------------------------------------------- schema kept beside the table

def table_exists(spark: SparkSession, path: str) -> bool:
    """Does ``path`` exist on its file system?  Asked before a read, so that an
    error during one is never mistaken for a table that is not there yet."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop)


@dataclass(frozen=True)
class Note:
    """What is recorded beside a table.

    ``epochs`` are (folder, types of its files), oldest first: a new one begins when a column's
    type changes to one that the old files cannot be read as.  ``keyed`` is the partition column of
    a keyed table, whose partitions of a later epoch replace those of earlier ones; an appended
    table has None, and its epochs add up.  Notes are appended, never replaced: the one of the
    greatest ``version`` holds, so a reader meets the old one or the new one."""

    schema: T.StructType
    shards: int | None
    epochs: tuple[tuple[str, T.StructType], ...]
    keyed: str | None
    version: int = field(default=0, compare=False)


def _note_path(path: str) -> str:
    # A leading underscore hides the folder from Spark's own listing of the table.
    return f"{path.rstrip('/')}/_schema"


_NOTE = "version int, schema string, shards int, epochs string, keyed string"


def read_note(spark: SparkSession, path: str) -> Note | None:
    """The note of the table at ``path``; None where nothing is recorded."""
    if not table_exists(spark, _note_path(path)):
        return None
    # one row for each change of the table's columns or types
    rows = spark.read.schema(_NOTE).parquet(_note_path(path)).collect()
    if not rows:
        return None
    row = max(rows, key=lambda r: r["version"] or 0)
    schema = T.StructType.fromJson(json.loads(row["schema"]))
    epochs = json.loads(row["epochs"]) if row["epochs"] else [["", schema.jsonValue()]]
    return Note(schema, row["shards"],
                tuple((f, T.StructType.fromJson(t)) for f, t in epochs), row["keyed"],
                row["version"] or 0)


def table_note(spark: SparkSession, path: str) -> tuple[T.StructType | None, int | None]:
    """(schema, shards) recorded for the table at ``path``; None where nothing is."""
    note = read_note(spark, path)
    return (note.schema, note.shards) if note else (None, None)


def _write_note(spark: SparkSession, path: str, note: Note) -> None:
    epochs = json.dumps([[f, t.jsonValue()] for f, t in note.epochs])
    spark.createDataFrame([(note.version, note.schema.json(), note.shards, epochs, note.keyed)], _NOTE) \
        .coalesce(1).write.mode("append").parquet(_note_path(path))


def _note_table(spark: SparkSession, path: str, schema: T.StructType,
                shards: int | None = None) -> T.StructType:
    """Record ``schema`` (added to the columns already known) and the shard count."""
    place = _place(spark, path, schema, shards=shards)
    place.commit()
    return place.note.schema


@dataclass
class Place:
    """Where and as what a batch is written: ``rows`` into ``folder``, then ``commit()``."""

    spark: SparkSession
    path: str
    folder: str
    note: Note
    changed: bool
    rows: DataFrame | None = None

    def commit(self) -> None:
        if self.changed:
            _write_note(self.spark, self.path, self.note)
            self.changed = False


def _place(spark: SparkSession, path: str, schema: T.StructType, keyed: str | None = None,
           shards: int | None = None, on_type_change: str = "widen",
           known: Note | None = None) -> Place:
    if on_type_change not in ("widen", "fail"):
        raise ValueError(f"unknown on_type_change {on_type_change!r}")
    path = path.rstrip("/")
    old = known or read_note(spark, path)
    if old is None and table_exists(spark, path):
        # written by something else: its files' columns count, and get a note now
        found = spark.read.option("mergeSchema", "true").parquet(path).schema
        old = Note(found, None, (("", found),), None)
        _write_note(spark, path, old)
    if old is None:
        known = merged_schema(T.StructType([]), schema)
        return Place(spark, path, path, Note(known, shards, (("", known),), keyed), True)
    merged = merged_schema(old.schema, schema)
    moved = [f.name for f in old.schema.fields if merged[f.name].dataType != f.dataType]
    if moved and on_type_change == "fail":
        raise TypeChange(f"columns {moved} would change their type")
    folder, types = old.epochs[-1]
    held = {f.name: f.dataType for f in types.fields}
    fits = all(read_as(t, merged[n].dataType) for n, t in held.items())
    if fits:
        # the files of this epoch are read as the wider types from now on
        epochs = (*old.epochs[:-1], (folder, merged))
    else:
        # the folder's name is its own, so leftovers of a write that failed are never read
        folder = f"_epochs/{uuid.uuid4().hex[:12]}"
        epochs = (*old.epochs, (folder, merged))
    note = Note(merged, shards or old.shards, epochs, keyed or old.keyed, old.version + 1)
    place = Place(spark, path, f"{path}/{folder}".rstrip("/"), note, note != old)
    if fits:
        # readers can widen what is there: recorded before the files are written, so that no
        # reader meets a file wider than the note says
        place.commit()
    return place


def prepare(df: DataFrame, path: str, keyed: str | None = None, shards: int | None = None,
            on_type_change: str = "widen", known: Note | None = None) -> Place:
    """Settle the types of a batch before anything is written.

    Each column gets a type that holds the table's and the batch's values (see
    :func:`haze.operators.types.wider`) and the batch is cast to it.  If the table's files cannot be
    read as the new types, the batch goes to a folder of its own (an epoch); otherwise beside them.
    ``on_type_change="fail"`` refuses a batch that would change a type; a refused batch, also one
    with a column that has no common type with the table's, raises ``TypeChange`` and leaves the
    table as it was.  ``known`` is the table's note, if it was just read."""
    place = _place(df.sparkSession, path, df.schema, keyed, shards, on_type_change, known)
    place.rows = cast_columns(df, place.note.schema)
    return place


def read_table(spark: SparkSession, path: str, known: Note | None = None) -> DataFrame:
    """The table with every column any of its files has.  The recorded schema
    saves opening the footer of each file; a table without one (written by
    something else) is read with ``mergeSchema``.  Files of earlier epochs are read as what they
    are and cast; a keyed table's partitions that a later epoch has are not read from them.
    ``known`` is the table's note, if it was just read."""
    note = known or read_note(spark, path)
    if note is None:
        return spark.read.option("mergeSchema", "true").parquet(path)
    parts, replaced = [], None
    for folder, types in reversed(note.epochs):
        place = f"{path.rstrip('/')}/{folder}".rstrip("/")
        if folder and not table_exists(spark, place):
            continue
        rows = cast_columns(spark.read.schema(types).parquet(place), note.schema)
        if note.keyed:
            mine = rows.select(F.col(note.keyed).alias("_replaced")).distinct()
            if replaced is not None:
                rows = rows.join(replaced, F.col(note.keyed).eqNullSafe(F.col("_replaced")), "left_anti")
                mine = mine.unionByName(replaced)
            replaced = mine
        parts.append(rows)
    out = parts[0]
    for rows in parts[1:]:
        out = out.unionByName(rows, allowMissingColumns=True)
    return out


def read_history(spark: SparkSession, path: str, columns: Sequence[str] | None = None,
                 fmt: str = "parquet", options: dict | None = None) -> DataFrame:
    """Read the table (any format/connector via ``fmt``/``options``): all its
    columns, or those of ``columns`` that it has."""
    if fmt == "parquet" and not options:
        df = read_table(spark, path)
    else:
        df = spark.read.format(fmt).options(**(options or {})).load(path)
    return df if columns is None else df.select(*[c for c in columns if c in df.columns])


def keyed_merge(spark: SparkSession, batch: DataFrame, path: str, keys: Sequence[str],
                order: Sequence[str], partition_col: str,
                files_per_partition: int | None = None, shards: int | None = None,
                on_type_change: str = "widen", known: Note | None = None) -> None:
    """Insert-or-replace ``batch`` into the table at ``path`` partitioned by
    ``partition_col`` (a function of ``keys``, e.g. the day of the event
    instant): per key the row with the greatest ``order`` survives.

    Only the partitions the batch touches are read, merged with the batch and
    rewritten with dynamic partition overwrite; the null partition (rows
    without an instant) is one like any other.  Which partitions those are,
    and how many rows they hold at most, stays a table that is joined null-safely;
    the driver sees their smallest and largest value and the total of files.

    Two shuffles of the batch: one collapses copies of a key (map-side
    combined), one deals the merged rows by (partition, hash(key) mod files of
    the partition), with the arg-max per key inside it.  ``files`` is about
    one per ``ROWS_PER_FILE`` rows, so a hot partition is spread over as many
    tasks as it needs; ``files_per_partition`` fixes it instead.  Columns that
    only one side has are kept and null in the other side's rows.  Re-running
    the same batch gives the same table.  Columns whose type differs from the
    table's are widened, see :func:`prepare`.  ``known`` is the table's note, if it was just read.

    This is the compaction route; a stream appends by default and reads
    through ``current_history``.  The overwrite of several partitions is not
    atomic on a bare Parquet folder: a reader may see some of them replaced.
    """
    # The batch as it came is cached, in its own partitions: behind a shuffle it would be cached in
    # as many pieces as shuffles have, and every pass below would start a task for each.
    batch = batch.persist()
    try:
        part = F.col(partition_col)
        span = batch.agg(F.min(part), F.max(part), F.bool_or(part.isNull()), F.count(F.lit(1)),
                         F.count_distinct(part)).first()
        if not span[3]:
            return
        stored_before = table_exists(spark, path)
        # Copies of a key are collapsed in the write itself, with map-side combining.
        place = prepare(latest_per_key(batch, [partition_col, *keys], list(order)), path,
                        partition_col, shards, on_type_change, known)
        merged = place.rows
        counted = batch.select(part.cast(place.note.schema[partition_col].dataType).alias(partition_col))
        if stored_before:
            near = part.between(F.lit(span[0]), F.lit(span[1]))
            near = F.coalesce(near, F.lit(False)) | (part.isNull() if span[2] else F.lit(False))
            touched = batch.select(part.alias("_touched")).distinct()
            stored = cast_columns(read_table(spark, path, place.note), place.note.schema).where(near) \
                .join(touched, part.eqNullSafe(F.col("_touched")), "left_semi")
            merged = stored.unionByName(merged, allowMissingColumns=True)
            counted = stored.select(partition_col).unionByName(counted)
        cols = merged.columns
        if files_per_partition is None:
            sizes = counted.groupBy(part.alias("_part")).agg(
                F.ceil(F.count(F.lit(1)) / ROWS_PER_FILE).alias("_files"))
            total = sizes.agg(F.sum("_files")).first()[0]
            sized = merged.join(sizes, part.eqNullSafe(F.col("_part")))
        else:
            total = (span[4] + int(span[2])) * int(files_per_partition)
            sized = merged.withColumn("_files", F.lit(int(files_per_partition)).cast("long"))
        bucket = F.pmod(F.xxhash64(*[F.col(k) for k in keys]), F.col("_files"))
        # As many tasks as files in total (an explicit count, which AQE keeps).
        spread = sized.withColumn("_file", bucket).select(*cols, "_file") \
            .repartition(int(total), partition_col, "_file")
        current = latest_per_key(spread, [partition_col, "_file", *keys], list(order))
        (current.select(*cols).sortWithinPartitions(partition_col, *keys)
            .write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
            .partitionBy(partition_col).parquet(place.folder))
        place.commit()
    finally:
        batch.unpersist()


def upsert_history(spark: SparkSession, batch: DataFrame, path: str,
                   keys: Sequence[str] = DEFAULT_KEYS,
                   order: Sequence[str] = ("processed_at",),
                   ts_col: str = "event_ts", granularity: str = "day",
                   files_per_partition: int | None = None, on_type_change: str = "widen") -> None:
    """Upsert into the time-partitioned history table (primary key ``keys``,
    the latest ``order`` wins, default: the last processed write).

    Each call rewrites the partitions it touches, so a micro-batch costs
    O(touched partition size).  ``granularity="hour"`` partitions by
    ``event_hour``: a stream then rewrites about an hour of data per batch
    instead of a day (a table format with ``MERGE INTO`` avoids the rewrite
    altogether)."""
    keyed_merge(spark, with_partition(batch, ts_col, granularity), path, keys, order,
                PARTITION_COLS[granularity], files_per_partition=files_per_partition,
                on_type_change=on_type_change)
