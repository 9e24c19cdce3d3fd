"""Per-station state on streams: a snapshot whose entries expire, and alerts on changes of level.

Both are ``transformWithState`` processors over RocksDB state (one small entry per station, kept in
the checkpoint, so a restart goes on where the stream stopped).  Spark drops rows older than the
watermark before they reach a processor.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor

from haze.operators.latest import DEFAULT_TTL_SECONDS, latest_per_key
from haze.session import ship

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ORDER = ("event_us", "datetime", "processed_us")
#: Rows gathered before they are thinned to the newest of each station.
THIN_ROWS = 200_000


@contextmanager
def rocksdb_state(spark: SparkSession):
    """Streams started inside keep their state in RocksDB, which ``transformWithState`` needs (a
    stream copies the session's settings when it starts); the setting is put back afterwards."""
    before = spark.conf.get(_PROVIDER)
    spark.conf.set(_PROVIDER, ROCKSDB)
    try:
        yield
    finally:
        spark.conf.set(_PROVIDER, before)


def _micros(df: DataFrame) -> DataFrame:
    """Instants as whole microseconds: what a processor keeps does not depend on a time zone."""
    return df.withColumns({"event_us": F.unix_micros("event_ts"),
                           "processed_us": F.unix_micros("processed_at")})


def _sort_key(row) -> tuple:
    """The snapshot's order; a missing value is older than any other."""
    return tuple((row[c] is not None, row[c] if row[c] is not None else 0) for c in ORDER)


def _newest(rows: pa.Table) -> pa.Table:
    """The newest row of each station in the snapshot's order; of equal ones, the first."""
    if rows.num_rows < 2:
        return rows
    keys = [("location_id", "ascending"), *[(c, "descending") for c in ORDER]]
    # nulls come last either way: a missing value is older than any other
    rows = rows.take(pc.sort_indices(rows, sort_keys=keys, null_placement="at_end"))
    station = rows["location_id"]
    other = pc.fill_null(pc.not_equal(station.slice(1), station.slice(0, len(rows) - 1)), True)
    return rows.filter(pa.array(np.concatenate([[True], other.to_numpy()])))


def _thinned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows without those that an other row of the task beats.  What is held does not follow the
    size of the task: with many stations the rows go on and a new thinning begins."""
    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += batch.num_rows
        if size >= THIN_ROWS:
            best = _newest(pa.Table.from_batches(held))
            if best.num_rows > THIN_ROWS // 2:
                yield from best.combine_chunks().to_batches()
                held, size = [], 0
            else:
                held, size = best.combine_chunks().to_batches(), best.num_rows
    if held:
        yield from _newest(pa.Table.from_batches(held)).combine_chunks().to_batches()


class ExpiringLatest(StatefulProcessor):
    """The newest reading of a station, until ``ttl_ms`` of event time have passed since it.

    Emits a ``set`` row whenever a newer reading arrives (one a micro-batch: the newest) and an
    ``expired`` row when the watermark passes the entry's end; the entry leaves the state then.
    A reading that extends the entry moves its end: the old timer is deleted."""

    def __init__(self, state: str, columns: Sequence[str], ttl_ms: int):
        self.state, self.columns, self.ttl_ms = state, list(columns), ttl_ms

    def init(self, handle) -> None:
        self.handle = handle
        self.latest = handle.getValueState("latest", self.state)

    def _end(self, event_us: int) -> int:
        """First whole millisecond at which the entry is over."""
        return -(-event_us // 1000) + self.ttl_ms

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        held = self.latest.get()
        held = dict(zip(self.columns, held)) if held is not None else None
        best = held
        for row in rows:
            if best is None or _sort_key(row) > _sort_key(best):
                best = row
        if best is held:
            return
        if held is not None:
            self.handle.deleteTimer(self._end(held["event_us"]))
        self.latest.update(tuple(best[c] for c in self.columns))
        self.handle.registerTimer(self._end(best["event_us"]))
        yield Row(location_id=key[0], change="set", **{c: best[c] for c in self.columns})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        held = self.latest.get()
        if held is None:
            return
        self.latest.clear()
        yield Row(location_id=key[0], change="expired", **dict(zip(self.columns, held)))

    def close(self) -> None:
        pass


def expiring_snapshot(scored: DataFrame, columns: Sequence[str],
                      ttl_seconds: int = DEFAULT_TTL_SECONDS) -> DataFrame:
    """Changes of the latest-per-station snapshot: ``change`` is ``set`` or ``expired`` (with the
    entry that ended).  Start it inside :func:`rocksdb_state`.  ``scored`` is a stream with a watermark on ``event_ts``; ``columns`` are the
    entry's further columns.  Readings without an instant or a station have no entry.  Run in
    ``update`` mode; a station's last change is its present state."""
    rows = _micros(scored.where("event_ts is not null and location_id is not null"))
    kept = ["event_us", "datetime", "processed_us",
            *[c for c in columns if c not in ("event_ts", "datetime", "processed_at")]]
    state = T.StructType([rows.schema[c] for c in kept])
    text = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in state)
    rows = rows.select("location_id", "event_ts", *kept)
    # A station's newest row of a micro-batch decides, and if that one is late all its rows are: the
    # others need not reach the processor.  The schema keeps the watermark of ``event_ts``.
    ship(rows.sparkSession)
    newest = rows.repartition("location_id").mapInArrow(_thinned, rows.schema)
    out = newest.groupBy("location_id").transformWithState(
        ExpiringLatest(text, kept, int(ttl_seconds) * 1000),
        f"location_id {rows.schema['location_id'].dataType.simpleString()}, change string, {text}",
        "Update", "eventTime")
    rest = [c for c in kept if c not in ORDER]
    return out.select("location_id", "change", "datetime",
                      F.timestamp_micros("event_us").alias("event_ts"), *rest,
                      F.timestamp_micros("processed_us").alias("processed_at"))


def present_state(changes: DataFrame) -> DataFrame:
    """Each station's last change among those written with their ``batch_id``: its entry, and
    whether that has ``expired`` (in a micro-batch readings come before ends)."""
    order = ("batch_id", "change_rank")
    ranked = changes.withColumn("change_rank", (F.col("change") == "expired").cast("int"))
    last = latest_per_key(ranked, "location_id", order)
    return last.withColumn("expired", F.col("change") == "expired") \
        .drop("change", "change_rank", "batch_id", "query_id")


class LevelEdges(StatefulProcessor):
    """Rows at which a station's level differs from its row before, in event order.

    Rows wait in the state until the watermark has passed them, so the order of arrival does not
    matter; then they are compared with the level kept from the last one.  What arrives behind the
    watermark is late and takes no part."""

    def __init__(self, fields: Sequence[str], waiting: str):
        self.fields, self.schema = list(fields), waiting

    def init(self, handle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", self.schema)
        self.level = handle.getValueState("level", "severity string")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        fresh = [tuple(r[c] for c in self.fields) for r in rows]
        self.waiting.appendList(fresh)
        # a timer fires once the watermark has passed it: the earliest new row's instant
        self.handle.registerTimer(min(r[0] for r in fresh) // 1000 + 1)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        mark = timerValues.getCurrentWatermarkInMs() * 1000
        rows = sorted(self.waiting.get(), key=lambda r: (r[0], r[1] is not None, r[1] or ""))
        ready = [r for r in rows if r[0] < mark]
        if not ready:
            if rows:
                self.handle.registerTimer(rows[0][0] // 1000 + 1)
            return
        held = self.level.get()
        level = held[0] if held is not None else None
        for r in ready:
            if r[1] is not None and r[1] != level:
                yield Row(location_id=key[0], **dict(zip(self.fields, r)))
            level = r[1]
        self.level.update((level,))
        if len(ready) < len(rows):
            self.waiting.put([tuple(r) for r in rows[len(ready):]])
            self.handle.registerTimer(rows[len(ready)][0] // 1000 + 1)
        else:
            self.waiting.clear()

    def close(self) -> None:
        pass


def stream_edges(judged: DataFrame, columns: Sequence[str] = ("datetime", "aqi")) -> DataFrame:
    """Stream form of :func:`haze.operators.windows.alert_edges`: one row per entry into a level.

    ``judged`` is a stream with ``severity`` (see ``apply_rules``) and a watermark on ``event_ts``;
    ``columns`` come through.  An edge is emitted once the watermark has passed it.  Rows with equal
    instants are ordered by level, as in the batch form.  Run in ``append`` mode, started inside
    :func:`rocksdb_state`."""
    rows = judged.where("event_ts is not null and location_id is not null") \
        .withColumn("event_us", F.unix_micros("event_ts"))
    fields = ["event_us", "severity", *columns]
    text = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in fields)
    key = rows.schema["location_id"].dataType.simpleString()
    out = rows.select("location_id", "event_ts", *fields).groupBy("location_id").transformWithState(
        LevelEdges(fields, text), f"location_id {key}, {text}", "Append", "eventTime")
    return out.select("location_id", F.timestamp_micros("event_us").alias("event_ts"), *columns,
                      "severity")
