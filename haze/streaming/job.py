"""The streaming scoring job: decode -> score -> history + snapshot + alerts.

All sinks go through ``foreachBatch`` with a persisted batch (one
computation for three writes).  The history write is keyed and idempotent
and its failure fails the micro-batch (Spark retries it from the
checkpoint); snapshot and alerts are best-effort and idempotent too.
"""

from __future__ import annotations

import logging
from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from haze.functions.aqi import score
from haze.operators.history import (DEFAULT_KEYS, PARTITION_COLS, _note_table, keyed_merge,
                                    read_note, table_exists, upsert_history, with_partition)
from haze.operators.latest import (SNAPSHOT_COLUMNS, fresh, latest_per_key, read_snapshot,
                                   snapshot_delta)
from haze.operators.windows import live_rules
from haze.schemas import HISTORY_COLUMNS
from haze.streaming.source import CORRUPT

log = logging.getLogger(__name__)

# Event-time tolerance and the alert threshold.
LATE_TOLERANCE = "10 minutes"
ALERT_THRESHOLD = 200
# Shards of a new snapshot table unless the caller says otherwise; the number is
# recorded beside the table, and every later write uses the recorded one.
SNAPSHOT_SHARDS = 32
SNAPSHOT_ORDER = ("event_ts", "datetime", "processed_at")


def score_stream(decoded: DataFrame, clock: Column | None = None,
                 watermark: str | None = LATE_TOLERANCE) -> DataFrame:
    """Score decoded readings, stamp ``processed_at`` (micro-batch time, or an
    injected ``clock``), flag rows later than the tolerance and declare the
    event-time watermark used by the stateful operators downstream."""
    out = score(decoded).withColumn("processed_at", clock if clock is not None
                                    else F.current_timestamp())
    out = out.withColumn("late", F.col("event_ts") < F.col("processed_at")
                         - F.expr(f"INTERVAL {LATE_TOLERANCE}"))
    return out.withWatermark("event_ts", watermark) if watermark else out


def snapshot_shard(df: DataFrame, shards: int = SNAPSHOT_SHARDS) -> DataFrame:
    return df.withColumn("shard", F.pmod(F.xxhash64("location_id"), F.lit(shards)).cast("int"))


def merge_snapshot(spark: SparkSession, rows: DataFrame, path: str,
                   shards: int = SNAPSHOT_SHARDS) -> None:
    """Keep one row per station, never regressing to an older reading: the
    batch's latest rows are merged with the stored ones of the same shards.

    ``shards`` is the number for a new table; an existing one keeps its own
    (about one per million stations holds a shard at tens of MB)."""
    # keyed_merge collapses the batch to one row per station itself (a
    # map-side combined arg-max) before merging with the stored shards.
    cols = [c for c in SNAPSHOT_COLUMNS if c in rows.columns]
    known = read_note(spark, path)
    shards = (known and known.shards) or int(shards)
    keyed_merge(spark, snapshot_shard(rows.select(*cols), shards), path, ["location_id"],
                SNAPSHOT_ORDER, "shard", files_per_partition=1, shards=shards, known=known)


def _query_id(spark: SparkSession) -> str:
    """The id of the running stream: it lives in the checkpoint, so a restart
    keeps it and a new checkpoint has another."""
    return spark.sparkContext.getLocalProperty("sql.streaming.queryId") or "batch"


class DualSink:
    """``foreachBatch`` target writing history, snapshot, alerts and quarantine.

    Rows whose ``decode_status`` is ``corrupt`` go to ``quarantine_path`` with
    their raw text; ``counts`` holds the rows per status of the last batch."""

    def __init__(self, spark: SparkSession, history_path: str | None,
                 snapshot_path: str | None = None,
                 alerts_path: str | None = None, keys: Sequence[str] = DEFAULT_KEYS,
                 alert_threshold: int = ALERT_THRESHOLD, latest_only_alerts: bool = False,
                 granularity: str = "day", quarantine_path: str | None = None,
                 shards: int = SNAPSHOT_SHARDS):
        self.spark = spark
        self.history_path = history_path
        self.snapshot_path = snapshot_path
        self.alerts_path = alerts_path
        self.keys = list(keys)
        self.alert_threshold = alert_threshold
        self.latest_only_alerts = latest_only_alerts
        self.granularity = granularity
        self.quarantine_path = quarantine_path
        self.shards = shards
        self.counts: dict[str, int] = {}

    def __call__(self, batch: DataFrame, epoch_id: int) -> None:
        batch = batch.persist(StorageLevel.MEMORY_AND_DISK)
        try:
            # One pass fills the cache and counts the rows per decode status.
            status = F.col("decode_status") if "decode_status" in batch.columns else F.lit("ok")
            self.counts = {r[0]: r[1] for r in batch.groupBy(status).count().collect()}
            if not self.counts:
                return
            query_id = _query_id(self.spark)
            if self.counts.get("corrupt"):
                log.warning("batch %s: %s of %s messages cannot be decoded", epoch_id,
                            self.counts["corrupt"], sum(self.counts.values()))
                if self.quarantine_path:
                    self._write_own(batch.where(status == "corrupt").select(
                        F.col(CORRUPT).alias("value")), self.quarantine_path, query_id, epoch_id)
            good = batch.where(status != "corrupt").drop(CORRUPT)
            # The snapshot and alert writes are independent of the history
            # write: they run as concurrent Spark jobs from a second driver
            # thread, and their failures are only logged (best effort, like
            # the cache they model).
            side = ThreadPoolExecutor(max_workers=1)
            pending = side.submit(self._serving_writes, good, epoch_id, query_id)
            try:
                # Must succeed: an exception here fails the micro-batch.
                if self.history_path:
                    cols = [c for c in HISTORY_COLUMNS + ["event_ts"] if c in good.columns]
                    upsert_history(self.spark, good.select(*cols), self.history_path, self.keys,
                                   granularity=self.granularity)
            finally:
                pending.result()
                side.shutdown()
        finally:
            batch.unpersist()

    def _serving_writes(self, batch: DataFrame, epoch_id: int, query_id: str) -> None:
        if self.snapshot_path:
            try:
                merge_snapshot(self.spark, batch, self.snapshot_path, self.shards)
            except Exception:
                log.warning("snapshot update failed for batch %s", epoch_id, exc_info=True)
        if self.alerts_path:
            try:
                self.write_alerts(batch, epoch_id, query_id)
            except Exception:
                log.warning("alert write failed for batch %s", epoch_id, exc_info=True)

    @staticmethod
    def _write_own(rows: DataFrame, path: str, query_id: str, epoch_id: int) -> None:
        """Rows of one batch of one query: a retried batch replaces its own, and
        batch 0 of a new checkpoint does not touch those of the old one."""
        (rows.withColumns({"query_id": F.lit(query_id), "batch_id": F.lit(int(epoch_id))})
            .write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
            .partitionBy("query_id", "batch_id").parquet(path))

    def write_alerts(self, batch: DataFrame, epoch_id: int, query_id: str = "batch") -> None:
        src = batch
        if self.latest_only_alerts:
            src = latest_per_key(batch.select(*[c for c in SNAPSHOT_COLUMNS if c in batch.columns]),
                                 "location_id", SNAPSHOT_ORDER)
        alerts = src.where(F.col("aqi") > F.lit(self.alert_threshold)).select(
            "location_id", "datetime", "event_ts", "aqi", "quality")
        self._write_own(alerts, self.alerts_path, query_id, epoch_id)


def batch_writer(spark: SparkSession, path: str):
    """``foreachBatch`` target: the batch's rows with ``query_id`` and ``batch_id``."""
    return lambda batch, epoch_id: DualSink._write_own(batch, path, _query_id(spark), epoch_id)


class LateSplit:
    """``foreachBatch`` target that keeps late rows instead of losing them.

    A row is late if its instant lies before the watermark its micro-batch began with: the newest
    instant of all earlier micro-batches less ``delay`` (a row without an instant is on time).  Both
    kinds go out in one write, to ``path/late=false`` and ``path/late=true``, kept apart by query and
    batch.  Counts and the newest instant are observed during that write (no job of their own) and
    recorded under ``{path}_marks``; a retried batch looks at the marks of earlier ones only."""

    MARKS = "newest_us long, delivered long, late_rows long, query_id string, batch_id int"

    def __init__(self, spark: SparkSession, path: str, delay: str = LATE_TOLERANCE,
                 ts_col: str = "event_ts"):
        self.spark, self.path, self.delay, self.ts_col = spark, path.rstrip("/"), delay, ts_col
        self.counts: dict[str, int] = {}

    def rows(self) -> DataFrame:
        """All rows written so far, with ``late`` as a boolean."""
        return self.spark.read.parquet(self.path).withColumn("late", F.col("late").cast("boolean"))

    def marks(self) -> DataFrame:
        """One row per micro-batch: its newest instant, rows delivered, rows late."""
        if not table_exists(self.spark, f"{self.path}_marks"):
            return self.spark.createDataFrame([], self.MARKS)
        return self.spark.read.schema(self.MARKS).parquet(f"{self.path}_marks")

    def __call__(self, batch: DataFrame, epoch_id: int) -> None:
        query_id = _query_id(self.spark)
        before = self.marks().where((F.col("query_id") == query_id) & (F.col("batch_id") < epoch_id))
        newest = before.agg(F.max("newest_us")).first()[0]
        late = F.lit(False)
        if newest is not None:
            mark = F.timestamp_micros(F.lit(newest)) - F.expr(f"INTERVAL {self.delay}")
            late = F.coalesce(F.col(self.ts_col) < mark, F.lit(False))
        seen = Observation()
        rows = batch.withColumn("late", late).observe(
            seen, F.count(F.lit(1)).alias("delivered"), F.count_if("late").alias("late_rows"),
            F.max(F.unix_micros(self.ts_col)).alias("newest_us"))
        (rows.withColumns({"query_id": F.lit(query_id), "batch_id": F.lit(int(epoch_id))})
             .write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
             .partitionBy("late", "query_id", "batch_id").parquet(self.path))
        self.counts = {k: seen.get[k] for k in ("delivered", "late_rows")}
        mark = self.spark.createDataFrame(
            [(seen.get["newest_us"], seen.get["delivered"], seen.get["late_rows"])],
            "newest_us long, delivered long, late_rows long")
        DualSink._write_own(mark, f"{self.path}_marks", query_id, epoch_id)


class DeltaPush:
    """``foreachBatch`` target that publishes what a micro-batch changed in the snapshot.

    The stored snapshot is updated with the batch (see :func:`merge_snapshot`); the difference to
    the state before goes to ``path`` with its batch (see
    :func:`haze.operators.latest.snapshot_delta`).  Both states are tables of their own under
    ``snapshot_path/v=<batch>``: a retried batch starts from the state before it again."""

    def __init__(self, spark: SparkSession, snapshot_path: str, path: str,
                 ttl_seconds: int | None = None, as_of=None, shards: int = SNAPSHOT_SHARDS):
        self.spark, self.snapshot_path, self.path = spark, snapshot_path.rstrip("/"), path
        self.ttl_seconds, self.as_of, self.shards = ttl_seconds, as_of, shards

    def state(self, version: int) -> DataFrame:
        """The snapshot after micro-batch ``version`` (-1: empty)."""
        return read_snapshot(self.spark, f"{self.snapshot_path}/v={version}")

    def __call__(self, batch: DataFrame, epoch_id: int) -> None:
        old = self.state(epoch_id - 1)
        cols = [c for c in SNAPSHOT_COLUMNS if c in batch.columns]
        both = old.select(*[c for c in cols if c in old.columns]).unionByName(
            batch.select(*cols), allowMissingColumns=True)
        new = latest_per_key(both, "location_id", SNAPSHOT_ORDER)
        if self.ttl_seconds is not None:
            # ends counted from the newest reading unless a clock is given
            now = self.as_of if self.as_of is not None else new.agg(F.max("processed_at")).scalar()
            new = fresh(new, now, self.ttl_seconds)
        target = f"{self.snapshot_path}/v={epoch_id}"
        (snapshot_shard(new, self.shards).repartition(self.shards, "shard").write.mode("overwrite")
            .option("partitionOverwriteMode", "static").partitionBy("shard").parquet(target))
        _note_table(self.spark, target, snapshot_shard(new, self.shards).schema, self.shards)
        DualSink._write_own(snapshot_delta(old, self.state(epoch_id)), self.path,
                            _query_id(self.spark), epoch_id)


class LiveRules:
    """``foreachBatch`` target judging every micro-batch by the alert rules of that moment.

    ``rules_path`` is a Parquet table (priority, column, op, threshold, severity) that may be
    replaced between micro-batches; it is listed and read anew in each.  Rows with a severity go to
    ``path``, kept apart by query and batch, so a retried batch replaces its own."""

    def __init__(self, spark: SparkSession, rules_path: str, path: str,
                 columns: Sequence[str] = ("location_id", "datetime", "event_ts", "aqi")):
        self.spark, self.rules_path, self.path, self.columns = spark, rules_path, path, list(columns)

    def __call__(self, batch: DataFrame, epoch_id: int) -> None:
        rules = self.spark.read.parquet(self.rules_path)
        judged = live_rules(batch, rules).where(F.col("severity").isNotNull())
        DualSink._write_own(judged.select(*self.columns, "severity"), self.path,
                            _query_id(self.spark), epoch_id)


def latest_state(scored: DataFrame) -> DataFrame:
    """Stateful latest-per-station aggregate (run in ``update`` mode): the
    state store keeps one row per station; an older reading arriving later
    never replaces a newer one."""
    return latest_per_key(scored.select(*[c for c in SNAPSHOT_COLUMNS if c in scored.columns]),
                          "location_id", SNAPSHOT_ORDER)


def dedup_stream(df: DataFrame, keys: Sequence[str] = DEFAULT_KEYS) -> DataFrame:
    """Drop repeated deliveries of a key while within the watermark; rows
    older than the watermark are dropped as late (needs ``withWatermark``)."""
    return df.dropDuplicatesWithinWatermark(list(keys))


def start(df: DataFrame, checkpoint: str, sink=None, fmt: str | None = None,
          path: str | None = None, mode: str = "append", trigger: dict | None = None,
          name: str | None = None) -> StreamingQuery:
    """Start a query with a durable checkpoint.  ``sink`` is a foreachBatch
    callable; else ``fmt``/``path`` (``console`` prints without truncation).
    ``trigger`` defaults to ``availableNow`` (drain what is there, then stop)."""
    w = df.writeStream.outputMode(mode).option("checkpointLocation", checkpoint)
    if name:
        w = w.queryName(name)
    w = w.trigger(**(trigger or {"availableNow": True}))
    if sink is not None:
        w = w.foreachBatch(sink)
    elif fmt == "console":
        w = w.format("console").option("truncate", "false")
    else:
        w = w.format(fmt or "parquet").option("path", path)
    return w.start()


def run_to_completion(df: DataFrame, checkpoint: str, **kw) -> None:
    q = start(df, checkpoint, **kw)
    q.awaitTermination()
    if q.exception() is not None:
        raise RuntimeError(str(q.exception()))


def _needs_checkpoint(checkpoint: str | None) -> str:
    if not checkpoint:
        raise ValueError("a checkpoint folder is needed: without it a restart begins anew")
    return checkpoint


def scoring_job(spark: SparkSession, messages: DataFrame, mode: str = "console",
                checkpoint: str | None = None, history_path: str | None = None,
                snapshot_path: str | None = None, alerts_path: str | None = None,
                trigger: dict | None = None, granularity: str = "day",
                quarantine_path: str | None = None,
                shards: int = SNAPSHOT_SHARDS) -> StreamingQuery:
    """The whole job: decode ``messages`` (a ``value`` column), score, and write
    either to the console (``mode="console"``, every row with its decode status)
    or to history + snapshot + alerts (``mode="dual"``); there corrupt messages
    go to ``quarantine_path`` (default: beside the history).  ``dual`` needs a
    ``checkpoint``; a console run without one starts at the latest message."""
    from haze.session import scratch_path
    from haze.streaming.source import decode_readings
    scored = score_stream(decode_readings(messages))
    trigger = trigger or {"processingTime": "0 seconds"}
    if mode == "console":
        return start(scored, checkpoint or scratch_path(spark, "console"), fmt="console",
                     trigger=trigger)
    if mode == "dual":
        sink = DualSink(spark, history_path, snapshot_path, alerts_path,
                        granularity=granularity, shards=shards,
                        quarantine_path=quarantine_path or f"{history_path}_quarantine")
        return start(scored, _needs_checkpoint(checkpoint), sink=sink, trigger=trigger)
    raise ValueError(f"unknown mode {mode!r}")


def history_append_stream(scored: DataFrame, path: str, checkpoint: str,
                          granularity: str = "day", trigger: dict | None = None) -> StreamingQuery:
    """History through Spark's file sink: exactly-once appends (the sink's
    metadata log hides files of uncommitted batches), time-partitioned, and
    each micro-batch costs only its own rows -- no partition rewrite.  Rows
    delivered twice upstream are stored twice; read with
    :func:`current_history` for primary-key semantics."""
    cols = [c for c in HISTORY_COLUMNS + ["event_ts"] if c in scored.columns]
    part = PARTITION_COLS[granularity]
    out = with_partition(scored.select(*cols), "event_ts", granularity)
    return (out.writeStream.format("parquet").outputMode("append")
            .option("path", path).option("checkpointLocation", checkpoint)
            .partitionBy(part).trigger(**(trigger or {"processingTime": "0 seconds"}))
            .start())


def current_history(history: DataFrame, keys: Sequence[str] = DEFAULT_KEYS,
                    order: Sequence[str] = ("processed_at",)) -> DataFrame:
    """Primary-key view of an append-only history: the latest write per key
    (map-side combined arg-max; the time partition column rides along)."""
    return latest_per_key(history, list(keys), list(order))


def scoring_job_append(spark: SparkSession, messages: DataFrame, history_path: str,
                       snapshot_path: str | None = None, alerts_path: str | None = None,
                       checkpoint: str | None = None, granularity: str = "day",
                       trigger: dict | None = None, quarantine_path: str | None = None,
                       shards: int = SNAPSHOT_SHARDS) -> list[StreamingQuery]:
    """The scoring job for high-rate streams: history by the exactly-once
    file sink (append, O(batch) per micro-batch); snapshot, alerts and the
    quarantine of corrupt messages (default: beside the history) by
    ``foreachBatch``; two queries over the same decoded stream, each with its
    own folder under ``checkpoint``."""
    from haze.streaming.source import decode_readings, split_decoded
    ckpt = _needs_checkpoint(checkpoint)
    decoded = decode_readings(messages)
    scored = score_stream(split_decoded(decoded)[0])
    queries = [history_append_stream(scored, history_path, f"{ckpt}/history", granularity,
                                     trigger)]
    serving = DualSink(spark, None, snapshot_path, alerts_path, shards=shards,
                       quarantine_path=quarantine_path or f"{history_path}_quarantine")
    queries.append(start(score_stream(decoded), f"{ckpt}/serving", sink=serving,
                         trigger=trigger or {"processingTime": "0 seconds"}))
    return queries


def snapshot_stream(scored: DataFrame, path: str, checkpoint: str,
                    every: str | None = "5 seconds", trigger: dict | None = None) -> StreamingQuery:
    """The latest-per-station snapshot as its own stream: the stateful
    arg-max (``update`` mode, one state row per station) merged into the
    sharded snapshot table by ``foreachBatch``, pushed every ``every``."""
    latest = latest_state(scored)
    trig = trigger or ({"processingTime": every} if every else {"availableNow": True})
    return start(latest, checkpoint, mode="update", trigger=trig,
                 sink=lambda b, e: merge_snapshot(b.sparkSession, b, path))


def compact_history(spark: SparkSession, append_path: str, compacted_path: str,
                    partitions: Sequence | None = None, keys: Sequence[str] = DEFAULT_KEYS,
                    order: Sequence[str] = ("processed_at",), granularity: str = "day") -> None:
    """Deduplicate time partitions of an append-mode history into a keyed
    table (latest write per key), rewriting only those partitions there.

    The append table itself is never rewritten: its files are tracked by the
    streaming file sink's metadata log, and files written outside it would
    be invisible to readers.  ``partitions=None`` compacts every partition.
    """
    part = PARTITION_COLS[granularity]
    src = spark.read.parquet(append_path)
    if partitions is not None:
        src = src.where(F.col(part).isin(list(partitions)))
    keyed_merge(spark, src, compacted_path, list(keys), list(order), part)
