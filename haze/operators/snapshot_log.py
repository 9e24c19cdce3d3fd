"""A snapshot that follows its size: changes are appended, compaction deals them into as many shards
as the stations need."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from haze.operators.history import table_exists
from haze.operators.latest import SNAPSHOT_COLUMNS, fresh, latest_per_key

#: Stations a shard of the base holds after a compaction that is not told their number.
STATIONS_PER_SHARD = 1_000_000


class SnapshotLog:
    """Latest-per-station table at ``path``: a sharded base and a log of later changes.

    A batch costs what it brings (one append, kept apart by writer and batch, so a retried batch
    replaces its own rows).  Reading takes the newest row per station over base and log.
    ``compact`` writes both as the next generation's base and then names that generation: readers
    see the old state or the new one.  Changes appended while it runs lie in the log of the
    generation before, which is read along with the present one's: counting a change twice does
    not alter a newest row.  Folders of earlier generations can go when no reader uses them."""

    def __init__(self, spark: SparkSession, path: str, order=("event_ts", "datetime", "processed_at")):
        self.spark, self.path, self.order = spark, path.rstrip("/"), order

    def _current(self) -> tuple[int, int]:
        """(generation, shards of its base); generation 0 has no base."""
        if not table_exists(self.spark, f"{self.path}/_generations"):
            return 0, 0
        row = self.spark.read.schema("generation int, shards int").parquet(f"{self.path}/_generations") \
            .agg(F.max(F.struct("generation", "shards")).alias("m")).first()
        return (row.m.generation, row.m.shards) if row.m else (0, 0)

    @property
    def shards(self) -> int:
        return self._current()[1]

    def append(self, rows: DataFrame, batch_id: int, writer: str = "batch") -> None:
        """Add a batch of readings: its newest row per station."""
        cols = [c for c in SNAPSHOT_COLUMNS if c in rows.columns]
        latest = latest_per_key(rows.select(*cols), "location_id", self.order)
        (latest.withColumns({"writer": F.lit(writer), "batch_id": F.lit(int(batch_id))})
            .write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
            .partitionBy("writer", "batch_id").parquet(f"{self.path}/log/g{self._current()[0]}"))

    def _all(self, generation: int) -> list[DataFrame]:
        folders = [f"{self.path}/base/g{generation}"] + \
            [f"{self.path}/log/g{g}" for g in (generation - 1, generation) if g >= 0]
        found = [f for f in folders if table_exists(self.spark, f)]
        return [self.spark.read.option("mergeSchema", "true").parquet(f).drop("shard", "writer", "batch_id")
                for f in found]

    def read(self, as_of=None, ttl_seconds: int | None = None) -> DataFrame:
        """One row per station: the newest one; without those over at ``as_of`` if that is given."""
        parts = self._all(self._current()[0])
        if not parts:
            raise ValueError(f"nothing was written to {self.path} yet")
        rows = parts[0]
        for p in parts[1:]:
            rows = rows.unionByName(p, allowMissingColumns=True)
        latest = latest_per_key(rows, "location_id", self.order)
        return latest if as_of is None or ttl_seconds is None else fresh(latest, as_of, ttl_seconds)

    def compact(self, shards: int | None = None, as_of=None, ttl_seconds: int | None = None) -> int:
        """Write base and log as a new base of ``shards`` files (default: one per
        ``STATIONS_PER_SHARD`` stations) and return that number."""
        generation = self._current()[0]
        state = self.read(as_of, ttl_seconds)
        if shards is None:
            shards = max(1, -(-state.count() // STATIONS_PER_SHARD))
        shard = F.pmod(F.xxhash64("location_id"), F.lit(int(shards))).cast("int")
        target = f"{self.path}/base/g{generation + 1}"
        (state.withColumn("shard", shard).repartition(int(shards), "shard")
            .write.mode("overwrite").option("partitionOverwriteMode", "static").partitionBy("shard").parquet(target))
        # the generation counts once this row is there
        self.spark.createDataFrame([(generation + 1, int(shards))], "generation int, shards int") \
            .coalesce(1).write.mode("append").parquet(f"{self.path}/_generations")
        return int(shards)
