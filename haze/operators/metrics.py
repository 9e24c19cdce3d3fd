"""Pipeline-quality metrics: latency samples and summary (exact quantiles),
histogram, per-station series, throughput, freshness, lag, recent rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from haze.functions.timefmt import parse_instant

# Latency validity range [0, 300) s, default recency window
# 60 min, load flags (avg > 1.0 s overloaded, stddev > 0.5 s unstable),
# freshness levels (< 30 s OK, < 120 s WARNING, else ERROR).
VALID_LATENCY_MAX_S = 300
DEFAULT_WINDOW_MIN = 60
OVERLOAD_AVG_S = 1.0
UNSTABLE_STD_S = 0.5
FRESH_OK_S = 30
FRESH_WARN_S = 120

# Level-1 histogram bucket width for exact quantiles, in microseconds.  Valid
# latencies lie in [0, 300 s), so there are at most 300e6 / 2**14 = 18 311
# level-1 buckets and at most 2**14 distinct values inside one bucket: both
# the bucket table and the per-bucket value table have a proven size bound,
# whatever the number of samples.
QUANTILE_BUCKET_US = 1 << 14


def _ts(as_of) -> Column:
    return as_of if isinstance(as_of, Column) else F.lit(as_of).cast("timestamp")


def latency_samples(df: DataFrame, as_of, window_minutes: int = DEFAULT_WINDOW_MIN,
                    datetime_col: str = "datetime", processed_col: str = "processed_at") -> DataFrame:
    """Classify every stored row: ``missing`` (either instant absent),
    ``old`` (event before ``as_of - window``), ``invalid`` (unparseable
    datetime or latency outside [0, 300) s) or ``valid``.

    Adds ``event_time``, ``latency`` (seconds, double) and ``latency_us``
    (exact integer microseconds).  All instants are UTC; ``as_of`` is the
    injected "now", so the result is reproducible.
    """
    raw = F.col(datetime_col)
    proc = F.col(processed_col)
    event_time = parse_instant(raw)
    lat_us = F.unix_micros(proc) - F.unix_micros(event_time)
    cutoff = _ts(as_of) - F.make_dt_interval(mins=F.lit(window_minutes))
    disposition = (
        F.when(raw.isNull() | (F.trim(raw) == "") | proc.isNull(), F.lit("missing"))
        .when(event_time.isNull(), F.lit("invalid"))
        .when(event_time < cutoff, F.lit("old"))
        .when((lat_us >= 0) & (lat_us < VALID_LATENCY_MAX_S * 1_000_000), F.lit("valid"))
        .otherwise(F.lit("invalid")))
    return df.select(
        event_time.alias("event_time"),
        proc.alias("processed_at"),
        (lat_us / F.lit(1e6)).alias("latency"),
        lat_us.alias("latency_us"),
        disposition.alias("disposition"),
        *[c for c in df.columns if c not in (datetime_col, processed_col, "event_time",
                                             "latency", "latency_us", "disposition")],
    )


def disposition_counts(samples: DataFrame) -> DataFrame:
    """raw / valid / old / invalid counters in one pass."""
    d = F.col("disposition")
    return samples.agg(
        F.count(F.lit(1)).alias("raw"),
        F.count_if(d == "valid").alias("valid"),
        F.count_if(d == "old").alias("old"),
        F.count_if(d == "invalid").alias("invalid"),
    )


def _rank_targets(n: Column, quantiles: dict[str, float]) -> list[Column]:
    """(name, 0-based rank) structs.  A number means the nearest rank,
    floor((n-1)q + 0.5); ``("linear", q)`` means the two ranks around (n-1)q, to
    be interpolated afterwards, and ``"median"`` is ``("linear", 0.5)``."""
    out = []
    for name, q in quantiles.items():
        if q == "median" or isinstance(q, tuple):
            at = (n - 1) * F.lit(0.5 if q == "median" else float(q[1]))
            out.append(F.struct(F.lit(f"{name}#lo").alias("name"), F.floor(at).alias("rank")))
            out.append(F.struct(F.lit(f"{name}#hi").alias("name"), F.ceil(at).alias("rank")))
        else:
            out.append(F.struct(F.lit(name).alias("name"),
                                F.floor((n - 1) * F.lit(float(q)) + F.lit(0.5)).alias("rank")))
    return out


def _locate(hist1: DataFrame, n: Column, quantiles: dict) -> DataFrame:
    """(name, b, local): the level-1 bucket holding each target rank and the
    rank inside it, from running counts over the bucket table (bounded)."""
    spark = hist1.sparkSession
    targets = spark.range(1).select(
        F.explode(F.array(*_rank_targets(n, quantiles))).alias("t")).select("t.*")
    upto = Window.orderBy("b").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    cum1 = hist1.withColumn("end", F.sum("c").over(upto)) \
        .withColumn("start", F.col("end") - F.col("c"))
    return cum1.join(F.broadcast(targets),
                     (F.col("rank") >= F.col("start")) & (F.col("rank") < F.col("end"))) \
        .select("name", "b", (F.col("rank") - F.col("start")).alias("local"))


def _pick(v: DataFrame, located: DataFrame) -> DataFrame:
    """Level 2: re-read only the rows of the located buckets (a broadcast
    semi-join against <= 4 bucket ids), count per distinct value inside each
    (<= ``bucket`` rows per bucket) and pick the value at the local rank."""
    wanted = located.select("b").distinct()
    hist2 = v.join(F.broadcast(wanted), "b", "left_semi").groupBy("b", "v") \
        .agg(F.count(F.lit(1)).alias("c"))
    upto2 = Window.partitionBy("b").orderBy("v").rowsBetween(Window.unboundedPreceding,
                                                            Window.currentRow)
    cum2 = hist2.withColumn("end", F.sum("c").over(upto2)) \
        .withColumn("start", F.col("end") - F.col("c"))
    return located.join(cum2, "b").where(
        (F.col("local") >= F.col("start")) & (F.col("local") < F.col("end"))).select("name", "v")


def _bucketed(values: DataFrame, col: str, bucket, origin=None) -> DataFrame:
    v = F.col(col) if origin is None else F.col(col) - origin
    return values.select(v.alias("v")).where(F.col("v").isNotNull()) \
        .withColumn("b", F.floor(F.col("v") / bucket))


# Bits of a value that one histogram level resolves: at most 2**20 rows.
LEVEL_BITS = 20


def _narrow(v: DataFrame, located: DataFrame, wide: int, narrow: int) -> DataFrame:
    """One more histogram level: inside the located buckets of width ``wide``
    (a handful) count per bucket of width ``narrow`` and follow each rank."""
    inside = v.join(F.broadcast(located.select("b").distinct()), "b", "left_semi") \
        .groupBy("b", F.floor(F.col("v") / F.lit(narrow)).alias("b2")) \
        .agg(F.count(F.lit(1)).alias("c"))
    upto = Window.partitionBy("b").orderBy("b2").rowsBetween(Window.unboundedPreceding,
                                                             Window.currentRow)
    cum = inside.withColumn("end", F.sum("c").over(upto)) \
        .withColumn("start", F.col("end") - F.col("c"))
    return located.join(cum, "b").where(
        (F.col("local") >= F.col("start")) & (F.col("local") < F.col("end"))) \
        .select("name", F.col("b2").alias("b"), (F.col("local") - F.col("start")).alias("local"))


def exact_ranks(values: DataFrame, col: str, quantiles: dict[str, float | str | tuple],
                bucket: int | None = None) -> DataFrame:
    """Exact order statistics of an integer column without collecting or
    globally sorting it: (name, value) rows.

    Histogram by levels.  Level 1 counts rows per ``(value - min) div bucket``
    (map-side combined) and is written once to the shared checkpoint folder;
    each target rank's bucket is located from running counts over that small
    table.  The next level re-reads only the rows of those buckets, and the
    last one counts per distinct value and picks the value at the rank.  Without
    an explicit ``bucket`` a value range of 2**bits (min/max come from one
    one-row aggregate) takes one level per ``LEVEL_BITS`` bits, so any range
    works and no level has more than 2**20 rows per located bucket; the
    single-partition windows run over those bounded tables.
    """
    from haze.session import materialize
    origin, widths = 0, [bucket]
    if bucket is None:
        mm = values.agg(F.min(col).alias("lo"), F.max(col).alias("hi")).first()
        if mm["lo"] is None:
            return values.sparkSession.createDataFrame([], "name string, v long")
        origin = int(mm["lo"])
        bits = max(0, (int(mm["hi"]) - origin).bit_length())
        if bits > 63:
            origin, bits = 0, 63       # differences would leave the long range
        levels = max(2, -(-bits // LEVEL_BITS))
        widths = [1 << (bits * k // levels) for k in range(levels - 1, 0, -1)]
    v = _bucketed(values, col, F.lit(int(widths[0])), F.lit(origin) if origin else None)
    hist1 = materialize(v.groupBy("b").agg(F.count(F.lit(1)).alias("c")), "rank-histogram")
    n = hist1.select(F.sum("c")).scalar()
    located = _locate(hist1, n, quantiles)
    for wide, narrow in zip(widths[:-1], widths[1:]):
        located = materialize(_narrow(v, located, wide, narrow), "rank-level")
        v = v.withColumn("b", F.floor(F.col("v") / F.lit(int(narrow))))
    picked = _pick(v, located)
    if origin:
        picked = picked.select("name", (F.col("v") + F.lit(origin)).alias("v"))
    return picked


def linear_quantiles(values: DataFrame, col: str, quantiles: dict[str, float]) -> DataFrame:
    """One row: the linearly interpolated quantiles of an integer column."""
    ranks = exact_ranks(values, col, {k: ("linear", q) for k, q in quantiles.items()})
    n = values.select(F.count(col)).scalar()
    out = []
    for k, q in quantiles.items():
        lo, hi = (F.max(F.when(F.col("name") == f"{k}#{s}", F.col("v"))) for s in ("lo", "hi"))
        out.append((lo + (hi - lo) * F.max((n - 1) * F.lit(float(q)) % 1)).alias(k))
    return ranks.agg(*out)


def latency_summary(samples: DataFrame, bucket: int = QUANTILE_BUCKET_US) -> DataFrame:
    """One row: disposition counters, count/min/max/avg/std (sample) of the
    valid latencies, p50 (median, linear), p95 and p99 (nearest rank),
    and the overload/instability flags.

    Two passes over the samples.  Pass 1 is one grouped aggregate by
    (disposition, level-1 bucket) carrying count, min, max, sum and the
    population variance per group; that table is small (<= 4 + 18 311 rows)
    and is written once to the shared checkpoint folder, so the counters,
    the moments (merged with the parallel-variance formula) and the rank
    location all read it without recomputing the scan.  Pass 2 is the
    level-2 read of the <= 4 buckets holding the ranks.
    """
    from haze.session import materialize
    d = F.col("disposition")
    lat = F.col("latency")
    b = F.when(d == "valid", F.floor(F.col("latency_us") / F.lit(bucket)))
    groups = samples.groupBy(d.alias("disposition"), b.alias("b")).agg(
        F.count(F.lit(1)).alias("c"), F.min(lat).alias("mn"), F.max(lat).alias("mx"),
        F.sum(lat).alias("sm"), F.var_pop(lat).alias("vp"))
    groups = materialize(groups, "latency-groups")
    valid = groups.where(F.col("disposition") == "valid")

    n = F.coalesce(F.sum("c"), F.lit(0).cast("long"))

    def count_of(disposition):
        return F.coalesce(F.sum(F.when(F.col("disposition") == disposition, F.col("c"))),
                          F.lit(0).cast("long")).alias(disposition)

    counts = groups.agg(n.alias("raw"), count_of("valid"), count_of("old"), count_of("invalid"))
    mean = valid.select((F.sum("sm") / F.sum("c")).alias("m")).scalar()
    m2 = F.sum(F.col("vp") * F.col("c") + F.col("c") * F.pow(F.col("sm") / F.col("c") - mean, 2))
    stats = valid.agg(
        n.alias("count"), F.min("mn").alias("min"), F.max("mx").alias("max"),
        F.when(n > 0, F.sum("sm") / n).alias("avg"),
        # sample standard deviation: undefined (null) below two samples
        F.when(n > 1, F.sqrt(m2 / (n - 1))).alias("std_dev"))

    hist1 = valid.select("b", "c")
    located = _locate(hist1, hist1.select(F.sum("c")).scalar(),
                      {"p50": "median", "p95": 0.95, "p99": 0.99})
    ranks = _pick(_bucketed(samples.where(d == "valid"), "latency_us", F.lit(bucket)), located)
    q = ranks.groupBy().agg(*[
        F.max(F.when(F.col("name") == k, F.col("v"))).alias(k)
        for k in ("p50#lo", "p50#hi", "p95", "p99")])
    lo = F.col("p50#lo") / F.lit(1e6)
    hi = F.col("p50#hi") / F.lit(1e6)
    q = q.select((lo + (hi - lo) * F.lit(0.5)).alias("p50"),
                 (F.col("p95") / F.lit(1e6)).alias("p95"),
                 (F.col("p99") / F.lit(1e6)).alias("p99"))
    # The one-row results ride along as struct-valued scalar subqueries
    # (each computed once), so no join is needed to combine them.
    s = stats.select(F.struct(*stats.columns)).scalar()
    p = q.select(F.struct(*q.columns)).scalar()
    out = counts.select("*", s.alias("_s"), p.alias("_p")).select(
        *counts.columns, "_s.*", "_p.*")
    return out.withColumns({
        "overloaded": F.col("avg") > F.lit(OVERLOAD_AVG_S),
        "unstable": F.col("std_dev") > F.lit(UNSTABLE_STD_S),
    })


def _finite(df: DataFrame, col: str) -> Column:
    x = F.col(col)
    if dict(df.dtypes)[col] in ("double", "float"):
        return x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
    return x.isNotNull()


def without_bin(df: DataFrame, col: str = "latency") -> DataFrame:
    """One row: values in a histogram of ``col`` and those without a bin, by kind."""
    x = F.col(col).cast("double")
    nan = F.coalesce(F.isnan(x), F.lit(False))
    return df.agg(F.count_if(_finite(df, col)).alias("binned"), F.count_if(F.col(col).isNull()).alias("missing"),
                  F.count_if(nan).alias("nan"), F.count_if(~nan & (F.abs(x) == float("inf"))).alias("infinite"))


def histogram(df: DataFrame, col: str = "latency", bins: int = 50) -> DataFrame:
    """Equal-width histogram over [min, max] with every bin present.

    bin = floor(bins * (x - min) / (max - min)) + 1, the maximum folded into
    the last bin, all values in bin 1 when min = max.  The value is projected
    first, min/max come from one struct-valued scalar subquery referenced
    once, the count is a map-side combined aggregate (<= bins rows) and the
    empty bins come from a ``bins``-row range.  Nulls, NaN and infinite values
    have no bin (:func:`without_bin` counts them).
    """
    x = F.col(col)
    keep = _finite(df, col)
    src = df.select(x.cast("double").alias("_x"), keep.alias("_keep")).where("_keep")
    bounds = src.select(F.struct(F.min("_x").alias("mn"), F.max("_x").alias("mx"))).scalar()
    withb = src.select("_x", bounds.alias("_mm"))
    mn, mx = F.col("_mm.mn"), F.col("_mm.mx")
    raw_bin = F.floor(F.lit(bins) * (F.col("_x") - mn) / (mx - mn)) + 1
    b = F.when(mx == mn, F.lit(1)).otherwise(F.least(raw_bin, F.lit(bins))).cast("int")
    counts = withb.groupBy(b.alias("bin")).agg(F.count(F.lit(1)).alias("count"),
                                               F.first("_mm").alias("_mm"))
    spark = df.sparkSession
    all_bins = spark.range(1, bins + 1).select(F.col("id").cast("int").alias("bin"))
    joined = all_bins.join(F.broadcast(counts), "bin", "left") \
        .withColumn("_mm", F.max("_mm").over(Window.partitionBy()))   # <= bins rows
    width = (mx - mn) / F.lit(bins)
    return joined.select(
        "bin",
        (mn + (F.col("bin") - 1) * width).alias("bin_lo"),
        (mn + F.col("bin") * width).alias("bin_hi"),
        F.coalesce(F.col("count"), F.lit(0)).alias("count"))


def latency_series(samples: DataFrame, station_col: str = "location_id",
                   chunk_seconds: int = 86_400) -> DataFrame:
    """Per-station sample index (1, 2, ...) in event-time order.

    Numbered per (station, day) so a hot station is spread over many tasks;
    each day's numbering is offset by the station's row count in earlier
    days, taken from a per-(station, day) count table (stations x days rows).
    """
    chunk_us = int(chunk_seconds) * 1_000_000
    valid = samples.where(F.col("disposition") == "valid").select(
        station_col, "event_time", "processed_at", "latency",
        F.floor(F.unix_micros("event_time") / F.lit(chunk_us)).alias("_chunk")) \
        .repartition(station_col, "_chunk")   # pin (station, day): see densify
    per_chunk = valid.groupBy(station_col, "_chunk").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(station_col).orderBy("_chunk") \
        .rowsBetween(Window.unboundedPreceding, -1)
    offsets = per_chunk.select(station_col, "_chunk",
                               F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"))
    w = Window.partitionBy(station_col, "_chunk").orderBy("event_time", "processed_at")
    offsets = offsets.withColumnsRenamed({station_col: "_os", "_chunk": "_oc"})
    same = valid[station_col].eqNullSafe(offsets["_os"]) & (valid["_chunk"] == offsets["_oc"])
    return valid.join(offsets, same).select(
        station_col, (F.col("_off") + F.row_number().over(w)).alias("idx"),
        "event_time", "processed_at", "latency")


CSV_TIME = "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"      # microseconds survive the file


def write_latency_csv(samples: DataFrame, path: str) -> None:
    """Valid samples (event_time, processed_at, latency) ordered by event
    time into CSV with a header (a range-partitioned sort, not one task)."""
    (samples.where(F.col("disposition") == "valid")
        .select("event_time", "processed_at", "latency")
        .orderBy("event_time")
        .write.mode("overwrite").option("header", True)
        .option("timestampFormat", CSV_TIME).csv(path))


def read_latency_csv(spark: SparkSession, path: str) -> DataFrame:
    from haze.schemas import LATENCY_SCHEMA
    return spark.read.schema(LATENCY_SCHEMA).option("header", True) \
        .option("timestampFormat", CSV_TIME).csv(path)


def throughput(df: DataFrame, ts_col: str) -> DataFrame:
    """Rows, first/last instant, elapsed seconds and rows per second."""
    first, last = F.min(ts_col), F.max(ts_col)
    elapsed = (F.unix_micros(last) - F.unix_micros(first)) / F.lit(1e6)
    return df.agg(F.count(F.lit(1)).alias("rows"), first.alias("first"), last.alias("last"),
                  elapsed.alias("elapsed_s")) \
        .withColumn("rows_per_s", F.when(F.col("elapsed_s") > 0,
                                          F.col("rows") / F.col("elapsed_s")))


def throughput_by_window(df: DataFrame, ts_col: str, every: str = "1 second") -> DataFrame:
    """Rows per tumbling window of ``every`` (the running-rate view)."""
    return df.groupBy(F.window(ts_col, every).alias("w")).agg(F.count(F.lit(1)).alias("rows")) \
        .select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "rows")


def recent_rows(df: DataFrame, as_of, seconds: int = 30, ts_col: str = "processed_at") -> DataFrame:
    """Total rows and rows that arrived in the last ``seconds`` before as_of."""
    lo = _ts(as_of) - F.make_dt_interval(secs=F.lit(seconds))
    t = F.col(ts_col)
    return df.agg(F.count(F.lit(1)).alias("total"),
                  F.count_if((t >= lo) & (t <= _ts(as_of))).alias("recent"))


def freshness(df: DataFrame, as_of, ts_col: str = "event_ts") -> DataFrame:
    """One row: count, newest instant, its age at ``as_of`` and a level
    (OK < 30 s, WARNING < 120 s, else ERROR; WARNING when empty)."""
    newest = F.max(ts_col)
    age = (F.unix_micros(_ts(as_of)) - F.unix_micros(newest)) / F.lit(1e6)
    out = df.agg(F.count(F.lit(1)).alias("count"), newest.alias("newest"), age.alias("age_s"))
    status = (F.when(F.col("count") == 0, F.lit("WARNING"))
              .when(F.col("age_s") < FRESH_OK_S, F.lit("OK"))
              .when(F.col("age_s") < FRESH_WARN_S, F.lit("WARNING"))
              .otherwise(F.lit("ERROR")))
    return out.withColumn("status", status)


def end_offsets(messages: DataFrame) -> DataFrame:
    """Total produced = sum over topic partitions of (max offset + 1), from
    a batch read of the topic (columns ``partition``, ``offset``)."""
    per_part = messages.groupBy("partition").agg((F.max("offset") + 1).alias("end"))
    return per_part.agg(F.sum("end").alias("produced"))


def ingest_lag(produced: DataFrame, stored: DataFrame) -> DataFrame:
    """produced (one-row frame with ``produced``) vs stored row count;
    lag = max(0, produced - stored)."""
    s = stored.select(F.count(F.lit(1))).scalar()
    return produced.select("produced", s.alias("stored")).withColumn(
        "lag", F.greatest(F.col("produced") - F.col("stored"), F.lit(0)))
