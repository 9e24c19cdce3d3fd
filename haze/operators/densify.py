"""Densify sparse readings onto a regular per-station time grid with linear
interpolation; forward fill; multiplicative Gaussian jitter.

Skew-safe layout
----------------
A window ``partitionBy(station)`` would put a whole station into one task;
with one station holding a third of all rows that task never finishes.  So
every window here is partitioned by ``(station, chunk)`` where ``chunk`` is a
fixed span of time (default one day).  What a row needs from outside its
chunk -- the last known value before the chunk, the first known value after
it, and the first reading of the next chunk -- is computed on a *summary*
table with one row per (station, chunk): a map-side combined aggregate whose
size is stations x chunks, independent of the reading count.  The summary's
own window runs per station over chunk rows (a year of days is 365 rows).

The dense grid itself is a narrow ``explode(sequence(...))`` from each sparse
row up to the next one, so the output is produced where the input already is
and no dense-side shuffle or join happens.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from haze.functions.uniform import uniforms
from haze.session import ship

DAY_SECONDS = 86_400


def _value_columns(df: DataFrame, station: str, ts: str, values: Sequence[str] | None):
    if values is not None:
        return list(values)
    return [c for c, t in df.dtypes if c not in (station, ts) and t in ("double", "float", "int",
                                                                         "bigint")]


def _known(t: Column, v: Column) -> Column:
    """(t, v) when v is present, else null: the unit the windows carry."""
    return F.when(v.isNotNull() & ~F.isnan(v.cast("double")), F.struct(t.alias("t"), v.alias("v")))


def _chunked_neighbours(df: DataFrame, station: str, values: Sequence[str], chunk_us: int,
                        need_next: bool = True) -> DataFrame:
    """Per row (``_t`` in micros): ``_p_<c>`` = last known (t, v) at or before
    the row, ``_n_<c>`` = first known (t, v) strictly after it, and ``_t_next``
    = the next row's instant; all across chunk boundaries."""
    # Pin the partitioning to (station, chunk).  Without it, a join that the
    # planner turns into a broadcast leaves the rows hash-partitioned by
    # station alone, which Spark accepts for a (station, chunk) window (a
    # subset of the keys) -- putting a hot station back into one task.  The
    # same exchange also feeds the per-chunk summary (reused, one shuffle).
    df = df.withColumn("_chunk", F.floor((F.col("_t") - F.col("_t0")) / F.lit(chunk_us))) \
        .repartition(station, "_chunk")
    known = {c: _known(F.col("_t"), F.col(c)) for c in values}

    # One row per (station, chunk): bounded by stations x chunks.
    aggs = [F.min("_t").alias("_first_t")]
    for c in values:
        aggs.append(F.max(known[c]).alias(f"_last_{c}"))
        if need_next:
            aggs.append(F.min(known[c]).alias(f"_first_{c}"))
    summary = df.groupBy(station, "_chunk").agg(*aggs)
    by_station = Window.partitionBy(station).orderBy("_chunk")
    before = by_station.rowsBetween(Window.unboundedPreceding, -1)
    after = by_station.rowsBetween(1, Window.unboundedFollowing)
    carry = [F.lead("_first_t").over(by_station).alias("_carry_t_next")]
    for c in values:
        carry.append(F.last(f"_last_{c}", ignorenulls=True).over(before).alias(f"_carry_p_{c}"))
        if need_next:
            carry.append(F.first(f"_first_{c}", ignorenulls=True).over(after)
                         .alias(f"_carry_n_{c}"))
    carry_df = summary.select(station, "_chunk", *carry)

    # Null-safe: readings without a station are a series of their own.
    carry_df = carry_df.withColumnsRenamed({station: "_cs", "_chunk": "_cc"})
    rows = df.join(carry_df, df[station].eqNullSafe(carry_df["_cs"])
                   & df["_chunk"].eqNullSafe(carry_df["_cc"]), "left").drop("_cs", "_cc")
    in_chunk = Window.partitionBy(station, "_chunk").orderBy("_t")
    upto = in_chunk.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    later = in_chunk.rowsBetween(1, Window.unboundedFollowing)
    cols = {"_t_next": F.coalesce(F.lead("_t").over(in_chunk), F.col("_carry_t_next"))}
    for c in values:
        cols[f"_p_{c}"] = F.coalesce(F.last(known[c], ignorenulls=True).over(upto),
                                     F.col(f"_carry_p_{c}"))
        if need_next:
            cols[f"_n_{c}"] = F.coalesce(F.first(known[c], ignorenulls=True).over(later),
                                         F.col(f"_carry_n_{c}"))
    out = rows.withColumns(cols)
    return out.drop(*[c for c in out.columns if c.startswith("_carry_")], "_chunk")


def _with_origin(df: DataFrame, station: str, ts: str) -> DataFrame:
    """``_t`` = instant in micros, ``_t0`` = the station's first instant.
    The per-station minimum is a small aggregate; AQE broadcasts it when its
    measured size allows, else it is a normal shuffle join."""
    base = df.withColumn("_t", F.unix_micros(F.col(ts)))
    origin = base.groupBy(F.col(station).alias("_os")).agg(F.min("_t").alias("_t0"))
    return base.join(origin, base[station].eqNullSafe(origin["_os"])).drop("_os")


def densify(df: DataFrame, station: str = "location_id", ts: str = "datetime",
            values: Sequence[str] | None = None, step_seconds: int = 5,
            chunk_seconds: int = DAY_SECONDS, *, off_grid: str,
            spread_gaps: bool = True) -> DataFrame:
    """Regular grid per station from its first to its last reading every
    ``step_seconds``; each value column linearly interpolated in time between
    the surrounding known points (leading/trailing gaps stay null).

    ``off_grid`` must be said.  ``"drop"``: readings not on the station's grid are ignored (the
    effect of joining the grid on exact instants); ``off_grid_rows`` counts
    them.  ``"snap"``: they are moved down to the grid.  Readings of one
    station that fall on one instant are averaged.  Readings without an
    instant are not on any grid; those without a station are one series.

    ``spread_gaps=True`` cuts every gap at chunk boundaries and shuffles the
    pieces by (station, chunk) before generating the grid, so no task emits
    more than one chunk of grid per station even when a station was silent
    for months (one extra shuffle of the sparse rows).  Without it, the grid
    of a gap is one array in the task that holds the row before the gap.
    """
    values = _value_columns(df, station, ts, values)
    step_us = int(step_seconds) * 1_000_000
    chunk_us = max(int(chunk_seconds) // int(step_seconds), 1) * step_us
    base = _with_origin(df.select(station, ts, *values), station, ts)
    if off_grid not in ("drop", "snap"):
        raise ValueError(f"off_grid must be drop or snap, got {off_grid!r}")
    if off_grid == "snap":
        snapped = F.col("_t0") + F.floor((F.col("_t") - F.col("_t0")) / F.lit(step_us)) * step_us
        base = base.withColumn("_t", snapped)
    else:
        base = base.where((F.col("_t") - F.col("_t0")) % F.lit(step_us) == 0)
    base = base.groupBy(station, "_t", "_t0").agg(*[F.avg(c).alias(c) for c in values])

    rows = _chunked_neighbours(base, station, values, chunk_us)
    stop = F.coalesce(F.col("_t_next") - F.lit(step_us), F.col("_t"))
    if spread_gaps:
        # One piece per chunk the segment touches; piece bounds stay on the
        # grid because chunks are whole multiples of the step from _t0.
        chunk_of = lambda t: F.floor((t - F.col("_t0")) / F.lit(chunk_us))
        rows = rows.withColumn("_stop", stop).withColumn(
            "_pc", F.explode(F.sequence(chunk_of(F.col("_t")), chunk_of(F.col("_stop")))))
        lo = F.greatest(F.col("_t"), F.col("_t0") + F.col("_pc") * F.lit(chunk_us))
        hi = F.least(F.col("_stop"),
                     F.col("_t0") + (F.col("_pc") + 1) * F.lit(chunk_us) - F.lit(step_us))
        rows = rows.withColumns({"_lo": lo, "_hi": hi}).repartition(station, "_pc")
        grid = rows.withColumn("_g", F.explode(F.sequence("_lo", "_hi", F.lit(step_us))))
    else:
        grid = rows.withColumn("_g", F.explode(F.sequence(F.col("_t"), stop, F.lit(step_us))))
    out = [F.col(station), F.timestamp_micros(F.col("_g")).alias(ts)]
    for c in values:
        p, n = F.col(f"_p_{c}"), F.col(f"_n_{c}")
        frac = (F.col("_g") - p["t"]).cast("double") / (n["t"] - p["t"]).cast("double")
        v = (F.when(p["t"] == F.col("_g"), p["v"])
             .when(p.isNotNull() & n.isNotNull(), p["v"] + (n["v"] - p["v"]) * frac))
        out.append(v.cast("double").alias(c))
    return grid.select(*out)


def off_grid_rows(df: DataFrame, station: str = "location_id", ts: str = "datetime",
                  step_seconds: int = 5) -> DataFrame:
    """One row: the readings, those on their station's grid, those off it (which
    ``densify(off_grid="drop")`` ignores) and those without an instant."""
    base = _with_origin(df.select(station, ts), station, ts)
    on = (F.col("_t") - F.col("_t0")) % F.lit(int(step_seconds) * 1_000_000) == 0
    return base.agg(F.count(F.lit(1)).alias("rows"), F.count_if(on).alias("on_grid"),
                    F.count_if(~on).alias("off_grid"), F.count_if(F.col("_t").isNull()).alias("no_instant"))


def left_join_grid(df: DataFrame, station: str = "location_id", ts: str = "datetime",
                   step_seconds: int = 5, chunk_seconds: int = DAY_SECONDS) -> DataFrame:
    """A per-station grid left-joined with the readings on exact instants, values
    left as they are (null off the readings).

    The grid of a station is cut into chunks of ``chunk_seconds``: one row for
    each, dealt by (station, chunk), which a task unfolds, so no array is longer
    than a chunk however long the station was read.  Grid and readings meet in a
    null-safe join on (station, instant): readings without a station are
    a series of their own, those without an instant are not on any grid, several
    at one instant give a row each.  The dense side is shuffled by that join;
    :func:`densify` is the form without it."""
    step_us = int(step_seconds) * 1_000_000
    chunk_us = max(int(chunk_seconds) // int(step_seconds), 1) * step_us
    t = F.unix_micros(ts)
    bounds = df.where(F.col(ts).isNotNull()).groupBy(F.col(station).alias("_gs")).agg(
        F.min(t).alias("_lo"), F.max(t).alias("_hi"))
    chunks = bounds.withColumn("_gc", F.explode(F.sequence(F.lit(0).cast("long"), F.call_function(
        "div", F.col("_hi") - F.col("_lo"), F.lit(chunk_us).cast("long"))))).repartition("_gs", "_gc")
    start = F.col("_lo") + F.col("_gc") * F.lit(chunk_us)
    stop = F.least(F.col("_hi"), start + F.lit(chunk_us - step_us))
    grid = chunks.select("_gs", "_gc", F.explode(F.sequence(start, stop, F.lit(step_us).cast("long"))).alias("_g"))
    rest = [c for c in df.columns if c not in (station, ts)]
    rows = df.withColumn("_t", t).where(F.col("_t").isNotNull()).select(
        F.col(station).alias("_rs"), "_t", F.struct(*[F.col(f"`{c}`") for c in rest], F.lit(0).alias("_")).alias("_row"))
    both = grid.join(rows, F.col("_gs").eqNullSafe(F.col("_rs")) & (F.col("_g") == F.col("_t")), "left")
    cells = {station: F.col("_gs").alias(station), ts: F.timestamp_micros("_g").alias(ts)}
    return both.select(*[cells.get(c, F.col(f"_row.`{c}`").alias(c)) for c in [station, ts, *rest]])


def forward_fill(df: DataFrame, columns: Sequence[str], station: str = "location_id",
                 ts: str = "datetime", chunk_seconds: int = DAY_SECONDS) -> DataFrame:
    """Replace nulls by the station's last known value in time order (rows
    and row count unchanged)."""
    base = _with_origin(df, station, ts)
    rows = _chunked_neighbours(base, station, list(columns), int(chunk_seconds) * 1_000_000,
                               need_next=False)
    filled = {c: F.coalesce(F.col(c), F.col(f"_p_{c}")["v"]).cast(df.schema[c].dataType)
              for c in columns}
    return rows.withColumns(filled).select(*df.columns)


def _key_text(key_cols: Sequence[str]) -> Column:
    """The key's text: its columns' texts, joined by ``|``; a missing value is empty."""
    return F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in key_cols])


def jitter(df: DataFrame, columns: Sequence[str], std: float = 0.02, seed: int = 42,
           key_cols: Sequence[str] | None = ("location_id", "datetime")) -> DataFrame:
    """``v * (1 + N(0, std))`` with an independent draw per column.

    The normal draw is a Box-Muller transform of two uniforms, md5 hashes of the
    row's key (``key_cols``), the seed and the column index: a row gets the
    same noise however the data is partitioned and however often a task is
    re-run after an executor loss.  All hashes of a batch are computed together
    (see :func:`haze.functions.uniform.uniforms`).  ``key_cols=None`` falls back to
    ``randn(seed + i)`` (stable only while the partition contents are)."""
    keys = [c for c in (key_cols or []) if c in df.columns]
    if not keys:
        return df.withColumns({c: F.col(c) * (F.lit(1.0) + F.lit(float(std)) * F.randn(seed + i))
                               for i, c in enumerate(columns)})
    ship(df.sparkSession)
    draws = uniforms(_key_text(keys), [f"{seed}|{salt}|" for salt in range(2 * len(columns))])
    out = {}
    for i, c in enumerate(columns):
        u1, u2 = F.col(f"_draws.u{2 * i}"), F.col(f"_draws.u{2 * i + 1}")
        z = F.sqrt(F.lit(-2.0) * F.log(u1)) * F.cos(F.lit(2 * 3.141592653589793) * u2)
        out[c] = F.col(c) * (F.lit(1.0) + F.lit(float(std)) * z)
    return df.withColumn("_draws", draws).withColumns(out).drop("_draws")
