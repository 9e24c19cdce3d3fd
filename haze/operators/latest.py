"""Latest-per-station snapshot: arg-max per key, TTL on read, key/value
form, and the snapshot-else-history fallback used by serving."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from haze.schemas import MEASURES

SNAPSHOT_COLUMNS = ["location_id", "datetime", "event_ts", *MEASURES,
                    "aqi", "aqi_pm25", "aqi_pm10", "quality", "processed_at"]
KEY_PREFIX = "location:"
DEFAULT_TTL_SECONDS = 3600
_SNAPSHOT_TYPES = {"location_id": "long", "datetime": "string", "event_ts": "timestamp",
                   **dict.fromkeys(MEASURES, "float"), "aqi": "int", "aqi_pm25": "int",
                   "aqi_pm10": "int", "quality": "string", "processed_at": "timestamp"}


def latest_per_key(df: DataFrame, key: str | Sequence[str] = "location_id",
                   order: Sequence[str] = ("event_ts", "datetime", "processed_at")) -> DataFrame:
    """One row per key: the row with the greatest ``order`` tuple.

    ``max(struct(order..., rest...))`` orders lexicographically, so ties on
    ``order`` are broken by the remaining columns and the answer does not
    depend on arrival order.  ``Max`` is a declarative aggregate: it runs as
    a partial (map-side) + final hash aggregate with codegen, so a hot key
    with a third of all rows still leaves each map task as a single row.
    Null order values sort first, i.e. never beat a real instant.
    """
    keys = [key] if isinstance(key, str) else list(key)
    order = [c for c in order if c in df.columns]
    rest = [c for c in df.columns if c not in keys and c not in order]
    packed = F.struct(*[F.col(c).alias(f"o{i}") for i, c in enumerate(order)],
                      *[F.col(c) for c in rest])
    agg = df.groupBy(*keys).agg(F.max(packed).alias("_r"))
    sel = [F.col(k) for k in keys] + [F.col(f"_r.o{i}").alias(c) for i, c in enumerate(order)] \
        + [F.col(f"_r.{c}") for c in rest]
    return agg.select(*sel).select(*[c for c in df.columns])


def fresh(df: DataFrame, as_of, ttl_seconds: int = DEFAULT_TTL_SECONDS,
          ts_col: str = "processed_at") -> DataFrame:
    """Rows still alive at ``as_of`` under a TTL counted from ``ts_col``
    (the key/value store's expiry, applied as a pushed-down predicate)."""
    as_of_col = as_of if isinstance(as_of, Column) else F.lit(as_of).cast("timestamp")
    return df.where(F.col(ts_col) > as_of_col - F.make_dt_interval(secs=F.lit(ttl_seconds)))


# ------------------------------------------------------------ key/value form

# A double's text as Spark prints it, split up: sign, digits before and after
# the point, exponent.
_PRINTED = r"^(-?)([0-9]+)\\.([0-9]+)(?:E(-?[0-9]+))?$"

# The shortest decimal text of ``d`` (a double): plain digits from 1e-4 up to
# below 1e16, else a mantissa and a signed exponent of two digits or more.  The
# nested lambdas name a part once, so that it is computed once.
_NUM_TEXT = """
aggregate(array(cast({x} as string)), '', (no, t) -> CASE
  WHEN t = 'NaN' THEN 'nan' WHEN t = 'Infinity' THEN 'inf' WHEN t = '-Infinity' THEN '-inf'
  WHEN NOT contains(t, 'E') THEN t
  ELSE aggregate(array(named_struct(
      'sign', regexp_extract(t, r'{p}', 1),
      'digits', rtrim('0', concat(regexp_extract(t, r'{p}', 2), regexp_extract(t, r'{p}', 3))),
      'e', int(regexp_extract(t, r'{p}', 4)))), '', (none, s) -> concat(s.sign, CASE
    WHEN s.e BETWEEN -4 AND -1 THEN concat('0.', repeat('0', -s.e - 1), s.digits)
    WHEN s.e BETWEEN 0 AND 15 AND length(s.digits) <= s.e + 1 THEN concat(rpad(s.digits, s.e + 1, '0'), '.0')
    WHEN s.e BETWEEN 0 AND 15 THEN concat(left(s.digits, s.e + 1), '.', substr(s.digits, s.e + 2))
    ELSE concat(left(s.digits, 1), if(length(s.digits) > 1, '.', ''), substr(s.digits, 2),
                if(s.e < 0, 'e-', 'e+'), if(abs(s.e) < 10, '0', ''), string(abs(s.e))) END)) END)"""


def _num_text(c: str) -> Column:
    text = F.expr(_NUM_TEXT.format(x=f"cast(`{c}` as double)", p=_PRINTED.replace("\\\\", "\\")))
    return F.when(F.col(c).isNull(), F.lit("")).otherwise(text)


def _int_text(c: Column) -> Column:
    return F.coalesce(c.cast("int").cast("string"), F.lit(""))


def _ts_text(c: Column) -> Column:
    txt = F.when(F.unix_micros(c) % 1_000_000 == 0,
                 F.date_format(c, "yyyy-MM-dd HH:mm:ss")) \
        .otherwise(F.date_format(c, "yyyy-MM-dd HH:mm:ss.SSSSSS"))
    return F.coalesce(txt, F.lit(""))


def to_kv(df: DataFrame, key_col: str = "location_id") -> DataFrame:
    """(key, fields) with key ``location:{id}`` and a string->string map of
    the 12 snapshot fields.  Nulls become ``''``; a missing AQI ``'0'``; a
    missing or empty quality ``'N/A'``; measures print as doubles (a float
    column is widened first).  A KV connector or plain parquet stores it."""
    key = F.concat(F.lit(KEY_PREFIX), F.coalesce(F.col(key_col), F.lit(0)).cast("string"))
    have = set(df.columns)

    def col(name):
        return F.col(name) if name in have else F.lit(None)

    fields = {
        "aqi": F.coalesce(col("aqi").cast("int").cast("string"), F.lit("0")),
        "quality": F.when(F.coalesce(col("quality"), F.lit("")) == "", F.lit("N/A"))
                    .otherwise(col("quality")),
        "timestamp": F.coalesce(col("datetime").cast("string"), F.lit("")),
        **{m: _num_text(m) if m in have else F.lit("") for m in MEASURES},
        "aqi_pm25": _int_text(col("aqi_pm25")),
        "aqi_pm10": _int_text(col("aqi_pm10")),
        "processed_at": _ts_text(col("processed_at")),
    }
    kv = F.create_map(*[x for k, v in fields.items() for x in (F.lit(k), v)])
    return df.select(key.alias("key"), kv.alias("fields"))


def text_to_double(c: Column) -> Column:
    """Blank -> null, unparseable -> null, else the double."""
    return F.nullif(F.trim(c), F.lit("")).try_cast("double")


def text_to_int(c: Column) -> Column:
    """Via double then truncation, so ``'7.9'`` gives 7 (a direct int cast
    of ``'7.9'`` would be null); out-of-range numbers give null, not an
    ANSI overflow error."""
    return text_to_double(c).try_cast("int")


def from_kv(kv: DataFrame) -> DataFrame:
    """Typed rows back from (key, fields)."""
    f = F.col("fields")
    return kv.select(
        F.coalesce(f["timestamp"], F.lit("")).alias("datetime"),
        F.try_element_at(F.split(F.col("key"), ":"), F.lit(2)).try_cast("long")
        .alias("location_id"),
        *[text_to_double(f[m]).alias(m) for m in MEASURES],
        F.coalesce(text_to_int(f["aqi"]), F.lit(0)).alias("aqi"),
        text_to_int(f["aqi_pm25"]).alias("aqi_pm25"),
        text_to_int(f["aqi_pm10"]).alias("aqi_pm10"),
        F.coalesce(f["quality"], F.lit("N/A")).alias("quality"),
        F.coalesce(f["processed_at"], f["timestamp"], F.lit("")).alias("processed_at"),
    )


# ---------------------------------------------------------------- fallback

def latest_or_history(snapshot: DataFrame, history: DataFrame, columns: Sequence[str],
                      n: int | None = None, ranked: bool = False) -> DataFrame:
    """Snapshot rows tagged ``source='snapshot'`` if there are any, else the
    newest ``n`` history rows tagged ``'history'`` (default ``DEFAULT_ROWS``),
    newest first; ``ranked`` adds that order as ``rank`` (the rows served fit
    one response, so numbering them is one small task).

    One plan, no driver-side branch.  The history side is guarded by an
    uncorrelated ``NOT EXISTS (snapshot)`` placed directly on the history
    input: it references no column, so on the day-partitioned table Spark
    turns it into a partition filter evaluated before listing files, and a
    non-empty snapshot means no history file is read at all.
    """
    from haze.operators.history import DEFAULT_ROWS, latest_history
    snap = snapshot.select(*columns).withColumn("source", F.lit("snapshot"))
    guarded = history.where(~snapshot.exists())
    hist = latest_history(guarded, DEFAULT_ROWS if n is None else n)
    out = snap.unionByName(hist.select(*columns).withColumn("source", F.lit("history")))
    by = [F.col(c).desc_nulls_last() for c in ("event_ts", "location_id") if c in out.columns]
    if ranked:
        out = out.withColumn("rank", F.row_number().over(Window.orderBy(*by)))
    return out.orderBy(*by)


# ---------------------------------------------------------------- stored snapshot

def read_snapshot(spark: SparkSession, path: str, as_of=None,
                  ttl_seconds: int = DEFAULT_TTL_SECONDS) -> DataFrame:
    """The stored snapshot table, without the entries expired at ``as_of``; an
    absent table reads as an empty one."""
    from haze.operators.history import read_table, table_exists
    if not table_exists(spark, path):
        empty = ", ".join(f"{c} {t}" for c, t in _SNAPSHOT_TYPES.items())
        return spark.createDataFrame([], empty)
    snap = read_table(spark, path).drop("shard")
    return snap if as_of is None else fresh(snap, as_of, ttl_seconds)


def compact_snapshot(spark: SparkSession, path: str, as_of, output: str,
                     ttl_seconds: int = DEFAULT_TTL_SECONDS) -> None:
    """Write the entries still alive at ``as_of`` as a new snapshot table at
    ``output``, one file per shard; the old table is left as it is."""
    from haze.operators.history import _note_table, read_table, table_note
    live = fresh(read_table(spark, path), as_of, ttl_seconds)
    shards = table_note(spark, path)[1]
    (live.repartition("shard").write.mode("overwrite")
         .option("partitionOverwriteMode", "static").partitionBy("shard").parquet(output))
    _note_table(spark, output, live.schema, shards)


# ---------------------------------------------------------------- changes

def snapshot_delta(old: DataFrame, new: DataFrame, key: str = "location_id") -> DataFrame:
    """What turns snapshot ``old`` into ``new``: one row per station that differs.

    ``change`` is ``added``, ``changed`` or ``expired`` (the station has no entry any more; its
    measures are those it had).  One full join on the station, null-safe; the sides need not have
    the same columns, a missing one is null.  A station occurs once in a snapshot."""
    names = [c for c in dict.fromkeys([*new.columns, *old.columns]) if c != key]
    types = dict(old.dtypes) | dict(new.dtypes)

    def side(df, name):
        cells = [(F.col(f"`{c}`") if c in df.columns else F.lit(None)).cast(types[c]).alias(c)
                 for c in names]
        return df.select(F.col(key).alias(f"{name}_key"), F.struct(*cells).alias(name))

    both = side(old, "old").join(side(new, "new"), F.col("old_key").eqNullSafe(F.col("new_key")), "full")
    change = (F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "expired")
              .when(~F.col("old").eqNullSafe(F.col("new")), "changed"))
    row = F.coalesce("new", "old")
    station = F.when(F.col("new").isNotNull(), F.col("new_key")).otherwise(F.col("old_key"))
    return both.select(station.alias(key), change.alias("change"), row.alias("row")) \
        .where(F.col("change").isNotNull()).select(key, "change", "row.*")


def replay_deltas(deltas: DataFrame, key: str = "location_id", order: str = "batch_id") -> DataFrame:
    """The snapshot that the deltas of all batches lead to: each station's last one, unless that
    ended it."""
    last = latest_per_key(deltas, key, (order,))
    return last.where(F.col("change") != "expired").drop("change", order)
