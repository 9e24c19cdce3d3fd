"""Time-window aggregates and rule-based, edge-triggered alerts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

DAY_SECONDS = 86_400
MAX_RULES = 1000

# Default alert rules (column, operator, threshold, severity),
# strongest first.
DEFAULT_RULES = [("aqi", ">", 200.0, "danger"), ("aqi", ">", 150.0, "warning")]

_OPS = {
    ">": lambda c, t: c > t, ">=": lambda c, t: c >= t,
    "<": lambda c, t: c < t, "<=": lambda c, t: c <= t,
    "=": lambda c, t: c == t, "!=": lambda c, t: c != t,
}


def window_stats(df: DataFrame, ts_col: str = "event_ts", every: str = "1 hour",
                 slide: str | None = None, station: str = "location_id",
                 value: str = "aqi") -> DataFrame:
    """Per station and tumbling (or sliding, when ``slide`` is given) event-time
    window: rows, mean and max of ``value``.  Works unchanged on a stream
    after ``withWatermark`` (append mode emits closed windows).  Each row
    lands in ceil(every/slide) windows; the aggregate is map-side combined."""
    w = F.window(ts_col, every, slide) if slide else F.window(ts_col, every)
    agg = df.groupBy(w.alias("w"), station).agg(
        F.count(F.lit(1)).alias("n"), F.avg(value).alias(f"avg_{value}"),
        F.max(value).alias(f"max_{value}"))
    return agg.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"),
                      station, "n", f"avg_{value}", f"max_{value}")


def rules_frame(spark: SparkSession, rules=None) -> DataFrame:
    return spark.createDataFrame(rules or DEFAULT_RULES,
                                 "column string, op string, threshold double, severity string")


def apply_rules(df: DataFrame, rules: DataFrame, out_col: str = "severity") -> DataFrame:
    """First matching rule's severity: rules in ``priority`` order when the
    table has that column (lowest first), else in table order (strongest
    first, as a local list keeps it).

    The rules table is configuration: its size is checked and its rows become
    one ``CASE WHEN`` expression, so evaluation stays a narrow projection."""
    if "priority" in rules.columns:
        rules = rules.orderBy("priority")
    rows = rules.limit(MAX_RULES + 1).collect()
    if len(rows) > MAX_RULES:
        raise ValueError(f"more than {MAX_RULES} rules are not supported")
    expr: Column | None = None
    for r in rows:
        cond = _OPS[r["op"]](F.col(r["column"]), F.lit(r["threshold"]))
        expr = F.when(cond, F.lit(r["severity"])) if expr is None \
            else expr.when(cond, F.lit(r["severity"]))
    return df.withColumn(out_col, expr if expr is not None else F.lit(None).cast("string"))


def live_rules(df: DataFrame, rules: DataFrame, out_col: str = "severity") -> DataFrame:
    """First matching rule's severity, the rules read when ``df`` is (not when the plan is made).

    The rules become one ordered array in a scalar subquery: Spark evaluates it once a query, the
    driver collects nothing, and a stream that calls this per micro-batch sees each batch's rules
    (:class:`haze.streaming.job.LiveRules`).  Rules are ordered by ``priority`` (missing last), then
    column, operator, threshold and severity.  A rule on a column that ``df`` lacks, with an unknown
    operator or without a threshold never matches; without rules the severity is null."""
    if "priority" not in rules.columns:
        raise ValueError("rules read from a table need a priority: a table has no order")
    names = sorted({f.name for f in df.schema.fields
                    if f.dataType.typeName() in ("double", "float", "integer", "long", "short", "byte")})
    item = F.struct(F.coalesce(F.col("priority").cast("long"), F.lit((1 << 63) - 1)).alias("priority"),
                    "column", "op", F.col("threshold").cast("double").alias("threshold"), "severity")
    packed = rules.agg(F.array_sort(F.collect_list(item)).alias("r")).scalar()
    # the measures of a row by name; nulls stay null and match nothing
    values = F.create_map(*[x for c in names for x in (F.lit(c), F.col(f"`{c}`").cast("double"))]) \
        if names else F.lit(None).cast("map<string,double>")

    def matches(rule):
        v, t = F.try_element_at(values, rule["column"]), rule["threshold"]
        cond = F.lit(False)
        for op, test in _OPS.items():
            cond = F.when(rule["op"] == op, test(v, t)).otherwise(cond)
        return F.coalesce(cond, F.lit(False))

    # a subquery may not stand inside a lambda's function: the array is a column first
    first = F.get(F.filter("_rules", matches), F.lit(0))
    return df.withColumn("_rules", packed).withColumn(out_col, first["severity"]).drop("_rules")


def previous_value(df: DataFrame, col: str, station: str = "location_id",
                   ts_col: str = "event_ts", chunk_seconds: int = DAY_SECONDS,
                   out_col: str | None = None) -> DataFrame:
    """The station's previous row's ``col`` in time order (null for the first).

    Windows run per (station, day) so a hot station is spread over many
    tasks; the first row of a day takes the last row of the station's
    previous non-empty day from a per-(station, day) summary (bounded by
    stations x days).  Rows with equal instants are ordered by ``col``."""
    out_col = out_col or f"prev_{col}"
    chunk_us = int(chunk_seconds) * 1_000_000
    base = df.withColumns({"_t": F.unix_micros(F.col(ts_col))}) \
        .withColumn("_chunk", F.floor(F.col("_t") / F.lit(chunk_us))) \
        .repartition(station, "_chunk")   # pin (station, day): see densify
    item = F.struct(F.col("_t").alias("t"), F.col(col).alias("v"))
    summary = base.groupBy(station, "_chunk").agg(F.max(item).alias("_last"))
    carry = summary.select(station, "_chunk", F.lag("_last").over(
        Window.partitionBy(station).orderBy("_chunk")).alias("_carry"))
    rows = base.join(carry, [station, "_chunk"], "left")
    w = Window.partitionBy(station, "_chunk").orderBy("_t", col)
    prev = F.coalesce(F.lag(item).over(w), F.col("_carry"))
    return rows.withColumn(out_col, prev["v"]).drop("_t", "_chunk", "_carry")


def alert_edges(df: DataFrame, rules: DataFrame, station: str = "location_id",
                ts_col: str = "event_ts") -> DataFrame:
    """Rows where a station enters a severity level (different from its
    previous row's level), i.e. alerts fire on the rising edge only."""
    sev = apply_rules(df, rules)
    with_prev = previous_value(sev, "severity", station, ts_col)
    s, p = F.col("severity"), F.col("prev_severity")
    return with_prev.where(s.isNotNull() & (p.isNull() | (p != s)))
