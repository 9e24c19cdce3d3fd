"""Reading-event sources and decoding (batch and streaming alike)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from haze.functions.aqi import pm25_status
from haze.functions.timefmt import parse_instant
from haze.functions.values import two_decimals
from haze.schemas import EVENT_SCHEMA, MEASURES

CORRUPT = "_corrupt_record"


def readings_stream(spark: SparkSession, source: str = "kafka", path: str | None = None,
                    options: dict[str, str] | None = None,
                    max_per_trigger: int | None = None,
                    min_partitions: int | None = None) -> DataFrame:
    """A streaming DataFrame with one ``value`` column holding message text.

    ``kafka``: subscribe to ``options['subscribe']`` on
    ``options['kafka.bootstrap.servers']`` (several brokers, comma separated),
    ``startingOffsets=latest`` and ``failOnDataLoss=false`` unless overridden;
    ``minPartitions`` spreads a few topic partitions over more tasks.  The
    Kafka connector jar must be on the classpath.
    ``text``/``json-lines``: newline-delimited JSON files under ``path`` (the
    test and replay source).
    """
    opts = dict(options or {})
    if source == "kafka":
        opts.setdefault("startingOffsets", "latest")
        opts.setdefault("failOnDataLoss", "false")
        if max_per_trigger:
            opts.setdefault("maxOffsetsPerTrigger", str(max_per_trigger))
        if min_partitions:
            opts.setdefault("minPartitions", str(min_partitions))
        try:
            raw = spark.readStream.format("kafka").options(**opts).load()
        except Exception as exc:
            if "kafka" in str(exc).lower() and ("find" in str(exc).lower()
                                                 or "DATA_SOURCE_NOT_FOUND" in str(exc)):
                raise RuntimeError(
                    "the Kafka connector is not on the classpath; start Spark with "
                    "spark.jars.packages=org.apache.spark:spark-sql-kafka-0-10_2.13:"
                    f"{spark.version}") from exc
            raise
        return raw.select(F.col("value").cast("string").alias("value"),
                          "topic", "partition", "offset", F.col("timestamp").alias("kafka_ts"))
    if source in ("text", "json-lines"):
        reader = spark.readStream.format("text").options(**opts)
        if max_per_trigger:
            reader = reader.option("maxFilesPerTrigger", str(max_per_trigger))
        return reader.load(path)
    raise ValueError(f"unknown source {source!r}")


def decode_readings(df: DataFrame, value_col: str = "value",
                    schema: T.StructType = EVENT_SCHEMA) -> DataFrame:
    """Message text -> typed reading columns, plus ``event_ts`` and
    ``decode_status``.

    PERMISSIVE JSON: a bad field nulls only that field (``partial``), an
    unparseable message gives an all-null row (``corrupt``) that keeps the raw
    text in ``_corrupt_record``, extra keys are ignored, ``NaN`` is accepted.
    ``event_ts`` parses ISO-8601 with/without fraction/offset and the
    ``yyyy-MM-dd HH:mm:ss`` form; anything else is null, never an error.
    """
    full = T.StructType(schema.fields + [T.StructField(CORRUPT, T.StringType())])
    parsed = F.from_json(F.col(value_col).cast("string"), full,
                         {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT})
    out = df.select(parsed.alias("d")).select("d.*")
    fields = [f.name for f in schema.fields]
    all_null = F.lit(True)
    for f in fields:
        all_null = all_null & F.col(f).isNull()
    status = (F.when(all_null, F.lit("corrupt"))
              .when(F.col(CORRUPT).isNotNull(), F.lit("partial"))
              .otherwise(F.lit("ok")))
    return out.withColumns({"event_ts": parse_instant(F.col("datetime")),
                            "decode_status": status})


def split_decoded(decoded: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(good rows, quarantined rows): quarantine holds all-null decodes."""
    good = decoded.where(F.col("decode_status") != "corrupt").drop(CORRUPT)
    bad = decoded.where(F.col("decode_status") == "corrupt")
    return good, bad


def encode_readings(df: DataFrame, time_col: str = "datetime", event_time=None) -> DataFrame:
    """Rows -> (key, value) JSON messages for a topic or files, every column of a
    row included (nulls are left out).  A timestamp ``time_col`` is rendered as
    ISO-8601 text; ``event_time`` (a Column) re-stamps every message, e.g. with
    an injected "now"."""
    from haze.functions.timefmt import iso_format
    first = [c for c in ["datetime", "location_id", *MEASURES] if c in df.columns or c == "datetime"]
    cols = first + [c for c in df.columns if c not in first and c != time_col]
    dt = event_time if event_time is not None else F.col(time_col)
    if dict(df.dtypes).get(time_col) in ("timestamp", "timestamp_ntz") or event_time is not None:
        dt = iso_format(dt)
    body = F.struct(*[dt.alias("datetime") if c == "datetime" else F.col(c) for c in cols])
    return df.select(F.col("location_id").cast("string").alias("key"), F.to_json(body).alias("value"))


# The signs before the three PM2.5 states in the tail reader's lines.
TAIL_SIGNS = ["🟢 ", "🟡 ", "🔴 "]


def tail_lines(decoded: DataFrame) -> DataFrame:
    """One ``value`` line per reading, batch or stream, as the tail reader prints it: instant text,
    PM2.5 with two decimals (0 if missing) and its state.  Start with ``start(fmt="console")`` to
    follow a topic."""
    pm = F.coalesce(F.col("pm25").cast("double"), F.lit(0.0))
    state = F.when(pm < 50, TAIL_SIGNS[0]).when(pm > 150, TAIL_SIGNS[2]).otherwise(TAIL_SIGNS[1])
    return decoded.select(F.concat(F.lit("Received: "), F.coalesce("datetime", F.lit("None")), F.lit(" | PM2.5: "),
                                   two_decimals(pm), F.lit(" -> "), state, pm25_status(pm)).alias("value"))


def publish_readings(df: DataFrame, topic: str, options: dict[str, str]) -> None:
    """Batch-publish encoded readings to a Kafka topic (connector required)."""
    encode_readings(df).write.format("kafka").options(**options).option("topic", topic).save()
