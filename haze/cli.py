"""Command line: ``python -m haze <command> ...``.

Each command is a thin wrapper over the library; all heavy lifting runs as
Spark jobs.  Only one-row reports are printed on the driver.

    etl        raw long CSV(.gz) -> wide parquet (clean, mean per instant, pivot)
    densify    wide parquet -> regular grid per station (+ optional noise)
    publish    wide/dense parquet -> JSON messages (Kafka topic or files)
    stream     scoring job: messages -> console, or history + snapshot + alerts
    compact    append-mode history -> keyed table (latest write per key)
    analyze    latency report from a history table (+ optional CSV of samples)
    freshness  newest reading age and level
    lag        produced vs stored rows
"""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import functions as F


def _spark(args):
    from haze.session import get_spark
    return get_spark("haze-cli", master=args.master,
                     shuffle_partitions=args.shuffle_partitions)


def _print_row(df) -> None:
    row = df.first()
    print(json.dumps({k: (str(v) if v is not None and not isinstance(v, (int, float, bool))
                          else v) for k, v in (row.asDict() if row else {}).items()}))


def cmd_etl(args) -> None:
    from haze.operators.clean import clean_long, pivot_mean, read_raw_readings, split_quarantine
    from haze.operators.clean import write_wide
    spark = _spark(args)
    raw = read_raw_readings(spark, args.input)
    good, bad = split_quarantine(clean_long(raw))
    aside = args.quarantine or f"{args.output.rstrip('/')}_quarantine"
    bad.write.mode("overwrite").parquet(aside)
    n = spark.read.schema(bad.schema).parquet(aside).count()
    print(json.dumps({"bad_datetime": n, "quarantine": aside}))
    params = args.parameters.split(",") if args.parameters else None
    wide = pivot_mean(good, ("location_id", "ts"), params).withColumnRenamed("ts", "datetime")
    write_wide(wide, args.output)


def cmd_densify(args) -> None:
    from haze.operators.densify import densify, jitter, off_grid_rows
    spark = _spark(args)
    wide = spark.read.parquet(args.input)
    if args.off_grid == "drop":
        _print_row(off_grid_rows(wide, step_seconds=args.step))
    dense = densify(wide, step_seconds=args.step, off_grid=args.off_grid,
                    spread_gaps=not args.whole_gaps)
    if args.noise > 0:
        values = [c for c in dense.columns if c not in ("location_id", "datetime")]
        dense = jitter(dense, values, std=args.noise, seed=args.seed)
    dense.write.mode("overwrite").parquet(args.output)


def cmd_publish(args) -> None:
    from haze.streaming.source import encode_readings, publish_readings
    spark = _spark(args)
    df = spark.read.parquet(args.input)
    stamp = F.current_timestamp() if args.restamp else None
    if args.topic:
        opts = {"kafka.bootstrap.servers": args.bootstrap}
        if stamp is not None:
            encode = encode_readings(df, event_time=stamp)
            encode.write.format("kafka").options(**opts).option("topic", args.topic).save()
        else:
            publish_readings(df, args.topic, opts)
    else:
        encode_readings(df, event_time=stamp).select("value") \
            .write.mode("append").text(args.out_dir)


def cmd_stream(args) -> None:
    from haze.streaming.job import scoring_job, scoring_job_append
    from haze.streaming.source import readings_stream
    spark = _spark(args)
    opts = {}
    if args.source == "kafka":
        opts = {"kafka.bootstrap.servers": args.bootstrap, "subscribe": args.topic}
    messages = readings_stream(spark, args.source, args.path, opts,
                               max_per_trigger=args.max_per_trigger)
    trigger = {"availableNow": True} if args.once else {"processingTime": args.trigger}
    if args.mode == "append":
        qs = scoring_job_append(spark, messages, args.history, args.snapshot, args.alerts,
                                checkpoint=args.checkpoint, granularity=args.granularity,
                                trigger=trigger, quarantine_path=args.quarantine)
    else:
        qs = [scoring_job(spark, messages, mode=args.mode, checkpoint=args.checkpoint,
                          history_path=args.history, snapshot_path=args.snapshot,
                          alerts_path=args.alerts, trigger=trigger,
                          granularity=args.granularity, quarantine_path=args.quarantine)]
    for q in qs:
        q.awaitTermination()


def cmd_compact(args) -> None:
    from haze.streaming.job import compact_history
    spark = _spark(args)
    parts = args.partitions.split(",") if args.partitions else None
    compact_history(spark, args.history, args.output, parts, granularity=args.granularity)


def cmd_analyze(args) -> None:
    from haze.operators.history import read_history
    from haze.operators.metrics import latency_samples, latency_summary, write_latency_csv
    spark = _spark(args)
    hist = read_history(spark, args.history, ["datetime", "processed_at"])
    samples = latency_samples(hist, args.as_of, args.window)
    _print_row(latency_summary(samples))
    if args.output:
        write_latency_csv(samples, args.output)


def cmd_freshness(args) -> None:
    from haze.operators.metrics import freshness
    spark = _spark(args)
    _print_row(freshness(spark.read.parquet(args.history), args.as_of, ts_col=args.ts_col))


def cmd_lag(args) -> None:
    from haze.operators.metrics import end_offsets, ingest_lag
    spark = _spark(args)
    if args.topic:
        msgs = spark.read.format("kafka").option("kafka.bootstrap.servers", args.bootstrap) \
            .option("subscribe", args.topic).load()
        produced = end_offsets(msgs)
    else:
        produced = spark.read.text(args.messages).agg(F.count(F.lit(1)).alias("produced"))
    _print_row(ingest_lag(produced, spark.read.parquet(args.history)))


def build_parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="haze")
    p.add_argument("--master", default=None)
    p.add_argument("--shuffle-partitions", type=int, default=None)
    sub = p.add_subparsers(dest="command", required=True)

    s = sub.add_parser("etl")
    s.add_argument("input")
    s.add_argument("output")
    s.add_argument("--parameters", default=None, help="comma list; default: discover")
    s.add_argument("--quarantine", default=None)
    s.set_defaults(fn=cmd_etl)

    s = sub.add_parser("densify")
    s.add_argument("input")
    s.add_argument("output")
    s.add_argument("--step", type=int, default=5)
    s.add_argument("--off-grid", choices=["drop", "snap"], required=True,
                   help="readings off their station's grid: ignored (and counted) or moved onto it")
    s.add_argument("--whole-gaps", action="store_true", help="do not cut long gaps at day bounds")
    s.add_argument("--noise", type=float, default=0.02)
    s.add_argument("--seed", type=int, default=42)
    s.set_defaults(fn=cmd_densify)

    s = sub.add_parser("publish")
    s.add_argument("input")
    s.add_argument("--topic", default=None)
    s.add_argument("--bootstrap", default="localhost:9092")
    s.add_argument("--out-dir", default=None)
    s.add_argument("--restamp", action="store_true", help="stamp messages with now")
    s.set_defaults(fn=cmd_publish)

    s = sub.add_parser("stream")
    s.add_argument("--source", choices=["kafka", "text"], default="kafka")
    s.add_argument("--path", default=None)
    s.add_argument("--bootstrap", default="localhost:9092")
    s.add_argument("--topic", default=None)
    s.add_argument("--mode", choices=["console", "dual", "append"], default="console",
                   help="dual: keyed history upsert; append: exactly-once file sink")
    s.add_argument("--granularity", choices=["day", "hour"], default="day")
    s.add_argument("--checkpoint", default=None)
    s.add_argument("--history", default=None)
    s.add_argument("--snapshot", default=None)
    s.add_argument("--alerts", default=None)
    s.add_argument("--quarantine", default=None,
                   help="folder for messages that cannot be decoded (default: beside the history)")
    s.add_argument("--trigger", default="0 seconds")
    s.add_argument("--max-per-trigger", type=int, default=None)
    s.add_argument("--once", action="store_true", help="process what is there, then stop")
    s.set_defaults(fn=cmd_stream)

    s = sub.add_parser("compact")
    s.add_argument("history", help="append-mode history table")
    s.add_argument("output", help="keyed (deduplicated) table")
    s.add_argument("--partitions", default=None, help="comma list; default: all")
    s.add_argument("--granularity", choices=["day", "hour"], default="day")
    s.set_defaults(fn=cmd_compact)

    s = sub.add_parser("analyze")
    s.add_argument("history")
    s.add_argument("--as-of", required=True)
    s.add_argument("--window", type=int, default=60, help="minutes")
    s.add_argument("--output", default=None)
    s.set_defaults(fn=cmd_analyze)

    s = sub.add_parser("freshness")
    s.add_argument("history")
    s.add_argument("--as-of", required=True)
    s.add_argument("--ts-col", default="event_ts")
    s.set_defaults(fn=cmd_freshness)

    s = sub.add_parser("lag")
    s.add_argument("history")
    s.add_argument("--topic", default=None)
    s.add_argument("--bootstrap", default="localhost:9092")
    s.add_argument("--messages", default=None, help="message files instead of a topic")
    s.set_defaults(fn=cmd_lag)
    return p


def main(argv=None) -> None:
    args = build_parser().parse_args(argv)
    args.fn(args)


if __name__ == "__main__":
    main(sys.argv[1:])
