"""Physical-plan audit of every registered query (run: python tests/plan_audit.py).

Prints, per query: parquet scans of the driver tables, hash/range shuffles,
single-partition exchanges, nested-loop joins, windows, Python nodes and
subqueries, from the planned (pre-AQE) physical plan at sf0.001.  Queries
that write tables while being built (upserts, streams) are skipped.
"""

import os
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

WRITERS = {"history_upsert", "stream_score", "stream_latest", "stream_dedup", "stream_window"}


def main(sf_dir="/root/testdata/sf0.001"):
    from __spark_entry__ import queries
    from haze.session import get_spark
    spark = get_spark(master="local[4]", shuffle_partitions=8)
    spark.sparkContext.setLogLevel("ERROR")
    print("| query | driver-table scans | shuffles | single-partition | nested-loop joins "
          "| windows | python | subqueries |")
    print("|---|---|---|---|---|---|---|---|")
    for name, fn in queries().items():
        if name in WRITERS:
            continue
        plan = fn(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
        lines = plan.split("\n")
        scans = sum(1 for ln in lines if "FileScan parquet" in ln and "testdata" in ln)
        shuffles = plan.count("Exchange hashpartitioning") + plan.count("Exchange rangepartitioning")
        print(f"| {name} | {scans} | {shuffles} | {plan.count('SinglePartition')} "
              f"| {plan.count('BroadcastNestedLoopJoin')} | {plan.count('Window [')} "
              f"| {plan.count('Python')} | {plan.count('Subquery')} |")


if __name__ == "__main__":
    main(*sys.argv[1:])
