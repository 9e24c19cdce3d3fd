"""Changing column types, numbering and order checks, printed numbers, pruned lookups."""

import datetime as dt
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from pyspark.sql import types as T

from haze.functions.values import two_decimals
from haze.operators import history as H
from haze.operators import metrics as M
from haze.operators.ordinal import global_ordinal, order_report, running_rate
from haze.operators.types import TypeChange, merged_schema, read_as, wider
from haze.streaming.progress import produced

T0 = dt.datetime(2025, 1, 1)


def rows(spark, data, types):
    at = lambda d: T0 + dt.timedelta(days=d)
    return spark.createDataFrame([(k, str(at(d)), at(d), v, at(d + p)) for k, d, v, p in data],
                                 f"location_id {types[0]}, datetime string, event_ts timestamp, v {types[1]}, processed_at timestamp")


# ---------------------------------------------------------------- types

@pytest.mark.parametrize("a,b,want", [
    ("int", "int", "int"), ("int", "bigint", "bigint"), ("tinyint", "smallint", "smallint"), ("float", "double", "double"),
    ("int", "float", "double"), ("smallint", "double", "double"), ("bigint", "double", "string"), ("string", "int", "string"),
    ("date", "timestamp", "string"), ("boolean", "int", "string"), ("void", "date", "date"), ("int", "void", "int"),
    ("decimal(10,2)", "decimal(8,4)", "decimal(12,4)"), ("decimal(38,0)", "decimal(38,10)", "string"),
    ("array<int>", "array<int>", "array<int>")])
def test_wider(a, b, want):
    kind = lambda t: T.NullType() if t == "void" else T._parse_datatype_string(t)
    assert wider(kind(a), kind(b)).simpleString() == want
    if "void" not in (a, b):
        assert wider(kind(b), kind(a)).simpleString() == want


def test_no_common_type():
    with pytest.raises(TypeChange, match="column a"):
        merged_schema(T._parse_datatype_string("a array<int>"), T._parse_datatype_string("a string"))
    assert read_as(T.IntegerType(), T.LongType()) and not read_as(T.LongType(), T.IntegerType())
    assert not read_as(T.IntegerType(), T.StringType())


def test_types_change_step_by_step(spark, tmp_dir):
    """int, bigint, text, int again: one column through all of them, in a keyed table."""
    path = f"{tmp_dir}/t"
    H.upsert_history(spark, rows(spark, [(1, 0, 1, 0), (2, 0, 2, 0), (3, 5, 3, 0)], ("int", "int")), path)
    H.upsert_history(spark, rows(spark, [(1, 0, 1 << 40, 1), (4, 1, 4, 0)], ("int", "bigint")), path)
    assert dict(H.read_history(spark, path).dtypes)["v"] == "bigint"
    H.upsert_history(spark, rows(spark, [(2, 0, "two", 1), (5, 1, None, 0)], ("bigint", "string")), path)
    H.upsert_history(spark, rows(spark, [(3, 5, 33, 1)], ("int", "int")), path)
    got = H.read_history(spark, path)
    assert {(r.location_id, r.v) for r in got.collect()} == {(1, str(1 << 40)), (2, "two"), (3, "33"), (4, "4"), (5, None)}
    assert got.where("v = '33' and location_id = 3").count() == 1
    assert {r.location_id for r in H.history_query(got, station=1).collect()} == {1}


def test_appends_of_all_epochs_add_up(spark, tmp_dir):
    path = f"{tmp_dir}/t"
    for value, kind in ((1, "int"), (2.5, "float"), (3.5, "double"), ("x", "string"), (5, "int")):
        H.append_history(rows(spark, [(1, 0, value, 0)], ("int", kind)), path)
    got = H.read_history(spark, path)
    assert sorted(r.v for r in got.collect()) == ["1.0", "2.5", "3.5", "5", "x"]


def test_refused_batch_leaves_the_table_as_it_was(spark, tmp_dir):
    path = f"{tmp_dir}/t"
    H.upsert_history(spark, rows(spark, [(1, 0, 1, 0)], ("int", "int")), path)
    with pytest.raises(TypeChange):
        H.upsert_history(spark, rows(spark, [(1, 0, "text", 1)], ("int", "string")), path, on_type_change="fail")
    with pytest.raises(TypeChange):
        H.append_history(rows(spark, [(1, 0, [1], 1)], ("int", "array<int>")), path)
    got = H.read_history(spark, path)
    assert [(r.location_id, r.v) for r in got.collect()] == [(1, 1)] and dict(got.dtypes)["v"] == "int"
    H.upsert_history(spark, rows(spark, [(2, 0, 2, 0)], ("int", "int")), path)
    assert H.read_history(spark, path).count() == 2


def test_table_without_a_note_gets_one(spark, tmp_dir):
    path = f"{tmp_dir}/t"
    H.with_partition(rows(spark, [(1, 0, 1, 0), (2, 3, 2, 0)], ("int", "int"))).withColumn("old", F.lit("o")) \
        .write.partitionBy("event_date").parquet(path)
    H.upsert_history(spark, rows(spark, [(1, 0, "t", 1)], ("int", "string")), path)
    assert {(r.location_id, r.v, r.old) for r in H.read_history(spark, path).collect()} == {(1, "t", None), (2, "2", "o")}


# ---------------------------------------------------------------- order

def test_global_ordinal_is_dense_and_even(spark):
    rng = random.Random(3)
    # half of all rows share one instant: the tie column splits them
    data = [(0 if rng.random() < 0.5 else rng.randrange(1000), i) for i in range(8000)] + [(None, -1)]
    df = spark.createDataFrame(data, "t long, i long").repartition(5)
    out = global_ordinal(df, ["t", "i"], partitions=8)
    got = [(r.t, r.i) for r in sorted(out.collect(), key=lambda r: r.ordinal)]
    assert got == sorted(data, key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    assert {r.ordinal for r in out.select("ordinal").collect()} == set(range(1, 8002))
    sizes = [r["count"] for r in df.repartitionByRange(8, "t", "i").groupBy(F.spark_partition_id()).count().collect()]
    assert max(sizes) < 2 * sorted(sizes)[len(sizes) // 2]


def test_running_rate(spark):
    df = spark.createDataFrame([(T0 + dt.timedelta(seconds=i // 2), i) for i in range(10)] + [(None, 99)], "ts timestamp, i int")
    got = {r.ordinal: (r.elapsed, r.rate) for r in running_rate(df, "ts", every=2, tie=["i"]).collect()}
    assert got == {2: (0.0, None), 4: (1.0, 4.0), 6: (2.0, 3.0), 8: (3.0, 8 / 3), 10: (4.0, 2.5)}
    assert running_rate(df.limit(0), "ts").collect() == []
    with pytest.raises(ValueError):
        running_rate(df, "ts", every=0)


def test_order_report_finds_one_row_out_of_place(spark, tmp_dir):
    good = [None, 1, 1, 2, 5, 8, 13, 21]
    for name, values, n in (("good", good, 3), ("swap", [*good[:5], 4, *good[5:]], 1), ("empty", [], 1)):
        spark.createDataFrame([(v,) for v in values], "v int").repartitionByRange(n, "v").sortWithinPartitions("v").write.parquet(f"{tmp_dir}/{name}-0") \
            if name == "good" else spark.createDataFrame([(v,) for v in values], "v int").coalesce(1).write.parquet(f"{tmp_dir}/{name}-0")
        report = order_report(spark.read.parquet(f"{tmp_dir}/{name}-0"), ["v"]).first()
        assert (report.rows, report.ordered, report.inside) == (len(values), name != "swap", int(name == "swap"))
    back = spark.createDataFrame([(v,) for v in range(100)], "v int").repartitionByRange(4, F.desc("v")).sortWithinPartitions("v")
    back.write.parquet(f"{tmp_dir}/back")
    found = spark.read.parquet(f"{tmp_dir}/back")
    assert order_report(found, ["v"]).first().between == 3
    assert order_report(found, ["v"], across_files=False).first().ordered


# ---------------------------------------------------------------- small repairs

@settings(max_examples=8, deadline=None)
@given(st.lists(st.one_of(st.floats(min_value=-1e6, max_value=1e6), st.integers(-10**6, 10**6).map(lambda n: n / 8),
                          st.integers(-10**5, 10**5).map(lambda n: n / 1000 + 0.005), st.sampled_from([2.675, 0.125, 1.005, -0.0, 0.0, 1e12 + 0.005])),
                min_size=20, max_size=200))
def test_two_decimals_prints_as_python(spark, values):
    df = spark.createDataFrame([(float(v),) for v in values], "x double")
    got = [(r.x, r.t) for r in df.select("x", two_decimals(F.col("x")).alias("t")).collect()]
    assert [t for _, t in got] == [f"{x:.2f}" for x, _ in got]


def test_histogram_leaves_infinite_values_out(spark):
    inf = float("inf")
    df = spark.createDataFrame([(x,) for x in (0.0, 1.0, 2.0, inf, -inf, float("nan"), None)], "latency double")
    got = {r.bin: r["count"] for r in M.histogram(df, bins=2).collect()}
    assert got == {1: 1, 2: 2}
    assert tuple(M.without_bin(df).first()) == (3, 1, 1, 2)


def test_csv_paths_with_blanks(spark, tmp_dir):
    from haze.operators.clean import read_raw_readings
    root = f"{tmp_dir}/a folder/with +100%"
    spark.createDataFrame([(1, "2025-01-01T00:00:00Z", "pm25", 3.5)], "location_id long, datetime string, parameter string, value double") \
        .write.option("header", True).csv(f"{root}/month=1")
    assert [(r.location_id, r.value) for r in read_raw_readings(spark, root).collect()] == [(1, 3.5)]


def test_produced_from_progress():
    assert produced('{"t": {"0": 5, "1": 7}}') == 12
    assert produced("3") is None and produced(None) is None


def scanned(df) -> int:
    """Rows that the Parquet scan of a plan without shuffles handed on."""
    df.collect()
    leaf = df._jdf.queryExecution().executedPlan().collectLeaves().head()
    return leaf.metrics().apply("numOutputRows").value()


def test_clustered_history_reads_fewer_rows(spark, tmp_dir):
    rng = random.Random(5)
    data = [(rng.randrange(0, 4000, 2), T0 + dt.timedelta(seconds=i), rng.choice("abcdef")) for i in range(60_000)]
    df = spark.createDataFrame(data, "location_id long, event_ts timestamp, quality string").repartition(1)
    H.with_partition(df).write.partitionBy("event_date").parquet(f"{tmp_dir}/plain")
    H.clustered_write(df, f"{tmp_dir}/laid", group_bytes=1 << 15, distinct=4000)
    plain, laid = (H.read_history(spark, f"{tmp_dir}/{n}") for n in ("plain", "laid"))
    assert laid.count() == plain.count() == len(data)
    for kw in ({"station": 1000}, {"quality": "c"}, {"station": 1000, "quality": "c"}):
        a, b = (H.history_query(t, **kw).select("location_id", "quality") for t in (plain, laid))
        assert sorted(a.collect()) == sorted(b.collect())
        assert scanned(b) < 0.5 * scanned(a), (kw, scanned(b), scanned(a))
    # an odd station lies inside the stored range, but in no row: Bloom filters rule it out
    assert scanned(H.history_query(laid, station=1001)) == 0


def test_notes_are_appended_and_the_newest_holds(spark, tmp_path):
    """A reader meets the old note or the new one, never none; a batch that changes nothing adds none."""
    path = str(tmp_path / "noted")
    first = spark.createDataFrame([(1, "2025-01-01 00:00:00", 1, 5.0)], "location_id int, t string, n int, v double")
    later = spark.createDataFrame([(1, "2025-01-01 00:00:00", 1 << 40, 6.0, "x")], "location_id int, t string, n long, v double, extra string")
    for df in (first, first, later, later, first):
        batch = df.select("*", F.col("t").cast("timestamp").alias("event_ts"), F.lit(1).alias("processed_at"))
        H.upsert_history(spark, batch, path, keys=["location_id", "event_ts"])
    notes = spark.read.parquet(f"{path}/_schema")
    assert sorted(r.version for r in notes.collect()) == list(range(notes.count())) and notes.count() >= 2
    note = H.read_note(spark, path)
    assert note.version == notes.count() - 1
    assert {"extra", "n"} <= set(note.schema.names) and note.schema["n"].dataType.simpleString() == "bigint"
    assert H.read_history(spark, path).count() == 1


def test_a_batch_full_of_copies_is_merged_once(spark, tmp_path):
    """The newest row per key survives, whatever the copies in the batch and the rows stored."""
    path = str(tmp_path / "copies")
    for lo in (0, 50):
        rows = spark.range(2000, numPartitions=5).select(
            (F.col("id") % 10).cast("int").alias("location_id"), F.expr("timestamp_seconds(86400 * (id % 3))").alias("event_ts"),
            (F.col("id") + lo).alias("processed_at"), (F.col("id") * 2.0).alias("v"))
        H.upsert_history(spark, rows, path, keys=["location_id", "event_ts"])
    got = {(r.location_id, r.event_ts): r.processed_at for r in H.read_history(spark, path).collect()}
    want = {}
    for i in range(2000):
        key = (i % 10, i % 3)
        want[key] = max(want.get(key, -1), i + 50)
    assert sorted(got.values()) == sorted(want.values()) and len(got) == 30
