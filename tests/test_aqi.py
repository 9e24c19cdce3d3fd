import math
import random
from bisect import bisect
from decimal import Decimal
from fractions import Fraction

from pyspark.sql import functions as F

from paths import SF01
from haze.functions import aqi

# FIXTURES.md section 2: c, PM2.5 f64, PM2.5 f32, PM10 f64, PM10 f32.
GOLDEN = [
    (None, 0, 0, 0, 0), (float("nan"), 0, 0, 0, 0), (-1, 0, 0, 0, 0), (0, 0, 0, 0, 0),
    (0.25, 0, 0, 0, 0), (0.75, 2, 2, 1, 1), (12.5, 25, 25, 12, 12), (25, 50, 50, 25, 25),
    (25.05, 0, 0, 25, 25), (25.1, 51, 51, 25, 25), (37.5, 75, 75, 38, 38),
    (50, 100, 100, 50, 50), (50.05, 0, 0, 0, 0), (50.1, 101, 0, 51, 0), (75, 125, 125, 75, 75),
    (100, 150, 150, 100, 100), (100.1, 151, 0, 101, 0), (125, 175, 175, 113, 113),
    (150, 200, 200, 125, 125), (150.1, 201, 201, 126, 126), (200, 250, 250, 150, 150),
    (250, 300, 300, 175, 175), (250.1, 301, 301, 176, 176), (300, 350, 350, 200, 200),
    (350, 400, 400, 250, 250), (350.1, 401, 401, 251, 251), (425, 450, 450, 326, 326),
    (500, 500, 500, 400, 400), (500.05, 500, 500, 0, 0), (550, 500, 500, 450, 450),
    (600, 500, 500, 500, 500), (600.1, 500, 500, 500, 500), (1000, 500, 500, 500, 500),
    (float("inf"), 500, 500, 500, 500),
]


# The published tables once more, as exact decimals.
SPEC = {
    "pm25": (["0", "25.1", "50.1", "100.1", "150.1", "250.1", "350.1"],
             ["25", "50", "100", "150", "250", "350", "500"], "500"),
    "pm10": (["0", "50.1", "100.1", "200.1", "300.1", "400.1", "500.1"],
             ["50", "100", "200", "300", "400", "500", "600"], "600"),
}
STEPS = [0, 50, 100, 150, 200, 300, 400, 500]


def exact_index(c, pollutant):
    """The written specification in exact arithmetic: interpolate inside the
    bracket that holds ``c``, half to even; 0 between brackets, below them and
    for a missing value."""
    if c is None:
        return 0
    lows, highs, cap = ([Decimal(x) for x in v] if isinstance(v, list) else Decimal(v)
                        for v in SPEC[pollutant])
    x = Decimal(repr(c))
    if x > cap:
        return 500
    at = bisect(lows, x) - 1
    if at < 0 or x > highs[at]:
        return 0
    base = STEPS[at] + (1 if at else 0)
    share = Fraction(x - lows[at]) / Fraction(highs[at] - lows[at])
    return round(base + share * (STEPS[at + 1] - base))


def _half(c, pollutant):
    """1 where the exact index lies on a half, which doubles may round either way."""
    if c is None:
        return 0
    lows, highs, _ = SPEC[pollutant]
    at = bisect([Decimal(x) for x in lows], Decimal(repr(c))) - 1
    if at < 0 or Decimal(repr(c)) > Decimal(highs[at]):
        return 0
    base = STEPS[at] + (1 if at else 0)
    share = Fraction(Decimal(repr(c)) - Decimal(lows[at])) / Fraction(Decimal(highs[at]) - Decimal(lows[at]))
    return int((base + share * (STEPS[at + 1] - base)) % 1 == Fraction(1, 2))


def test_golden_vectors(spark):
    rows = [(None if c is None else float(c),) for c, *_ in GOLDEN]
    df = spark.createDataFrame(rows, "c double").withColumn("f", F.col("c").cast("float"))
    out = df.select(aqi.aqi_pm25("c").alias("a"), aqi.aqi_pm25("f").alias("b"),
                    aqi.aqi_pm10("c").alias("x"), aqi.aqi_pm10("f").alias("y")).collect()
    for (c, p25, p25f, p10, p10f), r in zip(GOLDEN, out):
        assert (r.a, r.b, r.x, r.y) == (p25, p25f, p10, p10f), c


def test_differential_random(spark):
    rng = random.Random(7)
    vals = [round(rng.uniform(-5, 700), rng.choice([0, 1, 2, 3])) for _ in range(3000)]
    vals += [b.c_low for b in aqi.PM25.brackets] + [b.c_high for b in aqi.PM10.brackets]
    df = spark.createDataFrame([(v,) for v in vals], "c double")
    got = df.select("c", aqi.aqi_pm25("c").alias("a"), aqi.aqi_pm10("c").alias("b")).collect()
    for r in got:
        assert abs(r.a - exact_index(r.c, "pm25")) <= _half(r.c, "pm25")
        assert abs(r.b - exact_index(r.c, "pm10")) <= _half(r.c, "pm10")
        assert 0 <= r.a <= 500 and 0 <= r.b <= 500


def test_overall_and_labels(spark):
    df = spark.createDataFrame([(None, None), (10, None), (60, 120), (301, 5)], "a int, b int")
    out = [r.o for r in df.select(aqi.overall("a", "b").alias("o")).collect()]
    assert out == [0, 10, 120, 301]
    idx = spark.createDataFrame([(v,) for v in [None, -3, 0, 50, 51, 100, 101, 150, 151, 200,
                                                201, 300, 301, 500]], "a int")
    got = idx.select(aqi.quality("a").alias("f"), aqi.quality("a", "short").alias("s"),
                     aqi.aqi_color("a").alias("c")).collect()
    want_full = [aqi.QUALITY_FULL[i] for i in [5, 0, 0, 0, 1, 1, 2, 2, 3, 3, 4, 4, 5, 5]]
    want_short = ["N/A"] + [aqi.QUALITY_SHORT[i] for i in [0, 0, 0, 1, 1, 2, 2, 3, 3, 4, 4, 5, 5]]
    assert [r.f for r in got] == want_full
    assert [r.s for r in got] == want_short
    assert got[0].c == aqi.NULL_COLOR and got[4].c == "#FFFF00" and got[-1].c == "#7E0023"


def test_policies(spark):
    df = spark.createDataFrame([(25.05,), (None,), (float("nan"),)], "c double")
    r = df.select(aqi.aqi_pm25("c", gap_policy="continuous").alias("g"),
                  aqi.aqi_pm25("c", null_policy="null").alias("n")).collect()
    assert r[0].g == 50 and r[1].n is None and r[2].n is None


def test_sql_functions_match_columns(spark):
    aqi.register_sql_functions(spark)
    vals = [(float(v),) for v in [0.25, 25.05, 50.1, 123.4, 499.9, 650.0]] + [(None,)]
    spark.createDataFrame(vals, "c double").createOrReplaceTempView("t_sqlfn")
    got = spark.sql("SELECT aqi_pm25(c) a, aqi_pm10(c) b, "
                    "aqi_quality(aqi_overall(aqi_pm25(c), aqi_pm10(c))) q FROM t_sqlfn").collect()
    want = spark.table("t_sqlfn").select(
        aqi.aqi_pm25("c").alias("a"), aqi.aqi_pm10("c").alias("b"),
        aqi.quality(aqi.overall(aqi.aqi_pm25("c"), aqi.aqi_pm10("c"))).alias("q")).collect()
    assert got == want
    plan = spark.sql("SELECT aqi_pm25(c) FROM t_sqlfn")._jdf.queryExecution() \
        .executedPlan().toString()
    assert "PythonUDF" not in plan and "BatchEvalPython" not in plan


def test_score_by_table_equals_native(spark):
    from haze.operators.score import breakpoint_frame, score_by_table
    vals = [(float(v),) for v in [0, 0.25, 25.05, 50.1, 100.1, 333.3, 500.05, 599, 700]]
    vals += [(None,), (float("nan"),)]
    df = spark.createDataFrame(vals, "c double")
    bp = breakpoint_frame(spark)
    got = score_by_table(df, "c", "pm10", bp).select("c", "aqi_pm10")
    want = df.select("c", aqi.aqi_pm10("c").alias("aqi_pm10"))
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    assert "BroadcastNestedLoopJoin" in got._jdf.queryExecution().executedPlan().toString()


def test_anchor_sf001(spark):
    from haze.sources import tables
    r = aqi.score(tables.readings(spark, SF01))
    assert r.count() == 10000
    assert r.agg(F.sum("aqi_pm25")).first()[0] == 813757
    by_level = dict(r.groupBy(aqi.quality("aqi_pm25").alias("q")).count().collect())
    assert [by_level.get(q, 0) for q in aqi.QUALITY_FULL] == [3926, 2418, 2344, 841, 411, 60]


def test_no_python_in_scoring_plan(spark):
    from haze.sources import tables
    plan = aqi.score(tables.readings(spark, SF01))._jdf.queryExecution().executedPlan().toString()
    assert "WholeStageCodegen" in plan or "*(" in plan
    assert "BatchEvalPython" not in plan and "ArrowEvalPython" not in plan
    assert not math.isnan(0.0)
