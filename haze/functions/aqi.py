"""Air-quality index scoring as native Catalyst expressions.

Every function returns a ``Column`` built from ``when``/``rint``/``greatest``
so scoring stays inside whole-stage codegen: no Python worker, no UDF
barrier, and filters around it still push down.  The same bracket tables
also render as SQL text (:func:`sub_index_sql`) for ``CREATE TEMPORARY
FUNCTION`` and for the DuckDB oracle, so there is exactly one source of
truth for the constants.

Semantics kept on purpose (see SURVEY quirks Q1-Q6):

* brackets are closed ``[c_low, c_high]``; a value in a gap between two
  brackets (e.g. 25.05) scores 0 under ``gap_policy="reference"``;
* NaN, null and negative concentrations score 0 (``null_policy="zero"``);
* rounding is half-to-even (``rint``), not Spark's HALF_UP ``round``;
* float inputs are widened to double before the comparison, so 50.1f
  (50.09999847...) falls in the gap exactly as in the reference.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

ColumnOrName = Column | str


@dataclass(frozen=True)
class Bracket:
    c_low: float
    c_high: float
    i_low: int
    i_high: int

    @property
    def slope(self) -> float:
        return (self.i_high - self.i_low) / (self.c_high - self.c_low)


@dataclass(frozen=True)
class Standard:
    """A pollutant's bracket table plus the concentration above which the
    index is capped at ``index_cap``."""

    name: str
    brackets: tuple[Bracket, ...]
    cap_above: float
    index_cap: int = 500


def _table(rows):
    return tuple(Bracket(*r) for r in rows)


# Concentration brackets (ug/m3) -> index range, in order.
# PM2.5: (0.0, 25.0, 0, 50), (25.1, 50.0, 51, 100), (50.1, 100.0, 101, 150),
# (100.1, 150.0, 151, 200), (150.1, 250.0, 201, 300), (250.1, 350.0, 301, 400),
# (350.1, 500.0, 401, 500); above 500.0 the index is 500.
PM25 = Standard(
    "pm25",
    _table([
        (0.0, 25.0, 0, 50),
        (25.1, 50.0, 51, 100),
        (50.1, 100.0, 101, 150),
        (100.1, 150.0, 151, 200),
        (150.1, 250.0, 201, 300),
        (250.1, 350.0, 301, 400),
        (350.1, 500.0, 401, 500),
    ]),
    cap_above=500.0,
)

# PM10 brackets, in order; above 600.0 the index is 500.
PM10 = Standard(
    "pm10",
    _table([
        (0.0, 50.0, 0, 50),
        (50.1, 100.0, 51, 100),
        (100.1, 200.0, 101, 150),
        (200.1, 300.0, 151, 200),
        (300.1, 400.0, 201, 300),
        (400.1, 500.0, 301, 400),
        (500.1, 600.0, 401, 500),
    ]),
    cap_above=600.0,
)

STANDARDS = {"pm25": PM25, "pm10": PM10}

# Level upper bounds (inclusive) and their labels, in order.
LEVEL_BOUNDS = [50, 100, 150, 200, 300]
QUALITY_FULL = [
    "Tốt (Good)",
    "Trung bình (Moderate)",
    "Kém (Unhealthy for Sensitive)",
    "Xấu (Unhealthy)",
    "Rất Xấu (Very Unhealthy)",
    "Nguy hại (Hazardous)",
]
QUALITY_SHORT = ["Tốt", "Trung bình", "Kém", "Xấu", "Rất xấu", "Nguy hại"]
LEVEL_COLORS = ["#00E400", "#FFFF00", "#FF7E00", "#FF0000", "#8F3F97", "#7E0023"]
NULL_COLOR = "#CCCCCC"
NULL_LABEL = "N/A"

# Raw PM2.5 three-level status (< 50, > 150, else).
PM25_STATUS = ["Tốt", "Trung bình", "Nguy hại"]

# Alert severities, strictly above the threshold.
SEVERITY_DANGER = 200
SEVERITY_WARNING = 150


def _col(c: ColumnOrName) -> Column:
    return F.col(c) if isinstance(c, str) else c


def sub_index(
    c: ColumnOrName,
    standard: Standard | str = PM25,
    gap_policy: str = "reference",
    null_policy: str = "zero",
) -> Column:
    """Sub-index of one pollutant concentration, IntegerType."""
    std = STANDARDS[standard] if isinstance(standard, str) else standard
    # try_cast: text that is not a number scores as missing instead of
    # failing the job under ANSI; numeric inputs convert exactly as cast.
    x = _col(c).try_cast("double")
    missing = F.lit(0) if null_policy == "zero" else F.lit(None).cast("int")
    expr = F.when(x.isNull(), missing).when(F.isnan(x), missing)
    brackets = std.brackets
    for i, b in enumerate(brackets):
        if gap_policy == "continuous" and i + 1 < len(brackets):
            inside = (x >= F.lit(b.c_low)) & (x < F.lit(brackets[i + 1].c_low))
        else:
            inside = (x >= F.lit(b.c_low)) & (x <= F.lit(b.c_high))
        value = F.lit(b.slope) * (x - F.lit(b.c_low)) + F.lit(b.i_low)
        expr = expr.when(inside, F.rint(value).cast("int"))
    return expr.when(x > F.lit(std.cap_above), F.lit(std.index_cap)).otherwise(F.lit(0))


def aqi_pm25(c: ColumnOrName, **kw) -> Column:
    return sub_index(c, PM25, **kw)


def aqi_pm10(c: ColumnOrName, **kw) -> Column:
    return sub_index(c, PM10, **kw)


def overall(*parts: ColumnOrName, null_policy: str = "zero") -> Column:
    """Overall index = the largest sub-index.  ``null_policy="zero"``: a missing
    part counts as 0; ``"null"``: missing parts are passed over, and the index is
    null if all are missing."""
    if null_policy == "null":
        return F.greatest(*[_col(p) for p in parts]) if len(parts) > 1 else _col(parts[0])
    return F.greatest(*[F.coalesce(_col(p), F.lit(0)) for p in parts]) if len(parts) > 1 \
        else F.coalesce(_col(parts[0]), F.lit(0))


def _level_slots(labels: list) -> tuple[int, list]:
    """Level lookup table built from ``LEVEL_BOUNDS``: with ``step`` the
    common divisor of the bounds, slot k holds the label of the first level
    whose bound is >= k * step, so label(x) = slot[ceil(x / step)]."""
    step = 0
    for b in LEVEL_BOUNDS:
        step = math.gcd(step, b)
    slots = []
    for k in range(LEVEL_BOUNDS[-1] // step + 2):
        slots.append(next((lab for b, lab in zip(LEVEL_BOUNDS, labels) if k * step <= b),
                          labels[-1]))
    return step, slots


def _level_chain(c: Column, labels: list, null_value=None) -> Column:
    """Label of a level, reading ``c`` exactly once.

    A ``when`` chain would reference the index five times; once a filter on
    the label is pushed below the scoring projection, Catalyst inlines the
    whole bracket expression into every reference and the generated code
    grows past the JIT limit (measured 17x slower).  One array lookup keeps
    it to a single reference.  NaN ranks above every bound, as in SQL."""
    step, slots = _level_slots(labels)
    x = F.nanvl(c.cast("double"), F.lit(float("inf")))
    k = F.least(F.greatest(F.ceil(x / F.lit(float(step))), F.lit(0)), F.lit(len(slots) - 1))
    label = F.element_at(F.array(*[F.lit(s) for s in slots]), (k + 1).cast("int"))
    # The null branch is folded away by Catalyst when ``c`` cannot be null
    # (a scored AQI is greatest(coalesce(..., 0), ...)), keeping one reference.
    missing = F.lit(labels[-1] if null_value is None else null_value)
    return F.when(c.isNull(), missing).otherwise(label)


def quality(c: ColumnOrName, style: str = "full") -> Column:
    """Level label.  ``full``: the scoring job's bilingual text, null AQI falls
    to the last level as in the job.  ``short``: the dashboard text, null AQI
    gives ``N/A``."""
    x = _col(c)
    if style == "full":
        return _level_chain(x, QUALITY_FULL)
    return _level_chain(x.cast("double"), QUALITY_SHORT, null_value=NULL_LABEL)


def aqi_color(c: ColumnOrName) -> Column:
    return _level_chain(_col(c).cast("double"), LEVEL_COLORS, null_value=NULL_COLOR)


def pm25_status(c: ColumnOrName) -> Column:
    """Three-level status from raw PM2.5: < 50, > 150, else (null -> null)."""
    x = _col(c)
    return (F.when(x < 50, F.lit(PM25_STATUS[0]))
            .when(x > 150, F.lit(PM25_STATUS[2]))
            .when(x.isNotNull(), F.lit(PM25_STATUS[1])))


def severity(c: ColumnOrName) -> Column:
    """``danger`` above 200, ``warning`` above 150, otherwise null."""
    x = _col(c)
    return (F.when(x > SEVERITY_DANGER, F.lit("danger"))
            .when(x > SEVERITY_WARNING, F.lit("warning")))


def score(df, pm25: str = "pm25", pm10: str = "pm10", **kw):
    """Add ``aqi_pm25``, ``aqi_pm10``, ``aqi`` and ``quality`` in one
    projection (one ``withColumns`` keeps a single Project node)."""
    a25 = aqi_pm25(pm25, **kw)
    a10 = aqi_pm10(pm10, **kw)
    policy = kw.get("null_policy", "zero")
    return df.withColumns({"aqi_pm25": a25, "aqi_pm10": a10}).withColumns(
        {"aqi": overall("aqi_pm25", "aqi_pm10", null_policy=policy)}
    ).withColumns({"quality": _scored_quality(policy)})


def _scored_quality(policy: str) -> Column:
    """Label of ``aqi``; without an index there is none to give (``N/A``)."""
    if policy == "null":
        return F.when(F.col("aqi").isNull(), F.lit(NULL_LABEL)).otherwise(quality("aqi"))
    return quality("aqi")


def score_many(df, standards: dict[str, Standard], **kw):
    """Score any number of pollutants; ``aqi`` is the maximum of all parts."""
    parts = {f"aqi_{col}": sub_index(col, std, **kw) for col, std in standards.items()}
    out = df.withColumns(parts)
    policy = kw.get("null_policy", "zero")
    out = out.withColumns({"aqi": overall(*parts.keys(), null_policy=policy)})
    return out.withColumns({"quality": _scored_quality(policy)})


# ---------------------------------------------------------------- SQL text

def float_literal(x: float) -> str:
    """A double literal both Spark SQL and DuckDB parse as DOUBLE, exactly."""
    text = repr(float(x))
    return text if "e" in text or "inf" in text or "nan" in text else text + "E0"


def sub_index_sql(expr: str, standard: Standard | str = PM25, dialect: str = "spark") -> str:
    """The ``gap_policy="reference"`` sub-index as a SQL CASE expression."""
    std = STANDARDS[standard] if isinstance(standard, str) else standard
    rint = "rint({})" if dialect == "spark" else "round_even({}, 0)"
    x = f"CAST({expr} AS DOUBLE)"
    parts = [f"CASE WHEN {x} IS NULL THEN 0 WHEN isnan({x}) THEN 0"]
    for b in std.brackets:
        lo, hi = float_literal(b.c_low), float_literal(b.c_high)
        value = f"{float_literal(b.slope)} * ({x} - {lo}) + {b.i_low}"
        parts.append(
            f"WHEN {x} >= {lo} AND {x} <= {hi} THEN CAST({rint.format(value)} AS INTEGER)")
    parts.append(f"WHEN {x} > {float_literal(std.cap_above)} THEN {std.index_cap} ELSE 0 END")
    return " ".join(parts)


def quality_sql(expr: str) -> str:
    whens = " ".join(
        f"WHEN {expr} <= {b} THEN '{label}'" for b, label in zip(LEVEL_BOUNDS, QUALITY_FULL))
    return f"CASE {whens} ELSE '{QUALITY_FULL[-1]}' END"


def register_sql_functions(spark: SparkSession) -> list[str]:
    """Register ``aqi_pm25``, ``aqi_pm10``, ``aqi_overall`` and ``aqi_quality``
    as SQL functions.  They are SQL-bodied (``RETURN <expr>``), so Catalyst
    inlines them and no Python runs at execution time."""
    stmts = {
        "aqi_pm25": f"(c DOUBLE) RETURNS INT RETURN {sub_index_sql('c', PM25)}",
        "aqi_pm10": f"(c DOUBLE) RETURNS INT RETURN {sub_index_sql('c', PM10)}",
        "aqi_overall": "(a INT, b INT) RETURNS INT RETURN greatest(coalesce(a, 0), coalesce(b, 0))",
        "aqi_quality": f"(a INT) RETURNS STRING RETURN {quality_sql('a')}",
    }
    for name, body in stmts.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}{body}")
    return list(stmts)
