"""DuckDB SQL twins of the views in :mod:`haze.sources.tables`.

Each registered query's oracle is ``with_views(<body>)``: the body reads
the CTEs below, which restate the view definitions over the pre-registered
driver tables.  The scoring constants are written out here a second time: a
wrong one in the library shows as a difference.
"""

from __future__ import annotations

from haze.sources import tables as T

# Fixed values: (c_low, c_high, index_low, index_high) and, last, the
# concentration above which the index is 500.
INDEX = {
    "pm25": ([("0.0", "25.0", 0, 50), ("25.1", "50.0", 51, 100), ("50.1", "100.0", 101, 150),
              ("100.1", "150.0", 151, 200), ("150.1", "250.0", 201, 300),
              ("250.1", "350.0", 301, 400), ("350.1", "500.0", 401, 500)], "500.0"),
    "pm10": ([("0.0", "50.0", 0, 50), ("50.1", "100.0", 51, 100), ("100.1", "200.0", 101, 150),
              ("200.1", "300.0", 151, 200), ("300.1", "400.0", 201, 300),
              ("400.1", "500.0", 301, 400), ("500.1", "600.0", 401, 500)], "600.0"),
}


# Upper bounds of the first five of six levels, colours, short labels.
LEVEL_BOUNDS = [50, 100, 150, 200, 300]
COLORS = ["#00E400", "#FFFF00", "#FF7E00", "#FF0000", "#8F3F97", "#7E0023"]
SHORT_LABELS = ["Tốt", "Trung bình", "Kém", "Xấu", "Rất xấu", "Nguy hại"]
NO_COLOR, NO_LABEL = "#CCCCCC", "N/A"


def index_sql(expr: str, pollutant: str, continuous: bool = False, missing: str = "0") -> str:
    """Sub-index of ``expr``; ``continuous`` closes the gaps between brackets."""
    rows, cap = INDEX[pollutant]
    x = f"CAST({expr} AS DOUBLE)"
    out = [f"CASE WHEN {x} IS NULL OR isnan({x}) THEN {missing}"]
    for i, (lo, hi, a, b) in enumerate(rows):
        upper = f"< {rows[i + 1][0]}E0" if continuous and i + 1 < len(rows) else f"<= {hi}E0"
        out.append(f"WHEN {x} >= {lo}E0 AND {x} {upper} THEN CAST(round_even("
                   f"({b} - {a}) / ({hi}E0 - {lo}E0) * ({x} - {lo}E0) + {a}, 0) AS INTEGER)")
    return " ".join([*out, f"WHEN {x} > {cap}E0 THEN 500 ELSE 0 END"])


def level_sql(expr: str) -> str:
    return (f"CASE WHEN {expr} <= 50 THEN 'Tốt (Good)' WHEN {expr} <= 100 THEN 'Trung bình (Moderate)' "
            f"WHEN {expr} <= 150 THEN 'Kém (Unhealthy for Sensitive)' "
            f"WHEN {expr} <= 200 THEN 'Xấu (Unhealthy)' "
            f"WHEN {expr} <= 300 THEN 'Rất Xấu (Very Unhealthy)' ELSE 'Nguy hại (Hazardous)' END")


K = "TRY_CAST(json_extract_string(props, '$.k') AS INTEGER)"
ISO = "strftime({ts}, '%Y-%m-%dT%H:%M:%S.%f') || '+00:00'"


def _raw_param_case() -> str:
    whens = " ".join(f"WHEN '{e}' THEN '{p}'" for e, p in T.RAW_PARAMETER_BY_EVENT.items())
    return f"CASE event_type {whens} END"


def _processed_at(ts: str) -> str:
    return (f"{ts} + to_microseconds(CAST(({K} - {T.LATENCY_K_OFFSET}) "
            f"* {T.LATENCY_SECONDS_PER_K} AS BIGINT) * 1000000)")


VIEWS = {
    "raw_long": f"""
        SELECT user_id AS location_id, ts, {ISO.format(ts='ts')} AS datetime,
               {_raw_param_case()} AS parameter, value
        FROM events""",
    "readings": f"""
        SELECT user_id AS location_id, ts AS event_ts, {ISO.format(ts='ts')} AS datetime,
               value AS pm25, CAST({K} AS DOUBLE) * {T.PM10_PER_K!r}E0 AS pm10,
               CAST(NULL AS DOUBLE) AS pm1, CAST(NULL AS DOUBLE) AS temperature,
               CAST(NULL AS DOUBLE) AS relativehumidity, CAST(NULL AS DOUBLE) AS um003,
               {_processed_at('ts')} AS processed_at
        FROM events""",
    "scored": f"""
        SELECT *, {index_sql('pm25', 'pm25')} AS aqi_pm25,
                  {index_sql('pm10', 'pm10')} AS aqi_pm10
        FROM readings""",
    "history": f"""
        SELECT *, {level_sql('aqi')} AS quality FROM (
            SELECT *, greatest(coalesce(aqi_pm25, 0), coalesce(aqi_pm10, 0)) AS aqi
            FROM scored)""",
    "latency_source": f"""
        SELECT user_id AS location_id, ts AS event_time, {ISO.format(ts='ts')} AS datetime,
               {_processed_at('ts')} AS processed_at
        FROM events""",
}


def with_views(body: str, *names: str, extra: dict[str, str] | None = None) -> str:
    """Prefix ``body`` with the CTEs it needs (dependencies included), then
    the query's own ``extra`` CTEs in order."""
    deps = {"scored": ["readings"], "history": ["readings", "scored"]}
    wanted: list[str] = []
    for n in names:
        for d in deps.get(n, []) + [n]:
            if d not in wanted:
                wanted.append(d)
    parts = [f"{n} AS ({VIEWS[n]})" for n in wanted]
    parts += [f"{n} AS ({sql})" for n, sql in (extra or {}).items()]
    ctes = ",\n".join(parts)
    return f"WITH {ctes}\n{body}" if ctes else body
