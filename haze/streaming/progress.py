"""Live pipeline metrics from streaming progress events."""

from __future__ import annotations

import json
from collections import deque

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQueryListener

KEPT = 1000


def _offsets(text) -> dict[str, int]:
    """``topic/partition`` -> offset of a source that reports offsets per partition; else empty."""
    try:
        value = json.loads(text) if isinstance(text, str) else text
    except ValueError:
        return {}
    if not isinstance(value, dict):
        return {}
    return {f"{topic}/{part}": int(n) for topic, parts in value.items() if isinstance(parts, dict)
            for part, n in parts.items() if isinstance(n, (int, str)) and str(n).lstrip("-").isdigit()}


def source_lag(end, latest) -> int | None:
    """Messages the source has beyond what was read, from its own progress report (no topic is
    read for it); None for sources without offsets per partition."""
    read, there = _offsets(end), _offsets(latest)
    if not there:
        return None
    return sum(max(0, n - read.get(k, 0)) for k, n in there.items())


def produced(latest) -> int | None:
    """Messages produced so far by the source's own report of its partitions' ends: the topic is not
    read for it.  None for sources without offsets per partition."""
    ends = _offsets(latest)
    return sum(ends.values()) if ends else None


class ProgressLog(StreamingQueryListener):
    """Records one row per micro-batch: batch id, rows in, input and
    processing rates, duration, the source end offsets, the messages produced
    so far, the lag behind the source and the rows that stateful operators
    dropped behind the watermark.  The newest ``kept`` rows stay in memory; ``drain`` hands them out
    as a DataFrame and clears the buffer."""

    def __init__(self, kept: int = KEPT):
        self.rows: deque[dict] = deque(maxlen=kept)

    def onQueryStarted(self, event):
        pass

    def onQueryProgress(self, event):
        p = event.progress
        lags = [source_lag(s.endOffset, s.latestOffset) for s in p.sources]
        lags = [x for x in lags if x is not None]
        made = [x for x in (produced(s.latestOffset) for s in p.sources) if x is not None]
        self.rows.append({
            "query": p.name or str(p.id),
            "batch_id": int(p.batchId),
            "rows": int(p.numInputRows),
            "input_rows_per_s": float(p.inputRowsPerSecond or 0.0),
            "processed_rows_per_s": float(p.processedRowsPerSecond or 0.0),
            "duration_ms": int((p.durationMs or {}).get("triggerExecution", 0)),
            "end_offset": str(p.sources[0].endOffset) if p.sources else None,
            "lag": sum(lags) if lags else None,
            "produced": sum(made) if made else None,
            "dropped_late": sum(int(s.numRowsDroppedByWatermark) for s in p.stateOperators),
        })

    def onQueryIdle(self, event):
        pass

    def onQueryTerminated(self, event):
        pass

    def drain(self, spark: SparkSession) -> DataFrame:
        rows = [self.rows.popleft() for _ in range(len(self.rows))]
        return spark.createDataFrame(
            rows, "query string, batch_id long, rows long, input_rows_per_s double, "
                  "processed_rows_per_s double, duration_ms long, end_offset string, lag long, "
                  "produced long, dropped_late long")
