"""The stateful forms on streams: tumbling rate windows, the run state machine, incremental ingestion, event windows."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from lanternlake.operators.runs import TRANSITIONS


def event_counts(events: DataFrame, late: str = "10 minutes", size: str = "60 seconds", slide: str | None = None) -> DataFrame:
    """(window, type, n) over event time; rows later than `late` are dropped by the watermark."""
    window = F.window("ts", size, slide) if slide else F.window("ts", size)
    return events.withWatermark("ts", late).groupBy(window, "type").agg(F.count("*").alias("n")).select("window.start", "window.end", "type", "n")


def sessions(events: DataFrame, late: str = "10 minutes", gap: str = "30 minutes") -> DataFrame:
    return events.withWatermark("ts", late).groupBy(F.session_window("ts", gap), "user_id").agg(F.count("*").alias("n")).select("session_window.start", "session_window.end", "user_id", "n")


def once_within(events: DataFrame, key: str, late: str = "10 minutes") -> DataFrame:
    """The first row of each key: what drops jobs that are delivered twice."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark([key])


def run_machine(changes: DataFrame, seconds: int = 600, late: str = "10 minutes") -> DataFrame:
    """(run_id, status, ok) for a stream of changes (run_id, status, ts): each in order of time against the run's state.

    Changes that aren't allowed leave the state as it is and come out with ok false. A run that is Running `seconds` after
    it began, by the watermark, comes out as Failed. Finished runs keep their state, so nothing reopens them.
    """
    allowed = set(TRANSITIONS)

    def step(key, batches, state: GroupState):
        run, now = key[0], state.get[0] if state.exists else None
        if state.hasTimedOut:
            if now == "Running":
                state.update(("Failed",))
                yield pd.DataFrame({"run_id": [run], "status": ["Failed"], "ok": [True]})
            return
        out, last = [], None
        rows = pd.concat(list(batches)).sort_values(["ts", "status"])
        for status, ts in zip(rows["status"], rows["ts"], strict=True):
            ok = (now, status) in allowed or now is None and status == "Queued"
            now, last = (status, ts) if ok else (now, last)
            out.append((run, status, ok))
        if now is not None:
            state.update((now,))
        if now == "Running" and last is not None:
            state.setTimeoutTimestamp(max(int(last.timestamp() * 1000) + seconds * 1000, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(out, columns=["run_id", "status", "ok"])

    return changes.withWatermark("ts", late).groupBy("run_id").applyInPandasWithState(step, "run_id string, status string, ok boolean", "status string", "append", GroupStateTimeout.EventTimeTimeout)


def ingest_stream(documents: DataFrame, apply: Callable[[DataFrame, int], None], checkpoint: str):
    """Starts a query that hands each micro-batch of new documents to `apply`, which must be safe to repeat (an upsert by content hash is)."""
    return documents.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
