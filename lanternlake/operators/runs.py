"""Runs: state machine, idempotency, recovery, timeouts, rate windows, in batch form."""

from __future__ import annotations

import heapq

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .fold import folded

# fixed values: the changes of state that are allowed
TRANSITIONS = (("Queued", "Running"), ("Running", "Succeeded"), ("Running", "Failed"), ("Queued", "Failed"))
OUTSTANDING = ("Queued", "Running")
QUEUE_CAPACITY = 100


def state_violations(history: DataFrame) -> DataFrame:
    """(run_id, seq, from_status, to_status) of changes that aren't allowed, in histories (run_id, seq, status); runs begin as Queued."""
    w = Window.partitionBy("run_id").orderBy("seq")
    pairs = history.select("run_id", "seq", F.lag("status").over(w).alias("from_status"), F.col("status").alias("to_status"))
    allowed = F.lit(False)
    for a, b in TRANSITIONS:
        allowed = allowed | ((F.col("from_status") == a) & (F.col("to_status") == b))
    return pairs.where(F.when(F.col("from_status").isNull(), F.col("to_status") != "Queued").otherwise(~allowed))


def idempotency(submissions: DataFrame) -> DataFrame:
    """submissions (project_id, request_id, run_id, submitted_at, finished_at) with decision: started or reused.

    A submission while a run that an earlier one of its project and request id started is outstanding reuses that run and starts
    nothing, so its own end keeps nothing busy; a run without an end stays outstanding. Null request ids never reuse, nor does
    a submission without a time. Each key's submissions are one task's, in order of time and run id.
    """

    def begin():
        busy = None

        def step(submitted, finished):
            nonlocal busy
            if busy is not None and submitted is not None and busy > submitted:
                return "reused"
            end = float("inf") if finished is None else finished
            busy = end if busy is None else max(busy, end)
            return "started"

        return step

    some = folded(submissions.where("request_id is not null"), ["project_id", "request_id"], ["submitted_at", "run_id"], [F.unix_micros(F.col(c).cast("timestamp")) for c in ("submitted_at", "finished_at")], "decision", ("string", pa.string()), begin)
    return some.unionByName(submissions.where("request_id is null").withColumn("decision", F.lit("started")))


def recovered(runs: DataFrame) -> DataFrame:
    """runs after a restart: Running ones have failed, Queued ones are to be queued again."""
    running = F.col("status") == "Running"
    return runs.withColumn("failure_code", F.when(running, F.lit("WORKER_INTERRUPTED")).otherwise(F.col("failure_code"))).withColumn("requeue", F.col("status") == "Queued").withColumn("status", F.when(running, "Failed").otherwise(F.col("status")))


def timed_out(runs: DataFrame, seconds: int = 600) -> DataFrame:
    """Runs that took longer, or have run longer by the time in `now`."""
    took = F.unix_micros(F.coalesce("completed_at", "now")) - F.unix_micros("started_at")
    return runs.where(took > seconds * 1_000_000)


def rate_limited(events: DataFrame, seconds: int = 60, permits: int = 10, queue: int = 4, key: str | None = None) -> DataFrame:
    """events (event_id, ts) with label: in each window of time the first are admitted, the next queued, the rest rejected.

    Without a key there is one window for all, so each window of time is one group: choose a key, or windows that a task can hold.
    """
    size = seconds * 1_000_000
    at = (F.unix_micros(F.col("ts").cast("timestamp")) / size).cast("bigint")
    w = Window.partitionBy(*([key] if key else []), "window_no").orderBy("ts", "event_id")
    n = F.row_number().over(w)
    return events.withColumn("window_no", at).withColumn("n", n).withColumn("label", F.when(F.col("n") <= permits, "admitted").when(F.col("n") <= permits + queue, "queued").otherwise("rejected")).drop("n")


def queue_admission(submissions: DataFrame, capacity: int = QUEUE_CAPACITY) -> DataFrame:
    """submissions (queue, submitted_at, started_at, run_id) with rejected: as many admitted before them are still waiting as the queue holds.

    Rejected runs never wait. What leaves a queue at a moment does so before what arrives then; a run without a start waits on, one without a
    time of submission comes first. A queue's arrivals depend on one another, so they are one task's, which holds no more than `capacity` times.
    """

    def begin():
        waiting: list[float] = []

        def step(at, leaves):
            while waiting and at is not None and waiting[0] <= at:
                heapq.heappop(waiting)
            if len(waiting) >= capacity:
                return True
            heapq.heappush(waiting, float("inf") if leaves is None else leaves)
            return False

        return step

    return folded(submissions, ["queue"], ["submitted_at", "run_id"], [F.unix_micros(F.col(c).cast("timestamp")) for c in ("submitted_at", "started_at")], "rejected", ("boolean", pa.bool_()), begin)


def stage_durations(stages: DataFrame) -> DataFrame:
    """(run_id, stage, ms) from (run_id, stage, event, ts) with events started and completed; null while not completed."""
    at = lambda e: F.min(F.when(F.col("event") == e, F.unix_millis("ts")))
    return stages.groupBy("run_id", "stage").agg((at("completed") - at("started")).alias("ms"))


def tool_loop(calls: DataFrame, allowed: list[str], most: int = 3, output: int = 60_000) -> DataFrame:
    """calls (run_id, seq, tool, output, timed_out) with status: executed, not_allowed, timeout, or rejected beyond the limit; outputs are cut."""
    w = Window.partitionBy("run_id").orderBy("seq")
    n = F.row_number().over(w)
    status = F.when(F.col("n") > most, "rejected").when(~F.col("tool").isin(allowed), "not_allowed").when(F.col("timed_out"), "timeout").otherwise("executed")
    return calls.withColumn("n", n).withColumn("status", status).withColumn("output", F.when(F.col("status") == "executed", F.substring("output", 1, output))).drop("n")
