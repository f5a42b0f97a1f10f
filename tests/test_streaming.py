"""The stateful operators on streams of files: late rows, repeats, time-outs, restarts from a checkpoint."""

from __future__ import annotations

from datetime import datetime, timedelta

import pytest

from lanternlake.streaming import runs as T

DAY = datetime(2024, 1, 1)


def at(minutes):
    return DAY + timedelta(minutes=minutes)


@pytest.fixture
def fed(spark, tmp_path):
    """Runs an operator over batches of rows, each batch a file that arrives after the one before was worked off, and a restart between them."""

    def run(batches, schema, operator, mode="append"):
        folder, name = tmp_path / "in", f"t{tmp_path.name.replace('-', '_')}"
        folder.mkdir()
        out = []
        for i, rows in enumerate(batches):
            spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{folder}/{i}.parquet")
            stream = spark.readStream.schema(schema).option("recursiveFileLookup", "true").parquet(str(folder))
            sink = tmp_path / "out"
            query = operator(stream).writeStream.outputMode(mode).format("parquet").option("path", str(sink)).option("checkpointLocation", str(tmp_path / "state")).queryName(f"{name}_{i}").trigger(availableNow=True).start()
            query.awaitTermination(120)
            out = [tuple(r) for r in spark.read.parquet(str(sink)).collect()] if list(sink.glob("*.parquet")) else []
        return sorted(out, key=repr)

    return run


def test_windows_drop_late_rows(fed):
    batches = [[("a", at(0)), ("a", at(0.5)), ("b", at(0.2))], [("a", at(30))], [("a", at(0.1)), ("a", at(31))], [("a", at(90))]]
    out = fed(batches, "type string, ts timestamp", T.event_counts)
    assert [(r[0], r[2], r[3]) for r in out] == [(at(0), "a", 2), (at(0), "b", 1), (at(30), "a", 1), (at(31), "a", 1)]


def test_sessions_end_after_a_gap(fed):
    batches = [[(1, at(0)), (1, at(20)), (2, at(5))], [(1, at(100))], [(3, at(300))]]
    out = fed(batches, "user_id int, ts timestamp", T.sessions)
    assert [(r[0], r[2], r[3]) for r in out] == [(at(0), 1, 2), (at(5), 2, 1), (at(100), 1, 1)]


def test_jobs_delivered_twice_count_once(fed):
    batches = [[("j1", at(0)), ("j1", at(1)), ("j2", at(1))], [("j1", at(2)), ("j3", at(2))]]
    out = fed(batches, "job string, ts timestamp", lambda s: T.once_within(s, "job").select("job"))
    assert out == [("j1",), ("j2",), ("j3",)]


def test_run_machine_keeps_states_over_restarts_and_times_out(fed):
    batches = [
        [("r1", "Queued", at(0)), ("r1", "Running", at(1)), ("r2", "Queued", at(0)), ("r2", "Succeeded", at(1)), ("r3", "Running", at(0))],
        [("r1", "Succeeded", at(2)), ("r2", "Running", at(3))],
        [("r1", "Running", at(4)), ("r4", "Queued", at(100))],
        [("r4", "Running", at(101))],
    ]
    out = fed(batches, "run_id string, status string, ts timestamp", T.run_machine)
    assert {("r1", "Running", True), ("r1", "Succeeded", True), ("r1", "Running", False), ("r2", "Succeeded", False), ("r2", "Running", True), ("r3", "Running", False)} <= set(out)
    # r2 was running when the watermark passed its ten minutes.
    assert ("r2", "Failed", True) in out and ("r1", "Failed", True) not in out


def test_ingestion_goes_on_where_it_stopped(spark, tmp_path):
    folder, seen = tmp_path / "docs", []
    schema = "id int, content string"
    for i in range(3):
        spark.createDataFrame([(i, f"text {i}")], schema).coalesce(1).write.parquet(f"{folder}/{i}.parquet")
        stream = spark.readStream.schema(schema).option("recursiveFileLookup", "true").parquet(str(folder))
        T.ingest_stream(stream, lambda batch, n: seen.extend(r.id for r in batch.collect()), str(tmp_path / "state")).awaitTermination(120)
    assert seen == [0, 1, 2]
