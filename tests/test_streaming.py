import datetime as dt
import os
import time

from pyspark.sql import Window
from pyspark.sql import functions as F

from conftest import SF01, at, make_logs
from telemill.operators import sessions
from telemill.sources.events_adapter import machine_logs_from_events
from telemill.schema import LOG_SCHEMA
from telemill.streaming import start_failure_window_stream
from telemill.streaming.stateful_windows import closed_windows, late_rows, open_windows, start_stateful_windows


def test_stream_equals_batch_for_closed_windows(spark, tmpdir_path):
    events = spark.read.parquet(f"{SF01}/events.parquet")
    src = os.path.join(tmpdir_path, "events_in")
    # four files in time order
    q = events.withColumn("_part", F.ntile(4).over(Window.orderBy("ts")))
    for i in range(1, 5):
        q.where(F.col("_part") == i).drop("_part").coalesce(1).write.mode("append").parquet(src)
    stream_logs = machine_logs_from_events(
        spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(src))
    sink = os.path.join(tmpdir_path, "windows_out")
    query = start_failure_window_stream(spark, stream_logs, sink,
                                        checkpoint_location=os.path.join(tmpdir_path, "ckpt"))
    query.awaitTermination(300)
    streamed = spark.read.parquet(sink)
    batch_logs = machine_logs_from_events(events)
    batch = sessions.failure_windows(batch_logs, ordered=False)
    cols = ["machine_id", "start", "end", "event_count", "max_severity"]
    s = {tuple(r) for r in streamed.select(*cols).collect()}
    b = {tuple(r) for r in batch.select(*cols).collect()}
    # closed: no later event can join once the watermark (two hours behind) has passed the window's end and gap
    last = batch_logs.where("severity IN ('ERROR', 'CRITICAL') AND machine_id IS NOT NULL").agg(F.max("timestamp")).first()[0]
    closed = {w for w in b if w[2] + dt.timedelta(minutes=60) <= last - dt.timedelta(hours=2)}
    assert s == closed and b - s


def _stream(spark, folder, rows_by_file, run="1", **kw):
    """Run the stateful stream over files of log rows; (closed, open, late)."""
    src, sink, ckpt = (os.path.join(folder, x) for x in ("in", "out", "ckpt"))
    for rows in rows_by_file:
        make_logs(spark, rows).coalesce(1).write.mode("append").parquet(src)
    logs = spark.readStream.schema(LOG_SCHEMA).option("maxFilesPerTrigger", 1).parquet(src)
    q = start_stateful_windows(spark, logs, sink, ckpt, **kw)
    if kw.get("available_now", True):
        q.awaitTermination(300)
    return q, sink, ckpt


_COLS = ["machine_id", "start", "end", "duration_minutes", "event_count", "max_severity", "failure_categories", "error_codes"]


def _tuples(df):
    return sorted(map(str, df.select(*_COLS).collect()))


def test_stateful_stream_equals_batch_for_all_windows(spark, tmpdir_path, two_partitions):
    events = spark.read.parquet(f"{SF01}/events.parquet")
    src, sink, ckpt = (os.path.join(tmpdir_path, x) for x in ("in", "out", "ckpt"))
    q = events.withColumn("_part", F.ntile(2).over(Window.orderBy("ts")))
    for i in range(1, 3):
        q.where(F.col("_part") == i).drop("_part").orderBy(F.rand(i)).coalesce(1).write.mode("append").parquet(src)
    logs = machine_logs_from_events(spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(src))
    start_stateful_windows(spark, logs, sink, ckpt).awaitTermination(300)
    want = _tuples(sessions.failure_windows(machine_logs_from_events(events), ordered=False))
    closed, still = closed_windows(spark, sink), open_windows(spark, ckpt)
    assert _tuples(closed.unionByName(still)) == want
    assert 0 < still.count() < 20 and late_rows(spark, sink).count() == 0
    assert closed.where("NOT sets_whole").count() == 0


def test_late_rows_are_kept_aside_and_runs_go_on(spark, tmpdir_path, two_partitions):
    def row(i, minutes, machine="A", code="E-201", severity="ERROR"):
        return {"event_id": i, "timestamp": at(minutes=minutes), "machine_id": machine, "severity": severity, "error_code": code}

    first = [row(1, 0), row(2, 30), row(3, 200, code="E-301", severity="CRITICAL"), row(4, 10, "B")]
    # A's time is closed up to minute 80, then up to 380: 70 and 379 are late, 390 is not; B lags and is not
    second = [row(5, 500), row(6, 70), row(7, 60, "B")]
    third = [row(8, 390), row(9, 379), row(10, 455), row(11, 1000, "B")]
    _stream(spark, tmpdir_path, [first])
    before = _tuples(open_windows(spark, os.path.join(tmpdir_path, "ckpt")))
    assert len(before) == 3  # A's first window would close at a row after minute 210
    _, sink, ckpt = _stream(spark, tmpdir_path, [second])
    _, sink, ckpt = _stream(spark, tmpdir_path, [third])
    late = {r["event_id"]: r["timestamp"] for r in late_rows(spark, sink).collect()}
    assert late == {6: at(minutes=70), 9: at(minutes=379)}
    kept = [r for r in first + second + third if r["event_id"] not in late]
    want = _tuples(sessions.failure_windows(make_logs(spark, kept), ordered=False))
    assert _tuples(closed_windows(spark, sink).unionByName(open_windows(spark, ckpt))) == want


def test_idle_machines_close_by_a_timer(spark, tmpdir_path, two_partitions):
    rows = [{"event_id": i, "timestamp": at(minutes=i), "machine_id": "A", "severity": "ERROR"} for i in range(5)]
    q, sink, ckpt = _stream(spark, tmpdir_path, [rows], available_now=False, interval="1 second", idle_minutes=0.02)
    try:
        end = time.time() + 120
        while time.time() < end and not (os.path.isdir(os.path.join(sink, "kind=window"))):
            time.sleep(1)
    finally:
        q.stop()
    assert [r["event_count"] for r in closed_windows(spark, sink).collect()] == [5]
    assert open_windows(spark, ckpt).count() == 0
