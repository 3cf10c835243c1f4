import datetime as dt

from pyspark.sql import functions as F

from conftest import SF01, at, make_logs
from telemill.operators import sessions
from telemill.sources.events_adapter import load_machine_logs


def _f4(spark):
    T = lambda h, m, s=0: dt.datetime(2025, 1, 1, h, m, s)
    rows = [
        dict(timestamp=T(9, 50), machine_id="A", severity="WARNING", error_code="E-201", failure_category="THERMAL", operator_notes="warm"),
        dict(timestamp=T(10, 0), machine_id="A", severity="ERROR", error_code="E-201", failure_category="THERMAL", operator_notes="hot"),
        dict(timestamp=T(10, 30), machine_id="A", severity="INFO", operator_notes="fine"),
        dict(timestamp=T(11, 0), machine_id="A", severity="CRITICAL", error_code="E-202", failure_category="THERMAL", operator_notes="hot"),
        dict(timestamp=T(12, 0, 1), machine_id="A", severity="ERROR", error_code=None, failure_category=None, operator_notes=None),
        dict(timestamp=T(10, 20), machine_id="B", severity="ERROR", error_code="E-301", failure_category="OPTICAL", operator_notes=""),
        dict(timestamp=T(10, 25), machine_id=None, severity="ERROR", error_code="E-401", failure_category="PNEUMATIC", operator_notes="x"),
    ]
    return make_logs(spark, rows)


def test_f4_failure_windows(spark):
    for method in ("bucketed", "session_window"):
        w = sessions.failure_windows(_f4(spark), method=method).collect()
        got = [(r["machine_id"], r["start"].strftime("%H:%M:%S"), r["end"].strftime("%H:%M:%S"),
                r["duration_minutes"], r["event_count"], r["max_severity"], r["failure_categories"],
                r["error_codes"]) for r in w]
        assert got == [
            ("A", "10:00:00", "11:00:00", 60.0, 2, "CRITICAL", ["THERMAL"], ["E-201", "E-202"]),
            ("B", "10:20:00", "10:20:00", 0.0, 1, "ERROR", ["OPTICAL"], ["E-301"]),
            ("A", "12:00:01", "12:00:01", 0.0, 1, "ERROR", [], []),
        ], method


def test_f4_entries_and_notes(spark):
    e = sessions.window_entries(_f4(spark)).orderBy("machine_id", "window_start", "seq").collect()
    a1 = [r for r in e if r["machine_id"] == "A" and r["window_start"].hour == 10]
    assert [r["seq"] for r in a1] == [1, 2]
    notes = [r["operator_notes"] for r in a1 if r["operator_notes"]]
    assert notes == ["hot", "hot"]


def test_f4_prepared_windows(spark):
    p = sessions.prepared_windows(_f4(spark), max_windows=2).orderBy("start").collect()
    assert [(r["machine_id"], r["start"]) for r in p] == [("A", "2025-01-01 10:00:00"), ("B", "2025-01-01 10:20:00")]
    assert p[0]["duration_minutes"] == 60.0 and p[0]["error_codes"] == ["E-201", "E-202"]
    ent = p[0]["entries"]
    assert [x["timestamp"] for x in ent] == ["2025-01-01 10:00:00", "2025-01-01 11:00:00"]
    assert set(ent[0].asDict()) == {"timestamp", "severity", "error_code", "laser_power_w", "temperature_c",
                                    "gas_pressure_psi", "beam_alignment_mm", "feed_rate_mm_min",
                                    "coolant_flow_lpm", "operator_notes"}
    assert "failure_categories" not in p[0].asDict()


def test_prepared_windows_split_long_windows_into_parts(spark):
    whole = sessions.prepared_windows(_f4(spark), max_windows=2).orderBy("start", "part").collect()
    split = sessions.prepared_windows(_f4(spark), max_windows=2, part_entries=1).orderBy("start", "part").collect()
    a = [r for r in split if r["machine_id"] == "A"]
    assert [(r["part"], r["parts"]) for r in a] == [(0, 2), (1, 2)]
    assert [len(r["entries"]) for r in a] == [1, 1]
    assert [e for r in a for e in r["entries"]] == list(whole[0]["entries"])
    assert all(r["part"] == 0 and r["parts"] == 1 for r in whole)


def test_empty_and_no_failure_tables(spark):
    empty = make_logs(spark, [])
    assert sessions.failure_windows(empty).count() == 0
    assert sessions.failure_windows(empty).columns[:3] == ["machine_id", "start", "end"]
    infos = make_logs(spark, [{"timestamp": at(minutes=10 * i), "severity": "INFO"} for i in range(50)])
    assert sessions.failure_windows(infos).count() == 0
    assert sessions.prepared_windows(infos).count() == 0


def test_bucketed_equals_session_window_on_driver_data(spark):
    logs = load_machine_logs(spark, SF01)
    cols = ["machine_id", "start", "end", "event_count", "max_severity", "failure_categories", "error_codes"]
    a = {tuple(r[c] if not isinstance(r[c], list) else tuple(r[c]) for c in cols)
         for r in sessions.failure_windows(logs).collect()}
    b = {tuple(r[c] if not isinstance(r[c], list) else tuple(r[c]) for c in cols)
         for r in sessions.failure_windows(logs, method="session_window").collect()}
    assert a == b and len(a) == 1133
    # fine buckets split chains across many buckets: same answer
    e1 = sessions.window_entries(logs, bucket_minutes=5).select("event_id", "window_start", "seq")
    e2 = sessions.window_entries(logs, bucket_minutes=24 * 60).select("event_id", "window_start", "seq")
    assert sorted(e1.collect()) == sorted(e2.collect())


def test_window_invariants(spark):
    logs = load_machine_logs(spark, SF01)
    e = sessions.window_entries(logs)
    assert e.count() == sessions.failure_events(logs).count()
    w = sessions.failure_windows(logs, ordered=False)
    assert w.agg(F.sum("event_count")).first()[0] == e.count()
    rows = w.orderBy("machine_id", "start").collect()
    for prev, cur in zip(rows, rows[1:]):
        if prev["machine_id"] == cur["machine_id"]:
            assert (cur["start"] - prev["end"]).total_seconds() > 3600
    seqs = e.groupBy("machine_id", "window_start").agg(F.max("seq").alias("m"), F.count("*").alias("n"))
    assert seqs.where("m <> n").count() == 0


def test_listing(spark):
    w = sessions.failure_windows(_f4(spark))
    first = sessions.failure_window_listing(w).orderBy("start").first()
    assert first["title"] == "A — 2025-01-01 10:00 (2 events, 60 min)"
    assert first["error_codes_text"] == "E-201, E-202"


def test_failure_window_plan_shape(spark):
    """The log is read twice (full rows; narrow columns for the bucket table) and
    the rows meet the bucket table in one join; no per-machine-only exchange."""
    logs = load_machine_logs(spark, SF01)
    plan = sessions.failure_windows(logs, ordered=False)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan parquet") == 2
    assert plan.count("Join") == 1
    assert "CartesianProduct" not in plan
    big = [ln for ln in plan.split("\n") if "Exchange hashpartitioning(machine_id" in ln and "_bucket" in ln]
    assert len(big) == 2


def test_all_windows_prepared_alike(spark):
    logs = load_machine_logs(spark, SF01)
    few = {(r["machine_id"], r["start"]): r["entries"] for r in sessions.prepared_windows(logs, 20).collect()}
    every = {(r["machine_id"], r["start"]): r["entries"] for r in sessions.prepared_windows(logs, None).collect()}
    assert len(few) == 20 and len(every) == 1133 and all(every[k] == v for k, v in few.items())


def test_prepared_windows_plan_has_three_scans(spark):
    logs = load_machine_logs(spark, SF01)
    plan = sessions.prepared_windows(logs)._jdf.queryExecution().optimizedPlan().toString()
    whole = sessions.window_entries(logs)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation [") <= 2 * whole.count("Relation [") + 1


def test_windows_before_1970(spark):
    base = dt.datetime(1969, 12, 31, 20, 0)
    rows = [dict(timestamp=base + dt.timedelta(minutes=m), machine_id="A", severity="ERROR") for m in (0, 50, 100, 170, 225, 300)]
    w = sessions.failure_windows(make_logs(spark, rows)).collect()
    assert [r["event_count"] for r in w] == [3, 2, 1]


def test_rounding_follows_python(spark):
    from telemill.functions.exprs import fixed, round1, thousands
    xs = [12.25, 1.15, 0.15, 12.35, 0.25, 0.05, 2.675, 1e15 + 0.25, 0.0, 12.2, 60.0, 1.05, 0.45, 1234567.95, -0.25, -1.15]
    df = spark.createDataFrame([(x,) for x in xs], "x double").select(
        "x", round1("x").alias("r"), fixed("x", 1).alias("f"), fixed("x", 0).alias("z"))
    for r in df.collect():
        assert r["r"] == round(r["x"], 1), r["x"]
        if r["x"] >= 0:
            assert r["f"] == f"{r['x']:.1f}" and r["z"] == f"{r['x']:.0f}", r["x"]
    assert spark.range(1).select(thousands(F.lit(1234567)).alias("t")).first()["t"] == f"{1234567:,}"


def test_notes(spark):
    n = sessions.window_notes(sessions.window_entries(_f4(spark))).orderBy("machine_id", "start", "seq").collect()
    assert [(r["machine_id"], r["seq"], r["note"]) for r in n] == [("A", 1, "hot"), ("A", 2, "hot")]
