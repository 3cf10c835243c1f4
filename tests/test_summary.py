from conftest import SF01, at, make_logs
from telemill.operators import features, sessions, summary
from telemill.sources.events_adapter import load_machine_logs


def _f6(spark):
    rows = [("A", "INFO"), ("A", "INFO"), ("A", "ERROR"), ("B", "DEBUG"), ("C", None), (None, "INFO")]
    return make_logs(spark, [{"timestamp": at(minutes=i), "machine_id": m, "severity": s}
                             for i, (m, s) in enumerate(rows)])


def test_f6_severity_summary(spark):
    got = [tuple(r) for r in summary.severity_summary(_f6(spark)).collect()]
    assert got == [("A", 2, 0, 1, 0), ("B", 0, 0, 0, 0)]


def test_f6_overview(spark):
    o = summary.overview(_f6(spark)).first()
    assert o["total_entries"] == 6 and o["error_rate"] == 16.7 and o["machines"] == 3
    assert o["sensor_anomalies"] == 0


def test_severity_and_category_counts(spark):
    c = summary.severity_counts(_f6(spark)).orderBy("ord").collect()
    assert [(r["severity"], r["n"]) for r in c] == [("INFO", 3), ("WARNING", 0), ("ERROR", 1), ("CRITICAL", 0)]
    logs = load_machine_logs(spark, SF01)
    cc = summary.category_counts(logs).collect()
    assert [r["n"] for r in cc] == sorted([r["n"] for r in cc], reverse=True)
    assert sum(r["n"] for r in cc) == logs.where("failure_category <> ''").count()


def test_report_stats_rows(spark):
    logs = load_machine_logs(spark, SF01)
    rows = summary.report_stats(features.enrich(logs), sessions.window_entries(logs)).collect()
    st = {r["metric"]: r["value"] for r in rows}
    assert st["Total entries"] == "10000"
    assert st["Failure windows"] == "1133"
    assert sorted(r["value"] for r in rows if r["metric"] == "Machines") == ["M-0", "M-1", "M-2", "M-3", "M-4"]
    assert st["Error rate"].endswith("%") and " → " in st["Time range"]
