import os

from conftest import SF001
from telemill.operators import diagnose, features, report, sessions, summary
from telemill.plans.analyze import analyze
from telemill.sources.events_adapter import load_machine_logs


def test_section_text(spark):
    df = spark.createDataFrame(
        [("A", "2025-01-01 10:00:00", "2025-01-01 11:00:00", "rc", "THERMAL", 0.125, "HIGH", [], [], [], "")],
        "machine_id string, start string, end string, root_cause string, failure_mode string, confidence double, "
        "severity_assessment string, evidence array<string>, "
        "recommended_actions array<struct<action:string,priority:string,estimated_downtime_hours:double,"
        "estimated_downtime_text:string>>, parts_at_risk array<string>, pattern_notes string")
    text = report.report_sections(df).first()["text"]
    assert text == "\n".join([
        "### Machine `A` — 2025-01-01 10:00:00 → 2025-01-01 11:00:00", "",
        "| Field | Value |", "|-------|-------|",
        "| **Root Cause** | rc |", "| **Failure Mode** | `THERMAL` |",
        "| **Confidence** | 12% |", "| **Severity** | 🟠 HIGH |", "", "---", ""])


def test_actions_rows(spark):
    logs = load_machine_logs(spark, SF001)
    d = diagnose.diagnose(logs)
    a = report.recommended_actions(d)
    assert a.count() >= d.count()


def test_analyze_end_to_end(spark, tmpdir_path):
    logs = load_machine_logs(spark, SF001)
    out = analyze(spark, logs, tmpdir_path, max_windows=5, generated_at="2025-01-01 00:00:00")
    assert out["diagnoses"].count() == 5
    files = sorted(f for f in os.listdir(f"{tmpdir_path}/diagnostic_report") if f.startswith("part-"))
    text = "".join(open(f"{tmpdir_path}/diagnostic_report/{f}", encoding="utf-8").read() for f in files)
    assert text.startswith("# Manufacturing Log Diagnostic Report\n\n*Generated: 2025-01-01 00:00:00*")
    assert "## Dataset Overview" in text and "| Total entries | 1000 |" in text
    assert "## Fleet Summary" in text and "## Detailed Failure Analysis" in text
    assert text.count("### Machine `") == 5
    assert os.path.isdir(f"{tmpdir_path}/processed_logs")
    e = spark.read.parquet(f"{tmpdir_path}/processed_logs")
    assert e.count() == 1000 and "is_anomaly" in e.columns


def test_analyze_taken_up_asks_for_nothing_twice(spark, tmpdir_path, two_partitions):
    calls, out = os.path.join(tmpdir_path, "calls"), os.path.join(tmpdir_path, "out")
    os.makedirs(calls)

    def model(system, prompt, max_tokens):
        with open(os.path.join(calls, os.urandom(8).hex()), "w"):
            return '{"root_cause": "r", "executive_summary": "s"}'

    logs = load_machine_logs(spark, SF001)
    first = analyze(spark, logs, out, 4, model, generated_at="now", resume=True)
    assert first["diagnoses"].count() == 4 and len(os.listdir(calls)) == 5  # four windows and the fleet
    again = analyze(spark, logs, out, 6, model, generated_at="now", resume=True)
    assert again["diagnoses"].count() == 6 and len(os.listdir(calls)) == 8
    assert again["fleet"].first()["executive_summary"] == "s"


def test_fleet_section_text(spark):
    f = spark.createDataFrame(
        [("sum", [("i", ["M-1", "M-2"], None, "big")], [("act", ["M-1"], "IMMEDIATE", "why")], ["a1"], 2.25)],
        "executive_summary string, top_issues array<struct<issue:string,affected_machines:array<string>,"
        "frequency:string,business_impact:string>>, maintenance_priorities array<struct<action:string,"
        "machines:array<string>,priority:string,rationale:string>>, trend_alerts array<string>, "
        "estimated_downtime_savings_hours double")
    t = report.fleet_section(f).first()["text"]
    assert "**1. i**\n- Affected: `M-1, M-2`\n- Frequency: N/A\n- Impact: big" in t
    assert "| ⚡ IMMEDIATE | act | `M-1` | why |" in t
    assert "- ⚠️ a1" in t and "**Estimated Downtime Savings:** 2.2 hours" in t


def test_fleet_tables(spark):
    f = spark.createDataFrame(
        [("sum", [("i1", ["M-1", "M-2"], "3 windows", "big"), ("i2", [], None, None)],
          [("act", ["M-1"], "IMMEDIATE", "why")], ["a1", "a2"], 0.0)],
        "executive_summary string, top_issues array<struct<issue:string,affected_machines:array<string>,"
        "frequency:string,business_impact:string>>, maintenance_priorities array<struct<action:string,"
        "machines:array<string>,priority:string,rationale:string>>, trend_alerts array<string>, "
        "estimated_downtime_savings_hours double")
    issues = [tuple(r) for r in report.fleet_issue_rows(f).orderBy("rank").collect()]
    assert issues == [(1, "i1", "M-1, M-2", "3 windows", "big"), (2, "i2", "", None, None)]
    prios = [tuple(r) for r in report.fleet_priority_rows(f).collect()]
    assert prios == [(1, "IMMEDIATE", "act", "M-1", "why")]
    assert [tuple(r) for r in report.fleet_alert_rows(f).orderBy("rank").collect()] == [(1, "a1"), (2, "a2")]


def test_stats_and_windows_share_source(spark):
    logs = load_machine_logs(spark, SF001)
    st = summary.report_stats(features.enrich(logs), sessions.window_entries(logs), diagnose.diagnose(logs))
    assert st.count() == 6 + summary.machine_list(logs).count()


def test_dashboard_lines(spark):
    logs = load_machine_logs(spark, SF001)
    d = diagnose.diagnose(logs)
    t = report.diagnosis_titles(d).first()["title"]
    assert t[0] in "🔴🟠" and t.endswith("% confidence)")
    df = spark.createDataFrame([("A", "s", [("act", None, None, None)])], "machine_id string, start string, "
                               "recommended_actions array<struct<action:string,priority:string,"
                               "estimated_downtime_hours:double,estimated_downtime_text:string>>")
    assert report.action_lines(df).first()["line"] == "- [] act (~?h downtime)"
