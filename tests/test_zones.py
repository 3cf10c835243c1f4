"""Naive times mean the same in every session zone, also in hours that a zone leaves out or has twice."""

import datetime as dt

from conftest import make_logs
from telemill.operators import anomaly, diagnose, features, report, sessions, summary


def _rows():
    day, autumn = dt.datetime(2024, 3, 10), dt.datetime(2024, 11, 3)
    out = []
    for base in (day, autumn):
        for k, minutes in enumerate((0, 90, 150, 195, 200, 261, 262, 600)):
            out.append({"timestamp": base + dt.timedelta(minutes=minutes, microseconds=250_000 * (k % 2)), "severity": "ERROR",
                        "machine_id": "A" if k % 3 else "B", "temperature_c": 20.0 + k * k, "error_code": "E-201"})
    return [{**r, "event_id": i} for i, r in enumerate(out)]


def _everything(spark):
    logs = make_logs(spark, _rows())
    enriched = features.enrich(logs, z_threshold=0.5)
    windows = sessions.failure_windows(logs)
    diagnoses = diagnose.diagnose(logs)
    frames = [enriched, windows, sessions.window_entries(logs), sessions.failure_window_listing(windows), sessions.prepared_windows(logs),
              anomaly.sensor_anomalies_top(enriched, "temperature_c"), summary.report_stats(enriched, sessions.window_entries(logs)),
              diagnoses, report.assemble_report(diagnoses, "now")]
    return [sorted(map(str, f.collect())) for f in frames]


def test_results_do_not_depend_on_the_session_zone(spark, two_partitions):
    want = _everything(spark)
    try:
        for zone in ("America/New_York", "Asia/Kathmandu"):
            spark.conf.set("spark.sql.session.timeZone", zone)
            assert _everything(spark) == want
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_a_gap_over_a_missing_hour(spark):
    logs = make_logs(spark, [{"timestamp": dt.datetime(2024, 3, 10, h, m), "severity": "ERROR", "event_id": h}
                             for h, m in ((1, 30), (3, 15))])
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        assert [r["duration_minutes"] for r in sessions.failure_windows(logs).collect()] == [0.0, 0.0]
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
