"""Randomised checks of the bucketed operators against brute-force Python.

Small buckets force every cross-bucket path: chains that span many buckets,
buckets without a window break, halo rows from the previous bucket, equal
timestamps and NULL readings.
"""

import math
import random
import statistics

import pytest

from conftest import at, make_logs
from telemill.operators import features, sessions
from telemill.schema import SENSORS, rolling_mean_col, rolling_std_col


def _failure_rows(seed):
    rnd = random.Random(seed)
    rows, eid = [], 0
    for m in ["A", "B", "C"]:
        t = rnd.uniform(0, 30)
        for _ in range(rnd.randint(20, 60)):
            step = rnd.choice([0.0, rnd.uniform(0.5, 59), 60.0, 60.0001, rnd.uniform(61, 400), rnd.uniform(5, 30)])
            t += step
            sev = rnd.choice(["ERROR", "CRITICAL", "INFO", "WARNING", "ERROR"])
            rows.append({"event_id": eid, "machine_id": m, "timestamp": at(minutes=t), "severity": sev,
                         "error_code": rnd.choice(["", "E-201", "E-502"])})
            eid += 1
    return rows


def _brute_sessions(rows, gap_min=60):
    out = {}
    by_m = {}
    for r in rows:
        if r["severity"] in ("ERROR", "CRITICAL"):
            by_m.setdefault(r["machine_id"], []).append(r)
    for m, rs in by_m.items():
        rs.sort(key=lambda r: (r["timestamp"], r["event_id"]))
        start, seq, prev = None, 0, None
        for r in rs:
            if prev is None or (r["timestamp"] - prev).total_seconds() > gap_min * 60:
                start, seq = r["timestamp"], 0
            seq += 1
            prev = r["timestamp"]
            out[r["event_id"]] = (start, seq)
    return out


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_window_entries_match_brute_force(spark, seed):
    rows = _failure_rows(seed)
    logs = make_logs(spark, rows)
    got = {r["event_id"]: (r["window_start"], r["seq"])
           for r in sessions.window_entries(logs, bucket_minutes=7).collect()}
    assert got == _brute_sessions(rows)


def _sensor_rows(seed):
    rnd = random.Random(seed)
    rows, eid = [], 0
    for m in ["A", "B"]:
        t = 0.0
        for _ in range(150):
            t += rnd.choice([0.0, rnd.uniform(1, 40), rnd.uniform(100, 300), 240.0])
            r = {"event_id": eid, "machine_id": m, "timestamp": at(minutes=t), "severity": "INFO",
                 "coolant_flow_lpm": 10.0}
            for s in SENSORS[:-1]:
                r[s] = None if rnd.random() < 0.15 else round(rnd.uniform(0, 3000), 4)
            rows.append(r)
            eid += 1
    return rows


def _brute_rolling(rows, hours=4.0):
    out = {}
    for r in rows:
        frame = [x for x in rows if x["machine_id"] == r["machine_id"]
                 and 0 <= (r["timestamp"] - x["timestamp"]).total_seconds() < hours * 3600]
        res = {}
        for s in SENSORS:
            vals = [x[s] for x in frame if x.get(s) is not None]
            res[s] = (statistics.fmean(vals) if vals else None,
                      statistics.stdev(vals) if len(vals) >= 2 else 0.0)
        out[r["event_id"]] = res
    return out


@pytest.mark.parametrize("seed", [5, 6])
def test_rolling_stats_match_brute_force(spark, seed):
    rows = _sensor_rows(seed)
    want = _brute_rolling(rows)
    got = features.rolling_stats(make_logs(spark, rows), sub_blocks=2).collect()
    assert len(got) == len(rows)
    for r in got:
        for s in SENSORS:
            m, sd = want[r["event_id"]][s]
            if m is None:
                assert r[rolling_mean_col(s)] is None
            else:
                assert math.isclose(r[rolling_mean_col(s)], m, rel_tol=1e-9, abs_tol=1e-9)
            assert math.isclose(r[rolling_std_col(s)], sd, rel_tol=1e-7, abs_tol=1e-7), (s, r["event_id"])
    assert all(r[rolling_std_col("coolant_flow_lpm")] == 0.0 for r in got)
