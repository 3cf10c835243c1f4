import datetime as dt
import os
import random

import pytest
from pyspark.sql import functions as F

from conftest import SF001, at, make_logs
from telemill.operators import diagnose, features, partials, sessions, summary
from telemill.plans.incremental import advance, table
from telemill.schema import SENSORS, rolling_mean_col, rolling_std_col
from telemill.sources.events_adapter import load_machine_logs


def _close(got, want, key):
    got, want = ({tuple(r[k] for k in key): r for r in x} for x in (got, want))
    assert got.keys() == want.keys()
    for k, w in want.items():
        for c, v in w.asDict().items():
            g = got[k][c]
            assert g == (pytest.approx(v, rel=1e-9, abs=1e-9) if isinstance(v, float) else v), (k, c)


def _as_one(spark, logs, store):
    """The store's tables are those of one run over all rows."""
    enriched = features.enrich(logs)
    got = table(spark, store, "processed")
    assert set(got.columns) == set(enriched.columns)
    _close(got.collect(), enriched.collect(), ["event_id"])
    entries = sessions.window_entries(logs)
    want = sorted(map(str, sessions.summarize_windows(entries).collect()))
    windows = table(spark, store, "windows")
    assert sorted(map(str, windows.select(sessions.summarize_windows(entries).columns).collect())) == want
    told = diagnose.diagnose(logs)
    assert sorted(map(str, table(spark, store, "diagnoses").select(told.columns).collect())) == sorted(map(str, told.collect()))
    daily = table(spark, store, "daily")
    assert partials.overview(daily).collect() == summary.overview(enriched).collect()
    assert sorted(partials.report_stats(daily, windows).collect()) == sorted(summary.report_stats(enriched, entries).collect())
    return daily


def _rows(seed):
    """Machines with bursts, ties, long pauses and failures that chain over midnight."""
    rnd = random.Random(seed)
    out, i = [], 0
    for machine in ("A", "B", None):
        t = 0.0
        for _ in range(110):
            t += rnd.choice([0, 0, 1, 5, 20, 59, 61, 200, 2000, 5000])
            out.append({"event_id": i, "timestamp": at(minutes=t), "machine_id": machine, "severity": rnd.choice(["ERROR", "CRITICAL", "INFO", None]),
                        "error_code": rnd.choice(["E-201", "E-301", "", None]), "failure_category": rnd.choice(["THERMAL", ""]),
                        "temperature_c": rnd.choice([None, 60.0, 25.5, 1e6]), "laser_power_w": float(rnd.randrange(100))})
            i += 1
    out.append({"event_id": i, "timestamp": None, "machine_id": "A", "severity": "ERROR"})
    return out


def test_batches_in_time_order_read_and_write_their_dates_only(spark, tmpdir_path, two_partitions):
    logs = load_machine_logs(spark, SF001)
    store = os.path.join(tmpdir_path, "store")
    cut = dt.datetime(2024, 1, 25, 12)
    advance(spark, logs.where(F.col("timestamp") <= cut), store)
    before = {d: {f: os.stat(os.path.join(store, "processed", d, f)).st_mtime_ns for f in os.listdir(os.path.join(store, "processed", d))}
              for d in os.listdir(os.path.join(store, "processed")) if d.startswith("date=")}
    # earlier dates are out of reach: a broken file there would fail a run that read it
    hidden = os.path.join(store, "processed", "date=2024-01-05")
    saved = {f: open(os.path.join(hidden, f), "rb").read() for f in os.listdir(hidden) if f.endswith(".parquet") and not f.startswith(".")}
    for f in saved:
        with open(os.path.join(hidden, f), "wb") as h:
            h.write(b"not parquet")
    got = advance(spark, logs.where(F.col("timestamp") > cut), store)
    for f, data in saved.items():
        with open(os.path.join(hidden, f), "wb") as h:
            h.write(data)
    assert min(got["touched"]) == dt.date(2024, 1, 25)
    for d, files in before.items():
        if d < "date=2024-01-25" and d != "date=2024-01-05":
            assert files == {f: os.stat(os.path.join(store, "processed", d, f)).st_mtime_ns for f in files}
    _as_one(spark, logs, store)


def test_batches_in_any_order_and_twice(spark, tmpdir_path, two_partitions):
    rows = _rows(3)
    rnd = random.Random(4)
    store = os.path.join(tmpdir_path, "store")
    late = [r for r in rows if rnd.random() < 0.1]
    first = [r for r in rows if r not in late]
    advance(spark, make_logs(spark, first), store)
    advance(spark, make_logs(spark, late), store)
    advance(spark, make_logs(spark, late), store)
    daily = _as_one(spark, make_logs(spark, rows), store)
    logs = make_logs(spark, rows)
    assert partials.severity_summary(daily).collect() == summary.severity_summary(logs).collect()
    assert partials.severity_counts(daily).collect() == summary.severity_counts(logs).collect()
    assert partials.category_counts(table(spark, store, "categories")).collect() == summary.category_counts(logs).collect()


def test_only_changed_windows_are_prompted(spark, tmpdir_path, two_partitions):
    calls, store = os.path.join(tmpdir_path, "calls"), os.path.join(tmpdir_path, "store")
    os.makedirs(calls)

    def model(system, prompt, max_tokens):
        with open(os.path.join(calls, os.urandom(8).hex()), "w") as f:
            f.write(prompt)
        return '{"root_cause": "r"}'

    def fails(*hours):
        return [{"event_id": int(h * 100), "timestamp": at(hours=h), "machine_id": "A", "severity": "ERROR"} for h in hours]

    advance(spark, make_logs(spark, fails(1, 1.5, 30, 60)), store, call=model)
    assert len(os.listdir(calls)) == 3
    got = advance(spark, make_logs(spark, fails(60.5, 90)), store, call=model)
    assert len(os.listdir(calls)) == 5 and got["diagnoses"].count() == 4 == got["windows"].count()
    # an earlier row joins a window of the next date, which is left without one
    got = advance(spark, make_logs(spark, fails(23.8, 24.5, 25.4, 29.5)), store, call=model)
    assert sorted((r["start"], r["event_count"]) for r in got["windows"].collect()) == [
        (at(hours=1), 2), (at(hours=23.8), 3), (at(hours=29.5), 2), (at(hours=60), 2), (at(hours=90), 1)]
    assert got["diagnoses"].count() == 5
