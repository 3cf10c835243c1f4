import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from conftest import SF001, at, make_logs
from telemill.operators import catalog, range_catalog, sessions
from telemill.schema import SENSORS
from telemill.sources.events_adapter import load_machine_logs


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_tables_give_what_the_built_in_catalog_gives(spark):
    logs = load_machine_logs(spark, SF001)
    want = sorted(catalog.out_of_range(logs).collect())
    got = range_catalog.out_of_range(logs, range_catalog.built_in_ranges(spark))
    assert sorted(got.select("machine_id", "sensor", "n_readings", "n_out_of_range").collect()) == want
    entries = sessions.window_entries(logs)
    cols = ["machine_id", "start", "failure_mode", "confidence", "n_matched", "n_considered"]
    want = sorted(catalog.signature_match(entries).select(cols).collect())
    assert sorted(range_catalog.signature_match(entries, range_catalog.built_in_signatures(spark)).select(cols).collect()) == want


@pytest.mark.parametrize("seed", [1, 2])
def test_matches_against_brute_force(spark, seed):
    """Ranges of all widths, single values, open and empty ones; readings on borders, negative, huge, infinite."""
    rnd = random.Random(seed)
    points = [0.0, -0.0, 1.0, -1.0, 0.1, 35.0, 1e-9, 1e9, -1e9, 2.0 ** 40, *[rnd.uniform(-50, 50) for _ in range(40)]]
    ranges = []
    for k in range(150):
        lo = rnd.choice(points)
        hi = rnd.choice([lo, lo + 10 ** rnd.uniform(-6, 6), rnd.choice(points)])
        ranges.append((f"c{k % 30}", rnd.choice(SENSORS[:3]), None if rnd.random() < 0.05 else lo, None if rnd.random() < 0.05 else hi))
    values = [(k, rnd.choice(SENSORS), rnd.choice(points + [r[2] for r in ranges if r[2] is not None] + [r[3] for r in ranges if r[3] is not None]
                                                  + [float("inf"), -float("inf")])) for k in range(600)]
    df = range_catalog.matches(spark.createDataFrame(values, "k int, sensor string, value double"),
                               spark.createDataFrame(ranges, "category string, sensor string, low double, high double"))
    got = sorted((r["k"], r["category"]) for r in df.collect())
    want = sorted((k, c) for k, s, v in values for c, t, lo, hi in ranges
                  if s == t and (lo is None or v >= lo) and (hi is None or v <= hi))
    assert got == want and len(want) > 500
    assert "NestedLoop" not in _plan(df) and "Cartesian" not in _plan(df)


def test_a_hundred_thousand_ranges(spark):
    """Each reading meets the few ranges of its cells, not all of them."""
    ranges = spark.range(100_000, numPartitions=4).selectExpr(
        "concat('c', id) AS category", "if(id >= 0, 'temperature_c', 'none') AS sensor", "id * 0.01D AS low", "id * 0.01D + 0.005D AS high")
    logs = spark.range(4000, numPartitions=4).selectExpr(
        "id AS event_id", "CAST('2025-01-01' AS TIMESTAMP_NTZ) AS timestamp", "concat('M', id % 3) AS machine_id",
        *[f"CAST(NULL AS DOUBLE) AS {s}" if s != "temperature_c" else "(id * 37 % 1000) + (id % 10) * 0.001D + 0.0005D AS temperature_c"
          for s in SENSORS])
    out = range_catalog.out_of_range(logs, ranges)
    assert "NestedLoop" not in _plan(out) and "Cartesian" not in _plan(out)
    assert tuple(out.agg(F.sum("n_readings"), F.sum("n_out_of_range"), F.count("*")).first()) == (4000, 2000, 3)
    found = range_catalog.matches(range_catalog.readings(logs, ["event_id"]), ranges)
    assert found.count() == 2000


def test_many_chosen_windows_meet_rows_in_their_hours(spark):
    logs = load_machine_logs(spark, SF001)
    entries = sessions.window_entries(logs)
    n = entries.where("seq = 1").count()
    for k in (3, n - 1, 10_000):
        got = sessions.prepared_entries(logs, k)
        first = sessions.summarize_windows(entries).orderBy("start", "machine_id").limit(k)
        want = entries.join(first.select("machine_id", F.col("start").alias("window_start")), ["machine_id", "window_start"])
        assert sorted(map(tuple, got.select("machine_id", "window_start", "seq").collect())) == sorted(
            map(tuple, want.select("machine_id", "window_start", "seq").collect()))
    plan = _plan(sessions.prepared_entries(logs, 10_000))
    assert "_bin" in plan and "NestedLoop" not in plan


def test_a_window_over_days_and_the_part_of_the_first_windows(spark):
    rows = [{"event_id": i, "timestamp": at(minutes=50 * i), "machine_id": "A", "severity": "ERROR"} for i in range(60)]
    rows += [{"event_id": 100 + i, "timestamp": at(hours=60 + 2 * i), "machine_id": "B", "severity": "ERROR"} for i in range(60)]
    logs = make_logs(spark, rows)
    assert sessions.prepared_entries(logs, 1).count() == 60
    part = sessions.first_part(logs, 3)
    assert part.agg(F.max("timestamp")).first()[0] < at(hours=96)
    want = sorted(map(str, sessions.prepared_windows(logs, 3).collect()))
    assert sorted(map(str, sessions.prepared_windows(part, 3).collect())) == want
    assert sessions.first_part(logs, 1000).count() == 120 and sessions.first_part(logs, None).count() == 120
    assert sessions.first_part(logs.limit(0), 3).count() == 0
    assert sessions.first_part(make_logs(spark, [{"timestamp": dt.datetime(2025, 1, 1)}]), 1).count() == 1
