import collections
import datetime as dt

import pytest
from pyspark.sql import functions as F

from conftest import SF01, at, make_logs
from telemill.operators import anomaly, features
from telemill.schema import SENSORS, rolling_mean_col, rolling_std_col
from telemill.sources.events_adapter import load_machine_logs


def _by_id(df, cols):
    return {r["event_id"]: tuple(r[c] for c in cols) for r in df.collect()}


@pytest.mark.parametrize("plain", [True, False])
def test_f1_open_lower_bound(spark, plain):
    vals = [1, 2, 4, 8, 16]
    logs = make_logs(spark, [{"timestamp": at(hours=2 * i), "temperature_c": float(v)} for i, v in enumerate(vals)])
    r = features.rolling_stats(logs, plain=plain).orderBy("timestamp").collect()
    means = [x["temperature_c_rolling_mean"] for x in r]
    stds = [x["temperature_c_rolling_std"] for x in r]
    assert means == pytest.approx([1.0, 1.5, 3.0, 6.0, 12.0])
    assert stds == pytest.approx([0.0, 0.7071067812, 1.4142135624, 2.8284271247, 5.6568542495])
    t = features.time_features(logs, plain=plain).orderBy("timestamp").collect()
    assert [x["time_since_last"] for x in t] == [0.0, 7200.0, 7200.0, 7200.0, 7200.0]
    # sensors without readings: mean NULL, std 0
    assert r[0]["laser_power_w_rolling_mean"] is None and r[0]["laser_power_w_rolling_std"] == 0.0


@pytest.mark.parametrize("plain", [True, False])
def test_f2_equal_timestamps(spark, plain):
    hs = [0, 2, 2, 4, 6]
    vals = [1, 2, 4, 8, 16]
    logs = make_logs(spark, [{"timestamp": at(hours=h), "temperature_c": float(v)} for h, v in zip(hs, vals)])
    r = (features.rolling_stats(logs, plain=plain)
         .withColumn("n", F.lit(1)).orderBy("event_id").collect())
    assert [x["temperature_c_rolling_mean"] for x in r] == pytest.approx([1, 7 / 3, 7 / 3, 14 / 3, 12])
    t = features.time_features(logs, plain=plain).orderBy("event_id").collect()
    assert [x["time_since_last"] for x in t] == [0.0, 7200.0, 0.0, 7200.0, 7200.0]


def test_calendar_features(spark):
    logs = make_logs(spark, [{"timestamp": at(hours=13)}])  # 2025-01-01 is a Wednesday
    r = features.time_features(logs).collect()[0]
    assert (r["hour"], r["day_of_week"], str(r["date"])) == (13, 2, "2025-01-01")


def test_null_machine_gets_no_stats(spark):
    logs = make_logs(spark, [{"timestamp": at(0), "machine_id": None, "temperature_c": 5.0},
                             {"timestamp": at(1), "machine_id": None, "temperature_c": 7.0}])
    e = features.enrich(logs).collect()
    assert all(x["temperature_c_rolling_mean"] is None for x in e)
    assert all(x["time_since_last"] == 0.0 for x in e)
    assert not any(x["is_anomaly"] for x in e)


def test_blocks_equal_plain_on_driver_data(spark):
    logs = load_machine_logs(spark, SF01)
    for kind in ({"sub_blocks": 1}, {"sub_blocks": 4}, {"method": "frame"}):
        _compare(spark, logs, **kind)


def test_bucketed_lag_equals_plain(spark):
    logs = load_machine_logs(spark, SF01)
    a = _by_id(features.time_features(logs, plain=True), ["time_since_last"])
    for bucket_hours in (1, 24):
        b = _by_id(features.time_features(logs, bucket_hours=bucket_hours), ["time_since_last"])
        assert a == b


def test_enrich_one_pass_equals_separate_operators(spark):
    logs = load_machine_logs(spark, SF01)
    e = features.enrich(logs)
    cols = ["time_since_last"] + [rolling_mean_col(s) for s in SENSORS]
    sep = features.rolling_stats(features.time_features(logs, plain=True), plain=True)
    a, b = _by_id(e, cols), _by_id(sep, cols)
    assert a.keys() == b.keys()
    for k in a:
        for x, y in zip(a[k], b[k]):
            assert (x is None) == (y is None) and (y is None or x == pytest.approx(y, rel=1e-9, abs=1e-9))
    assert e.count() == logs.count()  # rolling keeps every row


def test_enrich_plan_has_single_log_exchange(spark):
    logs = load_machine_logs(spark, SF01)
    plan = features.enrich(logs)._jdf.queryExecution().executedPlan().toString()
    # one exchange for the haloed log (plus small per-bucket edge-table exchanges)
    assert plan.count("Window [") >= 2
    assert "CartesianProduct" not in plan


def _compare(spark, logs, **kind):
    cols = [c for s in SENSORS for c in (rolling_mean_col(s), rolling_std_col(s))]
    want = _by_id(features.rolling_stats(logs, plain=True), cols)
    got = _by_id(features.rolling_stats(logs, **kind), cols)
    assert got.keys() == want.keys()
    for k, v in want.items():
        for a, b in zip(got[k], v):
            assert (a is None) == (b is None) and (b is None or a == pytest.approx(b, rel=1e-9, abs=1e-9)), k


@pytest.mark.parametrize("sub_blocks", [1, 3, 16])
@pytest.mark.parametrize("start", [dt.datetime(2024, 1, 1), dt.datetime(1969, 12, 28)])
def test_glitch_is_forgotten(spark, sub_blocks, start):
    """One reading of 1e9 at row 5; a spike of 60 at row 300, long out of its frame, is still flagged."""
    rows = [{"timestamp": start + dt.timedelta(minutes=3 * i),
             "temperature_c": 1e9 if i == 5 else 60.0 if i == 300 else 25.0 + (i * 7919 % 11) / 2} for i in range(400)]
    logs = make_logs(spark, rows)
    _compare(spark, logs, sub_blocks=sub_blocks)
    e = {r["event_id"]: r for r in features.enrich(logs, sub_blocks=sub_blocks).collect()}
    assert e[300]["temperature_c_anomaly"] and e[300]["temperature_c_rolling_std"] > 1
    assert sum(r["temperature_c_anomaly"] for r in e.values() if r["event_id"] > 100) == 1


def test_dense_block(spark):
    rows = [{"timestamp": at(seconds=i // 4), "temperature_c": 1e6 + (i * 31 % 17) * 1e-3} for i in range(3000)]
    _compare(spark, make_logs(spark, rows), sub_blocks=1)
    _compare(spark, make_logs(spark, rows), sub_blocks=16)


def test_sub_blocks_must_divide_the_frame(spark):
    with pytest.raises(ValueError):
        features.rolling_stats(make_logs(spark, [{"timestamp": at(0)}]), sub_blocks=7)


@pytest.mark.parametrize("window_hours,z", [(1, 1.05), (0.5, 3.05), (12, 2.5)])
def test_other_parameters(spark, window_hours, z):
    logs = load_machine_logs(spark, SF01)
    a = _by_id(features.enrich(logs, window_hours=window_hours, z_threshold=z, sub_blocks=2), ["anomaly_count"])
    b = _by_id(anomaly.flag_anomalies(features.rolling_stats(logs, window_hours=window_hours, plain=True), z), ["anomaly_count"])
    assert a == b


def test_dense_machines_get_finer_blocks(spark):
    """A machine with a burst, a steady dense one and a sparse one: levels by their rows, results as in whole machines."""
    rows = [{"timestamp": at(seconds=20 * i), "machine_id": "steady", "temperature_c": 20 + i % 13 * 0.7} for i in range(1500)]
    rows += [{"timestamp": at(hours=30, seconds=i / 10), "machine_id": "burst", "temperature_c": 1e5 + i % 7} for i in range(300)]
    rows += [{"timestamp": at(hours=i * 0.9), "machine_id": "sparse", "temperature_c": float(i), "gas_pressure_psi": 1.0} for i in range(60)]
    rows += [{"timestamp": None, "machine_id": "sparse", "temperature_c": 1.0}, {"timestamp": at(1), "machine_id": None}]
    logs = make_logs(spark, rows)
    levels = features.machine_levels(logs, block_rows=50)
    assert set(levels) == {"steady", "burst"} and 4 <= levels["steady"] <= 6 and levels["burst"] >= 10
    _compare(spark, logs, block_rows=50)
    _compare(spark, logs, levels=3)
    assert features.machine_levels(logs) == {}
    want = _by_id(features.time_features(logs, plain=True), ["time_since_last"])
    assert _by_id(features.enrich(logs, block_rows=50), ["time_since_last"]) == want


def test_a_million_rows_in_a_frame_are_many_groups(spark):
    """One machine with 10**6 rows in four hours: by default no task has the machine alone."""
    us = 14_000_000_000 // 10 ** 6
    logs = spark.range(10 ** 6, numPartitions=4).selectExpr(
        "id AS event_id", f"CAST(timestamp_micros(1735689600000000 + id * {us}) AS TIMESTAMP_NTZ) AS timestamp", "concat('A', id div 1000000000) AS machine_id",
        *[f"CAST(pmod(id * {7919 + k}, 1009) AS DOUBLE) AS {s}" for k, s in enumerate(SENSORS)], "'INFO' AS severity")
    levels = features.machine_levels(logs)
    assert levels == {"A0": 3}
    out = features.rolling_stats(logs, levels=levels)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    x, _ = features._with_sub_blocks(features._with_ts(logs), features._frame_us(4), None, levels)
    groups = features._copied(x, features._frame_us(4)).groupBy("machine_id", "_bucket").count().collect()
    assert len(groups) >= 8 and max(r["count"] for r in groups) <= 2 * features.BLOCK_ROWS
    c = rolling_mean_col("temperature_c"), rolling_std_col("temperature_c")
    late = out.where("event_id % 99991 = 5").select("event_id", *c).collect()
    assert len(late) == 11
    for r in late:
        x = [float(i * 7920 % 1009) for i in range(r["event_id"] + 1)]
        m = sum(x) / len(x)
        assert r[c[0]] == pytest.approx(m, rel=1e-9)
        assert r[c[1]] == pytest.approx((sum((v - m) ** 2 for v in x) / (len(x) - 1)) ** 0.5, rel=1e-9)


def test_finer_blocks_take_no_more_shuffles(spark):
    """The moments of whole blocks are shuffled as often for 4096 blocks to a frame as for 8; gaps, NULLs and a glitch as in whole machines."""
    rows = [{"timestamp": at(seconds=i * i % 86400), "machine_id": f"m{i % 2}", "temperature_c": None if i % 11 == 0 else 1e9 if i == 40 else 20 + i % 13 * 0.7,
             "gas_pressure_psi": 140.0 if i % 90 == 0 else None} for i in range(700)]
    logs = make_logs(spark, rows)
    count = {}
    for level in (3, 12):
        out = features.rolling_stats(logs, window_hours=8, levels=level)
        count[level] = out._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")
    assert count[12] == count[3] <= 4
    _compare(spark, logs, levels=12)


def test_levels_are_the_coarsest_that_suffice(spark):
    """By counting every block of every level, also before 1970."""
    rows = [{"timestamp": dt.datetime(1969, 12, 31, 20) + dt.timedelta(seconds=i * i % 40000 / 3), "machine_id": f"m{i % 3}"} for i in range(900) if i % 3 < 2 or i % 60 == 2]
    frame_us = 4 * features.US_PER_HOUR
    want = {}
    for m in ("m0", "m1", "m2"):
        us = [(r["timestamp"] - dt.datetime(1970, 1, 1)) // dt.timedelta(microseconds=1) for r in rows if r["machine_id"] == m]
        most = [max(collections.Counter(u // (frame_us >> k) for u in us).values()) for k in range(features.MAX_LEVEL + 1)]
        if most[0] > 15:
            want[m] = next((k for k in range(1, features.MAX_LEVEL) if most[k] <= 15), features.MAX_LEVEL)
    assert features.machine_levels(make_logs(spark, rows), block_rows=15) == want and len(want) >= 2
