import math

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from conftest import SF01, at, make_logs
from telemill.operators import anomaly, features
from telemill.schema import SENSORS, anomaly_col
from telemill.sources.events_adapter import load_machine_logs


def _series(spark, n_flat, last=80.0, null_at=None):
    rows = []
    for i in range(n_flat):
        v = None if null_at == i else 25.0
        rows.append({"timestamp": at(minutes=20 * i), "temperature_c": v})
    rows.append({"timestamp": at(minutes=20 * n_flat), "temperature_c": last})
    return make_logs(spark, rows)


@pytest.mark.parametrize("n_flat,mean,std,z,flag", [
    (7, 31.875, 19.4454364826, 2.4748737342, False),
    (8, 31.1111111111, 18.3333333333, 2.6666666667, True),
    (9, 30.5, 17.3925271309, 2.8460498942, True),
])
def test_f3_threshold(spark, n_flat, mean, std, z, flag):
    e = anomaly.sensor_zscores(features.enrich(_series(spark, n_flat))).orderBy("timestamp").collect()
    last = e[-1]
    assert last["temperature_c_rolling_mean"] == pytest.approx(mean)
    assert last["temperature_c_rolling_std"] == pytest.approx(std)
    assert last["temperature_c_z"] == pytest.approx(z)
    assert last["temperature_c_anomaly"] is flag
    assert last["anomaly_count"] == int(flag) and last["is_anomaly"] is flag
    # flat readings: std 0 -> z 0 -> no flag; first row std 0
    assert all(r["temperature_c_z"] == 0.0 and not r["temperature_c_anomaly"] for r in e[:-1])


def test_f3_null_reading(spark):
    e = features.enrich(_series(spark, 9, null_at=3)).orderBy("timestamp").collect()
    assert e[3]["temperature_c_anomaly"] is False
    assert e[4]["temperature_c_rolling_mean"] == pytest.approx(25.0)


def test_flags_skip_missing_stats(spark):
    logs = make_logs(spark, [{"timestamp": at(0), "temperature_c": 1.0}])
    out = anomaly.flag_anomalies(logs).collect()[0]
    assert out["anomaly_count"] == 0 and out["is_anomaly"] is False
    assert anomaly_col("temperature_c") not in out.asDict()


def test_max_z_bound_and_counts(spark):
    # The row is inside its own frame: z <= (n-1)/sqrt(n) for n readings in the frame.
    e = anomaly.sensor_zscores(features.enrich(load_machine_logs(spark, SF01)))
    w = Window
    frame = (w.partitionBy("machine_id").orderBy(F.unix_micros(F.col("timestamp").cast("timestamp")))
             .rangeBetween(-(4 * 3600 * 10**6 - 1), 0))
    x = e.withColumn("n", F.count("temperature_c").over(frame)).select("n", "temperature_c_z").collect()
    for r in x:
        if r["temperature_c_z"] is not None and r["n"] > 0:
            assert r["temperature_c_z"] <= (r["n"] - 1) / math.sqrt(r["n"]) + 1e-9
    flagged = e.where("is_anomaly").count()
    assert flagged > 0


def test_anomaly_views(spark):
    e = features.enrich(load_machine_logs(spark, SF01))
    by = anomaly.anomalies_by_sensor(e)
    assert by.count() == 5 * len(SENSORS)
    total = by.agg(F.sum("n_anomalies")).first()[0]
    assert total == e.select(F.sum("anomaly_count")).first()[0]
    one = anomaly.sensor_trend(e, "temperature_c", machine_id="M-1")
    assert one.select("machine_id").distinct().collect()[0][0] == "M-1"
    top = anomaly.sensor_anomalies_top(e, "temperature_c", machine_id="M-1", n=20).orderBy("rank").collect()
    assert [r["rank"] for r in top] == list(range(1, len(top) + 1)) and len(top) <= 20
    ts = [r["timestamp"] for r in top]
    assert ts == sorted(ts)
    # brute force: first 20 flagged rows of the machine
    brute = (e.where("machine_id = 'M-1' AND temperature_c_anomaly").orderBy("timestamp", "event_id")
             .limit(20).select("event_id").collect())
    assert [r["event_id"] for r in top] == [r["event_id"] for r in brute]
