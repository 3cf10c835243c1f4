import pytest

from conftest import at, make_logs
from telemill.operators import catalog, sessions


def _one_event_windows(spark, readings):
    rows = [dict(timestamp=at(hours=5 * i), machine_id="A", severity="ERROR", **r) for i, r in enumerate(readings)]
    return make_logs(spark, rows)


def test_f5_signature_match(spark):
    thermal = dict(temperature_c=60.0, laser_power_w=2400.0, coolant_flow_lpm=4.0)
    normal = dict(temperature_c=25.0, laser_power_w=2000.0, feed_rate_mm_min=2000.0, gas_pressure_psi=150.0,
                  beam_alignment_mm=0.03, coolant_flow_lpm=10.0)
    logs = _one_event_windows(spark, [thermal, dict(thermal, feed_rate_mm_min=2000.0), normal])
    m = catalog.signature_match(sessions.window_entries(logs)).orderBy("start").collect()
    assert [(r["failure_mode"], r["confidence"]) for r in m] == [("MATERIAL", 1.0), ("THERMAL", 1.0), ("UNKNOWN", 0.0)]
    oor = {r["sensor"]: r["n_out_of_range"] for r in catalog.out_of_range(logs).collect()}
    assert oor["temperature_c"] == 2 and oor["laser_power_w"] == 2 and oor["coolant_flow_lpm"] == 2
    assert oor["feed_rate_mm_min"] == 0 and oor["gas_pressure_psi"] == 0


def test_code_lookup(spark):
    logs = make_logs(spark, [dict(timestamp=at(0), severity="ERROR", error_code="E-202", failure_category="THERMAL"),
                             dict(timestamp=at(1), severity="ERROR", error_code="E-999", failure_category="OPTICAL")])
    r = catalog.code_category(sessions.failure_events(logs)).orderBy("timestamp").collect()
    assert (r[0]["catalog_category"], r[0]["category_matches"]) == ("THERMAL", True)
    assert (r[1]["catalog_category"], r[1]["category_matches"]) == (None, False)
    plan = catalog.code_category(sessions.failure_events(logs))._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan


def test_catalog_sizes():
    assert len(catalog.SIGNATURES) == 13
    assert sum(len(c) for _, c in catalog.ERROR_CODES) == 17
    assert len(catalog.NORMAL_RANGES) == 6
    with pytest.raises(StopIteration):
        next(c for c, _ in catalog.ERROR_CODES if c not in catalog.CATEGORIES)
