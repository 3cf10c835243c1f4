"""Deterministic machine-log view of the driver's ``events`` table.

The driver tables hold no machine logs, so the operators run on this view.
Normal rows lie inside the normal sensor ranges; ``error`` events follow one
failure signature, chosen by ``k % 6`` where ``k`` is the integer in
``props``, with each of the category's error codes in turn. Five machines
(``user_id % 5``) keep the per-machine series long; some rows lack machine,
severity or category. Every column is a pure projection of one events row, so
Catalyst prunes the scan to the events columns a query really needs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from telemill.operators.catalog import CATEGORIES, ERROR_CODES, NORMAL_RANGES, SIGNATURES

# Which of the two fractions of a row (_u from value, _v from k) places a reading in its range.
_FRACTION = {"laser_power_w": "_u", "temperature_c": "_v", "gas_pressure_psi": "_u",
             "beam_alignment_mm": "_v", "feed_rate_mm_min": "_v", "coolant_flow_lpm": "_u"}
# Normal coolant flow is held constant, so that runs without spread occur.
_NORMAL = dict((s, (lo, hi)) for s, lo, hi in NORMAL_RANGES) | {"coolant_flow_lpm": (10.0, 10.0)}


def _reading(sensor: str) -> str:
    """A reading inside the failure signature's range, else inside the normal range."""
    def inside(lo: float, hi: float) -> str:
        return f"{lo!r}D + {round(hi - lo, 6)!r}D * {_FRACTION[sensor]}"

    cases = " ".join(f"WHEN {CATEGORIES.index(c)} THEN {inside(lo, hi)}" for c, x, lo, hi in SIGNATURES if x == sensor)
    text = f"CASE _c {cases} ELSE {inside(*_NORMAL[sensor])} END"
    if sensor == "gas_pressure_psi":
        text = f"CASE WHEN pmod(_k, 17) = 0 THEN CAST(NULL AS DOUBLE) ELSE {text} END"
    return f"{text} AS {sensor}"


def _codes() -> str:
    cases = " ".join(
        f"WHEN {i} THEN element_at(array({', '.join(repr(x) for x in codes)}), CAST(pmod(_k div 6, {len(codes)}) AS INT) + 1)"
        for i, (_, codes) in enumerate(ERROR_CODES))
    return f"CASE _c {cases} ELSE '' END AS error_code"


# The view as Spark SQL expressions: one parse on the JVM instead of hundreds
# of Python-side Column calls. Double literals carry the D suffix (a bare
# 0.15 would be DECIMAL).
_BASE = [
    "*",
    "CAST(get_json_object(props, '$.k') AS INT) AS _k",
]
_DERIVED = [
    "*",
    "CASE WHEN event_type = 'error' THEN pmod(_k, 6) ELSE -1 END AS _c",
    "(value % 10D) / 10D AS _u",
    "_k / 100D AS _v",
]
_VIEW = [
    "event_id",
    "ts AS timestamp",
    "CASE WHEN event_id % 97 = 5 THEN CAST(NULL AS STRING) ELSE concat('M-', CAST(pmod(user_id, 5) AS STRING)) END AS machine_id",
    """CASE WHEN event_id % 101 = 7 THEN CAST(NULL AS STRING) WHEN _c >= 0 AND value >= 100 THEN 'CRITICAL'
            WHEN _c >= 0 THEN 'ERROR' WHEN event_type = 'purchase' THEN 'WARNING' ELSE 'INFO' END AS severity""",
    _codes(),
    f"""CASE WHEN event_id % 103 = 9 THEN CAST(NULL AS STRING) WHEN _c >= 0
            THEN element_at(array({', '.join(repr(c) for c in CATEGORIES)}), _c + 1) ELSE '' END AS failure_category""",
    *[_reading(s) for s, _, _ in NORMAL_RANGES],
    """CASE WHEN pmod(_k, 5) = 0 THEN CAST(NULL AS STRING) WHEN pmod(_k, 7) = 0 THEN ''
            ELSE concat(event_type, ' note ', CAST(_k AS STRING)) END AS operator_notes""",
]


def machine_logs_from_events(events: DataFrame) -> DataFrame:
    return events.selectExpr(*_BASE).selectExpr(*_DERIVED).selectExpr(*_VIEW)


def load_machine_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Machine logs for a driver scale-factor folder."""
    return machine_logs_from_events(spark.read.parquet(f"{sf_dir}/events.parquet"))
