"""Column names, types and fixed domains of the machine log."""

from __future__ import annotations

from pyspark.sql import types as T

# Fixed values that must equal the reference's for right results.
SENSORS = [
    "laser_power_w",
    "temperature_c",
    "gas_pressure_psi",
    "beam_alignment_mm",
    "feed_rate_mm_min",
    "coolant_flow_lpm",
]
SEVERITIES = ["INFO", "WARNING", "ERROR", "CRITICAL"]
FAILURE_SEVERITIES = ["ERROR", "CRITICAL"]
FAILURE_MODES = ["THERMAL", "OPTICAL", "PNEUMATIC", "MECHANICAL", "MATERIAL", "ELECTRICAL", "UNKNOWN"]
DEFAULT_WINDOW_HOURS = 4
DEFAULT_Z_THRESHOLD = 2.5
DEFAULT_GAP_MINUTES = 60
DEFAULT_MAX_WINDOWS = 10
# Cells that pandas' CSV reader turns into missing values.
NULL_TOKENS = ["", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>",
               "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null"]

OPTIONAL_TEXT = ["operator", "shift", "material", "failure_category"]
TEXT_COLUMNS = ["machine_id", "operator", "shift", "material", "severity", "error_code",
                "failure_category", "operator_notes"]

# Column order of a raw log (the 15 generated fields).
RAW_COLUMNS = ["timestamp", "machine_id", "operator", "shift", "material", "severity",
               "error_code", "failure_category", *SENSORS, "operator_notes"]

RAW_SCHEMA = T.StructType(
    [T.StructField("timestamp", T.TimestampNTZType())]
    + [T.StructField(c, T.StringType()) for c in ["machine_id", "operator", "shift", "material",
                                                 "severity", "error_code", "failure_category"]]
    + [T.StructField(s, T.DoubleType()) for s in SENSORS]
    + [T.StructField("operator_notes", T.StringType())]
)

# Log as used by the operators: raw columns plus a stable row id for tie-breaks.
LOG_SCHEMA = T.StructType([T.StructField("event_id", T.LongType())] + RAW_SCHEMA.fields)


def rolling_mean_col(sensor: str) -> str:
    return f"{sensor}_rolling_mean"


def rolling_std_col(sensor: str) -> str:
    return f"{sensor}_rolling_std"


def anomaly_col(sensor: str) -> str:
    return f"{sensor}_anomaly"


def zscore_col(sensor: str) -> str:
    return f"{sensor}_z"


# Field names of the model's replies. All are read as STRING (a
# list as its raw JSON) and converted one by one, so an ill-typed value costs
# only itself.
DIAGNOSIS_FIELDS = ["root_cause", "failure_mode", "confidence", "severity_assessment", "evidence",
                    "recommended_actions", "parts_at_risk", "pattern_notes", "error"]
FLEET_FIELDS = ["executive_summary", "top_issues", "maintenance_priorities", "trend_alerts",
                "estimated_downtime_savings_hours", "error"]

DIAGNOSIS_JSON_SCHEMA = T.StructType([T.StructField(f, T.StringType()) for f in DIAGNOSIS_FIELDS])
FLEET_JSON_SCHEMA = T.StructType([T.StructField(f, T.StringType()) for f in FLEET_FIELDS])
