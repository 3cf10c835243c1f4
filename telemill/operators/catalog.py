"""Domain catalog lookups: normal ranges, failure signatures, error codes.

The catalog is a fixed literal of a few dozen entries, so it is applied as
literal column expressions (range checks compiled into the scan's codegen) or
as a broadcast table whose size is bounded by construction — never shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F



# ---------------------------------------------------------------------------
# Fixed values (must equal the reference's domain catalog).
# Normal operating range per sensor: (sensor, low, high).
NORMAL_RANGES = [
    ("laser_power_w", 1800.0, 2200.0),
    ("temperature_c", 20.0, 35.0),
    ("gas_pressure_psi", 140.0, 160.0),
    ("beam_alignment_mm", 0.0, 0.05),
    ("feed_rate_mm_min", 1800.0, 2400.0),
    ("coolant_flow_lpm", 8.0, 12.0),
]
# Failure signatures: (category, sensor, low, high).
SIGNATURES = [
    ("THERMAL", "temperature_c", 55.0, 85.0),
    ("THERMAL", "laser_power_w", 2300.0, 2600.0),
    ("THERMAL", "coolant_flow_lpm", 3.0, 5.5),
    ("OPTICAL", "beam_alignment_mm", 0.15, 0.45),
    ("OPTICAL", "laser_power_w", 1500.0, 1750.0),
    ("PNEUMATIC", "gas_pressure_psi", 80.0, 110.0),
    ("PNEUMATIC", "feed_rate_mm_min", 1000.0, 1500.0),
    ("MECHANICAL", "feed_rate_mm_min", 800.0, 1400.0),
    ("MECHANICAL", "beam_alignment_mm", 0.08, 0.20),
    ("MATERIAL", "laser_power_w", 2100.0, 2500.0),
    ("MATERIAL", "feed_rate_mm_min", 1200.0, 1600.0),
    ("ELECTRICAL", "laser_power_w", 0.0, 800.0),
    ("ELECTRICAL", "temperature_c", 15.0, 20.0),
]
# Error codes per category.
ERROR_CODES = [
    ("THERMAL", ["E-201", "E-202", "E-210"]),
    ("OPTICAL", ["E-301", "E-302", "E-315"]),
    ("PNEUMATIC", ["E-401", "E-402", "E-410"]),
    ("MECHANICAL", ["E-501", "E-502", "E-520"]),
    ("MATERIAL", ["E-601", "E-602"]),
    ("ELECTRICAL", ["E-701", "E-702", "E-710"]),
]
# ---------------------------------------------------------------------------

CATEGORIES = [c for c, _ in ERROR_CODES]


def code_table(spark: SparkSession) -> DataFrame:
    rows = [(code, cat) for cat, codes in ERROR_CODES for code in codes]
    return spark.createDataFrame(rows, "error_code string, catalog_category string")


def code_category(failures: DataFrame) -> DataFrame:
    """Catalog category of each failure row's error code (NULL for unknown codes).

    The 17-row code table is broadcast: its size is fixed by the catalog.
    """
    codes = F.broadcast(code_table(failures.sparkSession))
    return (failures.join(codes, "error_code", "left")
            .select("event_id", "machine_id", "timestamp", "error_code", "failure_category",
                    "catalog_category",
                    F.coalesce(F.col("catalog_category") == F.col("failure_category"), F.lit(False))
                    .alias("category_matches")))


def out_of_range(logs: DataFrame) -> DataFrame:
    """Readings outside the normal range, per machine and sensor.

    One aggregate with two conditional counts per sensor (no 6x unpivot of the
    log before aggregation); the machine x sensor result is unpivoted after.
    """
    aggs = []
    for s, lo, hi in NORMAL_RANGES:
        aggs.append(F.count(s).alias(f"{s}__n"))
        aggs.append(F.count(F.when((F.col(s) < lo) | (F.col(s) > hi), F.lit(1))).alias(f"{s}__out"))
    wide = logs.where(F.col("machine_id").isNotNull()).groupBy("machine_id").agg(*aggs)
    pairs = ", ".join(f"'{s}', `{s}__n`, `{s}__out`" for s, _, _ in NORMAL_RANGES)
    return wide.selectExpr("machine_id",
                           f"stack({len(NORMAL_RANGES)}, {pairs}) as (sensor, n_readings, n_out_of_range)")


def _between_sql(sensor: str, lo: float, hi: float) -> str:
    return f"({sensor} IS NOT NULL AND {sensor} >= {lo!r}D AND {sensor} <= {hi!r}D)"


# The scoring expressions are Spark SQL text, parsed once on the JVM.
def signature_aggs() -> list[Column]:
    """Per-window partial sums: readings inside each category's signature ranges
    (``{cat}__in``) and non-NULL readings of the signature's sensors (``{cat}__nn``)."""
    out = []
    for cat in CATEGORIES:
        sig = [(s, lo, hi) for c, s, lo, hi in SIGNATURES if c == cat]
        inside = " + ".join(f"CAST({_between_sql(s, lo, hi)} AS INT)" for s, lo, hi in sig)
        seen = " + ".join(f"CAST({s} IS NOT NULL AS INT)" for s, _, _ in sig)
        out.append(F.expr(f"sum({inside}) AS `{cat}__in`"))
        out.append(F.expr(f"sum({seen}) AS `{cat}__nn`"))
    return out


def best_signature(prefix: str = "") -> list[Column]:
    """failure_mode, confidence, n_matched, n_readings from the per-category sums.

    Score = matched / considered readings; the best score wins, ties go to the
    first category by name; a best score of 0 means UNKNOWN with confidence 0.
    """
    cands = []
    for cat in CATEGORIES:
        i, n = f"`{prefix}{cat}__in`", f"`{prefix}{cat}__nn`"
        score = f"CASE WHEN {n} > 0 THEN {i} / {n} ELSE 0D END"
        cands.append(f"named_struct('k', -({score}), 'category', '{cat}', 'score', {score}, "
                     f"'matched', {i}, 'considered', {n})")
    best = f"sort_array(array({', '.join(cands)}))[0]"
    known = f"{best}.score > 0"
    return [
        F.expr(f"CASE WHEN {known} THEN {best}.category ELSE 'UNKNOWN' END AS failure_mode"),
        F.expr(f"CASE WHEN {known} THEN {best}.score ELSE 0D END AS confidence"),
        F.expr(f"CAST(CASE WHEN {known} THEN {best}.matched ELSE 0 END AS BIGINT) AS n_matched"),
        F.expr(f"CAST(CASE WHEN {known} THEN {best}.considered ELSE 0 END AS BIGINT) AS n_considered"),
    ]


def signature_match(entries: DataFrame) -> DataFrame:
    """Score each failure window (from ``window_entries``) against the six signatures.

    Sums are partial aggregates on the window key, so a very large window is
    reduced map-side; the choice of the best category is a per-row array sort.
    """
    sums = entries.groupBy("machine_id", "window_start").agg(*signature_aggs())
    return sums.select("machine_id", F.col("window_start").alias("start"), *best_signature())
