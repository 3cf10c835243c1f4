"""Fleet summaries merged from one row per date and machine.

``daily_partials`` is the only pass over the processed log; all sums, rates and
ranges of ``summary`` follow from its rows, which a new date adds to and a
changed date replaces. Their number is that of machine-days, not of events.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from telemill.functions.exprs import epoch_us
from telemill.operators import summary
from telemill.schema import SENSORS, SEVERITIES, anomaly_col


def daily_partials(enriched: DataFrame) -> DataFrame:
    """(date, machine_id) -> counts, anomalies and times; rows without machine or date have rows of their own."""
    flags = [F.sum(F.col(anomaly_col(s)).cast("long")).alias(f"anomalies_{s}") for s in SENSORS]
    return enriched.withColumn("_us", epoch_us("timestamp")).groupBy("date", "machine_id").agg(
        F.count(F.lit(1)).alias("n"), F.count("severity").alias("n_severity"),
        F.sum(summary.error_flag().cast("long")).alias("n_failures"),
        *[F.count(F.when(F.col("severity") == s, F.lit(1))).alias(f"n_{s}") for s in SEVERITIES],
        F.sum(F.col("is_anomaly").cast("long")).alias("n_anomalous"), *flags,
        F.min("timestamp").alias("first"), F.max("timestamp").alias("last"), F.max("_us").alias("last_us"))


def daily_categories(logs: DataFrame) -> DataFrame:
    """(date, failure_category, n) of non-blank categories."""
    return (logs.where("failure_category <> ''").groupBy("date", "failure_category").agg(F.count(F.lit(1)).alias("n")))


def overview(daily: DataFrame) -> DataFrame:
    """The row of ``summary.overview``."""
    return summary.overview_row(daily.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("total_entries"), (F.sum("n_failures") / F.sum("n") * 100).alias("_pct"),
        F.count_distinct("machine_id").alias("machines"), F.coalesce(F.sum("n_anomalous"), F.lit(0)).alias("sensor_anomalies"),
        F.min("first").alias("time_start"), F.max("last").alias("time_end")))


def severity_summary(daily: DataFrame) -> DataFrame:
    """The rows of ``summary.severity_summary``."""
    return (daily.where("machine_id IS NOT NULL AND n_severity > 0").groupBy("machine_id")
            .agg(*[F.sum(f"n_{s}").alias(s) for s in SEVERITIES]).orderBy("machine_id"))


def severity_counts(daily: DataFrame) -> DataFrame:
    """The rows of ``summary.severity_counts``."""
    agg = daily.agg(*[F.coalesce(F.sum(f"n_{s}"), F.lit(0)).alias(s) for s in SEVERITIES])
    pairs = ", ".join(f"{i}, '{s}', `{s}`" for i, s in enumerate(SEVERITIES))
    return agg.selectExpr(f"stack({len(SEVERITIES)}, {pairs}) as (ord, severity, n)")


def category_counts(categories: DataFrame) -> DataFrame:
    """The rows of ``summary.category_counts`` from ``daily_categories``."""
    return categories.groupBy("failure_category").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "failure_category")


def anomalies_by_sensor(daily: DataFrame) -> DataFrame:
    """(machine_id, sensor, n_anomalies)."""
    sums = daily.where("machine_id IS NOT NULL").groupBy("machine_id").agg(*[F.sum(f"anomalies_{s}").alias(s) for s in SENSORS])
    return sums.selectExpr("machine_id", f"stack({len(SENSORS)}, {', '.join(f'{s!r}, `{s}`' for s in SENSORS)}) AS (sensor, n_anomalies)")


def report_stats(daily: DataFrame, windows: DataFrame, diagnoses: DataFrame | None = None) -> DataFrame:
    """The rows of ``summary.report_stats``."""
    machines = daily.where("machine_id IS NOT NULL").select("machine_id").distinct()
    return summary.stats_rows(overview(daily), machines, windows, diagnoses)
