"""Z-scores against the rolling baseline, anomaly flags and anomaly views."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from telemill.functions.exprs import epoch_us
from telemill.schema import (SENSORS, DEFAULT_Z_THRESHOLD, rolling_mean_col, rolling_std_col,
                             anomaly_col, zscore_col)


def _sensors_with_stats(df: DataFrame) -> list[str]:
    cols = set(df.columns)
    return [s for s in SENSORS if rolling_mean_col(s) in cols and rolling_std_col(s) in cols]


def zscore(sensor: str) -> Column:
    """|x - mean| / std when std > 0, else 0 (NULL reading -> NULL)."""
    m, s = F.col(rolling_mean_col(sensor)), F.col(rolling_std_col(sensor))
    return F.when(s > 0, F.abs(F.col(sensor) - m) / s).otherwise(F.lit(0.0))


def sensor_zscores(df: DataFrame) -> DataFrame:
    return df.select("*", *[zscore(s).alias(zscore_col(s)) for s in _sensors_with_stats(df)])


def flag_anomalies(df: DataFrame, z_threshold: float = DEFAULT_Z_THRESHOLD) -> DataFrame:
    """``{sensor}_anomaly`` = z > threshold (strict), ``anomaly_count``, ``is_anomaly``.

    Sensors without rolling columns are skipped; with none the count is 0.
    """
    sensors = _sensors_with_stats(df)
    flags = [F.coalesce(zscore(s) > F.lit(z_threshold), F.lit(False)).alias(anomaly_col(s))
             for s in sensors]
    out = df.select("*", *flags)
    count = reduce(lambda a, b: a + b, [F.col(anomaly_col(s)).cast("int") for s in sensors], F.lit(0))
    return (out.withColumn("anomaly_count", count.cast("int"))
               .withColumn("is_anomaly", F.col("anomaly_count") > 0))


def anomalies_by_sensor(enriched: DataFrame) -> DataFrame:
    """Flagged readings per machine and sensor: one aggregate pass, long output."""
    sensors = [s for s in SENSORS if anomaly_col(s) in enriched.columns]
    wide = (enriched.where(F.col("machine_id").isNotNull())
            .groupBy("machine_id")
            .agg(*[F.sum(F.col(anomaly_col(s)).cast("long")).alias(s) for s in sensors]))
    stack = ", ".join(f"'{s}', `{s}`" for s in sensors)
    return wide.selectExpr("machine_id", f"stack({len(sensors)}, {stack}) as (sensor, n_anomalies)")


def sensor_trend(enriched: DataFrame, sensor: str = "temperature_c",
                 machine_id: str | None = None) -> DataFrame:
    """Reading, rolling mean and flag of one sensor over time (one machine or all).

    The machine filter is on the window partition key, so Catalyst pushes it
    below the rolling window.
    """
    df = enriched if machine_id is None else enriched.where(F.col("machine_id") == machine_id)
    cols = set(enriched.columns)
    mean = F.col(rolling_mean_col(sensor)) if rolling_mean_col(sensor) in cols else F.lit(None).cast("double")
    flag = F.col(anomaly_col(sensor)) if anomaly_col(sensor) in cols else F.lit(False)
    return df.select("machine_id", "timestamp", "event_id", F.col(sensor).alias("value"),
                     mean.alias("rolling_mean"), flag.alias("is_anomaly"))


def sensor_anomalies_top(enriched: DataFrame, sensor: str = "temperature_c",
                         machine_id: str | None = None, n: int = 20,
                         bucket_hours: int = 24) -> DataFrame:
    """The first ``n`` anomalous readings of a sensor per machine, by time.

    Two-phase top-n: rank inside (machine, day) first, so a machine with very
    many anomalies is cut down in parallel before the per-machine ranking,
    which then sees at most ``n`` rows per bucket.
    """
    flag = anomaly_col(sensor)
    df = enriched.where(F.col(flag) & F.col("machine_id").isNotNull())
    if machine_id is not None:
        df = df.where(F.col("machine_id") == machine_id)
    bucket_us = bucket_hours * 3_600_000_000
    df = df.withColumn("_b", F.floor(epoch_us("timestamp") / F.lit(bucket_us)).cast("long"))
    local = Window.partitionBy("machine_id", "_b").orderBy("timestamp", "event_id")
    glob = Window.partitionBy("machine_id").orderBy("timestamp", "event_id")
    cand = df.withColumn("_r", F.row_number().over(local)).where(F.col("_r") <= n)
    top = cand.withColumn("rank", F.row_number().over(glob)).where(F.col("rank") <= n)
    return top.select("machine_id", "rank", "timestamp", "event_id", "severity",
                      F.col(sensor).alias("value"), "operator_notes")


