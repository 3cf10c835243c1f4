"""Fleet and machine summaries: severity matrix and counts, categories, overview, stats rows.

All are single hash aggregations with map-side partial aggregation; results
are tiny (machines x 4, a handful of categories, one row).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from telemill.functions.exprs import fixed, round1, thousands, ts_text
from telemill.schema import SEVERITIES, FAILURE_SEVERITIES


def severity_summary(logs: DataFrame) -> DataFrame:
    """Machine x severity counts: the four fixed columns in order, 0 when absent.

    A machine whose rows all carry another severity keeps a row of zeros; rows
    without machine or severity are not counted (as a pandas groupby does).
    """
    f = logs.where(F.col("machine_id").isNotNull() & F.col("severity").isNotNull())
    return (f.groupBy("machine_id")
             .agg(*[F.count(F.when(F.col("severity") == s, F.lit(1))).alias(s) for s in SEVERITIES])
             .orderBy("machine_id"))


def severity_counts(logs: DataFrame) -> DataFrame:
    """Fleet counts for the fixed severity domain, 0 filled, in domain order.

    One global aggregate of four conditional counts, unpivoted: the domain
    alignment needs no join.
    """
    agg = logs.agg(*[F.count(F.when(F.col("severity") == s, F.lit(1))).alias(s) for s in SEVERITIES])
    pairs = ", ".join(f"{i}, '{s}', `{s}`" for i, s in enumerate(SEVERITIES))
    return agg.selectExpr(f"stack({len(SEVERITIES)}, {pairs}) as (ord, severity, n)")


def category_counts(logs: DataFrame) -> DataFrame:
    """Rows per non-blank failure category, most frequent first (ties by name)."""
    return (logs.where(F.col("failure_category").isNotNull() & (F.col("failure_category") != ""))
                .groupBy("failure_category").agg(F.count(F.lit(1)).alias("n"))
                .orderBy(F.desc("n"), "failure_category"))


def error_flag():
    return F.coalesce(F.col("severity").isin(*FAILURE_SEVERITIES), F.lit(False))


def overview(enriched: DataFrame) -> DataFrame:
    """One row: entries (also as text with thousands separators), error rate (% to 1 dp),
    number of machines, anomalous rows, time range. The machines themselves are rows (``machine_list``)."""
    anomalies = (F.sum(F.col("is_anomaly").cast("long")) if "is_anomaly" in enriched.columns
                 else F.lit(0).cast("long"))
    return overview_row(enriched.agg(
        F.count(F.lit(1)).alias("total_entries"),
        (F.avg(error_flag().cast("double")) * 100).alias("_pct"),
        F.count_distinct("machine_id").alias("machines"),
        F.coalesce(anomalies, F.lit(0).cast("long")).alias("sensor_anomalies"),
        F.min("timestamp").alias("time_start"),
        F.max("timestamp").alias("time_end")))


def overview_row(sums: DataFrame) -> DataFrame:
    """The overview as it is shown, from its sums (``_pct`` is the unrounded error rate)."""
    return (sums
            .select("total_entries", thousands(F.col("total_entries")).alias("entries_text"),
                    round1("_pct").alias("error_rate"), "machines", "sensor_anomalies", "time_start", "time_end",
                    F.concat(fixed("_pct", 1), F.lit("%")).alias("error_rate_text")))


def machine_list(logs: DataFrame) -> DataFrame:
    """The machines, one row each."""
    return logs.where(F.col("machine_id").isNotNull()).select("machine_id").distinct()


def report_stats(enriched: DataFrame, entries: DataFrame, diagnoses: DataFrame | None = None) -> DataFrame:
    """Dataset-overview rows (ord, tie, metric, value) as the report prints them.

    Machines are one row each, ordered by ``tie``. ``entries`` are
    ``window_entries`` rows: a window is counted at its first entry. With
    ``diagnoses`` their number is added, as the exported report shows it.
    """
    return stats_rows(overview(enriched), machine_list(enriched), entries.where("seq = 1"), diagnoses)


def stats_rows(o: DataFrame, machine_rows: DataFrame, windows: DataFrame, diagnoses: DataFrame | None = None) -> DataFrame:
    """The rows of ``report_stats`` from the overview, the machines and the windows (a row each)."""

    def row(i, metric, value):
        return F.struct(F.lit(i).alias("ord"), F.lit("").alias("tie"), F.lit(metric).alias("metric"),
                        value.alias("value"))

    rows = o.select(F.explode(F.array(
        row(1, "Total entries", F.col("total_entries").cast("string")),
        row(2, "Time range", F.concat(ts_text("time_start"), F.lit(" → "), ts_text("time_end"))),
        row(5, "Sensor anomalies", F.col("sensor_anomalies").cast("string")),
        row(6, "Error rate", F.col("error_rate_text")),
    )).alias("r")).select("r.*")
    machines = machine_rows.select(F.lit(3).alias("ord"), F.col("machine_id").alias("tie"),
                                   F.lit("Machines").alias("metric"), F.col("machine_id").alias("value"))

    def counted(df, i, metric):
        return df.agg(F.count(F.lit(1)).cast("string").alias("value")).select(
            F.lit(i).alias("ord"), F.lit("").alias("tie"), F.lit(metric).alias("metric"), "value")

    rows = rows.unionByName(machines).unionByName(counted(windows, 4, "Failure windows"))
    if diagnoses is not None:
        rows = rows.unionByName(counted(diagnoses, 7, "Failure windows analyzed"))
    return rows
