"""The full analysis run: logs in, processed table + diagnostic report out.

Stages (each a lazy plan; data crosses to the driver only at the sinks):

1. enrich the log in one shuffle (time features, rolling stats, flags) and
   write it as Parquet partitioned by date — the written table cuts the
   lineage, so every later output re-reads it instead of recomputing;
2. failure windows, overview stats;
3. diagnoses of the first ``max_windows`` windows, None for all (model call or
   the signature scores), fleet summary, report rows;
4. report text sink.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from telemill.operators import diagnose, features, report, sessions, summary
from telemill.operators import fleet as fleet_tree
from telemill.functions.exprs import round1
from telemill.schema import DEFAULT_MAX_WINDOWS
from telemill.sources.csv_logs import write_enriched, write_report


def signature_fleet(diagnoses: DataFrame) -> DataFrame:
    """Offline fleet record from the issue table, which has one row per failure mode.

    Machines are given by number; who they are is in ``fleet_issue_machines``.
    """
    issues = diagnose.fleet_issues(diagnoses)
    rec = issues.agg(
        F.sum("n_windows").alias("n"), F.sum("hours").alias("hours"),
        F.array_sort(F.collect_list(F.struct((-F.col("n_windows")).alias("k"), "failure_mode", "n_windows", "n_machines",
                                             "n_critical"))).alias("items"))
    items = F.filter("items", lambda i: i["failure_mode"] != "UNKNOWN")

    def machines(i):
        return F.array(F.concat(i["n_machines"].cast("string"), F.lit(" machines")))

    return rec.select(
        F.concat(F.coalesce(F.col("n"), F.lit(0)).cast("string"), F.lit(" failure windows analysed; most frequent mode: "),
                 F.coalesce(F.try_element_at(items, F.lit(1))["failure_mode"], F.lit("none")), F.lit("."))
         .alias("executive_summary"),
        F.transform(items, lambda i: F.struct(
            F.concat(i["failure_mode"], F.lit(" failures")).alias("issue"),
            machines(i).alias("affected_machines"),
            F.concat(i["n_windows"].cast("string"), F.lit(" windows")).alias("frequency"),
            F.concat(i["n_critical"].cast("string"), F.lit(" critical windows")).alias("business_impact"))
        ).alias("top_issues"),
        F.transform(items, lambda i: F.struct(
            F.concat(F.lit("Inspect the "), F.lower(i["failure_mode"]), F.lit(" subsystem")).alias("action"),
            machines(i).alias("machines"),
            F.when(i["n_critical"] > 0, "IMMEDIATE").otherwise("THIS_WEEK").alias("priority"),
            F.concat(i["n_windows"].cast("string"), F.lit(" failure windows")).alias("rationale"))
        ).alias("maintenance_priorities"),
        F.transform(F.filter(items, lambda i: i["n_critical"] * 10 > i["n_windows"]), lambda i: F.concat(
            F.lit("Over a tenth of "), i["failure_mode"], F.lit(" windows are critical"))).alias("trend_alerts"),
        F.coalesce(F.col("hours"), F.lit(0.0)).alias("_hours"), F.lit("ok").alias("status"),
    ).select("executive_summary", "top_issues", "maintenance_priorities", "trend_alerts",
             round1("_hours").alias("estimated_downtime_savings_hours"), "status",
             F.lit(None).cast("string").alias("raw_response"))


FLEET_COLUMNS = ["executive_summary", "top_issues", "maintenance_priorities", "trend_alerts", "estimated_downtime_savings_hours",
                 "status", "raw_response"]


def fleet_summary(diagnoses: DataFrame, call=None, per_prompt: int = diagnose.FLEET_ITEMS, factory: bool = False,
                  fan_in: int = fleet_tree.FAN_IN, replies_path: str | None = None) -> DataFrame:
    """The fleet record over all diagnoses given: one, whatever their number."""
    if call is None:
        return signature_fleet(diagnoses)
    return fleet_tree.fleet_tree(diagnoses, call, per_prompt, fan_in, factory, replies_path=replies_path).select(FLEET_COLUMNS)


def analyze(spark: SparkSession, logs: DataFrame, out_dir: str, max_windows: int | None = DEFAULT_MAX_WINDOWS,
            call=None, factory: bool = False, generated_at: str | None = None, resume: bool = False) -> dict:
    """Run the whole analysis; returns the output DataFrames (re-read from the sinks).

    With ``resume`` the model's replies are kept below ``out_dir``: a run that was
    stopped, or one over a longer log, asks only for windows without a reply.
    """
    out = out_dir.rstrip("/")
    counts = logs.groupBy(F.to_date("timestamp").alias("date")).agg(F.count(F.lit(1)).alias("n"))
    write_enriched(features.enrich(logs), f"{out}/processed_logs", counts=counts)
    enriched = spark.read.parquet(f"{out}/processed_logs")
    entries = sessions.window_entries(enriched)
    windows = sessions.summarize_windows(entries)
    stats = summary.report_stats(enriched, entries)
    diagnoses = diagnose.diagnose(sessions.first_part(enriched, max_windows), call, max_windows, factory=factory,
                                  replies_path=f"{out}/replies" if resume else None)
    diagnoses.write.mode("overwrite").parquet(f"{out}/diagnoses")
    diagnoses = spark.read.parquet(f"{out}/diagnoses")
    fleet = fleet_summary(diagnoses, call, factory=factory, replies_path=f"{out}/fleet_replies" if resume else None)
    when = generated_at or dt.datetime.now(dt.timezone.utc).strftime("%Y-%m-%d %H:%M:%S")
    rows = report.assemble_report(diagnoses, when, fleet, stats)
    write_report(rows, f"{out}/diagnostic_report")
    return {"enriched": enriched, "windows": windows, "stats": stats, "diagnoses": diagnoses,
            "fleet": fleet, "report": rows}
