"""Runs over new rows only: processed log, summaries, windows and diagnoses grow batch by batch.

A store is a folder of tables, partitioned by date:

* ``processed``: the enriched log;
* ``daily`` and ``categories``: its mergeable summaries (``partials``);
* ``windows``: failure windows with their signature scores, by start;
* ``diagnoses``: one for each window, by start.

``advance`` reads a batch, the dates it touches and what lies one rolling frame
before them, computes those dates anew and replaces their partitions; no other
date is read or written. The seconds since the previous event come from the
daily table, whatever the distance. Windows near a machine's new failures are
chained anew from the processed rows between them. So batches may come in any
order and overlap with dates already there, and the tables are those of one run
over all rows.

A batch that is given again changes nothing (rows are known by ``event_id``),
also after a run that was stopped between two tables.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from telemill.functions.exprs import epoch_us, epoch_us_sql
from telemill.operators import anomaly, diagnose, features, partials, sessions
from telemill.schema import (DEFAULT_GAP_MINUTES, DEFAULT_WINDOW_HOURS, DEFAULT_Z_THRESHOLD, SENSORS, rolling_mean_col, rolling_std_col)
from telemill.session import shared_folder
from telemill.sources.csv_logs import dealt_by_date


def table(spark: SparkSession, store: str, name: str) -> DataFrame | None:
    """A table of the store, None where it isn't there yet."""
    try:
        t = spark.read.parquet(f"{store.rstrip('/')}/{name}")
    except AnalysisException as e:
        if "PATH_NOT_FOUND" in str(e) or "UNABLE_TO_INFER_SCHEMA" in str(e):
            return None
        raise
    return t.where("NOT _empty").drop("_empty", "start_date") if "_empty" in t.columns else t


def _staged(df: DataFrame) -> DataFrame:
    """Written to a folder of its own first: a table is never read while it is replaced."""
    path, schema = shared_folder(df.sparkSession, "staged"), df.schema
    df.write.parquet(path)
    return df.sparkSession.read.schema(schema).parquet(path)


def _replace(df: DataFrame, store: str, name: str, by: str) -> None:
    """Replace the partitions that df (a written table) has rows of."""
    (dealt_by_date(df, by, df.groupBy(by).agg(F.count(F.lit(1)).alias("n"))).write.mode("overwrite")
       .option("partitionOverwriteMode", "dynamic").partitionBy(by).parquet(f"{store.rstrip('/')}/{name}"))


def _in(column: str, dates: set):
    """Rows of those dates; None stands for no date."""
    known = [d for d in dates if d is not None]
    cond = F.col(column).isin(known) if known else F.lit(False)
    return (cond | F.col(column).isNull()) if None in dates else cond


def _dates(df: DataFrame, column: str = "date") -> set:
    return {r[0] for r in df.select(column).distinct().collect()}


def _rewritten(batch: DataFrame, daily: DataFrame | None, touched: set, days: int) -> set:
    """The dates whose rows can change: touched ones, a frame's reach after them, each machine's next one."""
    out = set(touched)
    real = [d for d in touched if d is not None]
    if daily is None or not real:
        return out
    later = daily.where(F.col("date") > F.lit(min(real)))
    known = _dates(later)  # none where batches come in order of time
    out |= {d for d in known for t in real if t < d <= t + dt.timedelta(days=days)}
    if known - out:
        pairs = batch.select("machine_id", F.col("date").alias("new")).where("machine_id IS NOT NULL AND new IS NOT NULL").distinct()
        following = (pairs.join(later.select("machine_id", "date"), "machine_id").where("date > new")
                     .groupBy("machine_id", "new").agg(F.min("date").alias("date")))
        out |= _dates(following)
    return out


def _processed(rows: DataFrame, raw: list[str], daily: DataFrame | None, dates: set, window_hours: float, z_threshold: float) -> DataFrame:
    """The enriched rows of `dates`; rows: those and what lies a frame before them."""
    x = anomaly.flag_anomalies(features.rolling_stats(rows, window_hours), z_threshold)
    x = (x.withColumn("hour", F.hour("timestamp")).withColumn("day_of_week", F.weekday("timestamp"))
         .withColumn("date", F.to_date("timestamp")).where(_in("date", dates)).withColumn("_us", epoch_us("timestamp")))
    # previous event: inside the date by lag, before it from the machine's last earlier date
    spread = F.when(F.col("machine_id").isNull() | F.col("date").isNull(), F.pmod("event_id", F.lit(4096)))
    x = x.withColumn("_lag", F.lag("_us").over(Window.partitionBy("machine_id", "date", spread).orderBy("_us", "event_id")))
    ends = (rows.select("machine_id", F.to_date("timestamp").alias("date"), epoch_us("timestamp").alias("us")).where(_in("date", dates))
            .groupBy("machine_id", "date").agg(F.max("us").alias("last_us")))
    if daily is not None:
        ends = ends.unionByName(daily.where(~_in("date", dates)).select("machine_id", "date", "last_us"))
    ends = ends.where("machine_id IS NOT NULL AND date IS NOT NULL").select("machine_id", "date", F.lag("last_us").over(
        Window.partitionBy("machine_id").orderBy("date")).alias("_before"))
    x = x.join(ends, ["machine_id", "date"], "left")
    valid = F.col("machine_id").isNotNull() & F.col("timestamp").isNotNull()
    gap = (F.col("_us") - F.coalesce("_lag", "_before")) / F.lit(1e6)
    x = x.withColumn("time_since_last", F.when(valid, F.coalesce(gap, F.lit(0.0))).otherwise(F.lit(0.0)))
    stats = [c(s) for s in SENSORS for c in (rolling_mean_col, rolling_std_col)]
    flags = [c for c in x.columns if c.endswith("_anomaly") and c != "is_anomaly"]
    return x.select(*raw, "hour", "day_of_week", "date", "time_since_last", *stats, *flags, "anomaly_count", "is_anomaly")


def _with_empty(df: DataFrame, starts: set) -> DataFrame:
    """A marked row for each start date, so that a partition without windows is replaced too."""
    spark = df.sparkSession
    marks = spark.createDataFrame([(d, True) for d in sorted(starts)], "start_date date, _empty boolean")
    return df.withColumn("_empty", F.lit(False)).unionByName(marks, allowMissingColumns=True)


def advance(spark: SparkSession, new_logs: DataFrame, store: str, window_hours: float = DEFAULT_WINDOW_HOURS,
            z_threshold: float = DEFAULT_Z_THRESHOLD, gap_minutes: int = DEFAULT_GAP_MINUTES, call=None, factory: bool = False) -> dict:
    """Add a batch of rows (``event_id`` and the raw columns) to a store; returns its tables and what was touched.

    With a model ``call`` only windows that are new or have changed are
    prompted, and replies are kept in ``replies``.
    """
    raw = new_logs.columns
    batch = _staged(new_logs.withColumn("date", F.to_date("timestamp")))
    touched = _dates(batch)
    daily, old = table(spark, store, "daily"), table(spark, store, "processed")
    if touched:
        days = int(-(-window_hours // 24))
        dates = _rewritten(batch, daily, touched, days)
        rows = batch.select(raw)
        if old is not None:
            known = old.where(_in("date", touched)).select("event_id").distinct()
            rows = rows.join(known, "event_id", "left_anti")
            context = dates | {d - dt.timedelta(days=k) for d in dates if d is not None for k in range(1, days + 1)}
            rows = old.where(_in("date", context)).select(raw).unionByName(rows)
        processed = _staged(_processed(rows, raw, daily, dates, window_hours, z_threshold))
        _replace(processed, store, "processed", "date")
        _replace(_staged(partials.daily_partials(processed)), store, "daily", "date")
        _replace(_staged(partials.daily_categories(processed)), store, "categories", "date")
        _advance_windows(spark, batch, store, raw, gap_minutes, call, factory)
    return {"touched": touched, **{n: table(spark, store, n) for n in ("processed", "daily", "categories", "windows", "diagnoses")}}


def _advance_windows(spark: SparkSession, batch: DataFrame, store: str, raw: list[str], gap_minutes: int, call, factory: bool) -> None:
    gap = gap_minutes * sessions.US_PER_MINUTE
    span = (sessions.failure_events(batch).select("machine_id", epoch_us("timestamp").alias("us"))
            .groupBy("machine_id").agg(F.min("us").alias("lo"), F.max("us").alias("hi")))
    windows, diagnoses = table(spark, store, "windows"), table(spark, store, "diagnoses")
    affected = None
    if windows is not None:
        near = windows.select("machine_id", "start", epoch_us("start").alias("s"), epoch_us("end").alias("e")).join(span, "machine_id")
        affected = _staged(near.where(f"e >= lo - {gap} AND s <= hi + {gap}").select("machine_id", "start", "s", "e"))
        span = (span.unionByName(affected.select("machine_id", F.col("s").alias("lo"), F.col("e").alias("hi")))
                .groupBy("machine_id").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")))
    span = _staged(span)
    reach = span.agg(F.min("lo"), F.max("hi")).first()
    if reach[0] is None:
        return
    first, last = (dt.date(1970, 1, 1) + dt.timedelta(days=us // 86_400_000_000) for us in reach)
    fails = sessions.failure_events(table(spark, store, "processed").where(F.col("date").between(F.lit(first), F.lit(last)))).select(raw)
    fails = fails.withColumn("_at", F.expr(epoch_us_sql("`timestamp`"))).join(span, "machine_id").where("_at BETWEEN lo AND hi").select(raw)
    changed = _staged(diagnose.scored_windows(sessions.window_entries(fails, gap_minutes)).withColumn("start_date", F.to_date("start")))
    starts = _dates(changed, "start_date")
    if affected is not None:
        starts |= _dates(affected.select(F.to_date("start").alias("start_date")), "start_date")
    if call is None:
        told = diagnose.signature_diagnoses(changed)
    else:
        from telemill.operators.replies import resumable_replies
        keys = ["machine_id", "start", "end", "part"]
        prompts = diagnose.window_prompts(sessions.prepared_windows(fails, None, gap_minutes))
        replies = resumable_replies(prompts, call, keys, f"{store.rstrip('/')}/replies", factory=factory)
        told = diagnose.merge_parts(diagnose.to_diagnoses(diagnose.parse_responses(replies), keys), keys[:3])
    day = F.to_date(F.col("start").cast("timestamp_ntz")).alias("start_date")
    told = told.select("*", day)
    if affected is not None:
        keep = windows.select("*", day).where(_in("start_date", starts)).join(affected, ["machine_id", "start"], "left_anti")
        changed = keep.unionByName(changed, allowMissingColumns=True)
        if diagnoses is not None:
            gone = affected.select("machine_id", F.col("start").alias("_start"))
            kept = diagnoses.select("*", day).where(_in("start_date", starts))
            kept = kept.join(gone, (kept["machine_id"] == gone["machine_id"]) & (kept["start"].cast("timestamp_ntz") == gone["_start"]), "left_anti")
            told = kept.unionByName(told, allowMissingColumns=True)
    _replace(_staged(_with_empty(changed, starts)), store, "windows", "start_date")
    _replace(_staged(_with_empty(told, starts)), store, "diagnoses", "start_date")
