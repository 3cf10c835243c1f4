"""Failure windows over a stream: watermark + ``session_window`` in append mode.

A window is emitted once the watermark passes its last event + gap, i.e.
when no later event can still join it; the values equal the batch operator
for every closed window; later rows and windows still open at the end are lost
(``stateful_windows`` keeps both). ``withWatermark`` needs a ``TIMESTAMP``
column, so the naive log time is taken as UTC.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from telemill.functions.exprs import epoch_us, epoch_us_sql
from telemill.operators.sessions import failure_events, value_set
from telemill.schema import DEFAULT_GAP_MINUTES
from telemill.session import checkpoint_dir


def stream_failure_windows(logs: DataFrame, gap_minutes: int = DEFAULT_GAP_MINUTES,
                           watermark: str = "2 hours") -> DataFrame:
    f = failure_events(logs).withColumn("_event_time", F.expr(f"timestamp_micros({epoch_us_sql('`timestamp`')})"))
    g = (f.withWatermark("_event_time", watermark)
          .groupBy("machine_id", F.session_window("_event_time", f"{gap_minutes} minutes").alias("_sw"))
          .agg(F.min("timestamp").alias("start"),
               F.max("timestamp").alias("end"),
               F.count(F.lit(1)).alias("event_count"),
               F.max((F.col("severity") == "CRITICAL").cast("int")).alias("_crit"),
               value_set("failure_category").alias("_cats"),
               value_set("error_code").alias("_codes")))
    return g.select(
        "machine_id", "start", "end",
        ((epoch_us("end") - epoch_us("start")) / F.lit(6e7)).alias("duration_minutes"),
        "event_count",
        F.when(F.col("_crit") == 1, "CRITICAL").otherwise("ERROR").alias("max_severity"),
        F.col("_cats").alias("failure_categories"),
        F.col("_codes").alias("error_codes"))


def start_failure_window_stream(spark: SparkSession, logs: DataFrame, sink_path: str,
                                checkpoint_location: str | None = None,
                                gap_minutes: int = DEFAULT_GAP_MINUTES, watermark: str = "2 hours",
                                available_now: bool = True) -> StreamingQuery:
    """Run the windows stream into a Parquet sink (exactly-once via the checkpoint)."""
    loc = checkpoint_location or f"{checkpoint_dir(spark).rstrip('/')}/streams/failure_windows"
    w = (stream_failure_windows(logs, gap_minutes, watermark).writeStream
         .outputMode("append").format("parquet")
         .option("path", sink_path).option("checkpointLocation", loc))
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="1 minute")
    return w.start()
