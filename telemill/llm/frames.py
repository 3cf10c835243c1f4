"""Reading, Arrow batches and written intermediate tables for this subpackage."""

from __future__ import annotations

import gc
import os
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from telemill.session import shared_folder

#: Most tasks that a shuffle by bucket is dealt to; a task then goes through several buckets, one at a time.
MOST_TASKS = 20_000
#: Rows in an Arrow batch, so that a batch of the longest documents fits a worker.
BATCH_ROWS = 1000


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


#: The folder that holds the package; workers started in this machine find it there, a cluster ships it (--py-files).
ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def map_batches(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]],
                schema: str) -> DataFrame:
    """mapInArrow with batches of a bounded number of rows."""
    spark = df.sparkSession
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > BATCH_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    env = spark.sparkContext.environment
    if ROOT not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(filter(None, [env.get("PYTHONPATH"), ROOT]))
    return df.mapInArrow(fn, schema)


def as_text(df: DataFrame, id_col: str, text_col: str, *more) -> DataFrame:
    """(doc_id long, text string, more columns), null text as empty; everything else is pruned."""
    return df.select(df[id_col].cast("long").alias("doc_id"),
                     F.coalesce(df[text_col].cast("string"), F.lit("")).alias("text"), *more)


def written(df: DataFrame) -> DataFrame:
    """The same rows, written as Parquet in the shared folder and read again.

    It cuts the lineage (a lost executor costs no earlier stage) and lets
    several readers share one computation.
    """
    spark, schema = df.sparkSession, df.schema
    path = shared_folder(spark)
    df.write.parquet(path)
    del df
    # The shuffle files behind the table go once nothing refers to the plan; the
    # session's listeners hold on to their last event's plan until another event.
    spark.sql("SELECT 1").collect()
    gc.collect()
    spark.sparkContext._jvm.System.gc()
    return spark.read.schema(schema).parquet(path)


def total_bytes(df: DataFrame, text_col: str = "text") -> int:
    return df.agg(F.sum(F.octet_length(text_col))).first()[0] or 0


def buckets(n_bytes: int, each: int, least: int = 8) -> int:
    """How many buckets of about `each` bytes."""
    return max(least, -(-n_bytes // each))
