"""Model runs that can be taken up again.

Replies are rows of a Parquet table, keyed by the prompt's key and a hash of
its text. A run deals the prompts that have no reply yet into batches and
appends the replies of one batch in one commit. A run that was stopped asks
again at most for the batch it was in; a prompt whose text has changed since is
asked anew.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.utils import AnalysisException

from telemill.operators import diagnose
from telemill.session import shared_folder

#: Prompts whose replies are committed together.
BATCH_PROMPTS = 10_000


def _table(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], schema)


def resumable_replies(prompts: DataFrame, call, key_cols: list[str], path: str, prompt_col: str = "prompt",
                      max_tokens: int = diagnose.WINDOW_MAX_TOKENS, system_prompt: str = diagnose.SYSTEM_PROMPT,
                      partitions: int = diagnose.MODEL_PARTITIONS, factory: bool = False,
                      batch_prompts: int = BATCH_PROMPTS) -> DataFrame:
    """(keys, response) for every prompt; ``path`` is the table of replies, which other runs may have begun.

    The table also holds replies to prompts not asked here; they stay. A NULL
    prompt has a NULL response. Keys are unique, and not NULL.
    """
    spark = prompts.sparkSession
    keys = [*key_cols, "prompt_hash"]
    asked = prompts.select(*key_cols, F.xxhash64(prompt_col).alias("prompt_hash"), F.col(prompt_col).alias("prompt"))
    folder = shared_folder(spark, "prompts")
    asked.write.parquet(f"{folder}/asked")
    asked = spark.read.schema(asked.schema).parquet(f"{folder}/asked")
    schema = T.StructType([f for f in asked.schema.fields if f.name in keys] + [T.StructField("response", T.StringType())])
    left = asked.join(_table(spark, path, schema).select(keys), keys, "left_anti")
    n = left.count()
    if n:
        # dealt by hash into parts of a bounded size, in numbers that follow each other within a part
        parts = max(1, -(-n // batch_prompts))
        part = F.pmod(F.xxhash64(*keys), F.lit(parts))
        number = F.row_number().over(Window.partitionBy("_part").orderBy(*keys)) - 1
        left = left.withColumn("_part", part).withColumn("_batch", F.col("_part") + F.lit(parts) * F.floor(number / batch_prompts))
        left.drop("_part").write.partitionBy("_batch").parquet(f"{folder}/left")
        batches = spark.read.schema(T.StructType([*asked.schema.fields, T.StructField("_batch", T.LongType())])).parquet(f"{folder}/left")
        for b in sorted(r["_batch"] for r in batches.select("_batch").distinct().collect()):
            replies = diagnose.infer(batches.where(F.col("_batch") == b), call, keys, "prompt", max_tokens, system_prompt,
                                     partitions, factory, persist=False)
            replies.write.mode("append").parquet(path)
    return asked.drop("prompt").join(_table(spark, path, schema).dropDuplicates(keys), keys).select(*key_cols, "response")
