"""A training-data pipeline over `documents`, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes
each stage's rows as Parquet in the shared folder and reads them again as the
next one's docs, so a lost executor never costs more than one stage. All
stages but the last return the columns of `documents`; whatever other columns
there are pass through unchanged.

Defined cases: an empty table gives an empty result; null texts have no words
and go with the quality rules; of repeated rows one stays, and rows of one
doc_id with unlike texts stay all; rows without doc_id are near-duplicates as
others are (one with a doc_id is kept first) and take part in all stages.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from telemill.llm import automaton_dedup, minmax, packing, pii, repetition
from telemill.llm.frames import documents, written


def _counted(docs: DataFrame) -> DataFrame:
    """n_chars follows the text where there is such a column."""
    if "n_chars" not in docs.columns:
        return docs
    return docs.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the rules on repetition."""
    return repetition.filter_quality(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near-duplicates: the one with the least doc_id (rows without doc_id come last).

    Rows are numbered, so that repeated rows and rows without doc_id are judged as all others. The
    row itself lies in a struct beside its number: no column name is in the way.
    """
    rows = written(docs.select(F.struct("*").alias("row"), F.monotonically_increasing_id().alias("number")))
    texts = rows.select("number", F.col("row.text").alias("text"))
    near = minmax.near_duplicates(texts, id_col="number").select(F.col("doc_id").alias("number"), "n_shingles", "component_id")
    ids = rows.select("number", F.col("row.doc_id").cast("long").alias("id"))
    # texts without words are linked to nothing: there rows of one doc_id are the copies
    group = (F.when(F.col("n_shingles") > 0, F.struct(F.lit(0).alias("kind"), F.col("component_id").alias("of")))
             .when(F.col("id").isNotNull(), F.struct(F.lit(1).alias("kind"), F.col("id").alias("of")))
             .otherwise(F.struct(F.lit(2).alias("kind"), F.col("number").alias("of"))))
    first = F.min(F.struct(F.isnull("id").alias("last"), "id", "number")).alias("first")
    keep = written(near.join(ids, "number").groupBy(group.alias("group")).agg(first).select("first.number"))
    return rows.join(keep, "number", "left_semi").select("row.*")


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages that are repeated anywhere."""
    return _counted(automaton_dedup.rewrite(docs))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with personal data replaced by its kind."""
    return _counted(pii.redact(docs))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token sequences."""
    import public_tokenizers as P
    return packing.pack(docs, P.path("word_bpe_49k.json"))


STAGES = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("repeated_passages", repeated_passages),
    ("personal_data", personal_data),
    ("pack", pack),
]

#: Sequences of a learned vocabulary are beyond SQL; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
