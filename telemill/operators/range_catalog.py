"""Catalogs of ranges and signatures as tables of any size.

A reading is matched to ranges by an equality join on (sensor, level, cell). A
level is a grid of cells of one width, each level twice as wide as the one
below. A range lies on the lowest level whose cells are as wide as it is, so it
touches one or two of them; a reading lies in one cell of each level that the
catalog uses for its sensor. The range itself decides last. So the join
compares a reading only with ranges near its value: no nested loops, and the
smaller side is broadcast only where Spark has measured it to be small.

A bound that is NULL is open. Ranges are (category, sensor, low, high).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from telemill.operators.catalog import NORMAL_RANGES, SIGNATURES
from telemill.schema import SENSORS

#: Level of ranges with an open bound: one cell for all values.
OPEN_LEVEL = 10_000


def built_in_ranges(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([("NORMAL", *r) for r in NORMAL_RANGES], "category string, sensor string, low double, high double")


def built_in_signatures(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(SIGNATURES, "category string, sensor string, low double, high double")


def readings(rows: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, sensor, value) of all non-NULL sensor cells."""
    pairs = ", ".join(f"'{s}', `{s}`" for s in SENSORS)
    return rows.selectExpr(*keys, f"stack({len(SENSORS)}, {pairs}) AS (sensor, value)").where("value IS NOT NULL")


def _levels(ranges: DataFrame) -> DataFrame:
    """Ranges with their level; a range of one value lies on the level of the narrowest real one, or on level 0."""
    width = F.col("high") - F.col("low")
    narrow = F.min(F.when(width > 0, F.ceil(F.log2(width)))).over(Window.partitionBy("sensor"))
    level = F.when(F.col("low").isNull() | F.col("high").isNull(), F.lit(OPEN_LEVEL)).when(
        width > 0, F.ceil(F.log2(width))).otherwise(F.coalesce(narrow, F.lit(0)))
    return ranges.where("low IS NULL OR high IS NULL OR low <= high").withColumn("level", level.cast("int"))


def _cell(value: str) -> str:
    return f"CASE WHEN level = {OPEN_LEVEL} THEN 0D ELSE floor({value} / pow(2D, level)) + 0D END"


def matches(values: DataFrame, ranges: DataFrame) -> DataFrame:
    """The rows of ``readings`` beside every range (category, low, high) that holds their value."""
    r = _levels(ranges)
    cells = r.selectExpr("*", f"{_cell('low')} AS c0", f"{_cell('high')} AS c1")
    # as wide as a cell at most: the range lies in the cells of its two ends
    cells = cells.select("category", "sensor", "low", "high", "level", F.explode(F.array_distinct(F.array("c0", "c1"))).alias("cell"))
    used = r.groupBy("sensor").agg(F.sort_array(F.collect_set("level")).alias("levels"))  # at most some two thousand numbers a sensor
    x = values.join(F.broadcast(used), "sensor").withColumn("level", F.explode("levels")).drop("levels")
    x = x.withColumn("cell", F.expr(_cell("value")))
    hit = x.join(cells, ["sensor", "level", "cell"])
    return hit.where("(low IS NULL OR value >= low) AND (high IS NULL OR value <= high)").drop("level", "cell")


def out_of_range(logs: DataFrame, ranges: DataFrame) -> DataFrame:
    """(machine_id, sensor, n_readings, n_out_of_range): readings inside none of their sensor's ranges.

    Readings of a sensor without ranges are not judged. Rows are told apart by ``event_id``.
    """
    values = readings(logs.where("machine_id IS NOT NULL"), ["machine_id", "event_id"])
    sensors = ranges.select("sensor").distinct()
    judged = values.join(F.broadcast(sensors), "sensor", "left_semi")  # a row a sensor, six in all
    counts = judged.groupBy("machine_id", "sensor").agg(F.count(F.lit(1)).alias("n_readings"))
    inside = (matches(values, ranges).select("machine_id", "sensor", "event_id").distinct()
              .groupBy("machine_id", "sensor").agg(F.count(F.lit(1)).alias("n_in")))
    every = (logs.where("machine_id IS NOT NULL").select("machine_id").distinct()
             .select("machine_id", F.explode(F.array(*[F.lit(s) for s in SENSORS])).alias("sensor"))
             .join(F.broadcast(sensors), "sensor", "left_semi"))
    out = every.join(counts, ["machine_id", "sensor"], "left").join(inside, ["machine_id", "sensor"], "left")
    n = F.coalesce("n_readings", F.lit(0).cast("long"))
    return out.select("machine_id", "sensor", n.alias("n_readings"), (n - F.coalesce("n_in", F.lit(0).cast("long"))).alias("n_out_of_range"))


def signature_match(entries: DataFrame, signatures: DataFrame) -> DataFrame:
    """``catalog.signature_match`` for a table of signatures: (machine_id, start, failure_mode, confidence, n_matched, n_considered).

    Only categories with a matching reading are looked at further, so the work
    goes by the matches and not by windows times categories.
    """
    key = ["machine_id", "window_start"]
    values = readings(entries, [*key, "seq"])
    known = signatures.where("sensor IS NOT NULL AND category IS NOT NULL")
    found = matches(values, known).groupBy(*key, "category").agg(F.count(F.lit(1)).alias("n_in"))
    per_sensor = values.groupBy(*key, "sensor").agg(F.count(F.lit(1)).alias("n"))
    parts = known.groupBy("category", "sensor").agg(F.count(F.lit(1)).alias("times"))
    seen = (found.join(parts, "category").join(per_sensor, [*key, "sensor"])
            .groupBy(*key, "category", "n_in").agg(F.sum(F.col("n") * F.col("times")).alias("n_nn")))
    score = F.col("n_in") / F.col("n_nn")
    order = Window.partitionBy(*key).orderBy(F.desc("score"), "category")
    best = seen.withColumn("score", score).withColumn("k", F.row_number().over(order)).where("k = 1")
    out = entries.select(*key).distinct().join(best, key, "left")
    zero = F.lit(0).cast("long")
    return out.select("machine_id", F.col("window_start").alias("start"), F.coalesce("category", F.lit("UNKNOWN")).alias("failure_mode"),
                      F.coalesce("score", F.lit(0.0)).alias("confidence"), F.coalesce("n_in", zero).alias("n_matched"),
                      F.coalesce("n_nn", zero).alias("n_considered"))
