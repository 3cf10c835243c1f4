"""CSV records with line breaks inside quotes, from files that are split between tasks.

A byte range of a file can't tell whether it begins inside quotes. Two passes
over the physical lines (Spark's text reader) find out:

1. Each range counts its lines with an odd number of quotes (a map-side
   aggregate, one row a range). In the order of a file's ranges the running sum
   of these counts says whether a range begins inside quotes, where the record
   that is open there began, and whether the range ends inside quotes.
2. Every range joins its own lines to records. It needs its row of the first
   pass; those go to the tasks as a few arrays: some 40 bytes a file split, less
   than the scan's own list of splits on the driver.

Only records that cross the border of two ranges are shuffled: a third scan
takes their pieces from the ranges beside such borders, where there are any.

Quotes inside a quoted cell are doubled, and cells without quotes around them
hold none, as CSV writers do. The header of each file is its first line; files
may differ in it.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_KEY = "_key"


def physical_lines(spark: SparkSession, path: str) -> DataFrame:
    """(value, file, start, _key): the lines of all files, with the range each was read from."""
    if spark.conf.get("spark.sql.files.minPartitionNum", None) is None:
        # both passes must cut the files alike, also when executors come or go between them
        spark.conf.set("spark.sql.files.minPartitionNum", str(spark.sparkContext.defaultParallelism))
    lines = spark.read.option("lineSep", "\n").text(path)
    return lines.select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"),
                        F.xxhash64("_metadata.file_path", "_metadata.file_block_start", "_metadata.file_block_length").alias(_KEY))


def line_ranges(lines: DataFrame) -> DataFrame:
    """One row a range: what its first line begins with and its last line ends with.

    file (a hash), start, _key; first and last (of the file's ranges); header (the
    file's first line); inside (begins inside quotes), open (ends inside quotes,
    with more to come); origin (start of the range where the record that is
    open at its beginning began).
    """
    odd = (F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))) % 2
    place = F.when(F.col("start") == 0, F.monotonically_increasing_id())
    each = lines.select("*", odd.alias("odd"), place.alias("place")).groupBy("file", "start", _KEY).agg(
        F.sum("odd").alias("n"), F.min_by("value", "place").alias("head"))
    by = Window.partitionBy("file").orderBy("start")
    before = by.rowsBetween(Window.unboundedPreceding, -1)
    r = each.select("*", F.coalesce(F.sum("n").over(before) % 2, F.lit(0)).alias("state"),
                    F.lead("start").over(by).isNull().alias("last"),
                    F.first("head").over(by.rowsBetween(Window.unboundedPreceding, 0)).alias("header"))
    r = r.withColumn("ends", (F.col("state") + F.col("n")) % 2)
    through = (F.col("state") == 1) & (F.col("n") == 0)
    begun = F.when((F.col("ends") == 1) & ~through, F.col("start"))
    return r.select(F.xxhash64("file").alias("file"), "start", _KEY, (F.col("start") == 0).alias("first"), "last",
                    F.regexp_replace("header", "^\ufeff|\r$", "").alias("header"), (F.col("state") == 1).alias("inside"),
                    ((F.col("ends") == 1) & ~F.col("last")).alias("open"),
                    F.coalesce(F.max(begun).over(before), F.lit(0)).alias("origin"))


_NAMES = ["header", "file", "origin", "start", "record"]
_PIECES = "header int, file long, origin long, start long, record string"


def _assembler(ranges: dict[str, np.ndarray], borders: bool):
    """Lines (_key, value) to records; ``ranges`` are arrays ordered by key.

    With ``borders`` only the pieces of records that cross ranges come out, to
    be joined by (file, origin) in the order of start; else all other records.
    """
    kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.string()]

    def run(batches):
        key, at, open_, skip, head, pending = None, 0, False, False, False, []
        out: list[tuple] = []

        def piece(origin):
            out.append((int(ranges["header"][at]), int(ranges["file"][at]), int(origin), int(ranges["start"][at]), "\n".join(pending)))

        def finish():
            """What is left at the end of a range: part of a record that goes on, or of one never closed."""
            if not pending:
                return
            if skip:
                if borders:
                    piece(ranges["origin"][at])
            elif ranges["last"][at] != borders:
                piece(ranges["start"][at])

        for b in batches:
            keys, values = b.column(0).to_numpy(), b.column(1)
            odd = pc.bit_wise_and(pc.count_substring(values, '"'), 1).to_numpy(zero_copy_only=False).astype(bool)
            whole = np.zeros(len(keys), bool)
            cuts = np.flatnonzero(np.diff(keys)) + 1
            for x, y in zip([0, *cuts.tolist()], [*cuts.tolist(), len(keys)], strict=True):
                if x == y:
                    continue
                if keys[x] != key:
                    finish()
                    key, pending = keys[x], []
                    at = int(np.searchsorted(ranges[_KEY], key))
                    if at == len(ranges[_KEY]) or ranges[_KEY][at] != key:
                        raise ValueError("files or their splits changed between the two passes over a CSV log")
                    open_ = skip = bool(ranges["inside"][at])
                    head = bool(ranges["first"][at])
                before = np.logical_xor.accumulate(np.concatenate(([open_], odd[x:y])))
                alone = ~before[:-1] & ~odd[x:y]  # a record of its own: no quotes open before or after it
                open_ = bool(before[-1])
                if head:
                    alone[0], head = False, False  # the header is one line
                    rest = (np.flatnonzero(~alone)[1:] + x).tolist()
                else:
                    rest = (np.flatnonzero(~alone) + x).tolist()
                whole[x:y] = alone
                for k in rest:
                    pending.append(values[k].as_py())
                    if not before[k - x + 1]:
                        if skip:
                            if borders:
                                piece(ranges["origin"][at])
                            skip = False
                        elif not borders:
                            piece(ranges["start"][at])
                        pending = []
            if not borders and whole.any():
                number = ranges["header"][np.searchsorted(ranges[_KEY], keys[whole])]
                n = len(number)
                yield pa.RecordBatch.from_arrays([pa.array(number, pa.int32()), *[pa.nulls(n, pa.int64())] * 3,
                                                  values.filter(pa.array(whole)).cast(pa.string())], _NAMES)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], _NAMES)
                out = []
        finish()
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], _NAMES)

    return run


def quoted_records(spark: SparkSession, path: str) -> tuple[DataFrame, list[str]]:
    """((header int, record string): all records but the headers, the different headers)."""
    lines = physical_lines(spark, path)
    table = line_ranges(lines).orderBy(_KEY).toArrow()
    heads = table.column("header").to_pylist()
    headers = sorted(set(heads))
    ranges = {c: table.column(c).to_numpy() for c in (_KEY, "file", "start", "first", "last", "inside", "open", "origin")}
    number = {h: k for k, h in enumerate(headers)}
    ranges["header"] = np.array([number[h] for h in heads], np.int32)
    if len(np.unique(ranges[_KEY])) != len(ranges[_KEY]):
        raise ValueError("two ranges with one key")
    lines = lines.select(_KEY, "value")
    out = lines.mapInArrow(_assembler(ranges, False), _PIECES).select("header", "record")
    beside = ranges[_KEY][ranges["inside"] | ranges["open"]]
    if ranges["inside"].any():
        keys = spark.createDataFrame(pa.table({_KEY: beside}))
        pieces = lines.join(F.broadcast(keys), _KEY, "left_semi").mapInArrow(_assembler(ranges, True), _PIECES)
        whole = (pieces.groupBy("file", "origin", "header")
                 .agg(F.array_sort(F.collect_list(F.struct("start", "record"))).alias("p"))
                 .select("header", F.array_join(F.transform("p", lambda p: p["record"]), "\n").alias("record")))
        out = out.unionByName(whole)
    return out.where(F.trim(F.regexp_replace("record", "[\r\n]+", "")) != ""), headers
