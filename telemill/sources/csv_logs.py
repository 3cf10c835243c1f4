"""CSV machine logs in and out, enriched-table and report sinks.

The CSV reader never infers types: every cell is read as text, missing-value
tokens become NULL, then each known column is cast with ``try_cast``. A row
whose cell does not cast keeps NULL in that column and its raw cells in
``_corrupt_record`` (JSON), so bad rows are visible, not lost. Columns beyond
the known ones are kept as text.

Files are split between tasks, also where notes hold line breaks inside quotes
(``quoted_csv``: two passes). Logs known to have one line per row are read in
one pass with ``line_breaks="none"``; the lines with too few cells that an open
quote leaves behind show in ``_corrupt_record`` then.
"""

from __future__ import annotations

import csv

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from telemill.functions.exprs import nan_to_null, null_if_token
from telemill.schema import OPTIONAL_TEXT, RAW_COLUMNS, SENSORS
from telemill.sources.quoted_csv import quoted_records


_LINE = "_corrupt_line"
# all cells are parsed, so that a line with too few of them shows whatever columns are used
_OPTIONS = {"header": True, "escape": '"', "mode": "PERMISSIVE", "columnPruning": False, "enforceSchema": False}


def read_logs_csv(spark: SparkSession, path: str, multi_line: bool = False, line_breaks: str | None = None) -> DataFrame:
    """Typed log of all CSV files of a path; columns go by each file's header.

    ``line_breaks`` says what a line break inside quotes is: ``quoted`` (the
    default) part of the cell, with files split between tasks; ``none`` the
    end of the row, in one pass; ``whole_file`` part of the cell, one task a file
    (``multi_line=True``). With the latter two all files have one header.
    """
    how = line_breaks or ("whole_file" if multi_line else "quoted")
    if how == "quoted":
        return type_cells(_cells(*quoted_records(spark, path)))
    if how not in ("none", "whole_file"):
        raise ValueError(f"unknown line_breaks {how!r}")
    options = {**_OPTIONS, "multiLine": how == "whole_file"}
    names = spark.read.options(**options).csv(path).columns
    return type_cells(spark.read.options(**options, columnNameOfCorruptRecord=_LINE).schema(_text_schema(names)).csv(path))


def _text_schema(names: list[str]) -> T.StructType:
    return T.StructType([T.StructField(c, T.StringType()) for c in [*names, _LINE]])


def _header_names(header: str) -> list[str]:
    """Column names of a header line; nameless ones and repeats get their number."""
    out: list[str] = []
    for k, name in enumerate(next(csv.reader([header]), [])):
        out.append(f"_c{k}" if not name else f"{name}{k}" if name in out else name)
    return out


def _cells(records: DataFrame, headers: list[str]) -> DataFrame:
    """Text cells by name from records; a column that a file's header lacks is NULL in its rows."""
    names = [_header_names(h) for h in headers]
    every = [*dict.fromkeys(c for n in names for c in n), _LINE]
    if not headers:
        return records.sparkSession.createDataFrame([], _text_schema(RAW_COLUMNS))
    options = {"escape": '"', "mode": "PERMISSIVE", "columnNameOfCorruptRecord": _LINE}
    parsed = None
    for k, own in enumerate(names):
        ddl = ", ".join("`" + c.replace("`", "``") + "` STRING" for c in [*own, _LINE])
        cells = F.from_csv("record", ddl, options)
        if own != every[:-1]:
            cells = F.struct(*[(cells.getField(c) if c in own or c == _LINE else F.lit(None).cast("string")).alias(c) for c in every])
        parsed = cells if k == 0 else F.when(F.col("header") == k, cells).otherwise(parsed)
    return records.select(parsed.alias("c")).select(*[F.col("c").getField(c).alias(c) for c in every])


def type_cells(raw: DataFrame) -> DataFrame:
    """Typed log from text cells: tokens to NULL, casts, ``event_id`` from the content, ``_corrupt_record``.

    Missing optional columns are NULL; a missing required one is an error. A
    line with too few or too many cells, as an open quote leaves behind, is
    corrupt with its text (column ``_corrupt_line``, if given).
    """
    present = set(raw.columns)
    cells = {}
    for name in RAW_COLUMNS:
        if name in present:
            cells[name] = null_if_token(F.col(f"`{name}`"))
        elif name in OPTIONAL_TEXT:
            cells[name] = F.lit(None).cast("string")
        else:
            raise ValueError(f"CSV log lacks required column {name!r}")
    extra = [c for c in raw.columns if c not in RAW_COLUMNS and c not in ("event_id", "_corrupt_record", _LINE)]
    typed = {"timestamp": cells["timestamp"].try_cast("timestamp_ntz")}
    for s in SENSORS:
        typed[s] = nan_to_null(cells[s].try_cast("double"))
    failed = [F.when(cells[n].isNotNull() & typed[n].isNull(), F.lit(n)) for n in ["timestamp", *SENSORS]]
    bad = F.array_compact(F.array(*failed))
    raw_cells = F.to_json(F.struct(*[cells[n].alias(n) for n in RAW_COLUMNS]))
    # A content hash gives CSV rows a stable id for deterministic tie-breaks.
    row_id = F.xxhash64(*[F.coalesce(cells[n], F.lit("\u0000")) for n in RAW_COLUMNS])
    return raw.select(
        row_id.alias("event_id"), *[typed.get(n, cells[n]).alias(n) for n in RAW_COLUMNS],
        *[F.col(f"`{c}`") for c in extra],
        F.coalesce(F.col(_LINE) if _LINE in present else F.lit(None).cast("string"),
                   F.when(F.size(bad) > 0, raw_cells)).alias("_corrupt_record"),
    )


def write_logs_csv(df: DataFrame, path: str, mode: str = "overwrite") -> str:
    """Raw log sink: header row, columns in the frame's order."""
    (df.write.mode(mode).option("header", True).option("escape", '"')
       .option("timestampNTZFormat", "yyyy-MM-dd HH:mm:ss[.SSSSSS]").csv(path))
    return path


#: Rows of a file of the processed table.
ROWS_PER_FILE = 2_000_000


def dealt_by_date(df: DataFrame, by: str, counts: DataFrame, rows_per_file: int = ROWS_PER_FILE) -> DataFrame:
    """Rows dealt to tasks by date, a date to as many of them as its rows need.

    counts: (``by``, n), one row a date; broadcast, as there are no more dates than folders to write.
    """
    files = counts.select(F.col(by).alias("_by"), F.ceil(F.col("n") / rows_per_file).cast("long").alias("_files"))
    total = files.agg(F.sum("_files")).first()[0] or 1
    tasks = max(int(total), int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    names = df.columns
    dealt = df.join(F.broadcast(files), F.col(by).eqNullSafe(F.col("_by")), "left")
    salt = F.pmod(F.xxhash64(*names), F.coalesce("_files", F.lit(1)))
    return dealt.repartition(tasks, by, salt).select(*names)


def write_enriched(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "overwrite", counts: DataFrame | None = None,
                   rows_per_file: int = ROWS_PER_FILE) -> str:
    """Processed-log sink. Parquet partitioned by calendar date enables partition pruning; each date goes to
    about one file for every ``rows_per_file`` rows. ``counts`` (date, n) saves a count of df, if known."""
    if fmt == "parquet" and "date" in df.columns:
        if counts is None:
            counts = df.groupBy("date").agg(F.count(F.lit(1)).alias("n"))
        w = dealt_by_date(df, "date", counts, rows_per_file).write.mode(mode).partitionBy("date")
    else:
        w = df.write.mode(mode)
    if fmt == "csv":
        w = w.option("header", True)
    w.format(fmt).save(path)
    return path


def write_report(sections: DataFrame, path: str, mode: str = "overwrite") -> str:
    """Report sink: ordered UTF-8 text rows.

    The global sort range-partitions the rows, so the part files read in name
    order give the report in order; no single task has to hold the whole
    report when every window is diagnosed.
    """
    sections.orderBy("section_ord", "ord", "tie").select("text").write.mode(mode).text(path)
    return path
