"""Failure windows: ERROR/CRITICAL rows of a machine chained by gaps <= 60 min.

Scale design
------------
The gap rule chains rows without limit, so the textbook form (``lag`` plus a
running sum over ``partitionBy(machine_id)``) — and Spark's batch
``session_window``, whose merge step is keyed by machine — sends a whole
machine to one task. Here the failure rows are partitioned by
``(machine_id, hour bucket)``:

1. inside a bucket, ``row_number``, ``lag`` and the running maximum of the
   bucket's *internal* breaks (gap to the previous row of the same bucket
   over the limit) — one exchange, one sort;
2. a small per-bucket table (one row per machine and bucket) adds what
   crosses bucket borders: the previous bucket's last time (does the first
   row start a window?), the row offset, and the latest break of the earlier
   buckets;
3. one join of the rows with that table on the key they are already
   partitioned and sorted by.

Each failure row thus gets its window key ``(machine_id, window_start)`` and
its position ``seq`` without any task seeing more than one bucket; the log is
read twice (all columns once, time/machine/severity once for the bucket
table). Window summaries are then a plain ``groupBy`` whose aggregates are all
partial (map-side combined), so even a failure storm spanning a third of all
rows is reduced in parallel. Unbounded per-window lists (entries, notes) stay
a long table (``window_entries``); nested arrays are built only for the first
N windows that go into prompts, in bounded parts.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from telemill.functions.exprs import epoch_us, epoch_us_sql, fixed, minute_text, non_blank, round1, ts_text
from telemill.schema import FAILURE_SEVERITIES, SENSORS, DEFAULT_GAP_MINUTES, DEFAULT_MAX_WINDOWS

US_PER_MINUTE = 60_000_000
DEFAULT_SESSION_BUCKET_MINUTES = 60

#: Different categories or codes that one summary row holds; the most frequent where a window has more.
SET_ITEMS = 1000
#: Different values counted at once for that; below three quarters of it the counts are exact.
SET_TRACKED = 10_000

_TS, _B, _ORD, _BRK = "_ts_us", "_bucket", "_ord", "_brk"


def failure_events(logs: DataFrame) -> DataFrame:
    """ERROR and CRITICAL rows (case-sensitive) that have a machine and a time."""
    return logs.where(F.col("severity").isin(*FAILURE_SEVERITIES)
                      & F.col("machine_id").isNotNull() & F.col("timestamp").isNotNull())


def window_entries(logs: DataFrame, gap_minutes: int = DEFAULT_GAP_MINUTES,
                   bucket_minutes: int = DEFAULT_SESSION_BUCKET_MINUTES) -> DataFrame:
    """Every failure row with its window key ``window_start`` and 1-based ``seq``.

    1. Inside each (machine, bucket), ordered by time and id: row number,
       ``lag``, *internal* breaks (gap to the previous row of the same bucket
       over the limit) and their running maximum (time and row number).
    2. One small per-bucket table: count, first/last time, last internal
       break; over a machine's buckets (one row each) it adds the previous
       bucket's last time, the row offset, whether the bucket's first row
       starts a window, and the latest break of the earlier buckets.
    3. One join of the rows with that table on (machine, bucket) — the rows
       are already partitioned and sorted on it, so the log is shuffled and
       sorted once — and a projection.
    """
    cols = logs.columns
    gap_us = gap_minutes * US_PER_MINUTE
    bucket_us = bucket_minutes * US_PER_MINUTE
    f = failure_events(logs).selectExpr(
        "*", f"{epoch_us_sql('`timestamp`')} AS {_TS}").selectExpr(
        "*", f"({_TS} - pmod({_TS}, {bucket_us})) div {bucket_us} AS {_B}")  # rounded down also before 1970

    w = f"PARTITION BY machine_id, {_B} ORDER BY {_TS}, event_id"
    upto = f"OVER ({w} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
    rows = (f.selectExpr("*", f"row_number() OVER ({w}) AS _rn", f"lag({_TS}) OVER ({w}) AS _lag")
            .selectExpr("*", f"_lag IS NOT NULL AND {_TS} - _lag > {gap_us} AS _ib")
            .selectExpr("*", f"max(CASE WHEN _ib THEN `timestamp` END) {upto} AS _ib_ts",
                        f"max(CASE WHEN _ib THEN _rn END) {upto} AS _ib_rn"))

    by_machine = f"PARTITION BY machine_id ORDER BY {_B}"
    earlier = f"OVER ({by_machine} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
    buckets = (rows.groupBy("machine_id", _B)
               .agg(F.expr(f"max({_TS}) AS _last"), F.expr("count(1) AS _n"),
                    F.expr(f"min({_TS}) AS _first_us"), F.expr("min(`timestamp`) AS _first_ts"),
                    F.expr("max(_ib_ts) AS _lib_ts"), F.expr("max(_ib_rn) AS _lib_rn"))
               .selectExpr("*", f"lag(_last) OVER ({by_machine}) AS _prev_last",
                           f"coalesce(sum(_n) {earlier}, 0) AS _offset")
               .selectExpr("*", f"_prev_last IS NULL OR _first_us - _prev_last > {gap_us} AS _fb")
               .selectExpr("machine_id", _B, "_offset", "_fb", "_first_ts",
                           "coalesce(_lib_ts, CASE WHEN _fb THEN _first_ts END) AS _blb_ts",
                           "coalesce(_offset + _lib_rn, CASE WHEN _fb THEN _offset + 1 END) AS _blb_ord")
               .selectExpr("machine_id", _B, "_offset", "_fb", "_first_ts",
                           f"max(_blb_ts) {earlier} AS _carry_start",
                           f"max(_blb_ord) {earlier} AS _carry_ord"))

    return rows.join(buckets, ["machine_id", _B], "inner").selectExpr(
        "coalesce(_ib_ts, CASE WHEN _fb THEN _first_ts END, _carry_start) AS window_start",
        "_offset + _rn - coalesce(_offset + _ib_rn, CASE WHEN _fb THEN _offset + 1 END, _carry_ord) + 1 AS seq",
        *[f"`{c}`" for c in cols])


def value_set(column: str) -> Column:
    """The different non-blank texts of a group, sorted: all of them up to ``SET_ITEMS``, else the most frequent.

    A mergeable sketch of bounded size: free text in a log can't make a cell of any
    size. ``window_values`` has every value as a row.
    """
    top = F.expr(f"approx_top_k(CASE WHEN `{column}` <> '' THEN `{column}` END, {SET_ITEMS}, {SET_TRACKED})")
    return F.array_sort(F.filter(F.transform(top, lambda t: t["item"]), lambda v: v.isNotNull()))


def window_values(entries: DataFrame) -> DataFrame:
    """(machine_id, start, field, value, n): every different category and code of every window, a row each."""
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("field"), non_blank(F.col(c)).alias("value"))
                                for c in ("failure_category", "error_code")])).alias("p")
    return (entries.select("machine_id", F.col("window_start").alias("start"), pairs).where("p.value IS NOT NULL")
            .groupBy("machine_id", "start", F.col("p.field").alias("field"), F.col("p.value").alias("value"))
            .agg(F.count(F.lit(1)).alias("n")))


def window_value_counts(entries: DataFrame) -> DataFrame:
    """(machine_id, start, n_categories, n_codes): exact numbers of different values."""
    counted = [F.count(F.when(F.col("field") == c, F.lit(1))).alias(n) for c, n in (("failure_category", "n_categories"), ("error_code", "n_codes"))]
    return window_values(entries).groupBy("machine_id", "start").agg(*counted)


def summarize_windows(entries: DataFrame, extra_aggs: list | None = None) -> DataFrame:
    """One row per failure window from ``window_entries`` rows (all aggregates partial).

    ``extra_aggs`` are computed in the same aggregation and passed through.
    """
    extra_aggs = extra_aggs or []
    g = (entries.groupBy("machine_id", "window_start")
         .agg(*extra_aggs, F.max("timestamp").alias("end"),
              F.count(F.lit(1)).alias("event_count"),
              F.max((F.col("severity") == "CRITICAL").cast("int")).alias("_crit"),
              value_set("failure_category").alias("failure_categories"),
              value_set("error_code").alias("error_codes")))
    return g.select(
        "machine_id",
        F.col("window_start").alias("start"),
        "end",
        ((epoch_us("end") - epoch_us("window_start")) / F.lit(6e7)).alias("duration_minutes"),
        "event_count",
        F.when(F.col("_crit") == 1, "CRITICAL").otherwise("ERROR").alias("max_severity"),
        "failure_categories",
        "error_codes",
        *[c for c in g.columns if "__" in c],
    )


def failure_windows(logs: DataFrame, gap_minutes: int = DEFAULT_GAP_MINUTES,
                    method: str = "bucketed", ordered: bool = True) -> DataFrame:
    """Failure-window summaries, sorted by start (ties by machine).

    ``method="session_window"`` uses Spark's ``session_window`` (same result,
    but its merge is keyed by machine only; kept for comparison and streaming).
    """
    if method == "session_window":
        out = _session_window_summary(failure_events(logs), gap_minutes)
    else:
        out = summarize_windows(window_entries(logs, gap_minutes))
    return out.orderBy("start", "machine_id") if ordered else out


def _session_window_summary(fails: DataFrame, gap_minutes: int) -> DataFrame:
    # session_window's end is last + gap; the reference's end is the last event.
    g = (fails.groupBy("machine_id", F.session_window("timestamp", f"{gap_minutes} minutes").alias("sw"))
         .agg(F.min("timestamp").alias("window_start"),
              F.max("timestamp").alias("end"),
              F.count(F.lit(1)).alias("event_count"),
              F.max((F.col("severity") == "CRITICAL").cast("int")).alias("_crit"),
              value_set("failure_category").alias("failure_categories"),
              value_set("error_code").alias("error_codes")))
    return g.select(
        "machine_id", F.col("window_start").alias("start"), "end",
        ((epoch_us("end") - epoch_us("window_start")) / F.lit(6e7)).alias("duration_minutes"),
        "event_count",
        F.when(F.col("_crit") == 1, "CRITICAL").otherwise("ERROR").alias("max_severity"),
        "failure_categories", "error_codes")


def first_windows(windows: DataFrame, max_windows: int | None = DEFAULT_MAX_WINDOWS) -> DataFrame:
    """The earliest ``max_windows`` windows by start (then machine), a bounded TakeOrdered; None: all."""
    return windows if max_windows is None else windows.orderBy("start", "machine_id").limit(max_windows)


#: Bins in which chosen windows and failure rows meet.
BIN_US = 3_600_000_000


def _chosen_entries(logs: DataFrame, entries: DataFrame, top: DataFrame, max_windows: int | None) -> DataFrame:
    """Failure rows of the chosen windows, with window_start and seq.

    A choice is cut into hours, and rows are joined on (machine, hour), so a row is
    compared with the few windows of its hour only, whatever the number of
    windows; only rows found are numbered. Without a choice the numbered entries are there already.
    """
    if max_windows is None:
        return entries
    bins = F.sequence(F.floor(epoch_us("start") / F.lit(BIN_US)), F.floor(epoch_us("end") / F.lit(BIN_US)))
    keys = top.select("machine_id", F.col("start").alias("window_start"), F.col("end").alias("_end"), F.explode(bins).alias("_bin"))
    rows = failure_events(logs).withColumn("_bin", F.floor(epoch_us("timestamp") / F.lit(BIN_US)))
    rows = (rows.join(keys, ["machine_id", "_bin"])
            .where(F.col("timestamp").between(F.col("window_start"), F.col("_end"))).drop("_end", "_bin"))
    return rows.selectExpr("window_start", "row_number() OVER (PARTITION BY machine_id, window_start "
                           "ORDER BY `timestamp`, event_id) AS seq", *[f"`{c}`" for c in logs.columns])


def first_part(logs: DataFrame, n: int | None, gap_minutes: int = DEFAULT_GAP_MINUTES, days: int = 1) -> DataFrame:
    """The rows up to a time by which the first n windows are closed: the same first n windows, from fewer dates.

    Looks at the first ``days`` days of the log, then at twice as many, and so on, each
    time at failure rows before a time that the scan can prune by (also by ``date``, where the
    log has that column). Hand over a written log.
    """
    if n is None:
        return logs
    ends = logs.where("timestamp IS NOT NULL").agg(F.min("timestamp"), F.max("timestamp")).first()
    if ends[0] is None:
        return logs
    span = dt.timedelta(days=days)
    while ends[0] + span <= ends[1]:
        limit = ends[0] + span
        part = logs.where(F.col("timestamp") < F.lit(limit))
        if "date" in logs.columns:
            part = part.where(F.col("date") <= F.lit(limit.date()))
        first = summarize_windows(window_entries(part, gap_minutes)).orderBy("start", "machine_id").limit(n)
        closed = first.where(F.col("end") < F.lit(limit - dt.timedelta(minutes=gap_minutes))).count()
        if closed == n:
            return part
        span *= 2
    return logs


_ENTRY_FIELDS = ["timestamp", "severity", "error_code", *SENSORS, "operator_notes"]


def prepared_entries(logs: DataFrame, max_windows: int | None = DEFAULT_MAX_WINDOWS,
                     gap_minutes: int = DEFAULT_GAP_MINUTES) -> DataFrame:
    """Entries of the chosen windows, projected to the 10 prompt fields (time as text)."""
    entries = window_entries(logs, gap_minutes)
    return _entry_fields(_chosen_entries(logs, entries, first_windows(summarize_windows(entries), max_windows), max_windows))


def _entry_fields(chosen: DataFrame) -> DataFrame:
    return chosen.select(
        "machine_id", "window_start", "seq",
        ts_text("timestamp").alias("timestamp"),
        "severity",
        F.coalesce(F.col("error_code"), F.lit("")).alias("error_code"),
        *SENSORS,
        F.coalesce(F.col("operator_notes"), F.lit("")).alias("operator_notes"),
    )


#: Entries in one prompt; a longer window is prompted in parts.
DEFAULT_PROMPT_ENTRIES = 2000


def prepared_windows(logs: DataFrame, max_windows: int | None = DEFAULT_MAX_WINDOWS,
                     gap_minutes: int = DEFAULT_GAP_MINUTES, nested: bool = True,
                     part_entries: int = DEFAULT_PROMPT_ENTRIES) -> DataFrame:
    """Context blocks for the model: the first N windows (None: all), times as text, duration to 1 dp.

    Category and note lists are left out (the label must not reach the prompt).
    With ``nested`` the entries are an ordered ``ARRAY<STRUCT>`` per window
    *part*: entries ``seq`` 1..k go to part 0, k+1..2k to part 1, and so on
    (k = ``part_entries``). A window of up to k entries is one row, exactly the
    reference's context block; a failure storm becomes several bounded rows
    (``part`` of ``parts``), which ``diagnose`` merges into one diagnosis again.
    """
    entries = window_entries(logs, gap_minutes)
    top = first_windows(summarize_windows(entries), max_windows)
    flat = top.select(
        "machine_id",
        F.col("start").alias("window_start"),
        ts_text("start").alias("start"),
        ts_text("end").alias("end"),
        round1("duration_minutes").alias("duration_minutes"),
        "event_count", "max_severity", "error_codes")
    if not nested:
        return flat.drop("window_start")
    k = int(part_entries)
    pe = (_entry_fields(_chosen_entries(logs, entries, top, max_windows))
          .withColumn("part", F.expr(f"CAST((seq - 1) div {k} AS INT)")))
    lists = (pe.groupBy("machine_id", "window_start", "part")
             .agg(F.array_sort(F.collect_list(F.struct("seq", *_ENTRY_FIELDS))).alias("_e")))
    parts = F.expr(f"CAST((event_count + {k - 1}) div {k} AS INT)")
    return (flat.join(lists, ["machine_id", "window_start"], "left")
            .select("machine_id", "start", "end", "duration_minutes", "event_count", "max_severity",
                    "error_codes", "part", parts.alias("parts"),
                    F.transform("_e", lambda e: F.struct(*[e[c].alias(c) for c in _ENTRY_FIELDS])).alias("entries")))


def failure_window_listing(windows: DataFrame) -> DataFrame:
    """Dashboard listing line per window: title, severity, codes, categories."""
    minutes = fixed("duration_minutes", 0)
    title = F.concat(F.col("machine_id"), F.lit(" — "), minute_text("start"), F.lit(" ("),
                     F.col("event_count").cast("string"), F.lit(" events, "), minutes, F.lit(" min)"))
    return windows.select(
        "machine_id", "start", title.alias("title"), "max_severity", "event_count",
        minutes.alias("duration_text"),
        F.array_join("error_codes", ", ").alias("error_codes_text"),
        F.array_join("failure_categories", ", ").alias("categories_text"))


def window_notes(entries: DataFrame) -> DataFrame:
    """The listing's operator notes: non-empty ones in time order, a row each (``seq`` is the entry's)."""
    return (entries.where(F.col("operator_notes").isNotNull() & (F.col("operator_notes") != ""))
            .select("machine_id", F.col("window_start").alias("start"), "seq", F.col("operator_notes").alias("note")))
