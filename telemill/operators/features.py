"""Time features and time-framed rolling statistics per machine.

Scale design
------------
A window partitioned by ``machine_id`` alone gives one task per machine: with
few machines and long histories (or one machine holding a third of the rows)
that is a handful of huge, skewed tasks. All operators here partition by
``(machine_id, time block)`` instead:

* rolling frames ``(t - h, t]`` are cut at block borders. With blocks as long
  as the frame, a frame is a suffix of the block before and a prefix of its
  own. Each row is copied into the block that needs it as suffix (one
  ``explode``, no second scan); prefix moments run up in time order, suffix
  moments run down, and the two are merged by count, mean and sum of squared
  deviations. Nothing is ever subtracted, so one glitch of any size is
  forgotten as soon as it leaves the frame. A machine with more than
  ``block_rows`` rows in a frame gets finer blocks, a power of two to the frame
  (``machine_levels``): the whole blocks between the two ends are again a
  suffix and a prefix, of stretches of blocks as long as the frame (``_middle``);
* the look-back of ``time_since_last`` is unbounded, so the first row of a
  block takes the last timestamp of the machine's previous non-empty block
  from a small edge table (one row per machine and block).

Rows without machine or time have no history; they are spread by their id and
keep NULL statistics. All forms give exactly the plain per-machine result
(checked in the tests).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window
from pyspark.sql import functions as F

from telemill.functions.exprs import epoch_us
from telemill.schema import (SENSORS, DEFAULT_WINDOW_HOURS, DEFAULT_Z_THRESHOLD,
                             rolling_mean_col, rolling_std_col)

US_PER_HOUR = 3_600_000_000
DEFAULT_BUCKET_HOURS = 24

_TS = "_ts_us"
_B = "_bucket"
_SHIFT = "_shift"
_V = "_v"
_PREV = "_prev_bucket_last_us"
#: Groups that rows without machine or time are spread over.
_SPREAD = 4096
_VALID_SQL = "machine_id IS NOT NULL AND timestamp IS NOT NULL"


def _block(width_us: int | str) -> str:
    """Block number of a row, rounded down also before 1970; rows without history are spread by id."""
    return (f"CASE WHEN {_VALID_SQL} THEN ({_TS} - pmod({_TS}, {width_us})) div ({width_us}) "
            f"ELSE pmod(event_id, {_SPREAD}) END")


def _valid() -> Column:
    return F.col("machine_id").isNotNull() & F.col("timestamp").isNotNull()


def _with_ts(df: DataFrame) -> DataFrame:
    return df.withColumn(_TS, epoch_us("timestamp"))


def _edge_table(df: DataFrame, width_us: int | str) -> DataFrame:
    """(machine_id, bucket) -> last timestamp of the machine's previous non-empty bucket.

    One row per machine and bucket: its size is the number of machine-days, not
    the number of events, so the per-machine window below stays small.
    """
    per_bucket = (df.where(_valid())
                  .groupBy("machine_id", F.expr(_block(width_us)).alias(_B))
                  .agg(F.max(_TS).alias("_last_us")))
    return per_bucket.select(
        "machine_id", _B,
        F.lag("_last_us").over(Window.partitionBy("machine_id").orderBy(_B)).alias(_PREV))


def _calendar(df: DataFrame) -> DataFrame:
    return (df.withColumn("hour", F.hour("timestamp"))
              .withColumn("day_of_week", F.weekday("timestamp"))
              .withColumn("date", F.to_date("timestamp")))


def _time_since_last(prev_us: Column) -> Column:
    gap = (F.col(_TS) - prev_us) / F.lit(1e6)
    return F.when(_valid(), F.coalesce(gap, F.lit(0.0))).otherwise(F.lit(0.0))


def time_features(logs: DataFrame, bucket_hours: int = DEFAULT_BUCKET_HOURS,
                  plain: bool = False) -> DataFrame:
    """hour, day_of_week (Monday = 0), date, time_since_last (seconds; first row 0)."""
    cols = logs.columns
    df = _with_ts(logs)
    if plain:
        w = Window.partitionBy("machine_id").orderBy(_TS, "event_id")
        out = df.withColumn("time_since_last", _time_since_last(F.lag(_TS).over(w)))
    else:
        # Window first, edge-table join after: the windowed rows are already
        # partitioned and sorted by (machine, bucket), so the join adds no
        # exchange or sort on the big side.
        bucket_us = bucket_hours * US_PER_HOUR
        df = df.withColumn(_B, F.expr(_block(bucket_us)))
        w = Window.partitionBy("machine_id", _B).orderBy(_TS, "event_id")
        lagged = df.withColumn("_lag", F.lag(_TS).over(w))
        out = (lagged.join(_edge_table(df, bucket_us), ["machine_id", _B], "left")
               .withColumn("time_since_last", _time_since_last(F.coalesce(F.col("_lag"), F.col(_PREV)))))
    out = _calendar(out)
    return out.select(*cols, "hour", "day_of_week", "date", "time_since_last")


# The statistics are written as Spark SQL text: each expression is parsed once
# on the JVM instead of being assembled from hundreds of Python-side Column
# calls, and every intermediate gets a name, so no window expression is
# expanded twice into the plan.
def _frame_us(window_hours: float) -> int:
    # pandas' time frame is (t - h, t]: exclude a row exactly h old.
    return int(window_hours * US_PER_HOUR)


#: Rows of one machine and block that a task should have to sort at most.
BLOCK_ROWS = 200_000
#: Finest blocks: a 4096th of the frame (3.5 seconds of four hours).
MAX_LEVEL = 12
#: Machines whose levels are joined by broadcast (some 30 bytes each); more than that share one level.
LEVEL_MACHINES = 1_000_000
_SUB = "_sub"


def _finest(frame_us: int) -> int:
    """The most times that a frame of whole microseconds can be halved, up to MAX_LEVEL."""
    level = 0
    while level < MAX_LEVEL and frame_us % (2 << level) == 0:
        level += 1
    return level


def machine_levels(logs: DataFrame, window_hours: float = DEFAULT_WINDOW_HOURS, block_rows: int = BLOCK_ROWS) -> dict | int:
    """How often the frame is halved for each dense machine: {machine_id: level}, or one level for all.

    Counts rows per machine and frame first (one narrow scan, partial counts
    before the shuffle). Only machines with more than ``block_rows`` rows in
    some frame are looked at again, in ever finer blocks; a machine gets the
    coarsest level at which no block has more rows, bursts included.
    """
    frame_us, finest = _frame_us(window_hours), _finest(_frame_us(window_hours))
    x = _with_ts(logs.select("machine_id", "timestamp", "event_id")).where(_VALID_SQL)
    dense = (x.groupBy("machine_id", F.expr(_block(frame_us)).alias(_B)).count().where(F.col("count") > block_rows)
             .select("machine_id").distinct().limit(LEVEL_MACHINES + 1).toArrow())
    if not dense.num_rows or not finest:
        return {}
    many = dense.num_rows > LEVEL_MACHINES
    if not many:
        x = x.join(F.broadcast(logs.sparkSession.createDataFrame(dense)), "machine_id", "left_semi")
    # dealt by frames, every coarser level is counted from the finer one where its blocks lie, without further shuffles
    blocks = (x.groupBy("machine_id", F.expr(_block(frame_us >> finest)).alias(_B)).agg(F.count(F.lit(1)).alias("n"))
              .withColumn("frame", F.expr(f"shiftright({_B}, {finest})")).repartition("machine_id", "frame"))
    for level in range(finest, 0, -1):
        most = [f"most_{k}" for k in range(level + 1, finest + 1)]
        blocks = (blocks.selectExpr("machine_id", "frame", f"shiftright({_B}, 1) AS {_B}", "n", f"n AS most_{level}", *most)
                  .groupBy("machine_id", "frame", _B)
                  .agg(F.sum("n").alias("n"), *[F.max(c).alias(c) for c in [f"most_{level}", *most]]))
    most = blocks.groupBy("machine_id").agg(*[F.max(f"most_{k}").alias(f"most_{k}") for k in range(1, finest + 1)])
    enough = " ".join(f"WHEN most_{k} <= {block_rows} THEN {k}" for k in range(1, finest + 1))
    full = most.selectExpr("machine_id", f"CASE {enough} ELSE {finest} END AS level")
    if many:
        return full.agg(F.max("level")).first()[0]
    return {r["machine_id"]: r["level"] for r in full.toLocalIterator()}


def _with_sub_blocks(x: DataFrame, frame_us: int, sub_blocks: int | None, levels: dict | int | None) -> tuple[DataFrame, int]:
    """(rows with the number of blocks in a frame, bits of the greatest such number less one)."""
    if sub_blocks is not None:
        if sub_blocks < 1 or frame_us % sub_blocks:
            raise ValueError("sub_blocks must divide the frame into whole microseconds")
        return x.withColumn(_SUB, F.lit(sub_blocks).cast("long")), (sub_blocks - 1).bit_length()
    if isinstance(levels, int):
        return x.withColumn(_SUB, F.lit(1 << levels).cast("long")), levels
    if not levels:
        return x.withColumn(_SUB, F.lit(1).cast("long")), 0
    table = x.sparkSession.createDataFrame([(m, 1 << k) for m, k in levels.items()], f"machine_id string, {_SUB} long")
    x = x.join(F.broadcast(table), "machine_id", "left").withColumn(_SUB, F.coalesce(_SUB, F.lit(1).cast("long")))
    return x, max(levels.values())


def _with_frame_stats(x: DataFrame, part: list[str], frame_us: int, keep: list[str]) -> DataFrame:
    """Sliding-frame form, the reference: Spark re-aggregates each frame (rows x frame size)."""
    w = (f"OVER (PARTITION BY {', '.join(part)} ORDER BY {_TS} "
         f"RANGE BETWEEN {frame_us - 1} PRECEDING AND CURRENT ROW)")
    out = []
    for s in SENSORS:
        out.append(f"CASE WHEN {_VALID_SQL} THEN avg({s}) {w} END AS {rolling_mean_col(s)}")
        out.append(f"CASE WHEN {_VALID_SQL} THEN coalesce(stddev_samp({s}) {w}, 0D) END AS {rolling_std_col(s)}")
    return x.selectExpr(*[f"`{c}`" for c in keep], *out)


def _copied(x: DataFrame, frame_us: int) -> DataFrame:
    """Each row in its own block (``_shift`` 0) and, as suffix, one frame later.

    ``_v`` is the time, for copies moved on by the frame: a copy belongs to the
    frame of a row exactly if its ``_v`` is greater than the row's.
    """
    shifts = f"CASE WHEN {_VALID_SQL} THEN array(0, 1) ELSE array(0) END"
    return (x.selectExpr("*", f"{_block(f'{frame_us} div {_SUB}')} AS _own", f"explode({shifts}) AS {_SHIFT}")
            .selectExpr("*", f"_own + {_SHIFT} * {_SUB} AS {_B}", f"{_TS} + {_SHIFT} * {frame_us} AS {_V}")
            .drop("_own"))


def _moments(value: str, over: str, tag: str) -> list[str]:
    return [f"count({value}) {over} AS _n{tag}", f"coalesce(avg({value}) {over}, 0D) AS _a{tag}",
            f"coalesce(var_pop({value}) {over}, 0D) AS _p{tag}"]


def _merged(sensor: str, one: str, two: str, tag: str) -> list[list[str]]:
    """Projections that merge (_n, _a, _q) of two parts into those named by ``tag``."""
    n1, n2 = f"_n{one}", f"_n{two}"
    return [[f"{n1} + {n2} AS _n{tag}", f"_a{two} - _a{one} AS _d{tag}"],
            [f"CASE WHEN {n1} = 0 THEN _a{two} WHEN {n2} = 0 THEN _a{one} "
             f"ELSE _a{one} + _d{tag} * ({n2} / _n{tag}) END AS _a{tag}",
             f"_q{one} + _q{two} + CASE WHEN {n1} = 0 OR {n2} = 0 THEN 0D "
             f"ELSE _d{tag} * _d{tag} * ({n1} * ({n2} / _n{tag})) END AS _q{tag}"]]


def _running(y: DataFrame, order: str, shift: int, tag: str) -> DataFrame:
    """Adds count, mean and squared deviations (_n, _a, _q) of the copies ``shift`` that come before a block in ``order``.

    Two passes on one sort: counts and sums, then the squared deviations. A
    block adds its own and those of its mean from the mean of all before it, so
    that nothing is subtracted.
    """
    over = f"OVER (PARTITION BY machine_id, _super ORDER BY {order} RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
    copies = f"CASE WHEN {_SHIFT} = {shift} THEN"
    y = y.selectExpr("*", *[e for s in SENSORS for e in (f"coalesce(sum({copies} _n_{s} END) {over}, 0L) AS _n{tag}_{s}",
                                                         f"sum({copies} _n_{s} * _a_{s} END) {over} AS _t{tag}_{s}")])
    y = y.selectExpr("*", *[f"CASE WHEN _n{tag}_{s} > 0 THEN _t{tag}_{s} / _n{tag}_{s} ELSE 0D END AS _a{tag}_{s}" for s in SENSORS])
    y = y.selectExpr("*", *[f"_a_{s} - _a{tag}_{s} AS _d{tag}_{s}" for s in SENSORS])
    added = [f"_q_{s} + CASE WHEN _n_{s} = 0 OR _n{tag}_{s} = 0 THEN 0D "
             f"ELSE _d{tag}_{s} * _d{tag}_{s} * (_n{tag}_{s} * (_n_{s} / (_n{tag}_{s} + _n_{s}))) END" for s in SENSORS]
    return y.selectExpr("*", *[f"coalesce(sum({copies} {e} END) {over}, 0D) AS _q{tag}_{s}" for s, e in zip(SENSORS, added)])


def _middle(x: DataFrame, frame_us: int) -> DataFrame:
    """(machine_id, block) -> moments of the whole blocks between a frame's ends; one row per machine and block.

    The frame of a row in block b holds the n - 1 blocks before b, n being the
    machine's blocks to a frame. What ``_with_block_stats`` does with rows is
    done with blocks once more: in stretches of n blocks these are a suffix of
    the stretch before and a prefix of b's own. Each block is copied once; a
    group has at most 2 * n of them, however many rows they hold.
    """
    aggs = [F.expr(e) for s in SENSORS for e in (f"count({s}) AS _n_{s}", f"coalesce(avg({s}), 0D) AS _a_{s}",
                                                 f"coalesce(var_pop({s}), 0D) * count({s}) AS _q_{s}")]
    blocks = (x.where(f"{_VALID_SQL} AND {_SUB} > 1")
              .selectExpr("machine_id", _SUB, f"{_block(f'{frame_us} div {_SUB}')} AS {_B}", *SENSORS)
              .groupBy("machine_id", _SUB, _B).agg(*aggs))
    y = (blocks.selectExpr("*", f"explode(array(0, 1)) AS {_SHIFT}")
         .selectExpr("*", f"{_B} + {_SHIFT} * {_SUB} AS {_V}")
         .selectExpr("*", f"({_V} - pmod({_V}, {_SUB})) div {_SUB} AS _super"))
    y = _running(_running(y, f"{_V} DESC", 1, "s"), _V, 0, "p").where(f"{_SHIFT} = 0")
    for step in zip(*[_merged(s, f"s_{s}", f"p_{s}", f"m_{s}") for s in SENSORS]):
        y = y.selectExpr("*", *[e for part in step for e in part])
    return y.selectExpr("machine_id", f"{_V} AS {_B}", *[f"_{c}m_{s}" for s in SENSORS for c in "naq"])


def _with_block_stats(x: DataFrame, frame_us: int, level: int, keep: list[str]) -> DataFrame:
    """Block form, O(rows), of rows with ``_sub``; home rows only come out.

    Two window passes on one partitioning: prefix moments of home rows in time
    order (peers, equal timestamps, are inside the frame as in the sliding
    form), suffix moments of copies from the block's end down.
    """
    part = f"PARTITION BY machine_id, {_B}"
    up = f"OVER ({part} ORDER BY {_V} RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
    down = f"OVER ({part} ORDER BY {_V} DESC RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
    cols = [f"`{c}`" for c in keep]
    middle = _middle(x, frame_us) if level else None
    y = _copied(x, frame_us)
    y = y.selectExpr("*", *[e for s in SENSORS for e in _moments(f"CASE WHEN {_SHIFT} = 1 THEN {s} END", down, f"s_{s}")])
    lag = (f"last(CASE WHEN {_SHIFT} = 0 THEN {_TS} END, true) OVER ({part} ORDER BY {_V}, event_id "
           f"ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS _lag")
    y = y.selectExpr("*", lag, *[e for s in SENSORS for e in _moments(f"CASE WHEN {_SHIFT} = 0 THEN {s} END", up, f"p_{s}")])
    y = y.where(f"{_SHIFT} = 0")
    extra = [_B, "_lag"]
    if middle is not None:
        y = y.join(middle, ["machine_id", _B], "left")
        y = y.selectExpr("*", *[f"coalesce(_nm_{s}, 0L) AS _nw_{s}" for s in SENSORS],
                         *[f"coalesce(_am_{s}, 0D) AS _aw_{s}" for s in SENSORS],
                         *[f"coalesce(_qm_{s}, 0D) AS _qw_{s}" for s in SENSORS])
    y = y.selectExpr("*", *[f"_p{k}_{s} * _n{k}_{s} AS _q{k}_{s}" for s in SENSORS for k in ("s", "p")])
    last = "sp"
    for step in zip(*[_merged(s, f"s_{s}", f"p_{s}", f"sp_{s}") for s in SENSORS]):
        y = y.selectExpr("*", *[e for part_ in step for e in part_])
    if middle is not None:
        last = "all"
        for step in zip(*[_merged(s, f"w_{s}", f"sp_{s}", f"all_{s}") for s in SENSORS]):
            y = y.selectExpr("*", *[e for part_ in step for e in part_])
    out = []
    for s in SENSORS:
        n, a, q = (f"_{k}{last}_{s}" for k in "naq")
        out.append(f"CASE WHEN {_VALID_SQL} AND {n} > 0 THEN {a} END AS {rolling_mean_col(s)}")
        out.append(f"CASE WHEN NOT ({_VALID_SQL}) THEN NULL WHEN {n} > 1 THEN sqrt({q} / ({n} - 1)) ELSE 0D END "
                   f"AS {rolling_std_col(s)}")
    return y.selectExpr(*cols, *[c for c in extra if c not in keep], *out)


def rolling_stats(df: DataFrame, window_hours: float = DEFAULT_WINDOW_HOURS, sub_blocks: int | None = None,
                  plain: bool = False, method: str = "blocks", levels: dict | int | None = None,
                  block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Rolling mean and sample std (NULL -> 0) per machine over (t - h, t], all sensors.

    ``method`` is ``blocks`` (O(rows), groups of a machine and a block) or
    ``frame`` (Spark's sliding frame); ``plain`` is the sliding frame over
    whole machines, for comparison. The blocks' length goes by ``levels``; where
    neither they nor ``sub_blocks`` (blocks to a frame) are given, rows are
    counted first (``machine_levels``), so that no group has over ``block_rows``.
    """
    cols = df.columns
    frame_us = _frame_us(window_hours)
    x = _with_ts(df)
    if plain or method == "frame":
        if plain:
            return _with_frame_stats(x, ["machine_id"], frame_us, cols)
        y = _copied(x.withColumn(_SUB, F.lit(1).cast("long")), frame_us)
        # Copies keep their own time here: the frame reaches back to them.
        return (_with_frame_stats(y, ["machine_id", _B], frame_us, [*cols, _SHIFT])
                .where(F.col(_SHIFT) == 0).drop(_SHIFT))
    if method != "blocks":
        raise ValueError(f"unknown rolling method {method!r}")
    if sub_blocks is None and levels is None:
        levels = machine_levels(df, window_hours, block_rows)
    x, level = _with_sub_blocks(x, frame_us, sub_blocks, levels)
    return _with_block_stats(x, frame_us, level, cols).drop(_B, "_lag")


def enrich(logs: DataFrame, window_hours: float = DEFAULT_WINDOW_HOURS,
           z_threshold: float = DEFAULT_Z_THRESHOLD, sub_blocks: int | None = None, levels: dict | int | None = None,
           block_rows: int = BLOCK_ROWS) -> DataFrame:
    """time features + rolling stats + anomaly flags in ONE shuffle of the log.

    The blocks (see ``rolling_stats``) also serve the look-back of
    ``time_since_last``: a block's first row finds its predecessor in the edge
    table.
    """
    from telemill.operators.anomaly import flag_anomalies

    cols = logs.columns
    frame_us = _frame_us(window_hours)
    if sub_blocks is None and levels is None:
        levels = machine_levels(logs, window_hours, block_rows)
    x, level = _with_sub_blocks(_with_ts(logs), frame_us, sub_blocks, levels)
    edges = _edge_table(x, f"{frame_us} div {_SUB}")
    # Windows first (one exchange), then the small edge-table join on
    # (machine, block), which the windowed rows already satisfy.
    y = _with_block_stats(x, frame_us, level, [*cols, _TS]).join(edges, ["machine_id", _B], "left")
    y = y.withColumn("time_since_last", _time_since_last(F.coalesce(F.col("_lag"), F.col(_PREV))))
    y = _calendar(y)
    ordered = [*cols, "hour", "day_of_week", "date", "time_since_last"]
    for s in SENSORS:
        ordered += [rolling_mean_col(s), rolling_std_col(s)]
    return flag_anomalies(y.select(*ordered), z_threshold)
