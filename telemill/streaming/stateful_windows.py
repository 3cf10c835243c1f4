"""Failure windows over a stream with state of their own: no window and no late row is lost.

State per machine: how far its time is closed, and the summaries of its open
windows (all that reach into the last ``delay`` plus gap, so their number is
bounded by that span). Rows may come out of order by up to ``delay``, measured
on the machine's own clock: one machine that lags or stops holds up no other.

* A window is written once its machine has a row more than ``delay`` + gap after
  the window's end. With ``idle_minutes`` a processing-time timer closes
  the windows of a machine that has sent no failure for so long.
* Rows before what is closed go to the side output (``kind = 'late'``).
* Windows still open when a run ends are in the state; ``open_windows`` reads
  them from the checkpoint, so closed and open windows together are the batch
  operator's. A next run goes on from the same state.

A summary holds up to ``SET_ITEMS`` different categories and codes each; where
there were more, ``sets_whole`` is false and ``window_values`` has them all.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StreamingQuery

from telemill.functions.exprs import epoch_us_sql, non_blank
from telemill.operators.sessions import SET_ITEMS, US_PER_MINUTE, failure_events
from telemill.schema import DEFAULT_GAP_MINUTES
from telemill.session import checkpoint_dir

_OPEN = "start_us long, end_us long, n long, critical boolean, categories array<string>, codes array<string>, whole boolean"
_OUT = f"kind string, machine_id string, event_id long, {_OPEN}"
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _processor(gap_us: int, delay_us: int, idle_ms: int | None, items: int) -> StatefulProcessor:
    """Made here so that it travels to the workers by value."""
    import numpy as np
    import pandas as pd

    names = ["kind", "machine_id", "event_id", "start_us", "end_us", "n", "critical", "categories", "codes", "whole"]

    class Windows(StatefulProcessor):
        def init(self, handle) -> None:
            self.handle = handle
            self.clock = handle.getValueState("clock", "closed_us long, last_us long")
            self.open = handle.getListState("open", _OPEN)

        def handleInputRows(self, key, rows, timerValues):
            closed, last = self.clock.get() if self.clock.exists() else (None, None)
            windows = [tuple(w) for w in self.open.get()] if self.open.exists() else []
            out = []
            for pdf in rows:
                us = pdf["us"].to_numpy(np.int64)
                if closed is not None:
                    late = us < closed
                    out += [("late", key[0], int(e), int(t), int(t), 1, bool(c), [], [], True)
                            for e, t, c in zip(pdf["event_id"][late], us[late], pdf["critical"][late], strict=True)]
                    pdf, us = pdf[~late], us[~late]
                if len(us):
                    last = int(us.max()) if last is None else max(last, int(us.max()))
                    windows = self.joined(windows + self.pieces(pdf, us))
            if last is not None:
                horizon = last - delay_us
                closed = horizon if closed is None else max(closed, horizon)
                done = [w for w in windows if w[1] + gap_us < closed]
                windows = [w for w in windows if w[1] + gap_us >= closed]
                out += [("window", key[0], None, *w) for w in done]
                self.keep(windows, closed, last)
            if idle_ms and windows:
                for t in self.handle.listTimers():
                    self.handle.deleteTimer(t)
                self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + idle_ms)
            if out:
                yield self.frame(out)

        def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
            windows = [tuple(w) for w in self.open.get()] if self.open.exists() else []
            if windows:
                closed, last = self.clock.get()
                self.keep([], max(closed, max(w[1] for w in windows) + gap_us + 1), last)
                yield self.frame([("window", key[0], None, *w) for w in windows])

        def keep(self, windows, closed, last) -> None:
            self.clock.update((closed, last))
            if windows:
                self.open.put(windows)
            else:
                self.open.clear()

        def frame(self, rows):
            df = pd.DataFrame(rows, columns=names)
            df["event_id"] = df["event_id"].astype("Int64")
            return df

        def pieces(self, pdf, us):
            """Summaries of the windows that these rows alone make."""
            order = np.argsort(us, kind="stable")
            us = us[order]
            cut = np.flatnonzero(np.diff(us) > gap_us) + 1
            crit = pdf["critical"].to_numpy(bool)[order]
            category, code = (pdf[c].to_numpy(object)[order] for c in ("category", "code"))
            out = []
            for a, b in zip([0, *cut.tolist()], [*cut.tolist(), len(us)], strict=True):
                sets = [sorted({x for x in v[a:b] if isinstance(x, str)}) for v in (category, code)]
                out.append((int(us[a]), int(us[b - 1]), b - a, bool(crit[a:b].any()), *[s[:items] for s in sets],
                            all(len(s) <= items for s in sets)))
            return out

        def joined(self, windows):
            out = []
            for w in sorted(windows):
                if out and w[0] - out[-1][1] <= gap_us:
                    p = out[-1]
                    sets = [sorted({*p[k], *w[k]}) for k in (4, 5)]
                    out[-1] = (p[0], max(p[1], w[1]), p[2] + w[2], p[3] or w[3], *[s[:items] for s in sets],
                               p[6] and w[6] and all(len(s) <= items for s in sets))
                else:
                    out.append(w)
            return out

        def close(self) -> None:
            pass

    return Windows()


def _readable(rows: DataFrame) -> DataFrame:
    """The columns of batch windows."""
    def time(c):
        return F.expr(f"timestampadd(MICROSECOND, {c}, TIMESTAMP_NTZ'1970-01-01 00:00:00')")

    return rows.select(
        "machine_id", time("start_us").alias("start"), time("end_us").alias("end"),
        ((F.col("end_us") - F.col("start_us")) / F.lit(6e7)).alias("duration_minutes"), F.col("n").alias("event_count"),
        F.when(F.col("critical"), "CRITICAL").otherwise("ERROR").alias("max_severity"),
        F.col("categories").alias("failure_categories"), F.col("codes").alias("error_codes"), F.col("whole").alias("sets_whole"))


def stateful_failure_windows(logs: DataFrame, gap_minutes: int = DEFAULT_GAP_MINUTES, delay_minutes: int = 120,
                             idle_minutes: float | None = None) -> DataFrame:
    """Streaming rows: closed windows (``kind = 'window'``) and late rows (``kind = 'late'``, one each)."""
    us = epoch_us_sql("`timestamp`")
    f = failure_events(logs).select(
        "machine_id", "event_id", F.expr(f"{us} AS us"), (F.col("severity") == "CRITICAL").alias("critical"),
        non_blank(F.col("failure_category")).alias("category"), non_blank(F.col("error_code")).alias("code"))
    processor = _processor(gap_minutes * US_PER_MINUTE, delay_minutes * US_PER_MINUTE,
                           None if idle_minutes is None else int(idle_minutes * 60_000), SET_ITEMS)
    # with timers a stream goes on as long as it is let, so a run that is to end has none
    mode = "None" if idle_minutes is None else "ProcessingTime"
    return f.groupBy("machine_id").transformWithStateInPandas(processor, _OUT, "append", mode)


def start_stateful_windows(spark: SparkSession, logs: DataFrame, sink_path: str, checkpoint_location: str | None = None,
                           gap_minutes: int = DEFAULT_GAP_MINUTES, delay_minutes: int = 120, idle_minutes: float | None = None,
                           available_now: bool = True, interval: str = "1 minute") -> StreamingQuery:
    """Run the stream into a Parquet sink partitioned by kind. Its state store is RocksDB's, which the query keeps.

    ``available_now`` ends with the input there is; ``idle_minutes`` is for streams that go on.
    """
    if available_now and idle_minutes is not None:
        raise ValueError("a run that ends with its input has no timers")
    loc = checkpoint_location or f"{checkpoint_dir(spark).rstrip('/')}/streams/stateful_windows"
    before = spark.conf.get(_PROVIDER, None)
    spark.conf.set(_PROVIDER, _ROCKS)
    try:
        w = (stateful_failure_windows(logs, gap_minutes, delay_minutes, idle_minutes).writeStream
             .outputMode("append").format("parquet").partitionBy("kind")
             .option("path", sink_path).option("checkpointLocation", loc))
        w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime=interval)
        return w.start()
    finally:
        if before is None:
            spark.conf.unset(_PROVIDER)
        else:
            spark.conf.set(_PROVIDER, before)


def closed_windows(spark: SparkSession, sink_path: str) -> DataFrame:
    return _readable(spark.read.schema(f"{_OUT.replace('kind string, ', '')}, kind string").parquet(sink_path).where("kind = 'window'"))


def late_rows(spark: SparkSession, sink_path: str) -> DataFrame:
    """(machine_id, event_id, timestamp): rows that came after their time was closed."""
    rows = spark.read.schema(f"{_OUT.replace('kind string, ', '')}, kind string").parquet(sink_path).where("kind = 'late'")
    return rows.select("machine_id", "event_id", F.expr("timestampadd(MICROSECOND, start_us, TIMESTAMP_NTZ'1970-01-01 00:00:00')").alias("timestamp"))


def open_windows(spark: SparkSession, checkpoint_location: str) -> DataFrame:
    """The windows not closed at the end of the last run, from the query's state."""
    state = spark.read.format("statestore").option("stateVarName", "open").load(checkpoint_location)
    return _readable(state.select(F.col("key.machine_id").alias("machine_id"), "list_element.*"))
