"""Intervals from a stream of start/end events in event time: events wait in the state until no earlier one can come."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from arrayflow.functions.expr import MICROS, micros

INTERVALS = "worker_id bigint, task_id string, start_us bigint, end_us bigint, duration double"
#: A row of this kind is no event; it only says that the time of its ``ts`` has come.
TICK = "tick"
STATE_STORE = "spark.sql.streaming.stateStore.providerClass"
# Fixed value: state with timers needs this store.
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_PER_MILLI = 1000
_ROWS = 10_000
#: Parts that the workers are dealt to, each with one state.
BUCKETS = 1024
# Events as they wait in the state, many to a value.
_EVENTS = pa.schema([("worker", pa.string()), ("ts_us", pa.int64()), ("seq", pa.int64()), ("start", pa.bool_()), ("task_id", pa.string())])


def _packed(events: pd.DataFrame) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, _EVENTS) as writer:
        writer.write_table(pa.Table.from_pandas(events, _EVENTS, preserve_index=False))
    return sink.getvalue().to_pybytes()


def _unpacked(values: Iterable[bytes]) -> pd.DataFrame:
    tables = [pa.ipc.open_stream(v).read_all() for v in values]
    return pa.concat_tables([_EVENTS.empty_table(), *tables]).to_pandas()


class Intervals(StatefulProcessor):
    """Per bucket of workers: the events behind the watermark, the open starts, and one timer at the earliest waiting event.

    A call to the state costs as much as hundreds of events, so that buckets, not workers, keep it.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._handle = handle
        self._waiting = handle.getListState("waiting", "events binary")
        self._opened = handle.getValueState("opened", "events binary")
        self._due = handle.getValueState("due", "milli bigint")

    def _wake(self, ts_us: int) -> None:
        """One timer, at the earliest event that waits."""
        milli = -(-ts_us // _PER_MILLI)
        before = self._due.get()
        if before is not None and before[0] <= milli:
            return
        if before is not None:
            self._handle.deleteTimer(before[0])
        self._handle.registerTimer(milli)
        self._due.update((milli,))

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        reached = timerValues.getCurrentWatermarkInMs() * _PER_MILLI
        least = None
        for frame in rows:
            # An event behind the watermark would end an interval before it began: its place in the order is gone.
            events = frame.loc[(frame["kind"] != TICK) & (frame["ts_us"] > reached)]
            if len(events):
                self._waiting.appendValue((_packed(events.assign(start=events["kind"] == "start")[_EVENTS.names]),))
                first = int(events["ts_us"].min())
                least = first if least is None else min(least, first)
        if least is not None:
            self._wake(least)
        return iter(())

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        reached = timerValues.getCurrentWatermarkInMs() * _PER_MILLI
        waiting = _unpacked(row[0] for row in self._waiting.get())
        due = waiting["ts_us"] <= reached
        opened, now, rest = self._opened.get(), waiting[due], waiting[~due]
        # Open starts are earlier than all that waits.
        events = pd.concat([_unpacked([opened[0]]), now], ignore_index=True) if opened is not None else now
        codes, workers = pd.factorize(events["worker"])
        order = np.lexsort((events["seq"], events["ts_us"], codes))
        events, codes = events.iloc[order], codes[order]
        last = np.append(codes[1:] != codes[:-1], True)[:len(codes)]
        starts = events["start"].to_numpy(dtype=bool)
        begun = np.flatnonzero(starts & ~last)
        still = events[starts & last]
        if len(still):
            self._opened.update((_packed(still),))
        elif opened is not None:
            self._opened.clear()
        self._due.clear()
        if len(rest):
            self._waiting.put([(_packed(rest.iloc[i:i + _ROWS]),) for i in range(0, len(rest), _ROWS)])
            self._wake(int(rest["ts_us"].min()))
        else:
            self._waiting.clear()
        ids = pd.array([int(w) if w else None for w in workers], dtype="Int64")
        ts_us, tasks = events["ts_us"].to_numpy(), events["task_id"].to_numpy()
        for i in range(0, len(begun), _ROWS):
            at = begun[i:i + _ROWS]
            yield pd.DataFrame({"worker_id": ids.take(codes[at]), "task_id": tasks[at], "start_us": ts_us[at], "end_us": ts_us[at + 1], "duration": (ts_us[at + 1] - ts_us[at]) / MICROS})

    def close(self) -> None:
        pass


def stream_intervals(activity_events: DataFrame, late: str = "10 minutes", buckets: int = BUCKETS) -> DataFrame:
    """Closed intervals from a stream of start/end events, in the order of their times, not of their arrival.

    Events may come up to ``late`` behind the newest one, in any order and in any micro-batch; a start is closed by its worker's
    next event once the watermark has passed that event. Later ones are dropped, so that no interval has a negative
    duration; so are times up to 1970, where watermarks begin. The last start of a worker stays open in its state. Rows of kind ``tick`` are no events: a quiet source sends
    them so that time goes on, and a replay ends with one. Workers are dealt to ``buckets`` by hash, which a checkpoint fixes.
    """
    activity_events.sparkSession.conf.set(STATE_STORE, ROCKS)
    # Workers are text: pandas would turn a null among integers into a float.
    worker = F.coalesce(F.col("worker_id").cast("string"), F.lit("")).alias("worker")
    events = activity_events.withWatermark("ts", late).select(worker, "ts", micros("ts").alias("ts_us"), "seq", "kind", F.col("task_id").cast("string").alias("task_id"))
    return events.withColumn("bucket", F.pmod(F.xxhash64("worker"), F.lit(buckets))).groupBy("bucket").transformWithStateInPandas(Intervals(), INTERVALS, "Append", "EventTime")
