"""Stateful operators that see each key's rows in event-time order.

Keys are dealt over slots by their hash. A slot's rows wait in the state, packed, until the
watermark has passed them; one timer per slot wakes the operator for the oldest. So a key costs
no calls of the state store, and a task holds the rows and the state of one slot at a time. What
an operator does with its rows in order is :meth:`InOrder.apply`; the result does not depend on
how the rows were cut into micro-batches, and state and timers survive restarts through the
checkpoint.

Rows later than the watermark never reach the operator: Spark drops and counts them
(``numRowsDroppedByWatermark``). Rows at the last instant of a stream wait for a later
row of any key, be it only a clock row.
"""
from __future__ import annotations

import pickle
import sys
from collections.abc import Iterator
from operator import itemgetter

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

#: Event-time column of inputs and outputs.
EVENT_TIME = "event_time"
#: Result rows handed on at once.
CHUNK = 10_000
#: Groups that the keys of an operator are dealt over.
SLOTS = 1024


class InOrder(StatefulProcessor):
    """Rows of the key and ``columns`` in the order of ``order``, whose first column is the time in
    milliseconds. With an event time in front the ``output`` takes it from its column ``ts``."""

    columns: tuple[str, ...] = ()
    order: tuple[str, ...] = ("ts", "ord")
    output: tuple[str, ...] = ()

    def over(self, key: tuple[str, ...], kinds: dict[str, str]) -> InOrder:
        """Set the key columns, which are the first of each row."""
        self.names = [*key, *self.columns]
        self.whole = [kinds[c] in ("bigint", "int", "smallint", "tinyint") for c in self.names]
        return self

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "rows binary")
        self.next = handle.getValueState("next", "ts bigint")
        self.kept = handle.getValueState("kept", "state binary")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        oldest = []
        for frame in filter(len, rows):
            oldest.append(int(frame[self.order[0]].min()))
            packed = list(zip(*(self._plain(frame[c], w) for c, w in zip(self.names, self.whole))))
            self.waiting.appendValue((pickle.dumps(packed),))
        known = self.next.get()[0] if self.next.exists() else None
        if oldest and (known is None or min(oldest) < known):
            self._wake(known, min(oldest))
        yield self._frame([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        upto, at = timerValues.getCurrentWatermarkInMs(), self.names.index(self.order[0])
        due, later = [], []
        for packed in self.waiting.get():
            for row in pickle.loads(packed[0]):
                (due if row[at] <= upto else later).append(row)
        due.sort(key=itemgetter(*map(self.names.index, self.order)))
        if later:
            self.waiting.put([(pickle.dumps(later),)])
            self._wake(None, min(r[at] for r in later))
        else:
            self.waiting.clear()
            self.next.clear()
        state = pickle.loads(self.kept.get()[0]) if self.kept.exists() else {}
        yield from self.frames(state, due)
        if state:
            self.kept.update((pickle.dumps(state),))
        else:
            self.kept.clear()

    def _wake(self, known: int | None, ts: int) -> None:
        if known is not None:
            self.handle.deleteTimer(known)
        self.handle.registerTimer(ts)
        self.next.update((ts,))

    def _frame(self, rows: list[tuple]) -> pd.DataFrame:
        names = [c.split()[0] for c in self.output]
        if names[0] != EVENT_TIME or not rows:
            return pd.DataFrame(rows, columns=names)
        frame = pd.DataFrame(rows, columns=names[1:])
        frame.insert(0, EVENT_TIME, pd.to_datetime(frame["ts"], unit="ms"))
        return frame

    def frames(self, state: dict, rows: list[tuple]) -> Iterator[pd.DataFrame]:
        """Results of :meth:`apply`, ``CHUNK`` at a time."""
        out: list[tuple] = []
        for row in self.apply(state, rows):
            out.append(row)
            if len(out) == CHUNK:
                yield self._frame(out)
                out = []
        yield self._frame(out)

    @staticmethod
    def _plain(values: pd.Series, whole: bool) -> list:
        if values.dtype != object:
            # pandas makes floats of whole numbers beside nulls
            plain = values.tolist()
            return plain if values.dtype.kind in "iub" else [None if v != v else int(v) if whole else v for v in plain]
        lists = (v.tolist() if hasattr(v, "tolist") else None if isinstance(v, float) and v != v else v for v in values)
        return [[tuple(x.values()) if isinstance(x, dict) else x for x in v] if isinstance(v, list) else v for v in lists]

    def apply(self, state: dict, rows: list[tuple]) -> Iterator[tuple]:
        """Results of rows in order. ``state`` is that of all keys of the slot, changed in place."""
        raise NotImplementedError

    def close(self) -> None:
        pass


def use_event_time(spark) -> None:
    """RocksDB state; of several inputs the newest event moves the watermark, so a quiet input
    (subscription requests at night) does not hold the others up."""
    spark.conf.set(
        "spark.sql.streaming.stateStore.providerClass",
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    )
    spark.conf.set("spark.sql.streaming.multipleWatermarkPolicy", "max")


def timed(df: DataFrame, delay: str, ts: str = "ts") -> DataFrame:
    """``df`` with its event time and watermark."""
    return df.withColumn(EVENT_TIME, F.timestamp_millis(ts)).withWatermark(EVENT_TIME, delay)


def in_order(
    df: DataFrame, key: tuple[str, ...], processor: InOrder, *, chained: bool = False, slots: int = SLOTS
) -> DataFrame:
    """Run ``processor`` on the rows of each ``key``. ``df`` has a watermark. With ``chained`` the
    output's first column is its event time, for a stateful operator above this one. A checkpoint
    holds for its number of ``slots``: the more, the fewer rows and the less state a task takes
    at once."""
    # the worker that plans the operator does not see files added to the session
    for module in {__name__, type(processor).__module__}:
        cloudpickle.register_pickle_by_value(sys.modules[module])
    use_event_time(df.sparkSession)
    dealt = df.withColumn("slot", F.pmod(F.xxhash64(*key), F.lit(slots)).cast("int"))
    return dealt.groupBy("slot").transformWithStateInPandas(
        statefulProcessor=processor.over(key, dict(df.dtypes)), outputStructType=", ".join(processor.output),
        outputMode="Append", timeMode="EventTime", eventTimeColumnName=EVENT_TIME if chained else "",
    )
