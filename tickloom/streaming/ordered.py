"""Order along a series from the data, whatever order files and rows arrive in."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from contextlib import contextmanager

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tickloom.schema import lag_name

_STORE = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_MS = "__ms"


class _HeldLags(StatefulProcessor):
    """Rows of one series wait until the watermark has passed them, then leave in the order of their slots."""

    def __init__(self, keys: Sequence[str], order: str, features: Sequence[str], row: T.StructType) -> None:
        self.keys, self.order, self.features, self.schema = list(keys), order, list(features), row

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", self.schema)
        self.before = handle.getValueState("before", T.StructType([self.schema[c] for c in self.features]))

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        new = [tuple(r[f.name] for f in self.schema.fields) for r in rows]
        self.waiting.appendList(new)
        self.handle.registerTimer(min(r[0] for r in new))
        return iter(())

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[Row]:
        now = timerValues.getCurrentWatermarkInMs()
        ready, later = [], []
        for r in self.waiting.get():
            (ready if r[0] <= now else later).append(tuple(r))
        if not ready:
            return iter(())
        last = self.before.get()
        previous = tuple(last) if last is not None else (None,) * len(self.features)
        out = []
        for _, slot, *values in sorted(ready, key=lambda r: r[:2]):
            out.append(Row(**dict(zip(self.keys, key, strict=True)), **{self.order: slot}, **{lag_name(c, 1): v for c, v in zip(self.features, previous, strict=True)}))
            previous = tuple(values)
        self.before.update(previous)
        if later:
            self.waiting.put(later)
            self.handle.registerTimer(min(r[0] for r in later))
        else:
            self.waiting.clear()
        return iter(out)

    def close(self) -> None:
        pass


def intraday_lag(
    stream: DataFrame,
    features: Sequence[str],
    event_time: str,
    delay: str,
    keys: Sequence[str] = ("date_id", "symbol_id"),
    order: str = "time_id",
) -> DataFrame:
    """Lag-1 features along each series, by keyed state and event-time timers.

    Rows may come in any order within ``delay``: a series holds its rows back until the watermark has passed them, and one
    value more for the row that follows. ``event_time`` must be a time that Python can hold (years up to 9999). Nothing depends on file times or on how rows fall into micro-batches. A row behind
    the watermark is dropped, as by every event-time operator. State of a series is what it got within the delay.
    """
    schema = stream.schema
    held = T.StructType([T.StructField(_MS, T.LongType()), schema[order], *[schema[c] for c in features]])
    result = T.StructType([*[schema[k] for k in keys], schema[order], *[T.StructField(lag_name(c, 1), schema[c].dataType) for c in features]])
    processor = _HeldLags(keys, order, features, held)
    timed = stream.select(*keys, order, *features, event_time, F.expr(f"unix_millis({event_time})").alias(_MS)).withWatermark(event_time, delay)
    return timed.groupBy(*keys).transformWithState(processor, result, "append", "eventTime")


@contextmanager
def keyed_state(spark: SparkSession) -> Iterator[None]:
    """The state store that keyed state needs, for streams that are started inside."""
    before = spark.conf.get(_STORE)
    spark.conf.set(_STORE, _ROCKS)
    try:
        yield
    finally:
        spark.conf.set(_STORE, before)
