"""Shortage calls as a stateful stream (R01, R03): a call opens with a shortage, is held, and closes by a timer."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

OUT = "key long, opened_us long, closed_us long, shortages long, peak double"
PROVIDER, ROCKS = "spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def merged(calls: list[tuple], hold_us: int) -> list[tuple]:
    """Calls (opened, last shortage, shortages, peak) of which those within the hold are one, in order."""
    out: list[tuple] = []
    for opened, last, n, peak in sorted(calls):
        if out and opened - out[-1][1] < hold_us:
            before = out[-1]
            out[-1] = (before[0], max(before[1], last), before[2] + n, max(before[3], peak))
        else:
            out.append((opened, last, n, peak))
    return out


class ShortageLatch(StatefulProcessor):
    """A call for a key opens at its first shortage and stays open until no shortage has come for ``hold_us``.

    What is kept for a key is a list of its calls that may still change, merged as rows arrive in whatever order, so its size doesn't
    grow with the rows of a call. Rows come as they are, since a data frame for each key would cost more than its rows. Each call has an event-time timer at its end; what the watermark has passed is put out once. Rows
    behind the watermark are late and dropped by Spark. A row without a value is a mark that the log of its key has ended.
    """

    def __init__(self, hold_us: int) -> None:
        self.hold_us = hold_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.calls = handle.getListState("calls", "opened long, last long, n long, peak double")

    def _due(self, calls: list[tuple]) -> int | None:
        """When the timer of a key is set that keeps ``calls``: one at a time, for the call that ends first."""
        return -(-(calls[0][1] + self.hold_us) // 1000) if calls else None

    def _keep(self, calls: list[tuple], set_for: int | None) -> None:
        if calls:
            self.calls.put(calls)
        else:
            self.calls.clear()
        due = self._due(calls)
        if due != set_for:
            if set_for is not None:
                self.handle.deleteTimer(set_for)
            if due is not None:
                self.handle.registerTimer(due)

    def _said(self, key: tuple, calls: list[tuple]) -> Iterator[Row]:
        for opened, last, n, peak in calls:
            yield Row(key=key[0], opened_us=opened, closed_us=last + self.hold_us, shortages=n, peak=peak)

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        found, ended = [], False
        for r in rows:
            if r.value is None:
                ended = True
            elif r.value == r.value:
                found.append((r.at_us, r.at_us, 1, r.value))
        before = list(map(tuple, self.calls.get()))
        calls = merged([*before, *found], self.hold_us)
        self._keep([] if ended else calls, self._due(before))
        yield from self._said(key, calls if ended else [])

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[Row]:
        now = timerValues.getCurrentWatermarkInMs()
        calls = list(map(tuple, self.calls.get()))
        over = [c for c in calls if self._due([c]) <= now]
        self._keep(calls[len(over) :], None)  # calls are in order, and so are their ends
        yield from self._said(key, over)

    def close(self) -> None:
        pass


def shortage_calls(events: DataFrame, key: str, at: str, value: str, least: float, hold_us: int, late: str = "2 hours") -> DataFrame:
    """(key, opened_us, closed_us, shortages, peak) of each call, once it is over. A shortage is a row of ``value`` ``least`` or more; a
    row with a null value ends the log of its key.

    The session needs the RocksDB state store: see with_rocks().
    """
    shortages = events.where((F.col(value) >= least) | F.col(value).isNull())
    rows = shortages.withWatermark(at, late).select(F.col(key).cast("long").alias("key"), F.col(at).alias("at"), F.unix_micros(at).alias("at_us"), F.col(value).cast("double").alias("value"))
    return rows.groupBy("key").transformWithState(ShortageLatch(hold_us), OUT, "append", "EventTime")


class with_rocks:  # noqa: N801
    """Sets the state store that stateful processors need, for streams that begin inside, and puts back what was set."""

    def __init__(self, spark) -> None:
        self.spark = spark

    def __enter__(self) -> None:
        self.before = self.spark.conf.get(PROVIDER, None)
        self.spark.conf.set(PROVIDER, ROCKS)

    def __exit__(self, *_) -> None:
        if self.before is None:
            self.spark.conf.unset(PROVIDER)
        else:
            self.spark.conf.set(PROVIDER, self.before)
