"""Batches of events by count or time, on Spark's keyed state with event-time timers."""

from __future__ import annotations

import sys
from bisect import bisect_left
from collections.abc import Iterator

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from brevia.streaming.events import run_available, scratch

#: Events of a batch at most, and seconds from its first event after which it is closed.
MOST, SECONDS = 20, 30
#: Groups that users are dealt into: calls to Spark's state are made by group, so their number doesn't grow with the users or events.
GROUPS = 2_048
BATCH = "user_id long, first_at long, n long, first_event long, last_event long"
COLUMNS = ["user_id", "first_at", "n", "first_event", "last_event"]
#: An element of a group's state: many events. One that is written again holds at most so many.
WAITING, MOST_HELD = "user_id array<long>, at array<long>, event_id array<long>", 10_000
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


Event = tuple[int, int, int]  # user_id, at, event_id


def cut(rows: list[Event], most: int, micros: int) -> list[tuple[int, int]]:
    """Where batches of sorted events begin and end (not included); a user's last one may still be open."""
    out, a = [], 0
    while a < len(rows):
        user, at, _ = rows[a]
        b = bisect_left(rows, (user, at + micros), a + 1, min(a + most, len(rows)))
        out.append((a, b))
        a = b
    return out


def shown(rows: list[Event], batches: list[tuple[int, int]]) -> pd.DataFrame:
    """The batches of sorted events from a to b as rows of BATCH."""
    return pd.DataFrame([(*rows[a][:2], b - a, rows[a][2], rows[b - 1][2]) for a, b in batches], columns=COLUMNS)


class Batcher(StatefulProcessor):
    """Keeps a group's events until the watermark has passed them, so that they are taken in the order of time, however they come."""

    def __init__(self, most: int, seconds: float) -> None:
        self.most, self.seconds, self.micros = most, seconds, int(seconds * 1_000_000)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", WAITING)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        firsts = []
        for part in rows:
            self.waiting.appendValue(tuple(part[c].tolist() for c in ("user_id", "at", "event_id")))
            firsts.append(int(part["at"].min()))
        watermark = timerValues.getCurrentWatermarkInMs()
        if watermark > 0:
            yield from self._settle(watermark)
        else:  # the first micro-batch: nothing is passed yet, so nothing need be read back
            self._wait(min(firsts), watermark)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        yield from self._settle(timerValues.getCurrentWatermarkInMs())

    def _wait(self, first: int, watermark: int) -> None:
        """Set a timer for when the batch that begins at ``first`` is due."""
        self.handle.registerTimer(max(first // 1000 + int(self.seconds * 1000), watermark) + 1)

    def _settle(self, watermark: int) -> Iterator[pd.DataFrame]:
        """Close what the watermark (milliseconds) allows; what stays gets a timer for when its first batch is due."""
        until = watermark * 1000
        rows = sorted(event for held in self.waiting.get() for event in zip(*held, strict=True))
        final = [r for r in rows if r[1] < until]
        done, left = [], [r for r in rows if r[1] >= until]
        for a, b in cut(final, self.most, self.micros):
            if b - a == self.most or until - final[a][1] >= self.micros:
                done.append((a, b))
            else:
                left += final[a:b]
        if left:
            self._wait(min(r[1] for r in left), watermark)
        if not done:
            return
        if left:
            self.waiting.put([tuple(map(list, zip(*left[k : k + MOST_HELD], strict=True))) for k in range(0, len(left), MOST_HELD)])
        else:
            self.waiting.clear()
        yield shown(final, done)

    def close(self) -> None:
        pass


def drained(waiting: DataFrame, most: int, seconds: float) -> DataFrame:
    """The batches of (user_id, event_id, at) that no more events follow. Rows are sorted within partitions and stream by."""

    def fold(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = []
        for part in parts:
            rows += zip(*(part[c].tolist() for c in ("user_id", "at", "event_id")), strict=True)
            if rows:
                *full, (last, _) = cut(rows, most, int(seconds * 1_000_000))
                yield shown(rows, full)
                rows = rows[last:]  # may go on
        if rows:
            yield shown(rows, [(0, len(rows))])

    rows = waiting.repartition("user_id").sortWithinPartitions("user_id", "at", "event_id").select("user_id", "event_id", "at")
    return rows.mapInPandas(fold, BATCH)


def count_or_time(events: DataFrame, most: int = MOST, seconds: float = SECONDS, late: str = "1 hour", out: str | None = None, groups: int = GROUPS) -> DataFrame:
    """user_id, first_at (microseconds), n, first_event and last_event of every batch of a stream of (event_id, user_id, ts).

    A user's events, in the order of time and id, fill a batch until it has ``most``, or until ``seconds`` have passed since
    its first one. All that is there is processed; what is then still open or behind the watermark is read from the state and
    closed at last. The batches are the same in whatever order files come, if no event comes more than ``late`` behind the
    newest one before it: Spark drops those. Events without a user or a time belong to no batch. Events of the last ``late``
    and of open batches are held in state (in the first micro-batch all). Users are dealt into ``groups``; a task sees one
    group's events at a time. The number stays with a checkpoint.
    """
    spark: SparkSession = events.sparkSession
    out = out or scratch(spark)
    group = F.pmod(F.xxhash64("user_id"), F.lit(groups)).alias("users")
    known = events.where("user_id is not null and ts is not null").select(group, "user_id", "event_id", "ts", F.unix_micros("ts").alias("at")).withWatermark("ts", late)
    before = spark.conf.get(_PROVIDER)
    spark.conf.set(_PROVIDER, _ROCKS)
    cloudpickle.register_pickle_by_value(sys.modules[__name__])  # the worker that reads a processor's states doesn't know the driver's path
    try:
        closed = known.groupBy("users").transformWithStateInPandas(Batcher(most, seconds), BATCH, "Append", "EventTime")
        done = run_available(closed, out)
        waiting = spark.read.format("statestore").option("stateVarName", "waiting").load(f"{out}/checkpoint")
        held = waiting.select(F.inline(F.arrays_zip("list_element.user_id", "list_element.at", "list_element.event_id")))
        rest = drained(held, most, seconds)
        rest.write.mode("overwrite").parquet(f"{out}/rest")
    finally:
        cloudpickle.unregister_pickle_by_value(sys.modules[__name__])
        spark.conf.set(_PROVIDER, before)
    return done.unionByName(spark.read.schema(BATCH).parquet(f"{out}/rest"))
