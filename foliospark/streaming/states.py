"""Job and review states as keyed state of a stream: one small state a key, in a state store, given out when it changes.

A key's state is its last event by (time, sequence number), whatever the order of arrival, and the number of its
events. With ``timeout`` a timer is set for every state that is not final; when the watermark passes it, the key is given out
once more as overdue, until another event comes. Only then are events that come later than ``lateness`` dropped; without ``timeout``
none are. States survive a restart from the checkpoint. ``follow`` keeps the changes in a bucketed log, so a batch
writes what changed and not the whole state.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from foliospark.sources.bucketlog import BucketLog
from foliospark.streaming.jobs import DONE

_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
STATE = "status string, at long, seq long, changes long, overdue boolean"


class LastEvent(StatefulProcessor):
    """Keeps the last event of a key; ``at`` is its time in microseconds."""

    def __init__(self, keys: list[str], final: tuple[str, ...], timeout_ms: int | None):
        self.keys, self.final, self.timeout_ms = keys, final, timeout_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.state = handle, handle.getValueState("last", STATE)

    def _row(self, key: tuple, state: tuple) -> Row:
        return Row(**dict(zip(self.keys, key, strict=True)), **dict(zip(("status", "at", "seq", "changes", "overdue"), state, strict=True)))

    def _due(self, state: tuple | None) -> int | None:
        return None if state is None or self.timeout_ms is None or state[4] or state[0] in self.final else state[1] // 1000 + self.timeout_ms

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues: object) -> Iterator[Row]:
        before = tuple(self.state.get()) if self.state.exists() else None
        last, n = before, 0
        for r in rows:
            n += 1
            if last is None or (r.at, r.seq) > (last[1], last[2]):
                last = (r.status, r.at, r.seq)
        last = (*last[:3], (before[3] if before else 0) + n, before is not None and before[4] and last[1:3] == before[1:3])
        was, due = self._due(before), self._due(last)
        if was != due:
            if was is not None:
                self.handle.deleteTimer(was)
            if due is not None:
                self.handle.registerTimer(due)
        self.state.update(last)
        yield self._row(key, last)

    def handleExpiredTimer(self, key: tuple, timerValues: object, expiredTimerInfo: object) -> Iterator[Row]:
        state = (*tuple(self.state.get())[:4], True)
        self.state.update(state)
        yield self._row(key, state)

    def close(self) -> None:
        pass


def keyed_states(events: DataFrame, keys: list[str], final: tuple[str, ...] = DONE, timeout_ms: int | None = None, lateness: str = "1 hour") -> DataFrame:
    """Changed states ``*keys, status, at, seq, changes, overdue`` of a stream of events ``*keys, status, ts, seq``; rows without a time or number count as the earliest."""
    spark = events.sparkSession
    spark.conf.set(_PROVIDER, _ROCKS)
    if timeout_ms is not None:
        events = events.withWatermark("ts", lateness)
    known = events.select(*keys, "status", "ts", F.coalesce(F.unix_micros("ts"), F.lit(-(1 << 62))).alias("at"), F.coalesce(F.col("seq").cast("long"), F.lit(-(1 << 62))).alias("seq"))
    kinds = ", ".join(f"{k} {events.schema[k].dataType.simpleString()}" for k in keys)
    return known.groupBy(*keys).transformWithState(LastEvent(keys, final, timeout_ms), f"{kinds}, {STATE}", "Update", "None" if timeout_ms is None else "EventTime")


def state_log(spark, root: str, keys: list[str], kinds: str, **layout) -> BucketLog:
    """Where ``follow`` keeps states; the first key deals them to buckets. A key's row of most changes is its state."""
    def last(rows: DataFrame) -> DataFrame:
        rest = [c for c in rows.columns if c not in keys]
        return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct("changes", "overdue")).alias("s")).select(*keys, *(F.col("s")[c].alias(c) for c in rest))

    return BucketLog(spark, root, f"{kinds}, {STATE}", keys[0], reduce=last, **layout)


def follow(states: DataFrame, log: BucketLog, checkpoint: str) -> StreamingQuery:
    """Append every batch of changes to the log until the input is used up; a repeated batch is applied once."""
    def each(batch: DataFrame, number: int) -> None:
        log.append(batch, (checkpoint, str(number)))
        log.compact()

    return states.writeStream.outputMode("update").foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
