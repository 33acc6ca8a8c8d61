"""Timed delivery as keyed state: content is due once, again while nobody confirms it, and once more after what was sent has expired.

One stream carries content and confirmations. State is kept per key and content hash, so the versions of a busy key spread over all tasks, and every
state ends: a confirmed hash is forgotten after its time to live, an unconfirmed one after its last attempt. All times are event times, so a run
that starts again from its checkpoint, or cuts its batches elsewhere, says the same. Rows of one key and hash are put in order within a batch
(``maxFilesPerTrigger`` bounds it); rows later than the watermark are not seen, and what is due after the watermark is said when it gets there.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from datetime import datetime, timedelta, timezone

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, StatefulProcessorHandle, TimerValues

STATE_STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKS_DB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
WAITING, SENT = "waiting", "sent"
EPOCH = datetime(1970, 1, 1, tzinfo=timezone.utc)


def millis(moment: datetime) -> int:
    at = moment if moment.tzinfo else moment.astimezone(timezone.utc)
    return (at - EPOCH) // timedelta(milliseconds=1)


class Outbox(StatefulProcessor):
    """State per (key, hash): waiting or sent, the attempt, and the time in milliseconds when it next changes."""

    def __init__(self, names: Sequence[str], time_to_live: timedelta, retry_after: timedelta, attempts: int):
        self.names = [*names, "outcome", "attempt", "due"]
        self.live, self.retry = time_to_live // timedelta(milliseconds=1), retry_after // timedelta(milliseconds=1)
        self.attempts = attempts

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("state", "status string, attempt int, until long")

    def row(self, key: tuple, outcome: str, attempt: int, at: int) -> Row:
        return Row(**dict(zip(self.names, [*key, outcome, attempt, EPOCH.replace(tzinfo=None) + timedelta(milliseconds=at)], strict=True)))

    def advance(self, key: tuple, now: tuple | None, upto: int) -> tuple[tuple | None, list[Row]]:
        """The state at ``upto`` and what became due on the way."""
        said = []
        while now and now[2] <= upto:
            status, attempt, until = now
            if status == SENT:
                now = None
            elif attempt < self.attempts:
                said.append(self.row(key, "send", attempt + 1, until))
                now = (WAITING, attempt + 1, until + self.retry)
            else:
                said.append(self.row(key, "given_up", attempt, until))
                now = None
        return now, said

    def keep(self, before: tuple | None, now: tuple | None) -> None:
        if before == now:
            return
        if before:
            self.handle.deleteTimer(before[2])
        if now:
            self.state.update(now)
            self.handle.registerTimer(now[2])
        else:
            self.state.clear()

    def current(self) -> tuple | None:
        return tuple(self.state.get()) if self.state.exists() else None

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues: TimerValues) -> Iterator[Row]:
        before = now = self.current()
        for at, confirmed in sorted((millis(r["_at"]), bool(r["_confirmed"])) for r in rows):
            now, said = self.advance(key, now, at)
            yield from said
            if confirmed:
                now = (SENT, now[1] if now else 0, max(at + self.live, now[2] if now and now[0] == SENT else 0))
            elif now is None:
                yield self.row(key, "send", 1, at)
                now = (WAITING, 1, at + self.retry)
        self.keep(before, now)

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[Row]:
        before = self.current()
        now, said = self.advance(key, before, timerValues.getCurrentWatermarkInMs())
        yield from said
        if now != before:
            if now:
                self.state.update(now)
                self.handle.registerTimer(now[2])
            else:
                self.state.clear()

    def close(self) -> None:
        pass


def timed_delivery(
    stream: DataFrame, key: Sequence[str], content_hash: str, event_time: str, confirmed: str, delay: str,
    time_to_live: timedelta, retry_after: timedelta, attempts: int = 3,
) -> DataFrame:
    """Stream of key columns, hash, outcome (send or given_up), attempt and due (UTC wall clock, in milliseconds).

    ``stream`` rows are content, or confirmations that content went out where ``confirmed`` is true. Content is sent when first seen, and again each
    ``retry_after`` until it is confirmed or ``attempts`` were made. Confirmed content is not sent again until ``time_to_live`` after its last
    confirmation; after giving up, its next appearance starts anew. Rows without an event time are never due. At one moment
    content comes before confirmations. Needs the RocksDB state store, which :func:`run` chooses.
    """
    timed = stream.where(F.col(event_time).isNotNull()).select(
        *key, content_hash, F.col(event_time).cast("timestamp").alias("_at"), F.coalesce(F.col(confirmed), F.lit(False)).alias("_confirmed"))
    ids = [*key, content_hash]
    kinds = [f"`{c}` {timed.schema[c].dataType.simpleString()}" for c in ids]
    return timed.withWatermark("_at", delay).groupBy(*ids).transformWithState(
        Outbox(ids, time_to_live, retry_after, attempts), ", ".join([*kinds, "outcome string", "attempt int", "due timestamp_ntz"]), "Append", "EventTime")


def run(due: DataFrame, out_path: str, checkpoint: str) -> None:
    """Append what is due from everything that has arrived, and stop. The file sink commits a batch and its state together."""
    conf = due.sparkSession.conf
    before = conf.get(STATE_STORE)
    conf.set(STATE_STORE, ROCKS_DB)
    try:
        due.writeStream.format("parquet").option("path", out_path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start().awaitTermination()
    finally:
        conf.set(STATE_STORE, before)
