"""Polling loops as Structured Streaming: new records, changed content, first write wins.

State is the set of seen keys and grows by contract; a watermark column bounds it when late repeats need not be caught.
Every query runs with ``availableNow``, so a scheduled start drains what has arrived and stops.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from datetime import timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from pitlake.operators.quality import new_first_writes
from pitlake.session import stage
from pitlake.sources.sinks import months_of, read_if_any
from pitlake.tables import columns


def distinct_stream(stream: DataFrame, key: Sequence[str], event_time: str | None = None, delay: str | None = None) -> DataFrame:
    """First row per key. With ``event_time`` and ``delay`` keys are forgotten after the delay."""
    if event_time and delay:
        return stream.withWatermark(event_time, delay).dropDuplicatesWithinWatermark(list(key))
    return stream.dropDuplicates(list(key))


def stream_new_records(
    stream: DataFrame, key: Sequence[str], out_path: str, checkpoint: str, send_existing: bool = False, event_time: str | None = None, delay: str | None = None,
) -> StreamingQuery:
    """Every key once, with ``announced``: false for what the very first run finds, unless asked to send it.

    The first run lasts until :func:`finish` marks it as done, so one that dies half-way goes on unannounced after its restart. The file sink
    commits a batch and its state together.
    """
    announced = send_existing or read_if_any(stream.sparkSession, first_run_mark(checkpoint)) is not None
    fresh = distinct_stream(stream, key, event_time, delay).withColumn("announced", F.lit(announced))
    return fresh.writeStream.format("parquet").option("path", out_path).option("checkpointLocation", checkpoint).outputMode("append").trigger(
        availableNow=True).start()


def first_run_mark(checkpoint: str) -> str:
    return checkpoint.rstrip("/") + "-first-run-done"


def finish(query: StreamingQuery, checkpoint: str) -> None:
    """Wait for a run of :func:`stream_new_records` and mark the first run as done; a failed run leaves no mark."""
    query.awaitTermination()
    SparkSession.active().range(1).write.mode("ignore").parquet(first_run_mark(checkpoint))


def stream_changed(stream: DataFrame, key: Sequence[str], content_hash: str, out_path: str, checkpoint: str) -> StreamingQuery:
    """A record whenever its content hash is new for its key; a hash once sent is never resent, even if content reverts.

    State is keyed by (key, hash), so the many versions of one busy key spread over all tasks.
    """
    fresh = distinct_stream(stream, [*key, content_hash])
    return fresh.writeStream.format("parquet").option("path", out_path).option("checkpointLocation", checkpoint).outputMode("append").trigger(
        availableNow=True).start()


def deliver_changed(
    stream: DataFrame, key: Sequence[str], content_hash: str, sent_path: str, checkpoint: str, deliver: Callable[[DataFrame], DataFrame],
) -> StreamingQuery:
    """Like :func:`stream_changed` with a sender: a hash counts as sent only after ``deliver`` returned its row.

    ``deliver`` takes the rows to send and returns those that went out; the rest is tried again when it next appears.
    Delivery is at least once: a batch that dies between ``deliver`` and the record of it sends its rows again. Rows to send are written before
    ``deliver`` sees them and its answer before it is recorded, so neither is computed twice.
    """
    ids = [*key, content_hash]

    def send(batch: DataFrame, batch_id: int) -> None:
        sent = read_if_any(batch.sparkSession, sent_path)
        wanted = batch.dropDuplicates(ids)
        wanted = stage(wanted if sent is None else wanted.join(sent.select(*ids), ids, "left_anti"), "to-send")
        stage(deliver(wanted).select(*ids), "sent").withColumn("batch_id", F.lit(batch_id)).write.mode("append").parquet(sent_path)

    return stream.writeStream.foreachBatch(send).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def stream_in_time(
    stream: DataFrame, key: Sequence[str], event_time: str, delay: timedelta, order: Sequence[str], out_path: str, late_path: str, checkpoint: str,
) -> StreamingQuery:
    """Every key once while it is in time; what comes too late goes to a reject table instead of being dropped.

    A batch's watermark is the latest event time of the batches before it, less ``delay``. Rows older than that, or without a time, are appended to
    ``late_path`` with ``reason`` (late, no event time). Of the others the first of a key in its batch, by time and ``order``, is new unless a row of
    the key that was taken before is not older than the watermark. What is remembered is thus bounded: both tables are partitioned, and of ``out_path``
    (by day and batch) only the days from the watermark on are read. A batch that runs again replaces its own partitions, so each row is written once.
    Null keys are keys like any other.
    """
    marks = checkpoint.rstrip("/") + "-watermarks"
    kind = stream.schema[event_time].dataType

    def take(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        rows = stage(batch.withColumn("batch", F.lit(batch_id)), "batch")
        before, taken = (read_if_any(spark, path) for path in (marks, out_path))
        high = before.where(F.col("batch") < batch_id).agg(F.max("high").cast("string")).first()[0] if before is not None else None
        mark = F.lit(high).cast(kind) - F.lit(delay)
        at = F.col(event_time)
        late = F.coalesce(at < mark, at.isNull())

        def replace(df: DataFrame, path: str, *by: str) -> None:
            df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)

        replace(rows.where(late).withColumn("reason", F.when(at.isNull(), "no event time").otherwise("late")), late_path, "batch")
        timely = rows.where(~late)
        first = timely.groupBy(*columns(key)).agg(F.min_by(F.struct("*"), F.struct(event_time, *order)).alias("_row")).select("_row.*").withColumn("day", F.to_date(event_time))
        if taken is not None and high is not None:
            recent = taken.where((F.col("batch") < batch_id) & (F.col("day") >= F.to_date(mark)) & (at >= mark))
            known = recent.select(*[F.col(c).alias(f"_known_{c}") for c in key]).distinct()
            on = F.lit(True)
            for c in key:
                on = on & F.col(c).eqNullSafe(F.col(f"_known_{c}"))
            first = first.join(known, on, "left_anti")
        replace(first, out_path, "day", "batch")
        replace(timely.groupBy("batch").agg(F.max(event_time).alias("high")), marks, "batch")

    return stream.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def stream_first_write_wins(stream: DataFrame, key: Sequence[str], order: Sequence[str], month_of: str, target_path: str, checkpoint: str) -> StreamingQuery:
    """Append only keys the target lacks; inside a batch the first by ``order``. Late points of unseen keys are accepted.

    The target is partitioned by month and filtered by the batch's months as literals, so only those are read.
    """

    def merge(batch: DataFrame, batch_id: int) -> None:
        staged = batch.withColumn("month", F.date_format(month_of, "yyyy-MM"))
        ids = [*key, "month"]
        target = read_if_any(batch.sparkSession, target_path)
        new_first_writes(staged.limit(0) if target is None else months_of(target, staged), staged, ids, order).write.mode("append").partitionBy("month").parquet(target_path)

    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
