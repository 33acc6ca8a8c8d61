"""Exact dedup by a heavy-hitter split.

Misra-Gries summaries of each task name the few digests that may be frequent. Their counts are verified exactly, the verified winners are
broadcast and their copies leave in the map tasks; the digests that remain form small groups and go through an ordinary shuffle.

Cases: a null text equals the empty text. Texts are compared after lower-casing A-Z only. The row with the largest doc_id stays (a null doc_id
is smaller than any number); of rows that share that doc_id too, the one read last in the written row order stays, so one row stays per text.
An empty table gives an empty result. Other columns are carried through ``deduplicate`` untouched, whatever their names.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Iterator
from string import ascii_lowercase, ascii_uppercase

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pitlake.llm.common import fresh, numbered
from pitlake.session import stage

CAPACITY = 4095


def normalised(text: str | Column) -> Column:
    return F.translate(F.coalesce(text, F.lit("")), ascii_uppercase, ascii_lowercase)


def text_digest(text: str | Column) -> Column:
    return F.unhex(F.sha2(normalised(text), 256))


def summarise(values: Iterable[Iterable[object]], capacity: int) -> dict[object, int]:
    """Misra-Gries over blocks of values: no more than ``capacity`` counters, each at most n / (capacity + 1) below the true count."""
    counters: Counter = Counter()
    for block in values:
        counters.update(block)
        if len(counters) > capacity:
            excess = sorted(counters.values(), reverse=True)[capacity]
            counters = Counter({value: count - excess for value, count in counters.items() if count > excess})
    return dict(counters)


def task_summaries(keyed: DataFrame, capacity: int) -> DataFrame:
    """One Misra-Gries summary per task: (digest, count) rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = summarise((b.column(0).to_pylist() for b in batches), capacity)
        yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.binary()), pa.array(list(found.values()), pa.int64())], ["digest", "count"])

    return keyed.select("digest").mapInArrow(run, "digest binary, count long")


def heavy_winners(keyed: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Frequent digests with their exact size and the row that stays.

    Summed summaries are at most n / (capacity + 1) below the true counts and add up to n at most, so no more than capacity + 1 digests reach
    n / (capacity + 1), and every digest with twice that many rows is among them. That bound allows the broadcasts.
    """
    floor = max(2, keyed.count() / (capacity + 1))
    candidates = task_summaries(keyed, capacity).groupBy("digest").agg(F.sum("count").alias("seen")).where(F.col("seen") >= floor).select("digest")
    return stage(group_totals(keyed.join(F.broadcast(candidates), "digest", "left_semi")).where(F.col("group_size") >= floor), "winners")


def group_totals(keyed: DataFrame) -> DataFrame:
    return keyed.groupBy("digest").agg(F.count(F.lit(1)).alias("group_size"), F.max(F.struct("doc_id", "uid")).alias("stays"))


def decide(keyed: DataFrame, winners: DataFrame) -> DataFrame:
    """For every row of ``keyed`` (uid, doc_id, digest): its group's size and the row that stays."""
    hot = keyed.join(F.broadcast(winners), "digest")
    rest = keyed.join(F.broadcast(winners.select("digest")), "digest", "left_anti")
    light = rest.join(group_totals(rest), "digest")
    return hot.unionByName(light).select(
        "uid", "doc_id", F.col("stays.doc_id").alias("keep_id"), "group_size", (F.col("uid") == F.col("stays.uid")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"))


def exact_groups(docs: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256."""
    keyed = numbered(docs, [F.col("doc_id"), text_digest("text").alias("digest")], ["uid"], "digests")
    return decide(keyed, heavy_winners(keyed, capacity)).drop("uid")


def deduplicate(docs: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """The documents that stay, with all their columns. Copies of frequent texts leave before anything is shuffled."""
    uid, digest = fresh(docs.columns, "uid", "digest")
    rows = numbered(docs, [F.col("*"), text_digest("text").alias(digest)], [uid], "rows")
    keyed = rows.select(F.col(uid).alias("uid"), F.col("doc_id"), F.col(digest).alias("digest"))
    winners = heavy_winners(keyed, capacity)
    stays = F.broadcast(winners.select(F.col("digest").alias(digest), F.col("stays.uid").alias("heavy_stays")))
    (heavy_stays,) = fresh(rows.columns, "heavy_stays")
    stays = stays.withColumnRenamed("heavy_stays", heavy_stays)
    left = rows.join(stays, digest, "left").where(F.col(heavy_stays).isNull() | (F.col(heavy_stays) == F.col(uid))).drop(heavy_stays)
    light = keyed.join(F.broadcast(winners.select("digest")), "digest", "left_anti")
    leave = light.join(group_totals(light).where("group_size > 1"), "digest").where(F.col("uid") != F.col("stays.uid")).select(F.col("uid").alias(uid))
    return left.join(stage(leave, "copies"), uid, "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])
