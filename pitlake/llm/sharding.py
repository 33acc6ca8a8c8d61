"""Sharding by a hierarchical weighted hash tree, in DataFrame functions only.

A document descends from region to rack to shard. On each level every child draws a number from the document's key, an exponential with the
child's weight as its rate, and the smallest wins, so children get rows in proportion to their weights. A changed weight alters only the draws of
that child and of the subtrees above it, so rows move only into or out of those. Shards beyond the base tree are added as regions of their own,
which makes a new shard take rows only into itself.

Cases: a null doc_id is a key like any other; a null text has size 1 and the checksum of no bytes. Rows that share a doc_id share a shard and get
slots of their own; slots follow the written row order. An empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pitlake.llm.common import numbered
from pitlake.session import stage

SLICE_ROWS = 1 << 16
TASK_BITS = 33


@dataclass(frozen=True)
class Leaf:
    region: str
    rack: str
    shard: int
    weight: float = 1.0


def base_tree(shards: int, regions: int = 2, racks: int = 2, base: int = 16) -> list[Leaf]:
    """``base`` shards dealt over racks of regions; each shard beyond them stands in a region of its own."""
    inner = [Leaf(f"r{s * regions // base}", f"k{s * regions * racks // base}", s) for s in range(min(shards, base))]
    return inner + [Leaf(f"r+{s}", f"k+{s}", s) for s in range(base, shards)]


def draw(key: str, child: str, weight: float) -> Column:
    """Exponential draw of ``child`` for a row: the lower the weight, the larger the number."""
    u = (F.shiftrightunsigned(F.xxhash64(F.lit(child), key), 11) + F.lit(0.5)) / F.lit(float(1 << 53))
    return -F.log(u) / F.lit(float(weight))


def winner(key: str, choices: Sequence[tuple[str, float, Column]]) -> Column:
    """Value of the child with the smallest draw; equal draws go to the first."""
    if len(choices) == 1:
        return choices[0][2]
    return F.array_min(F.array(*[F.struct(draw(key, name, weight).alias("d"), F.lit(i).alias("i"), value.alias("v")) for i, (name, weight, value) in enumerate(choices)]))["v"]


def descend(key: str, leaves: Sequence[Leaf]) -> Column:
    """Shard of a row: the region is drawn first, then a rack in it, then a shard in that."""
    def total(part: Sequence[Leaf]) -> float:
        return sum(leaf.weight for leaf in part)

    regions: dict[str, dict[str, list[Leaf]]] = {}
    for leaf in leaves:
        if leaf.weight > 0:
            regions.setdefault(leaf.region, {}).setdefault(leaf.rack, []).append(leaf)
    picks = []
    for region, racks in regions.items():
        inner = [(f"rack/{region}/{rack}", total(own), winner(key, [(f"shard/{leaf.shard}", leaf.weight, F.lit(leaf.shard)) for leaf in own])) for rack, own in racks.items()]
        picks.append((f"region/{region}", sum(total(own) for own in racks.values()), winner(key, inner)))
    return winner(key, picks)


def assign(docs: DataFrame, shards: int) -> DataFrame:
    """One row per document: doc_id, size, text_crc32, law, shard, slot, grown_shard (with one shard more).

    A slot is the count of rows before it in its shard: offsets per slice of the row number come from a small table of counts, and only the
    rows of one slice are numbered in one place, so a full shard never meets in one task.
    """
    data = F.coalesce(F.col("text").cast("binary"), F.lit(b""))
    rows = numbered(
        docs, ["doc_id", F.octet_length(data).cast("long").alias("bytes"), F.crc32(data).alias("text_crc32"), descend("doc_id", base_tree(shards)).cast("int").alias("shard"),
               descend("doc_id", base_tree(shards + 1)).cast("int").alias("grown_shard")], ["uid"], "placed")
    sliced = rows.withColumn("task", F.shiftright("uid", TASK_BITS)).withColumn("slice", F.floor(F.col("uid").bitwiseAND(F.lit((1 << TASK_BITS) - 1)) / SLICE_ROWS))
    counts = stage(sliced.groupBy("shard", "task", "slice").agg(F.count(F.lit(1)).alias("n")), "counts")
    totals = counts.groupBy("shard", "task").agg(F.sum("n").alias("n"))
    by_task = totals.select("shard", "task", (F.sum("n").over(Window.partitionBy("shard").orderBy("task")) - F.col("n")).alias("before_task"))
    within = counts.select("shard", "task", "slice", (F.sum("n").over(Window.partitionBy("shard", "task").orderBy("slice")) - F.col("n")).alias("before_slice"))
    starts = within.join(by_task, ["shard", "task"]).select("shard", "task", "slice", (F.col("before_task") + F.col("before_slice")).alias("start"))
    place = F.row_number().over(Window.partitionBy("task", "slice", "shard").orderBy("uid")) - 1
    return sliced.withColumn("place", place).join(starts, ["shard", "task", "slice"]).select(
        "doc_id", (F.col("bytes") + 1).alias("size"), "text_crc32", F.lit("key").alias("law"), "shard", (F.col("start") + F.col("place")).cast("long").alias("slot"), "grown_shard")
