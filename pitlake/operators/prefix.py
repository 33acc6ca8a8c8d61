"""Running sums inside groups of any size.

Rows are cut into slices, contiguous ranges of (group, order) dealt by a range partitioning, so a hot group spreads over many slices. Slices are summed,
the sums of earlier slices of a group become a slice's offset, and only inside a slice are rows sorted. With a budget, slices that start beyond it are
never sorted or sent on. Where a group's rows meet, they are one row per slice.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pitlake.session import stage

SLICE = "_slice"


def sliced(rows: DataFrame, by: Sequence[str], order: Sequence[str], slices: int | None = None) -> DataFrame:
    """``rows`` with the number of their slice, written once: a range partitioning samples, so another run may cut elsewhere."""
    keys = [*by, *order]
    dealt = rows.repartitionByRange(slices, *keys) if slices else rows.repartitionByRange(*keys)
    return stage(dealt.withColumn(SLICE, F.spark_partition_id()), "sliced")


def offsets(cut: DataFrame, by: Sequence[str], amounts: Mapping[str, Column]) -> DataFrame:
    """One row per group and slice with the sums over the group's earlier slices, named as in ``amounts``."""
    sums = cut.groupBy(*by, SLICE).agg(*[F.sum(value).alias(name) for name, value in amounts.items()])
    earlier = Window.partitionBy(*by).orderBy(SLICE).rowsBetween(Window.unboundedPreceding, -1)
    return sums.select(*by, SLICE, *[F.coalesce(F.sum(name).over(earlier), F.lit(0)).alias(name) for name in amounts])


def running_sums(
    rows: DataFrame, by: Sequence[str], order: Sequence[str], amounts: Mapping[str, Column], budget: tuple[str, int] | None = None, slices: int | None = None,
) -> DataFrame:
    """``rows`` with, under each name, the sum of its amount over the rows of the same group up to this one (nulls are one group).

    ``order`` should be total; equal places are summed in any order. ``budget`` = (name, most) keeps the rows whose sum is at most that, for an
    amount that is never negative.
    """
    cut = sliced(rows, by, order, slices)
    before = offsets(cut, by, amounts)
    if budget:
        before = before.where(F.col(budget[0]) <= budget[1])
    inside = Window.partitionBy(*by, SLICE).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    start = {name: f"_before_{name}" for name in amounts}
    keys = {c: f"_key_{c}" for c in [*by, SLICE]}
    shifted = before.select(*[F.col(c).alias(k) for c, k in keys.items()], *[F.col(name).alias(s) for name, s in start.items()])
    on = None
    for c, k in keys.items():
        same = F.col(c).eqNullSafe(F.col(k))
        on = same if on is None else on & same
    joined = cut.join(shifted, on)
    out = joined.select(*rows.columns, *[(F.col(start[name]) + F.sum(value).over(inside)).alias(name) for name, value in amounts.items()])
    return out.where(F.col(budget[0]) <= budget[1]) if budget else out
