"""Exact order statistics of groups of any size.

``median`` keeps every distinct value of a group in one task. Here a group is first cut into slices at approximate
quantiles (a sketch of fixed size), slices are counted, and only the slices that hold the wanted ranks are sorted.
The sketch decides where to cut, never the answer.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SLICES = 64


def order_statistics(
    rows: DataFrame, by: Sequence[str], value: str, ranks: dict[str, Column], counts: dict[str, Column] | None = None,
) -> DataFrame:
    """Per group: ``n`` and, for each name in ``ranks``, the value at that 1-based rank (NULL outside 1..n).

    A rank may be an expression of the group's size column ``n``. ``counts`` adds numbers of rows whose value meets a condition.
    """
    counts = counts or {}
    counted = rows.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count(F.lit(1)).alias("_c"))
    cuts = [i / SLICES for i in range(1, SLICES)]
    group = counted.groupBy(*by).agg(
        F.sum("_c").alias("n"), F.percentile_approx(value, cuts, 1000).alias("_cuts"),
        *[F.sum(F.when(condition, F.col("_c")).otherwise(0)).alias(name) for name, condition in counts.items()])
    sliced = counted.join(group, list(by)).withColumn("_slice", F.size(F.filter("_cuts", lambda c: c < F.col(value))))
    sizes = sliced.groupBy(*by, "n", *counts, "_slice").agg(F.sum("_c").alias("_in_slice"))
    earlier = Window.partitionBy(*by).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.withColumn("_before", F.coalesce(F.sum("_in_slice").over(earlier), F.lit(0)))
    wanted = F.lit(False)
    for rank in ranks.values():
        wanted = wanted | ((rank > F.col("_before")) & (rank <= F.col("_before") + F.col("_in_slice")))
    kept = sizes.where(wanted).select(*by, "_slice", "_before")
    inside = Window.partitionBy(*by, "_slice").orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    ranked = sliced.join(kept, [*by, "_slice"]).withColumn("_upto", F.col("_before") + F.sum("_c").over(inside))
    picks = [
        F.max(F.when((rank <= F.col("_upto")) & (rank > F.col("_upto") - F.col("_c")), F.col(value))).alias(name)
        for name, rank in ranks.items()
    ]
    return ranked.groupBy(*by, "n", *counts).agg(*picks)


def grouped_row_number(df: DataFrame, by: Sequence[str], slices: Sequence[str], slice_order: Sequence[Column], order: Sequence[Column], name: str) -> DataFrame:
    """``row_number`` over (by, slice order, order) for groups of any size.

    Rows are numbered inside (by, slices) and shifted by the sizes of earlier slices, so only slice counts of a group meet.
    """
    local = Window.partitionBy(*by, *slices).orderBy(*order)
    earlier = Window.partitionBy(*by).orderBy(*slice_order).rowsBetween(Window.unboundedPreceding, -1)
    sizes = df.groupBy(*by, *slices).agg(F.count(F.lit(1)).alias("_n")).withColumn("_before", F.coalesce(F.sum("_n").over(earlier), F.lit(0))).drop("_n")
    numbered = df.withColumn("_local", F.row_number().over(local))
    on = None
    for c in [*by, *slices]:
        same = numbered[c].eqNullSafe(sizes[c])
        on = same if on is None else on & same
    return numbered.join(sizes, on).select(*[numbered[c] for c in df.columns], (F.col("_before") + F.col("_local")).alias(name))
