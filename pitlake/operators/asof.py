"""As-of and exact-date lookups.

Spark has no as-of join. Both sides are put on one time line and each left row takes the last right
row before it. The time line of one key is cut into calendar buckets so that no task ever holds a
whole key: inside a bucket a window finds the last value, and one row per (key, bucket) carries the
last value of earlier buckets forward.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pitlake.tables import columns


def as_of_join(
    left: DataFrame,
    right: DataFrame,
    by: Sequence[str],
    left_ts: str,
    right_ts: str,
    values: Sequence[str],
    strict: bool = False,
    bucket: str = "MONTH",
    matched_ts: str = "matched_at",
) -> DataFrame:
    """Left rows plus the ``values`` of the latest right row at or before (``strict``: before) ``left_ts``."""
    found = F.struct(F.col(right_ts).alias(matched_ts), *columns(values))
    left_first = 0 if strict else 1
    lefts = left.select(
        *columns(by),
        F.col(left_ts).alias("_ts"),
        F.lit(left_first).alias("_side"),
        F.struct(*columns(left.columns)).alias("_left"),
    )
    rights = right.where(F.col(right_ts).isNotNull()).select(
        *columns(by), F.col(right_ts).alias("_ts"), F.lit(1 - left_first).alias("_side"), found.alias("_found")
    )
    line = lefts.unionByName(rights, allowMissingColumns=True).withColumn("_bucket", F.date_trunc(bucket, "_ts"))
    in_bucket = Window.partitionBy(*by, "_bucket").orderBy("_ts", "_side", "_found")
    local = line.withColumn(
        "_local", F.last("_found", ignorenulls=True).over(in_bucket.rowsBetween(Window.unboundedPreceding, 0))
    ).where(F.col("_left").isNotNull())
    # One row per (key, bucket): partial aggregation runs before the shuffle.
    per_bucket = line.groupBy(*by, "_bucket").agg(F.max(F.when(F.col("_found").isNotNull(), F.struct("_ts", "_found"))).alias("_last"))
    before = Window.partitionBy(*by).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    carried = per_bucket.select(*by, "_bucket", F.last("_last", ignorenulls=True).over(before).getField("_found").alias("_carried"))
    same = [local[k].eqNullSafe(carried[k]) for k in [*by, "_bucket"]]
    joined = local.join(carried, on=_all(same), how="left").select(
        local["_left"], F.coalesce(local["_local"], carried["_carried"]).alias("_found")
    )
    return joined.select("_left.*", "_found.*")


def _all(conditions: Sequence[Column]) -> Column:
    result = conditions[0]
    for c in conditions[1:]:
        result = result & c
    return result


def exact_date_lookup(left: DataFrame, right: DataFrame, by: Sequence[str], left_ts: str, right_ts: str, values: Sequence[str]) -> DataFrame:
    """Value on exactly that date, or NULL; never a nearby date."""
    renamed = right.select(*columns(by), F.col(right_ts).alias("_on"), *columns(values))
    on = [left[k] == renamed[k] for k in by] + [left[left_ts] == renamed["_on"]]
    return left.join(renamed, on=_all(on), how="left").select(*[left[c] for c in left.columns], *[renamed[v] for v in values])
