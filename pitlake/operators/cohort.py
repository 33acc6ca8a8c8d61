"""Cohorts of already settled comparables around a decision date, and the regime read from them.

A cohort depends only on the as-of date, so it is built once per distinct date instead of once per target, and each
target's own outcome is taken out of the cohort's sums and order statistics arithmetically. No target x comparable
pairs are made: the rows are outcomes x the as-of dates whose band they fall in, at most one band of days each.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pitlake.operators.ranks import order_statistics

# Band, settling margin and regime thresholds.
LOOKBACK_DAYS = 90
COMPLETION_BUFFER_DAYS = 9
MIN_COHORT = 3
STRONG_COHORT = 6
FAVORABLE_SHARE = 0.55
UNFAVORABLE_SHARE = 0.45


def _band_buckets(as_of: DataFrame, lookback: int) -> DataFrame:
    day = F.unix_date("as_of")
    first, last = F.floor((day - lookback) / lookback), F.floor(day / lookback)
    return as_of.select("as_of", F.explode(F.sequence(first, last)).alias("_band"))


def mature_outcomes(outcomes: DataFrame, as_of: DataFrame, metric: str, lookback: int = LOOKBACK_DAYS) -> DataFrame:
    """Cohort members per distinct as-of date: metric known, started within the band, settled by the as-of date.

    ``outcomes``: entity_id, start_date and metrics. ``as_of``: one DATE column. Dates meet starts on a band number
    (at most two per date), so the date range never becomes a nested loop.
    """
    dates = _band_buckets(as_of.select("as_of").distinct(), lookback)
    starts = outcomes.where(F.col(metric).isNotNull() & F.col("start_date").isNotNull())
    starts = starts.withColumn("_band", F.floor(F.unix_date("start_date") / lookback))
    age = F.datediff("as_of", "start_date")
    met = starts.join(dates, "_band").where((age > 0) & (age <= lookback) & (age >= COMPLETION_BUFFER_DAYS))
    return met.drop("_band")


def _without_own(targets: DataFrame, outcomes: DataFrame, metric: str, lookback: int) -> DataFrame:
    """Targets with their own metric value where they would be a member of their own cohort."""
    own = outcomes.where(F.col("start_date").isNotNull()).select(
        F.upper("entity_id").alias("_key"), F.col("start_date").alias("_own_start"), F.col(metric).alias("_own"))
    joined = targets.withColumn("_key", F.upper(F.trim("target_id"))).join(own, "_key", "left")
    age = F.datediff("as_of", "_own_start")
    inside = (age > 0) & (age <= lookback) & (age >= COMPLETION_BUFFER_DAYS)
    return joined.select("target_id", "as_of", F.when(inside, F.col("_own")).alias("_own"))


def _cohort_read(targets: DataFrame, outcomes: DataFrame, metric: str, lookback: int) -> DataFrame:
    members = mature_outcomes(outcomes, targets.select("as_of"), metric, lookback)
    n = F.col("n")
    half = F.floor(n / 2)
    stats = order_statistics(members, ["as_of"], metric, {
        "_v0": half, "_v1": half + 1, "_v2": half + 2,
        "_first": F.lit(1), "_second": F.lit(2), "_last": n, "_before_last": n - 1,
    }, {"_pos": F.col(metric) > 0})
    read = _without_own(targets, outcomes, metric, lookback).join(stats, "as_of", "left")
    is_member = F.col("_own").isNotNull()
    size = F.coalesce(n, F.lit(0)) - F.when(is_member, 1).otherwise(0)
    pos = F.coalesce(F.col("_pos"), F.lit(0)) - F.when(F.col("_own") > 0, 1).otherwise(0)

    def skipping_own(at, after):
        return F.when(is_member & (F.col("_own") <= at), after).otherwise(at)

    v0, v1, v2 = F.col("_v0"), F.col("_v1"), F.col("_v2")
    # With m the reduced size: even m needs ranks m/2 and m/2 + 1, odd m the middle one, counted without the own row.
    odd_total = (n % 2) == 1
    low = F.when(is_member, skipping_own(v0, v1)).otherwise(F.when(odd_total, v1).otherwise(v0))
    high = F.when(is_member, F.when(odd_total, skipping_own(v1, v2)).otherwise(skipping_own(v0, v1))).otherwise(v1)
    worst = F.when(is_member & (F.col("_own") <= F.col("_first")), F.col("_second")).otherwise(F.col("_first"))
    best = F.when(is_member & (F.col("_own") >= F.col("_last")), F.col("_before_last")).otherwise(F.col("_last"))
    return read.select(
        "target_id", "as_of", size.alias("n"), pos.alias("positive"), ((low + high) / 2).alias("median"),
        worst.alias("worst"), best.alias("best"),
    )


def cohort_regime(targets: DataFrame, outcomes: DataFrame, metric: str, lookback: int = LOOKBACK_DAYS) -> DataFrame:
    """FAVORABLE / NEUTRAL / UNFAVORABLE by the share of positive members; fewer than three is UNKNOWN.

    ``targets``: target_id, as_of (DATE). The target itself never counts, whatever its letter case. ``outcomes`` has
    one row per entity, and entity ids stay distinct when upper-cased.
    """
    read = _cohort_read(targets, outcomes, metric, lookback)
    known = F.col("n") >= MIN_COHORT
    share = F.when(known, F.col("positive") / F.col("n"))
    status = (
        F.when(~known, "UNKNOWN").when(share >= FAVORABLE_SHARE, "FAVORABLE")
        .when(share <= UNFAVORABLE_SHARE, "UNFAVORABLE").otherwise("NEUTRAL")
    )
    return read.select(
        "target_id", "as_of", status.alias("status"), F.col("n").alias("mature_count"),
        F.when(known, F.col("median")).alias("median_return"), share.alias("positive_share"),
    )


def cohort_observation(targets: DataFrame, outcomes: DataFrame, metric: str, lookback: int = LOOKBACK_DAYS, maturity: str | None = None) -> DataFrame:
    """Worst, median and best of the members' own returns as fractions; an empty cohort gives count 0 and NULLs.

    ``maturity`` names the column that must also be known for a member to count (the index-relative return).
    """
    settled = outcomes if maturity is None else outcomes.where(F.col(maturity).isNotNull())
    read = _cohort_read(targets, settled, metric, lookback)
    some = F.col("n") > 0
    return read.select(
        "target_id", "as_of", F.col("n").alias("comparable_count"),
        *[F.when(some, F.col(c) / 100).alias(f"observed_{c}") for c in ("worst", "median", "best")],
    )
