"""Market outcomes of all entities and the regime each decision date saw."""

from __future__ import annotations

from pyspark.sql import DataFrame

from pitlake.operators import cohort, events
from pitlake.session import stage


def market_outcomes(anchors: DataFrame, prices: DataFrame, index: DataFrame, reference_date=None, announcements: DataFrame | None = None) -> DataFrame:
    """One outcome row per entity, written once because every cohort read starts from it."""
    return stage(events.build_outcomes(anchors, prices, index, reference_date, announcements))


def regimes(targets: DataFrame, outcomes: DataFrame) -> DataFrame:
    """Regime by index-relative first-week return for every (target, decision date)."""
    return cohort.cohort_regime(targets, outcomes, "relative_5d")
