"""Event-anchored returns and drawdowns after a start date, against the anchor's own price and an index."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pitlake.operators.asof import as_of_join

# Session counts per horizon, and how far ahead prices are read.
HORIZONS = {"1d": 1, "5d": 5, "20d": 20, "3m": 60}
DRAWDOWN_HORIZONS = ("5d", "20d", "3m")
LOOKAHEAD_DAYS = 100


def first_sessions(prices: DataFrame, count: int) -> DataFrame:
    """The first ``count`` rows per entity, numbered in ``session``; cut in the map tasks before the shuffle."""
    forward = Window.partitionBy("entity_id").orderBy("obs_date")
    return prices.withColumn("session", F.row_number().over(forward)).where(F.col("session") <= count)


def event_metrics(sessions: DataFrame, horizons: Mapping[str, int] = HORIZONS) -> DataFrame:
    """Wide returns and drawdowns per entity.

    ``sessions``: entity_id, obs_date, close, offer_price, session. At least n rows are needed for a horizon of n;
    a NULL or zero offer price gives NULL. The drawdown's running peak starts at the offer price. Also counts the rows given.
    """
    upto = Window.partitionBy("entity_id").orderBy("session").rowsBetween(Window.unboundedPreceding, 0)
    offer = F.when(F.col("offer_price") != 0, F.col("offer_price"))
    peak = F.greatest(offer, F.max("close").over(upto))
    lined = sessions.select(
        "entity_id", "obs_date", "session",
        ((F.col("close") / offer - 1) * 100).alias("_ret"),
        F.when(offer.isNotNull(), F.when(peak > 0, (F.col("close") / peak - 1) * 100).otherwise(0.0)).alias("_fall"),
    )
    measures = []
    for name, n in horizons.items():
        at = F.col("session") == n
        measures.append(F.max(F.when(at, F.col("_ret"))).alias(f"return_{name}"))
        measures.append(F.max(F.when(at, F.col("obs_date"))).alias(f"date_{name}"))
        enough = F.max("session") >= n
        worst = F.least(F.lit(0.0), F.min(F.when(F.col("session") <= n, F.col("_fall"))))
        has_price = F.min("_fall").isNotNull()
        measures.append(F.when(enough & has_price, worst).alias(f"max_drawdown_{name}"))
    measures += [F.count(F.lit(1)).alias("price_observation_count"), F.max("obs_date").alias("last_price_observation_date")]
    return lined.groupBy("entity_id").agg(*measures)


def sessions_from_start(prices: DataFrame, anchors: DataFrame, reference_date=None, lookahead: int = LOOKAHEAD_DAYS) -> DataFrame:
    """Price rows inside each anchor's window [start, min(start + lookahead, reference date)].

    ``prices`` is unique per (entity_id, obs_date), so one entity is bounded by the calendar.
    ``anchors``: entity_id, offer_price, start_date.
    """
    end = F.date_add("start_date", lookahead)
    if reference_date is not None:
        end = F.least(end, F.lit(reference_date).cast("date"))
    windows = anchors.select("entity_id", "offer_price", "start_date", end.alias("_end"))
    inside = prices.join(windows, "entity_id").where(F.col("obs_date").between(F.col("start_date"), F.col("_end")))
    return inside.select("entity_id", "obs_date", "close", "offer_price", "start_date")


def relative_returns(metrics: DataFrame, anchors: DataFrame, index: DataFrame, horizons: Mapping[str, int] = HORIZONS) -> DataFrame:
    """Adds ``relative_*``: each return less the index move from its last close strictly before the start to the return's own date.

    ``metrics``: entity_id, start_date, return_* and date_*; ``index``: obs_date, value. Only the distinct start dates of ``anchors``
    meet the index for the base, so the lookups are bounded by the calendar however many entities there are.
    """
    starts = anchors.where(F.col("start_date").isNotNull()).select("start_date").distinct()
    base = as_of_join(starts, index.withColumnRenamed("value", "_base"), [], "start_date", "obs_date", ["_base"], strict=True)
    ends = index.select(F.col("obs_date").alias("end_date"), F.col("value").alias("_end"))
    cells = F.array(*[
        F.struct(F.lit(h).alias("horizon"), F.col(f"return_{h}").alias("ret"), F.col(f"date_{h}").alias("end_date")) for h in horizons])
    long = metrics.select("entity_id", "start_date", F.struct(*metrics.columns).alias("_row"), F.inline(cells))
    moved = long.join(base.select("start_date", "_base"), "start_date", "left").join(ends, "end_date", "left")
    excess = F.col("ret") - (F.try_divide(F.col("_end"), F.col("_base")) - 1) * 100
    joined = moved.groupBy("entity_id").agg(F.first("_row").alias("_row"), *[
        F.max(F.when(F.col("horizon") == h, excess)).alias(f"relative_{h}") for h in horizons
    ])
    return joined.select("_row.*", *[f"relative_{h}" for h in horizons])


def build_outcomes(anchors: DataFrame, prices: DataFrame, index: DataFrame, reference_date=None, announcements: DataFrame | None = None, lookahead: int = LOOKAHEAD_DAYS) -> DataFrame:
    """One outcome row per anchor. An unresolved start (NULL) keeps its row with count 0 and NULL measures.

    The price window holds at most one row per day, so counts and measures come from one numbering of it.
    ``announcements`` (entity_id, announced_on) adds the sorted distinct announcement dates, bounded by the calendar.
    """
    anchors = anchors.select("entity_id", "offer_price", "start_date")
    inside = sessions_from_start(prices, anchors.where(F.col("start_date").isNotNull()), reference_date, lookahead)
    forward = Window.partitionBy("entity_id").orderBy("obs_date")
    metrics = event_metrics(inside.withColumn("session", F.row_number().over(forward)))
    out = relative_returns(anchors.join(metrics, "entity_id", "left"), anchors, index)
    if announcements is not None:
        said = announcements.select("entity_id", "announced_on").distinct()
        dates = said.groupBy("entity_id").agg(F.array_sort(F.collect_list("announced_on")).alias("announcement_dates"))
        out = out.join(dates, "entity_id", "left")
    return out.withColumn("price_observation_count", F.coalesce("price_observation_count", F.lit(0)))
