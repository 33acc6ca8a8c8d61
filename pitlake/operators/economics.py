"""Allocation scenarios, what a limited budget can take, and illustrative stress moves. Money and shares are DECIMAL."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Participant counts, their labels, and the two illustrative moves.
PARTICIPANTS = (50_000, 200_000, 500_000)
DEMAND_LABELS = ("low", "typical", "high")
STRESS = (("stress", -0.20), ("optimistic", 0.20))
SHARES, MONEY = "decimal(28,2)", "decimal(38,6)"


def scenario_grid(terms: DataFrame, counts: Sequence[int] = PARTICIPANTS) -> DataFrame:
    """Each entity's equal split over hypothetical participant counts.

    ``terms``: entity_id, rule_status, retail_rule, shares_status, retail_shares, price_status, offer_price. Computed only for an
    extracted rule 'equal' with known shares; floor and remainder are exact.
    """
    cells = F.array(*[F.lit(int(c)) for c in counts])
    grid = terms.select("*", F.explode(cells).alias("participants"))
    can = (F.col("participants") > 0) & (F.col("rule_status") == "extracted") & (F.col("retail_rule") == "equal") & (F.col("shares_status") == "extracted")
    shares = F.when(can, F.col("retail_shares").cast(SHARES))
    base = F.floor(F.try_divide(shares, F.col("participants").cast(SHARES)))
    row = grid.withColumn("base_allocation", base.cast("bigint"))
    row = row.withColumn("remainder", F.bround(shares - F.col("base_allocation") * F.col("participants"), 0).cast("bigint"))
    top = F.when(F.col("remainder") == 0, F.col("base_allocation")).otherwise(F.col("base_allocation") + 1)
    price = F.when(F.col("price_status") == "extracted", F.col("offer_price").cast(MONEY))
    return row.select(
        "entity_id", "participants", F.when(F.coalesce(can, F.lit(False)), "computed").otherwise("unavailable").alias("status"),
        F.when(can, F.col("retail_shares") / F.col("participants")).alias("average_shares"), "base_allocation", "remainder", top.alias("max_allocation"),
        (F.col("base_allocation") * price).cast("double").alias("capital"), (top * price).cast("double").alias("max_capital"), price.cast("double").alias("offer_price"))


def capped_allocation(grid: DataFrame, limit: float | None) -> DataFrame:
    """Whole units a capital limit can pay for; without a limit nothing is executable."""
    known = (F.col("status") == "computed") & F.col("base_allocation").isNotNull() & (F.col("offer_price") > 0)
    affordable = F.greatest(F.floor(F.lit(limit).cast(MONEY) / F.col("offer_price").cast(MONEY)).cast("bigint"), F.lit(0).cast("bigint"))
    shares = F.when(known & F.lit(limit is not None), F.least("base_allocation", affordable))
    return grid.withColumn("executable_shares", shares).withColumn(
        "executable_capital", (F.col("executable_shares") * F.col("offer_price").cast(MONEY)).cast("double")).withColumn(
        "capital_constrained", F.col("executable_shares") < F.col("base_allocation"))


def stress_outcomes(capped: DataFrame) -> DataFrame:
    """Profit or loss of the executable (else theoretical) capital under each illustrative move."""
    cells = F.array(*[F.struct(F.lit(n).alias("scenario"), F.lit(p).alias("return_pct")) for n, p in STRESS])
    basis = F.coalesce("executable_capital", "capital")
    return capped.select("*", F.inline(cells)).where(basis.isNotNull()).withColumn("profit_loss", basis * F.col("return_pct"))
