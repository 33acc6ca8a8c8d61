"""Gated, non-compensatory subscription decision: one row-local rule chain per entity after the inputs are one row each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pitlake.operators import cohort
from pitlake.operators.scoring import share_equation_broken

# Gates and thresholds.
CRITICAL = ("offer_price", "subscription_start", "subscription_end", "distribution_method", "total_offered_shares", "retail_distribution_rule")
RETAIL_EVIDENCE = ("retail_offered_shares", "retail_allocation_percentage")
THIN_PCT, SUBSTANTIAL_PCT = 10.0, 20.0
DEBT_RED, CURRENT_RED, COVER_RED = 3.0, 1.0, 1.0
DEBT_GOOD, CURRENT_GOOD, COVER_GOOD = 1.0, 1.5, 3.0
MIN_GOOD_RATIOS = 2
HORIZONS = {
    "SUBSCRIBE_FOR_LISTING_TRADE": "5D_LISTING_TRADE", "SUBSCRIBE_WITH_HOLD_OPTION": "5D_LISTING_TRADE_OR_HOLD", "WATCH_SUBSCRIPTION": "watch_pending_edge",
    "PASS_SUBSCRIPTION": "not_applicable", "PASS_AND_REASSESS_AFTER_LISTING": "watch_post_listing", "CANNOT_ASSESS_SUBSCRIPTION": "not_applicable",
}
RATIOS = ("net_margin", "debt_to_equity", "current_ratio", "interest_coverage", "revenue_growth_yoy")


# Parts the long tables are dealt to, if the session does not ask for more. A stated number keeps adaptive execution from joining parts to large tasks.
PARTS = 200


def _dealt(rows: DataFrame) -> DataFrame:
    """Rows by entity. Nearly every row has its own (entity, name), so nothing could be combined before the shuffle, and a map task would sort all it reads."""
    return rows.repartition(max(PARTS, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))), "entity_id")


def _wide_terms(terms: DataFrame) -> DataFrame:
    names = sorted({*CRITICAL, *RETAIL_EVIDENCE, "new_issue_shares", "secondary_sale_shares"})
    cell = F.struct("status", "value_num", "value_str", "value_date")
    needed = _dealt(terms.where(F.col("term").isin(*names)))
    return needed.groupBy("entity_id").agg(*[F.max(F.when(F.col("term") == n, cell)).alias(n) for n in names])


def _wide_ratios(derived: DataFrame) -> DataFrame:
    return _dealt(derived).groupBy("entity_id").agg(F.first(F.lit(True)).alias("_has_ratios"), *[
        F.max(F.when((F.col("name") == n) & (F.col("status") == "computed"), F.col("value"))).alias(n) for n in RATIOS])


def financial_quality(net_margin: Column, debt: Column, current: Column, cover: Column, growth: Column) -> Column:
    """NEGATIVE on any risk, POSITIVE when at least two ratios are known and all are healthy, MIXED otherwise, UNKNOWN for none."""
    risky = [net_margin < 0, debt > DEBT_RED, current < CURRENT_RED, cover < COVER_RED]
    any_risk = F.exists(F.array(*[F.coalesce(r, F.lit(False)) for r in risky]), lambda r: r)
    healthy = F.filter(F.array(growth > 0, net_margin > 0, current >= CURRENT_GOOD, debt <= DEBT_GOOD, cover >= COVER_GOOD), lambda h: h.isNotNull())
    return (
        F.when(any_risk, "NEGATIVE").when(F.size(healthy) == 0, "UNKNOWN")
        .when((F.size(healthy) >= MIN_GOOD_RATIOS) & F.forall(healthy, lambda h: h), "POSITIVE").otherwise("MIXED"))


def gated_decision(entities: DataFrame, terms: DataFrame, derived: DataFrame, regimes: DataFrame, valuation: DataFrame, withdrawn: DataFrame) -> DataFrame:
    """First matching gate decides: missing evidence, red flag, closed window, bad edge, thin allocation, good edge, else watch.

    ``entities``: entity_id, as_of (DATE); ``terms``: effective terms, long; ``derived``: ratios, long; ``regimes``: entity_id, status,
    mature_count; ``valuation``: entity_id, sufficiency; ``withdrawn``: entity_id, withdrawn.
    """
    edge_in = regimes.select("entity_id", F.col("status").alias("_edge"), "mature_count")
    row = entities.select("entity_id", "as_of").join(_wide_terms(terms), "entity_id", "left")
    row = row.join(_wide_ratios(derived), "entity_id", "left").join(edge_in, "entity_id", "left")
    row = row.join(valuation.select("entity_id", "sufficiency"), "entity_id", "left").join(withdrawn.select("entity_id", "withdrawn"), "entity_id", "left")

    def status(name: str) -> Column:
        return F.coalesce(F.col(f"{name}.status"), F.lit("not_found"))

    def gap(name: str) -> Column:
        return F.when(status(name) == "not_found", F.lit(name)).when(status(name) == "conflicting", F.lit(f"{name} (conflicting)"))

    label = "_or_".join(RETAIL_EVIDENCE)
    retail = [status(n) for n in RETAIL_EVIDENCE]
    retail_gap = F.when(~((retail[0] == "extracted") | (retail[1] == "extracted")), F.when(
        (retail[0] == "conflicting") | (retail[1] == "conflicting"), F.lit(f"{label} (conflicting)")).otherwise(F.lit(label)))
    missing = F.filter(F.array(*[gap(n) for n in CRITICAL], retail_gap), lambda m: m.isNotNull())

    def number(name: str) -> Column:
        return F.when(status(name) == "extracted", F.col(f"{name}.value_num"))

    broken = share_equation_broken(number("new_issue_shares"), number("secondary_sale_shares"), number("total_offered_shares"))
    red_flag = broken | F.coalesce("withdrawn", F.lit(False))
    closed = F.coalesce(F.when(status("subscription_end") == "extracted", F.col("subscription_end.value_date") < F.col("as_of")), F.lit(False))
    pct, rule = number("retail_allocation_percentage"), F.col("retail_distribution_rule.value_str")
    mechanics = (
        F.when(status("retail_distribution_rule") != "extracted", "UNKNOWN").when(pct < THIN_PCT, "CONSTRAINED")
        .when((rule == "equal") & (pct >= SUBSTANTIAL_PCT), "SUPPORTIVE").otherwise("NEUTRAL"))
    quality = F.when(F.col("_has_ratios").isNull(), "UNKNOWN").otherwise(financial_quality(*[F.col(n) for n in RATIOS]))
    anchored = F.coalesce(F.col("sufficiency") == "SUFFICIENT", F.lit(False))
    base = row.select(
        "entity_id", missing.alias("missing_critical"), red_flag.alias("red_flag"), closed.alias("window_closed"), mechanics.alias("mechanics_state"),
        quality.alias("financial_quality"), anchored.alias("valuation_anchor"), F.coalesce("_edge", F.lit("UNKNOWN")).alias("subscription_edge"),
        F.coalesce("mature_count", F.lit(0)).alias("mature_count"), F.col("_has_ratios").isNotNull().alias("_has_ratios"))
    q = F.col("financial_quality")
    view = F.when(q == "NEGATIVE", "AVOID_LONG_TERM").when(q == "UNKNOWN", "NOT_ASSESSABLE").when(q == "MIXED", "WATCH").when(
        F.col("valuation_anchor"), "HOLD_CANDIDATE").otherwise("WATCH")
    out = base.withColumn("ownership_view", view)
    pass_or_reassess = F.when(F.col("ownership_view").isin("HOLD_CANDIDATE", "WATCH"), "PASS_AND_REASSESS_AFTER_LISTING").otherwise("PASS_SUBSCRIPTION")
    edge = F.col("subscription_edge")
    action = (
        F.when(F.size("missing_critical") > 0, "CANNOT_ASSESS_SUBSCRIPTION").when(F.col("red_flag"), "PASS_SUBSCRIPTION")
        .when(F.col("window_closed") | (edge == "UNFAVORABLE"), pass_or_reassess).when(F.col("mechanics_state") == "CONSTRAINED", "WATCH_SUBSCRIPTION")
        .when((edge == "FAVORABLE") & (F.col("ownership_view") == "HOLD_CANDIDATE"), "SUBSCRIBE_WITH_HOLD_OPTION")
        .when(edge == "FAVORABLE", "SUBSCRIBE_FOR_LISTING_TRADE").otherwise("WATCH_SUBSCRIPTION"))
    horizon = F.element_at(F.create_map(*[F.lit(x) for pair in HORIZONS.items() for x in pair]), F.col("action"))
    grade = F.when(F.size("missing_critical") > 0, "NONE").when(edge == "UNKNOWN", "WEAK").when(
        F.col("mature_count") < cohort.STRONG_COHORT, "MODERATE").otherwise("STRONG")
    ownership = F.when(~F.col("_has_ratios"), "NONE").when(q == "UNKNOWN", "WEAK").when(F.col("valuation_anchor"), "STRONG").otherwise("MODERATE")
    return out.withColumn("action", action).withColumn("intended_horizon", horizon).withColumn("subscription_evidence_grade", grade).withColumn(
        "ownership_evidence_grade", ownership).drop("_has_ratios")
