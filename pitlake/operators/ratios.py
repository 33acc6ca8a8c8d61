"""Financial ratios from long metric observations.

Pairs with identical period, scope, currency, scale and inflation flag come from one grouping on exactly those columns, where
NULL groups with NULL; no self-join, so no pairs are made. ``fin``: entity_id, metric, value, currency, scale,
period_start, period_end, period_type, consolidation_scope, inflation_adjusted, document_type, doc_id, page_no, place.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pitlake import fixed_values as fixed
from pitlake.operators.records import not_applicable
from pitlake.tables import columns

SAME = ("period_start", "period_end", "consolidation_scope", "currency", "scale", "inflation_adjusted")
ORDER = ("doc_id", "page_no", "place")

# Ratio -> (first metric, second metric, rule). The reason texts tell a missing pair from a meaningless one.
RATIOS = {
    "net_margin": ("revenue", "net_income", "second / first, first nonzero"),
    "net_debt": ("financial_debt", "cash_and_equivalents", "first - second"),
    "debt_to_equity": ("financial_debt", "equity", "first / second, second positive"),
    "current_ratio": ("current_assets", "current_liabilities", "first / second, second positive"),
    "operating_cash_flow_to_net_income": ("operating_cash_flow", "net_income", "first / second, second positive"),
    "interest_coverage": ("operating_profit", "finance_expense", "first / second, second positive"),
}
NO_PAIR = "no pair sharing period, scope, currency, scale and inflation status"
NOT_MEANINGFUL = "denominator is zero or negative"
DERIVED_NAMES = ("revenue_growth_yoy", "net_margin", "recalculated_pe", "reported_pe_difference_percentage", "net_debt", "debt_to_equity",
                 "current_ratio", "operating_cash_flow_to_net_income", "interest_coverage")
CAP_CURRENCY, CAP_SCALE = "USD", "million"
SCALES = {"unit": 1.0, "thousand": 1_000.0, "million": 1_000_000.0}
SAFE_FINANCIAL_SOURCES = ("price_determination_report",)
MULTIPLES = {"pe_at_offer": "net_income", "ps_at_offer": "revenue", "pb_at_offer": "equity"}


def observation_id(metric: Column | str) -> Column:
    day = [F.coalesce(F.date_format(c, "yyyy-MM-dd"), F.lit("-")) for c in ("period_start", "period_end")]
    return F.concat_ws(":", "document_type", "doc_id", F.concat(F.lit("p"), F.col("page_no")), metric, *day)


def _place(fin: DataFrame, order: Sequence[str]) -> Column:
    return F.struct(*columns([c for c in order if c in fin.columns]))


def compatible_pairs(fin: DataFrame, pairs: Sequence[tuple[str, str, str]], order: Sequence[str] = ORDER) -> DataFrame:
    """For each (name, first metric, second metric): the latest period where both agree on every attribute.

    Of several observations with the same attributes the first by ``order`` counts, and of several attribute sets with the same
    period end the one whose first metric comes first.
    """
    metrics = sorted({m for _, a, b in pairs for m in (a, b)})
    seen = F.struct(_place(fin, order).alias("at"), "value", observation_id("metric").alias("id"))
    wide = fin.where(F.col("metric").isin(*metrics)).groupBy("entity_id", *columns(SAME)).agg(
        *[F.min(F.when(F.col("metric") == m, seen)).alias(m) for m in metrics])
    cells = [F.struct(F.lit(name).alias("name"), F.col(a).alias("first"), F.col(b).alias("second")) for name, a, b in pairs]
    long = wide.select("entity_id", "period_end", F.inline(F.array(*cells))).where(F.col("first").isNotNull() & F.col("second").isNotNull())
    latest = F.struct((-F.unix_date("period_end")).alias("late"), F.col("first.at").alias("at"), F.col("second.at").alias("at2"))
    best = long.groupBy("entity_id", "name").agg(F.min_by(F.struct("period_end", "first", "second"), latest).alias("_p"))
    return best.select("entity_id", "name", "_p.period_end", F.col("_p.first.value").alias("first_value"), F.col("_p.second.value").alias("second_value"),
                       F.array("_p.first.id", "_p.second.id").alias("input_ids"))


def _all_names(entities: DataFrame, names: Sequence[str]) -> DataFrame:
    return entities.select("entity_id", F.explode(F.array(*[F.lit(n) for n in names])).alias("name"))


def pair_ratios(entities: DataFrame, fin: DataFrame, order: Sequence[str] = ORDER) -> DataFrame:
    """The six pair ratios for every entity: status, value, reason, input_ids."""
    found = compatible_pairs(fin, [(name, a, b) for name, (a, b, _) in RATIOS.items()], order)
    first, second = F.col("first_value"), F.col("second_value")
    value = (
        F.when(F.col("name") == "net_margin", F.try_divide(second, first)).when(F.col("name") == "net_debt", first - second)
        .when(second > 0, first / second))
    full = _all_names(entities, list(RATIOS)).join(found, ["entity_id", "name"], "left")
    return full.select(
        "entity_id", "name", F.when(value.isNotNull(), "computed").otherwise("unavailable").alias("status"), value.alias("value"),
        F.when(first.isNull(), NO_PAIR).when(value.isNull(), NOT_MEANINGFUL).alias("reason"), "input_ids")


def growth_yoy(entities: DataFrame, fin: DataFrame, order: Sequence[str] = ORDER) -> DataFrame:
    """Latest annual revenue against the fiscal year before it, with the same attributes."""
    annual = fin.where((F.col("metric") == "revenue") & (F.col("period_type") == "ANNUAL"))
    place = _place(fin, order)
    per_year = annual.groupBy("entity_id", *columns(SAME[2:]), F.year("period_end").alias("_year")).agg(
        F.min_by(F.struct("value", observation_id("metric").alias("id")), place).alias("_first"), F.min(place).alias("_at"),
        F.max("period_end").alias("_end"), F.min_by(F.struct("value", observation_id("metric").alias("id")), F.struct(
            (-F.unix_date("period_end")).alias("d"), place.alias("p"))).alias("_latest"),
        F.min(F.struct((-F.unix_date("period_end")).alias("d"), place.alias("p"))).alias("_key"))
    current = per_year.groupBy("entity_id").agg(F.min_by(F.struct("_latest", "_year", *columns(SAME[2:])), "_key").alias("_c"))
    prior = per_year.select(*[F.col(c).alias(f"_p_{c}") for c in ("entity_id", *SAME[2:])], F.col("_year").alias("_p_year"), F.col("_first").alias("_prev"))
    same = (F.col("entity_id") == F.col("_p_entity_id")) & (F.col("_c._year") - 1 == F.col("_p_year"))
    for c in SAME[2:]:
        same = same & F.col(f"_c.{c}").eqNullSafe(F.col(f"_p_{c}"))
    joined = entities.select("entity_id").join(current, "entity_id", "left").join(prior, same, "left")
    now, before = F.col("_c._latest.value"), F.col("_prev.value")
    value = F.try_divide(now - before, before)
    return joined.select(
        "entity_id", F.lit("revenue_growth_yoy").alias("name"), F.when(value.isNotNull(), "computed").otherwise("unavailable").alias("status"),
        value.alias("value"),
        F.when(now.isNull(), "no annual revenue").when(before.isNull(), "no comparable annual revenue for the prior year")
        .when(value.isNull(), "prior-year revenue is zero").alias("reason"),
        F.filter(F.array("_c._latest.id", "_prev.id"), lambda i: i.isNotNull()).alias("input_ids"))


def _latest_annual(fin: DataFrame, condition: Column, order: Sequence[str]) -> DataFrame:
    rows = fin.where((F.col("period_type") == "ANNUAL") & condition)
    latest = F.struct((-F.unix_date("period_end")).alias("d"), _place(fin, order).alias("p"))
    return rows.groupBy("entity_id", "metric").agg(
        F.min_by(F.struct("value", "scale", "period_end", observation_id("metric").alias("id")), latest).alias("_o"))


def recalculated_multiples(entities: DataFrame, facts: DataFrame, fin: DataFrame, order: Sequence[str] = ORDER) -> DataFrame:
    """Market cap over the latest annual net income stated in the cap's own units, and its gap to the reported multiple in percent."""
    said = facts.groupBy("entity_id").agg(*[
        F.max(F.when(F.col("field") == f, F.struct("status", "value_num"))).alias(f) for f in ("reported_post_money_market_cap", "reported_pe")])
    is_income = F.col("metric") == "net_income"
    income = _latest_annual(fin, is_income & (F.col("currency") == CAP_CURRENCY) & (F.col("scale") == CAP_SCALE), order).drop("metric")
    any_income = fin.where(is_income & (F.col("period_type") == "ANNUAL")).select("entity_id").distinct().withColumn("_any", F.lit(True))
    row = entities.select("entity_id").join(said, "entity_id", "left").join(income, "entity_id", "left").join(any_income, "entity_id", "left")
    cap_status = F.coalesce("reported_post_money_market_cap.status", F.lit("not_found"))
    pe_status = F.coalesce("reported_pe.status", F.lit("not_found"))
    earned = F.col("_o.value")
    pe = F.when((cap_status == "extracted") & (earned > 0), F.col("reported_post_money_market_cap.value_num") / earned)
    why = (
        F.when(cap_status != "extracted", F.concat(F.lit("reported_post_money_market_cap is "), cap_status))
        .when(F.col("_any").isNull(), "no annual net income").when(earned.isNull(), "no annual net income in the market cap's units")
        .when(pe.isNull(), "net income is zero or negative"))
    reported = F.col("reported_pe.value_num")
    gap = F.when(pe_status == "extracted", F.try_divide(pe - reported, reported) * 100)
    gap_why = (
        F.when(pe.isNull(), F.concat(F.lit("recalculated_pe is unavailable: "), why))
        .when(pe_status != "extracted", F.concat(F.lit("reported_pe is "), pe_status)).when(gap.isNull(), "reported_pe is zero"))

    def cell(name, value, reason):
        return F.struct(F.lit(name).alias("name"), F.when(value.isNotNull(), "computed").otherwise("unavailable").alias("status"),
                        value.alias("value"), F.when(value.isNull(), reason).alias("reason"),
                        F.filter(F.array("_o.id"), lambda i: i.isNotNull()).alias("input_ids"))

    return row.select("entity_id", F.inline(F.array(cell("recalculated_pe", pe, why), cell("reported_pe_difference_percentage", gap, gap_why))))


def not_applicable_override(derived: DataFrame, sectors: DataFrame, matrix=fixed.SECTOR_SKIPS_RATIO) -> DataFrame:
    """A sector where the ratio means nothing overrides whatever was computed. ``sectors``: entity_id, sector."""
    joined = derived.join(sectors.select("entity_id", "sector"), "entity_id", "left")
    skip = not_applicable(F.col("sector"), F.col("name"), matrix)
    return joined.select(
        "entity_id", "name", F.when(skip, "not_applicable").otherwise(F.col("status")).alias("status"),
        F.when(~skip, F.col("value")).alias("value"),
        F.when(skip, F.concat(F.lit("not a meaningful concept for sector "), "sector")).otherwise(F.col("reason")).alias("reason"),
        F.when(skip, F.array().cast("array<string>")).otherwise(F.col("input_ids")).alias("input_ids"))


def derived_financials(entities: DataFrame, fin: DataFrame, facts: DataFrame, sectors: DataFrame, order: Sequence[str] = ORDER) -> DataFrame:
    """All nine derived features per entity, after the sector override."""
    every = pair_ratios(entities, fin, order).unionByName(growth_yoy(entities, fin, order)).unionByName(
        recalculated_multiples(entities, facts, fin, order))
    return not_applicable_override(every, sectors)


def multiples_at_offer(terms: DataFrame, fin: DataFrame, sectors: DataFrame, order: Sequence[str] = ORDER) -> DataFrame:
    """Implied market cap and its P/E, P/S and P/B to the latest annual TRY figures, one row per entity.

    ``terms`` are effective offering terms (long). Only pre-offer-safe documents count for the figures. EV/EBITDA stays
    unavailable. ``sufficiency`` needs the cap and at least one multiple.
    """
    cap = terms.where(F.col("term") == "implied_post_money_market_cap").select("entity_id", F.col("status").alias("_cap_status"), F.col("value_num").alias("_cap"))
    safe = F.col("document_type").isin(*SAFE_FINANCIAL_SOURCES) & (F.col("currency") == "TRY") & F.col("metric").isin(*MULTIPLES.values())
    latest = _latest_annual(fin, safe, order)
    wide = latest.groupBy("entity_id").agg(*[F.max(F.when(F.col("metric") == m, F.struct("_o.value", "_o.scale", "_o.period_end"))).alias(f"_{m}") for m in MULTIPLES.values()])
    row = cap.join(wide, "entity_id", "left").join(sectors.select("entity_id", "sector"), "entity_id", "left")
    scale = F.create_map(*[F.lit(x) for pair in SCALES.items() for x in pair])
    has_cap = F.col("_cap_status") == "extracted"
    out = [F.when(has_cap, F.col("_cap")).alias("implied_market_cap")]
    computed = F.lit(0)
    for name, metric in MULTIPLES.items():
        figure = F.col(f"_{metric}.value") * F.try_element_at(scale, F.col(f"_{metric}.scale"))
        value = F.when(has_cap & (figure > 0), F.col("_cap") / figure)
        skip = not_applicable(F.col("sector"), F.lit(name), fixed.SECTOR_SKIPS_MULTIPLE)
        out += [F.when(~skip, value).alias(name), F.when(skip, "not_applicable").when(value.isNull(), "unavailable").otherwise("computed").alias(f"{name}_status")]
        computed = computed + F.when(~skip & value.isNotNull(), 1).otherwise(0)
    return row.select("entity_id", *out, F.lit(None).cast("double").alias("ev_ebitda_at_offer"), F.lit("unavailable").alias("ev_ebitda_at_offer_status"),
                      F.when(has_cap & (computed > 0), "SUFFICIENT").otherwise("INSUFFICIENT").alias("sufficiency"))
