from datetime import date, datetime

import pytest
from conftest import rows
from pyspark.sql import functions as F

from pitlake import catalog
from pitlake.operators import decision, economics, evidence, scoring

FS = "entity_id string, feature_id string, status string, value_num double"


def scores(spark, data):
    contributions = scoring.score_contributions(spark.createDataFrame([("e", *d) for d in data], FS))
    return {r["category"]: r for r in scoring.score_categories(contributions).collect()}


def test_catalog_counts():
    assert (len(catalog.DIRECT), len(catalog.DERIVED)) == (61, 5)
    every = [*catalog.DIRECT, *catalog.DERIVED]
    assert sum(f[5] for f in every) == 15 and sum(f[4] == "pre_offer" for f in every) == 52
    totals = {}
    for category, _, weight, *_ in catalog.SCORED:
        totals[category] = totals.get(category, 0) + weight
    assert set(totals.values()) == {100.0}


def test_missing_is_not_zero_and_thin_category_is_insufficient(spark):
    got = scores(spark, [("headline_discount_percentage", "AVAILABLE", 30.0), ("earnings_multiple_at_offer", "MISSING_FIELD", None), ("reported_pe_difference_percentage", "MISSING_FIELD", None)])
    assert (got["valuation"]["score"], got["valuation"]["coverage"], got["valuation"]["status"]) == (100.0, 0.4, "INSUFFICIENT")


def test_coverage_threshold_is_inclusive_and_not_applicable_leaves_the_denominator(spark):
    got = scores(spark, [("subscription_window", "AVAILABLE", None), ("distribution_method", "AVAILABLE", None), ("total_offered_shares", "AVAILABLE", None), ("capital_increase_shares", "AVAILABLE", None),
                         ("capital_increase_ratio", "MISSING_FIELD", None)])
    assert (got["offering_structure"]["coverage"], got["offering_structure"]["status"]) == (0.6, "OK")
    got = scores(spark, [("subscription_window", "AVAILABLE", None), ("capital_increase_ratio", "NOT_APPLICABLE", None), ("distribution_method", "CONFLICTED", None),
                         ("total_offered_shares", "AVAILABLE", None), ("capital_increase_shares", "AVAILABLE", None)])
    assert got["offering_structure"]["coverage"] == pytest.approx(45 / 60)


def test_all_not_applicable_has_no_score(spark):
    got = scores(spark, [(f, "NOT_APPLICABLE", None) for c, f, *_ in catalog.SCORED if c == "valuation"])
    assert (got["valuation"]["score"], got["valuation"]["coverage"], got["valuation"]["status"]) == (None, 0.0, "INSUFFICIENT")


def test_numeric_without_value_counts_as_uncovered_and_absolute_band(spark):
    got = scores(spark, [("headline_discount_percentage", "AVAILABLE", None), ("earnings_multiple_at_offer", "AVAILABLE", 5.0), ("reported_pe_difference_percentage", "DERIVABLE", -25.0)])
    assert got["valuation"]["coverage"] == 0.6
    assert got["valuation"]["score"] == pytest.approx((35 * 100 + 25 * 50) / 60)


def test_total_voided_by_a_thin_category(spark):
    schema = "entity_id string, category string, score double, coverage double, status string"
    rows_ = [("a", "fundamental_quality", 80.0, 1.0, "OK"), ("a", "valuation", 60.0, 1.0, "OK"), ("a", "offering_structure", 50.0, 1.0, "OK"),
             ("b", "fundamental_quality", 80.0, 1.0, "OK"), ("b", "valuation", 60.0, 0.5, "INSUFFICIENT"), ("b", "offering_structure", 50.0, 1.0, "OK")]
    assert rows(scoring.total_score(spark.createDataFrame(rows_, schema)), "entity_id", "total_score") == [("a", pytest.approx(68.0)), ("b", None)]


def signal(spark, total, confidence, valuation=60.0, fundamental=60.0, insufficient=False, skip=False):
    args = [F.lit(v).cast("double") for v in (total, confidence, valuation, fundamental)] + [F.lit(insufficient), F.lit(skip)]
    return spark.range(1).select(scoring.determine_signal(*args).alias("s")).first()["s"]


def test_signal_bands(spark):
    assert signal(spark, 68.0, 70.0) == "participate"
    assert signal(spark, 68.0, 70.0, valuation=54.0) == "insufficient_data"
    assert signal(spark, 68.0, 69.0) == "limited_participation"
    assert signal(spark, 67.0, 55.0) == "limited_participation"
    assert signal(spark, 67.5, 80.0) == "insufficient_data"
    assert signal(spark, 49.9, 55.0) == "skip" and signal(spark, 49.9, 54.0) == "insufficient_data"
    assert signal(spark, 90.0, 44.9) == "insufficient_data" and signal(spark, None, 90.0) == "insufficient_data"
    assert signal(spark, 90.0, 90.0, skip=True) == "skip" and signal(spark, 90.0, 90.0, insufficient=True, skip=True) == "insufficient_data"


OBS = "entity_id string, field string, source_type string, published_at timestamp_ntz, doc_id string, page_no int, method string, value_num double, value_date date"


def audit(spark):
    t = datetime(2024, 1, 1)
    obs = spark.createDataFrame([("e", "offering_price", "approved_prospectus", t, "d", 1, "digital", 10.0, None), ("e", "currency", "approved_prospectus", t, "d", 1, "ocr", None, None),
                                 ("e", "total_offered_shares", "approved_prospectus", t, "d", 1, "ocr", 5.0, None), ("e", "distribution_method", "approved_prospectus", t, "d", 1, "ocr", 1.0, None),
                                 ("e", "distribution_method", "investor_sale_announcement", t, "d", 1, "digital", 2.0, None)], OBS)
    facts = evidence.merge_evidence(obs)
    entities = spark.createDataFrame([("e", "banking"), ("f", "unknown")], "entity_id string, sector string")
    docs = spark.createDataFrame([("e", "approved_prospectus", True, "İzahname", t), ("e", "price_determination_report", False, "Rapor", t)],
                                 "entity_id string, document_type string, usable boolean, title string, published_at timestamp_ntz")
    return entities, docs, facts, scoring.audit_features(entities, docs, [scoring.fact_fields(facts)])


def test_audit_statuses(spark):
    entities, docs, facts, status = audit(spark)
    got = {(r["entity_id"], r["feature_id"]): r for r in status.collect()}
    assert len(got) == 132
    assert got["e", "offering_price"]["status"] == "AVAILABLE" and got["e", "offering_price"]["value_num"] is None
    assert (got["e", "offering_price"]["digital"], got["e", "offering_price"]["ocr"]) == (1, 1)
    assert got["e", "distribution_method"]["status"] == "CONFLICTED" and got["e", "distribution_method"]["digital"] == 0
    assert (got["e", "implied_offer_size_value"]["status"], got["e", "implied_offer_size_value"]["value_num"]) == ("DERIVABLE", 50.0)
    assert got["e", "ocr_reliance"]["status"] == "CONFLICTED"
    assert got["e", "capital_increase_ratio"]["status"] == "MISSING_FIELD" and got["e", "net_margin"]["status"] == "MISSING_DOCUMENT"
    assert got["e", "business_description"]["status"] == "MISSING_FIELD" and got["f", "offering_price"]["status"] == "MISSING_DOCUMENT"
    assert got["e", "document_completeness"]["status"] == "MISSING_DOCUMENT" and got["f", "sector_classification"]["status"] == "MISSING_DOCUMENT"
    assert got["e", "over_allotment_greenshoe_amount"]["status"] == "POST_OFFER_ONLY"
    hits = {r["rule_id"]: r["triggered"] for r in scoring.hard_rules(entities, status, facts, docs, scoring.score_categories(scoring.score_contributions(status))).where("entity_id = 'e'").collect()}
    assert hits["missing_mandatory_documents"] and hits["unresolved_critical_conflict"] and not hits["invalid_offer_share_equation"]


def test_confidence_empty_cases(spark):
    entities, docs, facts, status = audit(spark)
    got = {r["entity_id"]: r for r in scoring.confidence_components(status, facts, docs, F.lit("2024-01-31 23:00:00").cast("timestamp_ntz")).collect()}
    assert got["e"]["document_freshness"] == 100.0 and got["f"]["document_freshness"] == 0.0
    assert got["f"]["extraction_quality"] == 100.0 and got["f"]["critical_field_validation"] == 0.0
    assert got["e"]["critical_field_validation"] == 40.0
    assert got["e"]["source_agreement"] == pytest.approx(100 / 3)


def test_share_equation_tolerance(spark):
    df = spark.createDataFrame([(100.0, None, 101.0), (100.0, None, 101.1), (99900.0, 50.0, 100050.0), (1.0, 2.0, None)], "n double, s double, t double")
    assert [r[0] for r in df.select(scoring.share_equation_broken(F.col("n"), F.col("s"), F.col("t"))).collect()] == [False, True, False, False]


def test_changed_decisions_never_resend_a_reverted_hash(spark):
    sent = spark.createDataFrame([("e", "h1"), ("e", "h2")], "entity_id string, content_hash string")
    now = spark.createDataFrame([("e", "h1"), ("f", "h1")], "entity_id string, content_hash string")
    assert rows(scoring.changed_decisions(now, sent)) == [("f", "h1")]


def test_decision_hash_ignores_confidence(spark):
    d = spark.createDataFrame([("e", "skip", 40.0, 60.0)], "entity_id string, signal string, total_score double, confidence_score double")
    cats = spark.createDataFrame([("e", "valuation", 1.0, 0.61234567, "OK")], "entity_id string, category string, score double, coverage double, status string")
    hits = spark.createDataFrame([("e", "r", False)], "entity_id string, rule_id string, triggered boolean")
    first = scoring.decision_hash(d, cats, hits).first()["content_hash"]
    assert scoring.decision_hash(d.withColumn("confidence_score", F.lit(99.0)), cats, hits).first()["content_hash"] == first
    assert scoring.decision_hash(d.withColumn("signal", F.lit("participate")), cats, hits).first()["content_hash"] != first


GOOD_TERMS = {"offer_price": (10.0, None, None), "subscription_start": (None, None, date(2024, 6, 1)), "subscription_end": (None, None, date(2024, 6, 3)), "distribution_method": (None, "x", None),
              "total_offered_shares": (100.0, None, None), "retail_distribution_rule": (None, "equal", None), "retail_allocation_percentage": (25.0, None, None), "new_issue_shares": (100.0, None, None)}


def decide(spark, as_of=date(2024, 6, 1), edge="FAVORABLE", count=6, change=None, ratios=(("net_margin", 0.1), ("current_ratio", 2.0)), sufficiency="SUFFICIENT", withdrawn=False, drop=()):
    terms = {**GOOD_TERMS, **(change or {})}
    t = spark.createDataFrame([("e", n, "conflicting" if v is None else "extracted", *(v or (None, None, None))) for n, v in terms.items() if n not in drop],
                              "entity_id string, term string, status string, value_num double, value_str string, value_date date")
    derived = spark.createDataFrame([("e", n, "computed", v) for n, v in ratios], "entity_id string, name string, status string, value double")
    one = spark.createDataFrame([("e", as_of, edge, count, sufficiency, withdrawn)], "entity_id string, as_of date, status string, mature_count int, sufficiency string, withdrawn boolean")
    return decision.gated_decision(one, t, derived, one, one, one).first()


def test_gates_in_order(spark):
    assert decide(spark)["action"] == "SUBSCRIBE_WITH_HOLD_OPTION"
    assert decide(spark)["subscription_evidence_grade"] == "STRONG" and decide(spark, count=5)["subscription_evidence_grade"] == "MODERATE"
    assert decide(spark, sufficiency="INSUFFICIENT")["action"] == "SUBSCRIBE_FOR_LISTING_TRADE"
    assert decide(spark, edge="UNKNOWN")["action"] == "WATCH_SUBSCRIPTION"
    assert decide(spark, edge="UNFAVORABLE")["action"] == "PASS_AND_REASSESS_AFTER_LISTING"
    assert decide(spark, edge="UNFAVORABLE", ratios=(("net_margin", -0.1),))["action"] == "PASS_SUBSCRIPTION"
    assert decide(spark, change={"retail_allocation_percentage": (9.0, None, None)})["action"] == "WATCH_SUBSCRIPTION"
    assert decide(spark, as_of=date(2024, 6, 4))["action"] == "PASS_AND_REASSESS_AFTER_LISTING" and decide(spark, as_of=date(2024, 6, 3))["action"] == "SUBSCRIBE_WITH_HOLD_OPTION"
    assert decide(spark, withdrawn=True)["action"] == "PASS_SUBSCRIPTION"
    assert decide(spark, change={"new_issue_shares": (50.0, None, None)})["action"] == "PASS_SUBSCRIPTION"
    missing = decide(spark, change={"offer_price": None}, drop=("retail_allocation_percentage",), withdrawn=True)
    assert missing["action"] == "CANNOT_ASSESS_SUBSCRIPTION"
    assert missing["missing_critical"] == ["offer_price (conflicting)", "retail_offered_shares_or_retail_allocation_percentage"]


def test_financial_quality(spark):
    def quality(*ratios):
        return decide(spark, ratios=ratios)["financial_quality"]

    assert quality(("net_margin", 0.1)) == "MIXED" and quality(("net_margin", 0.1), ("debt_to_equity", 0.5)) == "POSITIVE"
    assert quality(("net_margin", 0.1), ("debt_to_equity", 2.0)) == "MIXED" and quality(("debt_to_equity", 3.1), ("net_margin", 0.5)) == "NEGATIVE"
    assert decide(spark, ratios=())["financial_quality"] == "UNKNOWN" and decide(spark, ratios=())["ownership_evidence_grade"] == "NONE"


def test_long_tables_are_dealt_by_entity_before_they_are_grouped(spark):
    """One map task may read every row of the long tables: it must not sort or group them."""
    terms = spark.range(30).selectExpr("cast(id % 10 as string) entity_id", "'offer_price' term", "'extracted' status", "1d value_num", "'x' value_str", "current_date() value_date")
    derived = spark.range(8).selectExpr("cast(id as string) entity_id", "'net_margin' name", "if(id < 4, 'unavailable', 'computed') status", "1d value")
    one = spark.range(10).selectExpr("cast(id as string) entity_id", "current_date() as_of", "'NEUTRAL' status", "1 mature_count", "'SUFFICIENT' sufficiency", "false withdrawn")
    out = decision.gated_decision(one, terms, derived, one, one, one)
    plan = out._jdf.queryExecution().sparkPlan().toString().split("\n")
    groupings = [i for i, line in enumerate(plan) if "Aggregate(" in line and "partial" in line]
    assert len(groupings) == 2 and all("REPARTITION_BY_NUM" in "".join(plan[i + 1:i + 3]) for i in groupings)
    assert rows(out, "entity_id", "ownership_evidence_grade", "financial_quality") == [
        (str(i), "NONE" if i > 7 else "WEAK" if i < 4 else "STRONG", "UNKNOWN" if i > 7 or i < 4 else "MIXED") for i in range(10)]


def test_audit_rows_are_plain_columns_and_may_be_restricted(spark):
    entities, docs, facts, status = audit(spark)
    assert "lambda" not in status._jdf.queryExecution().optimizedPlan().toString().split("Generate", 1)[0]
    names = ("net_margin", "offering_price", "ocr_reliance", "subscription_window")
    some = scoring.audit_features(entities, docs, [scoring.fact_fields(facts)], names)
    full = status.where(F.col("feature_id").isin(*names))
    assert some.count() == 8 and some.exceptAll(full).count() == 0
    missing = {(r["entity_id"], r["feature_id"]): r["missing"] for r in full.collect()}
    assert missing["e", "ocr_reliance"] == ["distribution_method", "subscription_window", "capital_increase_ratio"] and missing["e", "offering_price"] == []
    assert missing["f", "subscription_window"] == ["kap_extraction.subscription_start_date", "kap_extraction.subscription_end_date"]


def test_patterns_count_what_the_audit_says(spark):
    entities, docs, facts, _ = audit(spark)
    entities = entities.unionByName(spark.createDataFrame([("g", None), ("h", "insurance"), ("i", "banking")], "entity_id string, sector string"))
    more = spark.createDataFrame([("g", "price_determination_report", True), ("g", "price_determination_report", True), ("h", "price_determination_review", True), ("h", None, True),
                                  ("i", "ipo_results", None), ("x", "ipo_results", True), (None, "approved_prospectus", True)], "entity_id string, document_type string, usable boolean")
    docs = docs.select(more.columns).unionByName(more)
    derived = spark.createDataFrame([("g", "net_margin", "computed", 1.0), ("h", "net_margin", "not_applicable", None), ("h", "current_ratio", "unavailable", None), ("x", "net_margin", "computed", 1.0),
                                     (None, "net_margin", "computed", 1.0), ("i", "unheard_of", "computed", 1.0), ("i", "net_margin", "computed", 1.0), ("i", "net_margin", "not_applicable", None)],
                                    "entity_id string, name string, status string, value double")
    context = spark.createDataFrame([("g", "policy_rate", 1.0), ("h", "policy_rate", None)], "entity_id string, feature string, value double")
    records = spark.createDataFrame([("g", None, "5"), ("h", 3.0, None)], "entity_id string, ek_satis_tutari_bin_tl double, halka_arza_aracilik_eden_kurum string")
    applied = spark.createDataFrame([("g", date(2024, 1, 1)), ("h", None)], "entity_id string, application_date date")
    fin = spark.createDataFrame([("g", "revenue", "d", 1, 0), ("g", "net_income", "d", 1, 0), ("h", "revenue", "d", 1, 0)], "entity_id string, metric string, doc_id string, page_no int, place int")
    fields = [scoring.fact_fields(facts), scoring.derived_fields(derived), scoring.market_fields(context), scoring.record_fields(records), scoring.application_fields(applied),
              scoring.financial_fields(fin, entities)]
    status, patterns = scoring.audit_features(entities, docs, fields), scoring.audit_patterns(entities, docs, fields)
    told = {(r["entity_id"], r["feature_id"]): r["status"] for r in status.collect()}
    read = {(r["entity_id"], f): catalog.STATUSES[int(d)] for r in patterns.collect() for f, d in zip(scoring.AUDITED, r["pattern"], strict=True)}
    assert len(told) == 5 * 66 and read == told and set(told.values()) == set(catalog.STATUSES)
    long, wide = scoring.coverage_report(status), scoring.coverage_of_patterns(patterns)
    assert wide.dtypes == long.dtypes and rows(wide) == rows(long)
    counts = scoring.feature_counts(patterns)
    assert rows(counts) == rows(status.groupBy("feature_id", "status").count())
    assert rows(scoring.feature_coverage(counts)) == rows(scoring.feature_coverage(status)) and rows(scoring.top_gap_reasons(counts)) == rows(scoring.top_gap_reasons(status))


def test_coverage_counts_patterns_and_not_a_row_per_feature_and_entity(spark):
    from workload.scoring import coverage_report

    plan = coverage_report(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString().split("\n")
    expanded = [i for i, line in enumerate(plan) if "Expand" in line]
    assert expanded and all("Aggregate" in plan[i + 1] for i in expanded) and not any("Generate" in line and "feature_id" in line and "entity_id" in line for line in plan)


def test_sources_agree_on_equal_values_with_gaps(spark):
    t, nan = datetime(2024, 1, 1), float("nan")
    said = {"both_empty": ((None, None), (None, None)), "one_empty": ((1.0, None), (None, None)), "same": ((1.0, date(2024, 1, 1)), (1.0, date(2024, 1, 1))), "other_date": ((1.0, date(2024, 1, 1)), (1.0, date(2024, 1, 2))),
            "no_number": ((nan, None), (nan, None)), "zeros": ((0.0, None), (-0.0, None)), "alone": ((2.0, None),)}
    sources = ("approved_prospectus", "investor_sale_announcement")
    obs = spark.createDataFrame([("e", f, s, t, "d", 1, "digital", *v) for f, vs in said.items() for s, v in zip(sources, vs)], OBS)
    got = {r["field"]: r["status"] for r in evidence.merge_evidence(obs).collect()}
    assert {f for f, s in got.items() if s == "conflicting"} == {"one_empty", "other_date"} and len(got) == 7


TERMS = "entity_id string, rule_status string, retail_rule string, shares_status string, retail_shares double, price_status string, offer_price double"


def test_scenarios_and_budget_are_exact(spark):
    t = spark.createDataFrame([("e", "extracted", "equal", "extracted", 100003.0, "extracted", 0.1), ("p", "extracted", "proportional", "extracted", 100.0, "extracted", 1.0)], TERMS)
    grid = economics.scenario_grid(t, (0, 50000))
    got = {(r["entity_id"], r["participants"]): r for r in grid.collect()}
    assert (got["e", 50000]["base_allocation"], got["e", 50000]["remainder"], got["e", 50000]["max_allocation"]) == (2, 3, 3)
    assert got["e", 0]["status"] == "unavailable" and got["p", 50000]["status"] == "unavailable"
    capped = economics.capped_allocation(economics.scenario_grid(t.withColumn("retail_shares", F.lit(1e6)), (50000,)), 1.0).where("entity_id = 'e'").first()
    assert (capped["executable_shares"], capped["capital_constrained"]) == (10, True)
    out = rows(economics.stress_outcomes(economics.capped_allocation(grid.where("participants > 0"), None)), "scenario", "profit_loss")
    assert out == [("optimistic", pytest.approx(0.04)), ("stress", pytest.approx(-0.04))]
