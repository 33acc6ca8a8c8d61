"""The feature catalog and the scoring configuration."""

from __future__ import annotations

PRO = ("approved_prospectus", "investor_sale_announcement")
REPORT, RECORD, MARKET, FEED, RESULTS = ("price_determination_report",), ("spk_completed_ipo_record",), ("evds_market_data_feed",), ("external_market_data_feed",), ("ipo_results",)

# Direct features: id, category, fields read, acceptable sources, timing, mandatory.
DIRECT = (
    ("business_description", "fundamental_quality", ("kap_extraction.business_description",), PRO, "pre_offer", True),
    ("key_risk_factors", "fundamental_quality", ("kap_extraction.key_risk_items",), PRO, "pre_offer", True),
    ("use_of_proceeds_plan", "fundamental_quality", ("kap_extraction.use_of_proceeds",), PRO, "pre_offer", True),
    ("financial_statement_summary", "fundamental_quality", ("financial_series.revenue", "financial_series.net_income"), REPORT, "pre_offer", True),
    ("revenue_growth_yoy", "fundamental_quality", ("derived_financial.revenue_growth_yoy",), REPORT, "pre_offer", False),
    ("net_margin", "fundamental_quality", ("derived_financial.net_margin",), REPORT, "pre_offer", False),
    ("debt_to_equity", "fundamental_quality", ("derived_financial.debt_to_equity",), REPORT, "pre_offer", False),
    ("current_ratio", "fundamental_quality", ("derived_financial.current_ratio",), REPORT, "pre_offer", False),
    ("operating_cash_flow_to_net_income", "fundamental_quality", ("derived_financial.operating_cash_flow_to_net_income",), REPORT, "pre_offer", False),
    ("interest_coverage", "fundamental_quality", ("derived_financial.interest_coverage",), REPORT, "pre_offer", False),
    ("related_party_transactions_disclosure", "fundamental_quality", ("kap_extraction.related_party_transactions",), PRO, "pre_offer", False),
    ("litigation_exposure_disclosure", "fundamental_quality", ("kap_extraction.litigation_status",), PRO, "pre_offer", False),
    ("offering_price", "valuation", ("kap_extraction.offering_price", "kap_extraction.currency"), PRO, "pre_offer", True),
    ("capital_increase_ratio", "valuation", ("kap_extraction.capital_increase_ratio",), PRO, "pre_offer", True),
    ("secondary_sale_ratio", "valuation", ("kap_extraction.secondary_sale_ratio",), PRO, "pre_offer", False),
    ("post_offer_market_value_of_offering", "valuation", ("spk_ipo_record.satisa_sunulan_toplam_tutar_piyasa_degeri_bin_tl",), RECORD, "post_offer", False),
    ("earnings_multiple_at_offer", "valuation", ("kap_extraction.reported_pe",), REPORT, "pre_offer", False),
    ("reported_post_money_market_cap", "valuation", ("kap_extraction.reported_post_money_market_cap",), REPORT, "pre_offer", False),
    ("reported_enterprise_value", "valuation", ("kap_extraction.reported_enterprise_value",), REPORT, "pre_offer", False),
    ("reported_net_debt", "valuation", ("kap_extraction.reported_net_debt",), REPORT, "pre_offer", False),
    ("net_debt", "valuation", ("derived_financial.net_debt",), REPORT, "pre_offer", False),
    ("reported_ev_ebitda_multiple", "valuation", ("kap_extraction.reported_ev_ebitda",), REPORT, "pre_offer", False),
    ("reported_ps_multiple", "valuation", ("kap_extraction.reported_ps",), REPORT, "pre_offer", False),
    ("reported_pb_multiple", "valuation", ("kap_extraction.reported_pb",), REPORT, "pre_offer", False),
    ("headline_discount_percentage", "valuation", ("kap_extraction.headline_discount_percentage",), REPORT, "pre_offer", False),
    ("recalculated_pe", "valuation", ("derived_financial.recalculated_pe",), REPORT, "pre_offer", False),
    ("reported_pe_difference_percentage", "valuation", ("derived_financial.reported_pe_difference_percentage",), REPORT, "pre_offer", False),
    ("subscription_window", "offering_structure", ("kap_extraction.subscription_start_date", "kap_extraction.subscription_end_date"), PRO, "pre_offer", True),
    ("distribution_method", "offering_structure", ("kap_extraction.distribution_method",), PRO, "pre_offer", True),
    ("total_offered_shares", "offering_structure", ("kap_extraction.total_offered_shares",), PRO, "pre_offer", True),
    ("capital_increase_shares", "offering_structure", ("kap_extraction.capital_increase_shares",), PRO, "pre_offer", True),
    ("secondary_sale_shares", "offering_structure", ("kap_extraction.secondary_sale_shares",), PRO, "pre_offer", False),
    ("over_allotment_greenshoe_amount", "offering_structure", ("spk_ipo_record.ek_satis_tutari_bin_tl",), RECORD, "post_offer", False),
    ("lead_intermediary_institution", "offering_structure", ("spk_ipo_record.halka_arza_aracilik_eden_kurum",), RECORD, "post_offer", False),
    ("listing_market_segment", "offering_structure", ("spk_ipo_record.ilk_islem_gordugu_pazar",), RECORD, "post_offer", False),
    ("sector_classification", "market_context", ("kap_sector.classification",), PRO + RECORD, "pre_offer", True),
    ("peer_group_comparables", "market_context", ("market_data.peer_comparables",), FEED, "pre_offer", False),
    ("broader_index_level_at_offer", "market_context", ("market_data.bist_index_level",), MARKET, "pre_offer", False),
    ("recent_comparable_ipo_performance", "market_context", ("market_data.recent_ipo_performance",), FEED, "pre_offer", False),
    ("application_pipeline_status", "market_context", ("spk_application.application_date",), ("spk_application_record",), "pre_offer", False),
    ("bist100_return_20d", "market_context", ("market_data.bist100_return_20d",), MARKET, "pre_offer", False),
    ("bist100_return_60d", "market_context", ("market_data.bist100_return_60d",), MARKET, "pre_offer", False),
    ("bist100_return_120d", "market_context", ("market_data.bist100_return_120d",), MARKET, "pre_offer", False),
    ("bist100_volatility_20d", "market_context", ("market_data.bist100_volatility_20d",), MARKET, "pre_offer", False),
    ("bist100_max_drawdown_60d", "market_context", ("market_data.bist100_max_drawdown_60d",), MARKET, "pre_offer", False),
    ("policy_rate", "market_context", ("market_data.policy_rate",), MARKET, "pre_offer", False),
    ("tlref_rate", "market_context", ("market_data.tlref_rate",), MARKET, "pre_offer", False),
    ("cpi_yoy", "market_context", ("market_data.cpi_yoy",), MARKET, "pre_offer", False),
    ("policy_rate_minus_cpi", "market_context", ("market_data.policy_rate_minus_cpi",), MARKET, "pre_offer", False),
    ("oversubscription_ratio_overall", "allocation_efficiency", ("kap_extraction.total_demand_multiple",), RESULTS, "post_offer", True),
    ("retail_allocated_shares", "allocation_efficiency", ("kap_extraction.retail_allocated_shares",), RESULTS, "post_offer", False),
    ("institutional_allocated_shares", "allocation_efficiency", ("kap_extraction.institutional_allocated_shares",), RESULTS, "post_offer", False),
    ("allocation_by_investor_category", "allocation_efficiency", ("kap_extraction.allocation_by_investor_category",), RESULTS, "post_offer", False),
    ("demand_to_supply_ratio_by_tranche", "allocation_efficiency", ("kap_extraction.demand_to_supply_ratio_by_tranche",), RESULTS, "post_offer", False),
    ("total_participant_count", "demand_sentiment", ("kap_extraction.total_participant_count",), RESULTS, "post_offer", False),
    ("retail_participant_count", "demand_sentiment", ("kap_extraction.retail_participant_count",), RESULTS, "post_offer", False),
    ("retail_investor_demand_signal", "demand_sentiment", ("kap_extraction.retail_demand_multiple",), RESULTS, "post_offer", False),
    ("institutional_investor_demand_signal", "demand_sentiment", ("kap_extraction.institutional_demand_multiple",), RESULTS, "post_offer", False),
    ("analyst_or_broker_commentary_presence", "demand_sentiment", ("kap_document.price_determination_review",), ("price_determination_review",), "pre_offer", False),
    ("post_ipo_price_performance_signal", "demand_sentiment", ("market_data.first_day_trading_performance",), FEED, "post_offer", False),
    ("document_completeness", "data_confidence", ("kap_document.approved_prospectus", "kap_document.investor_sale_announcement"), PRO, "pre_offer", True),
)
CORE = ("offering_price", "distribution_method", "subscription_window", "total_offered_shares", "capital_increase_ratio")
# Derived features: id, category, features they depend on, acceptable sources, timing, mandatory.
DERIVED = (
    ("implied_offer_size_value", "valuation", ("offering_price", "total_offered_shares"), PRO, "pre_offer", True),
    ("final_allocation_price", "allocation_efficiency", ("offering_price",), PRO, "pre_offer", True),
    ("cross_document_field_corroboration", "data_confidence", CORE, PRO, "pre_offer", False),
    ("ocr_reliance", "data_confidence", CORE, PRO, "pre_offer", False),
    ("single_source_field_flag", "data_confidence", CORE, PRO, "pre_offer", False),
)
# Worst first; a feature takes the worst status of what it reads.
STATUSES = ("CONFLICTED", "MISSING_DOCUMENT", "MISSING_FIELD", "POST_OFFER_ONLY", "NOT_APPLICABLE", "DERIVABLE", "AVAILABLE")
NULL_MEANS_NOT_APPLICABLE = ("spk_ipo_record.ek_satis_tutari_bin_tl",)

SCORING_VERSION = "expert_v0"
CATEGORY_WEIGHTS = {"fundamental_quality": 0.50, "valuation": 0.30, "offering_structure": 0.20}
COVERAGE_THRESHOLD = 0.60
# category, feature, weight, kind, low value, low score, high value, high score, absolute.
SCORED = (
    ("fundamental_quality", "business_description", 10.0, "presence", None, None, None, None, False),
    ("fundamental_quality", "key_risk_factors", 10.0, "presence", None, None, None, None, False),
    ("fundamental_quality", "use_of_proceeds_plan", 10.0, "presence", None, None, None, None, False),
    ("fundamental_quality", "revenue_growth_yoy", 15.0, "numeric", -0.20, 0.0, 0.40, 100.0, False),
    ("fundamental_quality", "net_margin", 15.0, "numeric", -0.10, 0.0, 0.30, 100.0, False),
    ("fundamental_quality", "debt_to_equity", 15.0, "numeric", 0.0, 100.0, 2.0, 0.0, False),
    ("fundamental_quality", "current_ratio", 10.0, "numeric", 0.5, 0.0, 2.5, 100.0, False),
    ("fundamental_quality", "operating_cash_flow_to_net_income", 10.0, "numeric", 0.0, 0.0, 1.5, 100.0, False),
    ("fundamental_quality", "interest_coverage", 5.0, "numeric", 0.0, 0.0, 10.0, 100.0, False),
    ("valuation", "headline_discount_percentage", 40.0, "numeric", 0.0, 0.0, 30.0, 100.0, False),
    ("valuation", "earnings_multiple_at_offer", 35.0, "numeric", 5.0, 100.0, 30.0, 0.0, False),
    ("valuation", "reported_pe_difference_percentage", 25.0, "numeric", 0.0, 100.0, 50.0, 0.0, True),
    ("offering_structure", "subscription_window", 15.0, "presence", None, None, None, None, False),
    ("offering_structure", "distribution_method", 15.0, "presence", None, None, None, None, False),
    ("offering_structure", "total_offered_shares", 15.0, "presence", None, None, None, None, False),
    ("offering_structure", "capital_increase_shares", 15.0, "presence", None, None, None, None, False),
    ("offering_structure", "capital_increase_ratio", 40.0, "numeric", 0.0, 0.0, 100.0, 100.0, False),
)
SCORED_NAMES = ("category", "feature_id", "weight", "kind", "low_value", "low_score", "high_value", "high_score", "use_abs")
SCORED_TYPES = ("string", "string", "double", "string", "double", "double", "double", "double", "boolean")
CONFIDENCE_WEIGHTS = {
    "required_document_completeness": 0.30, "critical_field_validation": 0.25, "extraction_quality": 0.15, "source_agreement": 0.15, "document_freshness": 0.15,
}
FRESHNESS_BAND = (30.0, 100.0, 365.0, 0.0)
CRITICAL_FEATURES = ("offering_price", "distribution_method", "subscription_window", "total_offered_shares", "capital_increase_shares")
AGREEMENT_FIELDS = ("offering_price", "distribution_method", "subscription_start_date", "subscription_end_date", "total_offered_shares", "capital_increase_ratio")
THRESHOLDS = {
    "participate_total": 68.0, "participate_confidence": 70.0, "participate_valuation": 55.0, "participate_fundamental": 55.0,
    "limited_low": 50.0, "limited_high": 67.0, "limited_confidence": 55.0, "limited_high_total": 68.0, "limited_band_low": 45.0, "limited_band_high": 69.0,
    "skip_total": 50.0, "skip_confidence": 55.0, "insufficient_confidence": 45.0,
}
