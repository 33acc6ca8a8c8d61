"""From observations to decisions for all entities at once; every step is partitioned by entity."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame

from pitlake.operators import ratios, scoring
from pitlake.session import stage


@dataclass(frozen=True)
class DecisionTables:
    feature_status: DataFrame
    contributions: DataFrame
    category_scores: DataFrame
    confidence: DataFrame
    rule_hits: DataFrame
    decisions: DataFrame


def decide_entities(
    entities: DataFrame, documents: DataFrame, facts: DataFrame, fin: DataFrame, reference: Column, context: DataFrame | None = None,
    records: DataFrame | None = None, applications: DataFrame | None = None,
) -> DecisionTables:
    """Audit, score and decide.

    ``entities``: entity_id, sector; ``documents``: entity_id, doc_id, document_type, title, published_at, usable; ``facts``: merged
    facts; ``fin``: long metric observations; ``context``: entity_id, feature, value; ``reference``: evaluation time.
    """
    derived = ratios.derived_financials(entities, fin, facts, entities)
    fields = [scoring.fact_fields(facts), scoring.financial_fields(fin, entities), scoring.derived_fields(derived)]
    fields += [make(table) for make, table in (
        (scoring.market_fields, context), (scoring.record_fields, records), (scoring.application_fields, applications)) if table is not None]
    # Four later steps read the audit, so it is written once.
    status = stage(scoring.audit_features(entities, documents, fields))
    contributions = scoring.score_contributions(status)
    categories = scoring.score_categories(contributions)
    confidence = scoring.confidence_components(status, facts, documents, reference)
    hits = scoring.hard_rules(entities, status, facts, documents, categories)
    return DecisionTables(status, contributions, categories, confidence, hits, scoring.decide(scoring.total_score(categories), confidence, hits))
