"""Past decisions rebuilt with only what was knowable at each entity's cutoff, in one job for all entities and cutoffs."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pitlake.operators import evidence, pit, series
from pitlake.plans.decisions import decide_entities
from pitlake.session import stage
from pitlake.tables import per_key

FACT_SOURCE = "kap_extraction.subscription_end_date"
TIERS = {FACT_SOURCE: 1, "kap_ipo_results.subscription_end_date": 2, "issuer_ir.subscription_end_date": 3}

# Names of the context features in the catalog.
CONTEXT_NAMES = {
    "index_level": "bist_index_level", "return_20d": "bist100_return_20d", "return_60d": "bist100_return_60d", "return_120d": "bist100_return_120d",
    "volatility_20d": "bist100_volatility_20d", "max_drawdown_60d": "bist100_max_drawdown_60d", "policy_rate": "policy_rate", "tlref_rate": "tlref_rate",
    "yoy": "cpi_yoy", "policy_rate_minus_yoy": "policy_rate_minus_cpi",
}


def cutoff_evidence(facts: DataFrame, later: DataFrame) -> DataFrame:
    """Tiered dates: the fact itself first (all its dates when conflicting), then result announcements, then issuer pages."""
    ends = facts.where((F.col("field") == "subscription_end_date") & F.col("status").isin("extracted", "conflicting"))
    own = ends.select("entity_id", "status", "doc_id", F.explode("observations").alias("_o")).select(
        "entity_id", F.lit(1).alias("tier"), F.col("_o.value.value_date").alias("cutoff_date"), F.coalesce("doc_id", "_o.from.doc_id").alias("doc_id"), F.lit(FACT_SOURCE).alias("source"))
    tier = F.try_element_at(F.create_map(*[F.lit(x) for pair in TIERS.items() for x in pair]), F.col("source"))
    return own.unionByName(later.select("entity_id", tier.alias("tier"), "cutoff_date", "doc_id", "source"))


def build_cutoffs(entities: DataFrame, observations: DataFrame, later: DataFrame) -> DataFrame:
    facts = evidence.merge_evidence(observations, leading=evidence.OFFERING_LEADING)
    return pit.resolve_cutoff(entities, cutoff_evidence(facts, later))


def snapshot_documents(documents: DataFrame, cutoffs: DataFrame) -> DataFrame:
    """Every document of every entity with ``considered``: the ids behind a snapshot's two counts, one row each."""
    return pit.as_of_filter(documents, cutoffs, "published_at")


def context_at(cutoffs: DataFrame, index: DataFrame, rates: Mapping[str, DataFrame], monthly: DataFrame) -> DataFrame:
    """entity_id, feature, value: computed once per distinct cutoff date, then joined to the entities of that date."""
    dated = cutoffs.where(F.col("cutoff_date").isNotNull()).select("entity_id", F.col("cutoff_date").alias("as_of"))
    by_date = series.market_context(index, rates, monthly, dated.select("as_of").distinct())
    name = F.try_element_at(F.create_map(*[F.lit(x) for pair in CONTEXT_NAMES.items() for x in pair]), F.col("feature"))
    # A few rows per calendar day; the entities of a day are as many as there are.
    return dated.join(F.broadcast(by_date), "as_of").select("entity_id", name.alias("feature"), "value")


def build_snapshots(
    entities: DataFrame, documents: DataFrame, observations: DataFrame, later: DataFrame, fin: DataFrame, context_series, applications: DataFrame | None = None,
    outcomes: DataFrame | None = None, read_known: Callable[[DataFrame], DataFrame] | None = None,
) -> DataFrame:
    """One row per entity: cutoff, considered and excluded document counts, decision as of the cutoff, outcome label.

    An unresolved cutoff gives no decision and excludes every document. The outcome is joined last, so it cannot reach any feature.
    ``observations`` and ``fin`` carry entity_id and published_at; ``context_series`` is (index, rates, monthly). With ``read_known``, a function of the
    cutoffs that returns the observations known at them, ``observations`` need hold no field but the subscription's end, and only documents that
    are considered have to be read for all the others.
    """
    cutoffs = stage(build_cutoffs(entities, observations, later))
    keyed = per_key(cutoffs)
    judged = snapshot_documents(documents, keyed)
    counts = judged.groupBy("entity_id").agg(F.count_if("considered").alias("considered_documents"), F.count_if(~F.col("considered")).alias("excluded_documents"))
    known_documents = judged.where("considered").join(keyed.select("entity_id", "cutoff_date"), "entity_id")
    known = read_known(keyed) if read_known else pit.as_of_filter(observations, keyed, "published_at").where("considered").drop("considered")
    facts = stage(evidence.merge_evidence(known, leading=evidence.OFFERING_LEADING))
    known_fin = pit.as_of_filter(fin, keyed, "published_at").where("considered").drop("considered")
    applied = None
    if applications is not None:
        days = keyed.select("entity_id", "cutoff_date")
        applied = applications.join(days, "entity_id").where(F.col("application_date") <= F.col("cutoff_date")).select("entity_id", "application_date")
    resolved = entities.join(keyed.where("cutoff_status = 'resolved'").select("entity_id"), "entity_id", "left_semi")
    tables = decide_entities(resolved, known_documents, facts, known_fin, pit.end_of_day(F.col("cutoff_date")), context_at(cutoffs, *context_series), None, applied)
    out = keyed.select("entity_id", "cutoff_status", "cutoff_date", "cutoff_source").join(counts, "entity_id", "left").join(tables.decisions, "entity_id", "left")
    return out if outcomes is None else out.join(outcomes, "entity_id", "left")
