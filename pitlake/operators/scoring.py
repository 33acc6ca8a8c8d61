"""Coverage audit, coverage-aware scores, confidence, hard rules and the signal.

Each input is reduced to one row per entity first; auditing a whole catalog is then row-local, and everything after groups
by entity on data already partitioned by entity.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pitlake import catalog
from pitlake import extraction_rules as rules
from pitlake import fixed_values as fixed
from pitlake.functions.numbers import band_normalize
from pitlake.operators.records import is_withdrawal, not_applicable
from pitlake.tables import computed_once, literal_table, text_array

PRIORITY = {s: i for i, s in enumerate(catalog.STATUSES)}
USABLE = ("AVAILABLE", "DERIVABLE")
FOUND = "struct<status:string,value_num:double,method:string>"


def _found(ref: Column, status: Column, value: Column | None = None, method: Column | None = None) -> Column:
    none = F.lit(None)
    return F.struct(ref.alias("ref"), F.struct(
        status.alias("status"), (none if value is None else value).cast("double").alias("value_num"),
        (none if method is None else method).cast("string").alias("method")).cast(FOUND).alias("found"))


def fact_fields(facts: DataFrame) -> DataFrame:
    """Merged facts as audit fields. A conflict is counted to a method only when all its sources share it."""
    methods = F.array_distinct(F.transform("observations", lambda o: o["from"]["method"]))
    status = F.when(F.col("status") == "extracted", "AVAILABLE").when(F.col("status") == "conflicting", "CONFLICTED")
    method = F.when(F.col("status") == "extracted", F.col("method")).when(F.size(methods) == 1, methods[0])
    rows = facts.where(F.col("status").isin("extracted", "conflicting"))
    return rows.select("entity_id", _found(F.concat(F.lit("kap_extraction."), "field"), status, F.col("value_num"), method).alias("_x"))


def financial_fields(fin: DataFrame, entities: DataFrame) -> DataFrame:
    """``financial_series.*``: not applicable by sector, else available when any observation exists."""
    has_method = "method" in fin.columns
    first = fin.groupBy("entity_id", "metric").agg((F.min_by("method", F.struct("doc_id", "page_no", "place")) if has_method else F.lit(None).cast("string")).alias("method"))
    seen = first.select("entity_id", _found(F.concat(F.lit("financial_series."), "metric"), F.lit("AVAILABLE"), None, F.col("method")).alias("_x"))
    metrics = sorted({m for ms in fixed.SECTOR_SKIPS_METRIC.values() for m in ms})
    skipped = entities.select("entity_id", "sector", F.explode(text_array(metrics)).alias("metric")).where(
        not_applicable(F.col("sector"), F.col("metric"), fixed.SECTOR_SKIPS_METRIC))
    skipped = skipped.select("entity_id", _found(F.concat(F.lit("financial_series."), "metric"), F.lit("NOT_APPLICABLE")).alias("_x"))
    return seen.unionByName(skipped)


def derived_fields(derived: DataFrame) -> DataFrame:
    status = F.when(F.col("status") == "computed", "DERIVABLE").otherwise("NOT_APPLICABLE")
    rows = derived.where(F.col("status").isin("computed", "not_applicable"))
    return rows.select("entity_id", _found(F.concat(F.lit("derived_financial."), "name"), status, F.col("value")).alias("_x"))


def market_fields(context: DataFrame) -> DataFrame:
    """``context``: entity_id, feature, value."""
    return context.where(F.col("value").isNotNull()).select(
        "entity_id", _found(F.concat(F.lit("market_data."), "feature"), F.lit("AVAILABLE"), F.col("value")).alias("_x"))


def record_fields(records: DataFrame) -> DataFrame:
    """``spk_ipo_record.*`` from completed offerings (entity_id and its fields as columns)."""
    cells = []
    for name in [c for c in records.columns if c != "entity_id"]:
        ref = f"spk_ipo_record.{name}"
        empty = "NOT_APPLICABLE" if ref in catalog.NULL_MEANS_NOT_APPLICABLE else "MISSING_FIELD"
        cells.append(_found(F.lit(ref), F.when(F.col(name).isNotNull(), "AVAILABLE").otherwise(empty), F.col(name).try_cast("double")))
    return records.select("entity_id", F.explode(F.array(*cells)).alias("_x"))


def application_fields(applications: DataFrame) -> DataFrame:
    status = F.when(F.col("application_date").isNotNull(), "AVAILABLE").otherwise("MISSING_FIELD")
    return applications.select("entity_id", _found(F.lit("spk_application.application_date"), status).alias("_x"))


def _priority(status: Column) -> Column:
    value = F.lit(None).cast("int")
    for name, number in PRIORITY.items():
        value = F.when(status == name, number).otherwise(value)
    return value


def _status(priority: Column) -> Column:
    return F.element_at(text_array(catalog.STATUSES), priority + 1)


def _unseen(ref: str) -> str:
    """Status of a catalog field that has no entry, or the rule that gives it: ``gap`` and ``document`` by readable documents, ``sector`` by the sector."""
    space, name = ref.split(".", 1)
    if space == "kap_extraction" and name not in rules.FIELD_NAMES:
        return "MISSING_FIELD"
    if space in ("kap_extraction", "financial_series", "derived_financial"):
        return "gap"
    return {"spk_ipo_record": "POST_OFFER_ONLY", "kap_document": "document", "kap_sector": "sector"}.get(space, "MISSING_DOCUMENT")


def audit_features(entities: DataFrame, documents: DataFrame, fields: Sequence[DataFrame], features: Sequence[str] | None = None) -> DataFrame:
    """Status of every catalog feature (or of the named ``features``) for every entity.

    ``entities``: entity_id, sector. ``documents``: entity_id, document_type, usable. ``fields``: tables made by the
    ``*_fields`` functions. Output: entity_id, feature_id, category, status, value_num, evidence_count, digital, ocr,
    offer_timing, is_mandatory, acceptable_sources, missing.
    """
    every = fields[0]
    for more in fields[1:]:
        every = every.unionByName(more)
    # At most one entry per catalog field, so the map of an entity is bounded by the catalog.
    direct = {i: (refs, acc) for i, _, refs, acc, *_ in catalog.DIRECT}
    needed = sorted({dep for _, _, deps, *_ in catalog.DERIVED for dep in deps})
    chosen = [f for f in (*catalog.DIRECT, *catalog.DERIVED) if features is None or f[0] in features]
    wanted = sorted({ref for i in (*needed, *(f[0] for f in chosen)) if i in direct for ref in direct[i][0]})
    kept = every.select("entity_id", "_x.ref", "_x.found").where(F.col("ref").isin(*wanted))
    single = kept.groupBy("entity_id", "ref").agg(F.min_by("found", _priority(F.col("found.status"))).alias("found"))
    entry = F.struct("ref", F.struct(_priority(F.col("found.status")).alias("priority"), F.col("found.value_num").alias("value_num"), F.col("found.method").alias("method")))
    found = single.groupBy("entity_id").agg(F.map_from_entries(F.collect_list(entry)).alias("_found"))
    readable = documents.where("usable").groupBy("entity_id").agg(F.collect_set("document_type").alias("_readable"))
    row = entities.select("entity_id", "sector").join(found, "entity_id", "left").join(readable, "entity_id", "left")
    row = row.withColumn("_readable", F.coalesce("_readable", F.array().cast("array<string>")))

    def priority(ref: Column, accepted: Column, unseen: Column) -> Column:
        """Of one field; ``unseen`` is its status without an entry, or the rule that gives it."""
        name = F.substring_index(ref, ".", -1)
        default = (
            F.when(unseen == "gap", F.when(F.arrays_overlap(accepted, F.col("_readable")), PRIORITY["MISSING_FIELD"]).otherwise(PRIORITY["MISSING_DOCUMENT"]))
            .when(unseen == "document", F.when(F.array_contains(F.col("_readable"), name), PRIORITY["AVAILABLE"]).otherwise(PRIORITY["MISSING_DOCUMENT"]))
            .when(unseen == "sector", F.when(F.col("sector") == "unknown", PRIORITY["MISSING_DOCUMENT"]).otherwise(PRIORITY["AVAILABLE"]))
            .otherwise(_priority(unseen)))
        return F.coalesce(F.try_element_at(F.col("_found"), ref)["priority"], default)

    # What derived features depend on is worked out per entity: a few columns that every derived row reads.
    worst = [F.least(*p) if len(p) > 1 else p[0] for p in ([priority(F.lit(r), text_array(direct[d][1]), F.lit(_unseen(r))) for r in direct[d][0]] for d in needed)]
    price = F.try_element_at("_found", F.lit("kap_extraction.offering_price"))["value_num"]
    shares = F.try_element_at("_found", F.lit("kap_extraction.total_offered_shares"))["value_num"]
    row = row.select("*", F.array(*worst).alias("_needed"), price.alias("_price"), shares.alias("_shares"))

    # One config row per feature, generated beside the entity, so that the rest is plain columns of a row and no function of an array.
    width = max(len(refs) for refs, _ in direct.values())
    names = ["feature_id", "category", "offer_timing", "is_mandatory", "acceptable_sources", *(f"_r{k}" for k in range(width)), *(f"_u{k}" for k in range(width)), "_refs", "_deps", "_depends"]
    config = []
    for i, c, refs, acc, timing, mandatory in chosen:
        own = list(refs) if i in direct else []
        places = [] if i in direct else [needed.index(d) + 1 for d in refs]
        empty = [F.lit(None).cast("string")] * (width - len(own))
        cells = [F.lit(i), F.lit(c), F.lit(timing), F.lit(mandatory), text_array(acc), *map(F.lit, own), *empty, *(F.lit(_unseen(r)) for r in own), *empty,
                 F.lit(len(own)), F.array(*map(F.lit, places)).cast("array<int>"), F.lit(len(places))]
        config.append(F.struct(*[cell.alias(name) for cell, name in zip(cells, names, strict=True)]))
    row = row.select("*", F.inline(F.array(*config)))

    is_direct = F.col("_refs") > 0
    held = [F.when(F.col(f"_r{k}").isNotNull(), priority(F.col(f"_r{k}"), F.col("acceptable_sources"), F.col(f"_u{k}"))) for k in range(width)]
    most = max(len(deps) for _, _, deps, *_ in catalog.DERIVED)
    leant = [F.when(F.col("_depends") > k, F.element_at("_needed", F.try_element_at("_deps", F.lit(k + 1)))) for k in range(most)]
    worst_of = F.array_min(F.array(*[F.col(f"_p{k}") for k in range(width)], *[F.col(f"_d{k}") for k in range(most)]))
    row = row.select("*", *[p.alias(f"_p{k}") for k, p in enumerate(held)], *[p.alias(f"_d{k}") for k, p in enumerate(leant)])
    row = computed_once(row, "_worst", worst_of)
    ok = F.col("_worst") >= PRIORITY["DERIVABLE"]
    value = F.when(F.col("feature_id") == "implied_offer_size_value", F.col("_price") * F.col("_shares")).when(F.col("feature_id") == "final_allocation_price", F.col("_price"))

    def read_by(method: str) -> Column:
        return sum((F.when(F.try_element_at("_found", F.col(f"_r{k}"))["method"] == method, 1).otherwise(0) for k in range(width)), F.lit(0))

    missing = F.array_except(F.array(
        *[F.when(F.col(f"_p{k}") != PRIORITY["AVAILABLE"], F.col(f"_r{k}")) for k in range(width)],
        *[F.when(F.col(f"_d{k}") < PRIORITY["DERIVABLE"], F.element_at(text_array(needed), F.try_element_at("_deps", F.lit(k + 1)))) for k in range(most)]), F.array(F.lit(None).cast("string")))
    return row.select(
        "entity_id", "feature_id", "category", F.when(~is_direct & ok, "DERIVABLE").otherwise(_status(F.col("_worst"))).alias("status"),
        F.when(F.col("_refs") == 1, F.try_element_at("_found", F.col("_r0"))["value_num"]).when(~is_direct & ok, value).alias("value_num"),
        F.when(is_direct, F.col("_refs")).when(ok, 1).otherwise(0).alias("evidence_count"), read_by("digital").alias("digital"), read_by("ocr").alias("ocr"),
        "offer_timing", "is_mandatory", "acceptable_sources", missing.alias("missing"))


AUDITED = tuple(f[0] for f in (*catalog.DIRECT, *catalog.DERIVED))


def audit_patterns(entities: DataFrame, documents: DataFrame, fields: Sequence[DataFrame]) -> DataFrame:
    """The statuses that :func:`audit_features` gives, one row per entity: entity_id, pattern.

    ``pattern`` has one digit per catalog feature, in the order of ``AUDITED``: the place of its status in ``catalog.STATUSES``. Everything known of
    an entity meets in one grouping with a column per field, so nothing is joined and no row per feature is made. Entities given twice count once.
    """
    wanted = sorted({ref for _, _, refs, *_ in catalog.DIRECT for ref in refs})
    gaps = sorted({acc for _, _, refs, acc, *_ in catalog.DIRECT if any(_unseen(r) == "gap" for r in refs)})
    types = sorted({t for acc in gaps for t in acc} | {r.split(".", 1)[1] for r in wanted if _unseen(r) == "document"})

    def looked_up(numbers: Mapping[str, int], key: Column) -> Column:
        return F.try_element_at(F.create_map(*[F.lit(v) for pair in numbers.items() for v in pair]), key)

    # Every input becomes rows of entity_id, a key (field, readable document type or the entity itself) and a number whose least counts.
    # The status is looked up, that is, named once: so the optimizer drops what else an entry holds.
    known = [f.select("entity_id", F.col("_x.ref").alias("_key"), looked_up(PRIORITY, F.col("_x.found.status")).alias("_p")).where(F.col("_key").isin(*wanted)) for f in fields]
    read = documents.where(F.col("usable") & F.col("document_type").isin(*types)).select("entity_id", "document_type").distinct()
    known.append(read.select("entity_id", F.concat(F.lit("type."), "document_type").alias("_key"), F.lit(0).alias("_p")))
    keys = [*wanted, *(f"type.{t}" for t in types)]
    place = looked_up({key: k for k, key in enumerate(keys)}, F.col("_key")).alias("_key")
    known = [k.where(F.col("entity_id").isNotNull()).select("entity_id", place, "_p") for k in known]
    every = entities.select("entity_id", F.lit(-1).alias("_key"), F.when(F.col("sector") == "unknown", 0).otherwise(1).alias("_p"))
    for more in known:
        every = every.unionByName(more)
    # Dealt by entity first, so that no half-filled wide rows are shuffled.
    wide = every.repartition("entity_id").groupBy("entity_id").agg(
        F.min(F.when(F.col("_key") == -1, F.col("_p"))).alias("_sector"), *[F.min(F.when(F.col("_key") == k, F.col("_p"))).alias(f"_k{k}") for k in range(len(keys))])

    def has(accepted: Sequence[str]) -> Column:
        return F.coalesce(*[F.col(f"_k{keys.index(f'type.{t}')}") for t in accepted]).isNotNull()

    row = wide.where(F.col("_sector").isNotNull()).select(
        "*", *[F.when(has(acc), PRIORITY["MISSING_FIELD"]).otherwise(PRIORITY["MISSING_DOCUMENT"]).alias(f"_gap{k}") for k, acc in enumerate(gaps)])

    def priority(ref: str, accepted: Sequence[str]) -> Column:
        rule = _unseen(ref)
        if rule == "gap":
            default = F.col(f"_gap{gaps.index(accepted)}")
        elif rule == "document":
            default = F.when(has([ref.split(".", 1)[1]]), PRIORITY["AVAILABLE"]).otherwise(PRIORITY["MISSING_DOCUMENT"])
        elif rule == "sector":
            default = F.when(F.col("_sector") == 0, PRIORITY["MISSING_DOCUMENT"]).otherwise(PRIORITY["AVAILABLE"])
        else:
            default = F.lit(PRIORITY[rule])
        return F.coalesce(F.col(f"_k{keys.index(ref)}"), default)

    def worst(parts: Sequence[Column]) -> Column:
        return F.least(*parts) if len(parts) > 1 else parts[0]

    # What derived features depend on is worked out once.
    direct = {i: worst([priority(r, acc) for r in refs]) for i, _, refs, acc, *_ in catalog.DIRECT}
    needed = sorted({dep for _, _, deps, *_ in catalog.DERIVED for dep in deps})
    row = row.select("*", *[direct[i].alias(i) for i in needed])
    digits = [*(F.col(i) if i in needed else p for i, p in direct.items()), *(F.least(F.lit(PRIORITY["DERIVABLE"]), *map(F.col, deps)) for _, _, deps, *_ in catalog.DERIVED)]
    return row.select("entity_id", F.array_join(F.transform(F.array(*digits), lambda p: p.cast("string")), "").alias("pattern"))


def feature_counts(patterns: DataFrame) -> DataFrame:
    """feature_id, status and the number n of entities, from :func:`audit_patterns`; equal patterns are counted before they are taken apart."""
    places = literal_table(patterns.sparkSession, [(f, k) for k, f in enumerate(AUDITED, 1)], ["feature_id", "_place"], ["string", "int"])
    each = patterns.groupBy("pattern").agg(F.count(F.lit(1)).alias("_n")).crossJoin(places)
    counted = each.groupBy("feature_id", F.substring("pattern", F.col("_place"), F.lit(1)).alias("_p")).agg(F.sum("_n").alias("n"))
    return counted.select("feature_id", _status(F.col("_p").cast("int")).alias("status"), "n")


def coverage_of_patterns(patterns: DataFrame) -> DataFrame:
    """:func:`coverage_report` from :func:`audit_patterns`; the patterns are read twice, so pass them staged."""
    features, none = feature_counts(patterns), F.lit(None)
    per_feature = features.groupingSets([["feature_id", "status"], ["status"]], "feature_id", "status").agg(F.sum("n").alias("n"), F.grouping("feature_id").alias("_all"))
    per_feature = per_feature.select(
        F.when(F.col("_all") == 1, "all").otherwise("feature").alias("scope"), "feature_id", none.cast(patterns.schema["entity_id"].dataType).alias("entity_id"), "status", "n")
    length = F.length("pattern")
    cells = [F.struct(F.lit(s).alias("status"), (length - F.length(F.replace("pattern", F.lit(str(p)), F.lit("")))).cast("bigint").alias("n")) for s, p in PRIORITY.items()]
    per_entity = patterns.select("entity_id", F.inline(F.array(*cells))).where(F.col("n") > 0)
    return per_feature.unionByName(per_entity.select(F.lit("entity").alias("scope"), none.cast("string").alias("feature_id"), "entity_id", "status", "n"))


def audit_derived(feature_status: DataFrame, dependencies: DataFrame) -> DataFrame:
    """Derived features from already audited ones: the worst dependency, or DERIVABLE when all are usable.

    ``dependencies``: feature_id, depends_on (a small config table).
    """
    needed = dependencies.withColumnRenamed("feature_id", "_derived").withColumnRenamed("depends_on", "feature_id")
    worst = feature_status.join(needed, "feature_id").groupBy("entity_id", F.col("_derived").alias("feature_id")).agg(F.min(_priority(F.col("status"))).alias("_p"))
    return worst.select("entity_id", "feature_id", F.when(F.col("_p") >= PRIORITY["DERIVABLE"], "DERIVABLE").otherwise(_status(F.col("_p"))).alias("status"))


def coverage_report(feature_status: DataFrame) -> DataFrame:
    """Counts by status per feature, per entity and overall, in one job (GROUPING SETS)."""
    f, e, s = F.col("feature_id"), F.col("entity_id"), F.col("status")
    counted = feature_status.groupingSets([[f, s], [e, s], [s]], f, e, s).agg(
        F.count(F.lit(1)).alias("n"), F.grouping_id(f, e, s).alias("_g"))
    scope = F.when(F.col("_g") == 2, "feature").when(F.col("_g") == 4, "entity").otherwise("all")
    return counted.select(scope.alias("scope"), "feature_id", "entity_id", "status", "n")


def _entities(feature_status: DataFrame, condition: Column | None = None) -> Column:
    """Sum of the entities that rows stand for: ``n`` of :func:`feature_counts`, else one a row."""
    n = F.col("n") if "n" in feature_status.columns else F.lit(1).cast("bigint")
    return F.sum(n) if condition is None else F.coalesce(F.sum(F.when(condition, n)), F.lit(0).cast("bigint"))


def feature_coverage(feature_status: DataFrame) -> DataFrame:
    """Per feature: entities, available share in percent, conflicts. ``feature_status`` may be :func:`feature_counts`."""
    every, available = _entities(feature_status), _entities(feature_status, F.col("status").isin(*USABLE))
    return feature_status.groupBy("feature_id").agg(
        every.alias("entities"), available.alias("available"), F.round(100.0 * available / every, 1).alias("available_pct"),
        _entities(feature_status, F.col("status") == "CONFLICTED").alias("conflicts"))


def top_gap_reasons(feature_status: DataFrame, k: int = 5) -> DataFrame:
    """The k most frequent unavailable statuses per feature. ``feature_status`` may be :func:`feature_counts`."""
    gaps = feature_status.where(~F.col("status").isin(*USABLE)).groupBy("feature_id", "status").agg(_entities(feature_status).alias("n"))
    order = Window.partitionBy("feature_id").orderBy(F.col("n").desc(), "status")
    return gaps.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k)


def score_contributions(feature_status: DataFrame, scored=catalog.SCORED) -> DataFrame:
    """Scored features with their normalized score; ``feature_status``: entity_id, feature_id, status, value_num."""
    config = literal_table(feature_status.sparkSession, scored, catalog.SCORED_NAMES, catalog.SCORED_TYPES)
    own = feature_status.select("entity_id", "feature_id", "status", "value_num")
    joined = own.join(config, "feature_id")
    value = F.when(F.col("use_abs"), F.abs("value_num")).otherwise(F.col("value_num"))
    banded = band_normalize(value, *[F.col(c) for c in ("low_value", "low_score", "high_value", "high_score")])
    score = F.when(F.col("status").isin(*USABLE), F.when(F.col("kind") == "presence", 100.0).otherwise(banded))
    return joined.select("entity_id", "category", "feature_id", "status", "value_num", "weight", score.alias("normalized_score")).withColumn(
        "included", F.col("normalized_score").isNotNull())


def score_categories(contributions: DataFrame, scored=catalog.SCORED, threshold: float = catalog.COVERAGE_THRESHOLD) -> DataFrame:
    """Per entity and category: score over available weight only, coverage over applicable weight, OK or INSUFFICIENT.

    A configured feature without any row counts as missing, so applicable weight is the category's total less what is NOT_APPLICABLE.
    """
    totals: dict[str, float] = {}
    for category, _, weight, *_ in scored:
        totals[category] = totals.get(category, 0.0) + weight
    sums = []
    for i, category in enumerate(totals):
        mine = F.col("category") == category
        sums += [
            F.coalesce(F.sum(F.when(mine & F.col("included"), F.col("weight") * F.col("normalized_score"))), F.lit(0.0)).alias(f"_n{i}"),
            F.coalesce(F.sum(F.when(mine & F.col("included"), F.col("weight"))), F.lit(0.0)).alias(f"_a{i}"),
            F.coalesce(F.sum(F.when(mine & (F.col("status") == "NOT_APPLICABLE"), F.col("weight"))), F.lit(0.0)).alias(f"_x{i}"),
        ]
    wide = contributions.groupBy("entity_id").agg(*sums)
    cells = [F.struct(
        F.lit(c).alias("category"), F.try_divide(F.col(f"_n{i}"), F.col(f"_a{i}")).alias("score"),
        F.coalesce(F.try_divide(F.col(f"_a{i}"), F.lit(total) - F.col(f"_x{i}")), F.lit(0.0)).alias("coverage")) for i, (c, total) in enumerate(totals.items())]
    long = wide.select("entity_id", F.inline(F.array(*cells)))
    return long.withColumn("status", F.when(F.col("coverage") >= threshold, "OK").otherwise("INSUFFICIENT"))


def total_score(category_scores: DataFrame, weights=catalog.CATEGORY_WEIGHTS) -> DataFrame:
    """Weight-renormalized mean of the category scores; any INSUFFICIENT category voids the total."""
    weight = F.lit(None).cast("double")
    for name, value in weights.items():
        weight = F.when(F.col("category") == name, value).otherwise(weight)
    usable = F.when(F.col("score").isNotNull(), weight)
    mean = F.try_divide(F.sum(usable * F.col("score")), F.sum(usable))
    thin = F.bool_or(F.col("status") == "INSUFFICIENT")
    picks = [F.max(F.when(F.col("category") == c, F.col("score"))).alias(f"{c}_score") for c in weights]
    return category_scores.groupBy("entity_id").agg(
        F.when(~thin, mean).alias("total_score"), thin.alias("thin_category"), *picks)


def confidence_components(feature_status: DataFrame, facts: DataFrame, documents: DataFrame, reference: Column) -> DataFrame:
    """Five component scores and their weighted sum per audited entity.

    ``facts``: entity_id, field, status, values, source_count; ``documents``: entity_id, published_at; ``reference`` is the evaluation
    time, a literal or a column of ``documents``.
    """
    mandatory = F.col("is_mandatory") & (F.col("offer_timing") == "pre_offer") & (F.col("status") != "NOT_APPLICABLE")
    audit = feature_status.groupBy("entity_id").agg(
        F.coalesce(F.try_divide(100.0 * F.count_if(mandatory & F.col("status").isin(*USABLE)), F.count_if(mandatory)), F.lit(100.0)).alias("required_document_completeness"),
        F.coalesce(F.try_divide(100.0 * F.sum("digital"), F.sum("digital") + F.sum("ocr")), F.lit(100.0)).alias("extraction_quality"))

    def fact(field: str) -> Column:
        return F.max(F.when((F.col("field") == field) & (F.col("status") == "extracted"), F.struct(F.lit(True).alias("ok"), "value_num", "value_date")))

    names = ("offering_price", "distribution_method", "subscription_start_date", "subscription_end_date", "total_offered_shares", "capital_increase_shares")
    stated = F.col("field").isin(*catalog.AGREEMENT_FIELDS) & F.col("status").isin("extracted", "conflicting")
    said = facts.groupBy("entity_id").agg(
        *[fact(n).alias(n) for n in names], F.count_if(stated).alias("_stated"), F.count_if(stated & (F.col("source_count") > 1)).alias("_agreed"))
    checks = [
        F.col("offering_price.value_num") > 0, F.col("distribution_method.ok"),
        F.col("subscription_end_date.value_date") >= F.col("subscription_start_date.value_date"), F.col("total_offered_shares.value_num") > 0,
        F.col("capital_increase_shares.value_num") >= 0,
    ]
    valid = sum((F.when(F.coalesce(c, F.lit(False)), 1).otherwise(0) for c in checks), F.lit(0))
    said = said.select("entity_id", (100.0 * valid / len(checks)).alias("critical_field_validation"),
                       F.coalesce(F.try_divide(100.0 * F.col("_agreed"), F.col("_stated")), F.lit(0.0)).alias("source_agreement"))
    latest = documents.groupBy("entity_id").agg(F.max("published_at").alias("_latest"), F.max(reference).alias("_now"))
    row = audit.join(said, "entity_id", "left").join(latest, "entity_id", "left")
    age = F.floor(F.timestamp_diff("SECOND", F.col("_latest"), F.col("_now")) / 86400).cast("double")
    row = row.withColumn("document_freshness", band_normalize(age, *[F.lit(v) for v in catalog.FRESHNESS_BAND]))
    parts = {n: F.coalesce(F.col(n), F.lit(0.0)) for n in catalog.CONFIDENCE_WEIGHTS}
    confidence = sum((parts[n] * w for n, w in catalog.CONFIDENCE_WEIGHTS.items()), F.lit(0.0))
    return row.select("entity_id", *[v.alias(n) for n, v in parts.items()], confidence.alias("confidence_score"))


def share_equation_broken(new: Column, secondary: Column, total: Column) -> Column:
    """New plus sold shares differ from the total by more than max(1, 0.1 %); a missing sale counts as zero."""
    gap = F.abs(new + F.coalesce(secondary, F.lit(0.0)) - total)
    return F.coalesce(gap > F.greatest(F.lit(1.0), total * 0.001), F.lit(False))


def hard_rules(entities: DataFrame, feature_status: DataFrame, facts: DataFrame, documents: DataFrame, category_scores: DataFrame) -> DataFrame:
    """The five gates per entity, long: rule_id, target, triggered."""
    late = F.col("is_mandatory") & (F.col("offer_timing") == "pre_offer") & (F.col("status") == "MISSING_DOCUMENT")
    audit = feature_status.groupBy("entity_id").agg(
        F.bool_or(late).alias("_no_document"),
        F.bool_or(F.col("feature_id").isin(*catalog.CRITICAL_FEATURES) & (F.col("status") == "CONFLICTED")).alias("_conflict"))
    shares = {"new": "capital_increase_shares", "sold": "secondary_sale_shares", "total": "total_offered_shares"}
    said = facts.groupBy("entity_id").agg(
        *[F.max(F.when((F.col("field") == f) & (F.col("status") == "extracted"), F.col("value_num"))).alias(n) for n, f in shares.items()],
        F.bool_or(F.col("field").isin(*shares.values()) & (F.col("status") == "conflicting")).alias("_unclear"))
    said = said.select("entity_id", (~F.col("_unclear") & share_equation_broken(F.col("new"), F.col("sold"), F.col("total"))).alias("_equation"))
    withdrawn = documents.groupBy("entity_id").agg(F.bool_or(is_withdrawal(F.col("title"))).alias("_withdrawn"))
    thin = category_scores.groupBy("entity_id").agg(F.bool_or(F.col("status") == "INSUFFICIENT").alias("_thin"))
    row = entities.select("entity_id")
    for part in (audit, said, withdrawn, thin):
        row = row.join(part, "entity_id", "left")
    gates = (
        ("missing_mandatory_documents", "insufficient_data", "_no_document"), ("unresolved_critical_conflict", "insufficient_data", "_conflict"),
        ("invalid_offer_share_equation", "skip", "_equation"), ("withdrawn_cancelled_suspended", "skip", "_withdrawn"),
        ("insufficient_mandatory_category_coverage", "insufficient_data", "_thin"))
    cells = [F.struct(F.lit(i).alias("rule_id"), F.lit(t).alias("target"), F.coalesce(F.col(c), F.lit(False)).alias("triggered")) for i, t, c in gates]
    return row.select("entity_id", F.inline(F.array(*cells)))


def determine_signal(total: Column, confidence: Column, valuation: Column, fundamental: Column, insufficient_hit: Column, skip_hit: Column) -> Column:
    t = catalog.THRESHOLDS
    participate = (total >= t["participate_total"]) & (confidence >= t["participate_confidence"]) & (valuation >= t["participate_valuation"]) & (
        fundamental >= t["participate_fundamental"])
    limited = (total.between(t["limited_low"], t["limited_high"]) & (confidence >= t["limited_confidence"])) | (
        (total >= t["limited_high_total"]) & confidence.between(t["limited_band_low"], t["limited_band_high"]))
    return (
        F.when((confidence < t["insufficient_confidence"]) | insufficient_hit, "insufficient_data").when(skip_hit, "skip")
        .when(total.isNull(), "insufficient_data").when(F.coalesce(participate, F.lit(False)), "participate").when(limited, "limited_participation")
        .when((total < t["skip_total"]) & (confidence >= t["skip_confidence"]), "skip").otherwise("insufficient_data"))


def decide(totals: DataFrame, confidence: DataFrame, rule_hits: DataFrame) -> DataFrame:
    """Signal per entity from totals, confidence and rule hits."""
    hits = rule_hits.groupBy("entity_id").agg(
        F.bool_or(F.col("triggered") & (F.col("target") == "insufficient_data")).alias("_insufficient"),
        F.bool_or(F.col("triggered") & (F.col("target") == "skip")).alias("_skip"))
    row = totals.join(confidence.select("entity_id", "confidence_score"), "entity_id").join(hits, "entity_id", "left")
    signal = determine_signal(
        F.col("total_score"), F.col("confidence_score"), F.col("valuation_score"), F.col("fundamental_quality_score"),
        F.coalesce("_insufficient", F.lit(False)), F.coalesce("_skip", F.lit(False)))
    return row.select("entity_id", signal.alias("signal"), "total_score", "confidence_score", *[f"{c}_score" for c in catalog.CATEGORY_WEIGHTS])


def top_contributions(contributions: DataFrame, k: int = 3) -> DataFrame:
    """The k best and k worst scored features per entity; ties by configured order of the features."""
    order = F.array_position(text_array([f for _, f, *_ in catalog.SCORED]), F.col("feature_id"))
    scored = contributions.where("included").withColumn("_order", order)
    out = []
    for side, key in (("positive", F.col("normalized_score").desc()), ("negative", F.col("normalized_score").asc())):
        place = F.row_number().over(Window.partitionBy("entity_id").orderBy(key, "_order"))
        out.append(scored.withColumn("place", place).where(F.col("place") <= k).withColumn("side", F.lit(side)))
    return out[0].unionByName(out[1]).drop("_order")


def unavailable_high_weight(contributions: DataFrame, weight: float = 15.0) -> DataFrame:
    return contributions.where(~F.col("included") & (F.col("status") != "NOT_APPLICABLE") & (F.col("weight") >= weight))


def collect_warnings(category_scores: DataFrame, confidence: DataFrame, rule_hits: DataFrame) -> DataFrame:
    """Long: entity_id, kind, subject for thin coverage, weak confidence components and triggered rules."""
    thin = category_scores.where((F.col("status") == "INSUFFICIENT") | (F.col("coverage") < 0.75)).select(
        "entity_id", F.when(F.col("status") == "INSUFFICIENT", "insufficient_coverage").otherwise("low_coverage").alias("kind"), F.col("category").alias("subject"))
    cells = [F.struct(F.lit("low_confidence").alias("kind"), F.lit(n).alias("subject"), F.col(n).alias("score")) for n in catalog.CONFIDENCE_WEIGHTS]
    weak = confidence.select("entity_id", F.inline(F.array(*cells))).where(F.col("score") < 50).drop("score")
    hits = rule_hits.where("triggered").select("entity_id", F.lit("hard_rule").alias("kind"), F.col("rule_id").alias("subject"))
    return thin.unionByName(weak).unionByName(hits)


def evidence_references(contributions: DataFrame, facts: DataFrame) -> DataFrame:
    """Document and page behind every scored fact-based feature."""
    refs = [(i, ref.split(".")[1]) for i, _, fields, *_ in catalog.DIRECT for ref in fields if ref.startswith("kap_extraction.")]
    config = literal_table(contributions.sparkSession, refs, ["feature_id", "field"], ["string", "string"])
    scored = contributions.where("included").select("entity_id", "feature_id").join(config, "feature_id")
    sources = facts.where(F.col("status") == "extracted").select("entity_id", "field", "doc_id", F.col("winner_source").alias("document_type"), "page_no", "method")
    return scored.join(sources, ["entity_id", "field"]).select("entity_id", "feature_id", "doc_id", "document_type", "page_no", "method")


def decision_hash(decisions: DataFrame, category_scores: DataFrame, rule_hits: DataFrame) -> DataFrame:
    """Content hash of a decision without its time-drifting parts (confidence)."""
    cats = category_scores.groupBy("entity_id").agg(F.array_sort(F.collect_list(F.struct(
        "category", F.round("score", 6).alias("score"), F.round("coverage", 6).alias("coverage"), "status"))).alias("_c"))
    hits = rule_hits.groupBy("entity_id").agg(F.array_sort(F.collect_list(F.struct("rule_id", "triggered"))).alias("_r"))
    row = decisions.select("entity_id", "signal", F.round("total_score", 6).alias("total_score")).join(cats, "entity_id", "left").join(hits, "entity_id", "left")
    body = F.struct("signal", "total_score", F.col("_c").alias("category_scores"), F.col("_r").alias("hard_rules"), F.lit(catalog.SCORING_VERSION).alias("version"))
    return row.select("entity_id", F.sha2(F.to_json(body), 256).alias("content_hash"))


def changed_decisions(hashes: DataFrame, sent: DataFrame) -> DataFrame:
    """Entities whose hash was never sent; a hash sent once is never resent."""
    return hashes.join(sent.select("entity_id", "content_hash"), ["entity_id", "content_hash"], "left_anti")


def decision_report(decisions: DataFrame) -> DataFrame:
    """Counts per signal with the number of entities that have a total."""
    return decisions.groupBy("signal").agg(F.count(F.lit(1)).alias("n"), F.count("total_score").alias("with_total"))
