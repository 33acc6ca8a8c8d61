"""Record linkage and set differences.

Every lookup side is first reduced to one row per key, so a join never multiplies rows and a key holding a third of
all left rows meets a single right row (adaptive skew splitting applies).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pitlake.functions.text import fold_text, match_key, normalize_name
from pitlake.tables import columns, text_array


def _filled(value: Column) -> Column:
    return F.coalesce(value != "", F.lit(False))


def link_records(left: DataFrame, keyed: DataFrame, named: DataFrame) -> DataFrame:
    """Left rows with ``record_id`` and ``match_method`` (ticker | company_name | unmatched).

    A present key is final: unmatched or ambiguous stays unmatched, with no fallback to the name. Without a key the
    normalized name must point to exactly one record over both pools. ``left``: ticker, company_name, ...;
    ``keyed``: record_id, ticker, company_name; ``named``: record_id, company_name.
    """
    by_key = keyed.where(_filled(F.col("ticker"))).select(
        F.concat(F.lit("key:"), match_key(F.col("ticker"))).alias("_link"), "record_id")
    pools = keyed.select("record_id", "company_name").unionByName(named.select("record_id", "company_name"))
    by_name = pools.where(_filled(F.col("company_name"))).select(
        F.concat(F.lit("name:"), normalize_name(F.col("company_name"))).alias("_link"), "record_id")
    candidates = by_key.unionByName(by_name).groupBy("_link").agg(F.min("record_id").alias("_one"), F.max("record_id").alias("_other"))
    certain = candidates.where(F.col("_one") == F.col("_other")).select("_link", F.col("_one").alias("record_id"))
    has_key = _filled(F.col("ticker"))
    name = normalize_name(F.col("company_name"))
    link = F.when(has_key, F.concat(F.lit("key:"), match_key(F.col("ticker")))).when(name != "", F.concat(F.lit("name:"), name))
    joined = left.withColumn("_link", link).join(certain, "_link", "left")
    method = F.when(F.col("record_id").isNull(), "unmatched").when(has_key, "ticker").otherwise("company_name")
    return joined.select(*columns(left.columns), "record_id", method.alias("match_method"))


def link_registered(sources: DataFrame, offerings: DataFrame, applications: DataFrame) -> DataFrame:
    """Key in offerings first, else normalized name in applications; the first listed record wins.

    ``sources``: ticker, company_name; ``offerings``: record_id, ticker, position; ``applications``: record_id,
    company_name, position.
    """
    by_key = offerings.groupBy(match_key(F.coalesce("ticker", F.lit(""))).alias("_key")).agg(F.min_by("record_id", "position").alias("_offering"))
    by_name = applications.groupBy(normalize_name(F.col("company_name")).alias("_name")).agg(F.min_by("record_id", "position").alias("_application"))
    keyed = sources.withColumn("_key", F.col("ticker")).withColumn("_name", normalize_name(F.col("company_name")))
    joined = keyed.join(by_key, "_key", "left").join(by_name, "_name", "left")
    return joined.select(*columns(sources.columns), F.coalesce("_offering", "_application").alias("record_id"))


# Document types whose company name is trusted first, in order.
NAME_SOURCE_ORDER = ("approved_prospectus", "investor_sale_announcement")


def resolve_identity(entities: DataFrame, offerings: DataFrame, applications: DataFrame, disclosures: DataFrame) -> DataFrame:
    """Name and key per record id: offering, then application, then self-filed disclosure, then any disclosure, then the id.

    ``offerings``: record_id, company_name, ticker; ``applications``: record_id, company_name; ``disclosures``: record_id,
    document_type, published_at, disclosure_id, company_name, ticker. "First" disclosure is by (published_at, disclosure_id).
    """
    rank = F.lit(len(NAME_SOURCE_ORDER))
    for i, kind in reversed(list(enumerate(NAME_SOURCE_ORDER))):
        rank = F.when(F.col("document_type") == kind, i).otherwise(rank)
    named, coded = _filled(F.col("company_name")), _filled(F.col("ticker"))
    said = disclosures.groupBy("record_id").agg(
        F.min(F.when(named, F.struct(rank.alias("r"), "published_at", "disclosure_id", "company_name"))).alias("_name"),
        F.min(F.when(coded, F.struct("published_at", "disclosure_id", "ticker"))).alias("_code"),
    ).select("record_id", F.col("_name.company_name").alias("_said_name"), F.col("_code.ticker").alias("_said_code"))
    offered = offerings.where(named).groupBy("record_id").agg(F.min(F.struct("company_name", "ticker")).alias("_o"))
    applied = applications.groupBy("record_id").agg(F.min("company_name").alias("_applied_name"))
    all_ = entities.select("record_id").join(offered, "record_id", "left").join(applied, "record_id", "left").join(said, "record_id", "left")
    code = F.when(F.col("_o").isNotNull(), F.coalesce(F.nullif("_o.ticker", F.lit("")), "_said_code")).otherwise(F.col("_said_code"))
    return all_.select(
        "record_id", F.coalesce("_o.company_name", "_applied_name", "_said_name", "record_id").alias("company_name"), code.alias("ticker"))


def attach_application(disclosures: DataFrame, applications: DataFrame, normalize: bool = False) -> DataFrame:
    """First listed application whose name is among an entity's disclosure names (``normalize``: legal forms ignored).

    ``disclosures``: record_id, company_name; ``applications``: application_id, company_name, application_date, position.
    """
    as_name = normalize_name if normalize else match_key
    names = disclosures.where(_filled(F.col("company_name"))).select("record_id", as_name(F.col("company_name")).alias("_name")).distinct()
    first = applications.groupBy(as_name(F.col("company_name")).alias("_name")).agg(
        F.min(F.struct("position", "application_id", "application_date")).alias("_app"))
    hit = names.join(first, "_name").groupBy("record_id").agg(F.min("_app").alias("_app"))
    return hit.select("record_id", "_app.application_id", "_app.application_date")


def missing_required(entities: DataFrame, documents: DataFrame, required: Sequence[str], key: str = "record_id") -> DataFrame:
    """(entity, document_type) pairs still lacking a usable document. ``documents``: key, document_type, usable."""
    have = documents.where(F.col("usable") & F.col("document_type").isin(*required)).groupBy(key).agg(
        F.collect_set("document_type").alias("_have"))
    left = entities.select(key).join(have, key, "left")
    lacking = F.array_except(text_array(required), F.coalesce("_have", F.array().cast("array<string>")))
    return left.select(key, F.explode(lacking).alias("document_type"))


def unseen(records: DataFrame, seen: DataFrame, key: str) -> DataFrame:
    return records.join(seen.select(key), key, "left_anti")


def emit_new(records: DataFrame, seen: DataFrame | None, key: str, send_existing: bool = False) -> tuple[DataFrame, DataFrame]:
    """(records to announce, keys to remember). ``seen`` None is a first run: remember all, announce none unless asked."""
    keys = records.select(key).distinct()
    if seen is None:
        return (records if send_existing else records.limit(0)), keys
    return unseen(records, seen, key), seen.select(key).unionByName(keys).distinct()


def fallback_fill(primary: DataFrame, fallback: DataFrame, keys: Sequence[str], status: str = "status") -> DataFrame:
    """Field by field the fallback row, only where the primary has none or is not_found; a conflict is left alone."""
    rest = [c for c in primary.columns if c not in keys]
    p = primary.select(*columns(keys), F.struct(*columns(rest)).alias("_p"))
    f = fallback.select(*columns(keys), F.struct(*columns(rest)).alias("_f"))
    both = p.join(f, list(keys), "full")
    keep = F.col("_p").isNotNull() & ((F.col("_p")[status] != "not_found") | F.col("_f").isNull())
    return both.select(*columns(keys), F.when(keep, F.col("_p")).otherwise(F.col("_f")).alias("_row")).select(*columns(keys), "_row.*")


def skip_known_content(documents: DataFrame, known: DataFrame, types: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """(accepted, duplicates of known content). In list order one document per (entity, type), never the same bytes twice.

    ``documents``: entity_id, document_type, position, doc_id, content; ``known``: content_hash. Of one type only the
    first len(types) distinct contents can matter, because each other type blocks at most one, so at most
    len(types) squared rows per entity reach the in-order pass.
    """
    limit = len(types)
    hashed = documents.where(F.col("document_type").isin(*types)).withColumn("content_hash", F.sha2(F.col("content"), 256)).drop("content")
    seen = known.select("content_hash").distinct()
    duplicates = hashed.join(seen, "content_hash", "left_semi").select("entity_id", "document_type", "doc_id", "content_hash")
    fresh = hashed.join(seen, "content_hash", "left_anti")
    once = fresh.groupBy("entity_id", "document_type", "content_hash").agg(F.min(F.struct("position", "doc_id")).alias("_first"))
    place = Window.partitionBy("entity_id", "document_type").orderBy("_first")
    few = once.withColumn("_n", F.row_number().over(place)).where(F.col("_n") <= limit)
    queue = few.groupBy("entity_id").agg(F.array_sort(F.collect_list(
        F.struct("_first.position", "_first.doc_id", "document_type", "content_hash"))).alias("_queue"))
    row = "array<struct<position:bigint,doc_id:string,document_type:string,content_hash:string>>"
    queue = queue.withColumn("_queue", F.col("_queue").cast(row))

    def take(done: Column, item: Column) -> Column:
        blocked = F.exists(done, lambda x: (x["document_type"] == item["document_type"]) | (x["content_hash"] == item["content_hash"]))
        return F.when(blocked, done).otherwise(F.array_append(done, item))

    accepted = queue.select("entity_id", F.inline(F.aggregate("_queue", F.array().cast(row), take)))
    return accepted, duplicates


def validate_citations(outputs: DataFrame, allowed: DataFrame) -> DataFrame:
    """Cited (output, document, page) that were not supplied to that output. ``outputs``: output_id, citations array."""
    cited = outputs.select("output_id", F.explode("citations").alias("_c")).select("output_id", "_c.doc_id", "_c.page_no")
    return cited.join(allowed.select("output_id", "doc_id", "page_no"), ["output_id", "doc_id", "page_no"], "left_anti")


def validate_grounding(claims: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """Claims holding no term of their entity's vocabulary; an empty vocabulary allows no claim.

    ``claims``: entity_id, claim; ``vocabulary``: entity_id, term, of any size: terms stay rows and are never gathered per entity.
    """
    terms = vocabulary.where(_filled(F.col("term"))).select(F.col("entity_id").alias("_of"), fold_text(F.col("term")).alias("_term")).distinct()
    said = (F.col("entity_id") == F.col("_of")) & F.contains(fold_text(F.col("claim")), F.col("_term"))
    return claims.join(terms, said, "left_anti")
