"""Point-in-time reconstruction: when a decision was due, what was knowable then, and proof that nothing later leaked in."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pitlake.session import stage
from pitlake.tables import columns

# Days around an offering's life.
BEFORE_APPLICATION, BEFORE_PERIOD, AFTER_LISTING, MAX_WINDOW = 60, 180, 30, 400


def resolve_cutoff(entities: DataFrame, evidence: DataFrame) -> DataFrame:
    """First tier with any evidence is final: one date resolves, several conflict (no fall-through), none is missing.

    ``evidence``: entity_id, tier, cutoff_date, doc_id, source. What is collected per entity is one row per (tier, date),
    bounded by the tiers and the calendar.
    """
    per_date = evidence.groupBy("entity_id", "tier", "cutoff_date").agg(F.min("doc_id").alias("doc_id"), F.min_by("source", "doc_id").alias("source"))
    dates = per_date.groupBy("entity_id").agg(F.min("tier").alias("tier"), F.array_sort(F.collect_list(
        F.struct("tier", "cutoff_date", "doc_id", "source"))).alias("_all"))
    top = dates.withColumn("_top", F.filter("_all", lambda x: x["tier"] == F.col("tier")))
    joined = entities.select("entity_id").join(top.select("entity_id", "tier", "_top"), "entity_id", "left")
    one = F.size("_top") == 1
    only = F.try_element_at("_top", F.lit(1))
    return joined.select(
        "entity_id", F.when(F.col("_top").isNull(), "missing").when(one, "resolved").otherwise("conflicting").alias("cutoff_status"),
        F.when(one, only["cutoff_date"]).alias("cutoff_date"), F.when(one, only["source"]).alias("cutoff_source"),
        F.when(one, only["doc_id"]).alias("evidence_doc_id"),
        F.coalesce(F.transform("_top", lambda x: x["cutoff_date"]), F.array().cast("array<date>")).alias("candidate_dates"))


def end_of_day(day: Column) -> Column:
    """23:59:59 of the day, wall clock."""
    return day.cast("timestamp_ntz") + F.expr("INTERVAL '23:59:59' HOUR TO SECOND")


def as_of_filter(records: DataFrame, cutoffs: DataFrame, ts: str, key: str = "entity_id") -> DataFrame:
    """Records with ``considered``: dated no later than the end of their entity's cutoff day. No cutoff excludes all.

    Considered and excluded ids stay rows, so an entity of any size is never gathered into one value.
    """
    days = cutoffs.select(key, F.col("cutoff_date").alias("_cutoff"))
    joined = records.join(days, key, "left")
    return joined.select(*columns(records.columns), F.coalesce(F.col(ts) <= end_of_day(F.col("_cutoff")), F.lit(False)).alias("considered"))


def leak_check(considered: DataFrame, cutoffs: DataFrame, ts: str, key: str = "entity_id") -> DataFrame:
    """Considered records later than their cutoff day or without a cutoff; must be empty."""
    days = cutoffs.select(key, F.col("cutoff_date").alias("_cutoff"))
    joined = considered.where("considered").join(days, key, "left")
    return joined.where(~F.coalesce(F.col(ts) <= end_of_day(F.col("_cutoff")), F.lit(False))).select(*columns(considered.columns))


def changed_value(column: str, kind: T.DataType) -> Column:
    """Another value of the same type: numbers one up, texts longer, flags turned, times a day on; NULL becomes a value. Nested values stay."""
    value = F.col(column)
    if isinstance(kind, T.NumericType):
        return F.coalesce(F.try_add(value, F.lit(1).cast(kind)), F.lit(0)).cast(kind)
    if isinstance(kind, T.StringType):
        return F.concat(F.coalesce(value, F.lit("")), F.lit("~"))
    if isinstance(kind, T.BooleanType):
        return ~F.coalesce(value, F.lit(False))
    if isinstance(kind, T.DateType):
        return F.date_add(value, 1)
    return value


def without_future(records: DataFrame, cutoffs: DataFrame, ts: str, key: str) -> DataFrame:
    """Only what is considered at the cutoff."""
    return as_of_filter(records, cutoffs, ts, key).where("considered").drop("considered")


def with_changed_future(records: DataFrame, cutoffs: DataFrame, ts: str, key: str) -> DataFrame:
    """Every row that is not considered with other values in all columns but its key and time."""
    judged = as_of_filter(records, cutoffs, ts, key)
    return judged.select(*[
        F.col(f.name) if f.name in (key, ts) else F.when(F.col("considered"), F.col(f.name)).otherwise(changed_value(f.name, f.dataType)).alias(f.name) for f in records.schema])


PERTURBATIONS = {"future dropped": without_future, "future changed": with_changed_future}


def content_hashes(rows: DataFrame, key: str) -> DataFrame:
    """key, content: a hash of an entity's rows in any order, repeats counted."""
    row = F.to_json(F.struct(*[F.col(c) for c in sorted(rows.columns)]), {"ignoreNullFields": "false"})
    hashed = rows.select(key, F.xxhash64(row).alias("_a"), F.xxhash64(row, F.lit(1)).cast("decimal(38,0)").alias("_b"))
    return hashed.groupBy(key).agg(F.sha2(F.concat_ws(" ", F.count(F.lit(1)), F.bit_xor("_a"), F.sum("_b")), 256).alias("content"))


def leak_check_rebuild(
    inputs: Mapping[str, DataFrame], cutoffs: DataFrame, rebuild: Callable[[Mapping[str, DataFrame]], DataFrame], ts: str | Mapping[str, str], key: str = "entity_id",
    perturbations: Mapping[str, Callable[[DataFrame, DataFrame, str, str], DataFrame]] = PERTURBATIONS,
) -> DataFrame:
    """Entities whose result depends on what came after their cutoff: key, perturbation. Must be empty.

    A test by running twice: ``rebuild`` makes the results from all ``inputs``, then again from inputs in which everything after the end of an entity's
    cutoff day (all of it, without a cutoff) has gone, and once more with other values there. Whatever then differs for an entity, as told by a hash of its
    rows, has leaked; an entity that comes or goes differs too. It sees leaks by any way, where :func:`leak_check` sees rows that were let in. ``ts`` names
    the time column, for all inputs or for each; inputs without one there are passed on as they are. Results are compared by null-safe key.
    """
    times = {name: ts if isinstance(ts, str) else ts.get(name) for name in inputs}
    plain = content_hashes(rebuild(inputs), key).select(F.col(key).alias("_key"), F.col("content").alias("_before"))
    plain = stage(plain, "rebuilt")
    found = None
    for name, perturb in perturbations.items():
        altered = {n: perturb(df, cutoffs, times[n], key) if times[n] else df for n, df in inputs.items()}
        again = content_hashes(rebuild(altered), key)
        both = plain.join(again, F.col(key).eqNullSafe(F.col("_key")), "full")
        entity = F.when(F.col("_before").isNull(), F.col(key)).otherwise(F.col("_key"))
        differs = both.where(~F.col("_before").eqNullSafe(F.col("content"))).select(entity.alias(key), F.lit(name).alias("perturbation"))
        found = differs if found is None else found.unionByName(differs)
    return found


def lifecycle_window(entities: DataFrame, reference_date) -> DataFrame:
    """Dates within which an offering's documents appear; ``entities``: application_date, period_start, listing_date."""
    ref = F.lit(reference_date).cast("date")
    upper = F.least(F.date_add("listing_date", AFTER_LISTING), ref)
    earliest = F.least(F.date_sub("application_date", BEFORE_APPLICATION), F.date_sub("period_start", BEFORE_PERIOD))
    widest = F.date_sub(upper, MAX_WINDOW)
    return entities.withColumn("window_from", F.greatest(earliest, widest)).withColumn("window_to", upper)
