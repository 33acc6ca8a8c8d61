"""Record profiling, validation, quarantine, merge and completeness checks.

Everything per record is row-local; the rest are aggregations with map-side partial combine.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pitlake.functions.numbers import parse_series_date
from pitlake.tables import columns, computed_once, text_array


def profile_table(df: DataFrame) -> DataFrame:
    """One pass over all columns: row count, nulls, always-null flag and type per column."""
    counts = df.agg(F.count(F.lit(1)).alias("_rows"), *[F.count(F.col(c)).alias(c) for c in df.columns])
    cells = [
        F.struct(
            F.lit(f.name).alias("column_name"), F.lit(f.dataType.simpleString()).alias("observed_type"),
            F.col("_rows").alias("row_count"), (F.col("_rows") - F.col(f.name)).alias("null_count"),
            ((F.col(f.name) == 0) & (F.col("_rows") > 0)).alias("always_null"),
        )
        for f in df.schema.fields
    ]
    return counts.select(F.inline(F.array(*cells)))


def json_kind(variant: Column) -> Column:
    """JSON type of a VARIANT value: object, array, string, boolean, integer, number or null."""
    kinds = F.create_map(*[F.lit(x) for pair in (("OBJECT", "object"), ("ARRAY", "array"), ("STRING", "string"), ("BOOLEAN", "boolean"),
                                                ("VOID", "null"), ("BIGINT", "integer")) for x in pair])
    kind = F.regexp_substr(F.schema_of_variant(variant), F.lit("^[A-Z]+"))
    return F.when(variant.isNotNull(), F.coalesce(F.try_element_at(kinds, kind), F.lit("number")))


def profile_json(df: DataFrame, json: str) -> DataFrame:
    """Per key of JSON object records: presence, nulls and the sorted set of observed types."""
    spark = df.sparkSession
    parsed = df.select(F.parse_json(json).alias("_doc"))
    pairs = parsed.lateralJoin(spark.tvf.variant_explode(F.col("_doc").outer())).select("key", json_kind(F.col("value")).alias("kind"))
    kinds = pairs.groupBy("key", "kind").agg(F.count(F.lit(1)).alias("n"))
    per_key = kinds.groupBy("key").agg(
        F.sum("n").alias("present_count"),
        F.sum(F.when(F.col("kind") == "null", F.col("n")).otherwise(0)).alias("null_count"),
        F.array_sort(F.collect_set("kind")).alias("types"),
    )
    total = df.agg(F.count(F.lit(1))).scalar()
    return per_key.withColumn("record_count", total).select(
        "key", "record_count", "present_count", (F.col("record_count") - F.col("present_count")).alias("missing_count"),
        "null_count", (F.col("null_count") == F.col("present_count")).alias("always_null"), "types",
    )


def duplicate_rows(df: DataFrame) -> DataFrame:
    """Whole records that occur more than once, with their count."""
    return df.groupBy(*columns(df.columns)).agg(F.count(F.lit(1)).alias("copies")).where(F.col("copies") > 1)


def identity_candidates(df: DataFrame) -> DataFrame:
    """Per column: distinct non-null values, how many repeat, and the least repeated value. Reports, never decides."""
    cells = [F.struct(F.lit(c).alias("column_name"), F.col(c).cast("string").alias("cell")) for c in df.columns]
    values = df.select(F.inline(F.array(*cells))).where(F.col("cell").isNotNull())
    counted = values.groupBy("column_name", "cell").agg(F.count(F.lit(1)).alias("n"))
    repeated = F.col("n") > 1
    return counted.groupBy("column_name").agg(
        F.count(F.lit(1)).alias("distinct_values"), F.count_if(repeated).alias("duplicated_values"),
        F.min(F.when(repeated, F.col("cell"))).alias("example_value"),
    ).where(F.col("duplicated_values") > 0)


def compare_ordering(first: DataFrame, second: DataFrame, position: str) -> DataFrame:
    """Are two fetches the same records in the same order? ``position`` is the explicit place in the fetch."""
    def side(df, name):
        rest = [c for c in df.columns if c != position]
        return df.select(F.col(position).alias("_at"), F.struct(*columns(rest)).alias(name))

    both = side(first, "_a").join(side(second, "_b"), "_at", "full")
    counted = both.agg(
        F.count("_a").alias("first_count"), F.count("_b").alias("second_count"),
        F.min(F.when(~F.col("_a").eqNullSafe(F.col("_b")), F.col("_at"))).alias("first_divergence"),
    )
    return counted.select(
        "first_count", "second_count", (F.col("first_count") == F.col("second_count")).alias("same_length"),
        F.col("first_divergence").isNull().alias("stable"),
        F.when(F.col("first_count") == F.col("second_count"), F.col("first_divergence")).alias("first_divergence"),
    )


# Which observed JSON kinds satisfy a documented type.
KINDS_OF_TYPE = {
    "string": ("string",), "integer": ("integer",), "number": ("integer", "number"),
    "boolean": ("boolean",), "array": ("array",), "object": ("object",),
}


def validate_schema(df: DataFrame, key: str, json: str, fields: Sequence[tuple[str, str, bool]]) -> DataFrame:
    """Issues per JSON record against documented (field, type, nullable); row-local, no shuffle."""
    doc = F.col("_doc")
    is_object = F.coalesce(json_kind(doc) == "object", F.lit(False))
    names = [f[0] for f in fields]
    keys = F.coalesce(F.json_object_keys(json), F.array().cast("array<string>"))
    issues = []
    for i, (name, kind, nullable) in enumerate(fields):
        found = F.col("_kinds")[i]
        wrong = (
            F.when(~F.array_contains("_keys", name), "missing_documented_field")
            .when((found == "null") & F.lit(not nullable), "unexpected_null")
            .when((found != "null") & ~found.isin(*KINDS_OF_TYPE[kind]), "type_mismatch")
        )
        issues.append(F.struct(F.lit(name).alias("field_name"), wrong.alias("issue")))
    extra = F.transform(
        F.array_except("_keys", text_array(names)),
        lambda k: F.struct(k.alias("field_name"), F.lit("undocumented_field").alias("issue")),
    )
    broken = F.array(F.struct(F.lit("<record>").alias("field_name"), F.lit("not_an_object").alias("issue")))
    listed = F.when(F.col("_object"), F.concat(F.array(*issues), extra)).otherwise(broken)
    kinds = F.array(*[json_kind(F.try_variant_get(doc, f"$.{f[0]}", "variant")) for f in fields])
    parsed = computed_once(df.select(key, json), "_doc", F.try_parse_json(json))
    prepared = computed_once(parsed.select(key, is_object.alias("_object"), keys.alias("_keys"), "_doc"), "_kinds", kinds)
    return prepared.select(key, F.inline_outer(listed)).where(F.col("issue").isNotNull())


def fields_never_observed(df: DataFrame, json: str, fields: Sequence[tuple[str, str, bool]]) -> DataFrame:
    """Documented fields that no record carries, over all rows."""
    keys = F.json_object_keys(json)
    seen = df.agg(*[F.coalesce(F.bool_or(F.array_contains(keys, f[0])), F.lit(False)).alias(f[0]) for f in fields])
    cells = [F.struct(F.lit(f[0]).alias("field_name"), F.col(f[0]).alias("_seen")) for f in fields]
    return seen.select(F.inline(F.array(*cells))).where(~F.col("_seen")).select("field_name")


def with_reject_reason(df: DataFrame, rules: Sequence[tuple[Column, str]]) -> DataFrame:
    """Adds ``reason``: the first rule a row breaks, NULL for a good row. One bad row never loses the rest."""
    reason = F.lit(None).cast("string")
    for broken, text in reversed(rules):
        reason = F.when(F.coalesce(broken, F.lit(True)), text).otherwise(reason)
    return df.withColumn("reason", reason)


def quarantine(df: DataFrame, rules: Sequence[tuple[Column, str]]) -> tuple[DataFrame, DataFrame]:
    judged = with_reject_reason(df, rules)
    return judged.where(F.col("reason").isNull()).drop("reason"), judged.where(F.col("reason").isNotNull())


def duplicate_names(df: DataFrame, name: str, date: str) -> DataFrame:
    """Names on more than one row: counts, first and last date, and rows per date (bounded by the calendar)."""
    per_date = df.groupBy(name, date).agg(F.count(F.lit(1)).alias("n"))
    return per_date.groupBy(name).agg(
        F.sum("n").alias("row_count"), F.min(date).alias("first_date"), F.max(date).alias("last_date"),
        F.array_sort(F.collect_list(F.struct(F.col(date).alias("date"), "n"))).alias("dates"),
    ).where(F.col("row_count") > 1)


def application_report(judged: DataFrame, name: str, date: str) -> DataFrame:
    """Totals over rows with a ``reason`` column, and the earliest and latest good row."""
    good = F.col("reason").isNull()
    when_good = F.struct(date, name)
    return judged.agg(
        F.count(F.lit(1)).alias("total_rows"), F.count_if(good).alias("valid_rows"), F.count_if(~good).alias("invalid_rows"),
        F.min(F.when(good, when_good)).alias("_first"), F.max(F.when(good, when_good)).alias("_last"),
    ).select(
        "total_rows", "valid_rows", "invalid_rows", F.col("_first")[date].alias("earliest_date"), F.col("_first")[name].alias("earliest_name"),
        F.col("_last")[date].alias("latest_date"), F.col("_last")[name].alias("latest_name"),
    )


def flatten_wide_series(df: DataFrame, raw_date: str, spec: Sequence[tuple[str, str, str, str]]) -> DataFrame:
    """Wide date-by-series rows to points. ``spec``: (series, column, frequency, unit); bad cells are skipped singly."""
    cells = [
        F.struct(
            F.lit(series).alias("series"), parse_series_date(F.col(raw_date), F.lit(frequency)).alias("obs_date"),
            F.col(column).try_cast("double").alias("value"), F.lit(unit).alias("unit"), F.lit(frequency).alias("frequency"),
        )
        for series, column, frequency, unit in spec
    ]
    points = df.select(F.inline(F.array(*cells)))
    return points.where(F.col("obs_date").isNotNull() & F.col("value").isNotNull())


def new_first_writes(target: DataFrame, incoming: DataFrame, key: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Incoming rows whose key the target lacks; of several per key the first by ``order``. Nothing is overwritten."""
    first = incoming.groupBy(*columns(key)).agg(F.min_by(F.struct("*"), F.struct(*columns(order))).alias("_row")).select("_row.*")
    return first.join(target.select(*columns(key)), list(key), "left_anti").select(*columns(incoming.columns))


def dedup_last_wins(df: DataFrame, key: Sequence[str], order: Sequence[str]) -> DataFrame:
    """One row per key, the latest by ``order``; partial max before the shuffle."""
    return df.groupBy(*columns(key)).agg(F.max_by(F.struct("*"), F.struct(*columns(order))).alias("_row")).select("_row.*")


def summarize_dataset(snapshots: DataFrame, dimensions: Sequence[str], measures: Sequence[str]) -> DataFrame:
    """Counts by each dimension value and coverage of each measure, in one job."""
    cells = [F.struct(F.lit(d).alias("dimension"), F.col(d).cast("string").alias("value")) for d in dimensions]
    cells += [F.struct(F.lit(f"covered:{m}").alias("dimension"), F.col(m).isNotNull().cast("string").alias("value")) for m in measures]
    cells.append(F.struct(F.lit("total").alias("dimension"), F.lit("all").alias("value")))
    return snapshots.select(F.inline(F.array(*cells))).where(F.col("value").isNotNull()).groupBy("dimension", "value").agg(
        F.count(F.lit(1)).alias("n"))


def top_reasons(hits: DataFrame, reason: str, k: int = 10) -> DataFrame:
    counted = hits.groupBy(reason).agg(F.count(F.lit(1)).alias("n"))
    return counted.orderBy(F.col("n").desc(), F.col(reason)).limit(k)

