"""Two table jobs over records: standardize columns and classify rows. Both only add columns, in one pass."""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pitlake import fixed_values as fixed
from pitlake.functions import numbers, text
from pitlake.tables import computed_once

STANDARDS = {
    "fold": text.fold_text,
    "name": text.normalize_name,
    "single_token": text.single_token,
    "subject_key": text.subject_key,
    "part_number": text.part_number,
    "summary_or_title": text.summary_or_title,
    "entity_key": text.entity_key,
    "application_key": text.application_key,
    "number": numbers.parse_number,
    "signed_number": numbers.parse_signed_number,
    "date": numbers.parse_dotted_date,
    "month_name_date": numbers.parse_month_name_date,
    "period_start": numbers.parse_period_start,
    "series_date": numbers.parse_series_date,
}


def standardize_records(df: DataFrame, spec: Mapping[str, tuple[str, Sequence[str]]]) -> DataFrame:
    """Add one column per entry: name -> (standard, input columns)."""
    return df.select("*", *[STANDARDS[kind](*[F.col(c) for c in inputs]).alias(name) for name, (kind, inputs) in spec.items()])


def title_class(title: Column) -> Column:
    return text.classify_with_veto(
        text.fold_text(title), fixed.TITLE_RULES, "other", "price_determination_report", fixed.REVIEW_MARKERS, "price_determination_review")


MOST_RULES = 10_000
RULE = "struct<rule_order:long,pattern:string,label:string,veto:array<string>,veto_label:string>"


def classify_by_table(df: DataFrame, text_column: str, rules: DataFrame, name: str, default: str = "other") -> DataFrame:
    """``df`` with the label of the first rule of a table that hits the folded text; one pass, no join.

    ``rules``: rule_order, pattern, is_regex, label, veto (markers, may be null or empty), veto_label; at most ``MOST_RULES`` rows, or it fails. Order is by
    rule_order, then pattern. Patterns and markers are read as folded text, regular expressions with Unicode classes. Plain rules are one constant array,
    tried in a higher-order function; regular expressions, compiled once a task, are tried one after the other only where no earlier plain rule has hit.
    A winner whose text holds one of its veto markers gives ``veto_label``. A null text, or one that no rule hits, is ``default``; rules with a null
    pattern or order are left out.
    """
    usable = rules.where("pattern is not null and rule_order is not null").orderBy("rule_order", "pattern")
    listed = usable.select(F.col("rule_order").cast("long"), "pattern", "is_regex", "label", "veto", "veto_label").limit(MOST_RULES + 1).collect()
    if len(listed) > MOST_RULES:
        raise ValueError(f"more than {MOST_RULES} rules")
    entries = [{"rule_order": i, "pattern": r["pattern"], "label": r["label"], "veto": r["veto"] or [], "veto_label": r["veto_label"]} for i, r in enumerate(listed)]
    plain = F.from_json(F.lit(json.dumps([e for e, r in zip(entries, listed, strict=True) if not r["is_regex"]])), f"array<{RULE}>")
    folded = F.col("_folded")
    hit = F.try_element_at(F.filter(plain, lambda rule: F.contains(folded, rule["pattern"])), F.lit(1))
    with_plain = computed_once(computed_once(df, "_folded", text.fold_text(F.col(text_column))), "_plain", hit)
    order = F.coalesce(F.col("_plain.rule_order"), F.lit(len(entries)))
    winner = F.col("_plain")
    for e, r in reversed([(e, r) for e, r in zip(entries, listed, strict=True) if r["is_regex"]]):
        ruled = F.from_json(F.lit(json.dumps(e)), RULE)
        winner = F.when((order > e["rule_order"]) & folded.rlike("(?U)" + e["pattern"]), ruled).otherwise(winner)
    told = computed_once(with_plain, "_winner", winner)
    vetoed = F.exists("_winner.veto", lambda marker: F.contains(folded, marker))
    label = F.when(vetoed, F.col("_winner.veto_label")).otherwise(F.col("_winner.label"))
    return told.select(*df.columns, F.when(F.col("_winner").isNull(), default).otherwise(label).alias(name))


def link_class(link_text: Column) -> Column:
    by_title = title_class(link_text)
    rules = [("(?U)" + p, label) for p, label in fixed.LINK_RULES]
    return F.when(by_title != "other", by_title).otherwise(text.first_rule(text.fold_text(link_text), rules, "other", regex=True))


def prospectus_role(summary: Column, title: Column) -> Column:
    return text.document_role(text.summary_or_title(summary, title), fixed.PROSPECTUS_STEM, "(?U)" + fixed.APPENDIX_PATTERN, fixed.APPENDIX_KEYWORDS)


def attachment_role(file_name: Column) -> Column:
    return text.first_rule(text.fold_text(file_name), fixed.ATTACHMENT_RULES, "primary_candidate")


def sector_of(name: Column) -> Column:
    folded = text.fold_text(name)
    rules = [("(?U)" + p, label) for p, label in fixed.SECTOR_RULES]
    return F.when(F.coalesce(name, F.lit("")) == "", "unknown").otherwise(text.first_rule(folded, rules, "standard", regex=True))


def not_applicable(sector: Column, item: Column, matrix: Mapping[str, Sequence[str]]) -> Column:
    hit = F.lit(False)
    for name, items in matrix.items():
        hit = hit | ((sector == name) & item.isin(*items))
    return F.coalesce(hit, F.lit(False))


def is_withdrawal(title: Column) -> Column:
    return text.contains_any(text.fold_text(title), fixed.WITHDRAWAL_WORDS)


CLASSES = {
    "title_class": title_class,
    "link_class": link_class,
    "prospectus_role": prospectus_role,
    "attachment_role": attachment_role,
    "sector": sector_of,
    "withdrawal": is_withdrawal,
}


def classify_records(df: DataFrame, spec: Mapping[str, tuple[str, Sequence[str]]]) -> DataFrame:
    """Add one label column per entry: name -> (classification, input columns)."""
    return df.select("*", *[CLASSES[kind](*[F.col(c) for c in inputs]).alias(name) for name, (kind, inputs) in spec.items()])


def withdrawal_flags(documents: DataFrame, key: str) -> DataFrame:
    """Per entity: does any document title speak of withdrawal, cancellation or suspension."""
    return documents.groupBy(key).agg(F.coalesce(F.bool_or(is_withdrawal(F.col("title"))), F.lit(False)).alias("withdrawn"))


def pick_primary(attachments: DataFrame, key: str) -> DataFrame:
    """First attachment (by position) whose file name gives it no other role; an entity without one is absent.

    ``attachments``: key, position, file_name.
    """
    candidates = attachments.where(attachment_role(F.col("file_name")) == "primary_candidate")
    first = candidates.groupBy(key).agg(F.min(F.struct("position", "file_name")).alias("_first"))
    return first.select(key, "_first.position", "_first.file_name")
