"""Choosing which sections to read: ordered selection under a text budget, and candidate ranking."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pitlake.fixed_values import CATEGORY_KEYWORDS, SECTION_CHARS, TOTAL_CHARS
from pitlake.functions.text import contains_any, fold_text
from pitlake.operators.prefix import running_sums
from pitlake.operators.ranks import grouped_row_number
from pitlake.session import stage
from pitlake.tables import computed_once


def budgeted_selection(
    items: DataFrame,
    order: Sequence[str],
    categories: Sequence[tuple[str, Sequence[str]]] = CATEGORY_KEYWORDS,
    section_chars: int = SECTION_CHARS,
    total_chars: int = TOTAL_CHARS,
    slices: int | None = None,
) -> DataFrame:
    """Categorized sections per entity in order, until the next would pass the budget; then stop, with no skipping ahead.

    ``items``: entity_id, text and the order columns. Sections are cut once and written; their lengths alone are summed in slices of the order, so an
    entity of any size spreads over tasks, and slices that start past the budget are left unread. A section that fits nowhere in the budget ends the
    entity. Equal order values are taken by section text. A null entity is an entity of its own.
    """
    category = F.lit(None).cast("string")
    for name, words in reversed(categories):
        category = F.when(contains_any(F.col("_folded"), words), name).otherwise(category)
    folded = computed_once(items, "_folded", fold_text(F.col("text")))
    named = computed_once(folded, "category", category).where(F.col("category").isNotNull())
    section = F.left(F.regexp_replace("text", r"(?U)^\s+|\s+$", ""), F.lit(section_chars))
    cut = named.withColumn("section", section).drop("_folded", "text").where(F.length("section") > 0)
    sections = stage(cut.withColumn("_row", F.monotonically_increasing_id()), "sections")
    lengths = sections.select("entity_id", *order, F.xxhash64("section").alias("_tie"), "_row", F.length("section").cast("bigint").alias("_chars"))
    kept = running_sums(lengths, ["entity_id"], [*order, "_tie", "_row"], {"chars_so_far": F.col("_chars")}, ("chars_so_far", total_chars), slices)
    return sections.join(kept.select("_row", "chars_so_far"), "_row").drop("_row")


def rank_candidates(documents: DataFrame, key: str = "entity_id") -> DataFrame:
    """Numbered parts first, highest number first, then publish time. ``documents``: key, doc_id, part_number, published_at."""
    dated = documents.withColumn("_month", F.date_trunc("MONTH", "published_at"))
    part = F.col("part_number").desc_nulls_last()
    ranked = grouped_row_number(dated, [key], ["part_number", "_month"], [part, F.col("_month")], [F.col("published_at"), F.col("doc_id")], "candidate_rank")
    return ranked.drop("_month")
