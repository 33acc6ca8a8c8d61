"""How document filters interact: what each removes, repeats and costs at every place of every order they could be applied in.

Documents are reduced to mask cells: per part and set of failed filters (one bit a letter) their count, the good and the toxic ones. A recursive CTE
starts from the masks that occur and extends filter prefixes by every unused letter, carrying the bits applied so far; each level emits what its
step does to each mask. Counts of the cells turn that into the step's metrics, and every full order takes those of its prefixes. The recursion holds
masks and prefixes, never documents or parts: five filters give at most 32 * 326 rows, whatever the corpus.

A copy (``duplicate`` letter) is told by SHA-256 of the text over the whole table. Copies share every other bit, so the smallest id of a text is found
by grouping, with partial sums in the map tasks, and no group of copies is ever joined to itself.

Cases: a null text is empty, a null part the empty string; texts of any length are read whole. Of equal texts the smallest doc_id passes, on every row
that has it; rows with a null doc_id have no smaller one, pass and are no earlier copy for others. Repeated rows of ``labels`` count once, any 1 wins;
null ids and documents without labels are neither good nor toxic. An empty table has no parts and gives no rows. Other columns are not read, whatever
their names.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pitlake.session import stage
from pitlake.tables import literal_table

SPACES = r"[\x20\x09-\x0D]+"
MOST_FILTERS = 6  # prefixes grow with the factorial of their number


def words(text: Column) -> Column:
    return F.array_remove(F.split(text, SPACES), "")


def few_words(text: Column, least: int = 200) -> Column:
    return F.size(words(text)) < least


def repetitive(text: Column, percent: int = 50) -> Column:
    return F.size(F.array_distinct(words(text))) * 100 < F.size(words(text)) * percent


def shouting(text: Column, percent: int = 3) -> Column:
    return F.length(F.regexp_replace(text, "[^A-Z]+", "")) * 100 > F.length(text) * percent


def symbols(text: Column) -> Column:
    return text.rlike(r"[#$%&*|]")


FAILURES: dict[str, Callable[[Column], Column]] = {"A": few_words, "B": repetitive, "C": shouting, "D": symbols}


def mask_cells(docs: DataFrame, labels: DataFrame, failures: Mapping[str, Callable[[Column], Column]] = FAILURES, part: str = "lang") -> DataFrame:
    """part, mask, n, good, toxic: documents by part and failed filters. The bit after those of ``failures`` marks copies of a smaller doc_id."""
    text = F.coalesce(F.col("text"), F.lit(""))
    mask = sum((F.when(fails(text), F.lit(1 << k)).otherwise(0) for k, fails in enumerate(failures.values())), F.lit(0))
    copy_bit = 1 << len(failures)
    rows = stage(docs.select("doc_id", F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"), mask.cast("int").alias("mask"), F.unhex(F.sha2(text, 256)).alias("digest")), "measured")
    flags = labels.where("doc_id is not null").groupBy("doc_id").agg(
        F.max(F.coalesce(F.col("quality") == 1, F.lit(False))).alias("good"), F.max(F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("toxic"))
    no = F.lit(False)
    labelled = rows.where("doc_id is not null").join(flags, "doc_id", "left").unionByName(rows.where("doc_id is null"), allowMissingColumns=True)
    flagged = labelled.withColumn("good", F.coalesce("good", no)).withColumn("toxic", F.coalesce("toxic", no))
    text_keys = ["digest", "mask", "part", "good", "toxic"]
    by_id = flagged.groupBy("doc_id", *text_keys).agg(F.count(F.lit(1)).alias("n"))
    unnumbered = F.sum(F.when(F.col("doc_id").isNull(), F.col("n")).otherwise(0))
    by_text = by_id.groupBy(*text_keys).agg(F.sum("n").alias("n"), F.min(F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "n"))).alias("first"), unnumbered.alias("unnumbered"))
    earliest = by_text.withColumn("earliest", F.min("first.doc_id").over(Window.partitionBy("digest")))
    passing = F.col("unnumbered") + F.when(F.col("first.doc_id") == F.col("earliest"), F.col("first.n")).otherwise(0)
    both = F.array(F.struct(F.col("mask"), passing.alias("n")), F.struct(F.col("mask").bitwiseOR(F.lit(copy_bit)).alias("mask"), (F.col("n") - passing).alias("n")))
    split = earliest.select("part", "good", "toxic", F.inline(both)).where("n > 0")
    return split.groupBy("part", "mask").agg(
        F.sum("n").alias("n"), F.sum(F.when(F.col("good"), F.col("n")).otherwise(0)).alias("good"), F.sum(F.when(F.col("toxic"), F.col("n")).otherwise(0)).alias("toxic"))


WALK = """
with recursive walk(prefix, step, before, bit, mask) as (
  select cast('' as string), 0, 0, 0, mask from (select distinct mask from {cells})
  union all
  select concat(w.prefix, f.letter), w.step + 1, w.before | w.bit, f.bit, w.mask
  from walk w join {filters} f on ((w.before | w.bit) & f.bit) = 0)
select prefix, step, mask,
  (mask & (before | bit)) = 0 as kept, (mask & bit) <> 0 and (mask & before) = 0 as removed,
  (mask & bit) <> 0 and (mask & before) <> 0 as redundant, mask = bit as alone
from walk where step > 0"""


def orders(cells: DataFrame, letters: str) -> DataFrame:
    """part, filter_order, step and metrics of every step of every order of the filters; ``letters`` name the bits of the masks from the lowest."""
    if len(letters) > MOST_FILTERS or len(set(letters)) < len(letters):
        raise ValueError(f"at most {MOST_FILTERS} filters of different letters, not {letters!r}")
    spark = cells.sparkSession
    filters = literal_table(spark, [(letter, 1 << k) for k, letter in enumerate(letters)], ("letter", "bit"), ("string", "int"))
    walked = stage(spark.sql(WALK, cells=cells, filters=filters), "walk")  # bounded by masks x prefixes

    def total(flag: str, column: str, name: str) -> Column:
        return F.sum(F.when(F.col(flag), F.col(column)).otherwise(0)).cast("long").alias(name)

    metrics = cells.join(F.broadcast(walked), "mask").groupBy("part", "prefix").agg(
        total("kept", "n", "kept"), total("removed", "n", "removed"), total("redundant", "n", "redundant"), total("alone", "n", "unique_fails"),
        total("removed", "good", "good_lost"), total("removed", "toxic", "toxic_lost"))
    full = walked.where(F.col("step") == len(letters)).select(F.col("prefix").alias("filter_order")).distinct()
    places = full.select("filter_order", F.explode(F.sequence(F.lit(1), F.lit(len(letters)))).alias("step"))
    steps = metrics.join(F.broadcast(places.withColumn("prefix", F.expr("left(filter_order, step)"))), "prefix")
    shapley = F.sum("removed").over(Window.partitionBy("part", F.right("prefix", F.lit(1)))).alias("shapley")
    return steps.select("part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", shapley)


def audit(docs: DataFrame, labels: DataFrame, failures: Mapping[str, Callable[[Column], Column]] = FAILURES, duplicate: str = "E", part: str = "lang") -> DataFrame:
    """Metrics of every step of every order of ``failures`` and the copy filter ``duplicate``, per part."""
    return orders(stage(mask_cells(docs, labels, failures, part), "cells"), "".join(failures) + duplicate)
