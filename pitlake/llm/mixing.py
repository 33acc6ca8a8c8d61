"""Mixing sources to target weights by iterative proportional fitting.

Token counts per (source, language, topic) cell are raked until every marginal equals its target; a document is then taken as often as its cell's
calibrated weight gives (whole copies, and one more by chance), so the expected token shares are the targets. The scarcest cell is taken whole and the
others in proportion, unless that leaves less than a share of all tokens (KEPT, or KEPT_GIVEN for stated shares): then the output is that share, and
scarce cells are repeated, so no small cell thins the rest.

Cases: null source, language or topic is a cell value of its own; a null text has no tokens and takes its cell's probability. A target for a value
without tokens cannot be met: targets are scaled to the values that occur; a value with tokens but no target gets probability zero. The draw is a
hash of doc_id, so repeated rows are taken or left together, in every run. An empty table gives an empty result; other columns are kept by ``mix``.
"""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pitlake.llm.common import fresh
from pitlake.session import stage

AXES = ("source", "lang", "topic")
TEMPERATURES = {"source": 0.85, "lang": 0.85, "topic": 0.85}
KEPT, KEPT_GIVEN = 0.7, 0.4  # least expected output tokens as a share of the input's
TOLERANCE = 1e-6
MOST_ROUNDS = 50
SEED = 11


def tokens(text: str | Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def topic_of(text: str | Column) -> Column:
    """A coarse topic read from the whole text: licensed matter, tables and markup, figures and records, or plain prose."""
    t = F.coalesce(text, F.lit(""))
    holds = lambda *marks: reduce(or_, [F.contains(t, F.lit(m)) for m in marks])
    return (F.when(holds("icensed under", "nder the MIT License", "ll rights reserved"), "licensed")
            .when(holds(" | ", "$$$", "###", "&&&", "%%%", "***"), "markup").when(t.rlike(r"\d{3}"), "records").otherwise("prose"))


def scaled(shares: DataFrame, axis: str, share: Column) -> DataFrame:
    """(axis, target) with targets that add up to one; only their sum comes to the driver."""
    raw = shares.select(axis, share.alias("target"))
    total = raw.agg(F.sum("target")).first()[0]
    return raw.withColumn("target", F.col("target") / F.lit(total))


def tempered(cells: DataFrame, axis: str, temperature: float) -> DataFrame:
    """Target shares: observed token shares raised to ``temperature`` and scaled to one."""
    seen = cells.groupBy(axis).agg(F.sum("tokens").alias("n")).where("n > 0")
    return scaled(seen, axis, F.pow("n", F.lit(float(temperature))))


def given(cells: DataFrame, axis: str, shares: Mapping[str | None, float]) -> DataFrame:
    """Target shares from a mapping, scaled to the values that occur with tokens."""
    stated = cells.sparkSession.createDataFrame([(k, float(v)) for k, v in shares.items()], f"{axis} string, share double")
    seen = cells.groupBy(axis).agg(F.sum("tokens").alias("n")).where("n > 0")
    return scaled(seen.join(stated, seen[axis].eqNullSafe(stated[axis])).select(seen[axis], "share"), axis, F.col("share"))


def rake(cells: DataFrame, targets: Mapping[str, DataFrame], tolerance: float = TOLERANCE, most_rounds: int = MOST_ROUNDS) -> DataFrame:
    """``cells`` with ``weight``: token shares raked to the targets.

    Each step groups the cell table by one axis and joins the small result back; only the largest gap between a marginal and its target comes to
    the driver. The cell table has a row per combination, never a row per document.
    """
    total = cells.agg(F.sum("tokens")).first()[0]
    now = cells.withColumn("weight", F.coalesce(F.col("tokens") / F.lit(total or None).cast("double"), F.lit(0.0)))
    for axis, target in targets.items():
        now = now.join(target.select(F.col(axis).alias("value"), F.col("target").alias(f"{axis}_target")), F.col(axis).eqNullSafe(F.col("value")), "left").drop("value")
        now = now.fillna({f"{axis}_target": 0.0})
    now = stage(now, "cells")
    for _ in range(most_rounds):
        gaps = []
        for axis in targets:
            share = now.groupBy(axis).agg(F.sum("weight").alias("share")).withColumnRenamed(axis, "value")
            now = now.join(share, F.col(axis).eqNullSafe(F.col("value"))).drop("value")
            gaps.append(F.max(F.abs(F.col(f"{axis}_gap"))))
            now = now.withColumn(f"{axis}_gap", F.col("share") - F.col(f"{axis}_target"))
            now = now.withColumn("weight", F.when(F.col("share") > 0, F.col("weight") * F.col(f"{axis}_target") / F.col("share")).otherwise(0.0)).drop("share")
        now = stage(now, "cells")
        widest = now.agg(F.max(F.greatest(*[F.abs(f"{axis}_gap") for axis in targets]))).first()[0]
        now = now.drop(*[f"{axis}_gap" for axis in targets])
        if widest is None or widest < tolerance:
            break
    return now


def probabilities(cells: DataFrame, targets: Mapping[str, DataFrame], kept: float) -> DataFrame:
    """Per cell: weight, the rate (expected copies of a document) that takes its tokens to that weight, and the probability to be taken at all.

    The scarcest cell has rate one, or more if the expected output were below ``kept`` of all tokens otherwise. Cells without tokens cannot change a
    token share; they are taken whole.
    """
    raked = rake(cells, targets)
    ratio = F.when(F.col("tokens") > 0, F.col("weight") / F.col("tokens"))
    most, total, weight = raked.agg(F.max(ratio), F.sum("tokens"), F.sum("weight")).first()
    scale = max(1 / most, kept * total / weight) if most else None
    rate = F.coalesce(ratio * F.lit(scale).cast("double"), F.lit(1.0))
    rate = F.when(F.abs(rate - 1) < 1e-12, 1.0).otherwise(rate)  # the scarcest cell is whole in spite of rounding
    return raked.select(*AXES, "weight", rate.alias("rate"), F.least(F.lit(1.0), rate).alias("probability"))


def draw(doc_id: str, seed: int = SEED) -> Column:
    """A number in [0, 1) fixed by doc_id."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.coalesce(F.col(doc_id).cast("string"), F.lit(""))), 11) / F.lit(float(1 << 53))


def copies(doc_id: str, rate: str) -> Column:
    """How often a document is taken: the whole part of its rate, and once more with the chance of the rest."""
    whole = F.floor(rate)
    return whole + (draw(doc_id) < F.col(rate) - whole).cast("long")


def weigh(rows: DataFrame, temperatures: Mapping[str, float] = TEMPERATURES, shares: Mapping[str, Mapping[str | None, float]] | None = None, kept: float | None = None) -> DataFrame:
    """Probabilities per cell for ``rows`` (source, lang, topic, tokens). Axes named in ``shares`` are raked to those, others to tempered shares (1: as observed)."""
    cells = stage(rows.groupBy(*AXES).agg(F.sum("tokens").alias("tokens"), F.count(F.lit(1)).alias("documents")), "cells")
    targets = {a: stage(given(cells, a, shares[a]) if shares and a in shares else tempered(cells, a, temperatures[a]), "targets") for a in AXES}
    return stage(probabilities(cells, targets, (KEPT_GIVEN if shares else KEPT) if kept is None else kept), "probabilities")


def attach(rows: DataFrame, cells: DataFrame) -> DataFrame:
    """Cells are keyed by one text of their three values, so that null cells join too and a hot cell is a plain skewed join."""
    return rows.join(cells.select(cell_key(*AXES).alias("cell"), "weight", "rate", "probability"), "cell")


def cell_key(*parts: str) -> Column:
    return F.to_json(F.struct(*[F.col(p).cast("string").alias(f"v{i}") for i, p in enumerate(parts)]))


def sampled(docs: DataFrame, temperatures: Mapping[str, float] = TEMPERATURES, shares: Mapping[str, Mapping[str | None, float]] | None = None, kept: float | None = None) -> DataFrame:
    """One row per document: doc_id, source, lang, topic, tokens, weight (of its cell), rate, probability, copies, taken."""
    rows = stage(docs.select("doc_id", "source", "lang", topic_of("text").alias("topic"), tokens("text").alias("tokens")), "measures")
    placed = attach(rows.withColumn("cell", cell_key(*AXES)), weigh(rows, temperatures, shares, kept)).drop("cell")
    return placed.withColumn("copies", copies("doc_id", "rate")).withColumn("taken", F.col("copies") > 0)


def mix(docs: DataFrame, temperatures: Mapping[str, float] = TEMPERATURES, shares: Mapping[str, Mapping[str | None, float]] | None = None, kept: float | None = None) -> DataFrame:
    """The documents taken, as often as they are taken, with all their columns. Texts are read twice and never shuffled while the cell table is small enough to broadcast."""
    rate, topic, cell, times = fresh(docs.columns, "rate", "topic", "cell", "times")
    rows = docs.select("source", "lang", topic_of("text").alias("topic"), tokens("text").alias("tokens"))
    cells = weigh(rows, temperatures, shares, kept).select(cell_key(*AXES).alias(cell), F.col("rate").alias(rate))
    keyed = docs.withColumn(topic, topic_of("text")).withColumn(cell, cell_key("source", "lang", topic))
    taken = keyed.join(cells, cell).withColumn(times, copies("doc_id", rate)).where(F.col(times) > 0)
    return taken.withColumn(times, F.explode(F.array_repeat(F.lit(0), F.col(times).cast("int")))).select(*[F.col(f"`{c}`") for c in docs.columns])
