"""Small fixed config tables and column helpers shared by all operators."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def literal_rows(rows: Sequence[Sequence[object]], names: Sequence[str], types: Sequence[str]) -> Column:
    """Constant rows as one ARRAY<STRUCT> column; ``F.inline`` of it adds them to every input row."""
    return F.array(
        *[
            F.struct(*[F.lit(value).cast(kind).alias(name) for value, name, kind in zip(row, names, types, strict=True)])
            for row in rows
        ]
    )


def literal_table(spark: SparkSession, rows: Sequence[Sequence[object]], names: Sequence[str], types: Sequence[str]) -> DataFrame:
    """A config table whose size is fixed by code, marked for broadcast for that reason."""
    return F.broadcast(spark.range(1).select(F.inline(literal_rows(rows, names, types))))


def text_array(values: Iterable[str]) -> Column:
    return F.array(*[F.lit(v) for v in values]).cast("array<string>")


def columns(names: Iterable[str]) -> list[Column]:
    return [F.col(n) for n in names]


def computed_once(df: DataFrame, name: str, value: Column) -> DataFrame:
    """``withColumn`` for a costly value that several expressions read.

    The optimizer folds a projected column back into every expression that uses it; a generated one it leaves alone.
    """
    return df.select("*", F.explode_outer(F.array(value)).alias(name))


def per_key(df: DataFrame) -> DataFrame:
    """A lookup that has a row per key of the data, joined by that key: it is never broadcast.

    Spark broadcasts what looks small, and takes a written table for as large as its files; compressed keys and dates take a hundredth of what the
    rows take as a hash table in the driver.
    """
    return df.hint("merge")
