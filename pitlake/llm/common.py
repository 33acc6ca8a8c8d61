"""Helpers shared by the text operators: internal column names, row numbers that stay, Arrow batches."""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pitlake.session import stage


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh(taken: Iterable[str], *wanted: str) -> list[str]:
    """Names for internal columns that clash with none of ``taken`` (Spark compares names without case)."""
    used, out = {t.lower() for t in taken}, []
    for name in wanted:
        while name.lower() in used:
            name += "_"
        used.add(name.lower())
        out.append(name)
    return out


def numbered(docs: DataFrame, columns: Sequence[Column], names: Sequence[str], label: str) -> DataFrame:
    """``columns`` of ``docs`` and a row number, written once.

    Row numbers of a plan may change when a task runs again; those of a written table do not. They tell fully equal rows apart.
    The upper bits count input partitions and the lower 33 bits rows, so slices of the number are slices of bounded size.
    """
    return stage(docs.select(F.monotonically_increasing_id().alias(names[0]), *columns), label)


def as_bytes(column: str | Column) -> Column:
    """UTF-8 bytes of a text column; null counts as empty."""
    return F.coalesce((F.col(column) if isinstance(column, str) else column).cast("binary"), F.lit(b""))


def row_batches(batches: Iterable[pa.RecordBatch], most: int = 256) -> Iterator[pa.RecordBatch]:
    """The same rows in slices of at most ``most`` rows, so that Python objects exist for few long texts at a time."""
    for batch in batches:
        for start in range(0, batch.num_rows, most):
            yield batch.slice(start, most)
