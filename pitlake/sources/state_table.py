"""State that grows with every batch: tables bucketed by key, so a batch is shuffled to the table and the table never is.

A table is written once with a number of buckets; batches are dealt by the same hash of the key, one task per bucket, and appended to it. Looking keys up
joins bucket to bucket: the plan has an exchange above the batch alone, however large the table has grown. Appends add one file per bucket and batch;
:func:`compact` rewrites a table into one sorted file per bucket.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pitlake.tables import columns

BUCKETS = 64


def first_of_batch(incoming: DataFrame, key: Sequence[str], order: Sequence[str]) -> DataFrame:
    """One row per key, the first by ``order``; rows with a null in their key cannot be looked up and are left out."""
    keyed = incoming.dropna(subset=list(key))
    first = keyed.groupBy(*columns(key)).agg(F.min_by(F.struct("*"), F.struct(*columns(order))).alias("_row"))
    return first.select("_row.*").select(*columns(incoming.columns))


def buckets_of(spark: SparkSession, table: str) -> int:
    """The number of buckets a table was made with."""
    told = {r["col_name"]: r["data_type"] for r in spark.sql(f"describe extended {table}").collect()}
    return int(told["Num Buckets"])


def unseen(incoming: DataFrame, table: str, key: Sequence[str]) -> DataFrame:
    """Rows whose key the table lacks, a null key among them; all rows while there is no table."""
    spark = incoming.sparkSession
    if not spark.catalog.tableExists(table):
        return incoming
    dealt = incoming.repartition(buckets_of(spark, table), *columns(key))
    return dealt.join(spark.table(table).select(*key), list(key), "left_anti")


def seen(incoming: DataFrame, table: str, key: Sequence[str]) -> DataFrame:
    """Rows whose key the table holds."""
    spark = incoming.sparkSession
    if not spark.catalog.tableExists(table):
        return incoming.limit(0)
    return incoming.repartition(buckets_of(spark, table), *columns(key)).join(spark.table(table).select(*key), list(key), "left_semi")


def write_buckets(rows: DataFrame, table: str, key: Sequence[str], buckets: int, path: str | None, mode: str) -> None:
    dealt = rows.repartition(buckets, *columns(key)).sortWithinPartitions(*key)
    writer = dealt.write.format("parquet").mode(mode).bucketBy(buckets, key[0], *key[1:]).sortBy(key[0], *key[1:])
    (writer.option("path", path) if path else writer).saveAsTable(table)


def append_unseen(incoming: DataFrame, table: str, key: Sequence[str], order: Sequence[str], path: str | None = None, buckets: int = BUCKETS) -> None:
    """Append the first row of every key that the table lacks; what it holds is never changed. The first call makes the table.

    ``path`` and ``buckets`` count when the table is made: a folder that driver and executors share (the warehouse if not given), and the number of
    buckets, which stays. A batch that runs again finds its own keys there and appends nothing.
    """
    spark = incoming.sparkSession
    exists = spark.catalog.tableExists(table)
    fresh = first_of_batch(unseen(incoming, table, key), key, order)
    write_buckets(fresh, table, key, buckets_of(spark, table) if exists else buckets, None if exists else path, "append")


def compact(spark: SparkSession, table: str, key: Sequence[str], path: str | None = None) -> None:
    """Rewrite a table into one sorted file per bucket, in a new folder if ``path`` is given, and take its place."""
    aside = f"{table}_{uuid.uuid4().hex[:8]}"
    write_buckets(spark.table(table), aside, key, buckets_of(spark, table), path, "errorifexists")
    spark.sql(f"drop table {table}")
    spark.sql(f"alter table {aside} rename to {table}")
