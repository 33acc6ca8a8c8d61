"""Table sinks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pitlake.operators.quality import new_first_writes


def write_snapshot_dataset(snapshots: DataFrame, path: str, version: str) -> None:
    """One folder per dataset version; a rerun replaces only its own version."""
    out = snapshots.withColumn("dataset_version", F.lit(version))
    out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("dataset_version").parquet(path)


def read_snapshot_dataset(spark, path: str, version: str) -> DataFrame:
    return spark.read.parquet(path).where(F.col("dataset_version") == version)


def months_of(target: DataFrame, staged: DataFrame) -> DataFrame:
    """The partitions of ``target`` for the months of ``staged``: literals, so that no other month is listed or read."""
    return target.where(F.col("month").isin([r["month"] for r in staged.select("month").distinct().collect()]))


def append_first_writes(target_path: str, incoming: DataFrame, key: Sequence[str], order: Sequence[str], month_of: str) -> None:
    """Append only unseen keys to a Parquet table partitioned by the month of ``month_of``; only those months are read."""
    spark = incoming.sparkSession
    staged = incoming.withColumn("month", F.date_format(month_of, "yyyy-MM"))
    target = read_if_any(spark, target_path)
    known = staged.limit(0) if target is None else months_of(target, staged)
    new_first_writes(known, staged, [*key, "month"], order).write.mode("append").partitionBy("month").parquet(target_path)


def read_if_any(spark: SparkSession, path: str) -> DataFrame | None:
    """A Parquet table, or None where nothing has been written yet; a damaged one fails."""
    try:
        return spark.read.parquet(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return None
