from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query under ``name`` with the SQL it must equal (None: checked by tests only)."""

    def add(fn: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def r6(column: str | Column, name: str | None = None) -> Column:
    rounded = F.round(column, 6)
    return rounded.alias(name or column) if name or isinstance(column, str) else rounded


def day(column: str | Column, name: str | None = None) -> Column:
    text = F.date_format(column, "yyyy-MM-dd")
    return text.alias(name or column) if name or isinstance(column, str) else text


# A few fixed rows per input row, written once: ``[[name(cols) rows]]`` is a generator in Spark and a value list in DuckDB.
EACH = re.compile(r"\[\[(\w+)\(([^)]*)\) (.*?)\]\]", re.DOTALL)


def _generator(match: re.Match[str]) -> str:
    name, cols, rows = match.groups()
    structs = ", ".join(f"struct({r})" for r in re.findall(r"\(([^()]*)\)", rows))
    return f"lateral view inline(array({structs})) {name} as {cols}"


def _value_list(match: re.Match[str]) -> str:
    name, cols, rows = match.groups()
    return f"cross join (values {rows}) as {name}({cols})"


def plain(sql: str) -> str:
    """The same derivation for DuckDB: ``{orders}`` becomes the table name."""
    sql = EACH.sub(_value_list, sql)
    for name in TABLE_NAMES:
        sql = sql.replace("{" + name + "}", name)
    return sql


def derive(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    """Input rows derived from the test tables by SQL that both engines read."""
    sql = EACH.sub(_generator, sql)
    used = {n: table(spark, sf_dir, n) for n in TABLE_NAMES if "{" + n + "}" in sql}
    return spark.sql(sql, **used)


TABLE_NAMES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "pages",
               "benchmark", "labels", "conversations")
