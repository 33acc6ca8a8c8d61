"""Readers with explicit schemas; nothing is inferred."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pitlake.functions.text import subject_key

from pitlake.tables import computed_once

# Layout of the completed-offering feed (field, type, nullable).
OFFERING_FIELDS = (
    ("ay", "int", False), ("donem", "string", True), ("borsaKodu", "string", True), ("sirketUnvani", "string", True),
    ("halkaArzSekli", "string", True), ("halkaArzOrani", "double", True), ("halkaArzFiyatiTl", "double", True),
    ("ortakSatisBinTl", "bigint", True), ("nakitSermayeArtisiBinTl", "bigint", True), ("ekSatisTutariBinTl", "bigint", True),
    ("satisaHazirBekletilenPayTutariBinTl", "bigint", True), ("satisaSunulanToplamTutarBinABDDolari", "double", True),
    ("satisaSunulanToplamTutarBinTl", "bigint", True), ("mevcutSermayeBinTl", "double", True), ("yeniSermayeBinTl", "double", True),
    ("satisaSunulanToplamTutarPiyasaDegeriBinTl", "double", True), ("ilkIslemGorduguPazar", "string", True),
    ("halkaArzaAracilikEdenKurum", "string", True), ("borsadaIslemGormeTarihi", "timestamp_ntz", True),
)

# Columns of the daily bulletin and the rows that are secondary-market equity.
BULLETIN_COLUMNS = {
    "TRADE DATE": "trade_date", "INSTRUMENT SERIES CODE": "instrument_code", "INSTRUMENT GROUP": "instrument_group", "MARKET": "market",
    "OPENING PRICE": "open", "LOWEST PRICE": "low", "HIGHEST PRICE": "high", "CLOSING PRICE": "close",
    "TOTAL TRADED VALUE": "traded_value", "TOTAL TRADED VOLUME": "volume",
}
EQUITY_GROUP, EQUITY_MARKET, EQUITY_SUFFIX = "EQT", "MSPOT", ".E"

# JSON kinds that fill each typed column (a boolean never passes for a number).
_JSON_KINDS = {"int": ("BIGINT",), "bigint": ("BIGINT",), "string": ("STRING",), "timestamp_ntz": ("STRING",)}


def _fail(message: Column) -> Column:
    return F.raise_error(message)


def strict_records(lines: DataFrame, fields: Sequence[tuple[str, str, bool]], json: str = "value") -> DataFrame:
    """Typed columns from JSON objects. An unknown key, a wrong type or a missing required value stops the job."""
    keys = F.json_object_keys(json)
    known = F.array(*[F.lit(f[0]) for f in fields])
    unknown = F.array_except("_keys", known)
    raw = computed_once(lines.select(F.col(json).alias("_raw"), keys.alias("_keys")), "_doc", F.parse_json("_raw"))
    checked = computed_once(raw, "_record", 
        F.when(F.col("_keys").isNull(), _fail(F.concat(F.lit("record is not a JSON object: "), F.col("_raw"))).cast("variant"))
        .when(F.size(unknown) > 0, _fail(F.concat(F.lit("unknown field(s): "), F.array_join(unknown, ", "))).cast("variant"))
        .otherwise(F.col("_doc")))
    out = []
    for name, kind, nullable in fields:
        cell = F.try_variant_get("_record", f"$.{name}", "variant")
        seen = F.schema_of_variant(cell)
        absent = cell.isNull() | (seen == "VOID")
        fits = seen.isin(*_JSON_KINDS[kind]) if kind in _JSON_KINDS else (
            (seen == "BIGINT") | (seen == "DOUBLE") | F.startswith(seen, F.lit("DECIMAL")))
        text_type = "string" if kind == "timestamp_ntz" else kind
        value = F.try_variant_get("_record", f"$.{name}", text_type)
        value = value.try_cast("timestamp_ntz") if kind == "timestamp_ntz" else value
        wrong = _fail(F.concat(F.lit(f"field {name}: expected {kind}, got "), seen)).cast(kind)
        missing = F.lit(None).cast(kind) if nullable else _fail(F.lit(f"field {name} is required")).cast(kind)
        out.append(F.when(absent, missing).when(~fits | value.isNull(), wrong).otherwise(value).alias(name))
    return checked.select(*out)


def strict_read(spark: SparkSession, path: str, fields: Sequence[tuple[str, str, bool]] = OFFERING_FIELDS) -> DataFrame:
    """JSON lines read strictly; see :func:`strict_records`."""
    return strict_records(spark.read.text(path), fields)


def read_bulletin(spark: SparkSession, path: str, width: int) -> DataFrame:
    """``;``-separated daily files with a two-row header; each file's columns are found by the English names in its own second row.

    A file without that row, or without one of the names, stops the job with its path.
    """
    schema = T.StructType([T.StructField(f"c{i}", T.StringType()) for i in range(width)])
    raw = spark.read.csv(path, sep=";", schema=schema, header=True, enforceSchema=True, mode="FAILFAST")
    lines = raw.select(F.array(*[f"c{i}" for i in range(width)]).alias("cells"), F.col("_metadata.file_path").alias("file"))
    is_header = F.array_contains("cells", "TRADE DATE")
    headers = lines.where(is_header).groupBy("file").agg(F.first("cells").alias("names"))

    def cell(name: str) -> Column:
        at = F.array_position("names", name)
        return F.when(at > 0, F.element_at("cells", at.cast("int"))).otherwise(_fail(F.concat(F.lit(f"bulletin is missing column {name}: "), F.col("file"))).cast("string"))

    return lines.where(~F.coalesce(is_header, F.lit(False))).join(headers, "file", "left").select(*[cell(name).alias(alias) for name, alias in BULLETIN_COLUMNS.items()])


def filter_equity_bulletin(rows: DataFrame) -> DataFrame:
    """Secondary-market equity rows, typed; an equity row without the suffix or with a bad number stops the job."""
    equity = rows.where((F.col("instrument_group") == EQUITY_GROUP) & (F.col("market") == EQUITY_MARKET))
    code = F.col("instrument_code")

    def typed(column: str, kind: str, source: Column | None = None) -> Column:
        value = (F.col(column) if source is None else source).try_cast(kind)
        bad = _fail(F.concat(F.lit(f"bad {column}: "), F.col(column).cast("string"))).cast(kind)
        return F.when(value.isNotNull(), value).otherwise(bad).alias(column)

    ticker = F.when(F.endswith(code, F.lit(EQUITY_SUFFIX)), F.left(code, F.length(code) - len(EQUITY_SUFFIX))).otherwise(
        _fail(F.concat(F.lit("equity code without suffix: "), code)).cast("string"))
    return equity.select(
        typed("trade_date", "date").alias("trading_date"), ticker.alias("ticker"),
        *[typed(c, "double") for c in ("open", "high", "low", "close")],
        typed("volume", "bigint", F.col("volume").try_cast("double")), typed("traded_value", "double"))


# Layout of a disclosure item and its publish-time format.
DISCLOSURE_SCHEMA = """disclosureBasic struct<disclosureId string, disclosureIndex int, title string, companyTitle string, stockCode string,
 relatedStocks string, publishDate string, summary string, attachmentCount int, disclosureClass string, disclosureType string>"""
PUBLISHED_FORMAT = "dd.MM.yyyy HH:mm:ss"


def normalize_disclosures(items: DataFrame) -> DataFrame:
    """Rows from nested items (``item`` as JSON text): wall-clock publish time, subject key, trimmed names. A time that cannot be read is NULL."""
    basic = F.from_json("item", DISCLOSURE_SCHEMA)["disclosureBasic"]
    text = lambda name: F.nullif(F.trim(basic[name]), F.lit(""))
    return items.select(
        text("disclosureId").alias("disclosure_id"), basic["disclosureIndex"].alias("disclosure_index"),
        F.try_to_timestamp(basic["publishDate"], F.lit(PUBLISHED_FORMAT)).cast("timestamp_ntz").alias("published_at"), text("companyTitle").alias("company_name"),
        subject_key(basic["relatedStocks"], basic["stockCode"]).alias("ticker"), text("title").alias("title"), text("summary").alias("summary"),
        text("disclosureClass").alias("disclosure_class"), F.coalesce(basic["attachmentCount"], F.lit(0)).alias("attachment_count"))


def read_disclosures(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines of disclosure items; see :func:`normalize_disclosures`."""
    return normalize_disclosures(spark.read.text(path).withColumnRenamed("value", "item"))
