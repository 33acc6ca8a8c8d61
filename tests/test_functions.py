from datetime import date

import pytest
from conftest import rows
from pyspark.sql import functions as F

from pitlake.functions import numbers, text
from pitlake.operators import records


def one(spark, column, **values):
    row = spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()]).select(column.alias("x")).first()
    return row["x"]


def test_fold_keeps_offsets(spark):
    assert one(spark, text.fold_text(F.col("t")), t="İSTANBUL IŞIĞI Çöğüş") == "istanbul isigi cogus"


def test_normalize_name_drops_whole_legal_tokens_only(spark):
    name = text.normalize_name(F.col("t"))
    assert one(spark, name, t="Asil  Ticaret ve Sanayi A.Ş.") == "asil"
    assert one(spark, name, t="Veri Anonim Şirketi") == "veri"


def test_single_token_and_subject_key(spark):
    assert one(spark, text.single_token(F.col("t")), t=" ABC ,") == "ABC"
    assert one(spark, text.single_token(F.col("t")), t="ABC, DEF") is None
    assert one(spark, text.subject_key(F.col("a"), F.col("b")), a="X, Y", b="Z") == "Z"


def test_title_veto_reroutes_report_to_review(spark):
    cls = records.title_class(F.col("t"))
    assert one(spark, cls, t="Fiyat Tespit Raporu") == "price_determination_report"
    assert one(spark, cls, t="Fiyat Tespit Raporu Hakkında Analist Görüşü") == "price_determination_review"
    assert one(spark, cls, t="Onaylı İzahname") == "approved_prospectus"
    assert one(spark, cls, t="Genel Kurul") == "other"


def test_prospectus_role(spark):
    role = records.prospectus_role(F.col("s"), F.col("t"))
    assert one(spark, role, s="", t="Onaylı İzahname") == "base_document"
    assert one(spark, role, s="İzahname EK-3", t="x") == "attachment"
    assert one(spark, role, s="İzahname Esas Sözleşme", t="x") == "attachment"
    assert one(spark, role, s="Duyuru", t="İzahname") == "attachment"


def test_part_number_sector_attachment_and_link_class(spark):
    assert one(spark, text.part_number(text.fold_text(F.col("t"))), t="İzahname 12 . BÖLÜM") == 12
    sector = records.sector_of(F.col("t"))
    assert [one(spark, sector, t=t) for t in ("Ak Sigorta A.Ş.", "X Bankası", "Y GYO", "Z Yatırım Ortaklığı", "Demir A.Ş.", "")] == [
        "insurance", "banking", "reit", "investment_holding", "standard", "unknown"]
    assert one(spark, records.attachment_role(F.col("t")), t="İMZA sayfası.pdf") == "signature"
    assert one(spark, records.link_class(F.col("t")), t="Fonun Kullanım Yerleri") == "use_of_proceeds_report"


def test_numbers(spark):
    assert one(spark, numbers.parse_number(F.col("t")), t="2.380.000.000") == 2.38e9
    assert one(spark, numbers.parse_number(F.col("t")), t="25,03") == 25.03
    assert one(spark, numbers.parse_number(F.col("t")), t="abc") is None
    signed = numbers.parse_signed_number(F.col("t"))
    assert [one(spark, signed, t=t) for t in ("(1.234)", "-5,5", "7")] == [-1234.0, -5.5, 7.0]


def test_dates_never_raise(spark):
    dotted = numbers.parse_dotted_date(F.col("t"))
    assert [one(spark, dotted, t=t) for t in ("5.4.2024", "05/04/2024", "31.02.2024", "2024-04-05")] == [date(2024, 4, 5), date(2024, 4, 5), None, None]
    assert one(spark, numbers.parse_period_start(F.col("t")), t="2024 / 3") == date(2024, 3, 1)
    assert one(spark, numbers.parse_period_start(F.col("t")), t="2024 / 13") is None
    named = numbers.parse_month_name_date(F.col("d"), text.fold_text(F.col("m")), F.col("y"))
    assert one(spark, named, d="5", m="Şubat", y="2024") == date(2024, 2, 5)
    assert one(spark, named, d="31", m="Şubat", y="2024") is None


def test_band_clamps_and_degenerate_band_is_high(spark):
    def score(v, *band):
        return one(spark, numbers.band_normalize(F.col("v"), *[F.lit(float(b)) for b in band]), v=float(v))

    assert score(-5, 0, 0, 10, 100) == 0.0
    assert score(5, 0, 100, 10, 0) == 50.0
    assert score(50, 0, 0, 10, 100) == 100.0
    assert score(1, 3, 10, 3, 40) == 40.0


def test_entity_keys(spark):
    df = spark.createDataFrame([("ABC", "N", "2024 / 3"), ("", "N", None), (None, None, "p")], "c string, n string, p string")
    assert rows(df.select(text.entity_key(F.col("c"), F.col("n"), F.col("p")))) == [("ipo:ABC:2024 / 3",), ("ipo:N:",), ("ipo:unknown:p",)]


def test_withdrawal_flags_and_primary(spark):
    docs = spark.createDataFrame([("a", "Halka Arzın İptali"), ("a", "x"), ("b", "y")], "entity_id string, title string")
    assert rows(records.withdrawal_flags(docs, "entity_id")) == [("a", True), ("b", False)]
    files = spark.createDataFrame([("a", 1, "imza.pdf"), ("a", 2, "izahname.pdf"), ("a", 3, "z.pdf"), ("b", 1, "kapak.pdf")], "e string, position int, file_name string")
    assert rows(records.pick_primary(files, "e")) == [("a", 2, "izahname.pdf")]


def test_canonical_hash_tells_nulls_and_bars_apart(spark):
    data = [("a|b", "c"), ("a", "b|c"), (None, "c"), ("", "c"), ("c", None), ('a","y":"c', "c"), ("null", "c")]
    df = spark.createDataFrame(data, "x string, y string")
    hashes = [r["h"] for r in df.select(text.canonical_hash({"x": F.col("x"), "y": F.col("y")}).alias("h")).collect()]
    assert len(set(hashes)) == len(data)
    assert hashes == [r["h"] for r in df.select(text.canonical_hash({"y": F.col("y"), "x": F.col("x")}).alias("h")).collect()]


RULES = "rule_order int, pattern string, is_regex boolean, label string, veto array<string>, veto_label string"


def test_rule_table_first_match_with_vetoes(spark):
    rules = spark.createDataFrame([
        (20, "izahname", False, "prospectus", None, None), (10, "onayli", False, "approved", ["taslak"], "draft"), (5, r"ek\s*\d+$", True, "appendix", [], None),
        (30, r"^\w+ rapor", True, "report", ["analist"], "review"), (30, "rapor", False, "any report", None, None), (None, "x", False, "never", None, None), (1, None, False, "never", None, None)], RULES)
    said = {"Onaylı İzahname": "approved", "Onaylı taslak": "draft", "İZAHNAME EK 12": "appendix", "İzahname": "prospectus", "Mali rapor": "report", "analist rapor": "review",
            "iki üç rapor": "any report", "": "other", None: "other", "xyz": "other"}
    df = spark.createDataFrame([(t, 1) for t in said], "title string, label int")
    assert {r["title"]: r["kind"] for r in records.classify_by_table(df, "title", rules, "kind").collect()} == said
    assert rows(records.classify_by_table(df.limit(1), "title", rules.limit(0), "kind", "none"), "kind") == [("none",)]


def test_too_many_rules_fail(spark, monkeypatch):
    monkeypatch.setattr(records, "MOST_RULES", 2)
    rules = spark.createDataFrame([(i, str(i), False, "l", None, None) for i in range(3)], RULES)
    with pytest.raises(ValueError, match="more than 2"):
        records.classify_by_table(spark.createDataFrame([("1",)], "t string"), "t", rules, "kind")
