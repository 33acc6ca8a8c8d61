import itertools
import random
from datetime import date, datetime

import pytest
from conftest import rows
from pyspark.sql import functions as F

from pitlake.operators import evidence, page_chain, period_tables, ratios, terms

OBS = "entity_id string, field string, source_type string, published_at timestamp_ntz, doc_id string, page_no int, method string, value_num double, value_str string, value_date date, snippet string"
PRO, ANN, RES = "approved_prospectus", "investor_sale_announcement", "ipo_results"


def obs(field, source, value, day=1, doc="d", page=1, method="digital", entity="e"):
    return (entity, field, source, datetime(2024, 1, day), doc, page, method, value, None, None, "s")


def merged(spark, data, **kw):
    return {(r["entity_id"], r["field"]): r for r in evidence.merge_evidence(spark.createDataFrame(data, OBS), leading=evidence.OFFERING_LEADING, **kw).collect()}


def test_merge_rule(spark):
    data = [obs("offering_price", PRO, 5.0), obs("offering_price", ANN, 5.0, doc="a"), obs("total_offered_shares", PRO, 1.0), obs("total_offered_shares", ANN, 2.0),
            obs("reported_pe", RES, 7.0), obs("pre_offer_capital", ANN, 3.0), obs("pre_offer_capital", RES, 3.0)]
    got = merged(spark, data)
    assert (got["e", "offering_price"]["status"], got["e", "offering_price"]["winner_source"], got["e", "offering_price"]["doc_id"]) == ("extracted", ANN, "a")
    conflict = got["e", "total_offered_shares"]
    assert (conflict["status"], conflict["value_num"], len(conflict["observations"])) == ("conflicting", None, 2)
    assert got["e", "reported_pe"]["value_num"] == 7.0
    assert got["e", "pre_offer_capital"]["winner_source"] == ANN


def test_merge_takes_first_observation_per_source_in_any_input_order(spark):
    data = [obs("offering_price", PRO, 9.0, day=2), obs("offering_price", PRO, 5.0, day=1), obs("offering_price", ANN, 5.0)]
    for order in itertools.permutations(data):
        assert merged(spark, list(order))["e", "offering_price"]["status"] == "extracted"


def test_not_found_and_restriction(spark):
    df = spark.createDataFrame([obs("offering_price", PRO, 5.0), obs("offering_price", RES, 6.0)], OBS)
    entities = spark.createDataFrame([("e",), ("f",)], "entity_id string")
    safe = evidence.merge_evidence(evidence.restrict_sources(df, [PRO, ANN]))
    full = evidence.with_not_found(safe, entities, ["offering_price"])
    assert rows(full, "entity_id", "status", "value_num") == [("e", "extracted", 5.0), ("f", "not_found", None)]


def pages(spark, *texts):
    return spark.createDataFrame([("d", i + 1, t) for i, t in enumerate(texts)], "doc_id string, page_no int, text string")


def facts(spark, *texts):
    return {r["field"]: r for r in evidence.extract_facts(pages(spark, *texts)).collect()}


def test_price_rules_in_order_and_original_snippet(spark):
    got = facts(spark, "Payın nominal değeri 1,00 TL olup, 25,03 TL’den satışa sunulacaktır.", "Halka arz fiyatı: 99")
    assert got["offering_price"]["value_num"] == 25.03 and got["offering_price"]["page_no"] == 1
    assert got["offering_price"]["snippet"].startswith("nominal değeri 1,00 TL olup")
    assert got["currency"]["value_str"] == "TRY"
    assert facts(spark, "Halka Arz Fiyatı 12,50 25%")["offering_price"]["value_num"] == 12.5


def test_dates_methods_and_regulation(spark):
    got = facts(spark, "x", "Talep toplama süresi 3-4 gün: 03.04.2024 ile 31.02.2024 arası. Sabit Fiyatla Talep Toplama. II-5.2 sayılı Sermaye Piyasası Araçlarının Satışı Tebliği")
    assert got["subscription_start_date"]["value_date"] == date(2024, 4, 3)
    assert "subscription_end_date" not in got
    assert got["distribution_method"]["value_str"] == "Sabit Fiyatla Talep Toplama"
    assert got["distribution_regulation_reference"]["value_str"] == "II-5.2"


def test_capital_ratio_from_amounts_and_seller(spark):
    body = ("Şirket sermayesinin 100.000 TL’den 150.000 TL’ye çıkarılması nedeniyle artırılacak 50.000 TL nominal değerli pay ile mevcut ortak A’nın sahip olduğu "
            "10.000 TL pay {more}olmak üzere toplam 60.000 TL nominal değerli pay")
    got = facts(spark, body.format(more=""))
    assert got["capital_increase_ratio"]["value_num"] == pytest.approx(50.0)
    assert (got["pre_offer_capital"]["value_num"], got["post_offer_capital"]["value_num"]) == (100000.0, 150000.0)
    assert got["secondary_sale_shares"]["value_num"] == 10000.0
    two = facts(spark, body.format(more="ve mevcut ortak B’nin sahip olduğu 5.000 TL pay "))
    assert "secondary_sale_shares" not in two and two["total_offered_shares"]["value_num"] == 60000.0


def test_last_valuation_triple_and_pe_lookbehind(spark):
    got = facts(spark, "Piyasa Değeri 10 Net Borç 2 Firma Değeri 12 sonra Piyasa Değeri 20 Net Borç 3 Firma Değeri 23. EV F/K 9 F/K 7,5")
    assert [got[f]["value_num"] for f in ("reported_post_money_market_cap", "reported_net_debt", "reported_enterprise_value", "reported_pe")] == [20.0, 3.0, 23.0, 7.5]
    assert facts(spark, "Nihai Değer 500 Piyasa Değeri 20 Net Borç 3 Firma Değeri 23")["reported_post_money_market_cap"]["value_num"] == 500.0


def test_lists(spark):
    text = ("100 TL nominal değerdeki kısmı (10%) Yurt İçi Bireysel Yatırımcılar’a, 50 TL nominal değerdeki kısmı (5%) Yurt Dışı Kurumsal Yatırımcılara, son.\n"
            "Yurt İçi Bireysel Yatırımcılar Dağıtım: Eşit dağıtım yöntemine göre. Yurt İçi Kurumsal Dağıtım: Oransal dağıtım yöntemine göre\n"
            "Risk Faktörleri Kısa. Bu cümle yeterince uzun bir cümledir; bu da yeterince uzun ikinci cümle.")
    got = {r["field"]: r["value_items"] for r in evidence.extract_lists(pages(spark, "boş", text)).collect()}
    assert [(i["group"], i["label"], i["amount"], i["percentage"]) for i in got["investor_group_allocations"]] == [
        ("retail", "Yurt İçi Bireysel Yatırımcılar", 100.0, 10.0), ("foreign_institutional", "Yurt Dışı Kurumsal Yatırımcılara", 50.0, 5.0)]
    assert [(i["group"], i["method"]) for i in got["investor_group_distribution_rules"]] == [("retail", "equal"), ("domestic_institutional", "proportional")]
    assert len(got["key_risk_items"]) == 2


def test_post_offer_evidence_over_a_page_break(spark):
    df = pages(spark, "Halka arzda 5 Mayıs 2024 tarihleri arasında", "talep toplanmıştır").withColumn("source_system", F.lit("kap")).withColumn("document_type", F.lit("ipo_results"))
    assert rows(evidence.post_offer_evidence(df), "cutoff_date", "source") == [(date(2024, 5, 5), "kap_ipo_results.subscription_end_date")]
    issuer = pages(spark, "Talep Toplama 03.04.2024 - 05.04.2024").withColumn("source_system", F.lit("issuer_ir")).withColumn("document_type", F.lit("x"))
    assert rows(evidence.post_offer_evidence(issuer), "cutoff_date", "source") == [(date(2024, 4, 5), "issuer_ir.subscription_end_date")]


def test_post_offer_evidence_over_several_short_pages(spark):
    """A passage over three pages is found once, at its first page; a missing page in between ends it."""
    results = ["Başka bir konu. " * 60, "Halka arzda 5 Mayıs 2024", "tarihleri arasında", "\n yatırımcılardan ", "talep toplanmıştır", "7 Mayıs 2024 tarihleri arasında talep toplanmıştır"]
    df = pages(spark, *results).withColumn("source_system", F.lit("kap")).withColumn("document_type", F.lit("ipo_results"))
    found = evidence.post_offer_evidence(df, ["page_no"])
    assert rows(found, "cutoff_date", "page_no") == [(date(2024, 5, 5), 2)]
    assert found.collect()[0]["snippet"] == "5 Mayıs 2024\ntarihleri arasında\n\n yatırımcılardan \ntalep topla"
    assert rows(evidence.post_offer_evidence(df.where("page_no <> 4"), ["page_no"]), "cutoff_date", "page_no") == [(date(2024, 5, 7), 6)]
    assert rows(evidence.post_offer_evidence(df.where("page_no in (2, 3)"))) == []


def test_following_pages_equal_brute_force(spark):
    """Random page lengths, free openings, gaps and repeats against a walk over the pages."""
    random.seed(6)
    texts = {}
    for doc in "ab":
        for no in range(1, 80):
            if random.random() < 0.93:
                texts[doc, no] = "".join(random.choice("01xyz ") for _ in range(random.choice([0, 1, 3, 8, 40])))
    data = [(d, n, t) for (d, n), t in texts.items()] + [("a", 5, texts.get(("a", 5), "q")), ("a", None, "nowhere"), (None, 1, "nobody")]
    texts.setdefault(("a", 5), "q")
    df = spark.createDataFrame(data, "doc_id string, page_no long, text string").repartition(4).cache()
    led = F.length(F.regexp_substr("text", F.lit("^[01]*")))
    got = {(r["doc_id"], r["page_no"]): r["following"] for r in page_chain.with_following(df, F.lit(True), 20, led).collect()}
    assert got["a", None] == got[None, 1] == []
    for (doc, no), _ in texts.items():
        want, used, at = [], 0, no + 1
        while (doc, at) in texts and used < 20:
            text = texts[doc, at]
            free = len(text) - len(text.lstrip("01"))
            want.append(text[:free + 20 - used])
            used += len(text) - free + 1
            at += 1
        assert got[doc, no] == want, (doc, no)


def test_period_table_of_forty_periods_over_three_pages(spark):
    periods = [f"{1990 + i // 4}/{3 * (i % 4) + 3:02d}" for i in range(40)]
    first = [f"{100 + i}.{i:03d}.000" for i in range(40)]
    second = [f"({i + 1})" for i in range(40)]
    texts = ["Gelir Tablosu\nbin TL " + " ".join(periods[:25]), " ".join(periods[25:]) + "\nNet Satışlar " + " ".join(first[:30]),
             " ".join(first[30:]) + "\nNet Kar " + " ".join(second[:11]), " ".join(second[11:]) + "\nFinansman Giderleri " + " ".join(first) + "\nAçıklama " + "metin " * 400, "EBIT " + " ".join(first)]
    got = {m: [v[0] for v in values] for m, values in table(spark, *texts).items()}
    assert got == {"revenue": [float(f"{100 + i}{i:03d}000") for i in range(40)], "net_income": [-float(i + 1) for i in range(40)], "finance_expense": [float(f"{100 + i}{i:03d}000") for i in range(40)]}
    ends = [v[3] for v in table(spark, *texts)["revenue"]]
    assert (ends[0], ends[39]) == (date(1990, 3, 31), date(1999, 12, 31))
    assert rows(period_tables.period_table_rejects(pages(spark, *texts))) == []


def test_period_table_windows_do_not_cut_tokens(spark):
    """A token on the 300th and a number on the 400th character are read whole."""
    pad = "x" * 268
    assert [v[3] for v in table(spark, f"Gelir Tablosu {pad} TL 2022/12 2023/12 2024/12 Net Satışlar 1 2 3")["revenue"]] == [date(y, 12, 31) for y in (2022, 2023, 2024)]
    spread = "Gelir Tablosu TL 2022 2023\nNet Satışlar 1 " + "dipnot " * 56 + " 123.456.789 x"
    assert [v[0] for v in table(spark, spread)["revenue"]] == [1.0, 123456789.0]


def test_torn_tables_are_rejected_with_a_reason(spark):
    torn = pages(spark, "Gelir Tablosu TL 2020 2021 2022\nEBIT 4 5 6\nNet Satışlar 1 2 üç bin " + "söz " * 200, "Bilanço bin TL 31.12.2022 30.13.2023\nDönen Varlıklar 1 2")
    assert rows(period_tables.period_table_rejects(torn), "page_no", "metric", "reason", "have", "need") == [(1, "revenue", "row_torn", 2, 3), (2, None, "period_unreadable", 1, 2)]
    mended = pages(spark, "Gelir Tablosu TL 2020 2021 2022\nNet Satışlar 1 2 üç bin " + "söz " * 200, "Gelir Tablosu TL 2020 2021 2022\nNet Satışlar 1 2 3")
    assert rows(period_tables.period_table_rejects(mended)) == []


def test_long_number_pages_do_not_exhaust_the_matcher(spark):
    text = "Gelir Tablosu TL " + "2020 " * 30000 + "\nNet Satışlar " + "7 " * 30000
    assert len(table(spark, text)["revenue"]) == 30000


def table(spark, *texts):
    out = {}
    for r in period_tables.extract_period_table(pages(spark, *texts)).orderBy("place").collect():
        out.setdefault(r["metric"], []).append((r["value"], r["scale"], r["period_type"], r["period_end"], r["consolidation_scope"]))
    return out


def test_period_table(spark):
    got = table(spark, "Gelir Tablosu genel anlatım.", "Gelir Tablosu\n2023 2024 2024/06\nbin TL\nNet Satışlar 1.000 (2.000) 3.000 9\nNet Kar veya zararı 10 20 30\nkonsolide")
    assert got["revenue"] == [(1000.0, "thousand", "ANNUAL", date(2023, 12, 31), "consolidated"), (-2000.0, "thousand", "ANNUAL", date(2024, 12, 31), "consolidated"),
                              (3000.0, "thousand", "INTERIM", date(2024, 6, 30), "consolidated")]
    assert [v[0] for v in got["net_income"]] == [10.0, 20.0, 30.0]


def test_period_table_refuses_forecasts_and_narrative(spark):
    assert table(spark, "Gelir Tablosu 2024 2025 2026T TL Net Satışlar 1 2 3") == {}
    assert table(spark, "Gelir Tablosu 2024 2025 TL Net Satışlar geçen yıla göre 1 2") == {}
    assert table(spark, "Bilanço 31.12.2023 30.06.2024 TL Dönen Varlıklar 5 6")["current_assets"][1][2] == "INTERIM"


def test_period_table_row_on_the_next_page_unless_captioned(spark):
    head = "Bilanço\nTL 2023 2024\nDönen Varlıklar 5 6\n"
    assert [v[0] for v in table(spark, head, "Özkaynaklar 7 8")["equity"]] == [7.0, 8.0]
    assert "equity" not in table(spark, head, "Bilanço devamı Özkaynaklar 7 8")


def wide_facts(spark, data):
    return evidence.merge_evidence(spark.createDataFrame(data, OBS), leading=evidence.OFFERING_LEADING)


def term_map(df):
    return {r["term"]: (r["status"], r["value_num"]) for r in df.collect()}


def test_terms_status_algebra(spark):
    base = [obs("offering_price", PRO, 10.0), obs("capital_increase_shares", PRO, 70.0)]
    got = term_map(terms.build_terms(wide_facts(spark, [*base, obs("total_offered_shares", PRO, 100.0)])))
    assert got["gross_offer_size"] == ("extracted", 1000.0) and got["secondary_sale_shares"] == ("extracted", 30.0)
    assert got["implied_post_money_market_cap"][0] == "not_found"
    split = [*base, obs("total_offered_shares", PRO, 100.0), obs("total_offered_shares", ANN, 90.0)]
    got = term_map(terms.build_terms(wide_facts(spark, split)))
    assert got["gross_offer_size"][0] == "conflicting" and got["secondary_sale_shares"][0] == "conflicting"
    par = [*base, obs("par_value_per_share", PRO, 0.0), obs("post_offer_capital", PRO, 5.0)]
    assert term_map(terms.build_terms(wide_facts(spark, par)))["post_offer_share_count"] == ("not_found", None)


def test_confirmations_fill_only_gaps(spark):
    t = spark.createDataFrame([("e", "offer_price", "not_found", None), ("e", "total_offered_shares", "conflicting", None), ("f", "offer_price", "extracted", 3.0)],
                              "entity_id string, term string, status string, value_num double")
    t = t.withColumn("value_str", F.lit(None).cast("string")).withColumn("value_date", F.lit(None).cast("date")).withColumn("unit", F.lit("TRY"))
    c = spark.createDataFrame([("e", "offer_price", 5.0, 1), ("e", "offer_price", 6.0, 2), ("e", "offer_price", -1.0, 3), ("e", "total_offered_shares", 9.0, 1), ("f", "offer_price", 8.0, 1)],
                              "entity_id string, term string, value_num double, d int")
    c = c.select("*", F.lit(None).cast("string").alias("value_str"), F.lit(None).cast("date").alias("value_date"), F.lit("p").alias("confirmed_by"),
                 F.timestamp_add("DAY", F.col("d"), F.lit("2024-01-01").cast("timestamp_ntz")).alias("confirmed_at"))
    got = rows(terms.complete_with_confirmations(t, c), "entity_id", "term", "status", "value_num", "source")
    assert got == [("e", "offer_price", "extracted", 6.0, "user_confirmed"), ("e", "total_offered_shares", "conflicting", None, "automatic"), ("f", "offer_price", "extracted", 3.0, "automatic")]
    assert terms.invalid_confirmations(c).count() == 1


FIN = ("entity_id string, metric string, value double, currency string, scale string, period_start date, period_end date, period_type string, "
       "consolidation_scope string, inflation_adjusted boolean, document_type string, doc_id string, page_no int, place int")


def fin(metric, value, year=2024, scope=None, currency="TRY", scale="unit", place=0, kind="ANNUAL"):
    return ("e", metric, value, currency, scale, date(year, 1, 1), date(year, 12, 31), kind, scope, None, "price_determination_report", "d", 1, place)


def ratio_map(spark, data):
    entities = spark.createDataFrame([("e",)], "entity_id string")
    df = spark.createDataFrame(data, FIN)
    both = ratios.pair_ratios(entities, df).unionByName(ratios.growth_yoy(entities, df))
    return {r["name"]: (r["status"], r["value"]) for r in both.collect()}


def test_null_attributes_pair_and_latest_period_wins(spark):
    got = ratio_map(spark, [fin("revenue", 200.0), fin("net_income", 20.0), fin("revenue", 100.0, 2023), fin("net_income", 50.0, 2023), fin("equity", -1.0), fin("financial_debt", 5.0)])
    assert got["net_margin"] == ("computed", 0.1) and got["revenue_growth_yoy"] == ("computed", 1.0)
    assert got["debt_to_equity"] == ("unavailable", None) and got["net_debt"] == ("unavailable", None)


def test_different_scope_does_not_pair(spark):
    got = ratio_map(spark, [fin("revenue", 200.0, scope="consolidated"), fin("net_income", 20.0), fin("revenue", 100.0, 2023)])
    assert got["net_margin"][0] == "unavailable" and got["revenue_growth_yoy"][0] == "unavailable"


def test_multiples_and_sector_override(spark):
    cap = spark.createDataFrame([("e", "implied_post_money_market_cap", "extracted", 1e6)], "entity_id string, term string, status string, value_num double")
    sector = spark.createDataFrame([("e", "insurance")], "entity_id string, sector string")
    df = spark.createDataFrame([fin("net_income", 100.0, scale="thousand"), fin("revenue", 5.0, scale="million"), fin("equity", 0.0)], FIN)
    got = ratios.multiples_at_offer(cap, df, sector).first()
    assert (got["pe_at_offer"], got["ps_at_offer_status"], got["pb_at_offer_status"], got["sufficiency"]) == (10.0, "not_applicable", "unavailable", "SUFFICIENT")
    derived = ratios.derived_financials(sector, df, spark.createDataFrame([], "entity_id string, field string, status string, value_num double"), sector)
    assert {r["name"]: r["status"] for r in derived.collect()}["net_margin"] == "not_applicable"


def test_period_tables_compile_no_pattern_per_row(spark):
    from pitlake.operators import period_tables as p

    made = p.reach(F.col("t"), F.col("n"), p.rules.PERIOD_STEP)
    plain = r"(?U)^[\s\S]{0,%d}\S*(?:" + p.rules.PERIOD_STEP + ")*+"
    text = "bin TL 31.12.2022 2023 ve 2024/06 sonra 12"
    for n in range(len(text) + 2):
        df = spark.createDataFrame([(text, n)], "t string, n int")
        assert df.select(made.alias("r")).first().r == df.select(F.regexp_substr("t", F.lit(plain % n)).alias("r")).first().r, n
    assert "n#" not in spark.createDataFrame([(text, 3)], "t string, n int").select(made)._jdf.queryExecution().optimizedPlan().toString().split("regexp_extract(")[1].split("(?U)")[1]


def test_only_the_fields_of_wanted_terms_are_needed(spark):
    """Entity 2 has facts, but none that the wanted terms are made of; it stays, not found."""
    from pitlake.operators import terms

    schema = "entity_id int, field string, status string, value_num double, value_str string, value_date date"
    every = spark.createDataFrame([
        (1, "offering_price", "extracted", 2.0, None, None), (1, "total_offered_shares", "extracted", 50.0, None, None), (1, "par_value_per_share", "extracted", 1.0, None, None),
        (2, "par_value_per_share", "extracted", 1.0, None, None)], schema)
    wanted = ["gross_offer_size", "offer_price"]
    assert terms.fields_of(wanted) == ["offering_price", "total_offered_shares"]
    some = every.where(F.col("field").isin(*terms.fields_of(wanted)))

    def shown(df):
        return sorted(tuple(r) for r in df.where(F.col("term").isin(*wanted)).select("entity_id", "term", "status", "value_num").collect())

    assert shown(terms.build_terms(some, every.select("entity_id").distinct())) == shown(terms.build_terms(every))
    assert set(terms.fields_of(terms.TERM_NAMES)) == {f for f, _ in terms.PASSED.values()}


def test_values_are_read_with_literal_patterns(spark):
    """A pattern that comes from a row is compiled for every row."""
    from pitlake.operators import evidence

    pages = spark.createDataFrame([("d", 1, "Halka Arz Fiyatı (TL): 12,50")], "doc_id string, page_no int, text string")
    facts = evidence.extract_facts(pages)
    plan = facts._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp_extract(match" in plan and "pattern#" not in plan
    assert {(r.field, r.value_num, r.value_str) for r in facts.collect()} == {("offering_price", 12.5, None), ("currency", None, "TRY")}


def test_places_are_found_with_and_without_the_mark_in_the_text(spark):
    """One search gives matches and places; it agrees with two searches, also for a text that holds the mark."""
    from pitlake.functions import text

    df = spark.createDataFrame([("a1bb22c",), ("1",), ("",), ("x",), (None,), (f"1{text.MARK}2a{text.MARK}",), ("12\n3",)], "t string")
    got = {r.t: r.m and [(m.match, m.at) for m in r.m] for r in df.select("t", text.located(F.col("t"), r"\d+").alias("m")).collect()}
    assert got == {"a1bb22c": [("1", 2), ("22", 5)], "1": [("1", 1)], "": [], "x": [], None: None, f"1{text.MARK}2a{text.MARK}": [("1", 1), ("2", 3)], "12\n3": [("12", 1), ("3", 4)]}
    assert df.select(text.located(F.col("t"), r"\d+"))._jdf.queryExecution().analyzed().toString().count("regexp_replace") > 0


def test_period_tables_are_read_in_plain_python_from_unfolded_pages(spark):
    """Captions and leading numbers are found without folding any page; only captioned pages and what follows them are folded, and read in one map."""
    df = pages(spark, "Gelir Tablosu TL 2022 2023\nNet Satışlar 1 2")
    for made in (period_tables.extract_period_table(df), period_tables.period_table_rejects(df)):
        plan = made._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("MapInArrow") == 1 and "regexp" not in plan.split("MapInArrow")[0]
    joined = period_tables.captioned(df, 1500)._jdf.queryExecution().optimizedPlan().toString()
    assert joined.split("Join")[0].count("translate") == 2 and "translate" not in joined.split("Join", 1)[1]


def test_shapes_of_the_plain_reading_are_those_of_the_rules(spark):
    from pitlake.operators import period_reading as p

    random.seed(4)
    parts = ["2022", "2023/06", "31.12.2022", "1.234,5", "(", ")", "-", ".", "/", "t", "T", "x", " ", "7", "٣", "\n", "2025t", "hasilat", "tl", "é"]
    texts = ["".join(random.choice(parts) for _ in range(random.randint(0, 9))) for _ in range(3000)]
    for mine, rule in ((p.PERIOD, p.rules.PERIOD_TOKEN), (p.PERIOD_RUN, p.rules.PERIOD_RUN), (p.NUMBER, p.rules.SIGNED_NUM)):
        for text in texts:
            assert [m.span() for m in p.compiled(mine).finditer(text)] == [m.span() for m in p.compiled(rule).finditer(text)], (rule, text)
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    shapes = {"run": p.rules.PERIOD_RUN, "number": p.rules.SIGNED_NUM, "forecast": p.FORECAST, "word": r"\bhasilat\b", "mark": r"\btl\b", "gap": p.rules.LABEL_GAP[1:-1]}
    native = shapes | {"forecast": p.rules.FORECAST_TOKEN}
    for r in df.select("i", *[F.regexp_instr("t", F.lit("(?U)" + s)).alias(n) for n, s in native.items()]).collect():
        for name, shape in shapes.items():
            at = p.compiled(shape).search(texts[r["i"]])
            assert (at is not None) == (r[name] > 0) and (name == "forecast" or at is None or at.start() + 1 == r[name]), (name, texts[r["i"]])


def test_dates_and_numbers_of_the_plain_reading(spark):
    from pitlake.functions import numbers
    from pitlake.operators import period_reading as p

    days = [f"{d}.{m}.{y}" for d in (0, 1, 28, 29, 30, 31, 32) for m in (0, 1, 2, 4, 12, 13) for y in ("0001", "1900", "2000", "2023", "9999")]
    df = spark.createDataFrame([(t,) for t in days], "t string")
    for r in df.select("t", F.unix_date(numbers.parse_dotted_date(F.col("t"))).alias("d")).collect():
        assert p.period(r["t"]).end == r["d"], r
    written = ["1", "(1)", "-1", "(-1)", "1)", "(1", "1.234,5", "(1.234.567,89)", "0", "(0)", "-0", "٣", "1٣", "12345"]
    df = spark.createDataFrame([(t,) for t in written], "t string")
    for r in df.select("t", numbers.parse_signed_number(F.col("t")).alias("v")).collect():
        assert repr(p.number(r["t"])) == repr(r["v"]), r


def test_patterns_for_unfolded_text_match_where_folded_text_matches(spark):
    from pitlake.functions import text as t

    every = spark.range(1, 0x3000).where("id < 55296").select(F.expr("decode(unhex(lpad(hex(id), 8, '0')), 'UTF-32')").alias("c"))
    for shape in ("[a-zA-Z]", "k", "i", "bilan[c9~]o", r"gelir\s+tablosu"):
        text = F.col("c") if len(shape) < 9 else F.concat(F.lit(shape[:4]), F.col("c"), F.lit(shape.replace(r"\s+", " ").replace("[c9~]", "c")[5:]))
        differ = every.where(text.rlike(t.unfolded_pattern(shape)) != t.fold_text(text).rlike(shape))
        assert differ.count() == 0, (shape, differ.collect()[:9])


def test_window_pages_are_shuffled_only_where_their_end_may_begin_a_passage(spark, monkeypatch):
    """A page of its own never meets the page chain; one that breaks off does, together with its document only."""
    asked = []
    chain = evidence.with_following
    monkeypatch.setattr(evidence, "with_following", lambda df, wanted, chars: asked.append(sorted((r["doc_id"], r["page_no"], r["w"]) for r in df.select("doc_id", "page_no", wanted.alias("w")).collect())) or chain(df, wanted, chars))
    data = [("a", 1, "Talep Toplama 03.04.2024 - 05.04.2024. Talep toplama yeri"), ("a", 2, "x" * 200)]
    schema = "doc_id string, page_no int, text string"
    whole = spark.createDataFrame(data, schema).withColumn("source_system", F.lit("issuer_ir")).withColumn("document_type", F.lit("x"))
    assert rows(evidence.post_offer_evidence(whole), "doc_id", "cutoff_date") == [("a", date(2024, 4, 5))] and asked == []
    broken = spark.createDataFrame([*data, ("b", 1, "Talep Toplama 03.04.2024 -"), ("b", 2, "06.04.2024"), ("c", 1, "11.04.2024 ile 12.04.2024 tarihleri"), ("c", 2, "arasında satışa"), ("c", 3, "sunulacaktır")], schema)
    found = evidence.post_offer_evidence(broken.withColumn("source_system", F.lit("issuer_ir")).withColumn("document_type", F.lit("x")), ["page_no"])
    assert rows(found, "doc_id", "page_no", "cutoff_date") == [("a", 1, date(2024, 4, 5)), ("b", 1, date(2024, 4, 6)), ("c", 1, date(2024, 4, 12))]
    assert asked == [[("b", 1, True), ("b", 2, True), ("c", 1, True), ("c", 2, False), ("c", 3, False)]]


def test_openings_hold_every_beginning_of_a_window(spark):
    """Wherever a passage is broken at white space, its beginning is an opening."""
    from pitlake import extraction_rules as r

    cases = [(r.WINDOW_PATTERNS[0], r.WINDOW_OPENINGS[0], ["halka  arz suresi  bu yil 03.04.2024 ile 5/4/2024", "talep toplama a b c 1.4.2024 - 2.4.2024"]),
             (r.WINDOW_PATTERNS[1], r.WINDOW_OPENINGS[1], ["3.4.2024 - 5.4.2024 tarihleri  arasinda bazi yerlerde satisa sunulacaktir", "3.4.2024 ile 5.4.2024tarihleri arasinda satisa sunulacaktir"]),
             (r.RESULT_END_PATTERN, r.RESULT_END_OPENING, ["5 mayis 2024 tarihleri arasinda yatirimcilardan talep toplanmistir", "15 ekim 2023 tarihlerinde talep  toplandi", "7 ocak 2024 tarihleriarasinda talep toplama"])]
    for pattern, opening, texts in cases:
        for text in texts:
            df = spark.createDataFrame([(text[:i], text[i:]) for i in range(1, len(text)) if text[i].isspace()] + [(text, "")], "a string, b string")
            whole = F.concat_ws("\n", "a", "b").rlike("(?U)" + pattern)
            for row in df.select("a", "b", whole.alias("whole"), F.col("a").rlike("(?U)" + pattern).alias("own"), F.col("a").rlike("(?U)" + opening).alias("open")).collect():
                assert row["whole"] and (row["own"] or row["open"]), (pattern, row)
