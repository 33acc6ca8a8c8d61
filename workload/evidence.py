"""Facts: extracted from whole documents and from order-derived offering pages, merged, turned into terms."""

from __future__ import annotations

from pyspark.sql import functions as F

from pitlake import extraction_rules as rules
from pitlake.operators import evidence, period_tables, terms
from pitlake.session import stage
from workload import inputs
from workload.registry import day, derive, plain, query, r6, table
from workload.text import fold

PATTERNS = {
    "card": ((r"\b(\d{16})\b", 1),),
    "area": ((r"\+1 \((\d{3})\)", 1), (r"@mail(\d+)\.", 1)),
    "octet": ((r"\b(\d{1,3})\.\d{1,3}\.\d{1,3}\.\d{1,3}\b", 1),),
    "license_version": ((r"version (\d)", 1),),
}


@query("extract_pattern_facts", f"""with f as (select source as doc_id, doc_id as page_no, {fold('text')} as f from documents),
hits as (
  select doc_id, page_no, 'card' as field, regexp_extract(f, '\\b(\\d{{16}})\\b', 1) as v from f
  union all select doc_id, page_no, 'area', case when regexp_matches(f, '\\+1 \\((\\d{{3}})\\)') then regexp_extract(f, '\\+1 \\((\\d{{3}})\\)', 1) else regexp_extract(f, '@mail(\\d+)\\.', 1) end from f
  union all select doc_id, page_no, 'octet', regexp_extract(f, '\\b(\\d{{1,3}})\\.\\d{{1,3}}\\.\\d{{1,3}}\\.\\d{{1,3}}\\b', 1) from f
  union all select doc_id, page_no, 'license_version', regexp_extract(f, 'version (\\d)', 1) from f)
select doc_id, field, min(page_no) as page_no, cast(arg_min(v, page_no) as double) as value_num from hits where v <> '' group by 1, 2""")
def extract_pattern_facts(spark, d):
    pages = table(spark, d, "documents").select(F.col("source").alias("doc_id"), F.col("doc_id").alias("page_no"), "text")
    return evidence.extract_pattern_facts(pages, PATTERNS).select("doc_id", "field", "page_no", "value_num")


ROWS = plain(inputs.PAGE_ROWS)
FIRST = """
firsts as (select doc_id, any_value(entity_id) as entity_id, any_value(published_at) as published_at, any_value(document_type) as document_type, flag, min(page_no) as page_no,
  arg_min(q, page_no) as q, arg_min(e, page_no) as e, arg_min(ln, page_no) as ln, arg_min(st, page_no) as st from rows_ group by doc_id, flag)"""
# What each flag's text states, written from the row values and not by reading the text.
STATED = {
    "A": {"offering_price": ("q + 0.5", "num"), "currency": ("'TRY'", "str"), "distribution_method": ("'Sabit Fiyatla Talep Toplama'", "str"),
          "subscription_start_date": ("'2024-04-0' || (1 + ln)", "date"), "subscription_end_date": ("'2024-04-1' || ln", "date")},
    "N": {"capital_increase_shares": ("e", "num"), "total_offered_shares": ("e + 10 * q", "num"), "secondary_sale_shares": ("10 * q", "num"),
          "pre_offer_capital": ("e", "num"), "post_offer_capital": ("2 * e", "num"), "capital_increase_ratio": ("100", "num"), "par_value_per_share": ("1", "num")},
    "R": {"reported_pe": ("q + 0.5", "num"), "reported_pb": ("2 + ln / 10.0", "num"), "reported_post_money_market_cap": ("e + 7", "num"),
          "reported_net_debt": ("q", "num"), "reported_enterprise_value": ("e + 7 + q", "num")},
}
FACTS_SQL = " union all ".join(
    f"select doc_id, '{field}' as field, page_no, {f'round(cast({expr} as double), 6)' if kind == 'num' else 'cast(null as double)'} as value_num, "
    f"{expr if kind == 'str' else 'cast(null as varchar)'} as value_str, {expr if kind == 'date' else 'cast(null as varchar)'} as value_date from firsts where flag = '{flag}'"
    for flag, fields in STATED.items() for field, (expr, kind) in fields.items())


def offering_pages(spark, d, orders=None):
    """The pages of all orders, or of those given."""
    if orders is None:
        return derive(spark, d, inputs.SPARK_PAGES)
    return spark.sql(inputs.SPARK_PAGES, lineitem=table(spark, d, "lineitem"), orders=orders)


@query("extract_facts", f"with rows_ as ({ROWS}), {FIRST} {FACTS_SQL}")
def extract_facts(spark, d):
    out = evidence.extract_facts(offering_pages(spark, d))
    return out.select("doc_id", "field", F.col("page_no").cast("bigint"), r6("value_num"), "value_str", day("value_date"))


@query("fact_snippets", f"""with rows_ as ({ROWS}), {FIRST}
select doc_id, 'offering_price' as field, 'Halka Arz Fiyatı (TL): ' || q || ',50' as snippet from firsts where flag = 'A'
union all select doc_id, 'total_offered_shares', 'toplam ' || {inputs.tr('(e + 10 * q)')} || ' TL nominal değerli' from firsts where flag = 'N'
union all select doc_id, 'reported_net_debt', 'Piyasa Değeri ' || {inputs.tr('(e + 7)')} || ' Net Borç ' || q || ' Firma Değeri ' || {inputs.tr('(e + 7 + q)')} from firsts where flag = 'R'""")
def fact_snippets(spark, d):
    out = evidence.extract_facts(offering_pages(spark, d), fields=("offering_price", "total_offered_shares", "reported_net_debt"))
    return out.select("doc_id", "field", "snippet")


@query("unique_within_region", f"with rows_ as ({ROWS}), {FIRST} select doc_id, cast(10 * q as double) as value_num from firsts where flag = 'N'")
def unique_within_region(spark, d):
    rule = evidence.Rule("seller", rules.SELLER_ITEM, how="unique", region=rules.SELLER_REGION)
    return evidence.first_page_facts(offering_pages(spark, d), [rule]).select("doc_id", "value_num")


@query("last_match", f"with rows_ as ({ROWS}), {FIRST} select doc_id, cast(e + 7 as double) as value_num from firsts where flag = 'R'")
def last_match(spark, d):
    rule = evidence.Rule("cap", rules.VALUATION_TRIPLE, how="last")
    return evidence.first_page_facts(offering_pages(spark, d), [rule]).select("doc_id", "value_num")


@query("extract_lists", f"""with rows_ as ({ROWS}), {FIRST},
n as (select * from firsts where flag = 'N'), a as (select * from firsts where flag = 'A')
select doc_id, 'investor_group_allocations' as field, 1 as place, 'retail' as grp, 'Yurt İçi Bireysel Yatırımcılar' as label, cast(10 * q as double) as amount, cast(q as double) as percentage, cast(null as varchar) as method from n
union all select doc_id, 'investor_group_allocations', 2, 'foreign_institutional', 'Yurt Dışı Kurumsal Yatırımcılar', cast(20 * q as double), cast(q + 1 as double), null from n
union all select doc_id, 'investor_group_allocations', 3, 'domestic_institutional', 'Yurt İçi Kurumsal Yatırımcılar', cast(30 * q as double), cast(5 as double), null from n
union all select doc_id, 'investor_group_distribution_rules', 1, 'retail', 'Yurt İçi Bireysel Yatırımcılar', null, null, case st when 'O' then 'proportional' else 'equal' end from n
union all select doc_id, 'key_risk_items', 1, null, 'Bu sektörde rekabet yoğundur ve kar marjı düşüktür;', null, null, null from a
union all select doc_id, 'key_risk_items', 2, null, 'kur riski ' || q || ' puan etkilidir.', null, null, null from a
union all select doc_id, 'key_risk_items', 3, null, 'Son cümle bir nokta ile biter ve uzundur.', null, null, null from a""")
def extract_lists(spark, d):
    out = evidence.extract_lists(offering_pages(spark, d))
    long = out.select("doc_id", "field", F.posexplode("value_items").alias("place", "_i"))
    return long.select("doc_id", "field", (F.col("place") + 1).alias("place"), F.col("_i.group").alias("grp"), "_i.label", "_i.amount", "_i.percentage", "_i.method")


@query("section_items", f"""with f as (select doc_id, text, {fold('text')} as f from documents),
heads as (select doc_id, text, case when contains(f, 'released under') then strpos(f, 'released under') + 14 when contains(f, 'licensed under') then strpos(f, 'licensed under') + 14 end as p from f),
s as (select doc_id, list_filter(list_transform(regexp_split_to_array(regexp_replace(substring(text, p), '([.;])\\s+', '\\1' || chr(1), 'g'), chr(1)), lambda x: regexp_replace(x, '^\\s+|\\s+$', '', 'g')),
  lambda x: length(x) >= 20) as items from heads where p is not null)
select doc_id, len(items) as n, items[1] as first_item, items[len(items)] as last_item from s where len(items) > 0""")
def section_items(spark, d):
    pages = table(spark, d, "documents").select("doc_id", F.lit(1).alias("page_no"), "text")
    out = evidence.extract_lists(pages, headings={"licensing": ("released under", "licensed under")}).where("field = 'licensing'")
    return out.select("doc_id", F.size("value_items").cast("bigint").alias("n"), F.element_at("value_items", 1)["label"].alias("first_item"), F.element_at("value_items", -1)["label"].alias("last_item"))


@query("post_offer_evidence", f"""with rows_ as ({ROWS}), r as (select * from rows_ where flag = 'R' and document_type = 'ipo_results')
select doc_id, '2024-05-1' || arg_min(ln, page_no) as cutoff_date, 'kap_ipo_results.subscription_end_date' as source from r group by 1""")
def post_offer_evidence(spark, d):
    pages = offering_pages(spark, d).withColumn("source_system", F.lit("kap"))
    return evidence.post_offer_evidence(pages).select("doc_id", day("cutoff_date"), "source")


@query("issuer_window_ends", f"""with rows_ as ({ROWS}), a as (select * from rows_ where flag = 'A')
select doc_id, '2024-04-1' || arg_min(ln, page_no) as cutoff_date, 'issuer_ir.subscription_end_date' as source from a group by 1""")
def issuer_window_ends(spark, d):
    pages = offering_pages(spark, d).withColumn("source_system", F.lit("issuer_ir"))
    return evidence.post_offer_evidence(pages).select("doc_id", day("cutoff_date"), "source")


# Merging over all lines: entity = order, source = return flag, two fields, first by line order.
LINES = """
lines as (
  select l_orderkey as entity_id, f.field, l_returnflag as source_type, case f.field when 'tax' then l_tax else l_discount end as v, l_linestatus,
    row_number() over (partition by l_orderkey, l_returnflag, f.field order by l_linenumber, l_partkey, l_suppkey, l_extendedprice) as k
  from lineitem cross join (values ('tax'), ('discount')) f(field)),
firsts as (select * from lines where k = 1),
merged as (
  select entity_id, field, count(*) as source_count, case when count(distinct v) = 1 then 'extracted' else 'conflicting' end as status,
    case when count(distinct v) = 1 then min(v) end as value_num,
    case when count(distinct v) = 1 then case when field = 'tax' then arg_min(source_type, case source_type when 'R' then 0 when 'A' then 1 else 2 end)
      else arg_min(source_type, source_type) end end as winner_source
  from firsts group by 1, 2)"""


def line_observations(spark, d):
    lines = table(spark, d, "lineitem")
    cells = F.array(*[F.struct(F.lit(n).alias("field"), F.col(f"l_{n}").alias("value_num")) for n in ("tax", "discount")])
    return lines.select(
        F.col("l_orderkey").alias("entity_id"), F.inline(cells), F.col("l_returnflag").alias("source_type"), "l_linenumber", "l_partkey", "l_suppkey",
        "l_extendedprice", F.when(F.col("l_linestatus") == "O", "ocr").otherwise("digital").alias("method"))


LINE_MERGE = dict(sources=("A", "N", "R"), leading={"tax": ("R", "A", "N")}, order=("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"),
                  values=("value_num",), carry=("method",))


@query("merge_evidence", f"""with {LINES}, wanted as (select o_orderkey as entity_id, f.field from orders cross join (values ('tax'), ('discount')) f(field))
select entity_id, field, coalesce(status, 'not_found') as status, value_num, winner_source, coalesce(source_count, 0) as source_count
from wanted left join merged using (entity_id, field)""")
def merge_evidence(spark, d):
    facts = evidence.merge_evidence(line_observations(spark, d), **LINE_MERGE)
    entities = table(spark, d, "orders").select(F.col("o_orderkey").alias("entity_id"))
    out = evidence.with_not_found(facts, entities, ["tax", "discount"])
    return out.select("entity_id", "field", "status", "value_num", "winner_source", F.col("source_count").cast("bigint"))


@query("restrict_sources", f"""with {LINES.replace('select * from lines where k = 1', "select * from lines where k = 1 and source_type in ('A', 'N')")}
select entity_id, field, status, value_num from merged""")
def restrict_sources(spark, d):
    kept = evidence.restrict_sources(line_observations(spark, d), ["A", "N"])
    return evidence.merge_evidence(kept, **LINE_MERGE).select("entity_id", "field", "status", "value_num")


@query("unlisted_sources", "select l_orderkey as entity_id, l_returnflag as source_type, count(*) as n from lineitem where l_returnflag = 'N' group by 1, 2")
def unlisted_sources(spark, d):
    left = evidence.unlisted_sources(line_observations(spark, d), ["A", "R"]).where("field = 'tax'")
    return left.groupBy("entity_id", "source_type").agg(F.count(F.lit(1)).alias("n"))


@query("evidence_quality", f"""with {LINES},
q as (select entity_id, field, count(*) as n, bool_or(l_linestatus = 'O') as ocr from firsts group by 1, 2)
select entity_id, coalesce(string_agg(field, ',' order by field) filter (n > 1), '') as corroborated_fields,
  coalesce(string_agg(field, ',' order by field) filter (n = 1), '') as single_source_fields, coalesce(string_agg(field, ',' order by field) filter (ocr), '') as ocr_fields from q group by 1""")
def evidence_quality(spark, d):
    out = evidence.evidence_quality(evidence.merge_evidence(line_observations(spark, d), **LINE_MERGE), ["tax", "discount"])
    return out.select("entity_id", *[F.array_join(c, ",").alias(c) for c in ("corroborated_fields", "single_source_fields", "ocr_fields")])


@query("collect_series", "select l_orderkey as entity_id, count(*) as n from lineitem where l_returnflag <> 'N' group by 1")
def collect_series(spark, d):
    lines = table(spark, d, "lineitem").select(F.when(F.col("l_returnflag") != "N", F.col("l_orderkey")).alias("entity_id"), "l_tax")
    return evidence.collect_series(lines).groupBy("entity_id").agg(F.count(F.lit(1)).alias("n"))


# Terms per customer from its prospectuses and announcements.
def source_pages(spark, d, sources):
    """The pages of some sources, before any text is searched."""
    pages = offering_pages(spark, d).withColumnRenamed("document_type", "source_type")
    return evidence.restrict_sources(pages, sources).withColumnRenamed("source_type", "document_type")


def offering_facts(spark, d, terms_wanted, sources=rules.PRE_OFFER_SOURCES):
    """(facts that the terms need, all entities with a page)."""
    pages = source_pages(spark, d, sources)
    both = evidence.extract_observations(pages, ["entity_id", "published_at", "document_type", "method"], terms.fields_of(terms_wanted))
    facts = evidence.merge_evidence(both.withColumnRenamed("document_type", "source_type"), leading=evidence.OFFERING_LEADING)
    return facts, pages.select("entity_id").distinct()


def both_sides(expr: str, flag: str) -> tuple[str, str]:
    """SQL for (status, value) of one field over prospectus p and announcement i, read from their first document with the flag."""
    p, i = (expr.replace("@", f"side_{s}{flag.lower()}.") for s in "pi")
    has = [f"side_{s}{flag.lower()}.doc_id is not null" for s in "pi"]
    status = f"case when not ({has[0]}) and not ({has[1]}) then 'not_found' when ({has[0]}) and ({has[1]}) and {p} <> {i} then 'conflicting' else 'extracted' end"
    lead = f"coalesce({i}, {p})" if flag == "A" else f"coalesce({p}, {i})"
    return status, f"case when ({status}) = 'extracted' then {lead} end"


def derived_sql(inputs_: list[tuple[str, str]], value: str) -> tuple[str, str]:
    any_conflict = " or ".join(f"({s}) = 'conflicting'" for s, _ in inputs_)
    any_missing = " or ".join(f"({s}) = 'not_found'" for s, _ in inputs_)
    status = f"case when {any_conflict} then 'conflicting' when {any_missing} then 'not_found' else 'extracted' end"
    return status, f"case when ({status}) = 'extracted' then {value} end"


PRICE, NEW, TOTAL = both_sides("@q + 0.5", "A"), both_sides("@e", "N"), both_sides("@e + 10 * @q", "N")
SECOND, PAR, PRE, POST = both_sides("10 * @q", "N"), both_sides("@q * 0 + 1", "N"), both_sides("@e", "N"), both_sides("2 * @e", "N")
GROUPS = both_sides("@q", "N")
RULE = both_sides("@st", "N")
REST = derived_sql([TOTAL, NEW], f"({TOTAL[1]}) - ({NEW[1]})")
SECONDARY = (f"case when ({SECOND[0]}) <> 'not_found' then ({SECOND[0]}) else ({REST[0]}) end", f"case when ({SECOND[0]}) <> 'not_found' then ({SECOND[1]}) else ({REST[1]}) end")
PRE_COUNT = derived_sql([PRE, PAR], f"({PRE[1]}) / ({PAR[1]})")
POST_COUNT = derived_sql([POST, PAR], f"({POST[1]}) / ({PAR[1]})")
GROSS = derived_sql([PRICE, TOTAL], f"({PRICE[1]}) * ({TOTAL[1]})")
CAP = derived_sql([PRICE, POST_COUNT], f"({PRICE[1]}) * ({POST_COUNT[1]})")
TERM_SQL = {
    "offer_price": PRICE, "total_offered_shares": TOTAL, "new_issue_shares": NEW, "secondary_sale_shares": SECONDARY,
    "pre_offer_share_count": PRE_COUNT, "post_offer_share_count": POST_COUNT, "gross_offer_size": GROSS, "implied_post_money_market_cap": CAP,
    "retail_allocation_percentage": (GROUPS[0], GROUPS[1]), "retail_offered_shares": (GROUPS[0], f"10 * ({GROUPS[1]})"),
    "institutional_allocation_percentage": (GROUPS[0], f"6 + ({GROUPS[1]})"), "institutional_offered_shares": (GROUPS[0], f"50 * ({GROUPS[1]})"),
    "retail_distribution_rule": (RULE[0], "null"),
}
SIDES = """
sided as (select entity_id, document_type, flag, arg_min(doc_id, (published_at, doc_id)) as doc_id, arg_min(q, (published_at, doc_id)) as q, arg_min(e, (published_at, doc_id)) as e,
  arg_min(st, (published_at, doc_id)) as st from firsts where document_type in ('approved_prospectus', 'investor_sale_announcement') and flag in ('A', 'N') group by 1, 2, 3),
who as (select distinct entity_id from firsts where document_type in ('approved_prospectus', 'investor_sale_announcement'))"""
JOINS = " ".join(
    f"left join sided side_{s}{f.lower()} on side_{s}{f.lower()}.entity_id = who.entity_id and side_{s}{f.lower()}.flag = '{f}' and side_{s}{f.lower()}.document_type = '{kind}'"
    for s, kind in (("p", "approved_prospectus"), ("i", "investor_sale_announcement")) for f in "AN")
TERMS_SQL = f"""with rows_ as ({ROWS}), {FIRST}, {SIDES}, wide as (select who.entity_id, {', '.join(f'{s} as s_{n}, {v} as v_{n}' for n, (s, v) in TERM_SQL.items())} from who {JOINS})"""
SHOWN = list(TERM_SQL)


@query("build_terms", TERMS_SQL + " union all ".join(
    f" select entity_id, '{n}' as term, s_{n} as status, round(cast(v_{n} as double), 4) as value_num from wide" for n in SHOWN))
def build_terms(spark, d):
    out = terms.build_terms(*offering_facts(spark, d, SHOWN)).where(F.col("term").isin(*SHOWN))
    return out.select("entity_id", "term", "status", F.round("value_num", 4).alias("value_num"))


@query("derived_terms", TERMS_SQL + """ select entity_id, s_gross_offer_size as gross_status, round(cast(v_gross_offer_size as double), 4) as gross_offer_size from wide""")
def derived_terms(spark, d):
    facts, entities = offering_facts(spark, d, ["gross_offer_size"])
    wide = terms.facts_wide(facts, ["offering_price", "total_offered_shares"], entities)
    price, total = (terms.term(terms.status_of(F.col(f)), F.col(f)["value_num"]) for f in ("offering_price", "total_offered_shares"))
    gross = terms.derive_term([price, total], price["value_num"] * total["value_num"], "TRY", "price x shares")
    return wide.select("entity_id", gross["status"].alias("gross_status"), F.round(gross["value_num"], 4).alias("gross_offer_size"))


@query("group_lines", f"""with rows_ as ({ROWS}), {FIRST} select doc_id, cast(q as double) as retail_percentage, cast(50 * q as double) as institutional_amount from firsts where flag = 'N'""")
def group_lines(spark, d):
    lists = evidence.extract_lists(offering_pages(spark, d), fields=("investor_group_allocations",))
    return lists.select("doc_id", terms.group_line(F.col("value_items"), "retail")["percentage"].alias("retail_percentage"),
                        terms.sum_groups(F.col("value_items"), terms.INSTITUTIONAL, "amount").alias("institutional_amount"))


CONFIRMATIONS = """
select o_custkey as entity_id, case o_orderstatus when 'F' then 'offer_price' when 'O' then 'total_offered_shares' else 'retail_distribution_rule' end as term,
  case when o_orderstatus <> 'P' then o_totalprice - 100000 end as value_num, case when o_orderstatus = 'P' then case when o_orderpriority = '5-LOW' then 'lottery' else 'equal' end end as value_str,
  cast(null as date) as value_date, 'clerk' as confirmed_by, o_orderdate as confirmed_at, cast(o_orderkey as varchar(20)) as note
from {orders}"""
GOOD = "(term <> 'retail_distribution_rule' and value_num > 0) or (term = 'retail_distribution_rule' and value_str in ('equal', 'proportional'))"


@query("complete_with_confirmations", TERMS_SQL + f""",
t as (select entity_id, 'offer_price' as term, s_offer_price as status, cast(v_offer_price as double) as v from wide
  union all select entity_id, 'total_offered_shares', s_total_offered_shares, cast(v_total_offered_shares as double) from wide
  union all select entity_id, 'retail_distribution_rule', s_retail_distribution_rule, null from wide),
c as (select entity_id, term, max(confirmed_at) as at, arg_max(value_num, (confirmed_at, value_num)) as v from ({plain(CONFIRMATIONS)}) x where {GOOD} group by 1, 2)
select t.entity_id, t.term, case when t.status = 'not_found' and c.at is not null then 'extracted' else t.status end as status,
  round(case when t.status = 'not_found' and c.at is not null then c.v else t.v end, 4) as value_num,
  case when t.status = 'not_found' and c.at is not null then 'user_confirmed' else 'automatic' end as source from t left join c using (entity_id, term)""")
def complete_with_confirmations(spark, d):
    shown = ("offer_price", "total_offered_shares", "retail_distribution_rule")
    built = terms.build_terms(*offering_facts(spark, d, shown)).where(F.col("term").isin(*shown))
    out = terms.complete_with_confirmations(built, derive(spark, d, CONFIRMATIONS))
    return out.select("entity_id", "term", "status", F.round("value_num", 4).alias("value_num"), "source")


@query("invalid_confirmations", f"select note, case term when 'retail_distribution_rule' then 'must be equal or proportional' else 'must be a positive number' end as reason from ({plain(CONFIRMATIONS)}) x where not ({GOOD})")
def invalid_confirmations(spark, d):
    return terms.invalid_confirmations(derive(spark, d, CONFIRMATIONS)).select("note", "reason")


# Period tables: a caption page per order and its rows on the same page or spilled to the next.
TABLE_PAGES = """
select doc_id, page_no, case when flag = 'A' then 'Şirket tanıtımı. Gelir Tablosu' || chr(10) || 'TL 2022 2023 2023/06' || chr(10) || 'Net Satışlar ' || """ + inputs.tr("e") + """ || ' ' || """ + inputs.tr("(e + q)") + """ ||
    ' (' || q || ')' || chr(10) when flag = 'N' then 'Net Kar ' || q || ' -' || (q + 1) || ' ' || (q + 2) || ' dipnot' else 'Bilanço konsolide olmayan bin TL 31.12.2022 30.06.2023' || chr(10) || 'Dönen Varlıklar ' ||
    """ + inputs.tr("e") + """ || ' ' || """ + inputs.tr("(2 * e)") + """ end as text
from (""" + inputs.PAGE_ROWS + """) rows_"""


@query("extract_period_table", f"""with rows_ as ({ROWS}),
nexts as (select *, lead(flag) over w as nflag, lead(q) over w as nq from rows_ window w as (partition by doc_id order by page_no)),
rev as (select doc_id, min(page_no) as page_no, arg_min(e, page_no) as e, arg_min(q, page_no) as q from nexts where flag = 'A' group by 1),
inc as (select doc_id, min(page_no) as page_no, arg_min(nq, page_no) as q from nexts where flag = 'A' and nflag = 'N' group by 1),
cur as (select doc_id, min(page_no) as page_no, arg_min(e, page_no) as e from nexts where flag = 'R' group by 1)
select doc_id, 'revenue' as metric, page_no, 0 as place, cast(e as double) as value, 'unit' as scale, '2022-12-31' as period_end, 'ANNUAL' as period_type, null as scope from rev
union all select doc_id, 'revenue', page_no, 1, e + q, 'unit', '2023-12-31', 'ANNUAL', null from rev union all select doc_id, 'revenue', page_no, 2, -q, 'unit', '2023-06-30', 'INTERIM', null from rev
union all select doc_id, 'net_income', page_no, 0, q, 'unit', '2022-12-31', 'ANNUAL', null from inc union all select doc_id, 'net_income', page_no, 1, -(q + 1), 'unit', '2023-12-31', 'ANNUAL', null from inc
union all select doc_id, 'net_income', page_no, 2, q + 2, 'unit', '2023-06-30', 'INTERIM', null from inc
union all select doc_id, 'current_assets', page_no, 0, e, 'thousand', '2022-12-31', 'ANNUAL', 'standalone' from cur union all select doc_id, 'current_assets', page_no, 1, 2 * e, 'thousand', '2023-06-30', 'INTERIM', 'standalone' from cur""")
def extract_period_table(spark, d):
    out = period_tables.extract_period_table(stage(derive(spark, d, TABLE_PAGES.replace("//", "div")), "pages"))
    return out.select("doc_id", "metric", "page_no", "place", "value", "scale", day("period_end"), "period_type", F.col("consolidation_scope").alias("scope"))


# Tables over three pages: forty periods, a header broken over two pages, rows broken over the next. Every third order's second row stops after 25 numbers.
SPANS = [f"{1990 + i // 4}/{3 * (i % 4) + 3:02d}" for i in range(40)]


def listed(numbers, of):
    return " || ' ' || ".join(of.format(i) for i in numbers)


LONG_TABLE_PAGES = f"""
select doc_id, page_no, case page_no
  when 1 then 'Önsöz. Gelir Tablosu' || chr(10) || 'bin TL {" ".join(SPANS[:25])}'
  when 2 then '{" ".join(SPANS[25:])}' || chr(10) || 'Net Satışlar ' || {listed(range(30), "cast(e + {0} as varchar(9))")}
  else {listed(range(30, 40), "cast(e + {0} as varchar(9))")} || chr(10) || 'EBIT ' || {listed(range(25), "'(' || (q + {0}) || ')'")} ||
    case when torn = 1 then ' diye biten satır. ' || repeat('Açıklama metni. ', 40) else ' ' || {listed(range(25, 40), "'(' || (q + {0}) || ')'")} end end as text
from (select cast(o_orderkey as varchar(20)) as doc_id, case when o_orderkey % 3 = 0 then 1 else 0 end as torn, cast(floor(o_totalprice) as bigint) % 900 as e, o_custkey % 900 as q
  from {{orders}}) o [[p(page_no) (1), (2), (3)]]"""
LONG_TABLES = plain(f"select cast(o_orderkey as varchar(20)) as doc_id, o_orderkey % 3 = 0 as torn, cast(floor(o_totalprice) as bigint) % 900 as e, o_custkey % 900 as q from {{orders}}")


@query("long_period_tables", f"""with o as ({LONG_TABLES}), n as (select unnest(range(40)) as place)
select doc_id, metric, 1 as page_no, count(*) as periods, sum(value) as total, max(value) filter (place = 39) as last_value,
  '1999-12-31' as last_end, min(scale) as scale
from (select doc_id, 'revenue' as metric, place, cast(e + place as double) as value, 'thousand' as scale from o, n
  union all select doc_id, 'operating_profit', place, cast(-(q + place) as double), 'thousand' from o, n where not torn) c group by 1, 2""")
def long_period_tables(spark, d):
    out = period_tables.extract_period_table(stage(derive(spark, d, LONG_TABLE_PAGES.replace("//", "div")), "pages"))
    return out.groupBy("doc_id", "metric").agg(
        F.min("page_no").alias("page_no"), F.count(F.lit(1)).alias("periods"), F.sum("value").alias("total"), F.max(F.when(F.col("place") == 39, F.col("value"))).alias("last_value"),
        F.date_format(F.max("period_end"), "yyyy-MM-dd").alias("last_end"), F.min("scale").alias("scale"))


@query("torn_period_tables", f"select doc_id, 1 as page_no, 'operating_profit' as metric, 'row_torn' as reason, 25 as have, 40 as need from ({LONG_TABLES}) o where torn")
def torn_period_tables(spark, d):
    return period_tables.period_table_rejects(stage(derive(spark, d, LONG_TABLE_PAGES.replace("//", "div")), "pages"))


# A closing sentence cut into three short pages, with a page of other text before it; page 3 is missing for every fourth order.
BROKEN_PAGES = """
select doc_id, page_no, case page_no when 1 then repeat('Genel açıklama. ', 40) when 2 then 'Halka arzda 1' || ln || ' Mayıs 2024' when 3 then 'tarihleri arasında' else 'talep toplanmıştır.' end as text,
  'kap' as source_system, 'ipo_results' as document_type
from (select cast(o_orderkey as varchar(20)) as doc_id, o_orderkey % 9 as ln, o_orderkey % 4 as gap from {orders}) o [[p(page_no) (1), (2), (3), (4)]] where gap <> 0 or page_no <> 3"""


@query("broken_window_ends", """select cast(o_orderkey as varchar(20)) as doc_id, 2 as page_no, '2024-05-1' || (o_orderkey % 9) as cutoff_date,
  '1' || (o_orderkey % 9) || ' Mayıs 2024' || chr(10) || 'tarihleri arasında' || chr(10) || 'talep topla' as snippet from orders where o_orderkey % 4 <> 0""")
def broken_window_ends(spark, d):
    return evidence.post_offer_evidence(stage(derive(spark, d, BROKEN_PAGES), "pages"), ["page_no"]).select("doc_id", "page_no", day("cutoff_date"), "snippet")
