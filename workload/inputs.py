"""Domain-shaped inputs derived from the test tables; their size follows the tables."""

from __future__ import annotations

COMPANIES = """
select c_custkey, replace(c_name, '#', ' ') || case c_mktsegment
    when 'BUILDING' then ' Gayrimenkul Yatırım Ortaklığı A.Ş.' when 'MACHINERY' then ' Sigorta A.Ş.'
    when 'HOUSEHOLD' then ' Bankası Anonim Şirketi' when 'AUTOMOBILE' then ' Yatırım Ortaklığı A.Ş.'
    else ' Sanayi ve Ticaret A.Ş.' end as company_name,
  case when c_nationkey = 3 then 'CDUP' when c_nationkey < 15 then 'C' || c_custkey else '' end as ticker,
  case when c_acctbal > 5000 then '2024 / 3' when c_acctbal > 0 then '2025 / 11' else null end as period,
  c_acctbal, c_nationkey
from {customer}"""

DISCLOSURES = """
select 'd' || o_orderkey as disclosure_id, o_orderdate as published_at, o_custkey,
  case o_orderpriority when '1-URGENT' then 'Onaylı İzahname' when '2-HIGH' then 'Tasarruf Sahiplerine Satış Duyurusu'
    when '3-MEDIUM' then 'Fiyat Tespit Raporuna İlişkin Analist Raporu' when '4-NOT SPECIFIED' then 'Halka Arz Sonuçları'
    else 'Halka Arz İPTAL Başvurusu' end as title,
  case o_orderstatus when 'F' then 'İzahname 2. Bölüm' when 'P' then 'İzahname EK-3' else '' end as summary,
  company_name,
  case o_orderstatus when 'O' then '' when 'P' then ' c' || o_custkey || ' ' else 'C' || o_custkey end as ticker,
  case when o_orderpriority = '5-LOW' then 'C' || o_custkey || ', C1' when o_orderstatus = 'F' then ' C' || o_custkey || ',' else '' end as related
from {orders} join (""" + COMPANIES + """) c on c_custkey = o_custkey"""

OFFERINGS = """
select case when ticker <> '' then 'ipo:' || ticker else 'ipo:' || company_name end || ':' || coalesce(period, '') as record_id,
  ticker, company_name, period, c_custkey, c_acctbal
from (""" + COMPANIES + """) c where c_acctbal > -600"""

APPLICATIONS = """
select 'application:' || company_name || ':2024-01-15' as record_id, company_name, c_custkey as position, c_acctbal,
  date '2024-01-15' as application_date
from (""" + COMPANIES + """) c where c_acctbal < 2000"""

# Numbers written with grouping dots.


def tr(n: str) -> str:
    return (f"case when {n} >= 1000000 then cast({n} // 1000000 as varchar(9)) || '.' || lpad(cast({n} // 1000 % 1000 as varchar(9)), 3, '0') || '.' || lpad(cast({n} % 1000 as varchar(9)), 3, '0') "
            f"when {n} >= 1000 then cast({n} // 1000 as varchar(9)) || '.' || lpad(cast({n} % 1000 as varchar(9)), 3, '0') else cast({n} as varchar(9)) end")


# One document per order, one page per line item. Flag A: price and window; N: capital and allocation; R: valuation.
PAGE_ROWS = """
select cast(o_orderkey as varchar(20)) as doc_id, o_custkey as entity_id, o_orderdate as published_at,
  case o_orderpriority when '1-URGENT' then 'approved_prospectus' when '2-HIGH' then 'investor_sale_announcement'
    when '3-MEDIUM' then 'price_determination_report' when '4-NOT SPECIFIED' then 'ipo_results' else 'other' end as document_type,
  row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_extendedprice) as page_no,
  case l_linestatus when 'O' then 'ocr' else 'digital' end as method, l_returnflag as flag, l_linestatus as st, l_linenumber as ln,
  cast(l_quantity as bigint) as q, cast(floor(l_extendedprice) as bigint) as e
from {lineitem} join {orders} on o_orderkey = l_orderkey"""

PAGES = """
select doc_id, entity_id, published_at, document_type, page_no, method, flag, case flag
  when 'A' then 'Genel bilgi. Halka Arz Fiyatı (TL): ' || q || ',50 olarak belirlendi. Talep Toplama süresi 0' || (1 + ln) || '.04.2024 ile 1' || ln ||
    '.04.2024 arasındadır. Sabit Fiyatla Talep Toplama yöntemi. ' || chr(10) || 'Risk Faktörleri Bu sektörde rekabet yoğundur ve kar marjı düşüktür; kur riski ' || q ||
    ' puan etkilidir. Kısa. Son cümle bir nokta ile biter ve uzundur.'
  when 'N' then 'Şirket sermayesinin ' || """ + tr("e") + """ || ' TL’den ' || """ + tr("(2 * e)") + """ || ' TL’ye çıkarılması nedeniyle artırılacak ' || """ + tr("e") + """ ||
    ' TL nominal değerli paylar ile mevcut ortak Ali Veli’nin sahip olduğu ' || """ + tr("(10 * q)") + """ || ' TL nominal değerli pay olmak üzere toplam ' || """ + tr("(e + 10 * q)") + """ ||
    ' TL nominal değerli pay satılacaktır. Her bir payın nominal değeri 1 TL olup paylar dağıtılır. ' || """ + tr("(10 * q)") + """ || ' TL nominal değerdeki kısmı (' || q ||
    '%) Yurt İçi Bireysel Yatırımcılar’a, ' || """ + tr("(20 * q)") + """ || ' TL nominal değerdeki kısmı (' || (q + 1) || '%) Yurt Dışı Kurumsal Yatırımcılar’a, ' || """ + tr("(30 * q)") + """ ||
    ' TL nominal değerdeki kısmı (5%) Yurt İçi Kurumsal Yatırımcılar’a.' || chr(10) || 'Yurt İçi Bireysel Yatırımcılar Dağıtım: ' || case st when 'O' then 'Oransal' else 'Eşit' end || ' dağıtım yöntemine göre yapılır.'
  else 'Şirket F/K ' || q || ',5 ve PD/DD 2,' || ln || ' ile. Piyasa Değeri 10 Net Borç 20 Firma Değeri 30 ve güncel Piyasa Değeri ' || """ + tr("(e + 7)") + """ ||
    ' Net Borç ' || q || ' Firma Değeri ' || """ + tr("(e + 7 + q)") + """ || ' bulunur. 1' || ln || ' Mayıs 2024 tarihleri arasında talep toplanmıştır.' end as text
from (""" + PAGE_ROWS + """) rows_"""
# Spark spells integer division ``div``.
SPARK_PAGES = PAGES.replace("//", "div")

FIN = """
select entity_id, metric, value, case st when 'P' then 'USD' else 'TRY' end as currency, case st when 'P' then 'million' when 'O' then 'thousand' else 'unit' end as scale,
  make_date(yy, 1, 1) as period_start, make_date(yy, 12, 31) as period_end, case when yy = 1997 and st = 'O' then 'INTERIM' else 'ANNUAL' end as period_type,
  cast(null as varchar(9)) as consolidation_scope, cast(null as boolean) as inflation_adjusted,
  case st when 'F' then 'other' else 'price_determination_report' end as document_type, st as doc_id, half as page_no, 0 as place
from (
  select entity_id, yy, st, half, 'revenue' as metric, urgent as value from {base} union all select entity_id, yy, st, half, 'net_income', high - medium from {base}
  union all select entity_id, yy, st, half, 'financial_debt', medium from {base} union all select entity_id, yy, st, half, 'cash_and_equivalents', low from {base}
  union all select entity_id, yy, st, half, 'equity', unspecified - low from {base} union all select entity_id, yy, st, half, 'current_assets', low from {base}
  union all select entity_id, yy, st, half, 'current_liabilities', unspecified from {base} union all select entity_id, yy, st, half, 'operating_profit', high from {base}
  union all select entity_id, yy, st, half, 'operating_cash_flow', urgent - low from {base} union all select entity_id, yy, st, half, 'finance_expense', medium from {base}) m
where value <> 0 or metric in ('revenue', 'equity')"""
FIN_BASE = """
select o_custkey as entity_id, year(o_orderdate) as yy, o_orderstatus as st, case when month(o_orderdate) <= 6 then 1 else 2 end as half,
  cast(sum(case o_orderpriority when '1-URGENT' then cast(o_totalprice as decimal(18,2)) else 0 end) as double) as urgent,
  cast(sum(case o_orderpriority when '2-HIGH' then cast(o_totalprice as decimal(18,2)) else 0 end) as double) as high,
  cast(sum(case o_orderpriority when '3-MEDIUM' then cast(o_totalprice as decimal(18,2)) else 0 end) as double) as medium,
  cast(sum(case o_orderpriority when '4-NOT SPECIFIED' then cast(o_totalprice as decimal(18,2)) else 0 end) as double) as unspecified,
  cast(sum(case o_orderpriority when '5-LOW' then cast(o_totalprice as decimal(18,2)) else 0 end) as double) as low
from {orders} group by 1, 2, 3, 4"""
