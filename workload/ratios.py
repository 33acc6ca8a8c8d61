"""Ratios on yearly metrics per customer, two half-year documents per status (NULL scope and inflation flag throughout)."""

from __future__ import annotations

from pyspark.sql import functions as F

from pitlake.operators import ratios, records
from workload import inputs
from workload.registry import day, derive, plain, query, r6

FIN_SQL = f"base_ as ({plain(inputs.FIN_BASE)}), fin as ({inputs.FIN.replace('{base}', 'base_')})"
SAME = "n.period_start = d.period_start and n.period_end = d.period_end and n.currency = d.currency and n.scale = d.scale and n.consolidation_scope is not distinct from d.consolidation_scope and n.inflation_adjusted is not distinct from d.inflation_adjusted"


def fin(spark, d):
    return spark.sql(inputs.FIN, base=derive(spark, d, inputs.FIN_BASE))


def people(spark, d):
    named = records.classify_records(derive(spark, d, inputs.COMPANIES), {"sector": ("sector", ["company_name"])})
    return named.select(F.col("c_custkey").alias("entity_id"), "sector", "c_acctbal", "c_nationkey")


def pair_sql(name: str, first: str, second: str) -> str:
    return f"""select n.entity_id, '{name}' as name, n.period_end, n.value as a, d.value as b,
  row_number() over (partition by n.entity_id order by n.period_end desc, n.doc_id, n.page_no, d.doc_id, d.page_no) as k
  from fin n join fin d on n.entity_id = d.entity_id and {SAME} where n.metric = '{first}' and d.metric = '{second}'"""


PAIRS = f"{FIN_SQL}, pairs as (select * from ({' union all '.join(pair_sql(n, a, b) for n, (a, b, _) in ratios.RATIOS.items())}) p where k = 1)"


@query("compatible_pairs", f"with {PAIRS} select entity_id, name, cast(period_end as varchar) as period_end, round(a, 2) as first_value, round(b, 2) as second_value from pairs")
def compatible_pairs(spark, d):
    out = ratios.compatible_pairs(fin(spark, d), [(n, a, b) for n, (a, b, _) in ratios.RATIOS.items()])
    return out.select("entity_id", "name", day("period_end"), F.round("first_value", 2).alias("first_value"), F.round("second_value", 2).alias("second_value"))


RATIO_SQL = f"""{PAIRS}, names as (select unnest({list(ratios.RATIOS)}) as name),
valued as (select c_custkey as entity_id, names.name, a, case names.name when 'net_margin' then case when a <> 0 then b / a end when 'net_debt' then a - b else case when b > 0 then a / b end end as v
  from customer cross join names left join pairs on pairs.entity_id = c_custkey and pairs.name = names.name)"""


@query("pair_ratios", f"""with {RATIO_SQL} select entity_id, name, case when v is null then 'unavailable' else 'computed' end as status, round(v, 6) as value,
  case when a is null then 'no pair sharing period, scope, currency, scale and inflation status' when v is null then 'denominator is zero or negative' end as reason from valued""")
def pair_ratios(spark, d):
    return ratios.pair_ratios(people(spark, d), fin(spark, d)).select("entity_id", "name", "status", r6("value"), "reason")


GROWTH_SQL = """growth as (
  with rev as (select *, row_number() over (partition by entity_id order by period_end desc, doc_id, page_no) as k from fin where metric = 'revenue' and period_type = 'ANNUAL'),
  cur as (select * from rev where k = 1),
  prior as (select c.entity_id, p.value, row_number() over (partition by c.entity_id order by p.doc_id, p.page_no) as k from cur c join rev p
    on p.entity_id = c.entity_id and p.currency = c.currency and p.scale = c.scale and year(p.period_end) = year(c.period_end) - 1)
  select c_custkey as entity_id, cur.value as now, prior.value as before, (cur.value - prior.value) / nullif(prior.value, 0) as v
  from customer left join cur on cur.entity_id = c_custkey left join prior on prior.entity_id = c_custkey and prior.k = 1)"""


@query("growth_yoy", f"""with {FIN_SQL}, {GROWTH_SQL} select entity_id, case when v is null then 'unavailable' else 'computed' end as status, round(v, 6) as value,
  case when now is null then 'no annual revenue' when before is null then 'no comparable annual revenue for the prior year' when v is null then 'prior-year revenue is zero' end as reason from growth""")
def growth_yoy(spark, d):
    return ratios.growth_yoy(people(spark, d), fin(spark, d)).select("entity_id", "status", r6("value"), "reason")


def said(spark, d):
    people_ = people(spark, d)
    cells = F.array(
        F.struct(F.lit("reported_post_money_market_cap").alias("field"), F.when(F.col("c_acctbal") > 0, "extracted").otherwise("conflicting").alias("status"),
                 F.when(F.col("c_acctbal") > 0, F.col("c_acctbal") * 1000).alias("value_num")),
        F.struct(F.lit("reported_pe").alias("field"), F.when(F.col("c_nationkey") < 10, "extracted").otherwise("not_found").alias("status"),
                 F.when(F.col("c_nationkey") < 10, F.col("c_nationkey").cast("double")).alias("value_num")))
    return people_.select("entity_id", F.inline(cells))


MULT_SQL = """mult as (
  with inc as (select *, row_number() over (partition by entity_id order by period_end desc, doc_id, page_no) as k from fin where metric = 'net_income' and period_type = 'ANNUAL' and currency = 'USD' and scale = 'million')
  select c_custkey as entity_id, case when c_acctbal > 0 and inc.value > 0 then c_acctbal * 1000 / inc.value end as pe, case when c_nationkey < 10 then c_nationkey end as said
  from customer left join inc on inc.entity_id = c_custkey and inc.k = 1)"""


@query("recalculated_multiples", f"""with {FIN_SQL}, {MULT_SQL}
select entity_id, 'recalculated_pe' as name, case when pe is null then 'unavailable' else 'computed' end as status, round(pe, 6) as value from mult
union all select entity_id, 'reported_pe_difference_percentage', case when (pe - said) / nullif(said, 0) is null then 'unavailable' else 'computed' end, round((pe - said) / nullif(said, 0) * 100, 6) from mult""")
def recalculated_multiples(spark, d):
    return ratios.recalculated_multiples(people(spark, d), said(spark, d), fin(spark, d)).select("entity_id", "name", "status", r6("value"))


ALL_SQL = f"""{RATIO_SQL}, {GROWTH_SQL}, {MULT_SQL},
every as (select entity_id, name, v from valued union all select entity_id, 'revenue_growth_yoy', v from growth union all select entity_id, 'recalculated_pe', pe from mult
  union all select entity_id, 'reported_pe_difference_percentage', (pe - said) / nullif(said, 0) * 100 from mult),
final as (select e.entity_id, e.name, case when (c_mktsegment = 'MACHINERY' and name in ('revenue_growth_yoy', 'net_margin', 'interest_coverage')) or (c_mktsegment = 'HOUSEHOLD' and name = 'current_ratio')
    then 'not_applicable' when v is null then 'unavailable' else 'computed' end as status, v from every e join customer on c_custkey = e.entity_id)"""


@query("derived_financials", f"with {ALL_SQL} select entity_id, name, status, case when status = 'computed' then round(v, 6) end as value from final")
def derived_financials(spark, d):
    who = people(spark, d)
    out = ratios.derived_financials(who, fin(spark, d), said(spark, d), who)
    return out.select("entity_id", "name", "status", r6("value"))


@query("multiples_at_offer", f"""with {FIN_SQL},
latest as (select entity_id, metric, value * case scale when 'thousand' then 1000.0 when 'million' then 1000000.0 else 1.0 end as v,
    row_number() over (partition by entity_id, metric order by period_end desc, doc_id, page_no) as k
  from fin where period_type = 'ANNUAL' and currency = 'TRY' and document_type = 'price_determination_report' and metric in ('net_income', 'revenue', 'equity')),
w as (select c_custkey as entity_id, c_mktsegment, case when c_acctbal > 0 then c_acctbal * 1000000 end as cap,
    max(case when metric = 'net_income' and v > 0 then v end) as ni, max(case when metric = 'revenue' and v > 0 then v end) as rev, max(case when metric = 'equity' and v > 0 then v end) as eq
  from customer left join latest on latest.entity_id = c_custkey and k = 1 group by 1, 2, 3)
select entity_id, round(cap, 2) as implied_market_cap, round(cap / ni, 6) as pe_at_offer, case when c_mktsegment <> 'MACHINERY' then round(cap / rev, 6) end as ps_at_offer, round(cap / eq, 6) as pb_at_offer,
  case when c_mktsegment = 'MACHINERY' then 'not_applicable' when cap / rev is null then 'unavailable' else 'computed' end as ps_at_offer_status,
  case when cap / ni is not null or cap / eq is not null or (c_mktsegment <> 'MACHINERY' and cap / rev is not null) then 'SUFFICIENT' else 'INSUFFICIENT' end as sufficiency from w""")
def multiples_at_offer(spark, d):
    who = people(spark, d)
    caps = who.select("entity_id", F.lit("implied_post_money_market_cap").alias("term"), F.when(F.col("c_acctbal") > 0, "extracted").otherwise("not_found").alias("status"),
                      F.when(F.col("c_acctbal") > 0, F.col("c_acctbal") * 1000000).alias("value_num"))
    out = ratios.multiples_at_offer(caps, fin(spark, d), who)
    return out.select("entity_id", F.round("implied_market_cap", 2).alias("implied_market_cap"), *[r6(c) for c in ratios.MULTIPLES], "ps_at_offer_status", "sufficiency")
