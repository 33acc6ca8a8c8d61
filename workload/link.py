"""Record linkage over order-derived disclosures, customer-derived offerings and applications."""

from __future__ import annotations

from pyspark.sql import functions as F

from pitlake.operators import link
from workload import inputs
from workload.registry import day, derive, plain, query, table
from workload.text import fold, normal

DIS, OFF, APP = plain(inputs.DISCLOSURES), plain(inputs.OFFERINGS), plain(inputs.APPLICATIONS)


@query("link_records", f"""with l as ({DIS}), o as ({OFF}), a as ({APP}),
keys as (select upper(trim(ticker)) as k, min(record_id) as one, max(record_id) as other from o where ticker <> '' group by 1),
pool as (select record_id, company_name from o union all select record_id, company_name from a),
names as (select {normal('company_name')} as n, min(record_id) as one, max(record_id) as other from pool group by 1),
hits as (select disclosure_id, ticker <> '' as has_key, case when ticker <> '' then case when k.one = k.other then k.one end
   else case when n.one = n.other then n.one end end as record_id
 from l left join keys k on k.k = upper(trim(l.ticker)) left join names n on n.n = {normal('l.company_name')})
select disclosure_id, record_id, case when record_id is null then 'unmatched' when has_key then 'ticker' else 'company_name' end as match_method from hits""")
def link_records(spark, d):
    out = link.link_records(derive(spark, d, inputs.DISCLOSURES), derive(spark, d, inputs.OFFERINGS), derive(spark, d, inputs.APPLICATIONS))
    return out.select("disclosure_id", "record_id", "match_method")


@query("link_registered", f"""with c as ({plain(inputs.COMPANIES)}), o as ({OFF}), a as ({APP}),
keys as (select upper(trim(ticker)) as k, arg_min(record_id, c_custkey) as r from o group by 1),
names as (select {normal('company_name')} as n, arg_min(record_id, position) as r from a group by 1)
select c_custkey, coalesce(keys.r, names.r) as record_id from (select c_custkey, 'C' || c_custkey as ticker, company_name from c) s
left join keys on keys.k = s.ticker left join names on names.n = {normal('s.company_name')}""")
def link_registered(spark, d):
    sources = derive(spark, d, inputs.COMPANIES).withColumn("ticker", F.concat(F.lit("C"), F.col("c_custkey")))
    offerings = derive(spark, d, inputs.OFFERINGS).withColumnRenamed("c_custkey", "position")
    out = link.link_registered(sources, offerings, derive(spark, d, inputs.APPLICATIONS))
    return out.select("c_custkey", "record_id")


IDENTITY = """
select 'e' || o_custkey as record_id, disclosure_id, published_at, company_name || ' v' || substring(disclosure_id, 2, 1) as company_name,
  case when title = 'Halka Arz İPTAL Başvurusu' then ticker else '' end as ticker,
  case title when 'Onaylı İzahname' then 'approved_prospectus' when 'Tasarruf Sahiplerine Satış Duyurusu' then 'investor_sale_announcement' else 'other' end as document_type
from (""" + inputs.DISCLOSURES + ") x"


@query("resolve_identity", f"""with e as (select 'e' || c_custkey as record_id, c_custkey, c_acctbal, c_name, c_nationkey from customer),
dis as ({plain(IDENTITY)}),
said as (select record_id, arg_min(company_name, (case document_type when 'approved_prospectus' then 0 when 'investor_sale_announcement' then 1 else 2 end, published_at, disclosure_id)) as said_name from dis group by 1),
coded as (select record_id, arg_min(ticker, (published_at, disclosure_id)) as said_code from dis where ticker <> '' group by 1)
select record_id, case when c_acctbal > 7000 then 'off ' || c_name when c_acctbal > 4000 then 'app ' || c_name else coalesce(said_name, record_id) end as company_name,
  case when c_acctbal > 7000 and c_nationkey > 4 then 'T' || c_custkey else said_code end as ticker
from e left join said using (record_id) left join coded using (record_id)""")
def resolve_identity(spark, d):
    e = table(spark, d, "customer").withColumn("record_id", F.concat(F.lit("e"), F.col("c_custkey")))
    offered = e.where("c_acctbal > 7000").select("record_id", F.concat(F.lit("off "), "c_name").alias("company_name"),
                                                  F.when(F.col("c_nationkey") > 4, F.concat(F.lit("T"), "c_custkey")).otherwise("").alias("ticker"))
    applied = e.where("c_acctbal > 4000").select("record_id", F.concat(F.lit("app "), "c_name").alias("company_name"))
    return link.resolve_identity(e, offered, applied, derive(spark, d, IDENTITY))


@query("attach_application", f"""with a as ({APP}), n as (select distinct o_custkey, upper(trim(company_name)) as n from ({DIS}) x)
select o_custkey, arg_min(record_id, position) as application_id, '2024-01-15' as application_date
from n join a on upper(trim(a.company_name)) = n.n group by 1""")
def attach_application(spark, d):
    dis = derive(spark, d, inputs.DISCLOSURES).select(F.col("o_custkey").alias("record_id"), "company_name")
    apps = derive(spark, d, inputs.APPLICATIONS).withColumnRenamed("record_id", "application_id")
    out = link.attach_application(dis, apps)
    return out.select(F.col("record_id").alias("o_custkey"), "application_id", day("application_date"))


REQUIRED = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED"]


@query("missing_required", f"""select c_custkey, document_type from customer cross join unnest({REQUIRED}) u(document_type)
where not exists (select 1 from orders where o_custkey = c_custkey and o_orderpriority = document_type
  and (o_orderstatus <> 'P') and (o_orderpriority <> '1-URGENT' or o_orderstatus = 'F'))""")
def missing_required(spark, d):
    docs = table(spark, d, "orders").select(
        F.col("o_custkey").alias("c_custkey"), F.col("o_orderpriority").alias("document_type"),
        ((F.col("o_orderstatus") != "P") & ((F.col("o_orderpriority") != "1-URGENT") | (F.col("o_orderstatus") == "F"))).alias("usable"))
    return link.missing_required(table(spark, d, "customer"), docs, REQUIRED, "c_custkey")


@query("unseen_records", """select distinct user_id from events where ts >= '2024-01-20' and user_id not in (select user_id from events where event_type = 'purchase' and ts < '2024-01-08')""")
def unseen_records(spark, d):
    ev = table(spark, d, "events")
    seen = ev.where("event_type = 'purchase' and ts < '2024-01-08'").select("user_id").distinct()
    announce, _ = link.emit_new(ev.where("ts >= '2024-01-20'").select("user_id").distinct(), seen, "user_id")
    return announce


@query("remembered_keys", """select distinct user_id from events where (event_type = 'purchase' and ts < '2024-01-08') or ts >= '2024-01-20'""")
def remembered_keys(spark, d):
    ev = table(spark, d, "events")
    seen = ev.where("event_type = 'purchase' and ts < '2024-01-08'").select("user_id").distinct()
    return link.emit_new(ev.where("ts >= '2024-01-20'"), seen, "user_id")[1]


@query("fallback_fill", """with p as (select o_custkey, o_orderpriority as field, count(*) as n, round(sum(cast(o_totalprice as decimal(18,2))), 2) as v from orders where o_orderstatus = 'F' group by 1, 2),
pf as (select o_custkey, field, case when n > 2 then 'conflicting' when n = 2 then 'not_found' else 'extracted' end as status, case when n = 1 then v end as v from p),
f as (select o_custkey, o_orderpriority as field, 'extracted' as status, max(o_totalprice) as v from orders where o_orderstatus = 'O' group by 1, 2)
select coalesce(pf.o_custkey, f.o_custkey) as o_custkey, coalesce(pf.field, f.field) as field,
  case when pf.status <> 'not_found' or f.status is null then pf.status else f.status end as status,
  round(cast(case when pf.status <> 'not_found' or f.status is null then pf.v else f.v end as double), 2) as v
from pf full join f on pf.o_custkey = f.o_custkey and pf.field = f.field""")
def fallback_fill(spark, d):
    orders = table(spark, d, "orders").withColumnRenamed("o_orderpriority", "field")
    p = orders.where("o_orderstatus = 'F'").groupBy("o_custkey", "field").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col("o_totalprice").cast("decimal(18,2)")).cast("double").alias("v"))
    p = p.select("o_custkey", "field", F.when(F.col("n") > 2, "conflicting").when(F.col("n") == 2, "not_found").otherwise("extracted").alias("status"),
                 F.when(F.col("n") == 1, F.col("v")).alias("v"))
    f = orders.where("o_orderstatus = 'O'").groupBy("o_custkey", "field").agg(F.lit("extracted").alias("status"), F.max("o_totalprice").alias("v"))
    return link.fallback_fill(p, f, ["o_custkey", "field"]).select("o_custkey", "field", "status", F.round("v", 2).alias("v"))


@query("skip_known_content", """with recursive docs as (
  select source as entity_id, lang as document_type, doc_id, sha256(text) as h from documents
  where sha256(text) not in (select sha256(text) from documents where doc_id in (select doc_id from labels where toxic = 1))),
picks as (
  select source as entity_id, cast(-1 as bigint) as doc_id, cast([] as varchar[]) as types, cast([] as varchar[]) as hashes, 0 as step from documents group by 1
  union all
  select p.entity_id, n.doc_id, list_append(p.types, n.document_type), list_append(p.hashes, n.h), p.step + 1
  from picks p join lateral (
    select * from docs x where x.entity_id = p.entity_id and x.doc_id > p.doc_id and not list_contains(p.types, x.document_type) and not list_contains(p.hashes, x.h)
    order by x.doc_id limit 1) n on true)
select entity_id, cast(doc_id as bigint) as doc_id, types[-1] as document_type from picks where step > 0""")
def skip_known_content(spark, d):
    docs = table(spark, d, "documents")
    toxic = table(spark, d, "labels").where("toxic = 1").select("doc_id")
    known = docs.join(toxic, "doc_id", "left_semi").select(F.sha2("text", 256).alias("content_hash"))
    items = docs.select(F.col("source").alias("entity_id"), F.col("lang").alias("document_type"), F.col("doc_id").alias("position"),
                        F.col("doc_id").cast("string").alias("doc_id"), F.col("text").alias("content"))
    accepted, _ = link.skip_known_content(items, known, ["en", "fr", "de", "es"])
    return accepted.select("entity_id", F.col("position").alias("doc_id"), "document_type")


@query("known_content_duplicates", """select doc_id from documents where sha256(text) in (
  select sha256(text) from documents where doc_id in (select doc_id from labels where toxic = 1))""")
def known_content_duplicates(spark, d):
    docs = table(spark, d, "documents")
    toxic = table(spark, d, "labels").where("toxic = 1").select("doc_id")
    known = docs.join(toxic, "doc_id", "left_semi").select(F.sha2("text", 256).alias("content_hash"))
    items = docs.select(F.col("source").alias("entity_id"), F.col("lang").alias("document_type"), F.col("doc_id").alias("position"),
                        "doc_id", F.col("text").alias("content"))
    return link.skip_known_content(items, known, ["en", "fr", "de", "es"])[1].select("doc_id")


@query("invalid_citations", """select distinct l_orderkey as output_id, l_partkey as doc_id, l_linenumber as page_no from lineitem l where l_returnflag = 'A'
and not exists (select 1 from lineitem s where s.l_orderkey = l.l_orderkey and s.l_partkey = l.l_partkey and s.l_linenumber = l.l_linenumber and s.l_linestatus = 'O')""")
def invalid_citations(spark, d):
    lines = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("output_id"), F.col("l_partkey").alias("doc_id"),
                                              F.col("l_linenumber").alias("page_no"), "l_returnflag", "l_linestatus")
    outputs = lines.where("l_returnflag = 'A'").groupBy("output_id").agg(F.collect_set(F.struct("doc_id", "page_no")).alias("citations"))
    return link.validate_citations(outputs, lines.where("l_linestatus = 'O'"))


@query("ungrounded_claims", f"""with v as (
  select c.conv_id, {fold("b.word")} as term from (select distinct conv_id from conversations) c
  join (select item_id, split_part(text, ' ', 1) as word from benchmark) b on b.item_id = c.conv_id)
select conv_id, turn from conversations c where role = 'assistant'
and not exists (select 1 from v where v.conv_id = c.conv_id and term <> '' and contains({fold("c.text")}, term))""")
def ungrounded_claims(spark, d):
    claims = table(spark, d, "conversations").where("role = 'assistant'").select(F.col("conv_id").alias("entity_id"), "turn", F.col("text").alias("claim"))
    vocabulary = table(spark, d, "benchmark").select(F.col("item_id").alias("entity_id"), F.split_part("text", F.lit(" "), F.lit(1)).alias("term"))
    return link.validate_grounding(claims, vocabulary).select(F.col("entity_id").alias("conv_id"), "turn")
