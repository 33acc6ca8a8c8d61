"""Profiling, validation, quarantine, merge and completeness on orders, events, customers and parts."""

from __future__ import annotations

from pyspark.sql import functions as F

from pitlake.operators import quality
from pitlake.session import shared_folder
from pitlake.sources import readers
from workload.registry import day, derive, plain, query, table

ORDER_COLUMNS = {"o_orderkey": "bigint", "o_custkey": "bigint", "o_orderstatus": "string", "o_totalprice": "double",
                 "o_orderdate": "timestamp_ntz", "o_orderpriority": "string"}


@query("profile_table", " union all ".join(
    f"select '{c}' as column_name, '{t}' as observed_type, count(*) as row_count, count(*) - count({c}) as null_count, count({c}) = 0 as always_null from orders"
    for c, t in ORDER_COLUMNS.items()))
def profile_table(spark, d):
    return quality.profile_table(table(spark, d, "orders"))


RECORDS = """
select event_id, case event_type
    when 'click' then '{{"user_id": ' || user_id || ', "kind": "click", "flag": true}}'
    when 'view' then '{{"user_id": "u' || user_id || '", "kind": null}}'
    when 'error' then '{{"user_id": null, "kind": "error", "extra": [1]}}'
    when 'signup' then '[' || user_id || ']'
    else '{{"user_id": ' || user_id || '.5, "kind": "purchase", "flag": 1}}' end as record
from {events}"""
RECORDS_SQL = plain(RECORDS).replace("{{", "{").replace("}}", "}")


@query("profile_json", """select 'k' as key, count(*) as record_count, count(*) as present_count, cast(0 as bigint) as missing_count,
  cast(0 as bigint) as null_count, false as always_null, 'integer' as types from events where json_type(props, '$.k') in ('UBIGINT', 'BIGINT')""")
def profile_json(spark, d):
    return quality.profile_json(table(spark, d, "events"), "props").withColumn("types", F.array_join("types", ","))


@query("profile_mixed_json", f"""with r as (select * from ({RECORDS_SQL}) x where json_type(record) = 'OBJECT'),
cells as (select unnest(json_keys(record)) as key, record from r),
typed as (select key, case json_type(json_extract(record, '$.' || key)) when 'VARCHAR' then 'string' when 'BOOLEAN' then 'boolean' when 'NULL' then 'null'
  when 'ARRAY' then 'array' when 'DOUBLE' then 'number' else 'integer' end as kind from cells),
total as (select count(*) as record_count from r)
select key, record_count, count(*) as present_count, record_count - count(*) as missing_count, count(*) filter (kind = 'null') as null_count,
  count(*) filter (kind = 'null') = count(*) as always_null, string_agg(distinct kind, ',' order by kind) as types from typed, total group by key, record_count""")
def profile_mixed_json(spark, d):
    objects = derive(spark, d, RECORDS).where(F.startswith("record", F.lit("{")))
    return quality.profile_json(objects, "record").withColumn("types", F.array_join("types", ","))


FIELDS = (("user_id", "integer", False), ("kind", "string", True), ("flag", "boolean", True), ("never", "string", True))


@query("validate_schema", f"""with r as ({RECORDS_SQL}),
obj as (select * from r where json_type(record) = 'OBJECT'),
doc as (select * from (values ('user_id', 'integer', false), ('kind', 'string', true), ('flag', 'boolean', true), ('never', 'string', true)) v(field_name, t, nullable)),
judged as (select event_id, field_name, json_type(json_extract(record, '$.' || field_name)) as k, t, nullable, list_contains(json_keys(record), field_name) as has from obj, doc)
select event_id, '<record>' as field_name, 'not_an_object' as issue from r where json_type(record) <> 'OBJECT'
union all select event_id, field_name, 'missing_documented_field' from judged where not has
union all select event_id, field_name, 'unexpected_null' from judged where has and k = 'NULL' and not nullable
union all select event_id, field_name, 'type_mismatch' from judged where has and k <> 'NULL'
  and not case t when 'integer' then k in ('UBIGINT', 'BIGINT') when 'string' then k = 'VARCHAR' else k = 'BOOLEAN' end
union all select event_id, key, 'undocumented_field' from (select event_id, unnest(json_keys(record)) as key from obj) where key not in (select field_name from doc)""")
def validate_schema(spark, d):
    return quality.validate_schema(derive(spark, d, RECORDS), "event_id", "record", FIELDS)


@query("fields_never_observed", "select 'never' as field_name from events having count(*) > 0")
def fields_never_observed(spark, d):
    return quality.fields_never_observed(derive(spark, d, RECORDS), "record", FIELDS)


@query("strict_records", "select o_orderkey as ay, o_orderpriority as donem, o_totalprice as \"halkaArzFiyatiTl\", o_custkey as \"ortakSatisBinTl\" from orders")
def strict_records(spark, d):
    lines = table(spark, d, "orders").select(F.to_json(F.struct(
        F.col("o_orderkey").alias("ay"), F.col("o_orderpriority").alias("donem"), F.col("o_totalprice").alias("halkaArzFiyatiTl"),
        F.col("o_custkey").alias("ortakSatisBinTl"))).alias("value"))
    return readers.strict_records(lines, readers.OFFERING_FIELDS).select("ay", "donem", "halkaArzFiyatiTl", "ortakSatisBinTl")


LINE_COLUMNS = "l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate"


@query("duplicate_rows", f"""select {LINE_COLUMNS.replace('l_shipdate', 'cast(l_shipdate as varchar) as l_shipdate')}, copies
from (select {LINE_COLUMNS}, count(*) as copies from (select * from lineitem union all select * from lineitem where l_quantity > 45) x group by all having count(*) > 1) y""")
def duplicate_rows(spark, d):
    lines = table(spark, d, "lineitem").select(*LINE_COLUMNS.split(", "))
    out = quality.duplicate_rows(lines.unionAll(lines.where("l_quantity > 45")))
    return out.withColumn("l_shipdate", F.date_format("l_shipdate", "yyyy-MM-dd HH:mm:ss"))


@query("identity_candidates", " union all ".join(
    f"select '{c}' as column_name, count(*) as distinct_values, count(*) filter (n > 1) as duplicated_values, min(v) filter (n > 1) as example_value "
    f"from (select cast({c} as varchar) as v, count(*) as n from {t} where {c} is not null group by 1) x having count(*) filter (n > 1) > 0"
    for t, c in [("customer", x) for x in ("c_custkey", "c_name", "c_nationkey", "c_mktsegment")] + [("(select *, cast(round(c_acctbal * 100) as bigint) as acctbal_cents from customer) c", "acctbal_cents")]))
def identity_candidates(spark, d):
    customers = table(spark, d, "customer").select("c_custkey", "c_name", "c_nationkey", "c_mktsegment", F.round(F.col("c_acctbal") * 100).cast("bigint").alias("acctbal_cents"))
    return quality.identity_candidates(customers)


@query("compare_ordering", """select count(*) as first_count, count(*) as second_count, true as same_length, false as stable,
  min(case when o_orderstatus = 'P' and o_totalprice > 400000 then o_orderkey end) as first_divergence from orders""")
def compare_ordering(spark, d):
    a = table(spark, d, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice", "o_orderpriority")
    b = a.withColumn("o_orderpriority", F.when((F.col("o_orderstatus") == "P") & (F.col("o_totalprice") > 400000), "changed").otherwise(F.col("o_orderpriority")))
    return quality.compare_ordering(a, b, "o_orderkey")


RAW_ROWS = """
select event_id, case when event_type = 'error' then ' ' else 'Company ' || user_id end as company_raw,
  case event_type when 'view' then 'n/a' else cast(dd as varchar(9)) || '.' || cast(mm as varchar(9)) || '.2024' end as date_raw
from (select *, 1 + user_id - 40 * cast(floor(user_id / 40.0) as bigint) as dd, 1 + event_id - 13 * cast(floor(event_id / 13.0) as bigint) as mm from {events}) q"""


def judged_rows(spark, d):
    rows = derive(spark, d, RAW_ROWS).withColumn("company_name", F.trim("company_raw")).withColumn("application_date", F.try_to_date("date_raw", "d.M.yyyy"))
    return rows, [
        (F.col("company_name") == "", "empty name"),
        (~F.col("date_raw").rlike(r"^\d{1,2}\.\d{1,2}\.\d{4}$"), "date does not match DD.MM.YYYY"),
        (F.col("application_date").isNull(), "not a calendar date"),
    ]


JUDGED = f"""
judged as (select event_id, trim(company_raw) as company_name, try_strptime(date_raw, '%d.%m.%Y')::date as application_date,
  case when trim(company_raw) = '' then 'empty name' when not regexp_matches(date_raw, '^\\d{{1,2}}\\.\\d{{1,2}}\\.\\d{{4}}$') then 'date does not match DD.MM.YYYY'
    when try_strptime(date_raw, '%d.%m.%Y') is null then 'not a calendar date' end as reason from ({plain(RAW_ROWS)}) x)"""


@query("quarantine_valid", f"with {JUDGED} select event_id, company_name, cast(application_date as varchar) as application_date from judged where reason is null")
def quarantine_valid(spark, d):
    return quality.quarantine(*judged_rows(spark, d))[0].select("event_id", "company_name", day("application_date"))


@query("quarantine_rejects", f"with {JUDGED} select event_id, reason from judged where reason is not null")
def quarantine_rejects(spark, d):
    return quality.quarantine(*judged_rows(spark, d))[1].select("event_id", "reason")


@query("application_report", f"""with {JUDGED} select count(*) as total_rows, count(*) filter (reason is null) as valid_rows, count(*) filter (reason is not null) as invalid_rows,
  cast(min(application_date) filter (reason is null) as varchar) as earliest_date, arg_min(company_name, (application_date, company_name)) filter (reason is null) as earliest_name,
  cast(max(application_date) filter (reason is null) as varchar) as latest_date, arg_max(company_name, (application_date, company_name)) filter (reason is null) as latest_name from judged""")
def application_report(spark, d):
    rows, rules = judged_rows(spark, d)
    out = quality.application_report(quality.with_reject_reason(rows, rules), "company_name", "application_date")
    return out.withColumn("earliest_date", day("earliest_date")).withColumn("latest_date", day("latest_date"))


@query("duplicate_names", """with p as (select p_name, cast(min(l_shipdate) as date) as d from part join lineitem on l_partkey = p_partkey group by p_partkey, p_name),
per as (select p_name, d, count(*) as n from p group by 1, 2)
select p_name, cast(sum(n) as bigint) as row_count, cast(min(d) as varchar) as first_date, cast(max(d) as varchar) as last_date,
  string_agg(cast(d as varchar) || 'x' || n, ',' order by d) as dates from per group by 1 having sum(n) > 1""")
def duplicate_names(spark, d):
    first = table(spark, d, "lineitem").groupBy("l_partkey").agg(F.to_date(F.min("l_shipdate")).alias("d"))
    rows = table(spark, d, "part").join(first, F.col("p_partkey") == F.col("l_partkey")).select("p_name", "d")
    out = quality.duplicate_names(rows, "p_name", "d")
    dates = F.array_join(F.transform("dates", lambda x: F.concat(F.date_format(x["date"], "yyyy-MM-dd"), F.lit("x"), x["n"])), ",")
    return out.select("p_name", "row_count", day("first_date"), day("last_date"), dates.alias("dates"))


WIDE = """
select cast(dd as varchar(9)) || '-' || cast(mm as varchar(9)) || '-' || cast(yy as varchar(9)) as raw_date, a, case when a > '5' then 'n/a' else b end as b
from (select year(o_orderdate) as yy, month(o_orderdate) as mm, dayofmonth(o_orderdate) as dd,
  cast(cast(sum(case when o_orderstatus = 'F' then cast(o_totalprice as decimal(18,2)) end) as decimal(18,2)) as varchar(30)) as a,
  cast(cast(sum(case when o_orderstatus = 'O' then cast(o_totalprice as decimal(18,2)) end) as decimal(18,2)) as varchar(30)) as b
  from {orders} group by 1, 2, 3) q
union all
select cast(year(o_orderdate) as varchar(9)) || '-' || cast(month(o_orderdate) as varchar(9)), cast(null as varchar(30)), cast(cast(count(*) as bigint) as varchar(30)) from {orders} group by 1"""


@query("flatten_wide_series", f"""with w as ({plain(WIDE)}),
p as (select *, case when regexp_matches(raw_date, '^\\d{{1,2}}-\\d{{1,2}}-\\d{{4}}$') then try_strptime(raw_date, '%d-%m-%Y')::date end as dday,
  case when regexp_matches(raw_date, '^\\d{{4}}-\\d{{1,2}}$') then try_cast(raw_date || '-1' as date) end as dmonth from w)
select 'filled' as series, cast(dday as varchar) as obs_date, try_cast(a as double) as value from p where dday is not null and try_cast(a as double) is not null
union all select 'open', cast(dday as varchar), try_cast(b as double) from p where dday is not null and try_cast(b as double) is not null
union all select 'orders', cast(dmonth as varchar), try_cast(b as double) from p where dmonth is not null and try_cast(b as double) is not null""")
def flatten_wide_series(spark, d):
    spec = [("filled", "a", "daily", "usd"), ("open", "b", "daily", "usd"), ("orders", "b", "monthly", "count")]
    return quality.flatten_wide_series(derive(spark, d, WIDE), "raw_date", spec).select("series", day("obs_date"), "value")


BULLETIN = """
select cast(l_shipdate as date) as trade_date, 'P' || l_partkey || case when l_returnflag = 'A' then '.E' else '.X' end as instrument_code,
  case l_returnflag when 'A' then 'EQT' else 'BND' end as instrument_group, case l_linestatus when 'O' then 'MSPOT' else 'MREP' end as market,
  l_extendedprice as open, l_extendedprice as low, l_extendedprice as high, l_extendedprice as close, l_quantity as volume, l_tax as traded_value
from {lineitem}"""


@query("filter_equity_bulletin", """select cast(cast(l_shipdate as date) as varchar) as trading_date, 'P' || l_partkey as ticker, l_extendedprice as close,
  cast(l_quantity as bigint) as volume from lineitem where l_returnflag = 'A' and l_linestatus = 'O'""")
def filter_equity_bulletin(spark, d):
    out = readers.filter_equity_bulletin(derive(spark, d, BULLETIN))
    return out.select(day("trading_date"), "ticker", "close", "volume")


@query("read_bulletin", """select cast(cast(l_shipdate as date) as varchar) as trade_date, l_returnflag as market, l_extendedprice as open, l_tax as close,
  cast(l_quantity as bigint) as volume, count(*) as n from lineitem group by all""")
def read_bulletin(spark, d):
    """A file per ship month; the files of even months have their columns the other way round."""
    values = {"TRADE DATE": F.date_format("l_shipdate", "yyyy-MM-dd"), "MARKET": F.col("l_returnflag"), "OPENING PRICE": F.col("l_extendedprice"), "CLOSING PRICE": F.col("l_tax"),
              "TOTAL TRADED VOLUME": F.col("l_quantity").cast("bigint")}
    values |= {c: F.lit("1") for c in readers.BULLETIN_COLUMNS if c not in values}
    names = list(values)
    lines = table(spark, d, "lineitem").withColumn("month", F.date_format("l_shipdate", "yyyy-MM"))
    backwards = F.month("l_shipdate") % 2 == 0

    def line(cells):
        return F.when(backwards, F.concat_ws(";", *cells[::-1])).otherwise(F.concat_ws(";", *cells))

    heads = lines.dropDuplicates(["month"]).select("month", F.inline(F.array(
        F.struct(F.lit(0).alias("place"), F.lit(";" * (len(names) - 1)).alias("value")), F.struct(F.lit(1).alias("place"), line([F.lit(n) for n in names]).alias("value")))))
    body = lines.select("month", F.lit(2).alias("place"), line([values[n].cast("string") for n in names]).alias("value"))
    folder = shared_folder(spark, "bulletins")
    heads.unionByName(body).repartition("month").sortWithinPartitions("month", "place").select("month", "value").write.partitionBy("month").text(folder)
    out = readers.read_bulletin(spark, folder, len(names)).select("trade_date", "market", *[F.col(c).cast("double").alias(c) for c in ("open", "close")], F.col("volume").cast("bigint").alias("volume"))
    return out.groupBy(*out.columns).agg(F.count(F.lit(1)).alias("n"))


DISCLOSURE_ITEMS = """
select chr(123) || '"disclosureBasic": ' || chr(123) || '"disclosureId": "d' || o_orderkey || '", "disclosureIndex": ' || o_orderkey || ', "title": " ' || o_orderpriority || ' ", "companyTitle": "C' || o_custkey ||
  '", "stockCode": "S' || o_custkey || '", "relatedStocks": "' || case when o_orderstatus = 'F' then 'R1, R2' when o_orderstatus = 'O' then ' R3 ' else '' end ||
  '", "publishDate": "' || case when o_orderstatus = 'P' then 'soon' else '15.0' || (1 + (o_orderkey % 9)) || '.2024 10:20:30' end || '"' || chr(125) || chr(125) as item from {orders}"""


@query("normalize_disclosures", """select 'd' || o_orderkey as disclosure_id, case when o_orderstatus <> 'P' then '2024-0' || (1 + o_orderkey % 9) || '-15 10:20:30' end as published_at,
  'C' || o_custkey as company_name, case when o_orderstatus = 'O' then 'R3' else 'S' || o_custkey end as ticker, o_orderpriority as title, cast(0 as integer) as attachment_count from orders""")
def normalize_disclosures(spark, d):
    out = readers.normalize_disclosures(derive(spark, d, DISCLOSURE_ITEMS))
    return out.select("disclosure_id", F.date_format("published_at", "yyyy-MM-dd HH:mm:ss").alias("published_at"), "company_name", "ticker", "title", "attachment_count")


@query("first_write_wins", """with days as (select user_id, cast(ts as date) as day, min(event_id) as event_id from events group by 1, 2)
select user_id, cast(day as varchar) as day, event_id from days where not exists (
  select 1 from events t where t.user_id = days.user_id and cast(t.ts as date) = days.day and t.event_type = 'click')""")
def first_write_wins(spark, d):
    ev = table(spark, d, "events").select("user_id", F.to_date("ts").alias("day"), "event_id", "event_type")
    fresh = quality.new_first_writes(ev.where("event_type = 'click'"), ev, ["user_id", "day"], ["event_id"])
    return fresh.select("user_id", day("day"), "event_id")


@query("dedup_last_wins", """select user_id, event_type, event_id, round(value, 6) as value from (
  select *, row_number() over (partition by user_id, event_type order by ts desc, event_id desc) as k from events) where k = 1""")
def dedup_last_wins(spark, d):
    out = quality.dedup_last_wins(table(spark, d, "events"), ["user_id", "event_type"], ["ts", "event_id"])
    return out.select("user_id", "event_type", "event_id", F.round("value", 6).alias("value"))


@query("top_reasons", f"with {JUDGED} select reason, count(*) as n from judged where reason is not null group by 1 order by n desc, reason limit 10")
def top_reasons(spark, d):
    return quality.top_reasons(quality.quarantine(*judged_rows(spark, d))[1], "reason", 10)
