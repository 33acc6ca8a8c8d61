"""Text standardization and classification over whole documents, order-derived disclosures and company names."""

from __future__ import annotations

from pyspark.sql import functions as F

from pitlake.functions import numbers, text
from pitlake.operators import context, records
from workload import inputs
from workload.registry import day, derive, plain, query, r6, table

FOLD = "lower(translate({0}, 'İIıŞşĞğÜüÖöÇç', 'iiissgguuoocc'))"


def fold(column: str) -> str:
    return FOLD.format(column)


DISCLOSURES = plain(inputs.DISCLOSURES)
COMPANIES = plain(inputs.COMPANIES)
OR_TITLE = f"coalesce(nullif({fold('summary')}, ''), {fold('title')})"
# DuckDB states the title rules as an ordered CASE.
TITLE_CASE = f"""case when contains(f, 'izahname') then 'approved_prospectus'
  when contains(f, 'tasarruf sahiplerine satis duyurusu') then 'investor_sale_announcement'
  when contains(f, 'fiyat tespit raporuna iliskin analist raporu') or contains(f, 'fiyat tespit raporuna iliskin degerlendirme raporu') then 'price_determination_review'
  when contains(f, 'fiyat tespit raporu') then case when contains(f, 'analist') or contains(f, 'degerlendirme') then 'price_determination_review' else 'price_determination_report' end
  when contains(f, 'halka arz sonuclari') then 'ipo_results' when contains(f, 'islem gormeye baslama') then 'trading_start' else 'other' end"""


@query("fold_text", f"select doc_id, md5({fold('text')}) as folded_md5, length({fold('text')}) as folded_length from documents")
def fold_text(spark, d):
    out = records.standardize_records(table(spark, d, "documents"), {"folded": ("fold", ["text"])})
    return out.select("doc_id", F.md5("folded").alias("folded_md5"), F.length("folded").cast("bigint").alias("folded_length"))


@query("classify_titles", f"""select disclosure_id, {TITLE_CASE} as document_type
from (select *, {fold('title')} as f from ({DISCLOSURES}) x) y""")
def classify_titles(spark, d):
    out = records.classify_records(derive(spark, d, inputs.DISCLOSURES), {"document_type": ("title_class", ["title"])})
    return out.select("disclosure_id", "document_type")


TEXT_RULES = (("released under the mit license", "mit"), ("apache license", "apache"), ("token =", "credential"), ("@mail", "contact"), ("para", "spanish"), ("nicht", "german"))


@query("classify_documents", f"""select doc_id, case {' '.join(f"when contains(f, '{p}') then '{label}'" for p, label in TEXT_RULES[:-1])}
  when contains(f, 'nicht') then case when contains(f, 'für') or contains(f, 'über') then 'german_marked' else 'german' end else 'other' end as label
from (select doc_id, {fold('text')} as f from documents) x""")
def classify_documents(spark, d):
    folded = table(spark, d, "documents").select("doc_id", text.fold_text(F.col("text")).alias("f"))
    label = text.classify_with_veto(F.col("f"), TEXT_RULES, "other", "german", ("für", "über"), "german_marked")
    return folded.select("doc_id", label.alias("label"))


@query("document_role", f"""select disclosure_id, case when not contains(f, 'izahname') then 'attachment'
  when regexp_matches(f, '\\bek[\\s_.\\-]*\\d|\\bekleri\\b|\\beki\\b') then 'attachment'
  when list_bool_or(list_transform({list(records.fixed.APPENDIX_KEYWORDS)}, lambda k: contains(f, k))) then 'attachment'
  else 'base_document' end as document_role
from (select disclosure_id, {OR_TITLE} as f from ({DISCLOSURES}) x) y""")
def document_role(spark, d):
    out = records.classify_records(derive(spark, d, inputs.DISCLOSURES), {"document_role": ("prospectus_role", ["summary", "title"])})
    return out.select("disclosure_id", "document_role")


ATTACHMENTS = """
select 'o' || l_orderkey as entity_id, l_linenumber * 1000000 + l_partkey as position,
  case l_returnflag when 'A' then 'İmza Sayfası ' when 'R' then 'Denetim Raporu ' else case l_linestatus when 'F' then 'KAPAK ' else 'Belge ' end end
    || l_partkey || '.pdf' as file_name
from {lineitem}"""


@query("attachment_role", f"""select entity_id, position, case when contains(f, 'imza') then 'signature' when contains(f, 'kapak') then 'cover_page'
  when contains(f, 'analist') or contains(f, 'degerlendirme') then 'analyst_review'
  when contains(f, 'esas sozlesme') or contains(f, 'denetim raporu') then 'appendix' else 'primary_candidate' end as document_role
from (select *, {fold('file_name')} as f from ({plain(ATTACHMENTS)}) x) y""")
def attachment_role(spark, d):
    out = records.classify_records(derive(spark, d, ATTACHMENTS), {"document_role": ("attachment_role", ["file_name"])})
    return out.select("entity_id", F.col("position").cast("bigint"), "document_role")


@query("pick_primary", f"""select entity_id, min(position) as position, arg_min(file_name, position) as file_name
from ({plain(ATTACHMENTS)}) x where starts_with(file_name, 'Belge') group by 1""")
def pick_primary(spark, d):
    out = records.pick_primary(derive(spark, d, ATTACHMENTS), "entity_id")
    return out.select("entity_id", F.col("position").cast("bigint"), "file_name")


@query("part_number", f"""select disclosure_id, try_cast(regexp_extract({OR_TITLE}, '(\\d+)\\s*\\.\\s*(?:bolum|kisim)\\b', 1) as integer) as part_number
from ({DISCLOSURES}) x""")
def part_number(spark, d):
    out = records.standardize_records(derive(spark, d, inputs.DISCLOSURES), {"lead": ("summary_or_title", ["summary", "title"])})
    out = records.standardize_records(out, {"part_number": ("part_number", ["lead"])})
    return out.select("disclosure_id", "part_number")


NORMAL = """array_to_string(list_filter(regexp_split_to_array(replace({0}, '.', ''), '\\s+'),
  lambda t: t <> '' and not list_contains(['as','anonim','sirketi','sanayi','sanayii','ticaret','ticareti','ve'], t)), ' ')"""


def normal(column: str) -> str:
    return NORMAL.format(fold(column))


@query("normalize_name", f"select c_custkey, {normal('company_name')} as normal_name from ({COMPANIES}) x")
def normalize_name(spark, d):
    out = records.standardize_records(derive(spark, d, inputs.COMPANIES), {"normal_name": ("name", ["company_name"])})
    return out.select("c_custkey", "normal_name")


def one_token(column: str) -> str:
    parts = f"list_filter(list_transform(string_split({column}, ','), lambda t: trim(t)), lambda t: t <> '')"
    return f"case when len({parts}) = 1 then {parts}[1] end"


@query("subject_key", f"select disclosure_id, coalesce({one_token('related')}, {one_token('ticker')}) as subject from ({DISCLOSURES}) x")
def subject_key(spark, d):
    out = records.standardize_records(derive(spark, d, inputs.DISCLOSURES), {"subject": ("subject_key", ["related", "ticker"])})
    return out.select("disclosure_id", "subject")


AMOUNTS = """
select o_orderkey, case o_orderstatus when 'F' then '(' || b || ')' when 'P' then '-' || b else b end as raw from (
  select o_orderkey, o_orderstatus, cast(cast(floor(o_totalprice / 1000) as bigint) as varchar(20)) || '.' ||
    lpad(cast(cast(floor(o_totalprice) as bigint) - 1000 * cast(floor(o_totalprice / 1000) as bigint) as varchar(20)), 3, '0') ||
    case when o_orderpriority = '5-LOW' then ',x' else ',25' end as b from {orders}) q"""


@query("parse_signed_number", f"""select o_orderkey, case when starts_with(raw, '(') or starts_with(raw, '-') then -v else v end as amount
from (select *, try_cast(replace(replace(regexp_replace(raw, '[()-]', '', 'g'), '.', ''), ',', '.') as double) as v from ({plain(AMOUNTS)}) x) y""")
def parse_signed_number(spark, d):
    return records.standardize_records(derive(spark, d, AMOUNTS), {"amount": ("signed_number", ["raw"])}).select("o_orderkey", "amount")


@query("parse_number", f"""select o_orderkey, try_cast(replace(replace(raw, '.', ''), ',', '.') as double) as amount from ({plain(AMOUNTS)}) x""")
def parse_number(spark, d):
    return records.standardize_records(derive(spark, d, AMOUNTS), {"amount": ("number", ["raw"])}).select("o_orderkey", "amount")


RAW_DATES = """
select event_id, dd, mm, mname, cast(dd as varchar(9)) || sep || cast(mm as varchar(9)) || sep || '2024' as raw, '2024 / ' || cast(mm as varchar(9)) as period from (
  select event_id, case event_type when 'click' then '.' when 'view' then '/' else '-' end as sep,
    1 + user_id - 40 * cast(floor(user_id / 40.0) as bigint) as dd, 1 + event_id - 13 * cast(floor(event_id / 13.0) as bigint) as mm,
    case event_type when 'click' then 'Şubat' when 'view' then 'EYLÜL' when 'error' then 'mayis' else 'brumaire' end as mname
  from {events}) q"""


@query("parse_dates", f"""select event_id,
  cast(case when contains(raw, '-') then null else try_strptime(replace(raw, '/', '.'), '%d.%m.%Y') end::date as varchar) as dotted,
  cast(try_cast('2024-' || mm || '-1' as date) as varchar) as period_start,
  cast(try_cast('2024-' || case {fold('mname')} when 'subat' then '2' when 'eylul' then '9' when 'mayis' then '5' end || '-' || dd as date) as varchar) as named
from ({plain(RAW_DATES)}) x""")
def parse_dates(spark, d):
    out = derive(spark, d, RAW_DATES).withColumn("m", text.fold_text(F.col("mname"))).withColumn("y", F.lit("2024")).withColumn("dd", F.col("dd").cast("string"))
    out = records.standardize_records(out, {"dotted": ("date", ["raw"]), "period_start": ("period_start", ["period"]), "named": ("month_name_date", ["dd", "m", "y"])})
    return out.select("event_id", day("dotted"), day("period_start"), day("named"))


@query("classify_sector", f"""select c_custkey, case when regexp_matches(f, '\\bsigorta\\b|hayat ve emeklilik|\\bemeklilik\\b') then 'insurance'
  when regexp_matches(f, '\\bbankasi\\b|\\bbank\\b') then 'banking' when regexp_matches(f, 'gayrimenkul yatirim ortakligi|\\bgyo\\b') then 'reit'
  when contains(f, 'yatirim ortakligi') then 'investment_holding' else 'standard' end as sector
from (select c_custkey, {fold('company_name')} as f from ({COMPANIES}) x) y""")
def classify_sector(spark, d):
    return records.classify_records(derive(spark, d, inputs.COMPANIES), {"sector": ("sector", ["company_name"])}).select("c_custkey", "sector")


RATIOS = ["revenue_growth_yoy", "net_margin", "current_ratio", "interest_coverage", "net_debt"]


@query("applicability", f"""select c_custkey, ratio, case when (c_mktsegment = 'MACHINERY' and ratio in ('revenue_growth_yoy', 'net_margin', 'interest_coverage'))
  or (c_mktsegment = 'HOUSEHOLD' and ratio = 'current_ratio') then 'not_applicable' else 'applicable' end as status
from customer cross join unnest({RATIOS}) u(ratio)""")
def applicability(spark, d):
    named = records.classify_records(derive(spark, d, inputs.COMPANIES), {"sector": ("sector", ["company_name"])})
    wide = named.select("c_custkey", "sector", F.explode(F.array(*[F.lit(r) for r in RATIOS])).alias("ratio"))
    skip = records.not_applicable(F.col("sector"), F.col("ratio"), records.fixed.SECTOR_SKIPS_RATIO)
    return wide.select("c_custkey", "ratio", F.when(skip, "not_applicable").otherwise("applicable").alias("status"))


@query("entity_keys", f"""select c_custkey, 'ipo:' || case when ticker <> '' then ticker else company_name end || ':' || coalesce(period, '') as entity_key,
  'application:' || company_name || ':2024-01-15' as application_key from ({COMPANIES}) x""")
def entity_keys(spark, d):
    out = derive(spark, d, inputs.COMPANIES).withColumn("on", F.to_date(F.lit("2024-01-15")))
    return records.standardize_records(out, {
        "entity_key": ("entity_key", ["ticker", "company_name", "period"]), "application_key": ("application_key", ["company_name", "on"]),
    }).select("c_custkey", "entity_key", "application_key")


@query("content_hash", """select o_orderkey, sha256(o_orderkey || '|' || o_orderstatus || '|' || o_orderpriority || '|' || cast(round(o_totalprice * 100) as bigint)) as content_hash
from orders""")
def content_hash(spark, d):
    cents = F.round(F.col("o_totalprice") * 100).cast("bigint")
    hashed = text.content_hash([F.col("o_orderkey"), F.col("o_orderstatus"), F.col("o_orderpriority"), cents])
    return table(spark, d, "orders").select("o_orderkey", hashed.alias("content_hash"))


@query("withdrawal_flags", "select o_custkey, bool_or(o_orderpriority = '5-LOW') as withdrawn from orders group by 1")
def withdrawal_flags(spark, d):
    return records.withdrawal_flags(derive(spark, d, inputs.DISCLOSURES), "o_custkey")


@query("band_normalize", """select c_custkey,
  round(0.0 + least(1, greatest(0, (c_acctbal + 200) / 6200)) * 100, 6) as rising,
  round(100.0 + least(1, greatest(0, (c_acctbal - 0) / 5000)) * (0 - 100), 6) as falling,
  cast(40 as double) as flat from customer""")
def band_normalize(spark, d):
    value = F.col("c_acctbal")

    def band(*v):
        return numbers.band_normalize(value, *[F.lit(float(x)) for x in v])

    return table(spark, d, "customer").select(
        "c_custkey", r6(band(-200, 0, 6000, 100), "rising"), r6(band(0, 100, 5000, 0), "falling"), r6(band(7, 10, 7, 40), "flat"))


SECTION_FAMILIES = (("licensing", ("license",)), ("contact", ("@mail", "token")), ("romance", (" de ", " la ")), ("english", (" the ", " and ")))


@query("budgeted_selection", f"""with named as (
  select source, lang, doc_id, case when contains(f, 'license') then 'licensing' when contains(f, '@mail') or contains(f, 'token') then 'contact'
    when contains(f, ' de ') or contains(f, ' la ') then 'romance' when contains(f, ' the ') or contains(f, ' and ') then 'english' end as category,
    left(regexp_replace(regexp_replace(text, '^\\s+', ''), '\\s+$', ''), 1500) as section
  from (select *, {fold('text')} as f from documents) x),
summed as (select *, sum(length(section)) over (partition by source order by doc_id) as chars_so_far from named where category is not null)
select source, doc_id, category, length(section) as section_chars, cast(chars_so_far as bigint) as chars_so_far from summed where chars_so_far <= 12000""")
def budgeted_selection(spark, d):
    items = table(spark, d, "documents").select(F.col("source").alias("entity_id"), "doc_id", "text")
    out = context.budgeted_selection(items, ["doc_id"], SECTION_FAMILIES)
    return out.select(F.col("entity_id").alias("source"), "doc_id", "category", F.length("section").cast("bigint").alias("section_chars"), "chars_so_far")


# One entity holds every document: its sections are cut into slices of their order.
@query("budget_of_one_entity", """with lengths as (select doc_id, least(length(regexp_replace(regexp_replace(text, '^\\s+', ''), '\\s+$', '')), 500) as n from documents),
summed as (select doc_id, n, sum(n) over (order by doc_id) as upto from lengths where n > 0)
select doc_id, cast(n as bigint) as section_chars, cast(upto as bigint) as chars_so_far from summed where upto <= 200000""")
def budget_of_one_entity(spark, d):
    items = table(spark, d, "documents").select(F.lit("all").alias("entity_id"), "doc_id", "text")
    out = context.budgeted_selection(items, ["doc_id"], (("any", ("",)),), section_chars=500, total_chars=200_000)
    return out.select("doc_id", F.length("section").cast("bigint").alias("section_chars"), "chars_so_far")


@query("rank_candidates", f"""select o_custkey, disclosure_id, row_number() over (partition by o_custkey
  order by case when contains({OR_TITLE}, '2. bolum') then 2 end desc nulls last, published_at, disclosure_id) as candidate_rank from ({DISCLOSURES}) x""")
def rank_candidates(spark, d):
    out = records.standardize_records(derive(spark, d, inputs.DISCLOSURES), {"lead": ("summary_or_title", ["summary", "title"])})
    out = records.standardize_records(out, {"part_number": ("part_number", ["lead"])}).withColumnRenamed("disclosure_id", "doc_id")
    return context.rank_candidates(out, "o_custkey").select("o_custkey", F.col("doc_id").alias("disclosure_id"), F.col("candidate_rank").cast("bigint"))


@query("canonical_hash", """select user_id, event_id, sha256(cast(to_json(struct_pack(event_id := event_id, event_type := event_type, props := props)) as varchar)) as content
from events""")
def canonical_hash(spark, d):
    fields = {name: F.col(name) for name in ("props", "event_type", "event_id")}
    return table(spark, d, "events").select("user_id", "event_id", text.canonical_hash(fields).alias("content"))


# A table of 300 rules over customer names; every tenth is a regular expression, every fifth has veto markers.
RULE_ROWS = """
select i * 37 % 300 as rule_order, case when i % 10 = 0 then '0' || cast(i // 10 as varchar(9)) || '[1-4]$' else lpad(cast(i as varchar(9)), 3, '0') end as pattern, i % 10 = 0 as is_regex,
  'class ' || cast(i % 7 as varchar(9)) as label, i % 5 = 0 as has_veto"""


@query("classify_by_table", f"""with rules as ({RULE_ROWS} from (select unnest(range(300)) as i) r),
hits as (select c_custkey, c_name, rule_order, label, has_veto from customer join rules on case when is_regex then regexp_matches(lower(c_name), pattern) else contains(lower(c_name), pattern) end),
first as (select c_custkey, any_value(c_name) as c_name, arg_min(label, rule_order) as label, arg_min(has_veto, rule_order) as has_veto from hits group by 1)
select c.c_custkey, case when f.label is null then 'other' when f.has_veto and (contains(lower(c.c_name), '9') or contains(lower(c.c_name), '00000077')) then 'reviewed' else f.label end as class
from customer c left join first f using (c_custkey)""")
def classify_by_table(spark, d):
    rules = spark.range(300).withColumnRenamed("id", "i").selectExpr(*[e.strip() for e in (
        "i * 37 % 300 as rule_order", "case when i % 10 = 0 then concat('0', i div 10, '[1-4]$') else lpad(i, 3, '0') end as pattern", "i % 10 = 0 as is_regex",
        "concat('class ', i % 7) as label", "case when i % 5 = 0 then array('9', '00000077') end as veto", "'reviewed' as veto_label")])
    return records.classify_by_table(table(spark, d, "customer"), "c_name", rules, "class").select("c_custkey", "class")
