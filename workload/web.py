"""Links and shape of the raw pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from pitlake.operators import pages
from pitlake.sources import html
from workload.registry import query, table

LINK_RULES = (("the", "english"), ("de", "spanish"), ("nicht", "german"), ("la", "spanish"))


@query("discover_links", """with a as (
  select page_id, url, regexp_extract(url, '^(https?)', 1) as scheme, regexp_extract(url, '^(https?://[^/?#]*)', 1) as root,
    unnest(regexp_extract_all(html, '<a [^>]*href="([^"]*)"[^>]*>([^<]*)</a>', 1)) as href,
    unnest(regexp_extract_all(html, '<a [^>]*href="([^"]*)"[^>]*>([^<]*)</a>', 2)) as t,
    unnest(range(0, len(regexp_extract_all(html, '<a [^>]*href="([^"]*)"[^>]*>([^<]*)</a>', 1)))) as position from pages),
l as (select page_id, root || href as link_url, position, trim(t) as link_text, lower(translate(trim(t), 'İIıŞşĞğÜüÖöÇç', 'iiissgguuoocc')) as f from a
  where regexp_matches(root, '(^|\\.|/)example\\.com$')),
c as (select *, case when contains(f, 'the') then 'english' when contains(f, 'de') then 'spanish' when contains(f, 'nicht') then 'german' when contains(f, 'la') then 'spanish' end as document_type from l)
select page_id, link_url, min(position) as position, arg_min(link_text, position) as link_text, arg_min(document_type, position) as document_type
from c where document_type is not null group by 1, 2""")
def discover_links(spark, d):
    web = table(spark, d, "pages").withColumn("allowed_domain", F.lit("example.com"))
    out = pages.discover_links(web, LINK_RULES, marker="/")
    return out.select("page_id", "link_url", F.col("position").cast("bigint"), "link_text", "document_type")


@query("page_shape", """with p as (select page_id, html, regexp_extract(html, '(?is)<body[^>]*>(.*)</body>', 1) as body,
  regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1) as t from pages),
shown as (select *, regexp_split_to_array(regexp_replace(body, '(?is)<!--.*?-->|<script.*?</script>|<style.*?</style>', '<>', 'g'), '<[^>]*>') as parts from p)
select page_id, nullif(trim(replace(replace(replace(replace(replace(replace(t, '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&nbsp;', ' '), '&amp;', '&')), '') as page_title,
  len(regexp_extract_all(html, '(?i)<table\\b')) as table_count, len(regexp_extract_all(html, '(?i)<a [^>]*href=')) as link_count,
  len(regexp_extract_all(html, '(?i)<script\\b')) as script_count, 0 as download_count,
  cast(list_sum(list_transform(parts, lambda x: length(regexp_replace(regexp_replace(x, '&([A-Za-z]+|#[0-9]+);', 'x', 'g'), '^\\s+|\\s+$', '', 'g')))) as bigint) as text_length
from shown""")
def page_shape(spark, d):
    out = pages.page_shape(table(spark, d, "pages"))
    return out.select("page_id", "page_title", *[F.col(c).cast("bigint").alias(c) for c in ("table_count", "link_count", "script_count")],
                      F.size("download_links").alias("download_count"), F.col("text_length").cast("bigint"))


@query("html_table_rows", """select o_custkey * 100 + year(o_orderdate) - 1990 as page_id, row_number() over (partition by o_custkey, year(o_orderdate) order by o_orderkey) as row_index,
  'Firma &' || o_orderkey as company_name, case when o_orderstatus = 'P' then 'date does not match DD.MM.YYYY' end as reason,
  case when o_orderstatus <> 'P' then cast(cast(o_orderdate as date) as varchar) end as application_date from orders""")
def html_table_rows(spark, d):
    line = F.format_string("<tr><td>%d</td><td><b>Firma</b> &amp;%d</td><td>%s</td></tr>", "o_custkey", "o_orderkey",
                           F.when(F.col("o_orderstatus") == "P", "belirsiz").otherwise(F.date_format("o_orderdate", "dd.MM.yyyy")))
    line = F.replace(line, F.lit("</b> &amp;"), F.lit("</b> <i> &amp;</i>"))
    rows = table(spark, d, "orders").select((F.col("o_custkey") * 100 + F.year("o_orderdate") - 1990).alias("page_id"), "o_orderkey", line.alias("line")).groupBy("page_id").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("o_orderkey", "line"))), lambda x: x["line"]), "").alias("body"))
    head = ("<html><body><table><tr><td>menu</td></tr></table><table><tr><th>No</th><th>Şirket</th><th>Tarih</th></tr>"
            "<tr><td></td><td> </td></tr>")
    web = rows.select("page_id", F.concat(F.lit(head), "body", F.lit("</table></body></html>")).alias("html"))
    out = html.application_rows(web)
    name = F.regexp_replace("company_name", r"^Firma&", "Firma &")
    return out.select("page_id", F.col("row_index").cast("bigint"), name.alias("company_name"), "reason",
                      F.when(F.col("reason").isNull(), F.date_format("application_date", "yyyy-MM-dd")).alias("application_date"))
