"""Links, tables and shape of raw HTML pages. All but the table rows are built-in expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pitlake.functions.text import contains_any, first_rule, fold_text

# What counts as a download, and the body length under which a page may need scripts.
DOWNLOAD_EXTENSIONS = (".pdf", ".xls", ".xlsx", ".csv", ".zip", ".doc", ".docx", ".json")
DOWNLOAD_HINTS = ("download", "indir", "export", "/api/", "raporlar")
SHORT_BODY_CHARS = 200
SPEC_URL = r"""(?i)["']((?:https?://[^"']+|/[^"'\s]*)\.(?:json|xml|wsdl|ya?ml))["']"""

ANCHOR = r"""(?is)<a\b[^>]*?\bhref\s*=\s*["']([^"']*)["'][^>]*>(.*?)</a>"""
ENTITY = r"&(?:[A-Za-z]+|#\d+);"


def unescape(text: Column) -> Column:
    for code, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        text = F.replace(text, F.lit(code), F.lit(char))
    return text


def resolve_url(base: Column, href: Column) -> Column:
    """Absolute URL of a link: absolute, scheme-relative, root-relative or relative to the page's folder."""
    scheme = F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.\-]*):", 1)
    root = F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*)", 1)
    bare = F.regexp_replace(base, r"[?#].*$", "")
    folder = F.when(bare == root, F.concat(root, F.lit("/"))).otherwise(F.regexp_replace(bare, r"[^/]*$", ""))
    return (
        F.when(href.rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*:"), href)
        .when(F.startswith(href, F.lit("//")), F.concat(scheme, F.lit(":"), href))
        .when(F.startswith(href, F.lit("/")), F.concat(root, href))
        .when(F.startswith(href, F.lit("?")), F.concat(bare, href))
        .otherwise(F.concat(folder, href))
    )


def host_of(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1))


def in_domain(host: Column, allowed: Column) -> Column:
    return (host == F.lower(allowed)) | F.endswith(host, F.concat(F.lit("."), F.lower(allowed)))


def page_links(pages: DataFrame, keep: Sequence[str]) -> DataFrame:
    """Every usable anchor: kept columns, position, href as written, absolute url, link text."""
    hrefs = F.regexp_extract_all("html", F.lit(ANCHOR), F.lit(1))
    texts = F.regexp_extract_all("html", F.lit(ANCHOR), F.lit(2))
    exploded = pages.select(*keep, F.col("url").alias("_page"), F.posexplode(F.arrays_zip(hrefs.alias("h"), texts.alias("t"))).alias("position", "_link"))
    href = F.trim(unescape(F.col("_link.h")))
    links = exploded.select(
        *keep, "position", href.alias("href"), resolve_url(F.col("_page"), href).alias("link_url"),
        F.trim(unescape(F.regexp_replace("_link.t", r"<[^>]*>", ""))).alias("link_text"),
    )
    unusable = (F.col("href") == "") | F.startswith(F.lower("href"), F.lit("javascript:")) | F.startswith(F.col("href"), F.lit("#"))
    return links.where(~unusable)


def discover_links(pages: DataFrame, rules: Sequence[tuple[str, str]], marker: str = ".pdf", regex: bool = False) -> DataFrame:
    """Same-domain document links, first occurrence per page and URL, classified by link text; unclassified are dropped.

    ``pages``: page_id, url, html, allowed_domain.
    """
    links = page_links(pages, ["page_id", "allowed_domain"])
    wanted = links.where(F.contains(F.lower("href"), F.lit(marker)) & in_domain(host_of(F.col("link_url")), F.col("allowed_domain")))
    named = wanted.withColumn("document_type", first_rule(fold_text(F.col("link_text")), rules, None, regex)).where(F.col("document_type").isNotNull())
    first = named.groupBy("page_id", "link_url").agg(F.min(F.struct("position", "link_text", "document_type")).alias("_first"))
    return first.select("page_id", "link_url", "_first.link_text", "_first.document_type", "_first.position")


def _visible_length(html: Column) -> Column:
    body = F.regexp_extract(html, r"(?is)<body\b[^>]*>(.*)</body>", 1)
    shown = F.regexp_replace(body, r"(?is)<!--.*?-->|<script\b.*?</script>|<style\b.*?</style>", "<>")
    pieces = F.split(shown, r"<[^>]*>")
    return F.aggregate(pieces, F.lit(0), lambda n, p: n + F.length(F.regexp_replace(F.regexp_replace(p, ENTITY, "x"), r"^\s+|\s+$", "")))


def page_shape(pages: DataFrame) -> DataFrame:
    """Per page: title, tables, links, download and data-file links, visible text length, and a needs-scripts guess."""
    scripts = F.array_join(F.regexp_extract_all("html", F.lit(r"(?is)<script\b[^>]*>(.*?)</script>"), F.lit(1)), "\n")
    hrefs = F.transform(F.regexp_extract_all("html", F.lit(ANCHOR), F.lit(1)), lambda h: F.trim(unescape(h)))
    usable = F.filter(hrefs, lambda h: (h != "") & ~F.startswith(h, F.lit("#")) & ~F.startswith(F.lower(h), F.lit("javascript:")))

    def is_download(h):
        ends = F.lit(False)
        for extension in DOWNLOAD_EXTENSIONS:
            ends = ends | F.endswith(F.lower(h), F.lit(extension))
        return ends | contains_any(F.lower(h), DOWNLOAD_HINTS)

    downloads = F.transform(F.filter(usable, is_download), lambda h: resolve_url(F.col("url"), h))
    specs = F.transform(F.regexp_extract_all(F.col("_scripts"), F.lit(SPEC_URL), F.lit(1)), lambda u: resolve_url(F.col("url"), u))
    title = F.trim(F.regexp_replace(unescape(F.regexp_extract("html", r"(?is)<title\b[^>]*>(.*?)</title>", 1)), r"^\s+|\s+$", ""))
    shaped = pages.withColumn("_scripts", scripts).select(
        "page_id", F.nullif(title, F.lit("")).alias("page_title"),
        F.regexp_count("html", F.lit(r"(?i)<table\b")).alias("table_count"),
        F.regexp_count("html", F.lit(r"(?i)<a\b[^>]*\bhref\s*=")).alias("link_count"),
        F.regexp_count("html", F.lit(r"(?i)<script\b")).alias("script_count"),
        F.array_sort(F.array_distinct(F.concat(downloads, specs))).alias("download_links"),
        F.size(F.array_distinct(specs)).alias("data_file_links"),
        _visible_length(F.col("html")).alias("text_length"),
    )
    return shaped.withColumn("needs_scripts", (F.col("text_length") < SHORT_BODY_CHARS) & (F.col("script_count") > 0))
