"""Facts from document pages, and what several documents say about the same fact.

Pages are read once: all rules of all fields are one row-local array, so text is never shuffled; only hits are. The first
page of a document is a grouped minimum with partial combine. Merging is one shuffle on (entity, field): the sources are
a fixed short list, so each becomes one conditional minimum.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pitlake import extraction_rules as rules
from pitlake.functions.numbers import parse_dotted_date, parse_month_name_date, parse_number
from pitlake.functions.text import contains_any, fold_text, located, unfolded_pattern
from pitlake.operators.page_chain import with_following
from pitlake.operators.period_tables import bound
from pitlake.session import stage
from pitlake.tables import columns, computed_once

# Folded text is lower case already; (?U) lets \\s and \\w see every space and letter.
FLAGS = "(?U)"
ITEM = "struct<group:string,label:string,amount:double,percentage:double,method:string>"
PASSAGE_CHARS = 400
VALUES = ("value_num", "value_str", "value_date", "value_items")
READ = "struct<place:int,field:string,value_num:double,value_str:string,value_date:date>"


@dataclass(frozen=True)
class Rule:
    """One way to read one field. ``how`` finds the matched passage, ``kind`` says what to read from it.

    how: first | last | unique (exactly one ``pattern`` inside the first ``region``) | phrase (first of ``phrases`` present)
    kind: number | date | growth (percent from group to group + 1) | text (the passage) | head (a group opening the passage) |
    constant (``constant`` itself)
    """

    field: str
    pattern: str
    group: int = 1
    kind: str = "number"
    how: str = "first"
    anchor: str | tuple[str, ...] = ""
    region: str = ""
    phrases: tuple[str, ...] = ()
    constant: str = ""

    def finder(self) -> tuple:
        return self.how, self.pattern, self.anchor, self.region, self.phrases


def number_rules(patterns: Mapping[str, Sequence[tuple]]) -> list[Rule]:
    """Rules from a table field -> ((pattern, group[, anchor]), ...) in priority order."""
    return [Rule(field, t[0], t[1], anchor=t[2] if len(t) > 2 else "") for field, listed in patterns.items() for t in listed]


def offering_rules() -> list[Rule]:
    """All scalar and date fields of offering documents, in priority order per field."""
    out = number_rules(rules.NUMBER_PATTERNS)
    out += [Rule("currency", r.pattern, kind="constant", anchor=r.anchor, constant="TRY") for r in out if r.field == "offering_price"]
    out += [Rule(f, rules.VALUATION_TRIPLE, g, how="last", anchor="firma") for f, g in rules.VALUATION_TRIPLE_FIELDS.items()]
    capital = rules.NUMBER_PATTERNS["pre_offer_capital"][0]
    out.append(Rule("capital_increase_ratio", capital[0], 1, kind="growth", anchor=capital[2]))
    out.append(Rule("secondary_sale_shares", rules.SELLER_ITEM, how="unique", anchor="ortak", region=rules.SELLER_REGION))
    out.append(Rule("distribution_method", "", kind="text", how="phrase", phrases=rules.DISTRIBUTION_METHODS))
    out.append(Rule("distribution_regulation_reference", rules.REGULATION_PATTERN, kind="head", anchor="tebligi"))
    return out + window_rules()


def window_rules() -> list[Rule]:
    fields = (("subscription_start_date", 1), ("subscription_end_date", 2))
    return [Rule(f, p, g, kind="date", anchor=a) for f, g in fields for p, a in zip(rules.WINDOW_PATTERNS, rules.WINDOW_WORDS, strict=True)]


def spelled_at(text: Column, at: Column, match: Column) -> Column:
    """The original spelling of a folded passage that starts at ``at``; folding keeps every offset."""
    return F.substr(text, at, F.length(match))


def place_of(folded: Column, match: Column, how: str, pattern: str, anchor: str | tuple[str, ...] = "", region: str = "", phrases: Sequence[str] = ()) -> Column:
    """Where the passage that ``passage`` found starts. What stands around a match may decide it, so an earlier equal text may be no match."""
    if how == "last":
        return F.length(folded) - F.length(F.element_at(F.split(folded, FLAGS + pattern), -1)) - F.length(match) + 1
    if how == "unique":
        begin = F.regexp_instr(folded, F.lit(FLAGS + region))
        inside = F.regexp_substr(folded, F.lit(FLAGS + region))
        return begin + F.regexp_instr(inside, F.lit(FLAGS + pattern)) - 1
    looks_around = "(?<" in pattern or "(?!" in pattern or "(?=" in pattern or r"\b" in pattern
    return F.regexp_instr(folded, F.lit(FLAGS + pattern)) if how == "first" and looks_around else F.instr(folded, match)


def searched(text: Column, pattern: str) -> Column:
    """``regexp_substr``, which searches a second time for what it has found."""
    return F.try_element_at(F.filter(F.array(F.regexp_extract(text, FLAGS + pattern, 0)), lambda m: m != ""), F.lit(1))


def passage(folded: Column, how: str, pattern: str, anchor: str | tuple[str, ...] = "", region: str = "", phrases: Sequence[str] = ()) -> Column:
    """The matched passage of a page, or NULL."""
    if how == "phrase":
        found = F.lit(None).cast("string")
        for phrase in reversed(phrases):
            found = F.when(F.contains(folded, F.lit(phrase)), phrase).otherwise(found)
        return found
    if how == "last":
        found = F.try_element_at(F.regexp_extract_all(folded, F.lit(FLAGS + pattern), F.lit(0)), F.lit(-1))
    elif how == "unique":
        inside = F.array(searched(folded, region))
        # A one-element array binds the region so that it is found once.
        counted = F.transform(inside, lambda r: F.regexp_extract_all(r, F.lit(FLAGS + pattern), F.lit(0)))
        only = F.filter(counted, lambda items: F.size(items) == 1)
        found = F.try_element_at(F.flatten(only), F.lit(1))
    else:
        found = searched(folded, pattern)
    return F.when(contains_any(folded, (anchor,) if isinstance(anchor, str) else anchor), found) if anchor else found


def _finders(listed: Sequence[Rule]) -> dict[tuple, list[tuple[int, Rule]]]:
    """Rules that read the same passage share one search; each keeps its place in the priority order."""
    groups: dict[tuple, list[tuple[int, Rule]]] = {}
    for place, rule in enumerate(listed):
        groups.setdefault(rule.finder(), []).append((place, rule))
    return groups


def read_values(rule: Rule, place: int, match: Column, snippet: Column) -> Column:
    """What one rule reads from a passage; the pattern stays a literal, so it is compiled once and not for every row."""
    def group(number: int) -> Column:
        return F.regexp_extract(match, FLAGS + rule.pattern, number)

    num = text = date = F.lit(None)
    if rule.kind == "number":
        num = parse_number(group(rule.group))
    elif rule.kind == "growth":
        num = bound(parse_number(group(rule.group)), lambda n: F.try_divide(parse_number(group(rule.group + 1)) - n, n) * 100)
    elif rule.kind == "date":
        date = parse_dotted_date(group(rule.group))
    elif rule.kind == "head":
        text = F.left(snippet, F.length(group(rule.group)))
    else:
        text = snippet if rule.kind == "text" else F.lit(rule.constant)
    return F.struct(F.lit(place), F.lit(rule.field), num, text, date).cast(READ)


def first_page_facts(pages: DataFrame, listed: Sequence[Rule], keep: Sequence[str] = (), lists: Mapping[str, Callable[[Column, Column], Column]] | None = None) -> DataFrame:
    """(doc_id, field, values, snippet, page_no, kept columns): each field by its first rule on the first page that has it.

    ``pages``: doc_id, page_no, text and the kept columns. Every distinct search runs once per page; only passages found
    become rows, and reading numbers or dates happens on those short passages. ``lists`` maps list fields to functions of
    (folded, text) giving their items; they are read in the same pass.
    """
    groups = _finders(listed)
    items = f"array<{ITEM}>"
    hit_type = f"struct<search:int,match:string,list_field:string,value_items:{items}>"
    found = [
        F.struct(F.lit(i).alias("search"), passage(F.col("_folded"), *finder).alias("match"), F.lit(None).alias("list_field"), F.lit(None).cast(items).alias("value_items"))
        .cast(hit_type) for i, finder in enumerate(groups)]
    found += [
        F.struct(F.lit(-1).alias("search"), F.lit(None).alias("match"), F.lit(name).alias("list_field"), items_of(F.col("_folded"), F.col("text")).cast(items).alias("value_items"))
        .cast(hit_type) for name, items_of in (lists or {}).items()]
    folded = pages.select("doc_id", "page_no", "text", *keep, fold_text(F.col("text")).alias("_folded"))
    # The outer form keeps the optimizer from evaluating the searches a second time in a filter.
    kept = F.filter(F.array(*found), lambda x: x["match"].isNotNull() | (F.size(x["value_items"]) > 0))
    hits = folded.select("*", F.inline_outer(kept)).where(F.col("search").isNotNull())
    at = F.when(F.col("search") < 0, F.lit(None).cast("int"))
    for i, finder in enumerate(groups):
        at = at.when(F.col("search") == i, place_of(F.col("_folded"), F.col("match"), *finder))
    spelled = hits.select(
        "doc_id", "page_no", *keep, "search", "match", "list_field", "value_items", spelled_at(F.col("text"), at, F.col("match")).alias("snippet"))
    reads = F.when(F.col("search") < 0, F.array(F.struct(F.lit(0), F.col("list_field"), F.lit(None), F.lit(None), F.lit(None)).cast(READ)))
    for i, members in enumerate(groups.values()):
        reads = reads.when(F.col("search") == i, F.array(*[read_values(r, place, F.col("match"), F.col("snippet")) for place, r in members]))
    stated = F.filter(reads, lambda v: v["value_num"].isNotNull() | v["value_str"].isNotNull() | v["value_date"].isNotNull() | (F.col("search") < 0))
    read = spelled.select("doc_id", "page_no", *keep, "snippet", "value_items", F.inline_outer(stated)).where(F.col("field").isNotNull())
    values = VALUES if lists else VALUES[:3]
    first = read.groupBy("doc_id", "field").agg(
        F.min_by(F.struct(*values, "snippet", *keep, "page_no"), F.struct("page_no", "place")).alias("_f"))
    return first.select("doc_id", "field", "_f.*")


def chosen(fields: Sequence[str] | None) -> list[Rule]:
    return [r for r in offering_rules() if fields is None or r.field in fields]


def extract_facts(pages: DataFrame, keep: Sequence[str] = (), fields: Sequence[str] | None = None) -> DataFrame:
    """Scalar and date fields of offering documents; with ``fields`` only those are searched for."""
    return first_page_facts(pages, chosen(fields), keep)


def extract_observations(pages: DataFrame, keep: Sequence[str] = (), fields: Sequence[str] | None = None) -> DataFrame:
    """Scalar, date and list fields of offering documents (all, or ``fields``), reading the text once. Restrict the pages' sources before."""
    readers = list_readers(rules.SECTION_HEADINGS)
    return first_page_facts(pages, chosen(fields), keep, {n: r for n, r in readers.items() if fields is None or n in fields})


def extract_pattern_facts(pages: DataFrame, patterns: Mapping[str, Sequence[tuple]], keep: Sequence[str] = ()) -> DataFrame:
    """Number fields by any ordered pattern table: field -> ((pattern, group[, anchor]), ...)."""
    return first_page_facts(pages, number_rules(patterns), keep)


def _group_of(folded_label: Column) -> Column:
    group = F.lit("other")
    for word, name in reversed(rules.INVESTOR_GROUPS):
        group = F.when(F.contains(folded_label, F.lit(word)), name).otherwise(group)
    return group


def _passages(folded: Column, text: Column, pattern: str) -> Column:
    """All passages of a page, folded and as spelled."""
    return F.transform(located(folded, FLAGS + pattern), lambda m: F.struct(m["match"].alias("m"), spelled_at(text, m["at"], m["match"]).alias("spelled")))


def _named_items(lines: Column) -> Column:
    """Items from (label, amount, percentage, method) lines; each step of the chain is computed once per line."""
    labelled = F.transform(lines, lambda x: F.struct(x.alias("x"), fold_text(x["label"]).alias("low")))
    return F.transform(labelled, lambda y: F.struct(
        _group_of(y["low"]).alias("group"), y["x"]["label"].alias("label"), y["x"]["amount"].alias("amount"),
        y["x"]["percentage"].alias("percentage"), y["x"]["method"].alias("method")))


def allocation_lines(folded: Column, text: Column) -> Column:
    """(group, label, amount, percentage) lines of a page."""
    pattern = FLAGS + rules.ALLOCATION_LINE
    cut = F.transform(_passages(folded, text, rules.ALLOCATION_LINE), lambda p: F.struct(p.alias("p"), F.regexp_extract(p["m"], pattern, 3).alias("raw")))
    lines = F.transform(cut, lambda c: F.struct(
        F.trim(F.substr(c["p"]["spelled"], F.instr(c["p"]["m"], c["raw"]), F.length(c["raw"]))).alias("label"),
        parse_number(F.regexp_extract(c["p"]["m"], FLAGS + rules.ALLOCATION_AMOUNT, 1)).alias("amount"),
        parse_number(F.regexp_extract(c["p"]["m"], FLAGS + rules.ALLOCATION_SHARE, 1)).alias("percentage"), F.lit(None).cast("string").alias("method")))
    return F.when(F.contains(folded, F.lit("kismi")), _named_items(lines))


def distribution_lines(folded: Column, text: Column) -> Column:
    """(group, label, equal | proportional) lines of a page.

    The page is cut at the rule words; a label is the rest of its line before the cut, which costs one pass instead of trying every start.
    """
    none = F.lit(None).cast("double")
    cuts = located(folded, FLAGS + rules.DISTRIBUTION_CUT)

    def label_of(before: Column) -> Column:
        """The last line, folded, after its colon; what an earlier rule on the line took is left out."""
        return F.regexp_replace(F.substring_index(F.substring_index(before, "\n", -1), ":", -1), FLAGS + "^.*" + rules.DISTRIBUTION_WAY, "")

    led = F.transform(cuts, lambda c: F.struct(c.alias("c"), F.regexp_replace(F.left(folded, c["at"] - 1), r"(?U)\s+$", "").alias("before")))
    cut = F.transform(led, lambda x: F.struct(x["c"].alias("c"), F.length(x["before"]).alias("end"), label_of(x["before"]).alias("low")))
    lines = F.transform(F.filter(cut, lambda x: F.length(x["low"]) >= 4), lambda x: F.struct(
        F.regexp_replace(spelled_at(text, x["end"] - F.length(x["low"]) + 1, x["low"]), r"^[ \-•\t]+|[ \-•\t]+$", "").alias("label"), none.alias("amount"), none.alias("percentage"),
        F.when(F.startswith(F.substr(folded, x["c"]["at"] + F.length(x["c"]["match"])), F.lit("esit")), "equal").otherwise("proportional").alias("method")))
    return F.when(F.contains(folded, F.lit("yontemine")), _named_items(lines))


def section_items(folded: Column, text: Column, headings: Sequence[str]) -> Column:
    """The sentences after the first listed heading that occurs, to the end of the page."""
    start = F.lit(None).cast("int")
    for heading in reversed(headings):
        start = F.when(F.contains(folded, F.lit(heading)), F.instr(folded, F.lit(heading)) + len(heading)).otherwise(start)
    sentences = F.transform(F.split(F.substr(text, start), r"(?U)(?<=[.;])\s+"), lambda s: F.regexp_replace(s, r"(?U)^\s+|\s+$", ""))
    none_num, none_str = F.lit(None).cast("double"), F.lit(None).cast("string")
    return F.transform(F.filter(sentences, lambda s: F.length(s) >= rules.SECTION_MIN_CHARS), lambda s: F.struct(
        none_str.alias("group"), s.alias("label"), none_num.alias("amount"), none_num.alias("percentage"), none_str.alias("method")))


def list_readers(headings: Mapping[str, Sequence[str]]) -> dict[str, Callable[[Column, Column], Column]]:
    """List fields of a page as functions of (folded, text)."""
    readers: dict[str, Callable[[Column, Column], Column]] = {
        name: lambda folded, text, titles=titles: section_items(folded, text, titles) for name, titles in headings.items()}
    return readers | {"investor_group_allocations": allocation_lines, "investor_group_distribution_rules": distribution_lines}


def extract_lists(
    pages: DataFrame, keep: Sequence[str] = (), headings: Mapping[str, Sequence[str]] = rules.SECTION_HEADINGS, fields: Sequence[str] | None = None, most: int | None = None,
) -> DataFrame:
    """List fields (all, or ``fields``): everything on the first page of a document that has any; ``most`` limits the items of a list."""
    low, text = F.col("_folded"), F.col("text")
    readers = {n: r for n, r in list_readers(headings).items() if fields is None or n in fields}
    cells = [F.struct(F.lit(name).alias("field"), items_of(low, text).cast(f"array<{ITEM}>").alias("value_items")) for name, items_of in readers.items()]
    if most is not None:
        cells = [F.struct(c["field"].alias("field"), F.slice(c["value_items"], 1, most).alias("value_items")) for c in cells]
    folded = pages.select("doc_id", "page_no", "text", *keep, fold_text(F.col("text")).alias("_folded"))
    some = F.filter(F.array(*cells), lambda c: F.size(c["value_items"]) > 0)
    hits = folded.select("doc_id", "page_no", *keep, F.inline_outer(some)).where(F.col("field").isNotNull())
    first = hits.groupBy("doc_id", "field").agg(F.min_by(F.struct("value_items", *keep, "page_no"), "page_no").alias("_f"))
    return first.select("doc_id", "field", "_f.*")


def post_offer_evidence(pages: DataFrame, keep: Sequence[str] = (), passage_chars: int = PASSAGE_CHARS) -> DataFrame:
    """Window ends as later documents word them, kept apart from the facts: (doc_id, cutoff_date, snippet, source).

    ``pages``: doc_id, page_no, text, source_system, document_type. Result announcements name the month; issuer pages
    repeat the window itself. A page whose end may begin a passage is read with what follows it, up to ``passage_chars`` characters over as many pages as
    they fill, so a passage broken over several short pages is found once, at the page where it begins. All others are read where they lie: neither
    their text nor their place is shuffled.
    """
    issuer = F.col("source_system") == "issuer_ir"
    asked = pages.where(issuer | (F.col("document_type") == "ipo_results"))
    kept = list(dict.fromkeys(["doc_id", "page_no", *keep]))
    low, text, own = F.col("_folded"), F.col("text"), F.col("_own")
    windows = [(p, words, o, begins, lambda m, p: parse_dotted_date(F.regexp_extract(m, p, 2))) for p, words, o, begins in zip(
        rules.WINDOW_PATTERNS, rules.WINDOW_WORDS, rules.WINDOW_OPENINGS, rules.WINDOW_OPENING_WORDS, strict=True)]
    month_named = [(rules.RESULT_END_PATTERN, ("tarih",), rules.RESULT_END_OPENING, (), lambda m, p: parse_month_name_date(*[F.regexp_extract(m, p, g) for g in (1, 2, 3)]))]

    def reading(rank: int, pattern: str, words: tuple[str, ...], opening: str, begins: tuple[str, ...], read: Callable[[Column, str], Column]) -> Column:
        """What a pattern finds in the page, and whether it may find something before that place once more text follows; at one place the nearest end counts."""
        pattern = FLAGS + pattern
        match = F.when(contains_any(low, words), searched(low, pattern.removeprefix(FLAGS)))
        placed = bound(match, lambda m: F.struct(m.alias("m"), F.when(m.isNotNull(), F.regexp_instr(low, F.lit(pattern))).alias("at")))
        begun = F.regexp_instr(low, F.lit(FLAGS + opening))
        begun = F.when(contains_any(low, begins), begun).otherwise(0) if begins else begun
        return bound(placed, lambda b: F.struct(
            F.lit(rank).alias("rank"), F.when(b["m"].isNotNull(), read(b["m"], pattern)).alias("cutoff_date"), spelled_at(text, b["at"], b["m"]).alias("snippet"),
            (b["at"] <= own).alias("hit"), bound(begun, lambda at: F.coalesce((at > 0) & (b["at"].isNull() | (at < b["at"])), F.lit(False))).alias("open")))

    def readings(df: DataFrame) -> DataFrame:
        """``_read``: per pattern its rank, date or NULL, snippet, whether it is the page's and whether the page's end may change it."""
        each = F.when(issuer, F.array(*[reading(i, *w) for i, w in enumerate(windows)])).otherwise(F.array(*[reading(i, *m) for i, m in enumerate(month_named)]))
        return computed_once(computed_once(df, "_folded", fold_text(text)), "_read", each)

    hit, is_open = F.filter("_read", lambda r: r["hit"]), F.exists("_read", lambda r: r["open"]) & F.col("doc_id").isNotNull() & F.col("page_no").isNotNull()
    # Without a date, or the words a window's page may break off after, there is nothing to fold.
    some = F.when(issuer, text.rlike(FLAGS + unfolded_pattern("halka|talep") + "|" + rules.DATE)).otherwise(text.rlike(FLAGS + r"\d"))
    alone = readings(asked.where(some).withColumn("_own", F.length("text"))).select(*kept, issuer.alias("_issuer"), hit.alias("_hits"), is_open.alias("_open"))
    alone = stage(alone.where((F.size("_hits") > 0) | F.col("_open")), "windows")
    read = alone.where("not _open")
    if not alone.where("_open").isEmpty():
        told = asked.join(alone.where("_open").select("doc_id").distinct(), "doc_id", "left_semi").select(*asked.columns)
        judged = readings(told.withColumn("_own", F.length("text"))).withColumn("_open", is_open).drop("_folded", "_read")
        joined = with_following(judged, F.col("_open"), passage_chars).withColumn("text", F.concat_ws("\n", "text", "following"))
        read = read.unionByName(readings(joined).select(*kept, issuer.alias("_issuer"), hit.alias("_hits"), F.lit(True).alias("_open")))
    hits = read.select(*kept, "_issuer", F.inline("_hits"))
    # issuer pages: the first pattern anywhere in the document decides, readable or not; announcements: the first readable date
    counted = hits.where(F.col("_issuer") | F.col("cutoff_date").isNotNull()).withColumn(
        "source", F.when(F.col("_issuer"), "issuer_ir.subscription_end_date").otherwise("kap_ipo_results.subscription_end_date"))
    first = counted.groupBy("doc_id").agg(F.min_by(F.struct("cutoff_date", "snippet", "source", *keep), F.struct("rank", "page_no")).alias("_f"))
    return first.select("doc_id", "_f.*").where(F.col("cutoff_date").isNotNull())


OBSERVATION_ORDER = ("published_at", "doc_id", "page_no")


def restrict_sources(observations: DataFrame, allowed: Sequence[str]) -> DataFrame:
    """Leak guard: only what these sources say; merge afterwards."""
    return observations.where(F.col("source_type").isin(*allowed))


def merge_evidence(
    observations: DataFrame,
    sources: Sequence[str] = rules.SOURCE_ORDER,
    leading: Mapping[str, Sequence[str]] | None = None,
    order: Sequence[str] = OBSERVATION_ORDER,
    values: Sequence[str] = VALUES,
    carry: Sequence[str] = ("doc_id", "page_no", "method", "snippet"),
) -> DataFrame:
    """One row per (entity, field): extracted or conflicting, never arbitrating a conflict.

    Per source the first observation by ``order`` counts. All equal: the winner is the first source in the field's own order
    (``leading``: field -> source order, default ``sources``). Unequal: conflicting, no value. All kept observations stay in
    ``observations``. ``observations`` needs entity_id, field, source_type and the named columns; rows of a source that is not listed take no
    part, and :func:`unlisted_sources` returns them.
    """
    order = [c for c in order if c in observations.columns]
    values = [c for c in values if c in observations.columns]
    carry = [c for c in carry if c in observations.columns]
    known = observations.where(F.col("source_type").isin(*sources))
    # The order key leads the struct, so its minimum is the first observation of that source.
    seen = F.struct(
        F.struct(*columns(order)).alias("at"), F.struct(*columns(values)).alias("value"), F.col("source_type"),
        F.struct(*columns(carry)).alias("from") if carry else F.lit(None).alias("from"))
    picked = known.groupBy("entity_id", "field").agg(*[
        F.min(F.when(F.col("source_type") == s, seen)).alias(f"_s{i}") for i, s in enumerate(sources)])
    place = {s: F.col(f"_s{i}") for i, s in enumerate(sources)}
    winner = F.coalesce(*place.values())
    for field, own_order in (leading or {}).items():
        winner = F.when(F.col("field") == field, F.coalesce(*[place[s] for s in own_order])).otherwise(winner)
    slots = [f"_s{i}" for i in range(len(sources))]
    merged = picked.select("entity_id", "field", F.filter(F.array(*place.values()), lambda s: s.isNotNull()).alias("observations"), winner.alias("_w"), *slots)
    same = [F.col(f"{s}.value").eqNullSafe(F.col("_w.value")) | F.col(s).isNull() for s in slots]
    agree = reduce(and_, same)
    out = [F.when(agree, F.col("_w.value")[v]).alias(v) for v in values]
    out += [F.when(agree, F.col("_w.source_type")).alias("winner_source")]
    out += [F.when(agree, F.col("_w.from")[c]).alias(c) for c in carry]
    return merged.select(
        "entity_id", "field", F.when(agree, "extracted").otherwise("conflicting").alias("status"), *out,
        F.size("observations").alias("source_count"), "observations")


def unlisted_sources(observations: DataFrame, sources: Sequence[str] = rules.SOURCE_ORDER) -> DataFrame:
    """What :func:`merge_evidence` leaves out: observations whose source is NULL or not listed."""
    return observations.where(~F.coalesce(F.col("source_type").isin(*sources), F.lit(False)))


OFFERING_LEADING = {field: rules.ANNOUNCEMENT_ORDER for field in rules.ANNOUNCEMENT_FIELDS}


def with_not_found(facts: DataFrame, entities: DataFrame, fields: Sequence[str]) -> DataFrame:
    """Every entity x field of a fixed field list; what no source said is not_found."""
    wanted = entities.select("entity_id", F.explode(F.array(*[F.lit(f) for f in fields])).alias("field"))
    full = wanted.join(facts, ["entity_id", "field"], "left")
    return full.withColumn("status", F.coalesce("status", F.lit("not_found"))).withColumn("source_count", F.coalesce("source_count", F.lit(0)))


def evidence_quality(facts: DataFrame, fields: Sequence[str]) -> DataFrame:
    """Per entity: core fields with several sources, with one, and resting on OCR."""
    stated = facts.where(F.col("field").isin(*fields) & F.col("status").isin("extracted", "conflicting"))
    ocr = F.exists("observations", lambda o: o["from"]["method"] == "ocr")

    def names(condition: Column) -> Column:
        return F.array_sort(F.collect_set(F.when(condition, F.col("field"))))

    return stated.groupBy("entity_id").agg(
        names(F.col("source_count") > 1).alias("corroborated_fields"), names(F.col("source_count") == 1).alias("single_source_fields"),
        names(ocr).alias("ocr_fields"))


def collect_series(observations: DataFrame) -> DataFrame:
    """Metric observations of all matched documents, as they are: no deduplication."""
    return observations.where(F.col("entity_id").isNotNull())
