"""Text standardization and ordered rule classification as Column expressions."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from string import ascii_lowercase

from pyspark.sql import Column
from pyspark.sql import functions as F

# One character maps to one character, so offsets survive folding.
FOLD_FROM = "İIıŞşĞğÜüÖöÇç"
FOLD_TO = "iiissgguuoocc"

# A character that texts hardly hold.
MARK = "\x01"

# Legal-form tokens that do not identify a company.
LEGAL_TOKENS = ("as", "anonim", "sirketi", "sanayi", "sanayii", "ticaret", "ticareti", "ve")


def fold_text(text: Column) -> Column:
    return F.lower(F.translate(text, FOLD_FROM, FOLD_TO))


def unfolded(letters: str) -> str:
    """The characters that :func:`fold_text` makes one of these lower-case ASCII letters of, as the inside of a class."""
    kept = "".join(c + c.upper() for c in letters)
    # The Kelvin sign is the one other character whose lower case is an ASCII letter.
    return kept + "".join(a for a, b in zip(FOLD_FROM, FOLD_TO, strict=True) if b in letters and a not in kept) + ("\u212a" if "k" in letters else "")


def unfolded_pattern(pattern: str) -> str:
    """A pattern for unfolded text that matches where ``pattern`` matches folded text. Letters may stand alone or as ``a-zA-Z`` in a class."""
    whole = pattern.replace("a-zA-Z", unfolded(ascii_lowercase))
    if whole != pattern:
        return whole
    out, inside = [], False
    for part in re.findall(r"\\.|.", pattern):
        inside = part == "[" or inside and part != "]"
        out.append(part if len(part) > 1 or not part.islower() else unfolded(part) if inside else f"[{unfolded(part)}]")
    return "".join(out)


def located(text: Column, pattern: str) -> Column:
    """Every match of ``pattern`` with the place where it starts (1-based): array of (match, at), in order.

    One search sets a mark around every match; only a text that holds the mark itself is searched twice.
    """
    marked = F.transform(F.array(F.split(F.regexp_replace(text, pattern, f"{MARK}$0{MARK}"), MARK)), lambda parts: F.struct(
        F.filter(parts, lambda _, i: i % 2 == 1).alias("matches"), F.filter(parts, lambda _, i: i % 2 == 0).alias("between")))
    matches, between = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern)
    searched = F.array(F.struct(matches.alias("matches"), between.alias("between")))

    def at(match: Column, i: Column) -> Column:
        return F.struct(match.alias("match"), i.alias("i"))

    def length(parts: Column) -> Column:
        return F.aggregate(parts, F.lit(0), lambda total, part: total + F.length(part))

    def place(both: Column) -> Column:
        return F.transform(F.transform(both["matches"], at), lambda m: F.struct(
            m["match"].alias("match"), (1 + length(F.slice(both["between"], F.lit(1), m["i"] + 1)) + length(F.slice(both["matches"], F.lit(1), m["i"]))).alias("at")))

    return F.transform(F.when(F.contains(text, F.lit(MARK)), searched).otherwise(marked), place)[0]


def contains_any(text: Column, needles: Sequence[str]) -> Column:
    hit = F.lit(False)
    for needle in needles:
        hit = hit | F.contains(text, F.lit(needle))
    return hit


def tokens(text: Column) -> Column:
    return F.filter(F.split(text, r"(?U)\s+"), lambda t: t != "")


def normalize_name(name: Column, stop_tokens: Sequence[str] = LEGAL_TOKENS) -> Column:
    words = tokens(F.replace(fold_text(name), F.lit("."), F.lit("")))
    return F.array_join(F.filter(words, lambda t: ~t.isin(*stop_tokens)), " ")


def single_token(listing: Column) -> Column:
    """The token of a comma list when it holds exactly one, else NULL."""
    parts = F.filter(F.transform(F.split(listing, ","), lambda t: F.trim(t)), lambda t: t != "")
    return F.when(F.size(parts) == 1, F.try_element_at(parts, F.lit(1)))


def subject_key(related: Column, own: Column) -> Column:
    return F.coalesce(single_token(related), single_token(own))


def match_key(value: Column) -> Column:
    return F.upper(F.trim(value))


def first_rule(text: Column, rules: Sequence[tuple[str, str]], default: str | None, regex: bool = False) -> Column:
    """Label of the first rule that hits; rules are (pattern, label) in priority order."""
    label = None
    for pattern, name in rules:
        hit = text.rlike(pattern) if regex else F.contains(text, F.lit(pattern))
        label = F.when(hit, name) if label is None else label.when(hit, name)
    return label.otherwise(F.lit(default)) if label is not None else F.lit(default)


def classify_with_veto(
    folded: Column,
    rules: Sequence[tuple[str, str]],
    default: str,
    vetoed: str,
    veto_markers: Sequence[str],
    rerouted: str,
) -> Column:
    label = first_rule(folded, rules, default)
    return F.when((label == vetoed) & contains_any(folded, veto_markers), rerouted).otherwise(label)


def summary_or_title(summary: Column, title: Column) -> Column:
    return F.coalesce(F.nullif(fold_text(summary), F.lit("")), fold_text(title))


def document_role(folded: Column, stem: str, appendix_pattern: str, keywords: Sequence[str]) -> Column:
    attachment = ~F.contains(folded, F.lit(stem)) | folded.rlike(appendix_pattern) | contains_any(folded, keywords)
    return F.when(F.coalesce(attachment, F.lit(True)), "attachment").otherwise("base_document")


def part_number(folded: Column) -> Column:
    return F.regexp_extract(folded, r"(\d+)\s*\.\s*(?:bolum|kisim)\b", 1).try_cast("int")


def entity_key(code: Column, name: Column, period: Column) -> Column:
    who = F.coalesce(F.nullif(code, F.lit("")), F.nullif(name, F.lit("")), F.lit("unknown"))
    return F.concat(F.lit("ipo:"), who, F.lit(":"), F.coalesce(period, F.lit("")))


def application_key(name: Column, applied_on: Column) -> Column:
    return F.concat(F.lit("application:"), name, F.lit(":"), F.date_format(applied_on, "yyyy-MM-dd"))


def content_hash(parts: Sequence[Column]) -> Column:
    """sha256 over ``|``-joined parts in the given order; NULL counts as the empty string."""
    return F.sha2(F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]), 256)


def canonical_hash(fields: Mapping[str, Column]) -> Column:
    """sha256 over the fields as canonical JSON: named, in order of their names, nulls kept. No two different sets of values share an input.

    For detecting changes; :func:`content_hash` cannot tell NULL from the empty string, nor a bar inside a part from one between parts.
    """
    named = F.struct(*[value.alias(name) for name, value in sorted(fields.items())])
    return F.sha2(F.to_json(named, {"ignoreNullFields": "false"}), 256)
