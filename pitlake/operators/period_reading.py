"""Period tables of one page, read in plain Python: captions, header, numbers after labels.

Works on folded text and says for every caption and metric what stands there. The patterns are those of the extraction rules, written for the JVM with
``(?U)``; ``compiled`` spells their classes out, so both find the same. Work and memory are those of one page and what follows it.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import cache, lru_cache
from typing import NamedTuple

from pitlake import extraction_rules as rules

HEADINGS = tuple(dict.fromkeys(rules.METRIC_HEADINGS.values()))
# What (?U) takes for white space; Python's own class holds four more characters.
WHITE = "\t-\r \x85\xa0  -     　"
LETTER_KINDS = ("Lu", "Ll", "Lt", "Lm", "Lo")
WORD_KINDS = (*LETTER_KINDS, "Nl", "Mn", "Me", "Mc", "Nd", "Pc")
# Alphabetic symbols, and the two joiners.
WORD_MORE = "Ⓐ-ⓩ\U0001f130-\U0001f149\U0001f150-\U0001f169\U0001f170-\U0001f189‌‍"
# The same shapes with their first character in front, which a search skips to: forecast mark, period, signed number.
FORECAST = r"t(?<=\d{4}t)(?<!\d{5}t)\b"
PERIOD = r"\d(?:\d?\.\d{1,2}\.\d{4}|\d{3}/\d{1,2}(?!\d)|(?<!\d\d)\d{3}(?!\d)(?![a-zA-Z]))"
PERIOD_RUN = rf"{PERIOD}(?:{rules.PERIOD_STEP})++"
NUMBER = r"[(\-\d](?<![a-zA-Z].)(?:(?<=\()-?\d{1,3}|(?<=-)\d{1,3}|(?<=\d)\d{0,2})(?:\.\d{3})*(?:,\d+)?\)?"
EPOCH = 719_468  # days from 1 March of the year 0 to 1970-01-01


@cache
def _listed(kinds: tuple[str, ...]) -> str:
    """The characters of these Unicode categories as the inside of a class."""
    ranges, last = [], -2
    for code in range(0x110000):
        if unicodedata.category(chr(code)) in kinds:
            if code == last + 1:
                ranges[-1][1] = code
            else:
                ranges.append([code, code])
            last = code
    return "".join(re.escape(chr(a)) + (f"-{re.escape(chr(b))}" if b > a else "") for a, b in ranges)


@cache
def compiled(pattern: str) -> re.Pattern[str]:
    r"""The pattern as the JVM reads it under ``(?U)``. ``\b`` may stand at either end, next to a letter of the pattern.

    What a leading ``\b`` asks for is looked up after the word's letters, so that the search runs for these.
    """
    out, inside, i = [], False, 0
    while i < len(pattern):
        two = pattern[i:i + 2]
        if pattern.startswith(r"[\s\S]", i):
            out.append("(?s:.)")
            i += 6
        elif pattern.startswith(r"\p{L}", i):
            out.append(_listed(LETTER_KINDS) if inside else f"[{_listed(LETTER_KINDS)}]")
            i += 5
        elif two in (r"\s", r"\S", r"\w"):
            chars = WHITE if two != r"\w" else _listed(WORD_KINDS) + WORD_MORE
            out.append(chars if inside else f"[^{chars}]" if two == r"\S" else f"[{chars}]")
            i += 2
        elif two == r"\b" and not inside:
            word = _listed(WORD_KINDS) + WORD_MORE
            letters = re.match(r"[a-z]+(?![?*+{])", pattern[2:]).group() if i == 0 else ""
            out.append(f"{letters}(?<![{word}]{letters})" if i == 0 else f"(?![{word}])")
            i += 2 + len(letters)
        elif two[0] == "\\":
            out.append(two)
            i += 2
        else:
            inside = two[0] == "[" or inside and two[0] != "]"
            out.append(two[0])
            i += 1
    return re.compile("".join(out))


def ordinal(year: int, month: int, day: int) -> int | None:
    """Days since 1970, from the year 0 on; None for an impossible date."""
    leap = year % 4 == 0 and (year % 100 != 0 or year % 400 == 0)
    if not 1 <= month <= 12 or not 1 <= day <= (29 if leap and month == 2 else (31, 28, 31, 30, 31, 30, 31, 31, 30, 31, 30, 31)[month - 1]):
        return None
    y, m = (year, month - 3) if month > 2 else (year - 1, month + 9)
    return 365 * y + y // 4 - y // 100 + y // 400 + (153 * m + 2) // 5 + day - 1 - EPOCH


class Period(NamedTuple):
    kind: str
    start: int | None
    end: int | None


DOTTED, BARE, SLASH = (re.compile(p, re.ASCII) for p in (r"(\d{1,2})\.(\d{1,2})\.(\d{4})", r"\d{4}", r"(\d{4})/(\d{1,2})"))


@lru_cache(65_536)
def period(token: str) -> Period:
    """Type, first and last day of a period token; the days are None for an impossible date."""
    if BARE.fullmatch(token):
        return Period("ANNUAL", ordinal(int(token), 1, 1), ordinal(int(token), 12, 31))
    if whole := SLASH.fullmatch(token):
        year, month = int(whole[1]), int(whole[2])
        first = ordinal(year, month, 1)
        end = None if first is None else ordinal(year + month // 12, month % 12 + 1, 1) - 1
        return Period("INTERIM", None if end is None else ordinal(year, 1, 1), end)
    if whole := DOTTED.fullmatch(token):
        day, month, year = map(int, whole.groups())
        end = ordinal(year, month, day)
        return Period("ANNUAL" if (month, day) == (12, 31) else "INTERIM", None if end is None else ordinal(year, 1, 1), end)
    return Period("INTERIM", None, None)


def number(written: str) -> float | None:
    """``(x)`` and ``-x`` are negative; dots group, the comma is the decimal mark."""
    bare = written.replace(".", "").replace(",", ".")
    if not bare.isascii():
        return None
    if "0" <= bare[0] <= "9" and bare[-1] != ")":
        return float(bare)
    inner = bare.lstrip("(").rstrip(")")
    value = float(inner.removeprefix("-"))
    return -value if inner[0] == "-" or bare[0] == "(" and bare[-1] == ")" else value


def reach(text: str, chars: int, step: str) -> str:
    """The opening of ``text``: so many characters, the word they end in, and on while ``step`` (a bounded gap and one more token) repeats."""
    if len(text) <= chars:
        return text
    further = compiled(r"\S*(?:" + step + ")*+").match(text[chars:])
    return text[:chars] + (further.group() if further else "")


class Header(NamedTuple):
    periods: list[Period]
    scale: str
    stop: int  # characters of the body up to the end of the run
    bad: int  # tokens that are no dates


def header(body: str, chars: int) -> Header | None:
    """The first run of period tokens with a currency mark and no forecast around it, usable ones before those with ``bad`` tokens.

    The run begins within ``chars`` characters and may go on beyond. A run inside ``chars`` sees no further than that; one that goes on beyond has its
    own margin, in which a currency mark may stand.
    """
    window, margin, judged = reach(body, chars, rules.PERIOD_STEP), rules.CURRENCY_MARGIN, None
    if len(window) > chars:
        window = body[:len(window) + margin]
    for run in compiled(PERIOD_RUN).finditer(window):
        if run.start() >= chars:
            break
        stop = run.end()
        around = window[max(0, run.start() - margin):stop + margin if stop > chars else min(stop + margin, chars)]
        scale = next((name for mark, name in rules.CURRENCY_MARKS if compiled(mark).search(around)), None)
        if scale is None or compiled(FORECAST).search(around):
            continue
        periods = [period(t) for t in compiled(PERIOD).findall(run.group())]
        one = Header(periods, scale, stop, sum(p.end is None for p in periods))
        if one.bad == 0:
            return one
        judged = judged or one
    return judged


def numbers_after(text: str, label: str, needed: int, row_chars: int) -> list[str]:
    """The first ``needed`` numbers, as written, right after the first match of ``label``; fewer where they break off, none if none stand there."""
    at = compiled(label).search(text)
    digit = at and compiled(r"\d").search(text, at.end())
    gap = compiled(rules.LABEL_GAP[1:-1])
    # Up to the first digit stand only signs and gap, or what stands before the first number is more than a gap.
    if not digit or not gap.fullmatch(text, at.end(), digit.start()):
        return []
    opening = reach(text[at.end():], row_chars, rules.NUMBER_STEP)
    shape = compiled(NUMBER)
    first = shape.search(opening)
    return shape.findall(opening)[:needed] if first and gap.fullmatch(opening, 0, first.start()) else []


class Found(NamedTuple):
    """What stands at a caption for a metric: all its numbers (``raw``), or the most that one of its labels has (``have``)."""

    stop: int
    scope: str | None
    header: Header
    metric: str | None
    raw: list[str] | None
    values: list[float | None]
    have: int


def read_tables(folded: str, following: list[str], header_chars: int, row_chars: int) -> Iterator[Found]:
    """Every caption's metrics; a header with tokens that are no dates gives one row without a metric."""
    scope = None
    for i, heading in enumerate(HEADINGS):
        for caption in compiled(heading).finditer(folded):
            if scope is None:
                scope = next((name for mark, name in ((rules.STANDALONE_MARK, "standalone"), (rules.CONSOLIDATED_MARK, "consolidated")) if compiled(mark).search(folded)), "")
            after = folded[caption.end():]
            # Pages go on with this table up to one with a caption of the same kind.
            own = next((n for n, text in enumerate(following) if compiled(heading).search(text)), len(following))
            body = after + "\n" + "\n".join(following[:own])
            head = header(body, min(header_chars, len(after)))
            if head is None:
                continue
            need, stop = len(head.periods), caption.end() + 1
            if head.bad:
                yield Found(stop, scope or None, head, None, None, [], need - head.bad)
                continue
            rest = body[head.stop:]
            for metric, labels in METRICS[i]:
                have, raw = 0, None
                for label in labels:
                    listed = numbers_after(rest, label, need, row_chars)
                    have = max(have, len(listed))
                    if len(listed) == need:
                        raw = listed
                        break
                if have:
                    values = [number(n) for n in raw or ()]
                    yield Found(stop, scope or None, head, metric, raw, values, have if raw is None else sum(v is not None for v in values))


METRICS = tuple(tuple((m, rules.METRIC_LABELS[m]) for m, of in rules.METRIC_HEADINGS.items() if of == h) for h in HEADINGS)
