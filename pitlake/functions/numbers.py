"""Locale numbers, dates and score bands as Column expressions; bad input is NULL, never an error."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Month names after folding.
MONTHS = {
    "ocak": 1, "subat": 2, "mart": 3, "nisan": 4, "mayis": 5, "haziran": 6,
    "temmuz": 7, "agustos": 8, "eylul": 9, "ekim": 10, "kasim": 11, "aralik": 12,
}


def parse_number(raw: Column) -> Column:
    """``2.380.000.000`` and ``25,03``: dots group, the comma is the decimal mark."""
    plain = F.replace(F.replace(F.trim(raw), F.lit("."), F.lit("")), F.lit(","), F.lit("."))
    return plain.try_cast("double")


def parse_signed_number(raw: Column) -> Column:
    """``(x)`` and ``-x`` are negative."""
    bare = F.trim(raw)
    in_parens = bare.rlike(r"^\(.*\)$")
    inner = F.regexp_replace(bare, r"^\(+|\)+$", "")
    minus = F.startswith(inner, F.lit("-"))
    value = parse_number(F.regexp_replace(inner, "^-", ""))
    # Most numbers have neither sign nor parentheses and need no expression.
    unsigned = F.left(bare, F.lit(1)).between("0", "9") & ~F.contains(bare, F.lit(")"))
    return F.when(unsigned, parse_number(bare)).when(in_parens | minus, -value).otherwise(value)


def parse_dotted_date(raw: Column) -> Column:
    """``D.M.YYYY`` or ``D/M/YYYY``."""
    text = F.trim(raw)
    shaped = text.rlike(r"^\d{1,2}[./]\d{1,2}[./]\d{4}$")
    return F.when(shaped, F.try_to_date(F.replace(text, F.lit("/"), F.lit(".")), "d.M.yyyy"))


def parse_month_name_date(day: Column, folded_month: Column, year: Column) -> Column:
    number = F.lit(None).cast("int")
    for name, value in MONTHS.items():
        number = F.when(F.trim(folded_month) == name, value).otherwise(number)
    return F.try_to_date(F.concat_ws("-", year, number.cast("string"), day), "yyyy-M-d")


def parse_period_start(raw: Column) -> Column:
    """``YYYY / M`` is the first day of that month."""
    shaped = raw.rlike(r"^\s*\d+\s*/\s*\d+\s*$")
    parts = F.transform(F.split(raw, "/"), lambda t: F.trim(t))
    text = F.concat(F.try_element_at(parts, F.lit(1)), F.lit("-"), F.try_element_at(parts, F.lit(2)), F.lit("-1"))
    return F.when(shaped, F.try_to_date(text, "yyyy-M-d"))


def parse_series_date(raw: Column, frequency: Column) -> Column:
    """Daily points are dated ``D-M-YYYY``; monthly ones ``YYYY-M``, meaning the first day."""
    text = F.trim(raw)
    daily = F.when(text.rlike(r"^\d{1,2}-\d{1,2}-\d{4}$"), F.try_to_date(text, "d-M-yyyy"))
    monthly = F.when(text.rlike(r"^\d{4}-\d{1,2}$"), F.try_to_date(F.concat(text, F.lit("-1")), "yyyy-M-d"))
    return F.when(frequency == "daily", daily).when(frequency == "monthly", monthly)


def band_normalize(value: Column, low_value: Column, low_score: Column, high_value: Column, high_score: Column) -> Column:
    """Clamped linear score; a band of zero width gives the high score."""
    share = F.try_divide(value - low_value, high_value - low_value)
    clamped = F.least(F.lit(1.0), F.greatest(F.lit(0.0), share))
    scored = F.when(high_value == low_value, high_score).otherwise(low_score + clamped * (high_score - low_score))
    return F.when(value.isNotNull(), scored)
