"""Dates, school years, coercion and tolerant JSON as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The month names of an agenda header.
MONTHS = "January|February|March|April|May|June|July|August|September|October|November|December"
DATE_PATTERN = rf"(?i)\b({MONTHS})\s+(\d{{1,2}}),?\s+(\d{{4}})\b"


def meeting_date(text: Column) -> Column:
    """First "Month D, YYYY" of a text; null without one, or if it names no day."""
    part = lambda g: F.regexp_extract(text, DATE_PATTERN, g)
    month = F.array_position(F.lit(MONTHS.lower().split("|")), F.lower(part(1)))
    return F.when(part(1) != "", F.try_to_date(F.concat_ws("-", part(3), F.lpad(month.cast("string"), 2, "0"), F.lpad(part(2), 2, "0")), "yyyy-MM-dd"))


def compact_date(text: Column) -> Column:
    """First YYYYMMDD of a text as a date."""
    return F.try_to_date(F.nullif(F.regexp_extract(text, r"(20\d{2}[01]\d[0-3]\d)", 1), F.lit("")), "yyyyMMdd")


def _school_year(start: Column) -> Column:
    return F.concat(start.cast("string"), F.lit("-"), F.lpad(F.pmod(start + 1, F.lit(100)).cast("string"), 2, "0"))


def school_year(day: Column) -> Column:
    """"2024-25" of a date; a school year begins in July."""
    return _school_year(F.year(day) - F.when(F.month(day) >= 7, 0).otherwise(1))


def school_year_of_title(title: Column) -> Column:
    """First school year that a title names; of a longer term the first year."""
    start = F.regexp_extract(title, r"(20\d{2})\s*[-–—/]\s*(20\d{2}|\d{2})", 1)
    return F.when(start != "", _school_year(start.cast("int")))


def week_start(day: Column) -> Column:
    """Monday of the ISO week."""
    return F.to_date(F.date_trunc("week", day))


def number(raw: Column) -> Column:
    """A printed number: without , $ and %; placeholders of a dash give null; else the first number in it."""
    s = F.regexp_replace(F.trim(raw), r"[,$%]", "")
    first = F.nullif(F.regexp_extract(s, r"-?\d+(?:\.\d+)?", 0), F.lit(""))
    return F.when(~s.isin("", "-", "—", "–"), F.coalesce(s.try_cast("double"), first.try_cast("double")))


def integer(raw: Column) -> Column:
    return number(raw).cast("int")


def boolean(raw: Column) -> Column:
    return F.coalesce(F.lower(F.trim(raw)).isin("true", "yes", "y", "1"), F.lit(False))


def json_object(raw: Column) -> Column:
    """The text from the first { to the last }, where a model wrapped its JSON in fences or prose; null if it is no object."""
    inner = F.regexp_extract(raw, r"(?s)(\{.*\})", 1)
    return F.when(F.get_json_object(inner, "$").isNotNull(), inner)


def token_estimate(text: Column, per_token: float = 1.5, most: int = 32_000) -> Column:
    return F.least((F.char_length(text) / per_token).cast("int") + 1, F.lit(most))


def page_of_path(path: Column) -> Column:
    """Page of a table's section path: T4#1 is on page 4."""
    return F.nullif(F.regexp_extract(path, r"^T(\d+)", 1), F.lit("")).cast("int")
