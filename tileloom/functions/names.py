"""Metadata read out of file names and free text."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def date8(name: Column) -> Column:
    """The first run of eight digits as a date; NULL when it is none."""
    digits = F.regexp_extract(name, r"(\d{8})", 1)
    return F.to_date(F.try_to_timestamp(F.nullif(digits, F.lit("")), F.lit("yyyyMMdd")))


def date6_token(name: Column, position: int = 5) -> Column:
    """A yyMMdd date in one of the underscore-separated tokens, counted from 1.

    The token must have exactly six characters; the century is always 20.
    """
    token = F.try_element_at(F.split(name, "_"), F.lit(position))
    digits = F.when(token.rlike(r"^\d{6}$"), F.concat(F.lit("20"), token))
    return F.to_date(F.try_to_timestamp(digits, F.lit("yyyyMMdd")))


def epsg(text: Column) -> Column:
    """The number in ``EPSG:<number>``; NULL for any other text."""
    code = F.regexp_extract(text, r"(?i)^EPSG:(\d+)$", 1)
    return F.nullif(code, F.lit("")).cast("int")


def before_classified(name: Column) -> Column:
    return F.substring_index(name, "_classified", 1)


def matches(name: Column, pattern: str) -> Column:
    return name.rlike(pattern)


def not_excluded(name: Column, patterns: list[str]) -> Column:
    """True when none of the regular expressions occurs, upper and lower case alike."""
    keep = F.lit(True)
    for pattern in patterns:
        keep = keep & ~name.rlike("(?i)" + pattern)
    return keep
