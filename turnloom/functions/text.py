"""Small string functions of names, identifiers, tables and reports."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def ends_sentence(text: Column) -> Column:
    """Whether a text, without trailing blanks, ends in . ? ! or an ellipsis."""
    return F.rtrim(text).rlike("[.?!…]$")


def slug(text: Column) -> Column:
    """Small letters and digits; everything else an underscore, none at the ends."""
    return F.lower(F.regexp_replace(F.regexp_replace(text, "[^a-zA-Z0-9]", "_"), "^_+|_+$", ""))


def sql_literal(text: Column) -> Column:
    """A text as SQL literal, quotes doubled."""
    return F.concat(F.lit("'"), F.replace(text, F.lit("'"), F.lit("''")), F.lit("'"))


def anon_name(n: Column) -> Column:
    return F.format_string("anon_%03d", n)


def anon_number(name: Column) -> Column:
    """The number of ``anon_<digits>``; null for other names."""
    return F.try_to_number(F.nullif(F.regexp_extract(name, r"^anon_(\d+)$", 1), F.lit("")), F.lit("999999999")).cast("long")


def utterance_id(n: Column) -> Column:
    return F.format_string("utt-%03d", n)


def url_scheme(url: Column) -> Column:
    """The scheme of a storage address if it is a known one, else null."""
    scheme = F.lower(F.regexp_extract(url, "^([A-Za-z][A-Za-z0-9+.-]*)://", 1))
    return F.when(scheme.isin("memory", "sqlite", "postgres", "postgresql", "parquet", "jdbc"), scheme)


def percent(x: Column, digits: int = 1) -> Column:
    """``12.3%``; a dash for null or NaN."""
    return F.when(x.isNull() | F.isnan(x), F.lit("–")).otherwise(F.format_string(f"%.{digits}f%%", x * 100))


def signed(x: Column, digits: int = 3) -> Column:
    """With its sign; a dash for null or NaN."""
    return F.when(x.isNull() | F.isnan(x), F.lit("–")).otherwise(F.format_string(f"%+.{digits}f", x))
