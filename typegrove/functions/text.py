"""Text functions: comparison keys, blanks, snippets, labels, slugs, ids. All stay in the JVM but for exact case folding."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType


@F.pandas_udf(StringType())
def _casefold(s: pd.Series) -> pd.Series:
    return s.map(lambda x: None if x is None else x.casefold())


@F.pandas_udf(ArrayType(StringType()))
def fold_each(s: pd.Series) -> pd.Series:
    """Full Unicode case folding of each text of an array."""
    return s.map(lambda a: None if a is None else [None if x is None else x.casefold() for x in a])


def fold(col: Column, exact: bool = False) -> Column:
    """Caseless comparison key. ``exact``: full Unicode case folding in Arrow batches; else ``lower``, the same for ASCII."""
    return _casefold(col) if exact else F.lower(col)


def strip(col: Column) -> Column:
    """Without white space at either end, tabs and line ends included."""
    return F.regexp_replace(col, r"(?U)^\s+|\s+$", "")


def is_blank(col: Column) -> Column:
    """Null or white space only."""
    return col.isNull() | (strip(col) == "")


def is_populated(col: Column) -> Column:
    return ~is_blank(col)


def squeeze(col: Column) -> Column:
    """White space runs as one space, none at the ends."""
    return F.btrim(F.regexp_replace(col, r"(?U)\s+", " "))


def snippet(col: Column, length: int = 80) -> Column:
    return F.when(F.char_length(col) > length, F.concat(F.left(col, F.lit(length - 1)), F.lit("…"))).otherwise(col)


def squeezed_snippet(col: Column, length: int = 80) -> Column:
    return snippet(squeeze(col), length)


def display(col: Column, kind: str) -> Column:
    """Booleans as Yes or No, blanks as null."""
    if kind == "boolean":
        return F.when(F.lower(col) == "true", "Yes").when(F.lower(col) == "false", "No")
    return F.when(is_populated(col), col)


def without_zero_fraction(col: Column) -> Column:
    """30.0 as 30."""
    return F.regexp_replace(col, r"^(-?[0-9]+)\.0$", "$1")


def slug(col: Column, length: int = 100) -> Column:
    """Lower-case ASCII letters and digits joined by single underscores, accents dropped."""
    plain = F.regexp_replace(_unaccent(col), r"[^A-Za-z0-9]+", "_")
    return F.btrim(F.left(F.btrim(F.lower(plain), F.lit("_")), F.lit(length)), F.lit("_"))


@F.pandas_udf(StringType())
def _unaccent(s: pd.Series) -> pd.Series:
    return s.map(lambda x: None if x is None else unicodedata.normalize("NFKD", x).encode("ascii", "ignore").decode())


def is_slug(col: Column, length: int = 100) -> Column:
    return col.rlike(r"^[a-z][a-z0-9_]*$") & (F.char_length(col) <= length)


def uuid_of(col: Column) -> Column:
    """The canonical lower-case form of an id written with braces, a urn prefix, capitals or no hyphens; null if it is none."""
    bare = F.regexp_replace(F.lower(strip(col)), r"^urn:uuid:|[{}-]", "")
    dashed = F.regexp_replace(bare, "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5")
    return F.when(bare.rlike("^[0-9a-f]{32}$"), dashed)


def field_label(col: Column) -> Column:
    return F.initcap(F.replace(col, F.lit("_"), F.lit(" ")))


def bounds_label(least: Column, most: Column) -> Column:
    """min..max, an open end as a star."""
    return F.concat(least.cast("string"), F.lit(".."), F.coalesce(most.cast("string"), F.lit("*")))


def is_web_url(col: Column) -> Column:
    return F.coalesce(strip(col).rlike(r"^(?i)https?://[^\s/]+"), F.lit(False))


def iso_time(col: Column) -> Column:
    return F.date_format(col, "yyyy-MM-dd'T'HH:mm:ss")


def header_key(col: Column) -> Column:
    """Letters and digits only, for matching column headers to fields."""
    return F.regexp_replace(F.lower(col), "[^a-z0-9]+", "")


def tokens(query: str) -> list[str]:
    return query.lower().split()


def has_all_tokens(col: Column, query: str) -> Column:
    out = F.lit(True)
    for t in tokens(query):
        out = out & F.contains(F.lower(col), F.lit(t))
    return out


def file_slug(name: str, fallback: str = "model") -> str:
    out = re.sub(r"[^a-z0-9]+", "-", unicodedata.normalize("NFKD", name).encode("ascii", "ignore").decode().lower()).strip("-")
    return out or fallback
