"""Attribute values: form and cell coercion, display of cells, identity keys and equality."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import is_blank, strip

#: Fixed words for true and false.
TRUE_WORDS = ("true", "1", "yes", "on")
FALSE_WORDS = ("false", "0", "no", "off")
DATA_TYPES = ("text", "number", "boolean", "date", "datetime", "choice", "url")
IDENTITY_TYPES = ("text", "number", "date", "choice", "url")


def number_of(col: Column) -> Column:
    """A double, or null if the text is no number. Digit groups by underscore are read as in 1_000."""
    return F.regexp_replace(strip(col), "(?<=[0-9])_(?=[0-9])", "").try_cast("double")


def boolean_of(col: Column) -> Column:
    word = F.lower(strip(col))
    return F.when(word.isin(*TRUE_WORDS), True).when(word.isin(*FALSE_WORDS), False)


def date_of(col: Column) -> Column:
    text = strip(col)
    return F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.try_to_date(text, "yyyy-MM-dd"))


def datetime_of(col: Column) -> Column:
    text = F.regexp_replace(strip(col), "^(.{10})[ t]", "$1T")
    return F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}(T\d{2}:\d{2}(:\d{2}(\.\d{1,6})?)?(Z|[+-]\d{2}:?\d{2})?)?$"), text.try_cast("timestamp"))


def coerce(col: Column, data_type: Column) -> Column:
    """struct(value, kind, converted) of a cell for its column's data type. Unreadable cells pass through, not converted."""
    text = strip(col)
    n, b, d, t = number_of(col), boolean_of(col), date_of(col), datetime_of(col)
    value = (
        F.when(is_blank(col), F.lit(None).cast("string"))
        .when((data_type == "number") & n.isNotNull(), number_text(n))
        .when((data_type == "boolean") & b.isNotNull(), b.cast("string"))
        .when((data_type == "date") & d.isNotNull(), d.cast("string"))
        .when((data_type == "datetime") & t.isNotNull(), F.date_format(t, "yyyy-MM-dd'T'HH:mm:ss"))
        .otherwise(text)
    )
    read = (
        F.when(is_blank(col), True)
        .when(data_type == "number", n.isNotNull())
        .when(data_type == "boolean", b.isNotNull())
        .when(data_type == "date", d.isNotNull())
        .when(data_type == "datetime", t.isNotNull())
        .otherwise(True)
    )
    kind = F.when(is_blank(col), "null").when(read & (data_type == "number"), "number").when(read & (data_type == "boolean"), "boolean").otherwise("string")
    return F.struct(value.alias("value"), kind.alias("kind"), read.alias("converted"))


def number_text(n: Column) -> Column:
    """Whole numbers without a fraction, others as they print."""
    return F.when((n == F.floor(n)) & (F.abs(n) < 1e15), n.cast("long").cast("string")).otherwise(n.cast("string"))


def cell_text(value: Column, kind: Column) -> Column:
    """A stored value as a cell shows it: 3.0 as 3, booleans in lower case."""
    return F.when(kind == "number", number_text(value.try_cast("double"))).when(kind == "boolean", F.lower(value)).otherwise(value)


def identity_key(value: Column, kind: Column) -> Column:
    """struct(kind, text) that is equal just for values of one identity; null for booleans, nulls and blanks.

    Exact and case-sensitive; the number 1 is 1.0 but not the text "1".
    """
    key = F.struct(kind.alias("kind"), F.when(kind == "number", number_text(value.try_cast("double"))).otherwise(value).alias("text"))
    return F.when(kind.isin("number", "string") & ~is_blank(value), key)


def same_value(a: Column, a_kind: Column, b: Column, b_kind: Column) -> Column:
    """Null-safe, kinds apart (true is not 1), numbers by value."""
    numbers = (a_kind == "number") & (b_kind == "number")
    return F.when(numbers, a.try_cast("double").eqNullSafe(b.try_cast("double"))).otherwise(a_kind.eqNullSafe(b_kind) & a.eqNullSafe(b))


def format_cell(value: Column, data_type: Column) -> Column:
    """A stored value as a template's cell holds it, so that ``coerce`` gives the value back; an unset one is empty."""
    return F.when(value.isNull(), F.lit("")).when(data_type == "boolean", F.lower(value)).when(data_type == "number", F.coalesce(number_text(value.try_cast("double")), value)).otherwise(value)
