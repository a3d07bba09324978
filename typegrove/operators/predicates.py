"""Attribute filters as columns over ``type_id`` and ``attributes``."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.text import fold, is_populated
from ..functions.values import number_of
from ..plans.query import Filter


def in_values(raw: Column, values: tuple[str, ...], exact: bool = False) -> Column:
    """Caseless membership; the values come case-folded."""
    return is_populated(raw) & fold(raw, exact).isin(*values)


def contains_text(raw: Column, text: str, exact: bool = False) -> Column:
    """Caseless substring, without wildcards."""
    return is_populated(raw) & F.contains(fold(raw, exact), F.lit(text.casefold() if exact else text.lower()))


def in_number_range(raw: Column, least: float | None, most: float | None) -> Column:
    """Inclusive, open where a bound is missing; what is no number does not match."""
    n = number_of(raw)
    out = is_populated(raw) & n.isNotNull() & ~F.isnan(n)
    out = out & (n >= F.lit(float(least))) if least is not None else out
    return out & (n <= F.lit(float(most))) if most is not None else out


def in_text_range(raw: Column, least: str | None, most: str | None) -> Column:
    """ISO dates and times by code points; a short upper bound takes in all that begins with it."""
    out = is_populated(raw)
    out = out & (raw >= F.lit(least)) if least is not None else out
    return out & (F.left(raw, F.lit(len(most))) <= F.lit(most)) if most is not None else out


def matches(f: Filter, exact: bool = False) -> Column:
    """Whether a row of the filter's type has the attribute value; never null."""
    raw = F.element_at("attributes", F.lit(f.attribute))
    if f.operator == "in":
        out = in_values(raw, f.values, exact)
    elif f.operator == "contains":
        out = contains_text(raw, f.text, exact)
    elif isinstance(f.least, float) or isinstance(f.most, float):
        out = in_number_range(raw, f.least, f.most)
    else:
        out = in_text_range(raw, f.least, f.most)
    return F.coalesce(out, F.lit(False))


def passes(filters: tuple[Filter, ...], exact: bool = False) -> Column:
    """All filters of a row's own type hold; filters on other types leave it alone."""
    return reduce(lambda a, f: a & ((F.col("type_id") != f.type_id) | matches(f, exact)), filters, F.lit(True))
