"""Edges that are valid for a time: the view as of a moment, and pairs of edges whose times overlap.

An edge is valid from ``valid_from`` on and before ``valid_to``; a null bound is open.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import Dataset

#: Widths of time ranges in seconds: the first an hour, each eight times the one before; the last holds all time.
HOUR, STEP, LEVELS = 3600, 8, 9


def valid_at(when: Column) -> Column:
    starts, ends = F.col("valid_from"), F.col("valid_to")
    return (starts.isNull() | (starts <= when)) & (ends.isNull() | (ends > when))


def as_of(dataset: Dataset, when: str | Column) -> Dataset:
    """The dataset with the edges that are valid at a moment; a text is read as a timestamp."""
    moment = F.lit(when).cast(dict(dataset.relationships.dtypes)["valid_from"]) if isinstance(when, str) else when
    return dataset.with_(relationships=dataset.relationships.where(valid_at(moment)))


def _seconds(moment: Column, open_: int) -> Column:
    return F.coalesce(F.unix_seconds(moment.cast("timestamp")), F.lit(open_))


def _at_level(level: int):
    return lambda r: F.struct(F.lit(level).alias("level"), r.alias("range"))


def _ranged(rows: DataFrame, side: str, keys: list[str]) -> DataFrame:
    """A row for each level from the edge's own up and each of the at most two ranges of that level that its time meets.

    An edge's own level is the first whose ranges are as wide as its time is long.
    """
    first, last = F.col("__from"), F.greatest(F.col("__to") - 1, F.col("__from"))
    rows = rows.withColumns({"__from": _seconds(F.col("valid_from"), -(1 << 40)), "__to": _seconds(F.col("valid_to"), 1 << 40)})
    rows = rows.where("__from < __to")  # a time that ends when it begins, or before, meets nothing
    top, levels = LEVELS - 1, []
    for k in range(top):
        width = HOUR * STEP**k
        fits = F.col("__to") - F.col("__from") <= width
        spans = F.transform(F.sequence(F.floor(first / width), F.floor(last / width)), _at_level(k))
        levels.append(F.when(fits, spans).otherwise(F.array().cast("array<struct<level:int,range:bigint>>")))
    levels.append(F.array(F.struct(F.lit(top).alias("level"), F.lit(0).cast("long").alias("range"))))
    at = F.flatten(F.array(*levels))
    rows = rows.select(*keys, F.col("id").alias(f"{side}_id"), F.col("__from").alias(f"{side}_from"), F.col("__to").alias(f"{side}_to"), at.alias("__at"))
    rows = rows.withColumn(f"{side}_own", F.element_at("__at", 1)["level"])
    return rows.select("*", F.explode("__at").alias("__x")).select("*", "__x.*").drop("__at", "__x")


def overlapping(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, left_id, right_id) of edges with equal keys whose times have a moment in common, each pair once.

    A pair meets in ranges of the wider one's own level, which both meet in two ranges at most, and counts in the range
    where the later of the two begins. So an edge comes to twice as many rows as there are levels at most, and pairs are
    found by an equi-join on keys, level and range that is as wide as the result is, not by all pairs of a key. Times that
    are longer than the widest range, or open, share one range a key.
    """
    pairs = _ranged(left, "left", keys).join(_ranged(right, "right", keys), [*keys, "level", "range"])
    width = F.lit(HOUR) * F.pow(F.lit(STEP), F.col("level"))
    later = F.greatest("left_from", "right_from")
    counts = F.when(F.col("level") == LEVELS - 1, F.lit(True)).otherwise(F.floor(later / width) == F.col("range"))
    pairs = pairs.where((F.col("level") == F.greatest("left_own", "right_own")) & counts)
    return pairs.where("left_from < right_to and right_from < left_to").select(*keys, "left_id", "right_id")
