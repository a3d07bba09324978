"""Numbers and running sums within groups, where one group may hold most of the rows: no task has a whole group.

A group is cut into parts of bounded size; a window numbers each part, after the sum of the parts before it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..shared import Steps


def sums_before(rows: DataFrame, group: list[str], part: str, order: list[Column | str], value: str, name: str, total: str | None = None) -> DataFrame:
    """``rows`` with the sum of ``value`` over the rows of their group that come before: those of earlier parts, by ``part``, and
    those before in their own part, by ``order``. A group has a row a part in the inner table. ``total`` names the group's own sum, where it is wanted."""
    per = rows.groupBy(*group, part).agg(F.sum(value).alias("__sum"))
    earlier = Window.partitionBy(*group).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    per = per.select(*group, part, F.coalesce(F.sum("__sum").over(earlier), F.lit(0)).alias("__start"), *([F.sum("__sum").over(Window.partitionBy(*group)).alias(total)] if total else []))
    own = Window.partitionBy(*group, part).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    out = rows.withColumn("__own", F.coalesce(F.sum(value).over(own), F.lit(0))).join(per, [*group, part])
    return out.withColumn(name, F.col("__start") + F.col("__own")).drop("__start", "__own")


def places(rows: DataFrame, group: list[str], order: list[Column], name: str, steps: Steps, total: str | None = None) -> DataFrame:
    """``rows`` with their place in the group, from 1, by ``order``, which has to be total.

    Rows are dealt by ranges of group and order and written once, so that the number of a range stands; a large group lies in
    many ranges. ``total`` names the group's size, where it is wanted.
    """
    ranged = rows.repartitionByRange(*[F.col(g) for g in group], *order).withColumns({"__part": F.spark_partition_id(), "__one": F.lit(1)})
    ranged = steps.keep(ranged, f"ranged-{name}")
    return sums_before(ranged, group, "__part", order, "__one", "__before", total).withColumn(name, (F.col("__before") + 1).cast("int")).drop("__part", "__one", "__before")
