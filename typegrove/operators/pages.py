"""Pages of rows in a total order that do not sort or skip what comes before: by the last row seen, or by an index of ranges."""

from __future__ import annotations

from bisect import bisect_right
from itertools import accumulate

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..shared import Steps

#: An order is a list of (column name, descending); the last column tells all rows apart.
Order = list[tuple[str, bool]]


def sorting(order: Order) -> list[Column]:
    return [F.desc_nulls_last(c) if down else F.asc_nulls_first(c) for c, down in order]


def beyond(order: Order, last: list) -> Column:
    """Whether a row comes after the row whose values of the order's columns are ``last``; a null is the least value."""
    out = F.lit(False)
    for (c, down), value in zip(reversed(order), reversed(last)):
        x = F.col(c)
        if value is None:
            more, same = F.lit(False) if down else x.isNotNull(), x.isNull()
        else:
            more, same = (F.coalesce(x < value, F.lit(True)), x == value) if down else (x > value, x == value)
        out = F.coalesce(more, F.lit(False)) | (F.coalesce(same, F.lit(False)) & out)
    return out


def seek(rows: DataFrame, order: Order, last: list | None, size: int) -> DataFrame:
    """The page after the row with values ``last`` (None: the first page): a filter, and the least rows of each task."""
    rows = rows if last is None else rows.where(beyond(order, last))
    return rows.orderBy(*sorting(order)).limit(size)


class Pages:
    """Rows in the ranges of an order, written once; a page is found by the ranges' counts and read from one range or two."""

    def __init__(self, rows: DataFrame, order: Order, name: str = "pages"):
        self.order, self.steps = order, Steps(rows.sparkSession, name)
        self.spark, self.schema = rows.sparkSession, rows.schema
        ranged = rows.repartitionByRange(*sorting(order)).sortWithinPartitions(*sorting(order)).withColumn("page_range", F.spark_partition_id())
        ranged.write.partitionBy("page_range").parquet(f"{self.steps.root}/ranges")
        found = self.spark.read.parquet(f"{self.steps.root}/ranges").groupBy("page_range").count()
        self.ranges = sorted((r["page_range"], r["count"]) for r in found.collect())  # a number a range
        self.ends = list(accumulate(n for _, n in self.ranges))

    def page(self, number: int, size: int) -> DataFrame:
        """The rows of a page, numbered from 1; none beyond the last."""
        first, end = (max(1, number) - 1) * size, max(1, number) * size
        own, taken = bisect_right(self.ends, first), []
        while own < len(self.ranges) and (self.ends[own] - self.ranges[own][1]) < end:
            taken.append(self.ranges[own][0])
            own += 1
        if not taken:
            return self.spark.createDataFrame([], self.schema)
        skipped = first - (self.ends[own - len(taken)] - self.ranges[own - len(taken)][1])
        rows = self.spark.read.schema(self.schema).parquet(*[f"{self.steps.root}/ranges/page_range={k}" for k in taken])
        # what is sorted are the rows up to the page's end in its own ranges
        return rows.orderBy(*sorting(self.order)).offset(skipped).limit(size)
