"""What several operators share: shared scratch tables, range buckets of documents, word splitting."""

from __future__ import annotations

import atexit
import json
import os
import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The whitespace of every word rule: space and the five ASCII controls from tab to carriage return.
SPACE = r"[\x20\x09-\x0D]"
STRIP = " \t\n\x0b\x0c\r"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def text_of(col: str | Column = "text") -> Column:
    """The text, a null one as the empty text."""
    return F.coalesce(F.col(col) if isinstance(col, str) else col, F.lit(""))


def ascii_lower(col: Column) -> Column:
    """Lower-cases A-Z only. Texts of one byte per character take the faster built-in, which then does the same."""
    return F.when(F.octet_length(col) == F.char_length(col), F.lower(col)).otherwise(F.translate(col, UPPER, UPPER.lower()))


def words_of(col: Column) -> Column:
    return F.filter(F.split(col, SPACE + "+"), lambda w: w != "")


def let(value: Column, body) -> Column:
    """``body`` of a value that is computed once, however often the body (or a lambda within it) uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def fresh(taken: list[str], *names: str) -> list[str]:
    """The names, each led by as many more underscores as set it apart from the columns of a table (in any case)."""
    have, out = {c.lower() for c in taken}, []
    for name in names:
        while name.lower() in have:
            name = "_" + name
        have.add(name.lower())
        out.append(name)
    return out


_open: list[Scratch] = []


def _drop_after(mark: int) -> None:
    while len(_open) > mark:
        _open.pop().drop()


@contextmanager
def passing():
    """Drops, at its end, the shared folders that were opened within: for a result that is written by then."""
    mark = len(_open)
    try:
        yield
    finally:
        _drop_after(mark)


class Scratch:
    """Tables written to the folder that all executors share (``spark.checkpoint.dir``), removed when the driver exits.

    They cut lineage: a lost executor costs a reread of the table and no recomputation of what came before it.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        base = spark.conf.get("spark.checkpoint.dir", None)
        if not base:
            if not spark.sparkContext.master.startswith("local"):
                raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
            base = os.path.join(tempfile.gettempdir(), "typegrove-scratch")
        self.root = f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"
        if not _open:
            atexit.register(_drop_after, 0)
        _open.append(self)

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def keep(self, df: DataFrame, name: str, compression: str = "snappy") -> DataFrame:
        """Writes the table and returns it as read back."""
        df.write.option("compression", compression).parquet(self.path(name))
        return self.spark.read.schema(df.schema).parquet(self.path(name))

    def drop(self, name: str | None = None) -> None:
        try:
            jvm = self.spark.sparkContext._jvm
            path = jvm.org.apache.hadoop.fs.Path(self.path(name) if name else self.root)
            path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
        except Exception:  # the session may have ended already
            pass


#: Bounds found at once. More ranges than that are cut in two steps.
TOP = 512


def range_bounds(df: DataFrame, key: str, buckets: int, accuracy: int = 100_000) -> list[int]:
    """Up to ``buckets`` - 1 ascending values of the long column ``key`` that cut its rows into ranges of about equal size.

    Each bound is a value that occurs; the first bucket holds what is below the first bound. More than ``TOP`` buckets
    are cut in two steps, first into ``TOP`` ranges, then each of those by its own quantiles, so that their number can
    grow with the rows (``TOP`` squared before a task has more than ``TOP`` quantiles to find).
    """
    if buckets < 2:
        return []
    tops = min(buckets, TOP)
    at = [i / tops for i in range(1, tops)]
    found = df.select(F.percentile_approx(key, at, accuracy).alias("q")).first()["q"]
    bounds = sorted({int(x) for x in found or []})
    inner = -(-buckets // tops)
    if inner > 1 and bounds:
        at = [i / inner for i in range(1, inner)]
        cut = df.where(F.col(key).isNotNull()).groupBy(bucket_of(F.col(key), bounds).alias("b")).agg(F.percentile_approx(key, at, accuracy).alias("q"))
        bounds = sorted({*bounds, *(int(x) for r in cut.collect() for x in r["q"] or [])})  # a number a range
    return bounds


def numbers(values: list[int]) -> Column:
    """A list of integers as one constant of the plan, whatever its length."""
    return F.from_json(F.lit(json.dumps(values)), "array<bigint>")


def bucket_of(key: Column, bounds: list[int]) -> Column:
    """The number of bounds at or below the key: its range bucket.

    Up to ``TOP`` bounds are halved (log2 of them in comparisons); of more, every n-th is halved and the stretch counted.
    """

    def part(own: list[int], lo: int, hi: int) -> Column:
        if lo == hi:
            return F.lit(lo)
        mid = (lo + hi) // 2
        return F.when(key >= F.lit(own[mid]), part(own, mid + 1, hi)).otherwise(part(own, lo, mid))

    if len(bounds) <= TOP:
        return part(bounds, 0, len(bounds)).cast("int")
    step = -(-len(bounds) // TOP)
    tops = bounds[::step]
    at = (part(tops, 0, len(tops)) - 1) * step
    return F.when(key >= F.lit(tops[0]), at + F.array_size(F.filter(F.slice(numbers(bounds), at + 1, step), lambda x: x <= key))).otherwise(0).cast("int")


def sums_before(df: DataFrame, key: str, ranges: int, *columns: str) -> list[Column]:
    """For each column its sum over all ranges before that in column ``key``. A number a range and column reaches the driver."""
    found = {r[key]: r for r in df.groupBy(key).agg(*[F.sum(c).alias(c) for c in columns]).collect()}
    out = []
    for c in columns:
        before, at = [], 0
        for k in range(ranges):
            before.append(at)
            at += found[k][c] if k in found else 0
        out.append(F.element_at(numbers(before), F.col(key) + 1))
    return out


def buckets_for(rows: int, each: int) -> int:
    return max(1, -(-rows // each))


def parallelism(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
