"""A bounded slice of a dataset for a language model: ranked objects and their neighbourhood within a budget of bytes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schema import Dataset
from ..shared import Steps
from . import dataset as ds
from .reach import reachable

MOST_OBJECTS, HOPS, MOST_BYTES = 300, 2, 100_000


def slice_(dataset: Dataset, seeds: DataFrame, most: int = MOST_OBJECTS, hops: int = HOPS) -> DataFrame:
    """Seeds first, then neighbours within ``hops``, then the rest by degree, name and id; at most ``most`` objects."""
    near = reachable(seeds, dataset.relationships, hops).withColumnRenamed("hops", "priority")
    rows = dataset.objects.join(near, "id", "left").withColumn("priority", F.coalesce("priority", F.lit(hops + 1)))
    rows = ds.with_degree(rows, dataset.relationships)
    return rows.orderBy("priority", F.desc("degree"), F.lower("name"), "id").limit(most)


def packet(dataset: Dataset, seeds: DataFrame, most: int = MOST_OBJECTS, hops: int = HOPS, most_bytes: int = MOST_BYTES) -> tuple[DataFrame, DataFrame]:
    """Objects and edges of the slice, a tenth of the objects dropped at a time until both fit as JSON.

    The slice has at most ``most`` rows; the loop measures sizes, and stops at one object.
    """
    kept = most
    base = Steps(dataset.objects.sparkSession, "context").keep(slice_(dataset, seeds, most, hops), "slice")
    while True:
        objects = base.orderBy("priority", F.desc("degree"), F.lower("name"), "id").limit(kept)
        ids = objects.select("id")
        edges = dataset.relationships.join(ids.withColumnRenamed("id", "source_id"), "source_id", "left_semi").join(ids.withColumnRenamed("id", "target_id"), "target_id", "left_semi")
        size = sum(serialised_size(df).first()["bytes"] for df in (objects, edges))
        if size <= most_bytes or kept <= 1:
            return objects, edges
        kept = max(1, min(kept, base.count()) * 9 // 10)


def serialised_size(df: DataFrame) -> DataFrame:
    return df.agg(F.coalesce(F.sum(F.octet_length(F.to_json(F.struct(*[F.col(c) for c in df.columns])))), F.lit(0)).alias("bytes"))


def usage(logs: DataFrame) -> DataFrame:
    """Numeric usage entries (a JSON map per log row) summed by key, others by their last value."""
    rows = logs.select("seq", F.explode(F.from_json("usage_json", "map<string,string>")).alias("key", "value"))
    n = F.col("value").try_cast("double")
    return rows.groupBy("key").agg(F.sum(n).alias("total"), F.max_by("value", "seq").alias("last"))
