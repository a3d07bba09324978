"""What a publication says about itself: its types and their counts, its size against the model's, its starting objects."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schema import Dataset
from . import provenance
from .facets import type_counts

OUTSIDE = "Outside this publication"


def scope_types(types: DataFrame, rows: DataFrame, scoped: DataFrame, excluded: tuple[str, ...] = ()) -> DataFrame:
    """(type_id, name, n, excluded, empty, applicable) of every type: its records in the scope, if excluded those of the model."""
    every = type_counts(types, rows)
    within = scoped.groupBy("type_id").agg(F.count(F.lit(1)).alias("__scoped"))
    out = F.col("type_id").isin(*excluded) if excluded else F.lit(False)
    met = every.join(within, "type_id", "left").withColumn("excluded", out)
    met = met.withColumn("n", F.when(F.col("excluded"), F.col("n")).otherwise(F.coalesce("__scoped", F.lit(0))))
    empty = ~F.col("excluded") & (F.col("n") == 0)
    return met.select("type_id", "name", "n", "excluded", empty.alias("empty"), (~empty).alias("applicable"))


def select_all(types: DataFrame) -> DataFrame:
    """(checked, indeterminate, disabled): the state of an "all" selector over the applicable types."""
    n, out = F.count_if("applicable"), F.count_if(F.col("applicable") & F.col("excluded"))
    return types.agg(((n > 0) & (out == 0)).alias("checked"), ((out > 0) & (out < n)).alias("indeterminate"), (n == 0).alias("disabled"))


def summary(model: Dataset, published: Dataset) -> DataFrame:
    """(objects, relationships, total_objects, total_relationships), one row."""
    parts = {"objects": published.objects, "relationships": published.relationships, "total_objects": model.objects, "total_relationships": model.relationships}
    one = None
    for name, rows in parts.items():
        n = rows.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("part"), "n")
        one = n if one is None else one.unionByName(n)
    return one.agg(*[F.max(F.when(F.col("part") == name, F.col("n"))).alias(name) for name in parts])


def named_objects(dataset: Dataset, ids: DataFrame) -> DataFrame:
    """(id, name, type_name) of those of the objects that exist."""
    rows = dataset.objects.join(ids.select("id").distinct(), "id", "left_semi")
    return rows.join(dataset.object_types.select(F.col("id").alias("type_id"), F.col("name").alias("type_name")), "type_id").select("id", "name", "type_name")


def published_provenance(dataset: Dataset, changes: DataFrame, proposals: DataFrame, results: DataFrame) -> DataFrame:
    """Provenance of the published records only. Ends of created edges are named where they are published, else ``OUTSIDE``."""
    ids = dataset.objects.select(F.lit("object").alias("target_type"), F.col("id").alias("target_id")).unionByName(dataset.relationships.select(F.lit("relationship").alias("target_type"), F.col("id").alias("target_id")))
    rows = provenance.entries(changes.join(ids, ["target_type", "target_id"], "left_semi"), proposals, results)
    names = dataset.objects.select("id", "name")
    for end in ("source", "target"):
        own = F.when(F.col("kind") == "created", F.get_json_object("after_json", f"$.{end}_id"))
        named = names.select(F.col("id").alias("__end"), F.col("name").alias("__name"))
        rows = rows.withColumn("__own", own).join(named, F.col("__own") == F.col("__end"), "left")
        rows = rows.withColumn(f"{end}_name", F.when(F.col("__own").isNotNull(), F.coalesce("__name", F.lit(OUTSIDE)))).drop("__own", "__end", "__name")
    return rows


@dataclass(frozen=True)
class Opening:
    """The record that a publication opens at, and what of the request could not be kept."""

    kind: str | None
    id: str | None
    dropped: tuple[str, ...]


def opening(selection: object, published: Dataset) -> Opening:
    """A requested selection ({kind, id}) held against what is published: one lookup by id."""
    if not isinstance(selection, dict):
        return Opening(None, None, ())
    table = {"object": published.objects, "relationship": published.relationships}.get(selection.get("kind"))
    wanted = selection.get("id")
    if table is None or not isinstance(wanted, str) or table.where(F.col("id") == wanted).isEmpty():
        return Opening(None, None, ("selection",))
    return Opening(selection["kind"], wanted, ())
