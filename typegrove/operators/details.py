"""A record's details: incident edges with the records at their other ends, for one record or for many at once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schema import Dataset
from ..shared import Steps
from . import dataset as ds
from .numbering import places


def object_details(dataset: Dataset, ids: DataFrame | None = None, shown: DataFrame | None = None) -> DataFrame:
    """One row per incident edge of the objects in ``ids`` (column id); None: of all objects.

    ``in_view`` tells whether the other end is among the ``shown`` nodes. Only edges that touch ``ids`` are joined on.
    """
    types = dataset.relationship_types.select(F.col("id").alias("edge_type_id"), F.col("name").alias("edge_type_name"))
    if ids is None and shown is None:  # both ends of an edge meet it once, then each is told of the other
        e = ds.with_ends(dataset, "name")
        end = lambda own, other, direction: F.struct(F.col(f"{own}_id").alias("id"), F.col(f"{other}_id").alias("other_id"), F.lit(direction).alias("direction"), F.col(f"{other}_name").alias("other_name"), F.col(f"{other}_type").alias("other_type_id"))
        out, back = end("source", "target", "out"), end("target", "source", "in")
        ends = F.when(F.col("source_id") == F.col("target_id"), F.array(out)).otherwise(F.array(out, back))
        rows = e.select(F.col("id").alias("edge_id"), F.col("type_id").alias("edge_type_id"), F.explode(ends).alias("end"))
        return rows.select("end.id", "end.other_id", "edge_id", "edge_type_id", "end.direction", "end.other_name", "end.other_type_id").join(types, "edge_type_id").withColumn("in_view", F.lit(True))
    ids = dataset.objects if ids is None else ids
    near = ds.adjacency(dataset.relationships).join(ids.select("id"), "id", "left_semi")
    other = dataset.objects.select(F.col("id").alias("other_id"), F.col("name").alias("other_name"), F.col("type_id").alias("other_type_id"))
    out = near.join(other, "other_id").join(types, "edge_type_id")
    if shown is None:
        return out.withColumn("in_view", F.lit(True))
    seen = shown.select(F.col("id").alias("other_id"), F.lit(True).alias("__seen"))
    return out.join(seen, "other_id", "left").withColumn("in_view", F.coalesce("__seen", F.lit(False))).drop("__seen")


def grouped_details(details: DataFrame) -> DataFrame:
    """Per record, edge type and direction the other ends as rows, with their place by name and edge and the group's size.

    Rows, not a list a record. A hub's group lies in many ranges, each numbered after those before it, and its size is a sum of
    partial counts: no task has a whole group.
    """
    group = ["id", "edge_type_id", "edge_type_name", "direction"]
    return places(details, group, [F.lower("other_name"), F.col("edge_id")], "position", Steps(details.sparkSession, "details"), "n")


def all_grouped_details(dataset: Dataset) -> DataFrame:
    """``grouped_details`` of all objects, without names; by the source's own keys where the dataset has links."""
    if dataset.links is None:
        return grouped_details(object_details(dataset)).select("id", "edge_type_id", "direction", "other_id", "edge_id", "position", "n")
    types = {r["id"] for r in dataset.relationship_types.select("id").collect()}  # small by nature
    return dataset.links.grouped(types, Steps(dataset.relationship_types.sparkSession, "details"))


def hidden_counterparts(dataset: Dataset, ids: DataFrame, shown: DataFrame) -> DataFrame:
    """(id, other_id): neighbours of the records that a projection does not show."""
    near = ds.adjacency(dataset.relationships).join(ids.select("id"), "id", "left_semi").select("id", "other_id").distinct()
    return near.join(shown.select(F.col("id").alias("other_id")), "other_id", "left_anti").select("id", "other_id")


def relationship_details(dataset: Dataset, ids: DataFrame | None = None) -> DataFrame:
    """Edges with both ends' names and types, the fitting rule and, where edges have it, the time they are valid."""
    if ids is not None:
        dataset = dataset.with_(relationships=dataset.relationships.join(ids.select("id"), "id", "left_semi"))
    valid = [c for c in ("valid_from", "valid_to") if c in dataset.relationships.columns]
    return ds.rule_of_edges(dataset, *valid, ends=("name",))


def extract(details: DataFrame) -> DataFrame:
    """A text per record: one line per edge type with the names at the other ends. The text is as long as a record's names."""
    lines = details.groupBy("id", "edge_type_name").agg(F.array_join(F.array_sort(F.collect_list("other_name")), ", ").alias("names"))
    return lines.groupBy("id").agg(F.array_join(F.array_sort(F.collect_list(F.concat("edge_type_name", F.lit(": "), "names"))), "\n").alias("extract"))
