"""Bounded projections of a dataset: which objects and edges an explorer query shows, and how many it hides."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.query import Query
from ..schema import Dataset
from . import dataset as ds
from .predicates import passes


@dataclass(frozen=True)
class Projection:
    nodes: DataFrame
    edges: DataFrame
    summary: DataFrame


def _among(col: str, ids: tuple[str, ...]) -> Column:
    return F.col(col).isin(*ids) if ids else F.lit(False)


def statuses(objects: DataFrame, query: Query, exact: bool = False) -> DataFrame:
    """``objects`` with included and status: match, type (hidden by type) or filter (hidden by a filter).

    Inclusion outranks both; a hidden type outranks filters, so no object counts as hidden twice.
    """
    included = _among("id", query.include)
    status = F.when(included, "match").when(_among("type_id", query.hide_objects), "type").when(~passes(query.filters, exact), "filter").otherwise("match")
    return objects.withColumn("included", included).withColumn("status", status)


def order() -> list[Column]:
    return [F.col("included").desc(), F.col("degree").desc(), F.lower("name"), F.col("id")]


def shown_objects(dataset: Dataset, query: Query, exact: bool = False) -> DataFrame:
    """The objects that match, at most ``limit``: included ones first, then by degree, name and id.

    Degree is over all edges of the dataset: counted once, by partial sums, and joined to what matches. The top rows come
    from a partial sort per task, not a full one.
    """
    rows = statuses(dataset.objects, query, exact).where("status = 'match'")
    rows = ds.with_degree(rows, dataset.relationships)
    return rows.orderBy(*order()).limit(query.limit).drop("status")


def shown_edges(dataset: Dataset, query: Query, nodes: DataFrame) -> DataFrame:
    """Edges of shown types between shown objects. Hiding an edge type leaves its ends."""
    ids = nodes.select("id")
    rows = dataset.relationships.where(~_among("type_id", query.hide_relationships))
    rows = rows.join(ids.withColumnRenamed("id", "source_id"), "source_id", "left_semi")
    return rows.join(ids.withColumnRenamed("id", "target_id"), "target_id", "left_semi")


def summary(dataset: Dataset, query: Query, exact: bool = False) -> DataFrame:
    """One row of counts from one scan of the objects."""
    rows = statuses(dataset.objects, query, exact)
    n = lambda c: F.coalesce(F.sum(F.when(c, 1).otherwise(0)), F.lit(0)).cast("long")
    out = rows.agg(
        F.count(F.lit(1)).alias("total"),
        n(F.col("status") == "match").alias("matching"),
        n(F.col("status") == "type").alias("hidden_by_object_type"),
        n(F.col("status") == "filter").alias("hidden_by_filter"),
        n(F.col("included")).alias("included"),
    )
    return out.withColumn("shown", F.least("matching", F.lit(query.limit).cast("long"))).withColumn("truncated", F.col("matching") > query.limit)


def project(dataset: Dataset, query: Query, exact: bool = False) -> Projection:
    nodes = shown_objects(dataset, query, exact)
    return Projection(nodes, shown_edges(dataset, query, nodes), summary(dataset, query, exact))


def populated_attributes(rows: DataFrame, defs: DataFrame) -> DataFrame:
    """(id, position, key, name, value) of populated defined attributes, in the definitions' order."""
    d = defs.where("is_active").select(F.col("owner_id").alias("type_id"), "key", F.col("name").alias("label"), "sort_order", "data_type")
    out = rows.select("id", "type_id", "attributes").join(d, "type_id").withColumn("value", F.element_at("attributes", F.col("key")))
    return out.where(~F.coalesce(F.regexp_replace("value", r"(?U)\s", ""), F.lit("")).eqNullSafe("")).select("id", "type_id", "sort_order", "key", "label", "data_type", "value")


def compile_nodes(nodes: DataFrame, dataset: Dataset, styles: DataFrame | None = None) -> DataFrame:
    """Viewer rows: type key and label, populated attributes, and the type's colour where a style table is given."""
    types = dataset.object_types.select(F.col("id").alias("type_id"), F.col("key").alias("type_key"), F.col("name").alias("type_name"))
    attributes = populated_attributes(nodes, dataset.attribute_defs.where("owner_kind = 'object'"))
    attributes = attributes.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("sort_order", "key", "label", "value"))).alias("populated"))
    out = nodes.join(types, "type_id").join(attributes, "id", "left")
    if styles is not None:
        out = out.join(styles.select(F.col("type_id"), F.col("color")), "type_id", "left")
    return out


def compile_edges(edges: DataFrame, dataset: Dataset) -> DataFrame:
    types = dataset.relationship_types.select(F.col("id").alias("type_id"), F.col("key").alias("type_key"), F.col("name").alias("type_name"))
    return edges.join(types, "type_id")


def ontology_graph(dataset: Dataset) -> tuple[DataFrame, DataFrame]:
    """Active object types as nodes; rules between active types as edges."""
    nodes = dataset.object_types.where("is_active").select("id", "key", "name")
    active = dataset.relationship_types.where("is_active").select(F.col("id").alias("rel_type_id"), F.col("name").alias("label"))
    ids = nodes.select("id")
    edges = dataset.rules.join(active, "rel_type_id").join(ids.withColumnRenamed("id", "subject_type_id"), "subject_type_id", "left_semi")
    return nodes, edges.join(ids.withColumnRenamed("id", "object_type_id"), "object_type_id", "left_semi")


def published_attributes(rows: DataFrame, defs: DataFrame) -> DataFrame:
    """``rows`` with only defined, populated attributes; whole numbers of number attributes lose their fraction."""
    d = defs.where("is_active").groupBy(F.col("owner_id").alias("type_id")).agg(F.map_from_entries(F.collect_list(F.struct("key", "data_type"))).alias("__defs"))
    out = rows.join(d, "type_id", "left")
    empty = F.create_map().cast("map<string,string>")
    kept = F.map_filter("attributes", lambda k, v: F.map_contains_key(F.coalesce("__defs", empty), k) & (F.coalesce(F.regexp_replace(v, r"(?U)\s", ""), F.lit("")) != ""))
    cleaned = F.transform_values(kept, lambda k, v: F.when(F.element_at("__defs", k) == "number", F.regexp_replace(v, r"^(-?[0-9]+)\.0$", "$1")).otherwise(v))
    return out.withColumn("attributes", cleaned).drop("__defs")
