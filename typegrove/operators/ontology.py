"""Reads of an ontology: endpoint types of relationship types, counts per type, display order, and an index's columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..schema import Dataset
from .overlay import stored


def endpoint_pairs(dataset: Dataset) -> DataFrame:
    """(rel_type_id, subject_type_id, object_type_id, subject_name, object_name): the pairs that rules allow, each once."""
    names = dataset.object_types.select("id", "name")
    out = dataset.rules.select("rel_type_id", "subject_type_id", "object_type_id").distinct()
    for side in ("subject", "object"):
        out = out.join(names.select(F.col("id").alias(f"{side}_type_id"), F.col("name").alias(f"{side}_name")), f"{side}_type_id")
    return out


def endpoint_types(dataset: Dataset) -> DataFrame:
    """(rel_type_id, side, type_id, name): every type seen on either side; not every combination of them is allowed."""
    sides = F.explode(F.array(*[F.struct(F.lit(s).alias("side"), F.col(f"{s}_type_id").alias("type_id"), F.col(f"{s}_name").alias("name")) for s in ("subject", "object")]))
    return endpoint_pairs(dataset).select("rel_type_id", sides.alias("x")).select("rel_type_id", "x.*").distinct()


def _counted(types: DataFrame, rows: DataFrame, owner: str) -> DataFrame:
    n = rows.groupBy(F.col(owner).alias("id")).agg(F.count(F.lit(1)).alias("n"))
    return types.select("id").join(n, "id", "left").select("id", F.coalesce("n", F.lit(0)).alias("n"))


def attribute_counts(dataset: Dataset, changes: DataFrame, kind: str = "object") -> DataFrame:
    """(id, n): active definitions of each type under the log, proposed types and definitions included."""
    types = stored(dataset.object_types if kind == "object" else dataset.relationship_types, changes, f"{kind}_type")
    defs = stored(dataset.attribute_defs, changes, "attribute_definition")
    return _counted(types, defs.where(F.col("is_active") & (F.col("owner_kind") == kind)), "owner_id")


def rule_counts(dataset: Dataset, changes: DataFrame) -> DataFrame:
    """(id, n): rules of each relationship type under the log."""
    return _counted(stored(dataset.relationship_types, changes, "relationship_type"), stored(dataset.rules, changes, "relationship_type_rule"), "rel_type_id")


def ordered_types(types: DataFrame) -> DataFrame:
    return types.orderBy("sort_order", F.lower("name"), "id")


def ordered_definitions(defs: DataFrame) -> DataFrame:
    return defs.orderBy("owner_kind", "owner_id", "sort_order", "name", "id")


def index_columns(rows: DataFrame, defs: DataFrame, most: int = 3) -> DataFrame:
    """Records with ``columns``: array of (key, value) of the first active definitions of their type, in display order."""
    own = Window.partitionBy("owner_id").orderBy("sort_order", "name", "id")
    first = defs.where("owner_kind = 'object' and is_active").withColumn("rank", F.row_number().over(own)).where(F.col("rank") <= most)
    keys = first.groupBy(F.col("owner_id").alias("type_id")).agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "key"))), lambda x: x["key"]).alias("__keys"))
    out = rows.join(keys, "type_id", "left").withColumn("__keys", F.coalesce("__keys", F.array().cast("array<string>")))
    return out.withColumn("columns", F.transform("__keys", lambda k: F.struct(k.alias("key"), F.element_at("attributes", k).alias("value")))).drop("__keys")
