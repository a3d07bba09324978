"""Counts per type and per choice, zero-filled, over the unfiltered dataset."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schema import Dataset


def type_counts(types: DataFrame, rows: DataFrame) -> DataFrame:
    """(type_id, key, name, n): every type, 0 for those without records."""
    n = rows.groupBy("type_id").agg(F.count(F.lit(1)).alias("n"))
    out = types.select(F.col("id").alias("type_id"), "key", "name").join(n, "type_id", "left")
    return out.select("type_id", "key", "name", F.coalesce("n", F.lit(0)).alias("n"))


def choice_counts(dataset: Dataset) -> DataFrame:
    """(type_id, attribute, choice, n): every configured choice by exact text; other values are not counted."""
    d = dataset.attribute_defs.where("owner_kind = 'object' and is_active and data_type = 'choice'")
    choices = d.select(F.col("owner_id").alias("type_id"), F.col("key").alias("attribute"), F.explode("choices").alias("choice"))
    return _value_counts(dataset, choices, F.element_at("attributes", F.col("attribute")))


def boolean_counts(dataset: Dataset) -> DataFrame:
    d = dataset.attribute_defs.where("owner_kind = 'object' and is_active and data_type = 'boolean'")
    choices = d.select(F.col("owner_id").alias("type_id"), F.col("key").alias("attribute"), F.explode(F.array(F.lit("true"), F.lit("false"))).alias("choice"))
    return _value_counts(dataset, choices, F.lower(F.element_at("attributes", F.col("attribute"))))


def _value_counts(dataset: Dataset, choices: DataFrame, value) -> DataFrame:
    asked = choices.select("type_id", "attribute").distinct()
    n = dataset.objects.join(asked, "type_id").select("type_id", "attribute", value.alias("choice")).where("choice is not null")
    n = n.groupBy("type_id", "attribute", "choice").agg(F.count(F.lit(1)).alias("n"))
    out = choices.join(n, ["type_id", "attribute", "choice"], "left")
    return out.select("type_id", "attribute", "choice", F.coalesce("n", F.lit(0)).alias("n"))


def facets(dataset: Dataset) -> DataFrame:
    """All facets as rows (facet, type_id, attribute, choice, n)."""
    objects = type_counts(dataset.object_types, dataset.objects).select(F.lit("object_type").alias("facet"), "type_id", F.lit("").alias("attribute"), F.lit("").alias("choice"), "n")
    edges = type_counts(dataset.relationship_types, dataset.relationships).select(F.lit("relationship_type").alias("facet"), "type_id", F.lit("").alias("attribute"), F.lit("").alias("choice"), "n")
    choice = choice_counts(dataset).select(F.lit("choice").alias("facet"), "type_id", "attribute", "choice", "n")
    boolean = boolean_counts(dataset).select(F.lit("boolean").alias("facet"), "type_id", "attribute", "choice", "n")
    return objects.unionByName(edges).unionByName(choice).unionByName(boolean)


def legend(rows: DataFrame, color: str = "color", value: str = "value") -> DataFrame:
    """(color, value, items, of_color): rendered items by colour and attribute value, and those of the colour in all.

    A row a value, not a list a colour: the fallback colour may have any number of values.
    """
    per = rows.groupBy(color, value).agg(F.count(F.lit(1)).alias("items"))
    every = per.groupBy(F.col(color).alias("__color")).agg(F.sum("items").alias("of_color"))
    return per.join(every, F.col(color).eqNullSafe(F.col("__color"))).drop("__color")


def mixed_values(rows: DataFrame, keys: list[str]) -> DataFrame:
    """(key, mixed, value): over a selection, whether an attribute has more than one value (absent is one), and the one it has."""
    long = rows.select(F.explode(F.array(*[F.struct(F.lit(k).alias("key"), F.element_at("attributes", F.lit(k)).alias("value")) for k in keys])).alias("x")).select("x.*")
    per = long.groupBy("key").agg(F.countDistinct("value").alias("values"), F.max(F.when(F.col("value").isNull(), 1).otherwise(0)).alias("absent"), F.max("value").alias("value"))
    mixed = F.col("values") + F.col("absent") > 1
    return per.select("key", mixed.alias("mixed"), F.when(~mixed, F.col("value")).alias("value"))


def record_counts(rows: DataFrame) -> DataFrame:
    """All records per type, active or not."""
    return rows.groupBy("type_id").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("is_active")).alias("active"))
