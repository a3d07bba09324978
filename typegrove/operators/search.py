"""Ranked search over names and attributes, in one scan: each row is judged on its own, the best rows come from a top-k."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import fold, fold_each, snippet
from ..schema import Dataset

#: Fixed tiers, best first.
NAME_EXACT, NAME_PREFIX, NAME_CONTAINS, ATTRIBUTE_EXACT, ATTRIBUTE_CONTAINS = range(5)
LIMIT = 25


def search_fields(dataset: Dataset) -> DataFrame:
    """Objects with ``fields``: array of struct(ord, label, text); the name first, then populated attributes in order.

    Boolean attributes are not searched. Definitions are few and grouped by type; objects meet their type's list once.
    """
    d = dataset.attribute_defs.where("owner_kind = 'object' and is_active and data_type <> 'boolean'")
    d = d.groupBy(F.col("owner_id").alias("type_id")).agg(F.array_sort(F.collect_list(F.struct("sort_order", "key", "name"))).alias("__defs"))
    rows = dataset.objects.join(d, "type_id", "left")
    none = F.array().cast("array<struct<ord:int,label:string,text:string>>")
    own = F.transform("__defs", lambda x, i: F.struct((i + 1).alias("ord"), x["name"].alias("label"), F.element_at("attributes", x["key"]).alias("text")))
    own = F.filter(own, lambda x: F.coalesce(F.regexp_replace(x["text"], r"(?U)\s", ""), F.lit("")) != "")
    name = F.array(F.struct(F.lit(0).alias("ord"), F.lit("Name").alias("label"), F.col("name").alias("text")))
    return rows.withColumn("fields", F.concat(name, F.coalesce(own, none))).drop("__defs")


def _tier(folded: Column, ord_: Column, needle: str) -> Column:
    n = F.lit(needle)
    is_name = ord_ == 0
    return (
        F.when(is_name & (folded == n), NAME_EXACT)
        .when(is_name & F.startswith(folded, n), NAME_PREFIX)
        .when(is_name & F.contains(folded, n), NAME_CONTAINS)
        .when(folded == n, ATTRIBUTE_EXACT)
        .when(F.contains(folded, n), ATTRIBUTE_CONTAINS)
    )


def matches(dataset: Dataset, query: str, exact: bool = False) -> DataFrame:
    """All objects that match, with tier, label and text of the best field (of equal ones the first), and a subtitle."""
    needle = " ".join(query.split())
    needle = needle.casefold() if exact else needle.lower()
    rows = search_fields(dataset)
    if not needle:
        return rows.where("false").select("id", "type_id", "name", F.lit(0).alias("tier"), F.lit("").alias("label"), F.lit("").alias("text"), F.lit("").alias("subtitle"))
    subtitle = F.get("fields", F.lit(1))["text"]
    if exact:  # in Arrow batches, all fields of a record at once
        rows = rows.withColumn("__folded", fold_each(F.transform("fields", lambda x: x["text"])))
        scored = F.transform("fields", lambda x, i: F.struct(_tier(F.get("__folded", i), x["ord"], needle).alias("tier"), x["ord"].alias("ord"), x["label"].alias("label"), x["text"].alias("text")))
    else:
        scored = F.transform("fields", lambda x: F.struct(_tier(F.lower(x["text"]), x["ord"], needle).alias("tier"), x["ord"].alias("ord"), x["label"].alias("label"), x["text"].alias("text")))
    best = F.array_min(F.filter(scored, lambda x: x["tier"].isNotNull()))
    rows = rows.withColumn("best", best).where("best is not null")
    return rows.select("id", "type_id", "name", "best.tier", "best.label", snippet(F.col("best.text")).alias("text"), snippet(subtitle).alias("subtitle"))


def search(dataset: Dataset, query: str, limit: int = LIMIT, exact: bool = False) -> DataFrame:
    """The best ``limit`` matches by tier, folded name and id."""
    return matches(dataset, query, exact).orderBy("tier", fold(F.col("name"), exact), "id").limit(limit)


def total(dataset: Dataset, query: str, exact: bool = False) -> DataFrame:
    return matches(dataset, query, exact).agg(F.count(F.lit(1)).alias("total"))
