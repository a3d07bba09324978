"""The effective dataset: canonical rows with a change log laid over them.

The log is reduced once, by target and field, to the last value in ``seq`` order, held in a struct so that a null is a
value. The reduction is a partial aggregate before its shuffle, so a target changed very often costs no more than one
changed once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ATTRIBUTE = "attributes."


def update_payload(changes: DataFrame) -> DataFrame:
    """UPDATE rows as (target_id, field, value, seq). A payload counts only if it has the key ``value``, null or not."""
    rows = changes.where("operation = 'update'")
    has_value = F.array_contains(F.json_object_keys("after_json"), "value")
    rows = rows.where(F.coalesce(has_value, F.lit(False)))
    return rows.select("target_id", F.get_json_object("after_json", "$.field").alias("field"), F.get_json_object("after_json", "$.value").alias("value"), "seq").where("field is not null")


def last_values(updates: DataFrame) -> DataFrame:
    """(target_id, field, value): the last update of each field; the latest seq wins, also if it sets null."""
    out = updates.groupBy("target_id", "field").agg(F.max_by(F.struct("value"), "seq").alias("last"))
    return out.select("target_id", "field", F.col("last.value").alias("value"))


def overlay(rows: DataFrame, changes: DataFrame, target_type: str, fields: tuple[str, ...] = ("name", "description"), honour_deletes: bool = True) -> DataFrame:
    """Canonical ``rows`` under the log's changes of one kind of target: deletes, creates, then last values per field.

    A created record that is canonical already is not added again; one without a parent is dropped. Inactive records go
    only at the end, for a change may reactivate one. Adds ``is_proposed``: the log touches the record.
    """
    own = changes.where(F.col("target_type") == target_type)
    touched = own.select("target_id").distinct().withColumnRenamed("target_id", "id").withColumn("is_proposed", F.lit(True))
    base = rows
    if honour_deletes:
        gone = own.where("operation = 'delete'").select(F.col("target_id").alias("id"))
        base = base.join(gone, "id", "left_anti")
    created = created_rows(own, rows)
    base = base.unionByName(created.join(rows.select("id"), "id", "left_anti"), allowMissingColumns=True)
    last = last_values(update_payload(own))
    built_in = [F.max(F.when(F.col("field") == f, F.struct("value"))).alias(f"__{f}") for f in (*fields, "is_active")]
    entry = F.when(F.startswith("field", F.lit(ATTRIBUTE)), F.struct(F.substring("field", len(ATTRIBUTE) + 1, 1_000_000).alias("key"), F.col("value").alias("value")))
    per = last.groupBy(F.col("target_id").alias("id")).agg(*built_in, F.collect_list(entry).alias("__attributes"))
    out = base.join(per, "id", "left").join(touched, "id", "left")
    for f in fields:
        out = out.withColumn(f, F.when(F.col(f"__{f}").isNotNull(), F.col(f"__{f}.value")).otherwise(F.col(f)))
    out = out.withColumn("is_active", F.when(F.col("__is_active").isNotNull(), F.coalesce(F.col("__is_active.value") == "true", F.lit(False))).otherwise(F.col("is_active")))
    if "attributes" in rows.columns:
        out = out.withColumn("attributes", F.when(F.size("__attributes") > 0, merge_maps(F.col("attributes"), F.map_from_entries("__attributes"))).otherwise(F.col("attributes")))
    drop = [f"__{f}" for f in (*fields, "is_active")] + ["__attributes"]
    return out.drop(*drop).withColumn("is_proposed", F.coalesce("is_proposed", F.lit(False))).where("is_active")


def merge_maps(old: Column, new: Column) -> Column:
    """The new map's keys over the old one's."""
    empty = F.create_map().cast("map<string,string>")
    kept = F.map_filter(F.coalesce(old, empty), lambda k, v: ~F.map_contains_key(new, k))
    return F.map_concat(kept, new)


def created_rows(changes: DataFrame, like: DataFrame) -> DataFrame:
    """Rows of CREATE changes that have a parent and are not created inactive, in the columns of ``like`` they can fill."""
    rows = changes.where("operation = 'create' and parent_id is not null")
    get = lambda f: F.get_json_object("after_json", f"$.{f}")
    columns = {"id": F.col("target_id"), "type_id": F.col("parent_id"), "is_active": F.coalesce(get("is_active") != "false", F.lit(True))}
    for f in ("key", "name", "description", "source_id", "target_id"):
        if f in like.columns:
            columns[f] = get(f)
    if "attributes" in like.columns:
        columns["attributes"] = F.coalesce(F.from_json(get("attributes"), "map<string,string>"), F.create_map().cast("map<string,string>"))
    return rows.select(*[v.alias(k) for k, v in columns.items()]).where("is_active")


def effective_definitions(defs: DataFrame, changes: DataFrame) -> DataFrame:
    """Attribute definitions under the log: those active before it, changed by it; deletes there are not looked at."""
    return overlay(defs.where("is_active"), changes, "attribute_definition", ("name",), honour_deletes=False)


#: Columns that a change may set, by target type, and the columns that a created row takes its parent into.
STORED = {
    "object": ("name", "description", "is_active"),
    "relationship": ("source_id", "target_id", "is_active", "valid_from", "valid_to"),
    "object_type": ("name", "description", "is_active", "sort_order"),
    "relationship_type": ("name", "description", "is_active", "sort_order"),
    "attribute_definition": ("name", "data_type", "required", "nullable", "sort_order", "is_active", "min_length", "max_length", "least", "most", "choices"),
    "relationship_type_rule": ("subject_type_id", "object_type_id", "s_min", "s_max", "o_min", "o_max"),
}
PARENTS = {"object": "type_id", "relationship": "type_id", "attribute_definition": "owner_id", "relationship_type_rule": "rel_type_id"}


def typed(value: Column, kind: str) -> Column:
    """A payload's text as a column of the type holds it."""
    if kind == "boolean":
        return value == "true"
    if kind.startswith("array"):
        return F.from_json(value, kind)
    return value if kind == "string" else value.try_cast(kind)


def stored(rows: DataFrame, changes: DataFrame, target_type: str) -> DataFrame:
    """The table of one kind of target as a commit stores it: creates, then last values, then deletes.

    Inactive records stay, whether they were so, become so or are created so; a null sets a column to null. A created
    record that exists already is not added again; one without a parent, where its kind has parents, is dropped.
    """
    kinds = dict(rows.dtypes)
    own = changes.where(F.col("target_type") == target_type)
    get = lambda f: F.get_json_object("after_json", f"$.{f}")
    columns = {"id": F.col("target_id")}
    for f in (*STORED[target_type], "key"):
        if f in kinds:
            columns[f] = typed(get(f), kinds[f])
    if "is_active" in kinds:
        columns["is_active"] = F.coalesce(columns["is_active"], F.lit(True))
    made = own.where("operation = 'create'")
    if target_type in PARENTS:
        columns[PARENTS[target_type]] = F.col("parent_id")
        made = made.where("parent_id is not null")
    if "owner_kind" in kinds:
        columns["owner_kind"] = F.regexp_replace("parent_type", "_type$", "")
    for f in ("required", "nullable"):
        if f in kinds:
            columns[f] = F.coalesce(columns[f], F.lit(f == "nullable"))
    if "attributes" in kinds:
        columns["attributes"] = F.coalesce(F.from_json(get("attributes"), "map<string,string>"), F.create_map().cast("map<string,string>"))
    created = made.select(*[v.alias(k) for k, v in columns.items()]).dropDuplicates(["id"]).join(rows.select("id"), "id", "left_anti")
    base = rows.unionByName(created, allowMissingColumns=True)
    last = last_values(update_payload(own))
    fields = [f for f in STORED[target_type] if f in kinds]
    built_in = [F.max(F.when(F.col("field") == f, F.struct("value"))).alias(f"__{f}") for f in fields]
    entry = F.when(F.startswith("field", F.lit(ATTRIBUTE)), F.struct(F.substring("field", len(ATTRIBUTE) + 1, 1_000_000).alias("key"), F.col("value").alias("value")))
    out = base.join(last.groupBy(F.col("target_id").alias("id")).agg(*built_in, F.collect_list(entry).alias("__attributes")), "id", "left")
    for f in fields:
        out = out.withColumn(f, F.when(F.col(f"__{f}").isNotNull(), typed(F.col(f"__{f}.value"), kinds[f])).otherwise(F.col(f)))
    if "attributes" in kinds:
        out = out.withColumn("attributes", F.when(F.size("__attributes") > 0, merge_maps(F.col("attributes"), F.map_from_entries("__attributes"))).otherwise(F.col("attributes")))
    gone = own.where("operation = 'delete'").select(F.col("target_id").alias("id"))
    return out.select(*rows.columns).join(gone, "id", "left_anti").select(*rows.columns)
