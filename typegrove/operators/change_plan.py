"""Change plans: proposed creates, updates and deletes that name new records by tokens, checked and compiled into changes.

Operations are rows (n, operation, target_type, ref_kind, ref, parent_type, parent_ref_kind, parent_ref, fields map):
ref_kind is ``new`` for a token of the plan or ``existing`` for an id. Checks are semi- and anti-joins against the
dataset's ids and the plan's own tokens.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schema import Dataset

OPERATIONS = "n int, operation string, target_type string, ref_kind string, ref string, parent_type string, parent_ref_kind string, parent_ref string, fields map<string,string>"
KINDS = ("object", "relationship", "object_type", "relationship_type", "attribute_definition", "relationship_type_rule")
#: Fields that name another record, as an id or as ``new:`` and a token, and what they name.
REFERENCES = {"source": "object", "target": "object", "subject_type_id": "object_type", "object_type_id": "object_type"}
#: Fields of a created record that are taken as they are.
PLAIN = ("name", "key", "description", "is_active", "sort_order", "data_type", "required", "nullable", "min_length", "max_length", "least", "most", "s_min", "s_max", "o_min", "o_max")


def known_ids(dataset: Dataset) -> DataFrame:
    parts = [("object", dataset.objects), ("relationship", dataset.relationships), ("object_type", dataset.object_types), ("relationship_type", dataset.relationship_types), ("attribute_definition", dataset.attribute_defs), ("relationship_type_rule", dataset.rules)]
    out = None
    for kind, df in parts:
        one = df.select(F.lit(kind).alias("target_type"), F.col("id").alias("ref"))
        out = one if out is None else out.unionByName(one)
    return out


def problems(plan: DataFrame, dataset: Dataset) -> DataFrame:
    """(code, n, ref): what keeps a plan from being compiled."""
    say = lambda df, code: df.select(F.lit(code).alias("code"), "n", "ref")
    tokens = plan.where("operation = 'create' and ref_kind = 'new'").select("target_type", "ref")
    once = tokens.groupBy("ref").agg(F.count(F.lit(1)).alias("times"))
    ids = known_ids(dataset)
    existing = plan.where("ref_kind = 'existing'").select("n", "target_type", "ref")
    refs = plan.where("parent_ref is not null").select("n", F.col("parent_type").alias("target_type"), F.col("parent_ref_kind").alias("ref_kind"), F.col("parent_ref").alias("ref"))
    named = F.explode(F.array(*[F.struct(F.lit(kind).alias("target_type"), F.element_at("fields", F.lit(field)).alias("ref")) for field, kind in REFERENCES.items()]))
    ends = plan.where("operation = 'create' and target_type in ('relationship', 'relationship_type_rule')").select("n", named.alias("x")).select("n", "x.*").where("ref is not null")
    ends = ends.withColumn("ref_kind", F.when(F.startswith("ref", F.lit("new:")), "new").otherwise("existing")).withColumn("ref", F.regexp_replace("ref", "^new:", ""))
    every = refs.unionByName(ends.select(*refs.columns))
    fields = plan.where("operation = 'update'")
    return (
        say(plan.where(~F.col("target_type").isin(*KINDS)), "unknown_target_type")
        .unionByName(say(plan.where("operation = 'create' and ref_kind <> 'new'"), "create_needs_a_token"))
        .unionByName(say(plan.where("operation in ('update', 'delete') and ref_kind <> 'existing'"), "needs_an_existing_record"))
        .unionByName(say(plan.where("operation not in ('create', 'update', 'delete')"), "unknown_operation"))
        .unionByName(say(plan.join(once.where("times > 1"), "ref", "left_semi").where("operation = 'create'"), "token_used_twice"))
        .unionByName(say(existing.join(ids, ["target_type", "ref"], "left_anti"), "unknown_record"))
        .unionByName(say(every.where("ref_kind = 'existing'").join(ids, ["target_type", "ref"], "left_anti"), "unknown_reference"))
        .unionByName(say(every.where("ref_kind = 'new'").join(tokens, ["target_type", "ref"], "left_anti"), "dangling_token"))
        .unionByName(say(fields.where(F.coalesce(F.size("fields"), F.lit(0)) < 1), "nothing_to_change"))
        .unionByName(say(plan.where("operation = 'create' and target_type = 'object' and parent_ref is null"), "parent_required"))
    )


def compiled(plan: DataFrame, proposal_id: str) -> DataFrame:
    """Change rows: an id for each token, one row per updated field, in the plan's order. Ids come from the proposal and token."""
    minted = lambda kind, ref: F.when(kind == "new", F.concat(F.lit("n"), F.left(F.sha2(F.concat_ws("/", F.lit(proposal_id), ref), 256), F.lit(31)))).otherwise(ref)
    end = lambda name: minted(F.when(F.startswith(F.element_at("fields", F.lit(name)), F.lit("new:")), "new").otherwise("existing"), F.regexp_replace(F.element_at("fields", F.lit(name)), "^new:", ""))
    base = plan.withColumns({"target_id": minted(F.col("ref_kind"), F.col("ref")), "parent_id": minted(F.col("parent_ref_kind"), F.col("parent_ref"))})
    attributes = F.map_from_entries(F.transform(F.map_entries(F.map_filter("fields", lambda k, v: F.startswith(k, F.lit("attributes.")))), lambda e: F.struct(F.substring(e["key"], 12, 1000).alias("key"), e["value"].alias("value"))))
    plain = [F.element_at("fields", F.lit(f)).alias(f) for f in PLAIN]
    choices = F.from_json(F.element_at("fields", F.lit("choices")), "array<string>").alias("choices")
    ends = [end(f).alias({"source": "source_id", "target": "target_id"}.get(f, f)) for f in REFERENCES]
    payload = F.to_json(F.struct(*plain, choices, *ends, attributes.alias("attributes")))
    creates = base.where("operation = 'create'").withColumns({"after_json": payload, "sub": F.lit(0)})
    updates = base.where("operation = 'update'").select("*", F.posexplode(F.array_sort(F.map_entries("fields"))).alias("sub", "e"))
    updates = updates.withColumn("after_json", F.to_json(F.struct(F.col("e.key").alias("field"), F.col("e.value").alias("value")), {"ignoreNullFields": "false"})).drop("e")
    deletes = base.where("operation = 'delete'").withColumns({"after_json": F.lit(None).cast("string"), "sub": F.lit(0)})
    rows = creates.unionByName(updates).unionByName(deletes)
    seq = F.col("n").cast("long") * 1000 + F.col("sub")
    return rows.select(
        F.concat_ws(":", F.lit(proposal_id), seq.cast("string")).alias("id"), F.lit(proposal_id).alias("proposal_id"), seq.alias("seq"), "operation", "target_type", "target_id", "parent_type", "parent_id",
        F.lit(None).cast("string").alias("before_json"), "after_json",
    )


def import_changes(changes: DataFrame, proposal_id: str, type_id: str, source: str) -> tuple[DataFrame, DataFrame]:
    """Change and evidence rows of an object import plan: a create per new identity, an update per changed field.

    changes: operation, identity, field, old, new, first_row, as ``importing.plan_objects`` gives them.
    """
    mint = F.when(F.col("operation") == "create", F.concat(F.lit("n"), F.left(F.sha2(F.concat_ws("/", F.lit(proposal_id), "identity"), 256), F.lit(31)))).otherwise(F.col("identity"))
    rows = changes.withColumn("target_id", mint)
    entry = F.when(F.startswith("field", F.lit("attributes.")), F.struct(F.substring("field", 12, 1000).alias("key"), F.col("new").alias("value")))
    name = F.max(F.when(F.col("field") == "name", F.col("new")))
    creates = rows.where("operation = 'create'").groupBy("operation", "target_id").agg(name.alias("name"), F.collect_list(entry).alias("entries"), F.min("first_row").alias("first_row"))
    creates = creates.select("operation", "target_id", "first_row", F.lit("").alias("field"), F.to_json(F.struct("name", F.map_from_entries("entries").alias("attributes"))).alias("after_json"), F.lit(None).cast("string").alias("before_json"))
    json = lambda v: F.to_json(F.struct("field", F.col(v).alias("value")), {"ignoreNullFields": "false"})
    updates = rows.where("operation = 'update'").select("operation", "target_id", "first_row", "field", json("new").alias("after_json"), json("old").alias("before_json"))
    every = creates.unionByName(updates).withColumn("id", F.concat_ws(":", F.lit(proposal_id), "target_id", "field"))
    out = every.select(
        "id", F.lit(proposal_id).alias("proposal_id"), F.col("first_row").cast("long").alias("seq"), "operation", F.lit("object").alias("target_type"), "target_id",
        F.when(F.col("operation") == "create", "object_type").alias("parent_type"), F.when(F.col("operation") == "create", F.lit(type_id)).alias("parent_id"), "before_json", "after_json",
    )
    evidence = every.select(F.col("id").alias("change_id"), F.lit(source).alias("source"), F.concat(F.lit("row "), F.col("first_row").cast("string")).alias("locator"), F.lit("").alias("note"))
    return out, evidence
