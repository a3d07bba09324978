"""Whole-model validation: every rule gives issue rows (code, message, field, target_type, target_id).

Rules are joins and predicates over active records; an aggregate is needed for cardinality and duplicates only. Nothing
is collected: the union of all issues is one DataFrame.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import is_blank, is_slug
from ..functions.values import DATA_TYPES, date_of, datetime_of
from ..schema import Dataset

MOST_NAME = 255


def issues(rows: DataFrame, code: str, message: Column | str, target_type: Column | str, field: Column | str | None = None, target: str = "id") -> DataFrame:
    lit = lambda x: x if isinstance(x, Column) else F.lit(x).cast("string")
    return rows.select(F.lit(code).alias("code"), lit(message).alias("message"), lit(field).alias("field"), lit(target_type).alias("target_type"), F.col(target).alias("target_id"))


def union(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def _kinds(rows: DataFrame) -> DataFrame:
    """Rows without a ``kinds`` map hold texts: kinds are then read off the declared type's form."""
    return rows if "kinds" in rows.columns else rows.withColumn("kinds", F.lit(None).cast("map<string,string>"))


def attribute_pairs(rows: DataFrame, defs: DataFrame) -> DataFrame:
    """Each record with each definition of its type: value, present, kind and the definition's columns."""
    d = defs.select(F.col("owner_id").alias("type_id"), F.col("key").alias("attribute"), "data_type", "required", "nullable", "min_length", "max_length", "least", "most", "choices")
    out = _kinds(rows).join(d, "type_id")
    value = F.element_at("attributes", F.col("attribute"))
    n = value.try_cast("double")
    guess = F.when(value.isNull(), "null").when((F.col("data_type") == "number") & n.isNotNull(), "number").when((F.col("data_type") == "boolean") & F.lower(value).isin("true", "false"), "boolean").otherwise("string")
    kind = F.coalesce(F.element_at("kinds", F.col("attribute")), guess)
    return out.select("id", "attribute", "data_type", "required", "nullable", "min_length", "max_length", "least", "most", "choices", value.alias("value"), F.map_contains_key("attributes", F.col("attribute")).alias("present"), kind.alias("kind"))


def fits() -> Column:
    """Whether a pair has no issue for certain; most have none. One case a pair, in generated code, which a list of all codes is not."""
    v, data_type, n = F.col("value"), F.col("data_type"), F.col("value").try_cast("double")
    wanted = F.when(data_type == "number", "number").when(data_type == "boolean", "boolean").otherwise("string")
    within = lambda x, low, high: F.coalesce(~(x < F.col(low)), F.lit(True)) & F.coalesce(~(x > F.col(high)), F.lit(True))
    return (
        F.when(~F.col("present"), ~F.col("required"))
        .when(v.isNull(), F.col("nullable"))
        .when(~data_type.isin(*DATA_TYPES) | (F.col("kind") != wanted), F.lit(False))
        .when(data_type == "text", within(F.char_length(v), "min_length", "max_length"))
        .when(data_type == "number", within(n, "least", "most"))
        .when(data_type == "date", date_of(v).isNotNull())
        .when(data_type == "datetime", datetime_of(v).isNotNull())
        .when(data_type == "choice", F.array_contains("choices", v))
        .otherwise(F.lit(True))
    )


def attribute_issues(rows: DataFrame, defs: DataFrame, target_type: str) -> DataFrame:
    """Unknown, missing, null, wrongly typed and out-of-range attributes. One pass over record x definition pairs."""
    known = defs.groupBy(F.col("owner_id").alias("type_id")).agg(F.collect_set("key").alias("__known"))
    extra = rows.join(known, "type_id", "left").select("id", F.explode(F.array_except(F.map_keys("attributes"), F.coalesce("__known", F.array().cast("array<string>")))).alias("attribute"))
    unknown = issues(extra, "unknown_attribute", F.concat(F.lit("Unknown attribute "), "attribute"), target_type, F.concat(F.lit("attributes."), F.col("attribute")))
    pairs = attribute_pairs(rows, defs)
    v, kind, data_type = F.col("value"), F.col("kind"), F.col("data_type")
    here = F.col("present") & v.isNotNull()
    n = v.try_cast("double")
    wanted = F.when(data_type == "number", "number").when(data_type == "boolean", "boolean").otherwise("string")
    typed = here & data_type.isin(*DATA_TYPES) & (kind == wanted)
    codes = [
        (F.col("required") & ~F.col("present"), "required_attribute"),
        (F.col("present") & v.isNull() & ~F.col("nullable"), "null_not_allowed"),
        (here & ~data_type.isin(*DATA_TYPES), "unsupported_attribute_type"),
        (here & data_type.isin(*DATA_TYPES) & (kind != wanted), "invalid_attribute_type"),
        (typed & (data_type == "text") & (F.char_length(v) < F.col("min_length")), "value_below_minimum"),
        (typed & (data_type == "text") & (F.char_length(v) > F.col("max_length")), "value_above_maximum"),
        (typed & (data_type == "number") & (n < F.col("least")), "value_below_minimum"),
        (typed & (data_type == "number") & (n > F.col("most")), "value_above_maximum"),
        (typed & (data_type == "date") & date_of(v).isNull(), "invalid_date"),
        (typed & (data_type == "datetime") & datetime_of(v).isNull(), "invalid_datetime"),
        (typed & (data_type == "choice") & ~F.array_contains(F.coalesce("choices", F.array().cast("array<string>")), v), "invalid_choice"),
    ]
    found = F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.lit(code)) for c, code in codes]))
    hit = pairs.where(~F.coalesce(fits(), F.lit(False))).select("id", "attribute", F.explode(found).alias("code"))
    rest = hit.select("code", F.concat(F.lit("Attribute "), "attribute", F.lit(": "), F.replace("code", F.lit("_"), F.lit(" "))).alias("message"), F.concat(F.lit("attributes."), "attribute").alias("field"), F.lit(target_type).alias("target_type"), F.col("id").alias("target_id"))
    return unknown.unionByName(rest)


def field_issues(rows: DataFrame, target_type: str) -> DataFrame:
    """Name and activity of a record; an edge has no name."""
    found = [issues(rows.where(F.col("is_active").isNull()), "invalid_is_active", "Active or not must be given", target_type, "is_active")]
    if "name" in rows.columns:
        found += [
            issues(rows.where(is_blank(F.col("name"))), "name_required", "A name is required", target_type, "name"),
            issues(rows.where(F.char_length("name") > MOST_NAME), "name_too_long", f"The name is longer than {MOST_NAME}", target_type, "name"),
        ]
    return union(found)


def pair_issues(dataset: Dataset) -> DataFrame:
    """Active edges whose type allows no such pair of ends."""
    from .dataset import rule_of_edges

    edges = rule_of_edges(dataset, "is_active").where("is_active")
    return issues(edges.where("rule_id is null"), "invalid_relationship_types", "No rule allows this pair of types", "relationship")


def duplicate_keys(rows: DataFrame, target_type: str) -> DataFrame:
    """Records that share type and key."""
    twice = rows.where("key is not null").groupBy("type_id", "key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    return issues(rows.join(twice, ["type_id", "key"], "left_semi"), "duplicate_key", "The key is used twice", target_type, "key")


def structural_issues(dataset: Dataset) -> DataFrame:
    """Active definitions with a configuration their type does not have, and rules whose minimum exceeds the maximum."""
    d = dataset.attribute_defs.where("is_active")
    text = F.col("data_type") == "text"
    number = F.col("data_type") == "number"
    choice = F.col("data_type") == "choice"
    wrong = (
        ~F.col("owner_kind").isin("object", "relationship")
        | ~F.col("data_type").isin(*DATA_TYPES)
        | (~text & (F.col("min_length").isNotNull() | F.col("max_length").isNotNull()))
        | (~number & (F.col("least").isNotNull() | F.col("most").isNotNull()))
        | (choice & (F.coalesce(F.size("choices"), F.lit(0)) < 1))
        | (choice & (F.size(F.array_distinct("choices")) < F.size("choices")))
        | (~choice & F.col("choices").isNotNull())
        | F.coalesce(F.col("min_length") > F.col("max_length"), F.lit(False))
        | F.coalesce(F.col("least") > F.col("most"), F.lit(False))
        | ~is_slug(F.col("key"))
    )
    if "default_value" in d.columns:
        wrong = wrong | F.coalesce(~fits_default(), F.lit(False))
    r = dataset.rules.where("s_min > s_max or o_min > o_max or s_min < 0 or o_min < 0")
    return issues(d.where(wrong), "structural_invalid", "The definition does not fit its type", "attribute_definition").unionByName(issues(r, "structural_invalid", "Minimum above maximum", "relationship_type_rule"))


def fits_default() -> Column:
    """Whether a definition's default value, held as text, is a value that the definition allows; null where there is none."""
    v, kind, n = F.col("default_value"), F.col("data_type"), F.col("default_value").try_cast("double")
    bound = lambda value, low, high: F.coalesce(value >= F.col(low), F.lit(True)) & F.coalesce(value <= F.col(high), F.lit(True))
    fits = (
        F.when(kind == "text", bound(F.char_length(v), "min_length", "max_length"))
        .when(kind == "number", n.isNotNull() & bound(n, "least", "most"))
        .when(kind == "boolean", F.lower(v).isin("true", "false"))
        .when(kind == "choice", F.coalesce(F.array_contains("choices", v), F.lit(False)))
        .when(kind == "date", date_of(v).isNotNull())
        .when(kind == "datetime", datetime_of(v).isNotNull())
    )
    return F.when(v.isNotNull(), F.coalesce(fits, F.lit(False)))


def side_counts(edges: DataFrame) -> DataFrame:
    """(id, type_id, side, other_type, n): active edges of a type that a record has on one side, by the type of the other end.

    ``edges`` have their ends' types. Whatever rules there are, their counts are among these. Counting is partial before
    the shuffle, so a hub costs no more than another record.
    """
    side = F.explode(F.array(F.struct(F.col("source_id").alias("id"), F.lit("subject").alias("side"), F.col("target_type").alias("other_type")), F.struct(F.col("target_id").alias("id"), F.lit("object").alias("side"), F.col("source_type").alias("other_type"))))
    rows = edges.where("is_active").select("type_id", side.alias("x")).select("x.id", "type_id", "x.side", "x.other_type")
    return rows.groupBy("id", "type_id", "side", "other_type").agg(F.count(F.lit(1)).alias("n"))


def sides_of(dataset: Dataset) -> DataFrame:
    """``side_counts`` of a dataset's edges; by the source's own keys where it has links."""
    from .dataset import with_ends

    return dataset.links.side_counts() if dataset.links is not None else side_counts(with_ends(dataset))


def counts_by_rule(objects: DataFrame, rules: DataFrame, sides: DataFrame) -> DataFrame:
    """(rule_id, side, id, n, least, most) of every active object on either side of each rule, 0 where it has no edge."""
    r = rules.select(
        F.col("id").alias("rule_id"),
        F.col("rel_type_id"),
        F.explode(
            F.array(
                F.struct(F.lit("subject").alias("side"), F.col("subject_type_id").alias("type_id"), F.col("object_type_id").alias("other_type"), F.col("o_min").alias("least"), F.col("o_max").alias("most")),
                F.struct(F.lit("object").alias("side"), F.col("object_type_id").alias("type_id"), F.col("subject_type_id").alias("other_type"), F.col("s_min").alias("least"), F.col("s_max").alias("most")),
            )
        ).alias("x"),
    ).select("rule_id", "rel_type_id", "x.*")
    every = objects.where("is_active").select("id", "type_id").join(r, "type_id").drop("type_id")
    out = every.join(sides.withColumnRenamed("type_id", "rel_type_id"), ["id", "rel_type_id", "side", "other_type"], "left")
    return out.select("rule_id", "side", "id", F.coalesce("n", F.lit(0)).alias("n"), "least", "most")


def cardinality_counts(dataset: Dataset) -> DataFrame:
    """(rule_id, side, id, n, least, most) of every active object on either side of each rule, 0 where it has no edge.

    ``o_min``/``o_max`` bound the objects that each subject has, ``s_min``/``s_max`` the subjects of each object. Edges
    must be active and of the rule's types; their other end may be inactive.
    """
    return counts_by_rule(dataset.objects, dataset.rules, sides_of(dataset))


def cardinality_issues(dataset: Dataset) -> DataFrame:
    return out_of_bounds(cardinality_counts(dataset))


def out_of_bounds(c: DataFrame) -> DataFrame:
    """Issues of counts as ``counts_by_rule`` gives them."""
    low, high = F.col("n") < F.col("least"), F.col("most").isNotNull() & (F.col("n") > F.col("most"))
    name = F.when(F.col("side") == "subject", "object_cardinality").otherwise("subject_cardinality")
    code = F.when(low, F.concat(name, F.lit("_minimum"))).when(high, F.concat(name, F.lit("_maximum")))
    rows = c.withColumn("code", code).where("code is not null")
    return rows.select("code", F.concat(F.col("n").cast("string"), F.lit(" against "), F.col("least").cast("string"), F.lit(".."), F.coalesce(F.col("most").cast("string"), F.lit("*"))).alias("message"), F.col("rule_id").alias("field"), F.lit("object").alias("target_type"), F.col("id").alias("target_id"))


def model_mismatches(rows: DataFrame, types: DataFrame, target_type: str) -> DataFrame:
    """Records whose type belongs to another model (both tables with model_id)."""
    t = types.select(F.col("id").alias("type_id"), F.col("model_id").alias("type_model"))
    return issues(rows.join(t, "type_id").where("model_id <> type_model"), f"{target_type}_type_model_mismatch", "The type is of another model", target_type)


def end_mismatches(edges: DataFrame, objects: DataFrame) -> DataFrame:
    """Edges with a subject or an object of another model (both tables with model_id)."""
    o = objects.select(F.col("id").alias("end_id"), F.col("model_id").alias("end_model"))
    found = []
    for end, side in (("source_id", "subject"), ("target_id", "object")):
        rows = edges.join(o, F.col(end) == F.col("end_id")).where("model_id <> end_model")
        found.append(issues(rows, f"{side}_model_mismatch", f"The {side} is of another model", "relationship", side))
    return union(found)


def record_issues(dataset: Dataset, sides: DataFrame) -> list[DataFrame]:
    """Issues that a record's own row, its types and its edge counts (``sides``) decide: all but keys and the ontology's own.

    ``dataset`` may hold a part of the records. Attributes are held against all definitions, inactive ones included.
    """
    objects, edges = dataset.objects, dataset.relationships
    active, linked = objects.where("is_active"), edges.where("is_active")
    found = [
        field_issues(active, "object"),
        attribute_issues(active, dataset.attribute_defs.where("owner_kind = 'object'"), "object"),
        attribute_issues(linked, dataset.attribute_defs.where("owner_kind = 'relationship'"), "relationship"),
        pair_issues(dataset),
        out_of_bounds(counts_by_rule(active, dataset.rules, sides)),
    ]
    if "model_id" in objects.columns and "model_id" in dataset.object_types.columns:
        found.append(model_mismatches(active, dataset.object_types, "object"))
    if "model_id" in edges.columns and "model_id" in dataset.relationship_types.columns:
        found.append(model_mismatches(linked, dataset.relationship_types, "relationship"))
    return found


def validate(dataset: Dataset, sides: DataFrame | None = None) -> DataFrame:
    """All issues of active records, their keys and the ontology. ``sides``: the edges' ``side_counts``, where they are known."""
    sides = sides_of(dataset) if sides is None else sides
    found = [*record_issues(dataset, sides), duplicate_keys(dataset.objects.where("is_active"), "object"), structural_issues(dataset)]
    if "model_id" in dataset.objects.columns and "model_id" in dataset.relationships.columns:
        found.append(end_mismatches(dataset.relationships.where("is_active"), dataset.objects))
    return union(found)
