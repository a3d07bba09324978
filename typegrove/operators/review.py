"""Reviewing a change-set: names of targets, search, filters, sorting, grouping and counts; and indexes of records."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import has_all_tokens
from ..schema import Dataset

PAGE = 25
SORTS = {"created": ["seq"], "operation": ["operation"], "target": ["target_name"], "review": ["review_status"]}


def with_names(changes: DataFrame, objects: DataFrame) -> DataFrame:
    """``target_name``: the canonical name, else that of the CREATE in the log, else Untitled."""
    names = objects.select(F.col("id").alias("target_id"), F.col("name").alias("__canonical"))
    made = changes.where("operation = 'create'").groupBy("target_id").agg(F.max_by(F.get_json_object("after_json", "$.name"), "seq").alias("__made"))
    out = changes.join(names, "target_id", "left").join(made, "target_id", "left")
    return out.withColumn("target_name", F.coalesce("__canonical", "__made", F.lit("Untitled"))).drop("__canonical", "__made")


LINKS = {"relationship": "object", "relationship_type_rule": "object_type"}


def with_labels(changes: DataFrame, d: Dataset) -> DataFrame:
    """``target_label`` and ``parent_label`` for changes of every kind.

    A record's canonical name comes first, then that of its CREATE in the log, else Untitled. Relationships and rules have no
    name: theirs is that of their ends. Only records that the log names, and their ends, are looked up.
    """
    payload = lambda *keys: F.coalesce(*[F.get_json_object("after_json", f"$.{k}") for k in keys])
    key = ["kind", "ref"]
    made = changes.where("operation = 'create'").select(F.col("target_type").alias("kind"), F.col("target_id").alias("ref"), "seq", F.struct(payload("name").alias("name"), payload("source_id", "subject_type_id").alias("a"), payload("target_id", "object_type_id").alias("b")).alias("x"))
    made = made.groupBy(*key).agg(F.max_by("x", "seq").alias("x")).select(*key, "x.*")
    asked = changes.select(F.explode(F.array(F.struct(F.col("target_type").alias("kind"), F.col("target_id").alias("ref")), F.struct(F.col("parent_type").alias("kind"), F.col("parent_id").alias("ref")))).alias("x")).select("x.*").where("kind is not null and ref is not null").distinct()
    known = d.relationships.select(F.lit("relationship").alias("kind"), F.col("id").alias("ref"), F.col("source_id").alias("a"), F.col("target_id").alias("b"))
    known = known.unionByName(d.rules.select(F.lit("relationship_type_rule").alias("kind"), F.col("id").alias("ref"), F.col("subject_type_id").alias("a"), F.col("object_type_id").alias("b")))
    links = asked.where(F.col("kind").isin(*LINKS)).join(known, key, "left").join(made.select(*key, F.col("a").alias("made_a"), F.col("b").alias("made_b")), key, "left")
    links = links.select(*key, F.coalesce("a", "made_a").alias("a"), F.coalesce("b", "made_b").alias("b")).withColumn("end_kind", F.element_at(F.create_map(*[F.lit(x) for pair in LINKS.items() for x in pair]), F.col("kind")))
    ends = links.select(F.col("end_kind").alias("kind"), F.explode(F.array("a", "b")).alias("ref")).where("ref is not null")
    tables = {"object": d.objects, "object_type": d.object_types, "relationship_type": d.relationship_types, "attribute_definition": d.attribute_defs}
    names = reduce(DataFrame.unionByName, [t.select(F.lit(k).alias("kind"), F.col("id").alias("ref"), F.col("name").alias("canonical")) for k, t in tables.items()])
    plain = asked.where(~F.col("kind").isin(*LINKS)).unionByName(ends).distinct().join(names, key, "left").join(made.select(*key, "name"), key, "left")
    plain = plain.select(*key, F.coalesce("canonical", "name", F.lit("Untitled")).alias("label"))
    end = lambda c: plain.select(F.col("kind").alias("end_kind"), F.col("ref").alias(c), F.col("label").alias(f"{c}_label"))
    both = links.join(end("a"), ["end_kind", "a"], "left").join(end("b"), ["end_kind", "b"], "left")
    no_end = F.col("a").isNull() & F.col("b").isNull()
    pair = F.concat(F.coalesce("a_label", F.lit("Untitled")), F.lit(" \u2192 "), F.coalesce("b_label", F.lit("Untitled")))
    labels = plain.unionByName(both.select(*key, F.when(no_end, "Untitled").otherwise(pair).alias("label")))
    as_ = lambda side: labels.select(F.col("kind").alias(f"{side}_type"), F.col("ref").alias(f"{side}_id"), F.col("label").alias(f"{side}_label"))
    out = changes.join(as_("target"), ["target_type", "target_id"], "left").join(as_("parent"), ["parent_type", "parent_id"], "left")
    return out.select(*changes.columns, "target_label", "parent_label")


def search(changes: DataFrame, text: str = "", operation: str = "", target_type: str = "", review_status: str = "") -> DataFrame:
    out = changes
    if text.strip():
        needle = F.lit(text.strip().lower())
        hit: Column = F.lit(False)
        for c in ("target_id", "target_name", "parent_id", "before_json", "after_json"):
            if c in changes.columns:
                hit = hit | F.coalesce(F.contains(F.lower(c), needle), F.lit(False))
        out = out.where(hit)
    for column, value in (("operation", operation), ("target_type", target_type), ("review_status", review_status)):
        out = out.where(F.col(column) == value) if value else out
    return out


def ordered(changes: DataFrame, sort: str = "created") -> DataFrame:
    down = sort.startswith("-")
    keys = SORTS.get(sort.lstrip("-"), SORTS["created"])
    return changes.orderBy(*[F.desc(k) if down else F.asc(k) for k in keys], "seq", "id")


def counts(changes: DataFrame) -> DataFrame:
    reviewed = F.count_if(F.col("review_status") == "reviewed") if "review_status" in changes.columns else F.lit(0).cast("long")
    return changes.agg(F.count(F.lit(1)).alias("total"), reviewed.alias("reviewed"), F.countDistinct("target_id").alias("targets"), F.countDistinct("target_type").alias("target_types"))


def grouped(changes: DataFrame, by: str = "target") -> DataFrame:
    """(label, n, first_seq, last_seq) per target, parent or operation, or all as one."""
    label = {"target": F.col("target_name") if "target_name" in changes.columns else F.col("target_id"), "parent": F.coalesce("parent_id", F.lit("None")), "operation": F.col("operation")}.get(by, F.lit("All"))
    return changes.groupBy(label.alias("label")).agg(F.count(F.lit(1)).alias("n"), F.min("seq").alias("first_seq"), F.max("seq").alias("last_seq"))


def index(records: DataFrame, query: str = "", active_only: bool = True, sort: str = "name", page: int = 1, size: int = PAGE) -> DataFrame:
    """One page of records whose name, description or key holds the query, in a total order."""
    out = records.where("is_active") if active_only else records
    if query.strip():
        needle = F.lit(query.strip().upper())
        out = out.where(F.contains(F.upper("name"), needle) | F.coalesce(F.contains(F.upper("description"), needle), F.lit(False)) | F.coalesce(F.contains(F.upper("key"), needle), F.lit(False)))
    key = {"name": F.lower("name"), "status": F.col("is_active"), "created": F.col("created_at") if "created_at" in records.columns else F.col("id")}.get(sort.lstrip("-"), F.lower("name"))
    return out.orderBy(key.desc() if sort.startswith("-") else key.asc(), "id").offset((max(1, page) - 1) * size).limit(size)


def edge_index(edges: DataFrame, objects: DataFrame, query: str = "", sort: str = "subject", page: int = 1, size: int = PAGE, links=None) -> DataFrame:
    """One page of edges with their ends' names, by subject, object, status or time of creation. A query keeps edges with an end whose
    name holds it. One join an end, by the source's own keys where its ``links`` are given."""
    if links is not None:
        out = links.with_ends("name").withColumnsRenamed({"source_name": "subject", "target_name": "object"}).drop("source_type", "target_type")
    else:
        names = objects.select("id", "name")
        out = edges.join(names.select(F.col("id").alias("source_id"), F.col("name").alias("subject")), "source_id").join(names.select(F.col("id").alias("target_id"), F.col("name").alias("object")), "target_id")
    if query.strip():
        holds = lambda c: F.contains(F.upper(c), F.lit(query.strip().upper()))
        out = out.where(F.coalesce(holds("subject"), F.lit(False)) | F.coalesce(holds("object"), F.lit(False)))
    created = F.col("created_at") if "created_at" in edges.columns else F.col("id")
    key = {"object": F.lower("object"), "status": F.col("is_active"), "created": created}.get(sort.lstrip("-"), F.lower("subject"))
    return out.orderBy(key.desc() if sort.startswith("-") else key.asc(), "id").offset((max(1, page) - 1) * size).limit(size)


def inactive_matches(records: DataFrame, query: str) -> DataFrame:
    """Whether an Active-only search hides matches."""
    hit = has_all_tokens(F.col("name"), query)
    return records.agg(F.count_if(hit & ~F.col("is_active")).alias("hidden"), F.count_if(hit & F.col("is_active")).alias("shown"))


def endpoint_candidates(objects: DataFrame, object_types: DataFrame, allowed: DataFrame) -> DataFrame:
    """Active objects of the allowed types (column type_id), by type name, name and id."""
    rows = objects.where("is_active").join(allowed.select("type_id").distinct(), "type_id", "left_semi")
    return rows.join(object_types.select(F.col("id").alias("type_id"), F.col("name").alias("type_name")), "type_id").orderBy("type_name", F.lower("name"), "id")
