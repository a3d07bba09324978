"""Tables of a typed property graph.

Instance rows hold their attributes as a map from attribute key to text; ``kinds`` beside it, where present, has the
JSON kind of each value (string, number, boolean, null, other), so that text "1" and number 1 stay apart.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

OBJECT_TYPES = "id string, key string, name string, is_active boolean, sort_order int, description string"
ATTRIBUTE_DEFS = (
    "id string, owner_kind string, owner_id string, key string, name string, data_type string, required boolean, nullable boolean, sort_order int,"
    " is_active boolean, min_length int, max_length int, least double, most double, choices array<string>"
)
RELATIONSHIP_TYPES = OBJECT_TYPES
RULES = "id string, rel_type_id string, subject_type_id string, object_type_id string, s_min int, s_max int, o_min int, o_max int"
OBJECTS = "id string, type_id string, key string, name string, description string, attributes map<string,string>, is_active boolean"
RELATIONSHIPS = "id string, type_id string, source_id string, target_id string, attributes map<string,string>, is_active boolean"
CHANGES = (
    "id string, proposal_id string, seq long, operation string, target_type string, target_id string, parent_type string, parent_id string,"
    " before_json string, after_json string"
)
ISSUES = "code string, message string, field string, target_type string, target_id string"


@dataclass(frozen=True)
class Dataset:
    """Ontology tables (small) and instance tables (large).

    ``links``, where a source has them (``graphview.Links``), are the same objects and edges by the source's own keys; they go when
    objects or edges are replaced.
    """

    object_types: DataFrame
    relationship_types: DataFrame
    rules: DataFrame
    attribute_defs: DataFrame
    objects: DataFrame
    relationships: DataFrame
    links: object = None

    def with_(self, **tables) -> Dataset:
        if {"objects", "relationships"} & set(tables):
            tables.setdefault("links", None)
        return replace(self, **tables)


def with_kinds(df: DataFrame, json_column: str = "attributes_json") -> DataFrame:
    """Parses a JSON attribute bag into ``attributes`` (text as written) and ``kinds``."""
    kinds = F.expr(f"transform_values(from_json({json_column}, 'map<string,variant>'), (k, v) -> schema_of_variant(v))")
    kind = lambda x: F.when(x == "STRING", "string").when(x == "BOOLEAN", "boolean").when(x == "VOID", "null").when(x.rlike("BIGINT|DECIMAL|DOUBLE"), "number").otherwise("other")
    text = F.from_json(json_column, "map<string,string>")
    return df.withColumn("attributes", F.coalesce(text, F.create_map().cast("map<string,string>"))).withColumn("kinds", F.transform_values(kinds, lambda k, v: kind(F.coalesce(v, F.lit("VOID")))))
