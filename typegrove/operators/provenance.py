"""Where a record's state comes from: the completed change-sets that touched it, newest last, with readable changes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import field_label

#: Fixed number of change-sets shown for a record.
LIMIT = 25


def interpret(changes: DataFrame) -> DataFrame:
    """Adds kind, summary, field, old and new to change rows."""
    get = lambda doc, f: F.get_json_object(doc, f"$.{f}")
    field = get("after_json", "field")
    old, new = get("before_json", "value"), get("after_json", "value")
    attribute = F.when(F.startswith(field, F.lit("attributes.")), F.substring(field, 12, 1_000_000))
    op = F.col("operation")
    kind = (
        F.when(op == "create", "created")
        .when(op == "delete", "deleted")
        .when(field == "name", "renamed")
        .when(field == "description", "described")
        .when((field == "is_active") & (new == "true"), "reactivated")
        .when(field == "is_active", "deactivated")
        .when(attribute.isNotNull() & new.isNull(), "attribute_cleared")
        .when(attribute.isNotNull() & old.isNull(), "attribute_set")
        .when(attribute.isNotNull(), "attribute_changed")
        .otherwise("field_changed")
    )
    label = field_label(F.coalesce(attribute, field))
    return changes.select("*", kind.alias("kind"), F.coalesce(attribute, field).alias("field"), label.alias("label"), old.alias("old"), new.alias("new")).withColumn("summary", _summary())


def _summary() -> Column:
    k = F.col("kind")
    return (
        F.when(k == "created", "Created")
        .when(k == "deleted", "Deleted")
        .when(k == "renamed", F.concat(F.lit("Renamed to "), F.coalesce("new", F.lit(""))))
        .when(k == "described", "Description changed")
        .when(k == "reactivated", "Made active again")
        .when(k == "deactivated", "Retired")
        .when(k == "attribute_cleared", F.concat("label", F.lit(" cleared")))
        .otherwise(F.concat(F.coalesce("label", F.lit("Field")), F.lit(" set to "), F.coalesce("new", F.lit(""))))
    )


def entries(changes: DataFrame, proposals: DataFrame, results: DataFrame, limit: int = LIMIT) -> DataFrame:
    """Change rows of the last ``limit`` completed change-sets of each target, with ``position`` (1 the newest) and ``truncated``.

    Change-sets are ordered by the revision they led to, then time and id. Within one, creates come before updates before
    deletes. One job for any number of records: a window per target over its own change-sets.
    """
    done = proposals.where("status = 'completed'").select(F.col("id").alias("proposal_id"), "created_by", "title", "completed_at")
    r = results.where("outcome = 'completed'").select("proposal_id", "after_revision")
    done = done.join(r, "proposal_id")
    # Change-sets of a target are ranked as one row each, so a record with very many changes costs a row per change-set.
    sets = changes.groupBy("target_id", "proposal_id").agg(F.min("seq").alias("first_seq")).join(done.select("proposal_id", "after_revision"), "proposal_id")
    own = Window.partitionBy("target_id").orderBy(F.col("after_revision").desc(), F.col("first_seq").desc(), F.col("proposal_id").desc())
    sets = sets.withColumn("position", F.row_number().over(own)).where(F.col("position") <= limit + 1)
    sets = sets.withColumn("truncated", F.max("position").over(Window.partitionBy("target_id")) > limit).where(F.col("position") <= limit)
    rows = interpret(changes).join(sets.select("target_id", "proposal_id", "position", "truncated"), ["target_id", "proposal_id"]).join(done, "proposal_id")
    step = F.when(F.col("operation") == "create", 0).when(F.col("operation") == "update", 1).otherwise(2)
    return rows.withColumn("step", step)


def with_evidence(rows: DataFrame, evidence: DataFrame, most: int = 10) -> DataFrame:
    """Each change with up to ``most`` pieces of evidence and how many there are."""
    order = Window.partitionBy("change_id").orderBy("source", "locator")
    e = evidence.withColumn("rank", F.row_number().over(order))
    per = e.groupBy("change_id").agg(F.count(F.lit(1)).alias("evidence_count"), F.array_sort(F.collect_list(F.when(F.col("rank") <= most, F.struct("rank", "source", "locator", "note")))).alias("evidence"))
    return rows.join(per.withColumnRenamed("change_id", "id"), "id", "left").withColumn("evidence_count", F.coalesce("evidence_count", F.lit(0)))
