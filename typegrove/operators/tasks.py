"""Change-sets and assisted tasks as lists: which are recent or active, how many changes each has, and their state."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ACTIVE = ("queued", "running", "ready_for_review")
#: Outcome of a run -> (status, reason).
OUTCOMES = {
    "ready_for_review": ("ready_for_review", ""),
    "unresolved": ("failed", "unresolved"),
    "needs_user_clarification": ("failed", "needs_clarification"),
    "no_change_required": ("failed", "no_change_produced"),
}


def recent_or_active(tasks: DataFrame, since: Column, changes: DataFrame | None = None) -> DataFrame:
    """Tasks made since a time, and active ones of any age, newest first, with their number of changes."""
    out = tasks.where((F.col("created_at") >= since) | F.col("status").isin(*ACTIVE))
    if changes is not None:
        out = with_change_counts(out, changes)
    return out.orderBy(F.desc("created_at"), "id")


def with_change_counts(tasks: DataFrame, changes: DataFrame) -> DataFrame:
    n = changes.groupBy("proposal_id").agg(F.count(F.lit(1)).alias("change_count"))
    return tasks.join(n, "proposal_id", "left").withColumn("change_count", F.coalesce("change_count", F.lit(0)))


def active_by_model(tasks: DataFrame) -> DataFrame:
    """(model_id, task_id): the active task of each model that has one; of several the oldest listed last, by time and id."""
    rows = tasks.where(F.col("status").isin(*ACTIVE) & F.col("model_id").isNotNull())
    return rows.groupBy("model_id").agg(F.min_by("id", F.struct("created_at", "id")).alias("task_id"))


def decided(runs: DataFrame) -> DataFrame:
    """Runs (execution_status, outcome) with the status and reason that follow; an outcome without a rule has neither."""
    status, reason = F.lit(None).cast("string"), F.lit(None).cast("string")
    for outcome, (s, r) in OUTCOMES.items():
        status = F.when(F.col("outcome") == outcome, s).otherwise(status)
        reason = F.when(F.col("outcome") == outcome, r).otherwise(reason)
    failed = F.col("execution_status") == "failed"
    return runs.withColumn("status", F.when(failed, "failed").otherwise(status)).withColumn("reason", F.when(failed, "execution_failed").otherwise(reason))


def signatures(changes: DataFrame, time: str = "updated_at") -> DataFrame:
    """(proposal_id, changes, latest): whether a change-set is as it was; equal just if neither number nor time has changed."""
    return changes.groupBy("proposal_id").agg(F.count(F.lit(1)).alias("changes"), F.max(time).alias("latest"))


def fingerprint(model_id: str, type_id: str, ids: list[str], edits: dict[str, str | None], signature: tuple = ()) -> str:
    """Ties an edit of selected records to what its preview showed. The order of ids and edits does not matter."""
    document = {"model": model_id, "type": type_id, "ids": sorted(ids), "edits": sorted((k, v is None, v or "") for k, v in edits.items()), "state": [str(x) for x in signature]}
    return hashlib.sha256(json.dumps(document, sort_keys=True).encode()).hexdigest()


def per_model(rows: DataFrame, models: DataFrame) -> DataFrame:
    """(model_id, n): publications (or other rows with model_id) of every model, 0 where there are none."""
    n = rows.groupBy("model_id").agg(F.count(F.lit(1)).alias("n"))
    return models.select(F.col("id").alias("model_id")).join(n, "model_id", "left").select("model_id", F.coalesce("n", F.lit(0)).alias("n"))


def deletable(models: DataFrame, proposals: DataFrame) -> DataFrame:
    """Models without a queued or processing change-set: those that may be deleted."""
    busy = proposals.where("status in ('queued', 'processing')").select(F.col("model_id").alias("id"))
    return models.join(busy, "id", "left_anti")


#: Tables of a model in the order in which rows have to go, so that none names what is gone.
DELETE_ORDER = ("changes", "relationships", "objects", "rules", "attribute_defs", "relationship_types", "object_types")
