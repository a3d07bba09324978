"""Change-sets: pre-checks of their rows, the tables they leave, issues laid to changes, and work on the log itself.

``model.Model`` keeps the revisions that commits make.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import is_slug
from ..schema import Dataset
from ..shared import Steps
from . import dataset as ds
from .overlay import STORED, stored
from .validation import issues, union

TABLES = {"object_types": "object_type", "relationship_types": "relationship_type", "rules": "relationship_type_rule", "attribute_defs": "attribute_definition", "objects": "object", "relationships": "relationship"}


def apply(dataset: Dataset, changes: DataFrame) -> Dataset:
    """The dataset as a commit stores it: every kind of target changed, retired records kept.

    What belongs to a record that is gone goes with it: edges with their ends, definitions and rules with their types.
    """
    out = dataset.with_(**{name: stored(getattr(dataset, name), changes, kind) for name, kind in TABLES.items()})
    owners = out.object_types.select(F.lit("object").alias("owner_kind"), F.col("id").alias("owner_id")).unionByName(out.relationship_types.select(F.lit("relationship").alias("owner_kind"), F.col("id").alias("owner_id")))
    rules = out.rules.join(out.relationship_types.select(F.col("id").alias("rel_type_id")), "rel_type_id", "left_semi")
    for end in ("subject_type_id", "object_type_id"):
        rules = rules.join(out.object_types.select(F.col("id").alias(end)), end, "left_semi")
    return ds.sound(out.with_(attribute_defs=out.attribute_defs.join(owners, ["owner_kind", "owner_id"], "left_semi"), rules=rules))


def known_ids(dataset: Dataset, changes: DataFrame) -> DataFrame:
    """(target_type, target_id) of what exists or is created."""
    out = changes.where("operation = 'create'").select("target_type", "target_id")
    for name, kind in TABLES.items():
        out = out.unionByName(getattr(dataset, name).select(F.lit(kind).alias("target_type"), F.col("id").alias("target_id")))
    return out.distinct()


def illegal_fields(changes: DataFrame) -> DataFrame:
    """UPDATE rows, with ``field``, of a field that their target type does not have."""
    field = F.get_json_object("after_json", "$.field")
    legal = F.lit(False)
    for kind, fields in STORED.items():
        legal = legal | ((F.col("target_type") == kind) & field.isin(*fields))
    legal = legal | (F.col("target_type").isin("object", "relationship") & F.startswith(field, F.lit("attributes.")) & (F.char_length(field) > 11))
    has_value = F.coalesce(F.array_contains(F.json_object_keys("after_json"), "value"), F.lit(False))
    return changes.where("operation = 'update'").withColumn("field", field).where(~(F.coalesce(legal, F.lit(False)) & has_value))


def log_ends(changes: DataFrame) -> DataFrame:
    """(target_id, end_id): the ends that created edges name, and those that updates move edges to."""
    made = changes.where("operation = 'create' and target_type = 'relationship'")
    ends = made.select("target_id", F.explode(F.array(F.get_json_object("after_json", "$.source_id"), F.get_json_object("after_json", "$.target_id"))).alias("end_id"))
    moved = changes.where("operation = 'update' and target_type = 'relationship'").where(F.get_json_object("after_json", "$.field").isin("source_id", "target_id"))
    return ends.unionByName(moved.select("target_id", F.get_json_object("after_json", "$.value").alias("end_id")))


def created_keys(changes: DataFrame) -> DataFrame:
    """CREATE rows of objects that bring a key, with ``key``."""
    return changes.where("operation = 'create' and target_type = 'object'").withColumn("key", F.get_json_object("after_json", "$.key")).where("key is not null")


def change_issues(dataset: Dataset, changes: DataFrame, keys: DataFrame | None = None, holders: Dataset | None = None) -> DataFrame:
    """What is wrong with the change rows themselves, before they are applied.

    ``dataset`` may hold only the records that the log names. Then ``keys`` (type_id, key) must have the keys it could clash
    with, and ``holders`` the records that may still have a type it deletes.
    """
    keys, holders = keys if keys is not None else dataset.objects, holders or dataset
    known = known_ids(dataset, changes)
    updates = changes.where("operation = 'update'").withColumn("field", F.get_json_object("after_json", "$.field"))
    missing = updates.join(known, ["target_type", "target_id"], "left_anti")
    key = created_keys(changes)
    objects = known.where("target_type = 'object'").select(F.col("target_id").alias("end_id"))
    lost = log_ends(changes).join(objects, "end_id", "left_anti").select("target_id").distinct()
    clash = key.join(keys.select(F.col("type_id").alias("parent_id"), "key"), ["parent_id", "key"], "left_semi")
    twice = key.groupBy("parent_id", "key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    rules = stored(dataset.rules, changes, "relationship_type_rule")
    touched = changes.where("target_type = 'relationship_type_rule' and operation <> 'delete'").select(F.col("target_id").alias("id")).distinct()
    same = ["rel_type_id", "subject_type_id", "object_type_id"]
    again = rules.join(rules.groupBy(*same).agg(F.count(F.lit(1)).alias("n")).where("n > 1"), same, "left_semi").join(touched, "id", "left_semi")
    say = lambda rows, code, message, field=None: issues(rows, code, message, F.col("target_type"), field, "target_id")
    return union(
        [
            say(illegal_fields(changes), "invalid_change", "The field can't be changed, or no value is given", F.col("field")),
            say(updates.where("field = 'key'"), "key_immutable", "A key stays as it is", "key"),
            say(missing, "target_not_found", "The record does not exist", F.col("field")),
            say(key.where(~is_slug(F.col("key"))), "invalid_key", "The key is not a slug", "key"),
            say(clash.unionByName(key.join(twice, ["parent_id", "key"], "left_semi").select(*clash.columns)), "duplicate_key", "The key is used already", "key"),
            issues(lost, "endpoint_not_found", "An end does not exist", "relationship", None, "target_id"),
            issues(again, "duplicate_rule", "The pair of types has a rule already", "relationship_type_rule"),
            protected(changes, "object", holders.objects),
            protected(changes, "relationship", holders.relationships),
        ]
    )


def protected(changes: DataFrame, kind: str, rows: DataFrame) -> DataFrame:
    """Deletes of types that records still have, those left out that the same change-set deletes."""
    gone_types = changes.where(f"operation = 'delete' and target_type = '{kind}_type'").select(F.col("target_id").alias("type_id"))
    gone = changes.where(f"operation = 'delete' and target_type = '{kind}'").select(F.col("target_id").alias("id"))
    held = rows.join(gone, "id", "left_anti").join(gone_types, "type_id", "left_semi").select("type_id").distinct()
    return issues(held, "protected_reference", "Records still have the type", f"{kind}_type", None, "type_id")


def attributed(found: DataFrame, changes: DataFrame) -> DataFrame:
    """Each issue with the change it is laid to: one of the same record and field, else of the record, the latest first.

    Changes are reduced to the latest of each field, and of each record, before they meet the issues, so every issue comes
    out once, equal ones as often as they were found.
    """
    c = changes.select(F.col("id").alias("change_id"), F.col("target_id").alias("__target"), F.get_json_object("after_json", "$.field").alias("__field"), "seq")
    latest = F.max_by("change_id", F.struct(F.coalesce("seq", F.lit(-1)).alias("seq"), F.col("change_id").alias("id")))
    by_field = c.groupBy("__target", "__field").agg(latest.alias("__one"))
    by_record = c.groupBy("__target").agg(latest.alias("__other"))
    rows = found.join(by_field, (F.col("target_id") == F.col("__target")) & F.col("field").eqNullSafe(F.col("__field")), "left").drop("__target", "__field")
    rows = rows.join(by_record, F.col("target_id") == F.col("__target"), "left").drop("__target")
    return rows.withColumn("change_id", F.coalesce("__one", "__other")).drop("__one", "__other")


class Conflict(ValueError):
    """Another commit has made the revision that this one was to make."""


@dataclass(frozen=True)
class Outcome:
    revision: int
    committed: bool
    issues: DataFrame | None


def last_recorded(changes: DataFrame) -> DataFrame:
    """The log with one row per change-set, target and field: the last recorded; creates and deletes once each."""
    field = F.coalesce(F.get_json_object("after_json", "$.field"), F.lit(""))
    field = F.when(F.col("operation") == "update", field).otherwise("")
    own = Window.partitionBy("proposal_id", "target_id", "operation", field).orderBy(F.col("seq").desc())
    return changes.withColumn("__rank", F.row_number().over(own)).where("__rank = 1").drop("__rank")


#: Payload fields that name another record.
NAMING = ("source_id", "target_id", "subject_type_id", "object_type_id")


def references(changes: DataFrame) -> DataFrame:
    """(target_id, names): each record that the log creates with the records it names, its parent among them."""
    made = changes.where("operation = 'create'")
    named = F.array("parent_id", *[F.get_json_object("after_json", f"$.{f}") for f in NAMING])
    return made.select("target_id", F.explode(F.array_distinct(F.array_compact(named))).alias("names"))


def dependents(changes: DataFrame, gone: DataFrame) -> DataFrame:
    """(target_id): the records in ``gone`` and all that can't be without those of them that the log creates.

    Created records that name a created record that goes do go, whatever field names it, and those that name them, to a
    fixpoint: a round joins what went last with the references, which are computed once.
    """
    named, created = _dependents(changes, gone)
    return named.unionByName(created).distinct()


def _dependents(changes: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``gone``, and what of it and of its dependents the log creates."""
    steps = Steps(changes.sparkSession, "dependents")
    made = changes.where("operation = 'create'").select("target_id")
    # only what the log creates goes on: other names, most of them, are left out once
    named = steps.keep(references(changes).join(made.select(F.col("target_id").alias("names")), "names", "left_semi"), "references")
    first = steps.keep(gone.select("target_id").distinct(), "gone")
    last = out = steps.keep(made.join(first, "target_id", "left_semi").distinct(), "gone-0")
    k = 0
    while not last.isEmpty():
        k += 1
        found = named.join(last.select(F.col("target_id").alias("names")), "names", "left_semi").select("target_id").distinct()
        last = steps.keep(found.join(out, "target_id", "left_anti"), f"gone-{k}")
        out = out.unionByName(last)
    return first, out


def discard(changes: DataFrame, gone: DataFrame) -> DataFrame:
    """The log without the records in ``gone`` (target_id), without what depends on those that it creates, and without
    updates that make other records name one of them. What names a record that exists without the log stays."""
    first, created = _dependents(changes, gone)
    every, lost = first.unionByName(created), created.select(F.col("target_id").alias("__value"))
    names = (F.col("operation") == "update") & F.get_json_object("after_json", "$.field").isin(*NAMING)
    rows = changes.withColumn("__value", F.when(F.coalesce(names, F.lit(False)), F.get_json_object("after_json", "$.value")))
    # rows that name nothing, most of a log, take one join
    rest = rows.where("__value is null").join(every, "target_id", "left_anti")
    naming = rows.where("__value is not null").join(every, "target_id", "left_anti").join(lost, "__value", "left_anti")
    return rest.select(*changes.columns).unionByName(naming.select(*changes.columns))


def bulk_edit(objects: DataFrame, selection: list[str], edits: dict[str, str | None], start_seq: int, proposal_id: str, most: int = 100) -> DataFrame:
    """UPDATE rows that set (or, with None, clear) fields of the selected records; equal values give none. All or nothing."""
    ids = list(dict.fromkeys(selection))
    if not ids or len(ids) > most:
        raise ValueError(f"select 1 to {most} records")
    rows = objects.where(F.col("id").isin(*ids))
    if rows.count() != len(ids):
        raise ValueError("a selected record does not exist")
    edit = F.array(*[F.struct(F.lit(f).alias("field"), F.lit(v).cast("string").alias("value")) for f, v in edits.items()])
    rows = rows.select("*", F.explode(edit).alias("e"))
    field, value = F.col("e.field"), F.col("e.value")
    attribute = F.element_at("attributes", F.substring(field, 12, 1000))
    old = F.when(F.startswith(field, F.lit("attributes.")), attribute).when(field == "name", F.col("name")).when(field == "description", F.col("description")).otherwise(F.col("is_active").cast("string"))
    rows = rows.withColumn("old", old).where(~F.col("old").eqNullSafe(value))
    json = lambda v: F.to_json(F.struct(field.alias("field"), v.alias("value")), {"ignoreNullFields": "false"})
    n = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("id", field))  # at most ``most`` records
    return rows.select(
        F.concat(F.lit(f"{proposal_id}:"), (n + start_seq).cast("string")).alias("id"), F.lit(proposal_id).alias("proposal_id"), (n + start_seq).cast("long").alias("seq"), F.lit("update").alias("operation"),
        F.lit("object").alias("target_type"), F.col("id").alias("target_id"), F.lit(None).cast("string").alias("parent_type"), F.lit(None).cast("string").alias("parent_id"), json(F.col("old")).alias("before_json"), json(value).alias("after_json"),
    )


def next_in_queue(proposals: DataFrame, stale_before=None) -> DataFrame:
    """The change-set to process next: the oldest queued, or one that has been processing since before ``stale_before``."""
    ready = F.col("status") == "queued"
    if stale_before is not None:
        ready = ready | ((F.col("status") == "processing") & (F.col("claimed_at") < F.lit(stale_before)))
    return proposals.where(ready).orderBy("submitted_at", "id").limit(1)


def live(proposals: DataFrame) -> DataFrame:
    """Change-sets that are open, or completed and not yet acknowledged."""
    return proposals.where(F.col("status").isin("working", "failed", "queued", "processing") | ((F.col("status") == "completed") & F.col("acknowledged_at").isNull()))


def __getattr__(name: str):
    """``commit.Model``: the model is built on what is above, so it is imported when it is asked for."""
    if name == "Model":
        from .model import Model

        return Model
    raise AttributeError(name)
