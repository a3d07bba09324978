"""A model's revisions: commits that read, write and validate only what a change-set touches.

Objects and edges lie in buckets by id (``store``). Beside them a revision has two tables derived from them: ``counts``,
the edges of a type that a record has on one side by the type of the other end, moved by plus or minus one; and ``keys``,
the records of each type and key. Edges carry the types of their ends, which never change. With these, what a changed
record can make invalid is found in the buckets of that record, its ends and its key, and the issues of a revision are those
of the one before, but for the records that could have changed theirs.

A commit finds its issues from the records that it changes and the buckets as they are; it writes the buckets that it changes when
there are none, so a change-set that is rejected writes none.

Everything is read only where a change demands it: records of a type whose rules or definitions change are validated anew
(read by that type), the edges are scanned for the ends that go when objects are deleted, and a deleted type is looked for
among the records.

A manifest file, whole when it appears and made by one writer only, makes a revision: of several commits on one revision one
succeeds, readers see whole revisions, and a commit run again under its token changes nothing. A manifest file that can't be
read is passed over, its number never used.
"""

from __future__ import annotations

import json
import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import Dataset
from ..shared import Steps, delete, names, put_if_absent, read_text
from . import dataset as ds
from .commit import TABLES, Conflict, Outcome, attributed, change_issues, created_keys, log_ends
from .overlay import stored
from .store import KEYS, Index, Store
from .validation import duplicate_keys, end_mismatches, record_issues, side_counts, structural_issues, union, validate

ONTOLOGY = ("object_types", "relationship_types", "rules", "attribute_defs")
VALIDITY = {"valid_from": "timestamp", "valid_to": "timestamp"}


def _ids(*parts: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, [p.select("id") for p in parts]).distinct()


def _pick(rows: DataFrame, ids: DataFrame) -> DataFrame:
    return rows.join(ids, "id", "left_semi")


class Change:
    """The next revision's tables and issues of one change-set, on an index that is filled as they are written.

    ``pending`` has, for each table of many buckets that changes, these buckets and what they are to hold, as a function of buckets.
    """

    def __init__(self, store: Store, old: Index, changes: DataFrame, name: str, old_issues: DataFrame | None):
        self.store, self.old, self.new, self.changes, self.name, self.old_issues = store, old, old.copy(), changes, name, old_issues
        did = {(r["target_type"], r["operation"]) for r in changes.select("target_type", "operation").distinct().collect()}
        self.kinds = {kind for kind, _ in did}
        self.deletes = {kind for kind, operation in did if operation == "delete"}
        self.scratch, self.pending = 0, {}

    def keep(self, df: DataFrame) -> DataFrame:
        """Computed once, into the change-set's own folder."""
        self.scratch += 1
        path = f"{self.store.path}/{self.name}/step-{self.scratch}"
        df.write.parquet(path)
        return self.store.spark.read.schema(df.schema).parquet(path)

    def targets(self, kind: str) -> DataFrame:
        return self.changes.where(F.col("target_type") == kind).select(F.col("target_id").alias("id")).distinct()

    def read(self, index: Index, table: str, rows: DataFrame | None = None) -> DataFrame:
        """The buckets of a table that the keys of ``rows`` fall into; None: all of them."""
        return self.store.read(index, table, None if rows is None else self.store.touched(index, table, rows))

    def now(self, table: str, rows: DataFrame | None = None) -> DataFrame:
        """``read`` of the next revision, whose buckets may not have been written yet."""
        if table not in self.pending:
            return self.read(self.new, table, rows)
        only, content = self.pending[table]
        wanted = range(self.old.tables[table]["buckets"]) if rows is None else self.store.touched(self.old, table, rows)
        changed, others = [b for b in only if b in wanted], [b for b in wanted if b not in only]
        out = content(changed)
        if len(changed) < len(only):
            out = out.where(self.store.number(self.old, table, *map(F.col, KEYS[table])).isin(changed))
        return out.unionByName(self.store.read(self.old, table, others)) if others else out

    def objects_of(self, ids: DataFrame) -> DataFrame:
        """The next revision's objects of ``ids``: the log's are at hand, so the others only are looked for, mostly few."""
        if "objects" not in self.pending:
            return _pick(self.read(self.new, "objects", ids), ids)
        rest = self.keep(ids.join(self.touched_objects, "id", "left_anti"))
        only, wanted, types = self.pending["objects"][0], self.store.touched(self.old, "objects", rest), self.store.read(self.new, "object_types")
        of = lambda inside: _pick(self.store.read(self.old, "objects", [b for b in wanted if (b in only) == inside]), rest)
        out = _pick(self.new_objects, ids).unionByName(of(False))
        return out.unionByName(ds.known_objects(of(True), types).select(*out.columns))

    def write(self) -> None:
        """Writes the buckets that change."""
        for table in list(self.pending):
            only, content = self.pending[table]
            self.store.write(self.new, table, content(only), self.name, only)
            del self.pending[table]

    def ontology(self, index: Index) -> dict[str, DataFrame]:
        return {t: self.store.read(index, t) for t in ONTOLOGY}

    def write_ontology(self) -> None:
        tables = self.ontology(self.old)
        changed = {t for t in ONTOLOGY if TABLES[t] in self.kinds}
        if not changed:
            return
        out = {t: stored(df, self.changes, TABLES[t]) for t, df in tables.items()}
        owners = out["object_types"].select(F.lit("object").alias("owner_kind"), F.col("id").alias("owner_id")).unionByName(out["relationship_types"].select(F.lit("relationship").alias("owner_kind"), F.col("id").alias("owner_id")))
        rules = out["rules"].join(out["relationship_types"].select(F.col("id").alias("rel_type_id")), "rel_type_id", "left_semi")
        for end in ("subject_type_id", "object_type_id"):
            rules = rules.join(out["object_types"].select(F.col("id").alias(end)), end, "left_semi")
        out |= {"rules": rules, "attribute_defs": out["attribute_defs"].join(owners, ["owner_kind", "owner_id"], "left_semi")}
        if {"object_type", "relationship_type"} & self.deletes:
            changed |= {"rules", "attribute_defs"}
        for t in changed:
            self.store.write(self.new, t, out[t], self.name)

    def lay_objects(self) -> None:
        """Objects in the log, and the keys they bring or lose."""
        self.touched_objects = self.targets("object")
        if "object" not in self.kinds:
            self.old_objects = self.new_objects = self.store.read(self.old, "objects", [])
            self.keyed = self.store.read(self.old, "keys", [])
            return
        self.touched_objects = touched = self.keep(self.touched_objects)
        only = self.store.touched(self.old, "objects", touched)
        before, types = self.store.read(self.old, "objects", only), self.store.read(self.new, "object_types")
        self.old_objects = self.keep(_pick(before, touched))
        self.new_objects = fresh = self.keep(ds.known_objects(stored(self.old_objects, self.changes, "object"), types).select(*before.columns))

        def objects(buckets: list[int]) -> DataFrame:
            rest = ds.known_objects(self.store.read(self.old, "objects", buckets).join(touched, "id", "left_anti"), types)
            return rest.select(*before.columns).unionByName(fresh)

        self.pending["objects"] = (only, objects)
        columns = ["type_id", "key", "id", "is_active"]
        bring = self.new_objects.select(*columns).where("key is not null")
        groups = self.old_objects.select("type_id", "key").unionByName(bring.select("type_id", "key")).where("key is not null").distinct()
        only = self.store.touched(self.old, "keys", groups)
        keys = lambda rows: rows.join(touched, "id", "left_anti").select(*columns).unionByName(bring)
        self.pending["keys"] = (only, lambda buckets: keys(self.store.read(self.old, "keys", buckets)))
        # whoever has, or had, a key of a touched record
        had = self.keep(self.store.read(self.old, "keys", only).join(groups, ["type_id", "key"], "left_semi").select(*columns))
        self.new_keyed = keys(had)
        self.keyed = had.unionByName(self.new_keyed)

    def lay_edges(self) -> None:
        """Edges in the log and edges of deleted objects; then the counts that they move."""
        touched = self.targets("relationship")
        if "object" in self.deletes:  # by the two columns of the ends
            gone = self.changes.where("target_type = 'object' and operation = 'delete'").select(F.col("target_id").alias("end_id")).distinct()
            ends = self.store.read(self.old, "relationships").select("id", F.explode(F.array_distinct(F.array("source_id", "target_id"))).alias("end_id"))
            touched = _ids(touched, ends.join(gone, "end_id", "left_semi"))
        elif "relationship" not in self.kinds:
            self.touched_edges, self.moved = touched, self.store.read(self.old, "counts", [])
            self.new_edges = self.store.read(self.old, "relationships", [])
            return
        self.touched_edges = touched = self.keep(touched)
        only = self.store.touched(self.old, "relationships", touched)
        before = self.store.read(self.old, "relationships", only)
        mine, types = self.keep(_pick(before, touched)), self.store.read(self.new, "relationship_types").select(F.col("id").alias("type_id"))
        known = lambda rows: rows.join(types, "type_id", "left_semi").select(*before.columns)
        fresh = self.keep(known(stored(mine, self.changes, "relationship")).drop(*ds.END_TYPES))
        ends = self.keep(fresh.select(F.explode(F.array("source_id", "target_id")).alias("id")).distinct())
        fresh = self.keep(ds.with_end_types(fresh, self.objects_of(ends).select("id", "type_id")))
        self.pending["relationships"] = (only, lambda buckets: known(self.store.read(self.old, "relationships", buckets).join(touched, "id", "left_anti")).unionByName(fresh))
        self.new_edges = fresh.select(*before.columns)
        less = side_counts(mine).withColumn("n", -F.col("n"))
        columns = ["id", "type_id", "side", "other_type"]
        moved = less.unionByName(side_counts(self.new_edges)).groupBy(*columns).agg(F.sum("n").alias("n")).where("n <> 0")
        self.moved = self.keep(moved)

        def counts(buckets: list[int]) -> DataFrame:
            return self.store.read(self.old, "counts", buckets).unionByName(self.moved).groupBy(*columns).agg(F.sum("n").alias("n")).where("n <> 0")

        self.pending["counts"] = (self.store.touched(self.old, "counts", self.moved), counts)

    def write_objects(self) -> None:
        self.lay_objects()
        self.write()

    def write_edges(self) -> None:
        self.lay_edges()
        self.write()

    def _types(self) -> tuple[DataFrame, DataFrame] | None:
        """Types of objects and of edges whose rules or definitions the log changes, of either revision."""
        if not self.kinds & {"object_type", "relationship_type", "relationship_type_rule", "attribute_definition"}:
            return None
        objects, edges = [self.targets("object_type")], [self.targets("relationship_type")]
        for tables in (self.ontology(self.old), self.ontology(self.new)):
            defs, rules = _pick(tables["attribute_defs"], self.targets("attribute_definition")), _pick(tables["rules"], self.targets("relationship_type_rule"))
            objects += [defs.where("owner_kind = 'object'").select(F.col("owner_id").alias("id")), rules.select(F.col("subject_type_id").alias("id")), rules.select(F.col("object_type_id").alias("id"))]
            edges += [defs.where("owner_kind = 'relationship'").select(F.col("owner_id").alias("id")), rules.select(F.col("rel_type_id").alias("id"))]
        return tuple(self.keep(_ids(*parts).withColumnRenamed("id", "type_id")) for parts in (objects, edges))

    def issues(self) -> DataFrame:
        """The new revision's issues: of records that the change-set can have made valid or invalid, and the rest as before."""
        near, types = self.keep(_ids(self.touched_objects, self.moved, self.keyed)), self._types()
        objects, edges, sides = self.objects_of(near), self.new_edges, _pick(self.now("counts", near), near)
        if types:
            objects = objects.unionByName(self.now("objects").join(types[0], "type_id", "left_semi").select(*objects.columns)).dropDuplicates(["id"])
            edges = edges.unionByName(self.now("relationships").join(types[1], "type_id", "left_semi").select(*edges.columns)).dropDuplicates(["id"])
            sides = self.now("counts")
        objects, edges = self.keep(objects), self.keep(edges)
        part = Dataset(objects=objects, relationships=edges, **self.ontology(self.new))
        found = [*record_issues(part, sides), structural_issues(part)]
        if "object" in self.kinds:
            found.append(duplicate_keys(self.new_keyed.where("is_active"), "object"))
        if "model_id" in objects.columns and "model_id" in edges.columns:
            ends = edges.select(F.explode(F.array("source_id", "target_id")).alias("id")).distinct()
            found.append(end_mismatches(edges.where("is_active"), self.now("objects", ends)))
        out = union(found)
        if self.old_issues is not None:
            done = _ids(near, objects).select(F.lit("object").alias("target_type"), F.col("id").alias("target_id"))
            done = done.unionByName(_ids(self.touched_edges, edges).select(F.lit("relationship").alias("target_type"), F.col("id").alias("target_id")))
            twice = F.col("code") == "duplicate_key"  # such an issue changes with its key's records only, and those of the types are not all met
            rest = self.old_issues.where("target_type in ('object', 'relationship')").where(~twice).join(done, ["target_type", "target_id"], "left_anti")
            keyed = self.keyed.select(F.col("id").alias("target_id")).distinct()
            out = out.unionByName(rest.select(*out.columns)).unionByName(self.old_issues.where(twice).join(keyed, "target_id", "left_anti").select(*out.columns))
        return out

    def change_issues(self) -> DataFrame:
        """The log's own issues, held against the old records that it names."""
        named = self.old_objects
        if "relationship" in self.kinds:
            ends = self.keep(_ids(log_ends(self.changes).select(F.col("end_id").alias("id"))).join(self.touched_objects, "id", "left_anti"))
            named = named.unionByName(_pick(self.read(self.old, "objects", ends), ends))
        only = lambda table, ids: _pick(self.read(self.old, table, ids), ids)
        edges = only("relationships", self.keep(self.targets("relationship"))) if "relationship" in self.kinds else self.store.read(self.old, "relationships", [])
        keys = created_keys(self.changes).select(F.col("parent_id").alias("type_id"), "key")
        seen = Dataset(objects=named, relationships=edges, **self.ontology(self.old))
        holders = seen
        if {"object_type", "relationship_type"} & self.deletes:
            holders = seen.with_(objects=self.read(self.old, "objects"), relationships=self.read(self.old, "relationships"))
        return change_issues(seen, self.changes, self.read(self.old, "keys", keys) if "object" in self.kinds else self.store.read(self.old, "keys", []), holders)


class Model:
    """Revisions of a dataset under a folder that all executors share."""

    MANIFEST = "revision long, folder string, token string"

    def __init__(self, spark: SparkSession, path: str, buckets: int = 32):
        self.spark, self.path = spark, path.rstrip("/")
        self.store = Store(spark, self.path, buckets)

    def _entry(self, revision: int) -> dict | None:
        """A revision's line of the manifest; None where there is none that can be read."""
        try:
            found = json.loads(read_text(self.spark, f"{self.path}/manifest/{revision:012d}.json") or "")
            return found if found.get("folder") else None
        except (ValueError, AttributeError):
            return None

    def _numbers(self) -> list[int]:
        return [int(x[:12]) for x in names(self.spark, f"{self.path}/manifest") if x.endswith(".json") and x[:12].isdigit()]

    def manifest(self) -> DataFrame:
        """(revision, folder, token): a row for each revision."""
        if not self._numbers():
            return self.spark.createDataFrame([], self.MANIFEST)
        return self.spark.read.schema(self.MANIFEST).json(f"{self.path}/manifest").where("revision is not null and folder is not null")

    def revision(self) -> int:
        """The current revision: the highest number whose manifest file can be read, 0 before the first."""
        return next((n for n in sorted(self._numbers(), reverse=True) if self._entry(n)), 0)

    def _stage(self, dataset: Dataset) -> str:
        """Writes all tables of a dataset, sound records only, with what is derived from them and their issues."""
        name, index = f"tables/{uuid.uuid4().hex}", Index()
        for table in ONTOLOGY:
            self.store.write(index, table, getattr(dataset, table), name)
        self.store.write(index, "objects", ds.known_objects(dataset.objects, dataset.object_types), name)
        objects = self.store.read(index, "objects")
        if dataset.links is not None:
            dataset = dataset.with_(links=dataset.links.checked(Steps(self.spark, "ends"), "odd"))
        edges = ds.typed_relationships(dataset, objects)
        edges = edges.withColumns({c: F.lit(None).cast(kind) for c, kind in VALIDITY.items() if c not in edges.columns})
        self.store.write(index, "relationships", edges, name)
        self.store.write(index, "counts", side_counts(self.store.read(index, "relationships")), name)
        self.store.write(index, "keys", objects.select("type_id", "key", "id", "is_active").where("key is not null"), name)
        self._save(index, name, validate(self._dataset(index), self.store.read(index, "counts")))
        return name

    def _save(self, index: Index, name: str, found: DataFrame) -> None:
        path = f"{name}/issues"
        found.write.parquet(f"{self.path}/{path}")
        empty = self.spark.read.schema(found.schema).parquet(f"{self.path}/{path}").isEmpty()
        self.store.save(index, name, issues=None if empty else path)

    def _dataset(self, index: Index) -> Dataset:
        return Dataset(**{t: self.store.read(index, t) for t in TABLES})

    def _publish(self, revision: int, name: str, token: str | None) -> int:
        """Makes the next revision, ``revision`` or, where its manifest file can't be read, the first number after it that is free."""
        while revision in self._numbers():
            if self._entry(revision):
                raise Conflict(f"revision {revision} has been made by another commit")
            revision += 1
        line = json.dumps({"revision": revision, "folder": name, "token": token}) + "\n"
        if not put_if_absent(self.spark, f"{self.path}/manifest/{revision:012d}.json", line):
            raise Conflict(f"revision {revision} has been made by another commit")
        return revision

    def create(self, dataset: Dataset) -> int:
        return self._publish(1, self._stage(dataset), None)

    def _load(self, revision: int) -> tuple[Index, DataFrame | None]:
        entry = self._entry(revision)
        if entry is None:
            raise ValueError(f"there is no revision {revision}")
        index, more = self.store.load(entry["folder"])
        return index, self.spark.read.parquet(f"{self.path}/{more['issues']}") if more["issues"] else None

    def read(self, revision: int | None = None) -> Dataset:
        """A revision as one: no later commit touches its buckets. Its edges carry the types of their ends."""
        return self._dataset(self._load(revision or self.revision())[0])

    def issues(self, revision: int | None = None) -> DataFrame:
        """What is wrong with a revision: nothing, unless it was created so."""
        found = self._load(revision or self.revision())[1]
        return found if found is not None else self.spark.createDataFrame([], "code string, message string, field string, target_type string, target_id string")

    def read_consistent(self, view, tries: int = 2) -> tuple[int, object]:
        """(revision, ``view(dataset)``), of a revision that was still the current one after the view; one retry."""
        for _ in range(tries):
            before = self.revision()
            out = view(self.read(before))
            if self.revision() == before:
                return before, out
        raise Conflict("the model changed while it was read")

    def commit(self, changes: DataFrame, base_revision: int | None = None, token: str | None = None) -> Outcome:
        """Applies and validates; makes the next revision if there are no issues, else changes nothing.

        A ``token`` that a revision has already gives that revision and no other.
        """
        if token is not None:
            found = self.manifest().where(F.col("token") == token).first()
            if found is not None:
                return Outcome(found["revision"], True, None)
        now = self.revision()
        if base_revision is not None and base_revision != now:
            raise Conflict(f"the change-set was made on revision {base_revision}; the model is at {now}")
        index, old_issues = self._load(now)
        name, tried = f"tables/{uuid.uuid4().hex}", f"{self.path}/tried/{uuid.uuid4().hex}"
        changes.write.parquet(f"{tried}/changes")
        changes = self.spark.read.schema(changes.schema).parquet(f"{tried}/changes")
        change = Change(self.store, index, changes, name, old_issues)
        change.write_ontology()
        change.lay_objects()
        change.lay_edges()
        found = attributed(change.change_issues().unionByName(change.issues()), changes)
        found.write.parquet(f"{tried}/issues")
        found = self.spark.read.schema(found.schema).parquet(f"{tried}/issues")
        if not found.isEmpty():
            delete(self.spark, f"{self.path}/{name}")
            return Outcome(now, False, found)
        change.write()
        try:
            self.store.save(change.new, name, issues=None)
            made = self._publish(now + 1, name, token)
        except Conflict:
            delete(self.spark, f"{self.path}/{name}")
            raise
        for k in range(change.scratch):
            delete(self.spark, f"{self.path}/{name}/step-{k + 1}")
        return Outcome(made, True, found)
