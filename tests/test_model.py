"""Commits by buckets: what they write and read, that their issues are those of a whole validation, crashes and races."""

import json
import random
import threading
from collections import Counter

import pytest
from pyspark.sql import functions as F

from typegrove import schema, shared
from typegrove.operators import commit, validation
from typegrove.operators.model import Model

from .test_operators import definitions, graph, ids, log, types  # noqa: F401


def people(spark, n=40):
    """Persons and teams: a person has one to two teams, a team at most six persons; persons have a level from 0 to 9."""
    rng = random.Random(2)
    objects = [(f"p{k}", "person", f"p_{k}", f"Person {k}", "", {"level": str(k % 10)}, k % 9 != 8) for k in range(n)] + [(f"t{k}", "team", f"t_{k}", f"Team {k}", "", {}, True) for k in range(n // 4)]
    edges = [(f"e{k}", "member", f"p{k}", f"t{k % (n // 4)}", {}, True) for k in range(n)] + [(f"k{k}", "knows", f"p{rng.randrange(n)}", f"p{rng.randrange(n)}", {}, True) for k in range(n)]
    return schema.Dataset(
        types(spark, ("person", True), ("team", True)),
        types(spark, ("member", True), ("knows", True)),
        spark.createDataFrame([("m", "member", "person", "team", 0, 6, 1, 2), ("k", "knows", "person", "person", 0, None, 0, None)], schema.RULES),
        definitions(spark, dict(owner_id="person", key="level", data_type="number", least=0.0, most=9.0, required=True)),
        spark.createDataFrame(objects, schema.OBJECTS),
        spark.createDataFrame(edges, schema.RELATIONSHIPS),
    )


def log_of(spark, rows):
    return log(spark, *rows)


def rows_of(df):
    return Counter(tuple(json.dumps(v, sort_keys=True, default=str) for v in r) for r in df.collect())


def test_a_commit_of_one_record_writes_one_bucket_a_table(spark, tmp_path):
    model = Model(spark, str(tmp_path / "m"), buckets=8)
    model.create(people(spark))
    old = model._load(1)[0]
    assert model.commit(log(spark, dict(op="update", id="p3", after='{"field": "name", "value": "New"}'))).revision == 2
    new = model._load(2)[0]
    changed = {t: {b for b in new.files(t) if new.files(t)[b] != old.files(t).get(b)} for t in new.tables}
    assert {t: len(b) for t, b in changed.items()} == {"object_types": 0, "relationship_types": 0, "rules": 0, "attribute_defs": 0, "objects": 1, "keys": 1, "relationships": 0, "counts": 0}
    assert len(old.files("objects")) == 8
    edge = model.commit(log(spark, dict(op="create", id="e99", kind="relationship", parent="knows", after='{"source_id": "p1", "target_id": "p2"}')))
    assert edge.revision == 3
    newer = model._load(3)[0]
    assert {t: sum(newer.files(t)[b] != new.files(t).get(b) for b in newer.files(t)) for t in ("objects", "keys", "relationships")} == {"objects": 0, "keys": 0, "relationships": 1}
    assert 1 <= sum(newer.files("counts")[b] != new.files("counts").get(b) for b in newer.files("counts")) <= 2
    assert model.read(2).objects.where("id = 'p3'").first()["name"] == "New" and model.read(1).objects.where("id = 'p3'").first()["name"] == "Person 3"


def test_a_commit_reads_only_touched_buckets(spark, tmp_path, monkeypatch):
    model = Model(spark, str(tmp_path / "m"), buckets=8)
    model.create(people(spark))
    read, seen = type(model.store).read, []

    def watched(self, index, table, only=None):
        seen.append((table, only))
        return read(self, index, table, only)

    monkeypatch.setattr(type(model.store), "read", watched)
    model.commit(log(spark, dict(op="update", id="p3", after='{"field": "name", "value": "New"}'), dict(op="create", id="e99", kind="relationship", parent="knows", after='{"source_id": "p1", "target_id": "p2"}')))
    large = [(t, only) for t, only in seen if t in ("objects", "relationships", "counts", "keys")]
    assert large and all(only is not None and len(only) <= 3 for _, only in large)


@pytest.mark.parametrize("seed", range(3))
def test_issues_and_tables_equal_those_of_the_whole(spark, tmp_path, seed):
    """Random logs, half of them on a model that has issues from the start: the tables and issues that apply and validate give."""
    rng = random.Random(seed)
    base = people(spark, 20)
    if seed % 2:
        bad = {"p3": ("p_3", "88"), "p4": ("p_5", "4"), "p7": ("p_7", None)}
        key, level = (F.create_map(*[F.lit(x) for p, v in bad.items() for x in (p, v[k])])[F.col("id")] for k in (0, 1))
        odd = F.col("id").isin(*bad)
        base = base.with_(objects=base.objects.withColumn("key", F.when(odd, key).otherwise(F.col("key"))).withColumn("attributes", F.when(odd, F.create_map(F.lit("level"), level)).otherwise(F.col("attributes"))))
    model = Model(spark, str(tmp_path / "m"), buckets=4)
    model.create(base)
    index, old_issues = model._load(1)
    whole = model.read(1)
    assert rows_of(model.issues(1)) == rows_of(validation.validate(whole)) and (old_issues is not None) == bool(seed % 2)
    rows, value = [], lambda f, v: json.dumps({"field": f, "value": v})
    for k in range(rng.randrange(8, 25)):
        p, t, e = f"p{rng.randrange(22)}", f"t{rng.randrange(5)}", rng.choice([f"e{rng.randrange(20)}", f"k{rng.randrange(20)}"])
        rows.append(
            rng.choice(
                [
                    dict(op="update", id=p, after=value("name", rng.choice(["", "Other"]))),
                    dict(op="update", id=p, after=value("is_active", rng.choice([True, False]))),
                    dict(op="update", id=p, after=value("attributes.level", rng.choice(["3", "77", None]))),
                    dict(op="create", id=f"n{k}", parent=rng.choice(["person", "team", "none"]), after=json.dumps({"name": "N", "key": rng.choice(["p_1", f"x{k}"]), "attributes": {"level": "1"}})),
                    dict(op="delete", id=rng.choice([p, t])),
                    dict(op="create", id=f"m{k}", kind="relationship", parent=rng.choice(["member", "knows"]), after=json.dumps({"source_id": p, "target_id": rng.choice([p, t, "gone"])})),
                    dict(op="update", id=e, kind="relationship", after=value("is_active", False)),
                    dict(op="update", id=e, kind="relationship", after=value("target_id", t)),
                    dict(op="delete", id=e, kind="relationship"),
                    dict(op="update", id="m", kind="relationship_type_rule", after=value("o_max", rng.choice([1, 5]))),
                    dict(op="update", id="person.level", kind="attribute_definition", after=value("most", 4)),
                    dict(op="delete", id="m", kind="relationship_type_rule"),
                ]
            )
        )
    changes = log(spark, *rows).cache()
    from typegrove.operators.model import Change

    change = Change(model.store, index, changes, "tables/next", old_issues)
    change.write_ontology()
    change.write_objects()
    change.write_edges()
    after = commit.apply(whole, changes)
    for t in commit.TABLES:
        columns = [c for c in getattr(whole, t).columns if c not in ("source_type", "target_type")]
        assert rows_of(model.store.read(change.new, t).select(*columns)) == rows_of(getattr(after, t).select(*columns)), t
    full = after.with_(relationships=after.relationships.drop("source_type", "target_type"))
    assert rows_of(change.issues()) == rows_of(validation.validate(full))
    assert rows_of(change.change_issues()) == rows_of(commit.change_issues(whole, changes))
    kept = validation.side_counts(model.store.read(change.new, "relationships"))
    assert rows_of(model.store.read(change.new, "counts").select(*kept.columns)) == rows_of(kept)


def test_a_commit_that_mends_a_model_is_taken(spark, tmp_path):
    base = people(spark, 20)
    base = base.with_(objects=base.objects.withColumn("name", F.when(F.col("id") == "p1", "").otherwise(F.col("name"))).withColumn("is_active", F.lit(True)), relationships=base.relationships.where("id <> 'e1' or true"))
    model = Model(spark, str(tmp_path / "m"), buckets=4)
    model.create(base)
    assert [(r["code"], r["target_id"]) for r in model.issues().collect()] == [("name_required", "p1")]
    other = model.commit(log(spark, dict(op="update", id="p2", after='{"field": "name", "value": "X"}')))
    assert not other.committed and [r["target_id"] for r in other.issues.collect()] == ["p1"]
    done = model.commit(log(spark, dict(op="update", id="p1", after='{"field": "name", "value": "X"}')))
    assert done.committed and model.issues().isEmpty()


def test_an_unfinished_manifest_file_blocks_nothing(spark, tmp_path):
    model = Model(spark, str(tmp_path / "m"), buckets=2)
    model.create(people(spark, 8))
    for broken in ("", '{"revision": 2, "fol'):
        (tmp_path / "m" / "manifest" / f"{model.revision() + 1:012d}.json").write_text(broken)
        before = model.revision()
        done = model.commit(log(spark, dict(op="update", id="p1", after=json.dumps({"field": "name", "value": f"After {before}"}))), base_revision=before)
        assert done.committed and done.revision == before + 2 == model.revision()
    assert model.read().objects.where("id = 'p1'").first()["name"] == "After 3"
    assert {r["revision"] for r in model.manifest().collect()} == {1, 3, 5}
    with pytest.raises(commit.Conflict):  # a writer that looked before revision 3 was made
        model._publish(2, "tables/x", None)


def test_of_many_writers_of_a_file_one_makes_it(spark, tmp_path):
    path, made = str(tmp_path / "one.json"), []
    threads = [threading.Thread(target=lambda k=k: made.append((shared.put_if_absent(spark, path, str(k)), k))) for k in range(8)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    assert [k for won, k in made if won] == [int(shared.read_text(spark, path))]
    assert shared.names(spark, str(tmp_path)) == ["one.json"]
    spark.sparkContext._jsc.hadoopConfiguration().set("fs.viewfs.mounttable.put.link./in", f"file://{tmp_path}")
    spark.sparkContext._jsc.hadoopConfiguration().set("fs.AbstractFileSystem.viewfs.impl", "org.apache.hadoop.fs.viewfs.ViewFs")
    assert [shared.put_if_absent(spark, "viewfs://put/in/two.json", x) for x in ("a", "b")] == [True, False]  # by a rename
    assert (tmp_path / "two.json").read_text() == "a"


def test_equal_issues_are_all_laid_to_changes(spark):
    changes = log(spark, *[dict(op="update", id="zz", after='{"field": "name", "value": "a"}')] * 3, dict(op="update", id="zz", after='{"field": "description", "value": "a"}'))
    found = spark.createDataFrame([("x", "m", "name", "object", "zz")] * 3 + [("y", "m", None, "object", "zz"), ("z", "m", "name", "object", "other")], schema.ISSUES)
    got = [(r["code"], r["change_id"]) for r in commit.attributed(found, changes).collect()]
    assert Counter(got) == Counter({("x", "c2"): 3, ("y", "c3"): 1, ("z", None): 1})


def test_edges_keep_their_validity(spark, tmp_path):
    model = Model(spark, str(tmp_path / "m"), buckets=2)
    model.create(people(spark, 8))
    done = model.commit(
        log(
            spark,
            dict(op="update", id="e1", kind="relationship", after='{"field": "valid_from", "value": "2020-01-01T00:00:00"}'),
            dict(op="create", id="e50", kind="relationship", parent="knows", after='{"source_id": "p1", "target_id": "p2", "valid_from": "2021-01-01T00:00:00", "valid_to": "2022-01-01T00:00:00"}'),
        )
    )
    assert done.committed
    got = {r["id"]: (r["valid_from"], r["valid_to"]) for r in model.read().relationships.select("id", F.year("valid_from").alias("valid_from"), F.year("valid_to").alias("valid_to")).where("id in ('e1', 'e50', 'e2')").collect()}
    assert got == {"e1": (2020, None), "e50": (2021, 2022), "e2": (None, None)}
