"""Mappings, change plans, templates."""

from typegrove.operators import change_plan, importing, overlay
from typegrove.plans.mapping import Target, check
from typegrove.sources import tables, templates

from .test_operators import graph, ids  # noqa: F401

TARGETS = {
    ("object", "app"): Target("object", "app", {"owner": "text", "live": "boolean"}),
    ("relationship", "uses"): Target("relationship", "uses", {"since": "date"}, (("team", "app"),)),
}


def codes(raw, headers=("a", "b", "c")):
    return sorted(p["code"] for p in check(raw, list(headers), TARGETS)[1])


def test_mapping():
    target = {"kind": "object", "type_id": "app"}
    good = {"target": target, "columns": [{"column": "a", "field": "attributes.owner", "match": True}, {"column": "b", "field": "name"}, {"column": "c", "field": ""}]}
    mapping, problems = check(good, ["a", "b", "c"], TARGETS)
    assert not problems and [c.field for c in mapping.columns] == ["attributes.owner", "name"]
    assert codes({"target": {"kind": "x"}}) == ["unknown_target"]
    assert codes({"target": target, "columns": [{"column": "a", "field": "name"}, {"column": "a", "field": "name"}, {"column": "z", "field": "what"}]}) == ["duplicate_column", "duplicate_field", "identity_required", "unknown_column", "unknown_field"]
    assert codes({"target": target, "columns": [{"column": "a", "field": "attributes.live", "match": True}]}) == ["not_an_identity"]
    edge = {"kind": "relationship", "type_id": "uses"}
    ends = [{"column": "a", "field": "subject", "by": "key"}, {"column": "b", "field": "object", "by": "attribute:owner", "object_type_id": "app"}]
    assert codes({"target": edge, "columns": ends}) == []
    assert codes({"target": edge, "columns": [ends[0] | {"by": "luck", "object_type_id": "app"}]}) == ["ends_required", "type_not_allowed", "unknown_resolver"]


def test_change_plan(graph, spark):  # noqa: F811
    rows = [
        (1, "create", "object", "new", "n1", "object_type", "existing", "person", {"name": "New", "attributes.email": "a@b.c"}),
        (2, "create", "relationship", "new", "e1", "relationship_type", "existing", "member", {"source": "new:n1", "target": "t1"}),
        (3, "update", "object", "existing", "p1", None, None, None, {"name": "Ann", "attributes.email": None}),
        (4, "delete", "object", "existing", "p2", None, None, None, None),
    ]
    plan = spark.createDataFrame(rows, change_plan.OPERATIONS)
    assert change_plan.problems(plan, graph).count() == 0
    changes = change_plan.compiled(plan, "7")
    assert changes.count() == 5
    objects = {r["name"]: r for r in overlay.overlay(graph.objects, changes, "object").collect()}
    assert objects["New"]["attributes"] == {"email": "a@b.c"} and objects["Ann"]["attributes"] == {"email": None} and "Bob" not in objects
    edge = overlay.overlay(graph.relationships, changes, "relationship", ()).where("is_proposed").first()
    assert (edge["source_id"], edge["target_id"]) == (objects["New"]["id"], "t1")
    bad = [
        (1, "create", "object", "existing", "p1", None, None, None, {}),
        (2, "update", "object", "new", "x", None, None, None, {}),
        (3, "delete", "object", "existing", "nope", None, None, None, None),
        (4, "create", "relationship", "new", "t", "relationship_type", "new", "lost", {"source": "new:zz", "target": "qq"}),
        (5, "create", "object", "new", "t", "object_type", "existing", "none", {}),
        (6, "move", "thing", "existing", "p1", None, None, None, None),
    ]
    got = {(r["code"], r["n"]) for r in change_plan.problems(spark.createDataFrame(bad, change_plan.OPERATIONS), graph).collect()}
    assert got >= {("create_needs_a_token", 1), ("parent_required", 1), ("needs_an_existing_record", 2), ("nothing_to_change", 2), ("unknown_record", 3), ("dangling_token", 4), ("unknown_reference", 4), ("token_used_twice", 4), ("token_used_twice", 5), ("unknown_reference", 5), ("unknown_operation", 6), ("unknown_target_type", 6)}


def test_import_changes(graph, spark):  # noqa: F811
    rows = spark.createDataFrame([(1, "Carol", "Retired"), (2, "New", "Live")], "row_number int, owner string, s string")
    found = importing.identify(rows, graph.objects, "app", match=("owner", "owner"))
    plan = importing.plan_objects(found, graph.objects, graph.attribute_defs, "app", {"s": "attributes.status", "owner": "attributes.owner"}, match="owner")
    changes, evidence = change_plan.import_changes(importing.unblocked(plan), "3", "app", "apps.csv")
    after = overlay.overlay(graph.objects, changes, "object").where("is_proposed").collect()
    assert sorted(r["attributes"]["status"] for r in after) == ["Live", "Retired"] and ids(changes) == ids(evidence, "change_id")
    assert sorted(r["locator"] for r in evidence.collect()) == ["row 1", "row 2"]


def test_templates(graph, spark):  # noqa: F811
    doc = {
        "object_types": [{"key": "server", "name": "Server", "attributes": [{"key": "os", "name": "OS", "data_type": "text"}]}],
        "relationship_types": [{"key": "near", "name": "Near"}],
        "objects": [{"key": "s1", "name": "One", "type": "server", "attributes": {"os": "x"}}, {"key": "s2", "name": "Two", "type": "server"}],
        "relationships": [{"type": "near", "source": "s1", "target": "s2"}],
    }
    plan = templates.operations(spark, doc)
    assert change_plan.problems(plan, graph).count() == 0
    changes = change_plan.compiled(plan, "9")
    assert {r["target_type"]: r["count"] for r in changes.groupBy("target_type").count().collect()} == {"object_type": 1, "relationship_type": 1, "attribute_definition": 1, "object": 2, "relationship": 1}
    rows = [["k1", "Name, with comma", None], ["k2", "<b>", "Live"]]
    headers = ["key", "name", "status"]
    for name, data in (("t.csv", templates.csv_template(headers, rows)), ("t.xlsx", templates.xlsx_template(headers, rows, {"status": ["Live", "Retired"]}))):
        assert tables.parse(name, data) == (headers, [(2, rows[0]), (3, rows[1])])
    assert templates.zipped({"a": b"1"})[:2] == b"PK"
