"""Operators on small hand-made graphs, against plain Python where a loop is the plainest statement."""

import random
import re

import pytest
from pyspark.sql import functions as F

from typegrove import schema
from typegrove.functions import text, values
from typegrove.operators import commit, context, details, facets, importing, keys, overlay, projection, provenance, publication, reach, review, search, styles, tasks, validation
from typegrove.operators import dataset as ds
from typegrove.operators.predicates import in_text_range, matches
from typegrove.plans.query import Filter, Query, Scope, clean_scope, from_params, to_state


def types(spark, *rows):
    return spark.createDataFrame([(i, i, i.capitalize(), a, n, "") for n, (i, a) in enumerate(rows)], schema.OBJECT_TYPES)


def definitions(spark, *rows):
    full = []
    for n, r in enumerate(rows):
        d = dict(owner_kind="object", required=False, nullable=True, is_active=True, min_length=None, max_length=None, least=None, most=None, choices=None) | r
        full.append((f"{d['owner_id']}.{d['key']}", d["owner_kind"], d["owner_id"], d["key"], d["key"].capitalize(), d["data_type"], d["required"], d["nullable"], n, d["is_active"], d["min_length"], d["max_length"], d["least"], d["most"], d["choices"]))
    return spark.createDataFrame(full, schema.ATTRIBUTE_DEFS)


@pytest.fixture(scope="module")
def graph(spark):
    objects = [
        ("p1", "person", "alice", "Alice", "", {"email": "alice@example.com"}, True),
        ("p2", "person", "bob", "Bob", "", {}, True),
        ("p3", "person", "alice_2", "Alice", "", {"email": "  "}, True),
        ("t1", "team", "ops", "Ops", "", {}, True),
        ("a1", "app", "portal", "Web Portal", "", {"status": "Live", "owner": "Carol", "users": "1200", "launched": "2021-03-01T10:00", "critical": "true"}, True),
        ("a2", "app", "billing", "Billing", "", {"status": "Retired", "owner": "Dave", "users": "40", "launched": "2015-06-10", "critical": "false"}, True),
        ("a3", "app", "straße", "Straße", "", {"status": "Live"}, True),
        ("x1", "ghost", "x", "Unknown type", "", {}, True),
    ]
    edges = [
        ("r1", "member", "p1", "t1", {}, True),
        ("r2", "member", "p2", "t1", {}, True),
        ("r3", "uses", "t1", "a1", {}, True),
        ("r4", "uses", "t1", "a2", {}, True),
        ("r5", "uses", "a1", "a1", {}, True),
        ("r6", "uses", "t1", "a2", {}, True),
        ("r7", "uses", "t1", "gone", {}, True),
    ]
    d = schema.Dataset(
        types(spark, ("person", True), ("team", True), ("app", True), ("old", False)),
        types(spark, ("member", True), ("uses", True)),
        spark.createDataFrame([("m", "member", "person", "team", 0, None, 0, None), ("u", "uses", "team", "app", 1, None, 0, 1)], schema.RULES),
        definitions(
            spark,
            dict(owner_id="person", key="email", data_type="text"),
            dict(owner_id="app", key="status", data_type="choice", choices=["Live", "Retired", "Planned"]),
            dict(owner_id="app", key="owner", data_type="text"),
            dict(owner_id="app", key="users", data_type="number"),
            dict(owner_id="app", key="launched", data_type="datetime"),
            dict(owner_id="app", key="critical", data_type="boolean"),
        ),
        spark.createDataFrame(objects, schema.OBJECTS),
        spark.createDataFrame(edges, schema.RELATIONSHIPS),
    )
    return ds.sound(d)


def ids(df, column="id"):
    return sorted(r[column] for r in df.select(column).collect())


# ---- invariants, adjacency, degree


def test_invariants(graph):
    assert ids(graph.objects) == ["a1", "a2", "a3", "p1", "p2", "p3", "t1"]
    assert ids(graph.relationships) == ["r1", "r2", "r3", "r4", "r5", "r6"]


def test_degree_counts_loops_once_and_parallel_edges_each(graph):
    got = {r["id"]: r["degree"] for r in ds.degree(graph.objects, graph.relationships).collect()}
    assert got == {"a1": 2, "a2": 2, "a3": 0, "p1": 1, "p2": 1, "p3": 0, "t1": 5}


def test_rules_and_types(graph):
    got = {r["id"]: r["rule_id"] for r in ds.rule_of_edges(graph).collect()}
    assert got == {"r1": "m", "r2": "m", "r3": "u", "r4": "u", "r5": None, "r6": "u"}
    assert {(r["kind"], r["id"]) for r in ds.unused_types(graph).collect()} == {("object", "old")}
    assert ids(ds.keep_inactive_types_in_use(graph).object_types) == ["app", "person", "team"]


# ---- queries, filters, projection


def shown(graph, **kw):
    return [r["id"] for r in projection.shown_objects(graph, Query(**kw)).collect()]


def test_projection_order_limit_and_include(graph):
    assert shown(graph) == ["t1", "a2", "a1", "p1", "p2", "p3", "a3"]
    assert shown(graph, limit=3) == ["t1", "a2", "a1"]
    assert shown(graph, limit=2, include=("a3",)) == ["a3", "t1"]
    assert shown(graph, hide_objects=("app",), include=("a3",)) == ["a3", "t1", "p1", "p2", "p3"]


@pytest.mark.parametrize(
    "f,want",
    [
        (Filter("app", "status", "in", values=("live",)), {"a1", "a3"}),
        (Filter("app", "owner", "contains", text="AR"), {"a1"}),
        (Filter("app", "owner", "contains", text="%"), set()),
        (Filter("app", "users", "range", least=40.0, most=1200.0), {"a1", "a2"}),
        (Filter("app", "users", "range", least=41.0), {"a1"}),
        (Filter("app", "launched", "range", most="2021-03-01"), {"a1", "a2"}),
        (Filter("app", "launched", "range", least="2015-06-11"), {"a1"}),
        (Filter("app", "critical", "in", values=("true", "false")), {"a1", "a2"}),
        (Filter("app", "nothing", "in", values=("x",)), set()),
    ],
)
def test_filters(graph, f, want):
    assert set(ids(graph.objects.where(F.col("type_id") == "app").where(matches(f)))) == want


def test_filters_leave_other_types(graph):
    assert set(shown(graph, filters=(Filter("app", "status", "in", values=("retired",)),))) == {"t1", "a2", "p1", "p2", "p3"}


def test_blank_never_matches(graph):
    assert not ids(graph.objects.where(matches(Filter("person", "email", "contains", text=" "))))


def test_text_range_takes_in_the_whole_last_day(spark):
    df = spark.createDataFrame([("2021-03-01T23:59",), ("2021-03-02",), ("2021-03",)], "v string")
    assert [r[0] for r in df.where(in_text_range(F.col("v"), "2021-03", "2021-03-01")).collect()] == ["2021-03-01T23:59", "2021-03"]


def test_summary(graph):
    q = Query(hide_objects=("person",), filters=(Filter("app", "status", "in", values=("live",)),), include=("a2",), limit=2)
    got = projection.summary(graph, q).first().asDict()
    assert got == dict(total=7, matching=4, hidden_by_object_type=3, hidden_by_filter=0, included=1, shown=2, truncated=True)


def test_edges_of_a_projection(graph):
    p = projection.project(graph, Query(hide_relationships=("member",), limit=3))
    assert ids(p.edges) == ["r3", "r4", "r5", "r6"]


def test_exact_folding(graph):
    f = Filter("app", "owner", "contains", text="CAROL")
    assert ids(graph.objects.where(matches(f, exact=True))) == ["a1"]
    assert [r["id"] for r in search.search(graph, "STRASSE", exact=True).collect()] == ["a3"]
    assert search.search(graph, "STRASSE").count() == 0


def test_query_documents():
    kinds = {("app", "status"): "choice", ("app", "users"): "number", ("app", "link"): "url", ("app", "note"): "text"}
    raw = [
        {"type_id": "APP", "attribute": "status", "values": ["Live", "live", " "]},
        {"type_id": "app", "attribute": "users", "min": "3", "max": ""},
        {"type_id": "app", "attribute": "users", "min": "many"},
        {"type_id": "app", "attribute": "link", "value": "x"},
        {"type_id": "app", "attribute": "note", "operator": "in", "value": "x"},
        "junk",
    ]
    q, dropped = from_params({"hide_objects": ["app", "nope", "{APP}"], "filters": raw, "limit": "many", "include": ["A", "a"]}, {"app"}, set(), kinds)
    assert (q.hide_objects, q.limit, q.include, dropped.object_types, len(dropped.filters)) == (("app",), 300, ("a",), ["nope"], 4)
    assert q.filters == (Filter("app", "status", "in", values=("live",)), Filter("app", "users", "range", least=3.0))
    assert from_params(to_state(q), {"app"}, set(), kinds)[0] == q
    assert [from_params({"limit": n}, set(), set(), {})[0].limit for n in (0, "2", 5000)] == [1, 2, 1000]
    assert clean_scope({"depth": 9, "roots": ["{A}"]}, set(), set(), {}) == Scope(roots=("a",), depth=5)


# ---- search, facets, details


def test_search_tiers(graph):
    got = [(r["id"], r["tier"]) for r in search.search(graph, "alice").collect()]
    assert got == [("p1", search.NAME_EXACT), ("p3", search.NAME_EXACT)]
    assert [(r["id"], r["tier"], r["label"]) for r in search.search(graph, "EXAMPLE.com").collect()] == [("p1", search.ATTRIBUTE_CONTAINS, "Email")]
    assert search.search(graph, "true").count() == 0 and search.search(graph, "  ").count() == 0


def test_facets_fill_zeros(graph):
    got = {(r["facet"], r["type_id"], r["choice"]): r["n"] for r in facets.facets(graph).collect()}
    assert got[("choice", "app", "Live")] == 2 and got[("choice", "app", "Planned")] == 0 and got[("object_type", "old", "")] == 0
    assert got[("boolean", "app", "true")] == 1 and got[("relationship_type", "uses", "")] == 4


def test_mixed_values(graph):
    rows = graph.objects.where("type_id = 'app'")
    got = {r["key"]: (r["mixed"], r["value"]) for r in facets.mixed_values(rows, ["status", "owner", "none"]).collect()}
    assert got == {"status": (True, None), "owner": (True, None), "none": (False, None)}


def test_details(graph, spark):
    one = spark.createDataFrame([("t1",)], "id string")
    rows = details.object_details(graph, one, projection.shown_objects(graph, Query(limit=3)))
    assert sorted((r["edge_id"], r["direction"], r["in_view"]) for r in rows.collect()) == [("r1", "in", False), ("r2", "in", False), ("r3", "out", True), ("r4", "out", True), ("r6", "out", True)]
    assert details.extract(rows).first()["extract"] == "Member: Alice, Bob\nUses: Billing, Billing, Web Portal"
    assert ids(details.hidden_counterparts(graph, one, graph.objects.where("type_id = 'app'")), "other_id") == ["p1", "p2"]


# ---- reachability


def brute_reach(edges, roots, depth):
    hops = dict.fromkeys(roots, 0)
    front, n = set(roots), 0
    while front and (depth is None or n < depth):
        n += 1
        front = {b for a, b in edges + [(b, a) for a, b in edges] if a in front} - set(hops)
        hops |= dict.fromkeys(front, n)
    return hops


@pytest.mark.parametrize("seed", range(3))
@pytest.mark.parametrize("depth", [0, 1, 2, None])
def test_reachable(spark, seed, depth):
    rng = random.Random(seed)
    edges = [(f"n{rng.randrange(30)}", f"n{rng.randrange(30)}") for _ in range(25)]
    df = spark.createDataFrame([(str(i), "e", a, b, {}, True) for i, (a, b) in enumerate(edges)], schema.RELATIONSHIPS)
    roots = ["n0", "n5", "nowhere"]
    got = {r["id"]: r["hops"] for r in reach.reachable(spark.createDataFrame([(r,) for r in roots], "id string"), df, depth).collect()}
    assert got == brute_reach(edges, roots, depth)


def test_scope(graph):
    inside = lambda **kw: ids(reach.apply_scope(graph, Scope(**kw)).objects)
    assert inside(roots=("p1",), depth=1) == ["p1", "t1"]
    assert inside(roots=("p1",), exclude_objects=("team",)) == ["p1"]
    assert inside(roots=("t1",), exclude_objects=("team",)) == []
    assert inside(exclude_relationships=("member",), roots=("p1",)) == ["p1"]
    out = reach.apply_scope(graph, Scope(exclude_objects=("team",)))
    assert ids(out.rules) == [] and "person" in ids(out.object_types)


# ---- overlay


def log(spark, *rows):
    full = [(f"c{n}", r.get("p", "1"), n, r["op"], r.get("kind", "object"), r["id"], None, r.get("parent"), r.get("before"), r.get("after")) for n, r in enumerate(rows)]
    return spark.createDataFrame(full, schema.CHANGES)


def test_overlay(graph, spark):
    changes = log(
        spark,
        dict(op="update", id="p1", after='{"field": "name", "value": "First"}'),
        dict(op="update", id="p1", after='{"field": "name", "value": "Last"}'),
        dict(op="update", id="p1", after='{"field": "attributes.email", "value": null}'),
        dict(op="update", id="p2", after='{"field": "is_active", "value": false}'),
        dict(op="update", id="p2", after='{"field": "name"}'),
        dict(op="update", id="a1", after='{"field": "is_active", "value": false}'),
        dict(op="update", id="a1", after='{"field": "is_active", "value": true}'),
        dict(op="update", id="a1", after='{"field": "unheard_of", "value": 1}'),
        dict(op="delete", id="a2"),
        dict(op="create", id="n1", parent="person", after='{"name": "New", "attributes": {"email": "n@x.y"}}'),
        dict(op="create", id="n2", after='{"name": "No parent"}'),
        dict(op="create", id="n3", parent="person", after='{"name": "Inactive", "is_active": false}'),
        dict(op="create", id="p1", parent="person", after='{"name": "Twice"}'),
        dict(op="update", id="n1", after='{"field": "name", "value": "Newer"}'),
    )
    got = {r["id"]: r for r in overlay.overlay(graph.objects, changes, "object").collect()}
    assert sorted(got) == ["a1", "a3", "n1", "p1", "p3", "t1"]
    assert (got["p1"]["name"], got["p1"]["attributes"], got["p1"]["is_proposed"]) == ("Last", {"email": None}, True)
    assert (got["n1"]["name"], got["n1"]["attributes"], got["n1"]["type_id"]) == ("Newer", {"email": "n@x.y"}, "person")
    assert got["a1"]["attributes"]["owner"] == "Carol" and not got["t1"]["is_proposed"]


def test_overlay_reactivates(graph, spark):
    rows = graph.objects.withColumn("is_active", F.col("id") != "p2")
    changes = log(spark, dict(op="update", id="p2", after='{"field": "is_active", "value": true}'))
    assert "p2" in ids(overlay.overlay(rows, changes, "object"))


# ---- validation


def test_attribute_issues(spark):
    rows = spark.createDataFrame([(str(n), "t", j) for n, j in enumerate(['{"n": 3, "c": "x", "d": "2021-02-30", "w": "ok", "b": true}', '{"n": "3", "c": "q", "d": null, "w": "toolong", "b": "true"}', '{"n": 99, "zz": 1, "d": "2021-02-03", "w": "", "b": 1}'])], "id string, type_id string, attributes_json string")
    defs = definitions(
        spark,
        dict(owner_id="t", key="n", data_type="number", least=1.0, most=10.0),
        dict(owner_id="t", key="c", data_type="choice", choices=["x", "y"], required=True),
        dict(owner_id="t", key="d", data_type="date", nullable=False),
        dict(owner_id="t", key="w", data_type="text", min_length=1, max_length=3),
        dict(owner_id="t", key="b", data_type="boolean"),
    )
    got = sorted((r["target_id"], r["code"], r["field"][11:]) for r in validation.attribute_issues(schema.with_kinds(rows), defs, "object").collect())
    assert got == [
        ("0", "invalid_date", "d"),
        ("1", "invalid_attribute_type", "b"),
        ("1", "invalid_attribute_type", "n"),
        ("1", "invalid_choice", "c"),
        ("1", "null_not_allowed", "d"),
        ("1", "value_above_maximum", "w"),
        ("2", "invalid_attribute_type", "b"),
        ("2", "required_attribute", "c"),
        ("2", "unknown_attribute", "zz"),
        ("2", "value_above_maximum", "n"),
        ("2", "value_below_minimum", "w"),
    ]


def test_cardinality(graph):
    got = {(r["code"], r["field"], r["target_id"]) for r in validation.cardinality_issues(graph).collect()}
    # one app per team at most; every app needs a team
    assert got == {("object_cardinality_maximum", "u", "t1"), ("subject_cardinality_minimum", "u", "a3")}


def test_structure_pairs_and_fields(graph, spark):
    bad = definitions(spark, dict(owner_id="t", key="Bad Key", data_type="text"), dict(owner_id="t", key="c", data_type="choice", choices=["a", "a"]), dict(owner_id="t", key="n", data_type="number", least=5.0, most=1.0), dict(owner_id="t", key="ok", data_type="url"), dict(owner_id="t", key="gone", data_type="choice", is_active=False))
    assert ids(validation.structural_issues(graph.with_(attribute_defs=bad)), "target_id") == ["t.Bad Key", "t.c", "t.n"]
    assert ids(validation.pair_issues(graph), "target_id") == ["r5"]
    rows = graph.objects.withColumn("name", F.when(F.col("id") == "p1", F.lit(" \t")).when(F.col("id") == "p2", F.repeat(F.lit("x"), 256)).otherwise(F.col("name")))
    assert {(r["code"], r["target_id"]) for r in validation.field_issues(rows, "object").collect()} == {("name_required", "p1"), ("name_too_long", "p2")}
    assert {r["code"] for r in validation.validate(graph).collect()} >= {"object_cardinality_maximum", "invalid_relationship_types"}


# ---- text and values


def test_text_functions(spark):
    df = spark.createDataFrame([("  Éa  b\tc ", "Über Straße!", "{A0EEBC99-9C0B-4EF8-BB6D-6BB9BD380A11}", "30.0")], "a string, b string, c string, d string")
    r = df.select(text.squeeze("a"), text.slug(F.col("b")), text.uuid_of(F.col("c")), text.without_zero_fraction(F.col("d")), text.snippet(F.repeat(F.lit("x"), 90)), text.fold(F.col("b"), exact=True), text.bounds_label(F.lit(1), F.lit(None).cast("int")), text.field_label(F.lit("sort_order"))).first()
    assert list(r) == ["Éa b c", "uber_strae", "a0eebc99-9c0b-4ef8-bb6d-6bb9bd380a11", "30", "x" * 79 + "…", "über strasse!", "1..*", "Sort Order"]
    df = spark.createDataFrame([(None,), ("",), (" \t\n",), ("0",), (" ",)], "x string")
    assert [r[0] for r in df.select(text.is_blank(F.col("x"))).collect()] == [True, True, True, False, True]
    urls = spark.createDataFrame([("http://a.b",), ("HTTPS://x",), ("javascript:alert(1)",), (None,)], "u string")
    assert [r[0] for r in urls.select(text.is_web_url(F.col("u"))).collect()] == [True, True, False, False]


def test_coercion(spark):
    rows = [("1_000", "number"), ("3.0", "number"), ("x", "number"), ("ON", "boolean"), ("maybe", "boolean"), ("2021-02-03", "date"), ("2021-02-30", "date"), ("2021-02-03 10:00", "datetime"), (" ", "text"), (" a ", "text")]
    got = [tuple(r[0]) for r in spark.createDataFrame(rows, "c string, t string").select(values.coerce(F.col("c"), F.col("t"))).collect()]
    assert got == [("1000", "number", True), ("3", "number", True), ("x", "string", False), ("true", "boolean", True), ("maybe", "string", False), ("2021-02-03", "string", True), ("2021-02-30", "string", False), ("2021-02-03T10:00:00", "string", True), (None, "null", True), ("a", "string", True)]


def test_identity_is_strict(spark):
    rows = [("1", "number", "1.0", "number", True), ("1", "string", "1", "number", False), ("true", "boolean", "1", "number", False), ("a", "string", "A", "string", False), (None, "null", None, "null", True)]
    df = spark.createDataFrame(rows, "a string, ak string, b string, bk string, same boolean")
    got = df.select("same", values.same_value(F.col("a"), F.col("ak"), F.col("b"), F.col("bk")).alias("s"), values.identity_key(F.col("a"), F.col("ak")).alias("k")).collect()
    assert all(r["same"] == r["s"] for r in got) and [r["k"] is None for r in got] == [False, False, True, False, True]


# ---- keys


def brute_keys(requests, taken):
    used = set(taken)
    out = {}
    for seq, base in requests:
        n, key = 1, base
        while key in used:
            n += 1
            key = base[: 100 - len(f"_{n}")] + f"_{n}"
        used.add(key)
        out[seq] = key
    return out


@pytest.mark.parametrize(
    "requests,taken",
    [
        ([["alpha", "beta", "x" * 100][i % 3] for i in range(40)], ["alpha", "alpha_3", "beta_2", "beta_20", "x" * 98 + "_2", "other"]),
        (["A", "A", "A 2"], []),
        (["A 2", "A", "A", "A 2 2", "A 2", "A"], ["a_3"]),
        (["x" * 100, "x" * 98 + " 2", "x" * 100, "x" * 99, "x" * 100] * 3, []),
        (["", "!", "Item", "item 2", "é", "E"], ["item_3"]),
    ],
)
def test_key_allocation(spark, requests, taken):
    rows = [(i, r) for i, r in enumerate(requests)]
    got = keys.allocate(spark.createDataFrame([("s", i, b) for i, b in rows], "scope string, seq int, name string"), spark.createDataFrame([("s", k) for k in taken] + [("t", "beta")], "scope string, key string"))
    assert {r["seq"]: r["key"] for r in got.collect()} == sequential_keys(rows, taken)


def sequential_keys(requests, taken):
    """One request after another, as by hand."""
    import unicodedata

    used, out = set(taken), {}
    for seq, name in requests:
        plain = unicodedata.normalize("NFKD", name).encode("ascii", "ignore").decode()
        base = re.sub("[^a-z0-9]+", "_", plain.lower()).strip("_")[:100].strip("_") or "item"
        key, n = base, 2
        while key in used:
            key, n = base[: 100 - len(f"_{n}")] + f"_{n}", n + 1
        used.add(key)
        out[seq] = key
    return out


# ---- import


def test_identify(graph, spark):
    rows = spark.createDataFrame([(1, "alice", None), (2, None, "p2"), (3, "alice", "p2"), (4, "zed", None), (5, None, "t1"), (6, None, "junk"), (7, None, None), (8, " alice ", "p1")], "row_number int, k string, i string")
    got = {r["row_number"]: (r["object_id"], r["problem"]) for r in importing.identify(rows, graph.objects, "person", key="k", id_="i").collect()}
    assert got[1] == ("p1", None) and got[2] == ("p2", None) and got[8] == ("p1", None)
    assert [got[i][1] for i in (3, 4, 5, 6, 7)] == ["identity_mismatch", "unresolved_identity", "wrong_object_type", "invalid_identity_id", "missing_identity"]


def test_plan_objects(graph, spark):
    rows = spark.createDataFrame([(1, "Carol", "Live", "5"), (2, "Carol", "Retired", "1200"), (3, "New", "Live", None), (4, "Dave", "Retired", "40")], "row_number int, owner string, s string, u string")
    found = importing.identify(rows, graph.objects, "app", match=("owner", "owner"))
    plan = importing.plan_objects(found, graph.objects, graph.attribute_defs, "app", {"s": "attributes.status", "u": "attributes.users", "owner": "attributes.owner"}, match="owner")
    got = sorted((r["operation"], r["identity"], r["field"], r["new"]) for r in importing.unblocked(plan).collect())
    assert got == [("create", "new:New", "attributes.owner", "New"), ("create", "new:New", "attributes.status", "Live"), ("update", "a1", "attributes.status", "Retired")]
    assert plan.summary.first().asDict() == dict(creates=1, updates=1, unchanged=1, field_changes=1, unconverted=0)
    twice = importing.identify(rows.withColumn("owner", F.lit("  ")), graph.objects, "app", match=("owner", "owner"))
    with pytest.raises(ValueError, match="problems"):
        importing.unblocked(importing.plan_objects(twice, graph.objects, graph.attribute_defs, "app", {"s": "attributes.status"}, match="owner"))


def test_plan_edges(graph, spark):
    rows = spark.createDataFrame([(1, "ops", "portal"), (2, "ops", "straße"), (3, "ops", "straße"), (4, "ops", "nope"), (5, "alice", "portal"), (6, "ops", "billing"), (7, "", "portal")], "row_number int, s string, o string")
    rows = importing.resolve_endpoints(rows, "s", graph.objects, ["team", "person"])
    rows = importing.resolve_endpoints(rows, "o", graph.objects, ["app"], prefix="object")
    plan = importing.plan_edges(rows, graph.rules, graph.relationships, "uses")
    assert [r["identity"] for r in plan.changes.collect()] == ["uses:t1:a3"]
    assert {r["row_number"]: r["code"] for r in plan.problems.collect()} == {4: "unresolved_endpoint", 5: "endpoint_pair_not_allowed", 6: "ambiguous_relationship", 7: "missing_endpoint"}


def test_plan_edge_values(graph, spark):
    links = spark.createDataFrame([("r3", "uses", "t1", "a1", {"since": "2020-01-01", "load": "5"}, True), ("r5", "uses", "a1", "a1", {}, True)], schema.RELATIONSHIPS)
    defs = definitions(spark, dict(owner_id="uses", key="since", data_type="date"), dict(owner_id="uses", key="load", data_type="number"))
    rows = spark.createDataFrame([(1, "ops", "portal", "2020-01-01", "6"), (2, "ops", "portal", "2020-01-01", " 5.0 "), (3, "ops", "straße", "", "many"), (4, "ops", "billing", "", ""), (5, "ops", "nope", "", "")], "row_number int, s string, o string, since string, load string")
    rows = importing.resolve_endpoints(rows, "s", graph.objects, ["team"])
    rows = importing.match_edges(importing.resolve_endpoints(rows, "o", graph.objects, ["app"], prefix="object"), graph.rules, links, "uses")
    plan = importing.plan_edge_values(rows, links, defs, "uses", {"since": "attributes.since", "load": "attributes.load"})
    got = sorted((r["operation"], r["identity"], r["field"], r["new"], r["converted"]) for r in plan.changes.collect())
    assert got == [("create", "uses:t1:a2", "is_active", "true", True), ("create", "uses:t1:a3", "attributes.load", "many", False), ("create", "uses:t1:a3", "is_active", "true", True)]
    assert plan.summary.first().asDict() == dict(creates=2, updates=0, unchanged=1, field_changes=0, unconverted=1, duplicate_identities=1, duplicate_rows=2)
    assert [(r["row_number"], r["code"]) for r in plan.problems.collect()] == [(5, "unresolved_endpoint")]
    by_id = importing.identify_edges(spark.createDataFrame([(1, "r3", "", "no"), (2, "r9", "8", "")], "row_number int, id string, load string, active string"), links, "uses", "id")
    plan = importing.plan_edge_values(by_id, links, defs, "uses", {"load": "attributes.load", "active": "is_active"})
    assert sorted((r["operation"], r["identity"], r["field"], r["old"], r["new"]) for r in plan.changes.collect()) == [("update", "r3", "attributes.load", "5", None), ("update", "r3", "is_active", "true", "false")]
    assert plan.problems.count() == 1
    assert importing.plan_edge_values(by_id.limit(0), links, defs, "uses", {"load": "attributes.load"}).summary.first()["updates"] == 0


def test_labels_of_edges_and_created_records(graph, spark):
    changes = log(
        spark,
        dict(op="update", id="r1", kind="relationship", after='{"field": "is_active", "value": false}'),
        dict(op="create", id="n1", after='{"name": "New one"}', parent="person"),
        dict(op="create", id="r9", kind="relationship", parent="member", after='{"source_id": "n1", "target_id": "nowhere"}'),
        dict(op="delete", id="lost", kind="relationship"),
        dict(op="delete", id="u", kind="relationship_type_rule"),
    ).withColumn("parent_type", F.when(F.col("parent_id") == "person", "object_type").when(F.col("parent_id") == "member", "relationship_type"))
    got = [(r["target_id"], r["target_label"], r["parent_label"]) for r in review.with_labels(changes, graph).orderBy("seq").collect()]
    assert got == [("r1", "Alice → Ops", None), ("n1", "New one", "Person"), ("r9", "New one → Untitled", "Member"), ("lost", "Untitled", None), ("u", "Team → App", None)]


def test_suggest_fields(spark):
    headers = spark.createDataFrame([(1, "E-mail"), (2, "email"), (3, "Full Name"), (4, "??")], "position int, header string")
    fields = spark.createDataFrame([("email", "Email", []), ("name", "Name", ["full name"])], "field string, label string, synonyms array<string>")
    assert sorted((r["position"], r["field"]) for r in importing.suggest_fields(headers, fields).collect()) == [(1, "email"), (3, "name")]


# ---- commit


def test_commit(graph, spark, tmp_path):
    fine = graph.with_(rules=graph.rules.where("id = 'm'"), relationships=graph.relationships.where("type_id = 'member'"))
    model = commit.Model(spark, str(tmp_path / "model"))
    assert model.revision() == 0
    model.create(fine)
    good = log(spark, dict(op="update", id="p1", after='{"field": "name", "value": "Ann"}'), dict(op="create", id="e9", kind="relationship", parent="member", after='{"source_id": "p3", "target_id": "t1"}'))
    done = model.commit(good, base_revision=1)
    assert (done.committed, done.revision, model.revision()) == (True, 2, 2)
    now = model.read()
    assert {r["name"] for r in now.objects.where("id = 'p1'").collect()} == {"Ann"} and "e9" in ids(now.relationships)
    bad = log(spark, dict(op="update", id="p1", after='{"field": "name", "value": ""}'), dict(op="update", id="zz", after='{"field": "key", "value": "k"}'))
    failed = model.commit(bad)
    codes = {(r["code"], r["change_id"]) for r in failed.issues.collect()}
    assert not failed.committed and model.revision() == 2
    assert codes == {("name_required", "c0"), ("target_not_found", "c1"), ("invalid_change", "c1"), ("key_immutable", "c1")}
    assert {r["name"] for r in model.read(1).objects.where("id = 'p1'").collect()} == {"Alice"}
    with pytest.raises(ValueError, match="revision"):
        model.commit(good, base_revision=1)


def test_commit_keeps_retired_records(graph, spark, tmp_path):
    """Retired records stay in storage and are hidden by the view only; they can be made active again."""
    sound = graph.with_(rules=graph.rules.where("id = 'm'"), relationships=graph.relationships.where("type_id = 'member'"))
    retired = sound.with_(objects=sound.objects.withColumn("is_active", F.col("id") != "p2"))
    every = ids(ds.sound(sound).objects)
    after = commit.apply(retired, log(spark))
    assert ids(after.objects) == every and after.objects.where("not is_active").count() == 1
    again = commit.apply(retired, log(spark, dict(op="update", id="p2", after='{"field": "is_active", "value": true}'), dict(op="update", id="p1", after='{"field": "is_active", "value": false}')))
    assert ids(again.objects) == every and ids(again.objects.where("not is_active")) == ["p1"]
    assert ids(overlay.overlay(retired.objects, log(spark), "object")) == [x for x in every if x != "p2"]


def test_commit_of_types_definitions_and_rules(graph, spark):
    changes = log(
        spark,
        dict(op="create", id="site", kind="object_type", after='{"name": "Site", "key": "site", "description": "A place"}'),
        dict(op="update", id="person", kind="object_type", after='{"field": "description", "value": "Someone"}'),
        dict(op="update", id="person", kind="object_type", after='{"field": "sort_order", "value": 7}'),
        dict(op="create", id="d9", kind="attribute_definition", parent="site", after='{"name": "Floor", "key": "floor", "data_type": "choice", "choices": ["1", "2"]}'),
        dict(op="create", id="r9", kind="relationship_type_rule", parent="member", after='{"subject_type_id": "site", "object_type_id": "person", "s_min": 0, "o_min": 1, "o_max": 3}'),
        dict(op="create", id="o9", parent="site", after='{"name": "North", "attributes": {"floor": "2"}, "is_active": false}'),
    ).withColumn("parent_type", F.when(F.col("target_id") == "r9", "relationship_type").otherwise("object_type"))
    after = commit.apply(graph, changes)
    types = {r["id"]: (r["name"], r["description"], r["sort_order"], r["is_active"]) for r in after.object_types.collect()}
    assert types["site"] == ("Site", "A place", None, True) and types["person"][1:3] == ("Someone", 7)
    d = after.attribute_defs.where("id = 'd9'").first()
    assert (d["owner_kind"], d["owner_id"], d["data_type"], d["choices"], d["required"], d["nullable"], d["is_active"]) == ("object", "site", "choice", ["1", "2"], False, True, True)
    r = after.rules.where("id = 'r9'").first()
    assert (r["rel_type_id"], r["subject_type_id"], r["object_type_id"], r["s_min"], r["s_max"], r["o_min"], r["o_max"]) == ("member", "site", "person", 0, None, 1, 3)
    assert after.objects.where("id = 'o9' and not is_active").count() == 1
    twice = log(spark, dict(op="create", id="r8", kind="relationship_type_rule", parent="member", after='{"subject_type_id": "person", "object_type_id": "team"}'), dict(op="update", id="d1x", kind="attribute_definition", after='{"field": "colour", "value": 1}'), dict(op="delete", id="person", kind="object_type"))
    codes = {(r["code"], r["target_id"]) for r in commit.change_issues(graph, twice).collect()}
    assert {("duplicate_rule", "r8"), ("invalid_change", "d1x"), ("target_not_found", "d1x"), ("protected_reference", "person")} <= codes


def test_commit_of_two_writers_and_of_one_token(graph, spark, tmp_path):
    fine = graph.with_(rules=graph.rules.where("id = 'm'"), relationships=graph.relationships.where("type_id = 'member'"))
    model = commit.Model(spark, str(tmp_path / "model"))
    model.create(fine)
    good = log(spark, dict(op="update", id="p1", after='{"field": "name", "value": "Ann"}'))
    assert model.commit(good, token="t").revision == 2
    assert model.commit(good, token="t").revision == 2 and model.revision() == 2
    name = model._stage(fine)
    with pytest.raises(commit.Conflict):
        model._publish(2, name, None)
    assert model.read().objects.where("id = 'p1'").first()["name"] == "Ann"
    late = commit.Model(spark, model.path)
    late.revision = lambda: 1  # a writer that looked before the other was done
    with pytest.raises(commit.Conflict):
        late.commit(good)
    assert model.revision() == 2 and model.read_consistent(lambda d: d.objects.count()) == (2, fine.objects.count())


def test_bulk_edit_and_discard(graph, spark):
    rows = commit.bulk_edit(graph.objects, ["a1", "a2"], {"attributes.status": "Live", "attributes.owner": None}, 10, "9")
    assert sorted((r["target_id"], r["after_json"]) for r in rows.collect()) == [("a1", '{"field":"attributes.owner","value":null}'), ("a2", '{"field":"attributes.owner","value":null}'), ("a2", '{"field":"attributes.status","value":"Live"}')]
    with pytest.raises(ValueError, match="exist"):
        commit.bulk_edit(graph.objects, ["a1", "no"], {}, 0, "9")
    changes = log(spark, dict(op="create", id="T", kind="object_type", after="{}"), dict(op="create", id="o", parent="T", after="{}"), dict(op="create", id="e", kind="relationship", parent="uses", after='{"source_id": "t1", "target_id": "o"}'), dict(op="create", id="k", parent="person", after="{}"))
    assert ids(commit.discard(changes, spark.createDataFrame([("T",)], "target_id string")), "target_id") == ["k"]


def test_queue(spark):
    p = spark.createDataFrame([("b", "queued", "2"), ("a", "queued", "2"), ("c", "processing", "1")], "id string, status string, submitted_at string")
    assert ids(commit.next_in_queue(p)) == ["a"]


# ---- provenance, review, context, styles


def test_provenance(spark):
    rows = [dict(op="update", id="p1", p=str(i), after='{"field": "name", "value": "v%d"}' % i) for i in range(30)]
    rows += [dict(op="delete", id="p1", p="29"), dict(op="update", id="p1", p="failed", after='{"field": "name", "value": "no"}')]
    p = spark.createDataFrame([(str(i), "u", "", "completed", i) for i in range(30)] + [("failed", "u", "", "failed", 0)], "id string, created_by string, title string, status string, completed_at int")
    r = spark.createDataFrame([(str(i), "completed", i) for i in range(30)], "proposal_id string, outcome string, after_revision int")
    got = provenance.entries(log(spark, *rows), p, r)
    assert sorted({x["proposal_id"] for x in got.collect()}, key=int) == [str(i) for i in range(5, 30)] and got.where("truncated").count() == got.count() == 26
    assert {x["summary"] for x in got.where("proposal_id = '29'").collect()} == {"Renamed to v29", "Deleted"}


def test_context_fits(graph, spark):
    seeds = spark.createDataFrame([("p1",)], "id string")
    assert [r["id"] for r in context.slice_(graph, seeds, most=3).collect()] == ["p1", "t1", "a2"]
    objects, edges = context.packet(graph, seeds, most_bytes=700)
    assert 1 <= objects.count() < 7
    assert sum(context.serialised_size(x).first()[0] for x in (objects, edges)) <= 700


def test_styles_and_reviews(graph, spark):
    own = spark.createDataFrame([("app", {"color": "red"})], "type_id string, style map<string,string>")
    got = {r["type_id"]: r["style"] for r in styles.layered(graph.object_types, {"color": "grey", "size": "1"}, {"size": "2"}, own).collect()}
    assert got["app"] == {"color": "red", "size": "2"} and got["team"] == {"color": "grey", "size": "2"}
    assert ids(review.index(graph.objects, "ali", sort="-name")) == ["p1", "p3"]
    assert review.inactive_matches(graph.objects.withColumn("is_active", F.col("id") != "p1"), "alice").first().asDict() == dict(hidden=1, shown=1)


# ---- publications, tasks


def test_opening_and_select_all(graph, spark):
    assert publication.opening({"kind": "object", "id": "p1"}, graph).id == "p1"
    assert publication.opening({"kind": "object", "id": "zz"}, graph) == publication.opening({"kind": "x", "id": "p1"}, graph) == publication.Opening(None, None, ("selection",))
    assert publication.opening(None, graph).dropped == ()
    rows = spark.createDataFrame([("a", True, False), ("b", True, True), ("c", False, False)], "type_id string, applicable boolean, excluded boolean")
    assert tuple(publication.select_all(rows).first()) == (False, True, False)
    assert tuple(publication.select_all(rows.where("type_id = 'a'")).first()) == (True, False, False)
    assert tuple(publication.select_all(rows.where("type_id = 'c'")).first()) == (False, False, True)


def test_provenance_of_published_ends(graph, spark):
    changes = log(spark, dict(op="create", id="r1", kind="relationship", parent="member", after='{"source_id": "p1", "target_id": "t1"}'), dict(op="update", id="p2", after='{"field": "name", "value": "B"}'))
    p = spark.createDataFrame([("p", "me", "", "completed", "1")], "id string, created_by string, title string, status string, completed_at string")
    changes = changes.withColumn("proposal_id", F.lit("p"))
    r = spark.createDataFrame([("p", "completed", 2)], "proposal_id string, outcome string, after_revision long")
    shown = graph.with_(objects=graph.objects.where("id = 'p1'"))
    (row,) = publication.published_provenance(shown, changes, p, r).collect()
    assert (row["target_id"], row["source_name"], row["target_name"]) == ("r1", "Alice", publication.OUTSIDE)


def test_fingerprint():
    one = tasks.fingerprint("m", "t", ["b", "a"], {"x": None, "y": "1"}, ("p", 3))
    assert one == tasks.fingerprint("m", "t", ["a", "b"], {"y": "1", "x": None}, ("p", 3))
    assert len({one, tasks.fingerprint("m", "t", ["a"], {"y": "1", "x": None}, ("p", 3)), tasks.fingerprint("m", "t", ["a", "b"], {"y": "1", "x": ""}, ("p", 3)), tasks.fingerprint("m", "t", ["a", "b"], {"y": "1", "x": None}, ("p", 4))}) == 4


def test_import_preview(spark):
    changes = spark.createDataFrame([("create", f"n{i}", 40 - i) for i in range(40)], "operation string, identity string, first_row int")
    problems = spark.createDataFrame([(i, "x") for i in range(130)], "row_number int, code string")
    first, bad, totals = importing.preview(importing.Plan(changes, problems, changes))
    assert [r["first_row"] for r in first.collect()] == list(range(1, 26)) and bad.count() == 100 and tuple(totals.first()) == (40, 130)
