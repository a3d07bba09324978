"""Claims, snapshots, adjacency, cascades, validity, and numbers within hot groups."""

import json
import random
import threading
from collections import Counter

import pytest
from pyspark.sql import functions as F

from typegrove import schema
from typegrove.operators import commit, details, keys, reach, validity
from typegrove.operators.claims import Claims, work
from typegrove.operators.commit import Outcome
from typegrove.operators.numbering import places, sums_before
from typegrove.shared import Steps
from typegrove.sources import export
from typegrove.sources.snapshots import Snapshots

from .test_operators import graph, ids, log  # noqa: F401

# ---- claims

PROPOSALS = "id string, status string, submitted_at string"


class FakeModel:
    """Counts what it commits, once a token."""

    def __init__(self):
        self.done, self.lock = Counter(), threading.Lock()

    def commit(self, changes, token=None):
        with self.lock:
            self.done[token] += 1
        return Outcome(self.done.total(), True, None)


def test_two_workers_never_process_one_change_set(spark, tmp_path):
    queue = spark.createDataFrame([(f"p{k}", "queued", str(k)) for k in range(6)] + [("x", "working", "0")], PROPOSALS).cache()
    model, got = FakeModel(), []
    changes = spark.createDataFrame([], schema.CHANGES)
    threads = [threading.Thread(target=lambda w=w: got.extend(work(model, Claims(spark, str(tmp_path)), queue, changes, f"w{w}"))) for w in range(3)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    assert model.done == Counter({f"p{k}": 1 for k in range(6)}) and sorted(p for p, _ in got) == [f"p{k}" for k in range(6)]
    assert {r["state"] for r in Claims(spark, str(tmp_path)).states().collect()} == {"done"}


def test_a_stale_claim_is_taken_over_once(spark, tmp_path):
    now = [0.0]
    claims = [Claims(spark, str(tmp_path), seconds=10, clock=lambda: now[0]) for _ in range(4)]
    queue = spark.createDataFrame([("a/b", "queued", "1"), ("c", "processing", "2")], PROPOSALS)
    dead = claims[0].next(queue, "dead")
    assert dead.proposal_id == "a/b" and claims[1].take("a/b", "w1") is None and claims[1].next(queue, "w1").proposal_id == "c"
    now[0] = 11.0
    assert ids(claims[1].queue(queue)) == ["a/b", "c"]
    taken = []
    threads = [threading.Thread(target=lambda c=c, k=k: taken.append(c.take("a/b", f"w{k}"))) for k, c in enumerate(claims)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    (lease,) = [x for x in taken if x]
    assert claims[0].renew(dead) is None and not claims[0].finish(dead, Outcome(1, True, None))  # the dead one wakes up
    longer = claims[1].renew(lease)
    assert longer.until == 21.0 and claims[1].finish(longer, Outcome(2, False, None))
    now[0] = 1000.0
    assert claims[2].take("a/b", "late") is None
    last = claims[0].last("a/b")
    assert (last["state"], last["committed"], last["revision"], last["owner"]) == ("done", False, 2, lease.owner)


# ---- snapshots


def lines_of(spark, n, odd=()):
    return spark.createDataFrame([("object" if k % 3 else "rule", f"id{k}", json.dumps({"id": k, "v": "new" if k in odd else "old"})) for k in range(n)], "part string, id string, value string")


def rows_of(df):
    return sorted(tuple(r) for r in df.select("part", "id", "value").collect())


def rows_at(df):
    return sorted((r["part"], r["block"]) for r in df.collect())


def test_snapshots_share_what_did_not_change(spark, tmp_path):
    s = Snapshots(spark, str(tmp_path), block=8)
    first, second = lines_of(spark, 300), lines_of(spark, 300, odd=(7, 8))
    assert s.add(first.repartition(5), 1)[0] == 1 and s.add(second, 2)[0] == 2
    old, new = s.leaves(1), s.leaves(2)
    assert old.count() == new.count() > 30
    written = new.where(F.col("folder") == s.entry(2)["folder"])
    touched = s.read(2).where("id in ('id7', 'id8')").select("part", "block").distinct()
    assert rows_at(written) == rows_at(touched)  # the blocks of two changed records
    again, digest = s.add(first.repartition(3), 3)
    assert (again, digest) == (3, s.entry(1)["digest"]) and digest != s.entry(2)["digest"]
    for n, want in ((1, first), (2, second), (None, first)):
        assert rows_of(s.read(n)) == rows_of(want) and s.verify(n)
    assert [r["sequence"] for r in s.manifest().orderBy("sequence").collect()] == [1, 2, 3]
    with pytest.raises(ValueError):
        s.entry(9)


def test_two_publishers_get_two_numbers(spark, tmp_path):
    got = []
    threads = [threading.Thread(target=lambda k=k: got.append((Snapshots(spark, str(tmp_path)).add(lines_of(spark, 10 + k), k), k))) for k in range(3)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    assert sorted(seq for (seq, _), _ in got) == [1, 2, 3]
    s = Snapshots(spark, str(tmp_path))
    for (seq, digest), k in got:
        assert s.entry(seq)["digest"] == digest and s.read(seq).count() == 10 + k and s.verify(seq)


def test_a_damaged_snapshot_is_seen(spark, tmp_path):
    s = Snapshots(spark, str(tmp_path), block=4)
    s.add(lines_of(spark, 40), 1)
    folder = s.entry(1)["folder"]
    rows = s.read(1).withColumn("value", F.when(F.col("id") == "id4", "{}").otherwise(F.col("value"))).select("part", "bits", "block", "id", "value")
    rows.where("id <> 'id9'").write.parquet(str(tmp_path / "other"))
    (tmp_path / folder / "blocks").rename(tmp_path / "kept")
    (tmp_path / "other").rename(tmp_path / folder / "blocks")
    assert not s.verify(1) and 1 <= s.damaged(1).count() <= 2


def test_publish_of_a_previewed_model(graph, spark, tmp_path):  # noqa: F811
    s = Snapshots(spark, str(tmp_path))
    digest = s.preview(graph)
    assert s.publish(graph, 4, digest) == (1, digest)
    with pytest.raises(ValueError, match="preview"):
        s.publish(graph.with_(objects=graph.objects.where("id <> 'p1'")), 5, digest)
    assert s.sequences() == [1] and rows_of(s.read()) == rows_of(export.json_lines(graph))


# ---- adjacency


def test_hops_shuffle_no_edges(spark):
    rng = random.Random(1)
    edges = spark.createDataFrame([(f"e{k}", "t", f"n{rng.randrange(60)}", f"n{rng.randrange(60)}", {}, True) for k in range(90)], schema.RELATIONSHIPS)
    near = reach.Adjacency(edges)
    roots = spark.createDataFrame([("n1",), ("n2",), ("lost",)], "id string")
    start = near._write(roots.withColumn("hops", F.lit(0)))
    plan = near.step(start, [start], 1, sent=False)._jdf.queryExecution().executedPlan().toString()
    join = plan[plan.index("SortMergeJoin [id") :] if "SortMergeJoin [id" in plan else plan
    assert plan.count("FileScan") == 3 and plan.count("Exchange hashpartitioning") == 1, plan  # of what was found only
    assert "Bucketed: true" in join or "bucket" in join.lower()
    got = [{r["id"]: r["hops"] for r in reach.reachable(roots, x, d).collect()} for d in (1, 2, None) for x in (edges, near)]
    assert got[0] == got[1] and got[2] == got[3] and got[4] == got[5] and got[0]["lost"] == 0 and len(got[4]) > len(got[2]) > 3


@pytest.mark.parametrize("sent", [0, 10**6])
def test_long_and_short_frontiers_give_the_same(spark, monkeypatch, sent):
    monkeypatch.setattr(reach, "SENT", sent)
    rng = random.Random(7)
    pairs = [(rng.randrange(40), rng.randrange(40)) for _ in range(45)]
    edges = spark.createDataFrame([(f"e{k}", "t", f"n{a}", f"n{b}", {}, True) for k, (a, b) in enumerate(pairs)], schema.RELATIONSHIPS)
    want, last, hop = {"n0": 0, "n5": 0}, {"n0", "n5"}, 0
    while last:
        hop += 1
        last = {y for a, b in pairs for x, y in ((f"n{a}", f"n{b}"), (f"n{b}", f"n{a}")) if x in last} - set(want)
        want |= dict.fromkeys(last, hop)
    got = {r["id"]: r["hops"] for r in reach.reachable(spark.createDataFrame([("n0",), ("n5",)], "id string"), edges).collect()}
    assert got == want


# ---- cascade


def test_discard_follows_every_name(spark):
    make = lambda id_, kind, parent=None, **after: dict(op="create", id=id_, kind=kind, parent=parent, after=json.dumps(after))
    changes = log(
        spark,
        make("T", "object_type", name="T"),
        make("U", "object_type", name="U"),
        make("R", "relationship_type", name="R"),
        make("d", "attribute_definition", "T", key="k"),
        make("o", "object", "T", name="o"),
        make("p", "object", "U", name="p"),
        make("e", "relationship", "R", source_id="o", target_id="p"),
        make("f", "relationship", "R", source_id="p", target_id="old"),
        make("rule1", "relationship_type_rule", "R", subject_type_id="U", object_type_id="T"),
        make("rule2", "relationship_type_rule", "R", subject_type_id="U", object_type_id="U"),
        dict(op="update", id="o", after='{"field": "name", "value": "x"}'),
        dict(op="update", id="old_edge", kind="relationship", after='{"field": "target_id", "value": "o"}'),
        dict(op="update", id="old_edge", kind="relationship", after='{"field": "is_active", "value": true}'),
        dict(op="update", id="canonical", after='{"field": "name", "value": "o"}'),
        make("child", "object", "canonical", name="c"),
    )
    gone = lambda *x: spark.createDataFrame([(i,) for i in x], "target_id string")
    left = lambda *x: sorted(r["id"] for r in commit.discard(changes, gone(*x)).collect())
    every = {f"c{k}" for k in range(15)}
    assert set(left("T")) == every - {"c0", "c3", "c4", "c6", "c8", "c10", "c11"}
    assert set(left("R")) == every - {"c2", "c6", "c7", "c8", "c9"}
    assert set(left("canonical")) == every - {"c13"}  # it exists without the log, and so does what names it
    assert set(left("none")) == every


# ---- validity


def test_as_of_and_overlaps(graph, spark):  # noqa: F811
    rng = random.Random(5)
    rows = []
    for k in range(120):
        start = rng.choice([None, *range(0, 4_000_000, 1800)])
        length = rng.choice([None, 0, 900, 3600, 3601, 50_000, 3_000_000])
        rows.append((f"e{k}", rng.choice(["a", "b"]), start, None if length is None else (start or 0) + length))
    df = spark.createDataFrame(rows, "id string, owner string, s long, t long")
    df = df.select("id", "owner", F.timestamp_seconds("s").alias("valid_from"), F.timestamp_seconds("t").alias("valid_to"))
    lo, hi = -(1 << 40), 1 << 40
    span = {i: (o, lo if s is None else s, hi if t is None else t) for i, o, s, t in rows}
    got = Counter((r["owner"], r["left_id"], r["right_id"]) for r in validity.overlapping(df, df, ["owner"]).collect())
    want = Counter((o, i, j) for i, (o, s, t) in span.items() for j, (q, u, v) in span.items() if o == q and max(s, u) < min(t, v))
    assert got == want and max(got.values()) == 1
    when = 2_000_000
    view = validity.as_of(graph.with_(relationships=df), F.timestamp_seconds(F.lit(when)))
    assert {r["id"] for r in view.relationships.collect()} == {i for i, (_, s, t) in span.items() if s <= when < t}
    assert validity.as_of(graph.with_(relationships=df), "2100-01-01 00:00:00").relationships.count() == sum(t == hi for _, _, t in span.values())


# ---- numbers within hot groups


def test_places_of_a_hot_group_lie_in_many_tasks(spark):
    rng = random.Random(2)
    rows = [("hub" if rng.random() < 0.9 else f"g{rng.randrange(5)}", rng.randrange(10_000), k) for k in range(3000)]
    df = spark.createDataFrame(rows, "g string, x int, k int")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        steps = Steps(spark, "test")
        got = places(df, ["g"], [F.col("x"), F.col("k")], "place", steps)
        assert {(r["g"], r["k"], r["place"]) for r in got.collect()} == {(g, k, n) for own in {g for g, _, _ in rows} for n, (_, k, g) in enumerate(sorted((x, k, g) for g, x, k in rows if g == own), 1)}
        hub = spark.read.parquet(f"{steps.root}/ranged-place").where("g = 'hub'").groupBy("__part").count().collect()
        assert len(hub) >= 3 and max(r["count"] for r in hub) < 2000
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    sums = sums_before(df.withColumn("part", F.col("x").cast("int") % 1 + F.shiftright("x", 9)), ["g"], "part", ["x", "k"], "x", "before")
    assert all(r["before"] == sum(x for g, x, k in rows if g == r["g"] and (x, k) < (r["x"], r["k"])) for r in sums.limit(40).collect())


def test_keys_of_one_base_take_free_numbers(spark):
    requests = spark.createDataFrame([("s", k, "Item") for k in range(400)] + [("s", 1000, "item_5"), ("s", 150, "item 7"), ("s", 1001, "Item 2")], "scope string, seq long, name string")
    taken = {"item", "item_3", "item_9", "item_400", "item_x"}
    got = {r["seq"]: r["key"] for r in keys.allocate(requests, spark.createDataFrame([("s", t) for t in taken], "scope string, key string")).collect()}
    want, used = {}, set(taken)
    for scope, seq, name in sorted(map(tuple, requests.collect()), key=lambda r: r[1]):
        base, n = name.lower().replace(" ", "_"), 1
        while (base if n == 1 else f"{base}_{n}") in used:
            n += 1
        want[seq] = base if n == 1 else f"{base}_{n}"
        used.add(want[seq])
    assert got == want
    plan = keys._claims(requests.select("scope", F.lower("name").alias("base"), "seq", F.lit(1).alias("rank")), spark.createDataFrame([], "scope string, base string, number int, gap int"))
    assert "Python" not in plan._jdf.queryExecution().executedPlan().toString()


def test_details_of_a_hub(graph, spark):  # noqa: F811
    rows = [("hub", f"o{k}", f"e{k}", "out", f"Name {k % 7}", "t", "T") for k in range(200)]
    d = spark.createDataFrame(rows, "id string, other_id string, edge_id string, direction string, other_name string, edge_type_id string, edge_type_name string")
    got = details.grouped_details(d).collect()
    order = sorted(((n.lower(), e) for _, _, e, _, n, _, _ in rows))
    assert [(r["other_name"].lower(), r["edge_id"]) for r in sorted(got, key=lambda r: r["position"])] == order and {r["n"] for r in got} == {200}


# ---- deletion of a model, one document, pages


def test_deletion_is_guarded_ordered_and_resumed(spark, tmp_path):
    from typegrove.operators.deletion import Tables
    from typegrove.operators.tasks import DELETE_ORDER

    t = Tables(spark, str(tmp_path))
    for table in DELETE_ORDER:
        t.write(table, spark.createDataFrame([("m/1", k) for k in range(3)] + [("m2", 9)], "model_id string, x int"))
    models = spark.createDataFrame([("m/1",), ("m2",)], "id string")
    busy = spark.createDataFrame([("m2", "queued"), ("m/1", "completed")], "model_id string, status string")
    with pytest.raises(ValueError):
        t.delete("m2", models, busy)
    with pytest.raises(ValueError):
        t.delete("m3", models, busy)
    seen = []

    def crash(table):
        if len(seen) == 3:
            raise RuntimeError("the driver dies")
        seen.append(table)

    with pytest.raises(RuntimeError):
        t.delete("m/1", models, busy, crash)
    assert seen == list(DELETE_ORDER[:3])
    assert all([r["model_id"] for r in t.read(x).collect()] == ["m2"] for x in DELETE_ORDER)  # a half-deleted model is not seen
    left = lambda x: spark.read.parquet(str(tmp_path / x)).where("model_id = 'm/1'").count()
    assert [left(x) for x in DELETE_ORDER] == [0, 0, 0, 3, 3, 3, 3]
    assert Tables(spark, str(tmp_path)).resume() == ["m/1"] and t.resume() == []
    assert [left(x) for x in DELETE_ORDER] == [0] * 7


@pytest.mark.parametrize("parts", [export.PARTS, ("rule", "object"), ("object_type",), ("relationship", "object", "attribute_definition")])
def test_one_json_document_from_many_tasks(spark, tmp_path, parts):
    rows = [(p, f"{p}-{k:03}", json.dumps({"id": k, "text": "a,b\n]}"})) for p in parts for k in range(1 if p == "rule" else 57)]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        export.write_document(spark.createDataFrame(rows, "part string, id string, value string").repartition(5), str(tmp_path / "d"))
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    files = sorted((tmp_path / "d").glob("part-*.txt"))
    found = json.loads("".join(f.read_text() for f in files))
    assert len(files) >= 2 or len(rows) < 60
    assert list(found) == list(export.PARTS) and {p: [x["id"] for x in found[p]] for p in export.PARTS} == {p: sorted(json.loads(v)["id"] for q, _, v in rows if q == p) for p in export.PARTS}


def test_pages_by_seek_and_by_index_equal_offset(spark):
    from typegrove.operators import pages

    rng = random.Random(4)
    rows = [(k, rng.choice([None, "a", "b", "c", "d"]), rng.choice([None, 1, 2])) for k in range(333)]
    df = spark.createDataFrame(rows, "id int, name string, n int")
    for order in ([("name", False), ("id", False)], [("name", True), ("n", False), ("id", True)]):
        every = [r["id"] for r in df.orderBy(*pages.sorting(order)).collect()]
        index, last = pages.Pages(df, order), None
        for p in range(1, 6):
            want = every[(p - 1) * 20 : p * 20]
            got = pages.seek(df, order, last, 20).collect()
            assert [r["id"] for r in got] == want
            last = [got[-1][c] for c, _ in order]
        for p in (1, 9, 17, 18):
            assert [r["id"] for r in index.page(p, 20).collect()] == every[(p - 1) * 20 : p * 20]
        read = index.page(9, 20)._jdf.queryExecution().executedPlan().toString()
        assert read.count("page_range=") <= 2
