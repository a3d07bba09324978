"""What grows with the input: no task gets all records of a type, edges meet their ends by keys, rows are moved once."""

import os

import pytest

from typegrove import history_queries, model_queries, queries  # noqa: F401

SF = "/root/testdata/sf0.001"

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["v_date", "v_datetime", "v_null", "v_unsupported_type"])
def test_records_meet_definitions_where_they_are(spark, name):
    """By type there would be one key, so one task, for all orders."""
    text = plan(queries.FOUND[name](spark, SF))
    assert "SortMergeJoin" not in text and "BroadcastHashJoin" in text


@pytest.mark.parametrize("name", ["relationship_details", "v_pair_rules", "rule_for_edges", "export_edges_keys", "edge_index", "cardinality_counts", "cardinality_violations"])
def test_edges_meet_their_ends_by_the_tables_own_keys(spark, name):
    """Ids are texts made of keys: an edge with three of them is several times as long as its keys."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "1")
    try:
        text = plan(queries.FOUND[name](spark, SF))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "hashpartitioning(l_orderkey" in text and "hashpartitioning(l_partkey" in text
    assert "hashpartitioning(source_id" not in text and "hashpartitioning(target_id" not in text


def test_an_edge_without_an_end_has_no_rule(spark, tmp_path):
    """By keys as by ids: rows that name no order, no part or nothing are edges without an end."""
    from pyspark.sql import functions as F

    from typegrove.operators import dataset as ds
    from typegrove.operators import validation
    from typegrove.sources import graphview

    for t in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem"):
        rows = spark.read.parquet(f"{SF}/{t}.parquet")
        if t == "lineitem":
            n = F.col("l_linenumber")
            rows = rows.withColumns({"l_orderkey": F.when(n == 2, None).otherwise(F.col("l_orderkey")), "l_partkey": F.when(n == 3, -F.col("l_partkey") - 1).otherwise(F.col("l_partkey"))})
        rows.write.parquet(f"{tmp_path}/{t}.parquet")
    d = graphview.dataset(spark, str(tmp_path))
    plain = d.with_(links=None)
    rule = lambda x: sorted(map(tuple, ds.rule_of_edges(x, ends=("name",)).select("id", "rule_id", "source_name", "target_name").collect()))
    sides = lambda x: sorted(map(tuple, validation.sides_of(x).select("id", "type_id", "side", "other_type", "n").collect()))
    assert rule(d) == rule(plain) and len(rule(d)) < d.relationships.count()
    assert sides(d) == sides(plain)
    assert d.with_(objects=d.objects.where("false")).links is None


@pytest.mark.parametrize("name", ["publication_summary", "scope_publish"])
def test_a_scope_reads_no_edges_of_types_it_leaves_out(spark, name):
    """Line items join orders with parts, which the scopes exclude."""
    assert "l_orderkey" not in plan(queries.FOUND[name](spark, SF))


def test_values_of_an_edge_are_moved_once(spark):
    """Not the fields of each row, each apart, and the rows again for their number."""
    assert plan(queries.FOUND["plan_edge_updates"](spark, SF)).count("Exchange hashpartitioning(identity") == 1


def test_a_discarded_log_is_moved_once(spark):
    """Rows that name nothing meet what is gone once; records that go are known to be the log's own."""
    assert plan(queries.FOUND["discarded_cascade"](spark, SF)).count("Exchange hashpartitioning") <= 2


def test_groups_are_counted_where_they_are_placed(spark):
    """Their size is the sum of the parts that places are counted in: details are found once, and not moved again for it."""
    text = plan(queries.FOUND["grouped_details"](spark, SF))
    assert "orders.parquet" not in text and text.count("Join") <= 1


def test_digests_move_bytes(spark):
    """Half as long as their digits, which they become where they are sorted already."""
    assert "collect_list(unhex(sha2(" in plan(queries.FOUND["snapshot_digests"](spark, SF))


def test_records_of_a_snapshot_are_written_once(spark, tmp_path):
    """A block follows from the id, so records stay where they were written; only those of new blocks are copied."""
    from typegrove.sources.snapshots import Snapshots

    lines = spark.range(600).selectExpr("'object' AS part", "cast(id AS string) AS id", "cast(id AS string) AS value")
    s = Snapshots(spark, str(tmp_path), block=8)
    s.add(lines.repartition(5), 1)
    s.add(lines.where("id <> '7'"), 2)
    first, second = (spark.read.parquet(f"{tmp_path}/{s.entry(n)['folder']}/blocks") for n in (1, 2))
    assert first.columns == ["part", "id", "value"] and first.rdd.getNumPartitions() > 1
    assert first.count() == 600 and second.count() < 50 and s.read(2).count() == 599 and s.verify(1) and s.verify(2)


def test_edges_of_a_snapshot_meet_their_ends_by_keys(spark):
    from typegrove.sources import derived, export

    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "1")
    try:
        text = plan(export.json_lines(derived.dataset(spark, SF)))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "hashpartitioning(source_id" not in text and "hashpartitioning(target_id" not in text


def test_a_table_is_written_to_its_buckets_where_it_lies(spark, tmp_path):
    """By as many tasks as have its rows, not one a bucket."""
    from typegrove.operators.store import OPEN, Index, Store

    store, index = Store(spark, str(tmp_path), 2), Index()
    store.write(index, "objects", spark.range(0, 1000, 1, 4).selectExpr("cast(id AS string) AS id", "id AS n"), "t")
    for bucket, folder in index.files("objects").items():
        assert len(list((tmp_path / folder / f"store_bucket={bucket}").glob("*.parquet"))) == 4
    only = store.touched(index, "objects", spark.createDataFrame([("7",)], "id string"))
    assert store.read(index, "objects").count() == 1000 and store.read(index, "objects", only).where("id = '7'").count() == 1
    assert spark.conf.get(OPEN, "0") == "0"


def test_edges_of_a_model_meet_their_ends_by_keys(spark):
    from typegrove.operators import dataset as ds
    from typegrove.sources import graphview

    d = graphview.dataset(spark, SF)
    d = d.with_(object_types=d.object_types.where("id <> 'supplier'"), relationship_types=d.relationship_types.where("id <> 'in_region'"))
    objects = ds.known_objects(d.objects, d.object_types)
    rows = lambda x: sorted(map(repr, x.select("id", "type_id", "source_id", "target_id", "attributes", "is_active", *ds.END_TYPES).collect()))
    assert rows(ds.typed_relationships(d, objects)) == rows(ds.typed_relationships(d.with_(links=None), objects))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "1")
    try:
        text = plan(ds.typed_relationships(d, objects))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "hashpartitioning(source_id" not in text and "hashpartitioning(target_id" not in text


def test_a_commit_changes_only_records_that_the_log_names(spark, tmp_path, monkeypatch):
    """The others of their buckets are written as they are."""
    from typegrove import history_queries
    from typegrove.operators import model
    from typegrove.sources import graphview

    m = model.Model(spark, str(tmp_path / "model"), 2)
    m.create(history_queries._sound(spark, SF))
    given, stored = {}, model.stored
    monkeypatch.setattr(model, "stored", lambda rows, changes, kind: given.update({kind: rows.count()}) or stored(rows, changes, kind))
    log = graphview.changes(spark, SF).where("operation = 'update'").limit(0)
    row = ("c", "p", 1, "update", "object", "customer:1", None, None, None, '{"field": "name", "value": "Other"}')
    assert m.commit(log.unionByName(spark.createDataFrame([row], log.schema))).committed
    assert given["object"] == 1
    old, new = (m.read(n).objects.select("id", "type_id", "key", "name", "is_active") for n in (1, 2))
    assert [(r["id"], r["name"]) for r in new.exceptAll(old).select("id", "name").collect()] == [("customer:1", "Other")] and old.count() == new.count()


def test_pairs_without_an_issue_go_before_codes_are_listed(spark, monkeypatch):
    """Values at their bounds, past them and of every type, with bounds the wrong way round: all codes of a pair, none of a fine one."""
    from pyspark.sql import functions as F

    from typegrove.operators import validation
    from typegrove.schema import ATTRIBUTE_DEFS

    types = [("text", 2, 3), ("number", None, None), ("date", None, None), ("datetime", None, None), ("choice", None, None), ("boolean", None, None), ("money", None, None), ("text", 5, 1)]
    defs = [(f"d{n}", "object", "t", f"a{n}", "A", kind, n % 2 == 0, n % 3 == 0, n, True, low, high, 1.0 if kind == "number" else None, 2.0 if kind == "number" else None, ["x", "y"] if kind == "choice" else None) for n, (kind, low, high) in enumerate(types)]
    values = ["x", "xx", "xxx", "xxxx", "1", "2", "2.5", "0.5", "NaN", "1995-02-28", "1995-02-30", "1995-02-28T10:30", "true", "", None]
    rows = [(f"r{i}", "t", {f"a{n}": v for n in range(len(types)) if (i + n) % 5}) for i, v in enumerate(values)]
    rows, defs = spark.createDataFrame(rows, "id string, type_id string, attributes map<string,string>"), spark.createDataFrame(defs, ATTRIBUTE_DEFS)
    found = validation.attribute_issues(rows, defs, "object")
    some = lambda: sorted((r["target_id"], r["field"], r["code"]) for r in found.collect())
    with_filter = some()
    monkeypatch.setattr(validation, "fits", lambda: F.lit(False))
    found = validation.attribute_issues(rows, defs, "object")
    assert with_filter == some() and len(with_filter) > 30


def test_a_snapshot_that_shares_blocks_writes_no_others(spark, tmp_path, monkeypatch):
    """Not even for a while: its records are held against the list of the one before as they come."""
    from pyspark.sql.readwriter import DataFrameWriter

    from typegrove.sources.snapshots import Snapshots

    lines = spark.range(600).selectExpr("'object' AS part", "cast(id AS string) AS id", "cast(id AS string) AS value")
    s, seen, parquet = Snapshots(spark, str(tmp_path), block=8), [], DataFrameWriter.parquet
    s.add(lines, 1)
    monkeypatch.setattr(DataFrameWriter, "parquet", lambda self, *a, **k: (seen.append(self._df.count()) if self._df.columns == ["part", "id", "value"] else None, parquet(self, *a, **k))[1])
    s.add(lines.where("id <> '7'"), 2)
    assert 0 < sum(seen) < 50 and s.verify(2)


def test_digests_of_blocks_are_added_up_where_records_lie(spark, tmp_path):
    """A row a block and task is moved, no list of hashes; records are not dealt to blocks to be checked."""
    from typegrove.sources.snapshots import Snapshots

    lines = spark.range(600).selectExpr("'object' AS part", "cast(id AS string) AS id", "cast(id AS string) AS value")
    s = Snapshots(spark, str(tmp_path), block=8)
    s.add(lines, 1)
    s.add(lines.where("id <> '7'"), 2)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "1")
    try:
        assert not any("collect_list" in plan(s.damaged(n)) for n in (1, 2)) and "Join" not in plan(s.read(1))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_snapshots_of_a_model_that_grows_and_shrinks(spark, tmp_path):
    """Blocks are more or fewer then; digests are the same as of a snapshot of its own, and repeated records count."""
    from typegrove.sources.snapshots import Snapshots

    lines = lambda n: spark.range(n).selectExpr("if(id % 3 = 0, 'rule', 'object') AS part", "cast(id AS string) AS id", "if(id = 5, null, cast(id AS string)) AS value")
    s = Snapshots(spark, str(tmp_path / "s"), block=8)
    for k, n in enumerate((30, 300, 40, 2)):
        rows = lines(n)
        _, digest = s.add(rows, 1)
        assert digest == Snapshots(spark, str(tmp_path / f"own{k}"), block=8).add(rows.repartition(3), 1)[1]
        assert s.read().count() == n and s.verify()
    assert s.add(lines(2).unionByName(lines(1)), 1)[1] != digest
    assert s.verify_all((1, 2, 3, 4, 5)) == dict.fromkeys((1, 2, 3, 4, 5), True)
    put = s._put
    s._put = lambda rows, folder: put(rows.selectExpr("part", "id", "'other' AS value"), folder)  # as if the model changed in between
    with pytest.raises(ValueError):
        s.add(lines(9), 1)
    assert s.sequences() == [1, 2, 3, 4, 5]


def test_ends_that_are_there_once_move_no_edges(spark, tmp_path):
    """Ends that are missing, null or there twice are found by their keys beforehand: the same edges, each as often."""
    from pyspark.sql import functions as F

    from typegrove.shared import Steps
    from typegrove.sources import graphview

    for t in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem"):
        rows = spark.read.parquet(f"{SF}/{t}.parquet")
        if t == "lineitem":
            n = F.col("l_linenumber")
            rows = rows.withColumns({"l_orderkey": F.when(n == 2, None).otherwise(F.col("l_orderkey")), "l_partkey": F.when(n == 3, -F.col("l_partkey") - 1).otherwise(F.col("l_partkey"))})
        if t == "part":
            rows = rows.unionByName(rows.where("p_partkey < 20")).unionByName(rows.where("p_partkey < 10"))
        rows.write.parquet(f"{tmp_path}/{t}.parquet")
    own = graphview.links(spark, str(tmp_path))
    checked = own.checked(Steps(spark, "checked"), "odd")
    rows = lambda x: x.with_ends("key").select(F.xxhash64("id", "source_type", "target_type", "source_key", "target_key").alias("h")).groupBy("h").count().collect()
    assert sorted(rows(own)) == sorted(rows(checked)) and not checked.odd.isEmpty()
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "20000")
    try:
        text = plan(graphview.links(spark, SF).checked(Steps(spark, "checked"), "odd").with_ends("key"))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "hashpartitioning(l_orderkey" not in text and "SortMergeJoin" not in text


def test_details_are_moved_as_keys(spark, monkeypatch):
    """Not as texts, and no names are written: they only decide the order."""
    from pyspark.sql.readwriter import DataFrameWriter

    seen, parquet = [], DataFrameWriter.parquet
    monkeypatch.setattr(DataFrameWriter, "parquet", lambda self, *a, **k: (seen.append(self._df.dtypes), parquet(self, *a, **k))[1])
    text = plan(queries.FOUND["grouped_details"](spark, SF))
    assert "Exchange" not in text and not any(c == "other_name" for found in seen for c, _ in found)
    placed = [found for found in seen if ("l_linenumber", "int") in found]
    assert len(placed) == 2 and not any(kind == "string" for found in placed for _, kind in found)


def test_large_groups_of_details_are_dealt_by_ranges(spark):
    """The same places whether a group is one task's or not; edges of types that are not there go."""
    from typegrove.shared import Steps
    from typegrove.sources import graphview

    own = graphview.links(spark, SF)
    types = {x.type_id for x in own.links} - {"placed_by"}
    got = [own.grouped(types, Steps(spark, "details"), large) for large in (1 << 20, 20)]
    assert got[0].exceptAll(got[1]).isEmpty() and got[1].exceptAll(got[0]).isEmpty()
    assert got[0].where("n > 20").count() > 1000 and got[0].where("edge_type_id = 'placed_by'").isEmpty()


def test_a_rejected_change_set_writes_no_buckets(spark, tmp_path, monkeypatch):
    """Its issues come from the records it names and the buckets as they are; they are those of the buckets as they would be."""
    from typegrove import history_queries
    from typegrove.operators import model, store
    from typegrove.sources import graphview

    m = model.Model(spark, str(tmp_path / "model"), 4)
    m.create(history_queries._sound(spark, SF, "based_in:supplier:nation"))
    schema, none = graphview.changes(spark, SF).schema, (None, None, None)
    rows = [
        ("a", "p", 1, "update", "object", "customer:1", *none, '{"field": "name", "value": ""}'),
        ("b", "p", 2, "create", "relationship", "second:1", "relationship_type", "based_in", None, '{"source_id": "supplier:1", "target_id": "nation:1"}'),
        ("c", "p", 3, "delete", "object", "customer:2", *none, None),
        ("d", "p", 4, "create", "object", "customer:new", "object_type", "customer", None, '{"name": "New", "key": "customer_3", "attributes": {"mktsegment": "NONE"}}'),
        ("e", "p", 5, "create", "relationship", "second:2", "relationship_type", "based_in", None, '{"source_id": "customer:none", "target_id": "nation:1"}'),
    ]
    log, wrote, write = spark.createDataFrame(rows, schema).cache(), [], store.Store.write
    monkeypatch.setattr(store.Store, "write", lambda self, index, table, *more: (wrote.append(table), write(self, index, table, *more))[1])
    out = m.commit(log)
    found = [(r["code"], r["change_id"]) for r in out.issues.collect()]
    assert not out.committed and wrote == [] and m.revision() == 1
    assert {"name_required", "object_cardinality_maximum", "duplicate_key", "invalid_choice", "endpoint_not_found"} <= {code for code, _ in found}, found
    change = model.Change(m.store, m._load(1)[0], log, "tables/next", None)
    change.lay_objects()
    change.lay_edges()
    rows_of = lambda: sorted(map(repr, change.issues().unionByName(change.change_issues()).collect()))
    laid = rows_of()
    change.write()
    assert laid == rows_of() and len(laid) == len(found) and {"objects", "relationships", "counts", "keys"} <= set(wrote)
