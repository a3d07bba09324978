"""Queries over what changes and what was: revisions, issues of a commit, cascades, validity, snapshots, deep pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import commit, pages, validity
from .operators.model import ONTOLOGY, Model
from .queries import OBJECTS, attribute, query, sql
from .shared import Steps
from .sources import derived, export, graphview
from .sources.snapshots import Snapshots


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def _sound(spark: SparkSession, sf_dir: str, bounded: str = ""):
    """The graph under rules without bounds, but for the one rule named."""
    d = graphview.dataset(spark, sf_dir)
    free = F.col("id") != bounded
    bound = {c: F.when(free, F.lit(0 if c.endswith("min") else None).cast("int")).otherwise(F.col(c)) for c in ("s_min", "s_max", "o_min", "o_max")}
    return d.with_(rules=d.rules.withColumns(bound))


def _new_model(spark: SparkSession, dataset, buckets: int = 16) -> Model:
    model = Model(spark, Steps(spark, "model").root, buckets)
    model.create(dataset)
    return model


def _customer_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events that change customers that exist, as updates."""
    own = _read(spark, sf_dir, "customer").select(F.concat(F.lit("customer:"), F.col("c_custkey").cast("string")).alias("target_id"))
    rows = graphview.changes(spark, sf_dir).where("operation = 'update'")
    field = F.get_json_object("after_json", "$.field")
    return rows.where(field.isin("name", "attributes.acctbal", "is_active")).join(own, "target_id", "left_semi")


@query("""
WITH e AS (SELECT event_id AS seq, 'customer:' || user_id AS id, event_type AS t, value, CAST(json_extract_string(props, '$.k') AS INT) AS k FROM events),
names AS (SELECT id, 'Customer v' || arg_max(k, seq) AS name FROM e WHERE t = 'click' GROUP BY id),
sums AS (SELECT id, arg_max(value, seq) AS acctbal FROM e WHERE t = 'purchase' GROUP BY id),
states AS (SELECT id, arg_max(t, seq) = 'view' AS is_active FROM e WHERE t = 'error' AND k % 10 = 0 OR t = 'view' AND k % 10 = 1 GROUP BY id)
SELECT id, coalesce(name, c_name) AS name, round(coalesce(acctbal, c_acctbal), 4) AS acctbal, coalesce(is_active, true) AS is_active, 3::BIGINT AS revision
FROM (SELECT *, 'customer:' || c_custkey AS id FROM customer) LEFT JOIN names USING (id) LEFT JOIN sums USING (id) LEFT JOIN states USING (id)""")
def commit_round_trip(spark, sf_dir):
    """A model of the whole graph, two commits of half of the events each, and all customers as read back."""
    model, log = _new_model(spark, _sound(spark, sf_dir)), _customer_log(spark, sf_dir)
    half = _read(spark, sf_dir, "events").count() // 2
    for part in (log.where(F.col("seq") < half), log.where(F.col("seq") >= half)):
        outcome = model.commit(part)
        if not outcome.committed:
            raise ValueError("the events should make no issues")
    rows = model.read().objects.where("type_id = 'customer'")
    return rows.select("id", "name", F.round(attribute("acctbal").cast("double"), 4).alias("acctbal"), "is_active", F.lit(model.revision()).cast("long").alias("revision"))


@query("""
SELECT CASE c_custkey % 5 WHEN 0 THEN 'name_required' WHEN 1 THEN 'name_too_long' WHEN 2 THEN 'invalid_choice' ELSE 'invalid_attribute_type' END AS code, 'customer:' || c_custkey AS target_id, 'c:' || c_custkey AS change_id FROM customer WHERE c_custkey % 5 < 4
UNION ALL SELECT 'object_cardinality_maximum', 'supplier:' || s_suppkey, NULL FROM supplier
UNION ALL SELECT 'invalid_relationship_types', 'odd:' || r_regionkey, 'r:' || r_regionkey FROM region
UNION ALL SELECT 'target_not_found', 'nobody:' || n_nationkey, 'n:' || n_nationkey FROM nation""")
def commit_issues(spark, sf_dir):
    """What a rejected change-set is told: of records it changes, of ends of edges it adds, of edges no rule allows; each laid to its change."""
    model = _new_model(spark, _sound(spark, sf_dir, "based_in:supplier:nation"))
    none, m = F.lit(None).cast("string"), F.col("c_custkey") % 5
    field = F.when(m < 2, "name").when(m == 2, "attributes.mktsegment").when(m == 3, "attributes.acctbal").otherwise("is_active")
    value = F.when(m == 0, "").when(m == 1, F.repeat(F.lit("x"), 256)).when(m == 2, "NONE").when(m == 3, "soon").otherwise("false")
    json = lambda **v: F.to_json(F.struct(*[x.alias(k) for k, x in v.items()]))
    text = lambda p, c: F.concat(F.lit(f"{p}:"), F.col(c).cast("string"))

    def rows(table, prefix, key, operation, kind, target, parent, after):
        return _read(spark, sf_dir, table).select(
            text(prefix, key).alias("id"), F.lit("p").alias("proposal_id"), F.col(key).cast("long").alias("seq"), F.lit(operation).alias("operation"), F.lit(kind).alias("target_type"), target.alias("target_id"),
            F.lit("relationship_type").alias("parent_type"), F.lit(parent).cast("string").alias("parent_id"), none.alias("before_json"), after.alias("after_json"),
        )

    log = rows("customer", "c", "c_custkey", "update", "object", text("customer", "c_custkey"), None, json(field=field, value=value))
    log = log.unionByName(rows("supplier", "s", "s_suppkey", "create", "relationship", text("second", "s_suppkey"), "based_in", json(source_id=text("supplier", "s_suppkey"), target_id=F.lit("nation:1"))))
    log = log.unionByName(rows("region", "r", "r_regionkey", "create", "relationship", text("odd", "r_regionkey"), "in_region", json(source_id=text("region", "r_regionkey"), target_id=F.lit("region:0"))))
    log = log.unionByName(rows("nation", "n", "n_nationkey", "update", "object", text("nobody", "n_nationkey"), None, json(field=F.lit("name"), value=F.lit("x"))))
    return model.commit(log).issues.select("code", "target_id", "change_id")


_TIMED = """
spans AS (
  SELECT 'placed_by:' || o_orderkey AS id, 'customer:' || o_custkey AS target_id, o_orderdate AS valid_from, valid_to
  FROM orders LEFT JOIN (SELECT l_orderkey AS o_orderkey, max(l_shipdate) AS valid_to FROM lineitem GROUP BY l_orderkey) USING (o_orderkey))"""


@query(sql(
    """SELECT id FROM spans WHERE valid_from <= DATE '1995-06-17' AND (valid_to IS NULL OR valid_to > DATE '1995-06-17')
UNION ALL SELECT 'contains:' || l_orderkey || ':' || l_linenumber || ':' || l_partkey || ':' || l_suppkey || ':' || strftime(l_shipdate, '%Y%m%d') || ':' || round(l_extendedprice * 100)::BIGINT
  FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE o_orderdate <= DATE '1995-06-17' AND l_shipdate > DATE '1995-06-17'
UNION ALL SELECT 'in_region:' || n_nationkey FROM nation UNION ALL SELECT 'based_in:c:' || c_custkey FROM customer UNION ALL SELECT 'based_in:s:' || s_suppkey FROM supplier
UNION ALL SELECT DISTINCT 'supplied_by:' || l_partkey || ':' || l_suppkey FROM lineitem""",
    _TIMED,
))
def as_of(spark, sf_dir):
    """The edges that are valid on one day."""
    d = graphview.dataset(spark, sf_dir).with_(relationships=graphview.timed_relationships(spark, sf_dir))
    return validity.as_of(d, "1995-06-17 00:00:00").relationships.select("id")


@query(sql(
    """SELECT l.target_id, l.id AS left_id, r.id AS right_id FROM spans l JOIN spans r ON r.target_id = l.target_id AND l.id < r.id
WHERE l.valid_from < coalesce(r.valid_to, TIMESTAMP '9999-01-01') AND r.valid_from < coalesce(l.valid_to, TIMESTAMP '9999-01-01')
  AND l.valid_from < coalesce(l.valid_to, TIMESTAMP '9999-01-01') AND r.valid_from < coalesce(r.valid_to, TIMESTAMP '9999-01-01')""",
    _TIMED,
))
def overlapping_orders(spark, sf_dir):
    """Pairs of a customer's orders that were open at the same time."""
    placed = graphview.timed_relationships(spark, sf_dir).where("type_id = 'placed_by'")
    return validity.overlapping(placed, placed, ["target_id"]).where("left_id < right_id")


@query("""
WITH gone AS (SELECT o_orderkey FROM orders WHERE o_orderpriority IN ('1-URGENT', '5-LOW'))
SELECT 'type:' || o_orderpriority AS id FROM orders WHERE o_orderpriority NOT IN ('1-URGENT', '5-LOW') GROUP BY o_orderpriority
UNION ALL SELECT 'rule:' || o_orderpriority FROM orders WHERE o_orderpriority NOT IN ('1-URGENT', '5-LOW') GROUP BY o_orderpriority
UNION ALL SELECT 'object:' || o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT o_orderkey FROM gone)
UNION ALL SELECT 'edge:' || l_orderkey || ':' || l_linenumber || ':' || l_partkey FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM gone)
UNION ALL SELECT 'moved:' || o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT o_orderkey FROM gone)
UNION ALL SELECT 'named:' || c_custkey FROM customer""")
def discarded_cascade(spark, sf_dir):
    """A log that creates types, rules, objects and edges: two types go, and all that can't be without them, in three steps."""
    none = F.lit(None).cast("string")
    json = lambda **v: F.to_json(F.struct(*[x.alias(k) for k, x in v.items()]))
    text = lambda p, *c: F.concat_ws(":", F.lit(p), *[F.col(x).cast("string") for x in c])

    def rows(table, id_, operation, kind, target, parent, after):
        return table.select(id_.alias("id"), F.lit("p").alias("proposal_id"), F.lit(1).cast("long").alias("seq"), F.lit(operation).alias("operation"), F.lit(kind).alias("target_type"), target.alias("target_id"), none.alias("parent_type"), parent.alias("parent_id"), none.alias("before_json"), after.alias("after_json"))

    orders, items, customers = (_read(spark, sf_dir, t) for t in ("orders", "lineitem", "customer"))
    kinds, kind, contains = orders.select("o_orderpriority").distinct(), text("type", "o_orderpriority"), F.lit("contains")
    parts = [
        rows(kinds, kind, "create", "object_type", kind, none, json(name=F.col("o_orderpriority"))),
        rows(kinds, text("rule", "o_orderpriority"), "create", "relationship_type_rule", text("rule", "o_orderpriority"), contains, json(subject_type_id=kind, object_type_id=F.lit("part"))),
        rows(orders, text("object", "o_orderkey"), "create", "object", text("object", "o_orderkey"), kind, json(name=text("Order", "o_orderkey"))),
        rows(items, text("edge", "l_orderkey", "l_linenumber", "l_partkey"), "create", "relationship", text("edge", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"), contains, json(source_id=text("object", "l_orderkey"), target_id=text("part", "l_partkey"))),
        rows(orders, text("moved", "o_orderkey"), "update", "relationship", text("placed_by", "o_orderkey"), none, json(field=F.lit("source_id"), value=text("object", "o_orderkey"))),
        rows(customers, text("named", "c_custkey"), "update", "object", text("customer", "c_custkey"), none, json(field=F.lit("name"), value=F.lit("type:1-URGENT"))),
    ]
    log = parts[0]
    for more in parts[1:]:
        log = log.unionByName(more)
    gone = kinds.where("o_orderpriority in ('1-URGENT', '5-LOW')").select(kind.alias("target_id"))
    return commit.discard(log, gone).select("id")


@query("""
WITH n AS (
  SELECT 'object' AS part, (SELECT count(*) FROM region) + (SELECT count(*) FROM nation) + (SELECT count(*) FROM customer) + (SELECT count(*) FROM supplier) + (SELECT count(*) FROM part) + (SELECT count(*) FROM orders) AS n
  UNION ALL SELECT 'relationship', (SELECT count(*) FROM nation) + (SELECT count(*) FROM customer) + (SELECT count(*) FROM supplier) + (SELECT count(*) FROM orders) + (SELECT count(*) FROM lineitem) + (SELECT count(*) FROM (SELECT DISTINCT l_partkey, l_suppkey FROM lineitem))
  UNION ALL SELECT 'object_type', (SELECT count(DISTINCT p_brand) FROM part) + (SELECT count(DISTINCT c_mktsegment) FROM customer) + (SELECT count(DISTINCT s_nationkey) FROM supplier)
  UNION ALL SELECT 'relationship_type', (SELECT count(DISTINCT o_orderpriority) FROM orders) + 1
  UNION ALL SELECT 'attribute_definition', 2 * (SELECT count(DISTINCT p_brand) FROM part) + (SELECT count(DISTINCT o_orderpriority) FROM orders)
  UNION ALL SELECT 'rule', (SELECT count(*) FROM (SELECT DISTINCT p_brand, s_nationkey FROM lineitem JOIN part ON p_partkey = l_partkey JOIN supplier ON s_suppkey = l_suppkey))
    + (SELECT count(*) FROM (SELECT DISTINCT o_orderpriority, p_brand, c_mktsegment FROM lineitem JOIN part ON p_partkey = l_partkey JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey)))
SELECT s AS sequence, part, n - CASE WHEN s = 2 AND part = 'object' THEN (SELECT count(*) FROM region) WHEN s = 2 AND part = 'relationship' THEN (SELECT count(*) FROM nation) ELSE 0 END AS n, true AS whole, s = 1 OR part IN ('object', 'relationship') AS written
FROM n, (VALUES (1::BIGINT), (2::BIGINT)) v(s)""")
def snapshots_shared(spark, sf_dir):
    """Two published snapshots, the second without regions: records of each part as read back, and whether a part has blocks that the
    second had to write."""
    steps = Steps(spark, "snapshots")
    shots, d = Snapshots(spark, f"{steps.root}/shots"), derived.dataset(spark, sf_dir)
    d = d.with_(**{t: steps.keep(getattr(d, t), t) for t in ONTOLOGY})  # aggregates of all line items, needed by both
    rest = d.links.where(F.col("type_id") != "region", F.lit(True))
    for n, links in enumerate((d.links, rest)):
        links = links.checked(steps, f"odd-{n}")
        shots.add(export.json_lines(d.with_(objects=links.objects(), links=links)), 1)
    out, whole = None, shots.verify_all((1, 2))
    for sequence in (1, 2):
        own = F.col("folder") == shots.entry(sequence)["folder"]
        written = shots.leaves(sequence).groupBy("part").agg(F.max(own).alias("written"))
        rows = shots.read(sequence).groupBy("part").agg(F.count(F.lit(1)).alias("n")).join(written, "part")
        rows = rows.select(F.lit(sequence).cast("long").alias("sequence"), "part", "n", F.lit(whole[sequence]).alias("whole"), "written")
        out = rows if out is None else out.unionByName(rows)
    return out


_NAMED = "named AS (SELECT id, name, row_number() OVER (ORDER BY lower(name), id) AS place FROM objects)"
_BY_NAME = [("folded", False), ("id", False)]


@query(sql("SELECT id, name FROM named WHERE place > 50 AND place <= 75", OBJECTS, _NAMED))
def page_after(spark, sf_dir):
    """The third page of all records by name, from the last row of the second, which is from the last row of the first."""
    rows, last = graphview.objects(spark, sf_dir).select("id", "name", F.lower("name").alias("folded")), None
    for _ in range(2):
        row = pages.seek(rows, _BY_NAME, last, 25).collect()[-1]  # a page
        last = [row["folded"], row["id"]]
    return pages.seek(rows, _BY_NAME, last, 25).select("id", "name")


@query(sql("SELECT id, name FROM named, (SELECT (count(*) - 1) // 25 AS p FROM objects) WHERE place > 25 * (p - 1) AND place <= 25 * p", OBJECTS, _NAMED))
def page_by_number(spark, sf_dir):
    """The last full page of all records by name, from the one or two ranges that hold it."""
    rows = graphview.objects(spark, sf_dir).select("id", "name", F.lower("name").alias("folded"))
    index = pages.Pages(rows, _BY_NAME)
    return index.page((index.ends[-1] - 1) // 25, 25).select("id", "name")
