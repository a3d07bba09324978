"""Further queries with their SQL: commits, validation, imports, publications, tasks and value functions over the tables."""

from __future__ import annotations

from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import text, values
from .operators import change_plan, commit, context, details, facets, importing, ontology, projection, publication, reach, review, styles, tasks, validation
from .plans.query import Filter, Scope
from .queries import CARDINALITY, DEGREES, EDGES, ENDS, FOUND, LOG, OBJECTS, SQL, attribute, query, sql
from .sources import derived, export, graphview, staging, templates


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


# ---- commits

STORED = """
kept AS (SELECT a.id, coalesce('Customer v' || n.k, a.name) AS name, coalesce(i.event_type, 'view') = 'view' AS is_active, v.k AS visits FROM alive a
  LEFT JOIN lasts n ON n.target_id = a.id AND n.field = 'name' LEFT JOIN lasts v ON v.target_id = a.id AND v.field = 'attributes.visits' LEFT JOIN lasts i ON i.target_id = a.id AND i.field = 'is_active')"""


@query(sql("SELECT id, name, is_active, visits FROM kept", LOG, STORED))
def commit_keeps_inactive(spark, sf_dir):
    """All customers after the log: retired ones are stored as inactive."""
    d = graphview.dataset(spark, sf_dir)
    after = commit.apply(d, graphview.changes(spark, sf_dir)).objects.where("type_id = 'customer'")
    return after.select("id", "name", "is_active", attribute("visits").cast("int").alias("visits"))


@query(sql("SELECT e.type_id, count(*)::BIGINT AS n FROM edges e WHERE NOT starts_with(source_id, 'customer:') AND NOT starts_with(target_id, 'customer:') OR starts_with(source_id, 'customer:') AND source_id IN (SELECT id FROM alive) OR starts_with(target_id, 'customer:') AND target_id IN (SELECT id FROM alive) GROUP BY e.type_id", EDGES, LOG))
def commit_edges_follow_ends(spark, sf_dir):
    after = commit.apply(graphview.dataset(spark, sf_dir), graphview.changes(spark, sf_dir))
    return after.relationships.groupBy("type_id").agg(F.count(F.lit(1)).alias("n"))


#: The derived ontology and its log in SQL (``sources.derived``).
BASE_ONTOLOGY = """
types AS (
  SELECT 'brand:' || p_brand AS id, p_brand AS name, count(*)::INT AS sort_order FROM part GROUP BY p_brand
  UNION ALL SELECT 'segment:' || c_mktsegment, c_mktsegment, count(*)::INT FROM customer GROUP BY c_mktsegment
  UNION ALL SELECT 'maker:' || s_nationkey, any_value(n_name), count(*)::INT FROM supplier JOIN nation ON n_nationkey = s_nationkey GROUP BY s_nationkey),
rel_types AS (SELECT 'sold:' || o_orderpriority AS id, o_orderpriority AS name FROM orders GROUP BY o_orderpriority UNION ALL SELECT 'made_by', 'Made by' FROM part HAVING count(*) >= 0),
defs AS (
  SELECT 'brand:' || p_brand || '.size' AS id, 'brand:' || p_brand AS owner_id, 'size' AS key, 'number' AS data_type, min(p_size)::DOUBLE AS least, max(p_size)::DOUBLE AS most FROM part GROUP BY p_brand
  UNION ALL SELECT 'brand:' || p_brand || '.ptype', 'brand:' || p_brand, 'ptype', 'choice', NULL, NULL FROM part GROUP BY p_brand
  UNION ALL SELECT 'sold:' || o_orderpriority || '.status', 'sold:' || o_orderpriority, 'status', 'choice', NULL, NULL FROM orders GROUP BY o_orderpriority),
base_rules AS (
  SELECT 'made_by:' || p_brand || ':' || s_nationkey AS id, 'made_by' AS rel_type_id, 'brand:' || p_brand AS subject_type_id, 'maker:' || s_nationkey AS object_type_id, count(DISTINCT l_suppkey)::INT AS o_max
  FROM lineitem JOIN part ON p_partkey = l_partkey JOIN supplier ON s_suppkey = l_suppkey GROUP BY p_brand, s_nationkey
  UNION ALL SELECT 'sold:' || o_orderpriority || ':' || p_brand || ':' || c_mktsegment, 'sold:' || o_orderpriority, 'brand:' || p_brand, 'segment:' || c_mktsegment, count(*)::INT
  FROM lineitem JOIN part ON p_partkey = l_partkey JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey GROUP BY o_orderpriority, p_brand, c_mktsegment)"""
ONTOLOGY_LOG = """
told AS (SELECT event_id AS seq, event_type AS t, CAST(json_extract_string(props, '$.k') AS INT) AS k, 'Brand#' || (user_id % 30 + 1) AS b FROM events),
renamed AS (SELECT 'brand:' || b AS id, 'Brand v' || arg_max(k, seq) AS name FROM told WHERE t = 'click' GROUP BY b),
shown AS (SELECT 'brand:' || b AS id, arg_max(t, seq) = 'view' AS is_active FROM told WHERE t = 'error' AND k % 10 = 0 OR t = 'view' AND k % 10 = 1 GROUP BY b),
mosts AS (SELECT 'brand:' || b || '.size' AS id, arg_max(k, seq)::DOUBLE AS most FROM told WHERE t = 'purchase' GROUP BY b),
tops AS (SELECT 'made_by:' || b || ':' || k % 25 AS id, arg_max(k, seq) AS o_max FROM told WHERE t = 'signup' GROUP BY b, k % 25),
now_types AS (SELECT id, coalesce(r.name, t.name) AS name, sort_order, coalesce(is_active, true) AS is_active FROM types t LEFT JOIN renamed r USING (id) LEFT JOIN shown USING (id)),
now_defs AS (
  SELECT id, owner_id, key, data_type, least, coalesce(m.most, d.most) AS most FROM defs d LEFT JOIN mosts m USING (id)
  WHERE id NOT IN (SELECT 'brand:' || b || '.ptype' FROM told WHERE t = 'error' AND k % 50 = 5)
  UNION ALL SELECT 'extra:' || seq, 'brand:' || b, 'extra_' || seq, 'number', k::DOUBLE, NULL FROM told WHERE t = 'view' AND k % 10 = 2),
all_rules AS (
  SELECT id, rel_type_id, subject_type_id, object_type_id, coalesce(n.o_max, r.o_max) AS o_max FROM base_rules r LEFT JOIN tops n USING (id)
  UNION ALL SELECT 'allow:' || seq, 'made_by', 'brand:' || b, 'maker:' || k % 25, k FROM told WHERE t = 'view' AND k % 10 = 3),
now_rules AS (SELECT * FROM all_rules WHERE subject_type_id IN (SELECT id FROM types) AND object_type_id IN (SELECT id FROM types))"""


def _derived(spark: SparkSession, sf_dir: str):
    """The ontology that the tables show, after the changes that the events make to it."""
    return commit.apply(derived.dataset(spark, sf_dir), derived.changes(spark, sf_dir))


@query(sql("SELECT id, owner_id, key, data_type, least, most FROM now_defs WHERE owner_id IN (SELECT id FROM types UNION ALL SELECT id FROM rel_types)", BASE_ONTOLOGY, ONTOLOGY_LOG))
def commit_definitions(spark, sf_dir):
    return _derived(spark, sf_dir).attribute_defs.select("id", "owner_id", "key", "data_type", "least", "most")


@query(sql("SELECT id, rel_type_id, subject_type_id, object_type_id, o_max FROM now_rules", BASE_ONTOLOGY, ONTOLOGY_LOG))
def commit_rules(spark, sf_dir):
    return _derived(spark, sf_dir).rules.select("id", "rel_type_id", "subject_type_id", "object_type_id", "o_max")


@query(sql("SELECT id, name, is_active, sort_order FROM now_types", BASE_ONTOLOGY, ONTOLOGY_LOG))
def commit_types(spark, sf_dir):
    return _derived(spark, sf_dir).object_types.select("id", "name", "is_active", "sort_order")


@query(sql("SELECT t.id, count(d.id)::BIGINT AS n FROM types t LEFT JOIN now_defs d ON d.owner_id = t.id GROUP BY t.id", BASE_ONTOLOGY, ONTOLOGY_LOG))
def attribute_counts(spark, sf_dir):
    return ontology.attribute_counts(derived.dataset(spark, sf_dir), derived.changes(spark, sf_dir))


@query(sql("SELECT t.id, count(r.id)::BIGINT AS n FROM rel_types t LEFT JOIN all_rules r ON r.rel_type_id = t.id GROUP BY t.id", BASE_ONTOLOGY, ONTOLOGY_LOG))
def rule_counts(spark, sf_dir):
    return ontology.rule_counts(derived.dataset(spark, sf_dir), derived.changes(spark, sf_dir))


@query(sql("SELECT DISTINCT rel_type_id, side, t.id AS type_id, t.name FROM (SELECT rel_type_id, 'subject' AS side, subject_type_id AS id FROM now_rules UNION ALL SELECT rel_type_id, 'object', object_type_id FROM now_rules) JOIN now_types t USING (id)", BASE_ONTOLOGY, ONTOLOGY_LOG))
def endpoint_types(spark, sf_dir):
    return ontology.endpoint_types(_derived(spark, sf_dir))


@query(sql("SELECT row_number() OVER (ORDER BY sort_order, lower(name), id) AS place, id FROM now_types", BASE_ONTOLOGY, ONTOLOGY_LOG))
def ordered_types(spark, sf_dir):
    """Places as the operator's own order gives them; types are few, so one partition numbers them."""
    rows = ontology.ordered_types(_derived(spark, sf_dir).object_types).coalesce(1)
    return rows.select((F.monotonically_increasing_id() + 1).alias("place"), "id")


@query(sql("SELECT r.id, s.name AS subject, o.name AS object, t.name AS label FROM now_rules r JOIN now_types s ON s.id = subject_type_id AND s.is_active JOIN now_types o ON o.id = object_type_id AND o.is_active JOIN rel_types t ON t.id = rel_type_id UNION ALL SELECT id, name, NULL, NULL FROM now_types WHERE is_active", BASE_ONTOLOGY, ONTOLOGY_LOG))
def ontology_graph(spark, sf_dir):
    """Nodes and edges of the ontology that the tables and events give."""
    nodes, edges = projection.ontology_graph(_derived(spark, sf_dir))
    names = lambda c: nodes.select(F.col("id").alias(f"{c}_type_id"), F.col("name").alias(c))
    edges = edges.join(names("subject"), "subject_type_id").join(names("object"), "object_type_id")
    none = F.lit(None).cast("string")
    return edges.select("id", "subject", "object", "label").unionByName(nodes.select("id", F.col("name").alias("subject"), none.alias("object"), none.alias("label")))


@query("SELECT 'part:' || p_partkey AS id, 'brand,ptype,size' AS keys, p_brand || ',' || p_type || ',' || p_size AS vals FROM part UNION ALL SELECT 'supplier:' || s_suppkey, 'acctbal', s_acctbal::VARCHAR FROM supplier UNION ALL SELECT 'nation:' || n_nationkey, '', '' FROM nation UNION ALL SELECT 'region:' || r_regionkey, '', '' FROM region UNION ALL SELECT 'customer:' || c_custkey, 'mktsegment,acctbal', c_mktsegment || ',' || c_acctbal FROM customer UNION ALL SELECT 'order:' || o_orderkey, 'status,totalprice,orderdate', o_orderstatus || ',' || o_totalprice || ',' || strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') FROM orders")
def index_columns(spark, sf_dir):
    d = graphview.dataset(spark, sf_dir)
    rows = ontology.index_columns(d.objects, d.attribute_defs)
    join = lambda f: F.array_join(F.transform("columns", lambda x: x[f]), ",")
    return rows.select("id", join("key").alias("keys"), join("value").alias("vals"))


def _bad_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A change for each customer, good or bad by its number."""
    k = F.col("c_custkey")
    m = k % 12
    key = lambda x: F.concat(F.lit("customer_"), x.cast("string"))
    operation = F.when(m.isin(3, 4, 5, 6, 7), "create").when(m == 8, "delete").otherwise("update")
    kind = F.when(m.isin(6, 7, 10, 11), "relationship").otherwise("object")
    target = F.when(m.isin(10, 11), F.concat(F.lit("placed_by:"), (k % 1000).cast("string"))).when(operation == "create", F.concat(F.lit("new:"), k.cast("string"))).when(m == 2, F.concat(F.lit("nobody:"), k.cast("string"))).otherwise(F.concat(F.lit("customer:"), k.cast("string")))
    field = F.when(m == 0, "name").when(m == 1, "colour").when(m == 9, "key").when(m == 10, "source_id").when(m == 11, "name").otherwise("description")
    value = F.when(m == 10, "order:none").otherwise("x")
    made = F.when(m == 3, F.to_json(F.struct(F.lit("A").alias("name"), key(k).alias("key")))).when(m == 4, F.to_json(F.struct(F.lit("B").alias("name"), F.lit("twice").alias("key")))).when(m == 5, F.to_json(F.struct(F.lit("C").alias("name"), F.concat(F.lit("Bad "), k.cast("string")).alias("key"))))
    made = made.when(m == 6, F.to_json(F.struct(F.lit("order:1").alias("source_id"), F.lit("customer:none").alias("target_id")))).when(m == 7, F.to_json(F.struct(F.lit("order:1").alias("source_id"), F.lit("customer:1").alias("target_id"))))
    after = F.when(operation == "update", F.to_json(F.struct(field.alias("field"), value.alias("value")))).otherwise(made)
    return _read(spark, sf_dir, "customer").select(
        F.concat(F.lit("c"), k.cast("string")).alias("id"), F.lit("p").alias("proposal_id"), k.alias("seq"), operation.alias("operation"), kind.alias("target_type"), target.alias("target_id"),
        F.when(operation == "create", F.when(kind == "object", "object_type").otherwise("relationship_type")).alias("parent_type"), F.when(operation == "create", F.when(kind == "object", "customer").otherwise("placed_by")).alias("parent_id"),
        F.lit(None).cast("string").alias("before_json"), after.alias("after_json"),
    )


BAD = """
c AS (SELECT c_custkey AS k, c_custkey % 12 AS m FROM customer),
bad AS (SELECT 'invalid_change' AS code, 'colour' AS field, 'customer:' || k AS target_id, k FROM c WHERE m = 1
  UNION ALL SELECT 'invalid_change', 'key', 'customer:' || k, k FROM c WHERE m = 9
  UNION ALL SELECT 'invalid_change', 'name', 'placed_by:' || k % 1000, k FROM c WHERE m = 11
  UNION ALL SELECT 'key_immutable', 'key', 'customer:' || k, k FROM c WHERE m = 9
  UNION ALL SELECT 'target_not_found', 'description', 'nobody:' || k, k FROM c WHERE m = 2
  UNION ALL SELECT 'target_not_found', CASE WHEN m = 10 THEN 'source_id' ELSE 'name' END, 'placed_by:' || k % 1000, k FROM c WHERE m IN (10, 11) AND k % 1000 NOT IN (SELECT o_orderkey FROM orders)
  UNION ALL SELECT 'duplicate_key', 'key', 'new:' || k, k FROM c WHERE m = 3 OR m = 4 AND (SELECT count(*) FROM c WHERE m = 4) > 1
  UNION ALL SELECT 'invalid_key', 'key', 'new:' || k, k FROM c WHERE m = 5
  UNION ALL SELECT 'endpoint_not_found', NULL, 'new:' || k, k FROM c WHERE m = 6
  UNION ALL SELECT DISTINCT 'endpoint_not_found', NULL, 'placed_by:' || k % 1000, NULL::BIGINT FROM c WHERE m = 10)"""


@query(sql("SELECT code, field, target_id FROM bad", BAD))
def change_issues(spark, sf_dir):
    return commit.change_issues(graphview.dataset(spark, sf_dir), _bad_changes(spark, sf_dir)).select("code", "field", "target_id")


@query(sql("SELECT code, target_id, CASE WHEN target_id LIKE 'placed_by:%' THEN NULL ELSE 'c' || k END AS change_id FROM bad", BAD))
def attributed_issues(spark, sf_dir):
    """Each issue with its change; of edges that several changes touch only the code is compared."""
    changes = _bad_changes(spark, sf_dir)
    found = commit.attributed(commit.change_issues(graphview.dataset(spark, sf_dir), changes), changes)
    return found.select("code", "target_id", F.when(~F.startswith("target_id", F.lit("placed_by:")), F.col("change_id")).alias("change_id"))


@query("SELECT 'object_type' AS target_type, t AS target_id FROM (VALUES ('nation'), ('customer')) v(t) UNION ALL SELECT 'relationship_type', 'supplied_by'")
def protected_types(spark, sf_dir):
    """Types may go with all their records, or while they have none."""
    regions = _read(spark, sf_dir, "region").select(F.concat(F.lit("region:"), F.col("r_regionkey").cast("string")).alias("target_id"), F.lit("object").alias("target_type"))
    kinds = spark.createDataFrame([(t, "object_type") for t in ("region", "nation", "customer", "invoice")] + [("supplied_by", "relationship_type"), ("billed_by", "relationship_type")], "target_id string, target_type string")
    rows = regions.unionByName(kinds).withColumns({"operation": F.lit("delete"), "after_json": F.lit(None).cast("string")})
    d = graphview.dataset(spark, sf_dir)
    out = commit.protected(rows, "object", d.objects).unionByName(commit.protected(rows, "relationship", d.relationships))
    return out.select("target_type", "target_id")


@query(sql("SELECT seq FROM (SELECT seq, row_number() OVER (PARTITION BY proposal_id, target_id, operation, CASE WHEN operation = 'update' THEN field ELSE '' END ORDER BY seq DESC) AS r FROM changes) WHERE r = 1", LOG))
def last_recorded(spark, sf_dir):
    return commit.last_recorded(graphview.changes(spark, sf_dir)).select("seq")


@query(sql("SELECT seq FROM changes WHERE target_id NOT IN (SELECT 'customer:' || c_custkey FROM customer WHERE c_nationkey = 3)", LOG))
def discarded(spark, sf_dir):
    gone = _read(spark, sf_dir, "customer").where("c_nationkey = 3").select(F.concat(F.lit("customer:"), F.col("c_custkey").cast("string")).alias("target_id"))
    return commit.discard(graphview.changes(spark, sf_dir), gone).select("seq")


@query("SELECT 'customer:' || c_custkey AS target_id, 'attributes.mktsegment' AS field, c_mktsegment AS old, 'BUILDING' AS new FROM customer WHERE c_custkey < 40 AND c_mktsegment <> 'BUILDING' UNION ALL SELECT 'customer:' || c_custkey, 'attributes.acctbal', c_acctbal::VARCHAR, NULL FROM customer WHERE c_custkey < 40")
def bulk_edit(spark, sf_dir):
    """Forty selected records; a selection is what the operator takes."""
    out = commit.bulk_edit(graphview.objects(spark, sf_dir).where("type_id = 'customer'"), [f"customer:{n}" for n in range(40)], {"attributes.mktsegment": "BUILDING", "attributes.acctbal": None}, 0, "p")
    get = lambda c, f: F.get_json_object(c, f"$.{f}")
    return out.select("target_id", get("after_json", "field").alias("field"), get("before_json", "value").alias("old"), get("after_json", "value").alias("new"))


# ---- validation


def _odd_customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.substring("id", 10, 20).cast("long")
    rows = graphview.objects(spark, sf_dir).where("type_id = 'customer'")
    rows = rows.withColumn("name", F.when(k % 9 == 0, F.lit(" \t")).when(k % 9 == 1, F.repeat(F.lit("x"), 256)).otherwise(F.col("name")))
    return rows.withColumn("is_active", F.when(k % 9 == 2, F.lit(None).cast("boolean")).otherwise(F.lit(True)))


@query("SELECT CASE c_custkey % 9 WHEN 0 THEN 'name_required' WHEN 1 THEN 'name_too_long' ELSE 'invalid_is_active' END AS code, 'customer:' || c_custkey AS target_id FROM customer WHERE c_custkey % 9 < 3")
def v_fields(spark, sf_dir):
    return validation.field_issues(_odd_customers(spark, sf_dir), "object").select("code", "target_id")


def _typed_orders(spark: SparkSession, sf_dir: str, data_type: str, nullable: bool = True) -> DataFrame:
    """Order dates as texts good and bad for a data type, held against one definition."""
    k = F.substring("id", 7, 20).cast("long")
    day = F.substring(attribute("orderdate"), 1, 10)
    value = F.when(k % 5 == 0, day).when(k % 5 == 1, F.concat(day, F.lit("T10:30"))).when(k % 5 == 2, F.concat(F.lit("1995-02-3"), (k % 2).cast("string"))).when(k % 5 == 3, F.lit(None).cast("string")).otherwise(F.lit("soon"))
    rows = graphview.objects(spark, sf_dir).where("type_id = 'order'").withColumn("attributes", F.create_map(F.lit("orderdate"), value))
    defs = graphview.dataset(spark, sf_dir).attribute_defs.where("id = 'order.orderdate'").withColumns({"data_type": F.lit(data_type), "nullable": F.lit(nullable)})
    return validation.attribute_issues(rows, defs, "object").select("code", "target_id")


for _name, _args, _sql in (
    ("v_date", ("date",), "SELECT 'invalid_date' AS code, 'order:' || o_orderkey AS target_id FROM orders WHERE o_orderkey % 5 IN (1, 2, 4)"),
    ("v_datetime", ("datetime",), "SELECT 'invalid_datetime' AS code, 'order:' || o_orderkey AS target_id FROM orders WHERE o_orderkey % 5 IN (2, 4)"),
    ("v_unsupported_type", ("money",), "SELECT 'unsupported_attribute_type' AS code, 'order:' || o_orderkey AS target_id FROM orders WHERE o_orderkey % 5 <> 3"),
    ("v_null", ("text", False), "SELECT 'null_not_allowed' AS code, 'order:' || o_orderkey AS target_id FROM orders WHERE o_orderkey % 5 = 3"),
):
    FOUND[_name] = partial(lambda args, spark, sf_dir: _typed_orders(spark, sf_dir, *args), _args)
    SQL[_name] = _sql


@query("SELECT 'object_type_model_mismatch' AS code, 'customer:' || c_custkey AS target_id FROM customer WHERE c_nationkey % 2 = 1 UNION ALL SELECT 'object_type_model_mismatch', 'supplier:' || s_suppkey FROM supplier WHERE s_nationkey % 2 = 0")
def v_model(spark, sf_dir):
    """Records of two models against types of either."""
    c = _read(spark, sf_dir, "customer").select(F.concat(F.lit("customer:"), F.col("c_custkey").cast("string")).alias("id"), F.lit("customer").alias("type_id"), (F.col("c_nationkey") % 2).alias("model_id"))
    s = _read(spark, sf_dir, "supplier").select(F.concat(F.lit("supplier:"), F.col("s_suppkey").cast("string")).alias("id"), F.lit("supplier").alias("type_id"), (F.col("s_nationkey") % 2).alias("model_id"))
    types = spark.createDataFrame([("customer", 0), ("supplier", 1)], "id string, model_id int")
    return validation.model_mismatches(c.unionByName(s), types, "object").select("code", "target_id")


@query(sql(
    """SELECT 'structural_invalid' AS code, 'brand:' || b || '.size' AS target_id FROM sizes WHERE n % 2 = 0 AND least < most
UNION ALL SELECT 'structural_invalid', 'brand:' || b || '.ptype' FROM sizes WHERE n % 5 = 0 OR n % 7 = 0
UNION ALL SELECT 'structural_invalid', 'brand:' || b || '.size' FROM sizes WHERE n % 2 = 1 AND n % 3 = 0 AND most <> least
UNION ALL SELECT 'structural_invalid', id FROM base_rules WHERE o_max % 2 = 1""",
    BASE_ONTOLOGY, "sizes AS (SELECT p_brand AS b, split_part(p_brand, '#', 2)::INT AS n, min(p_size) AS least, max(p_size) AS most FROM part GROUP BY p_brand)",
))
def v_structural(spark, sf_dir):
    """Derived definitions with bounds the wrong way round, repeated choices, choices of a text, a default out of bounds; rules likewise."""
    d = derived.dataset(spark, sf_dir)
    n, size = F.regexp_extract("owner_id", "#([0-9]+)", 1).try_cast("int"), F.col("key") == "size"
    ptype = F.col("key") == "ptype"
    defs = d.attribute_defs.select("*", F.when(size & (n % 2 == 0), F.struct(F.col("most").alias("least"), F.col("least").alias("most"))).otherwise(F.struct("least", "most")).alias("bounds"))
    defs = defs.withColumns(
        {
            "least": F.col("bounds.least"), "most": F.col("bounds.most"),
            "choices": F.when(ptype & (n % 5 == 0), F.concat("choices", "choices")).otherwise(F.col("choices")),
            "data_type": F.when(ptype & (n % 7 == 0), "text").otherwise(F.col("data_type")),
            "default_value": F.when(size & (n % 2 == 1) & (n % 3 == 0), F.when(F.col("most") != F.col("least"), (F.col("most") + 1).cast("string")).otherwise(F.col("most").cast("string"))).when(ptype & (n % 5 != 0) & (n % 7 != 0), F.element_at("choices", 1)),
        }
    ).drop("bounds")
    rules = d.rules.withColumns({"s_min": F.when(F.col("o_max") % 2 == 1, 2).otherwise(F.col("s_min")), "s_max": F.when(F.col("o_max") % 2 == 1, 1).otherwise(F.col("s_max"))})
    return validation.structural_issues(d.with_(attribute_defs=defs, rules=rules)).select("code", "target_id")


@query(sql(
    """SELECT code, count(*)::BIGINT AS n FROM (
  SELECT CASE c_custkey % 9 WHEN 0 THEN 'name_required' ELSE 'name_too_long' END AS code FROM customer WHERE c_custkey % 9 < 2
  UNION ALL SELECT CASE WHEN n < least THEN CASE WHEN side = 'subject' THEN 'object' ELSE 'subject' END || '_cardinality_minimum' ELSE CASE WHEN side = 'subject' THEN 'object' ELSE 'subject' END || '_cardinality_maximum' END
    FROM sides WHERE (n < least OR n > most) AND NOT (id LIKE 'customer:%' AND split_part(id, ':', 2)::BIGINT % 9 = 2)) GROUP BY code""",
    OBJECTS, EDGES, CARDINALITY,
))
def validate_model(spark, sf_dir):
    """Every rule over the whole graph with odd customers; a record neither active nor not is left out, as inactive ones are."""
    d = graphview.dataset(spark, sf_dir)
    rows = d.objects.where("type_id <> 'customer'").unionByName(_odd_customers(spark, sf_dir))
    return validation.validate(d.with_(objects=rows)).groupBy("code").agg(F.count(F.lit(1)).alias("n"))


# ---- imports


@query("SELECT 'k' || c_custkey AS row_id, CASE WHEN c_custkey % 4 = 0 THEN NULL ELSE 'customer:' || c_custkey END AS object_id, CASE WHEN c_custkey % 4 = 0 THEN 'unresolved_identity' END AS problem FROM customer UNION ALL SELECT 'blank', NULL, 'missing_identity'")
def identify_by_key(spark, sf_dir):
    k = F.col("c_custkey").cast("string")
    rows = _read(spark, sf_dir, "customer").select(F.concat(F.lit("k"), k).alias("row_id"), F.concat(F.lit(" customer_"), k, F.when(F.col("c_custkey") % 4 == 0, "x").otherwise(" ")).alias("cell"))
    rows = rows.unionByName(spark.createDataFrame([("blank", "  ")], "row_id string, cell string"))
    return importing.identify(rows, graphview.objects(spark, sf_dir), "customer", key="cell").select("row_id", "object_id", "problem")


@query("SELECT o_orderkey AS n, CASE WHEN o_orderkey % 3 = 0 THEN 'customer:' || o_custkey END AS object_id, CASE o_orderkey % 3 WHEN 1 THEN 'wrong_object_type' WHEN 2 THEN 'invalid_identity_id' END AS problem FROM orders")
def identify_by_id(spark, sf_dir):
    cell = F.when(F.col("o_orderkey") % 3 == 0, F.concat(F.lit("customer:"), F.col("o_custkey").cast("string"))).when(F.col("o_orderkey") % 3 == 1, F.concat(F.lit("order:"), F.col("o_orderkey").cast("string"))).otherwise(F.lit("not there"))
    rows = _read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("n"), cell.alias("cell"))
    return importing.identify(rows, graphview.objects(spark, sf_dir), "customer", id_="cell").select("n", "object_id", "problem")


@query("SELECT c_custkey AS n, CASE WHEN c_custkey % 2 = 1 THEN 'identity_mismatch' END AS problem FROM customer WHERE c_custkey + 1 < (SELECT count(*) FROM customer)")
def identify_mismatch(spark, sf_dir):
    """A key cell and an id cell, of one record or of two."""
    n = F.col("c_custkey")
    rows = _read(spark, sf_dir, "customer").where(n + 1 < _read(spark, sf_dir, "customer").count())
    rows = rows.select(n.alias("n"), F.concat(F.lit("customer_"), n.cast("string")).alias("k"), F.concat(F.lit("customer:"), (n + n % 2).cast("string")).alias("i"))
    return importing.identify(rows, graphview.objects(spark, sf_dir), "customer", key="k", id_="i").select("n", "problem")


@query("SELECT l_orderkey AS o, l_linenumber AS line, l_partkey AS p, 'part:' || l_partkey AS object_id, 'part' AS object_type FROM lineitem")
def endpoint_by_id(spark, sf_dir):
    rows = _read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o"), F.col("l_linenumber").alias("line"), F.col("l_partkey").alias("p"), F.concat(F.lit("part:"), F.col("l_partkey").cast("string")).alias("cell"))
    return importing.resolve_endpoints(rows, "cell", graphview.objects(spark, sf_dir), ["part"], by="id", prefix="object").select("o", "line", "p", "object_id", "object_type")


@query("SELECT p_brand AS cell, CASE WHEN n = 1 THEN one END AS subject_id, CASE WHEN n > 1 THEN 'ambiguous_endpoint' END AS subject_problem FROM (SELECT p_brand, count(*) AS n, min('part:' || p_partkey) AS one FROM part GROUP BY p_brand) UNION ALL SELECT 'Brand#none', NULL, 'unresolved_endpoint'")
def endpoint_by_attribute(spark, sf_dir):
    rows = _read(spark, sf_dir, "part").select(F.col("p_brand").alias("cell")).distinct().unionByName(spark.createDataFrame([("Brand#none",)], "cell string"))
    return importing.resolve_endpoints(rows, "cell", graphview.objects(spark, sf_dir), ["part"], by="attribute:brand").select("cell", "subject_id", "subject_problem")


@query("SELECT l_orderkey AS o, l_linenumber AS line, l_partkey AS p, CASE WHEN l_partkey % 4 = 0 THEN 'part:' || l_partkey END AS object_id, CASE l_partkey % 4 WHEN 1 THEN 'invalid_endpoint_id' WHEN 2 THEN 'unresolved_endpoint' WHEN 3 THEN 'missing_endpoint' END AS object_problem FROM lineitem")
def endpoint_id_problems(spark, sf_dir):
    p = F.col("l_partkey")
    cell = F.when(p % 4 == 0, F.concat(F.lit(" part:"), p.cast("string"))).when(p % 4 == 1, F.concat(F.lit("no part "), p.cast("string"))).when(p % 4 == 2, "{00000000-0000-0000-0000-000000000001}").otherwise(" ")
    rows = _read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o"), F.col("l_linenumber").alias("line"), p.alias("p"), cell.alias("cell"))
    return importing.resolve_endpoints(rows, "cell", graphview.objects(spark, sf_dir), ["part"], by="id", prefix="object").select("o", "line", "p", "object_id", "object_problem")


@query(
    """WITH prices AS (SELECT p_retailprice AS v, count(*) AS n, min('part:' || p_partkey) AS one FROM part GROUP BY 1)
SELECT p_partkey AS k, CASE WHEN p_partkey % 3 = 0 AND n = 1 THEN one END AS subject_id, CASE p_partkey % 3 WHEN 1 THEN 'invalid_endpoint_value' WHEN 2 THEN 'unresolved_endpoint' ELSE CASE WHEN n > 1 THEN 'ambiguous_endpoint' END END AS subject_problem FROM part JOIN prices ON v = p_retailprice"""
)
def endpoint_by_number(spark, sf_dir):
    """Parts named by their price: written with white space, unreadable, or of no part."""
    k, price = F.col("p_partkey"), F.col("p_retailprice").cast("string")
    cell = F.when(k % 3 == 0, F.concat(F.lit("  "), price, F.lit(" "))).when(k % 3 == 1, F.concat(F.lit("about "), price)).otherwise("-1")
    rows = _read(spark, sf_dir, "part").select(k.alias("k"), cell.alias("cell"))
    return importing.resolve_endpoints(rows, "cell", graphview.objects(spark, sf_dir), ["part"], by="attribute:retailprice", data_type="number").select("k", "subject_id", "subject_problem")


@query("SELECT o_orderkey AS n, CASE WHEN o_orderkey % 5 = 0 THEN 'placed_by:' || o_orderkey END AS edge_id, CASE o_orderkey % 5 WHEN 1 THEN 'wrong_relationship_type' WHEN 2 THEN 'invalid_identity_id' WHEN 3 THEN 'unresolved_identity' WHEN 4 THEN 'missing_identity' END AS problem FROM orders")
def edge_identity(spark, sf_dir):
    o = F.col("o_orderkey")
    cell = F.when(o % 5 == 0, F.concat(F.lit("placed_by:"), o.cast("string"))).when(o % 5 == 1, "in_region:1").when(o % 5 == 2, "nothing").when(o % 5 == 3, "00000000000000000000000000000001").otherwise("")
    rows = _read(spark, sf_dir, "orders").select(o.alias("n"), cell.alias("cell"))
    return importing.identify_edges(rows, graphview.relationships(spark, sf_dir), "placed_by", "cell").select("n", "edge_id", "problem")


@query("SELECT o_orderkey AS n, CASE WHEN o_orderkey % 4 = 0 THEN 'missing_endpoint' WHEN o_orderkey % 4 = 1 THEN 'unresolved_endpoint' WHEN o_orderkey % 4 = 2 THEN 'endpoint_pair_not_allowed' END AS code FROM orders WHERE o_orderkey % 4 < 3")
def edge_problems(spark, sf_dir):
    d = graphview.dataset(spark, sf_dir)
    o = F.col("o_orderkey")
    cell = F.when(o % 4 == 0, " ").when(o % 4 == 1, "nothing").when(o % 4 == 2, "region_0").otherwise(F.concat(F.lit("customer_"), F.col("o_custkey").cast("string")))
    rows = _read(spark, sf_dir, "orders").select(o.cast("int").alias("row_number"), F.concat(F.lit("order_"), o.cast("string")).alias("s"), cell.alias("t"))
    rows = importing.resolve_endpoints(rows, "s", d.objects, ["order"])
    rows = importing.resolve_endpoints(rows, "t", d.objects, ["customer", "region"], prefix="object")
    return importing.plan_edges(rows, d.rules, d.relationships, "placed_by").problems.select(F.col("row_number").cast("long").alias("n"), "code")


LINE_EDGE = "'contains:' || l_orderkey || ':' || l_linenumber || ':' || l_partkey || ':' || l_suppkey || ':' || strftime(l_shipdate, '%Y%m%d') || ':' || round(l_extendedprice * 100)::BIGINT"
WHOLE = "CASE WHEN {0} = floor({0}) THEN {0}::BIGINT::VARCHAR ELSE {0}::VARCHAR END"


@query(
    f"""WITH lines AS (SELECT {LINE_EDGE} AS identity, * FROM lineitem)
SELECT identity, 'attributes.quantity' AS field, l_quantity::DOUBLE AS old, CASE WHEN l_orderkey % 4 > 0 THEN {WHOLE.format("(l_quantity + 1)")} END AS new FROM lines WHERE l_orderkey % 3 = 0 OR l_orderkey % 4 = 0
UNION ALL SELECT identity, 'is_active', NULL, 'false' FROM lines WHERE l_linenumber = 2 AND l_orderkey % 4 > 0"""
)
def plan_edge_updates(spark, sf_dir):
    """Every line item's edge by its id, some in two rows: changed and unchanged quantities, blanks that win, edges that are retired."""
    d = graphview.dataset(spark, sf_dir)
    o, items = F.col("l_orderkey"), _read(spark, sf_dir, "lineitem")
    quantity = F.when(o % 3 == 0, (F.col("l_quantity") + 1).cast("string")).otherwise(F.concat(F.lit(" "), F.col("l_quantity").cast("string"), F.lit(" ")))
    first = items.select((o * 2).alias("row_number"), graphview.contains_id().alias("cell"), quantity.alias("q"), F.when(F.col("l_linenumber") == 2, "no").otherwise(" TRUE ").alias("a"))
    again = items.where(o % 4 == 0).select((o * 2 + 1).alias("row_number"), graphview.contains_id().alias("cell"), F.lit(" ").alias("q"), F.lit("yes").alias("a"))
    rows = importing.identify_edges(first.unionByName(again), d.relationships, "contains", "cell")
    plan = importing.plan_edge_values(rows, d.relationships, d.attribute_defs, "contains", {"q": "attributes.quantity", "a": "is_active"})
    return plan.changes.select("identity", "field", F.col("old").try_cast("double").alias("old"), "new")


@query(
    """WITH pairs AS (SELECT o_orderkey, o_custkey % (SELECT count(*) FROM part) AS p FROM orders),
met AS (SELECT pairs.*, count(l_orderkey) AS n FROM pairs LEFT JOIN lineitem ON l_orderkey = o_orderkey AND l_partkey = p GROUP BY ALL),
made AS (SELECT 'contains:order:' || o_orderkey || ':part:' || p AS identity, o_orderkey FROM met WHERE n = 0)
SELECT identity, 'is_active' AS field, CASE WHEN o_orderkey % 5 = 0 THEN 'false' ELSE 'true' END AS new FROM made
UNION ALL SELECT identity, 'attributes.quantity', '7' FROM made UNION ALL SELECT identity, 'attributes.returnflag', 'R' FROM made WHERE o_orderkey % 2 = 0"""
)
def plan_edge_creates(spark, sf_dir):
    """An edge from every order to a part, by their keys: new pairs with the values of their cells."""
    d = graphview.dataset(spark, sf_dir)
    o, parts = F.col("o_orderkey"), _read(spark, sf_dir, "part").count()
    rows = _read(spark, sf_dir, "orders").select(o.alias("row_number"), F.concat(F.lit("order_"), o.cast("string")).alias("s"), F.concat(F.lit("part_"), (F.col("o_custkey") % parts).cast("string")).alias("t"), F.lit(" 7.0").alias("q"), F.when(o % 2 == 0, "R").otherwise("").alias("r"), F.when(o % 5 == 0, "no").alias("a"))
    rows = importing.resolve_endpoints(rows, "s", d.objects, ["order"])
    rows = importing.resolve_endpoints(rows, "t", d.objects, ["part"], prefix="object")
    rows = importing.match_edges(rows, d.rules, d.relationships, "contains")
    plan = importing.plan_edge_values(rows, d.relationships, d.attribute_defs, "contains", {"q": "attributes.quantity", "r": "attributes.returnflag", "a": "is_active"})
    return plan.changes.where("operation = 'create'").select("identity", "field", "new")


@query(
    sql(
        """SELECT seq, CASE WHEN t = 'click' OR t = 'error' AND k % 10 = 0 OR t = 'view' AND k % 10 = 1 THEN coalesce(own.name, 'Untitled') WHEN t = 'purchase' THEN CASE WHEN own.name IS NULL THEN 'Untitled' ELSE 'Size' END WHEN t = 'error' THEN CASE WHEN own.name IS NULL THEN 'Untitled' ELSE 'Type' END
    WHEN t = 'view' AND k % 10 = 2 THEN 'Extra' WHEN t = 'signup' AND r.id IS NULL THEN 'Untitled' ELSE coalesce(own.name, 'Untitled') || ' → ' || coalesce(maker.name, 'Untitled') END AS target_label,
  CASE WHEN t = 'view' AND k % 10 = 2 THEN coalesce(own.name, 'Untitled') WHEN t = 'view' AND k % 10 = 3 THEN (SELECT name FROM rel_types WHERE id = 'made_by') END AS parent_label
FROM told LEFT JOIN types own ON own.id = 'brand:' || b LEFT JOIN types maker ON maker.id = 'maker:' || k % 25 LEFT JOIN base_rules r ON r.id = 'made_by:' || b || ':' || k % 25
WHERE t IN ('click', 'purchase', 'signup') OR t = 'error' AND (k % 10 = 0 OR k % 50 = 5) OR t = 'view' AND k % 10 IN (1, 2, 3)""",
        BASE_ONTOLOGY,
        ONTOLOGY_LOG,
    )
)
def review_labels(spark, sf_dir):
    """Names of the types, definitions and rules that the events change, and of their parents."""
    return review.with_labels(derived.changes(spark, sf_dir), derived.dataset(spark, sf_dir)).select("seq", "target_label", "parent_label")


@query("SELECT 'customer:' || c_custkey AS identity, count(*)::BIGINT AS rows FROM customer JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey HAVING count(*) > 1")
def duplicate_identities(spark, sf_dir):
    rows = _read(spark, sf_dir, "orders").select(F.concat(F.lit("customer:"), F.col("o_custkey").cast("string")).alias("identity"))
    return importing.duplicate_identities(rows)


@query("SELECT c_custkey % 7 AS k, count(*)::BIGINT AS n, min(c_custkey)::BIGINT AS first_row, arg_max(c_name, c_custkey) AS cell FROM customer GROUP BY ALL")
def first_and_last_cells(spark, sf_dir):
    rows = _read(spark, sf_dir, "customer").select((F.col("c_custkey") % 7).alias("k"), F.col("c_custkey").alias("row_number"), F.col("c_name").alias("cell")).withColumns({"identity": F.col("k").cast("string"), "field": F.lit("name")})
    n = rows.groupBy("k").agg(F.count(F.lit(1)).alias("n"))
    return importing.last_cells(rows).select(F.col("identity").cast("long").alias("k"), "first_row", "cell").join(n, "k")


@query("SELECT count(DISTINCT p_partkey)::BIGINT AS creates, count(*) FILTER (p_size % 2 = 0)::BIGINT AS with_size, count(*)::BIGINT AS evidence FROM part")
def import_changes(spark, sf_dir):
    rows = _read(spark, sf_dir, "part").select(F.lit("create").alias("operation"), F.concat(F.lit("new:"), F.col("p_partkey").cast("string")).alias("identity"), F.explode(F.array_compact(F.array(F.struct(F.lit("name").alias("field"), F.col("p_name").alias("new")), F.when(F.col("p_size") % 2 == 0, F.struct(F.lit("attributes.size").alias("field"), F.col("p_size").cast("string").alias("new")))))).alias("e"), F.col("p_partkey").alias("first_row"))
    rows = rows.select("operation", "identity", "e.field", F.lit(None).cast("string").alias("old"), "e.new", "first_row")
    changes, evidence = change_plan.import_changes(rows, "p", "part", "parts.csv")
    one = changes.agg(F.countDistinct("target_id").alias("creates"), F.count_if(F.get_json_object("after_json", "$.attributes.size").isNotNull()).alias("with_size"))
    return one.join(evidence.agg(F.count(F.lit(1)).alias("evidence")), F.lit(True))


# ---- change plans


def _plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A plan of one operation for each supplier, good or bad by its number."""
    k = F.col("s_suppkey")
    m = k % 8
    token = F.concat(F.lit("t"), k.cast("string"))
    operation = F.when(m.isin(3, 4), "update").when(m == 5, "delete").when(m == 7, "merge").otherwise("create")
    kind = F.when(m == 6, "relationship").otherwise("object")
    ref = F.when(m == 3, F.concat(F.lit("supplier:"), k.cast("string"))).when(m.isin(4, 5), F.concat(F.lit("nobody:"), k.cast("string"))).when(m == 1, F.lit("same")).otherwise(token)
    fields = F.when(m == 6, F.create_map(F.lit("source"), F.lit("part:1"), F.lit("target"), F.lit("new:missing"))).when(m == 3, F.create_map().cast("map<string,string>")).otherwise(F.create_map(F.lit("name"), F.col("s_name")))
    return _read(spark, sf_dir, "supplier").select(
        k.cast("int").alias("n"), operation.alias("operation"), kind.alias("target_type"), F.when(m.isin(3, 4, 5), "existing").otherwise("new").alias("ref_kind"), ref.alias("ref"),
        F.when(operation == "create", F.when(kind == "object", "object_type").otherwise("relationship_type")).alias("parent_type"), F.when(operation == "create", "existing").alias("parent_ref_kind"),
        F.when(m == 2, None).when(kind == "relationship", "supplied_by").when(operation == "create", "supplier").alias("parent_ref"), fields.alias("fields"),
    )


@query(
    """SELECT code, s_suppkey::INT AS n FROM supplier, (VALUES (2, 'parent_required'), (3, 'nothing_to_change'), (4, 'unknown_record'), (5, 'unknown_record'), (6, 'dangling_token'), (7, 'unknown_operation')) v(m, code) WHERE s_suppkey % 8 = m
UNION ALL SELECT 'token_used_twice', s_suppkey::INT FROM supplier WHERE s_suppkey % 8 = 1 AND (SELECT count(*) FROM supplier WHERE s_suppkey % 8 = 1) > 1"""
)
def change_plan_problems(spark, sf_dir):
    return change_plan.problems(_plan(spark, sf_dir), graphview.dataset(spark, sf_dir)).select("code", "n")


@query("SELECT s_suppkey * 1000 AS seq, 'create' AS operation, s_name AS name, 'supplier' AS parent_id FROM supplier WHERE s_suppkey % 8 = 0 UNION ALL SELECT s_suppkey * 1000, 'delete', NULL, NULL FROM supplier WHERE s_suppkey % 8 = 5 UNION ALL SELECT s_suppkey * 1000, 'update', s_name, NULL FROM supplier WHERE s_suppkey % 8 = 4")
def change_plan_compiled(spark, sf_dir):
    rows = change_plan.compiled(_plan(spark, sf_dir).where("n % 8 in (0, 4, 5)"), "p")
    name = F.coalesce(F.get_json_object("after_json", "$.name"), F.get_json_object("after_json", "$.value"))
    return rows.select("seq", "operation", name.alias("name"), "parent_id")


def _template(spark: SparkSession, sf_dir: str) -> dict:
    """A template of regions and nations, its choices and bounds from the suppliers: tables that are bounded by nature."""
    regions, nations = _read(spark, sf_dir, "region").collect(), _read(spark, sf_dir, "nation").collect()
    some = _read(spark, sf_dir, "supplier").groupBy("s_nationkey").agg(F.count(F.lit(1)).alias("n"))
    n = {r["s_nationkey"]: r["n"] for r in some.join(_read(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).collect()}  # a row a nation
    return {
        "object_types": [{"key": "region", "name": "Region"}, {"key": "nation", "name": "Nation", "attributes": [{"key": "suppliers", "name": "Suppliers", "data_type": "number", "least": 0, "most": max(n.values()), "required": True}]}],
        "relationship_types": [{"key": "lies_in", "name": "Lies in", "rules": [{"subject": "nation", "object": "region", "s_min": 0, "o_min": 1, "o_max": len(regions)}]}],
        "objects": [{"key": f"region_{r['r_regionkey']}", "name": r["r_name"], "type": "region"} for r in regions] + [{"key": f"nation_{r['n_nationkey']}", "name": r["n_name"], "type": "nation", "attributes": {"suppliers": n.get(r["n_nationkey"], 0)}} for r in nations],
        "relationships": [{"type": "lies_in", "source": f"nation_{r['n_nationkey']}", "target": f"region_{r['n_regionkey']}"} for r in nations],
    }


def _template_model(spark: SparkSession, sf_dir: str):
    """A model made of a template alone."""
    d = graphview.dataset(spark, sf_dir)
    none = d.with_(**{t: getattr(d, t).where("false") for t in commit.TABLES})
    plan = templates.operations(spark, _template(spark, sf_dir))
    if not change_plan.problems(plan, none).isEmpty():
        raise ValueError("the template has problems")
    return commit.apply(none, change_plan.compiled(plan, "p"))


@query(
    """WITH n AS (SELECT n_nationkey, n_name, n_regionkey, count(s_suppkey) AS n FROM nation LEFT JOIN supplier ON s_nationkey = n_nationkey GROUP BY ALL)
SELECT 'type' AS kind, 'Region' AS name, NULL AS a, NULL AS b, NULL AS c FROM region HAVING count(*) > 0 UNION ALL SELECT 'type', 'Nation', NULL, NULL, NULL FROM nation HAVING count(*) > 0
UNION ALL SELECT 'definition', 'Suppliers', 'Nation', max(n)::VARCHAR, 'true' FROM n UNION ALL SELECT 'rule', 'Lies in', 'Nation', 'Region', '0..* 1..' || count(*) FROM region
UNION ALL SELECT 'object', r_name, 'Region', NULL, NULL FROM region UNION ALL SELECT 'object', n_name, 'Nation', n::VARCHAR, NULL FROM n
UNION ALL SELECT 'edge', 'Lies in', n_name, r_name, NULL FROM n JOIN region ON r_regionkey = n_regionkey"""
)
def template_model(spark, sf_dir):
    m = _template_model(spark, sf_dir)
    named = lambda df, c: df.select(F.col("id").alias(c), F.col("name").alias(f"{c}_name"))
    none = F.lit(None).cast("string")
    rows = lambda df, kind, name, a=none, b=none, c=none: df.select(F.lit(kind).alias("kind"), F.col(name).alias("name"), a.alias("a"), b.alias("b"), c.alias("c"))
    out = rows(m.object_types, "type", "name")
    out = out.unionByName(rows(m.attribute_defs.join(named(m.object_types, "owner_id"), "owner_id"), "definition", "name", F.col("owner_id_name"), F.col("most").cast("int").cast("string"), F.col("required").cast("string")))
    r = m.rules.join(named(m.relationship_types, "rel_type_id"), "rel_type_id").join(named(m.object_types, "subject_type_id"), "subject_type_id").join(named(m.object_types, "object_type_id"), "object_type_id")
    out = out.unionByName(rows(r, "rule", "rel_type_id_name", F.col("subject_type_id_name"), F.col("object_type_id_name"), F.concat_ws(" ", text.bounds_label(F.col("s_min"), F.col("s_max")), text.bounds_label(F.col("o_min"), F.col("o_max")))))
    out = out.unionByName(rows(m.objects.join(named(m.object_types, "type_id"), "type_id"), "object", "name", F.col("type_id_name"), attribute("suppliers")))
    e = m.relationships.join(named(m.relationship_types, "type_id"), "type_id").join(named(m.objects, "source_id"), "source_id").join(named(m.objects, "target_id"), "target_id")
    return out.unionByName(rows(e, "edge", "type_id_name", F.col("source_id_name"), F.col("target_id_name")))


# ---- facets, details, context


@query(
    """SELECT 'true' AS choice, count(*) FILTER (c_acctbal < 0)::BIGINT AS n FROM customer UNION ALL SELECT 'false', count(*) FILTER (c_acctbal >= 0)::BIGINT FROM customer"""
)
def facet_boolean(spark, sf_dir):
    d = _with_owing(spark, sf_dir)
    return facets.boolean_counts(d).select("choice", "n")


def _with_owing(spark: SparkSession, sf_dir: str):
    d = graphview.dataset(spark, sf_dir)
    owing = (attribute("acctbal").cast("double") < 0).cast("string")
    objects = d.objects.withColumn("attributes", F.when(F.col("type_id") == "customer", F.map_concat("attributes", F.create_map(F.lit("owing"), owing))).otherwise(F.col("attributes")))
    one = d.attribute_defs.where("id = 'customer.acctbal'").withColumns({"id": F.lit("customer.owing"), "key": F.lit("owing"), "data_type": F.lit("boolean")})
    return d.with_(objects=objects, attribute_defs=d.attribute_defs.unionByName(one))


@query(sql(
    """SELECT 'object_type' AS facet, type_id, '' AS attribute, '' AS choice, count(*)::BIGINT AS n FROM objects GROUP BY ALL UNION ALL SELECT 'object_type', 'invoice', '', '', 0
UNION ALL SELECT 'relationship_type', type_id, '', '', count(*)::BIGINT FROM edges GROUP BY ALL UNION ALL SELECT 'relationship_type', 'billed_by', '', '', 0
UNION ALL SELECT 'choice', * FROM (""" + SQL["facet_choice"] + """)
UNION ALL SELECT 'boolean', 'customer', 'owing', choice, n FROM (""" + SQL["facet_boolean"] + ")",
    OBJECTS, EDGES,
))
def facet_document(spark, sf_dir):
    return facets.facets(_with_owing(spark, sf_dir))


@query(sql("SELECT id, string_agg(line, chr(10) ORDER BY line) AS extract FROM (SELECT e.id, upper(left(edge_type_id, 1)) || replace(substr(edge_type_id, 2), '_', ' ') || ': ' || string_agg(o.name, ', ' ORDER BY o.name) AS line FROM ends e JOIN objects o ON o.id = other_id WHERE e.id LIKE 'supplier:%' GROUP BY e.id, edge_type_id) GROUP BY id", OBJECTS, EDGES, ENDS))
def extracts(spark, sf_dir):
    d = graphview.dataset(spark, sf_dir)
    return details.extract(details.object_details(d, d.objects.where("type_id = 'supplier'")))


@query(sql(
    """SELECT o.id, coalesce(w.hops, 2)::INT AS priority, d.degree FROM objects o JOIN degrees d ON d.id = o.id LEFT JOIN (SELECT 'nation:3' AS id, 0 AS hops UNION ALL SELECT DISTINCT other_id, 1 FROM ends WHERE id = 'nation:3') w ON w.id = o.id
ORDER BY priority, d.degree DESC, lower(o.name), o.id LIMIT 300""",
    OBJECTS, EDGES, ENDS, DEGREES,
))
def context_slice(spark, sf_dir):
    return context.slice_(graphview.dataset(spark, sf_dir), spark.createDataFrame([("nation:3",)], "id string"), hops=1).select("id", "priority", "degree")


@query("SELECT json_extract_string(props, '$.k')::INT % 5 AS k, sum(value) AS total FROM events GROUP BY ALL")
def usage_totals(spark, sf_dir):
    e = _read(spark, sf_dir, "events").select(F.col("event_id").alias("seq"), F.to_json(F.map_from_arrays(F.array((F.get_json_object("props", "$.k").cast("int") % 5).cast("string")), F.array("value"))).alias("usage_json"))
    return context.usage(e).select(F.col("key").cast("int").alias("k"), "total")


@query(sql("SELECT id, type_name FROM (SELECT id, 'Customer' AS type_name FROM objects WHERE type_id = 'customer' UNION ALL SELECT id, 'Supplier' FROM objects WHERE type_id = 'supplier')", OBJECTS))
def endpoint_candidates(spark, sf_dir):
    d = graphview.dataset(spark, sf_dir)
    allowed = d.rules.where("rel_type_id = 'based_in'").select(F.col("subject_type_id").alias("type_id"))
    return review.endpoint_candidates(d.objects, d.object_types, allowed).select("id", "type_name")


@query("SELECT count(*) FILTER (c_custkey % 3 = 0)::BIGINT AS hidden, count(*) FILTER (c_custkey % 3 <> 0)::BIGINT AS shown FROM customer WHERE contains(c_name, '7')")
def inactive_matches(spark, sf_dir):
    rows = graphview.objects(spark, sf_dir).where("type_id = 'customer'").withColumn("is_active", F.substring("id", 10, 20).cast("long") % 3 != 0)
    return review.inactive_matches(rows, "customer 7")


# ---- publications, tasks


SCOPE = Scope(("part",), (), (Filter("customer", "mktsegment", "in", values=("building",)),), (), None)
WITHIN = "within_ AS (SELECT * FROM objects WHERE type_id <> 'part' AND (type_id <> 'customer' OR mktsegment = 'BUILDING'))"


@query(sql("SELECT t AS type_id, (SELECT count(*) FROM objects WHERE type_id = t AND (t = 'part' OR id IN (SELECT id FROM within_)))::BIGINT AS n, t = 'part' AS excluded, t = 'invoice' AS empty, t <> 'invoice' AS applicable FROM (VALUES ('region'), ('nation'), ('customer'), ('supplier'), ('part'), ('order'), ('invoice')) v(t)", OBJECTS, WITHIN))
def scope_types(spark, sf_dir):
    d = graphview.dataset(spark, sf_dir)
    out = publication.scope_types(d.object_types, d.objects, reach.apply_scope(d, SCOPE).objects, SCOPE.exclude_objects)
    return out.drop("name")


@query(sql("SELECT (SELECT count(*) FROM within_)::BIGINT AS objects, (SELECT count(*) FROM edges WHERE source_id IN (SELECT id FROM within_) AND target_id IN (SELECT id FROM within_))::BIGINT AS relationships, (SELECT count(*) FROM objects)::BIGINT AS total_objects, (SELECT count(*) FROM edges)::BIGINT AS total_relationships", OBJECTS, EDGES, WITHIN))
def publication_summary(spark, sf_dir):
    d = graphview.dataset(spark, sf_dir)
    return publication.summary(d, reach.apply_scope(d, SCOPE))


@query("SELECT 'nation:' || n_nationkey AS id, n_name AS name, 'Nation' AS type_name FROM nation")
def named_objects(spark, sf_dir):
    d = graphview.dataset(spark, sf_dir)
    ids = _read(spark, sf_dir, "customer").select(F.concat(F.lit("nation:"), F.col("c_nationkey").cast("string")).alias("id")).unionByName(_read(spark, sf_dir, "nation").select(F.concat(F.lit("nation:"), F.col("n_nationkey").cast("string")).alias("id")))
    return publication.named_objects(d, ids.unionByName(spark.createDataFrame([("nation:none",)], "id string")))


@query(sql("SELECT seq, target_id FROM changes WHERE proposal_id::INT % 5 <> 4 AND target_id IN (SELECT 'customer:' || c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')", LOG))
def published_provenance(spark, sf_dir):
    from .queries import _proposals

    d = graphview.dataset(spark, sf_dir)
    shown = d.with_(objects=d.objects.where((F.col("type_id") == "customer") & (attribute("mktsegment") == "BUILDING")), relationships=d.relationships.where("false"))
    return publication.published_provenance(shown, graphview.changes(spark, sf_dir), *_proposals(spark)).select("seq", "target_id")


@query("SELECT user_id AS model_id, max(event_id)::BIGINT AS sequence FROM events GROUP BY user_id")
def latest_publication(spark, sf_dir):
    return export.latest(_read(spark, sf_dir, "events").select(F.col("user_id").alias("model_id"), F.col("event_id").alias("sequence"))).select("model_id", "sequence")


TASKS = "tasks AS (SELECT event_id AS id, user_id AS model_id, ts AS created_at, CASE event_type WHEN 'click' THEN 'running' WHEN 'view' THEN 'completed' ELSE 'failed' END AS status, (user_id % 20)::VARCHAR AS proposal_id FROM events)"


def _tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.col("event_type")
    return _read(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.col("user_id").alias("model_id"), F.col("ts").alias("created_at"), F.when(kind == "click", "running").when(kind == "view", "completed").otherwise("failed").alias("status"), (F.col("user_id") % 20).cast("string").alias("proposal_id"))


@query(sql("SELECT id, coalesce(n, 0)::BIGINT AS change_count FROM tasks LEFT JOIN (SELECT proposal_id, count(*) AS n FROM changes GROUP BY 1) c USING (proposal_id) WHERE status = 'running' OR created_at >= (SELECT max(ts) - INTERVAL 2 DAY FROM events)", TASKS, LOG))
def recent_or_active_tasks(spark, sf_dir):
    rows = _tasks(spark, sf_dir)
    since = rows.agg(F.max("created_at")).first()[0]
    return tasks.recent_or_active(rows, F.lit(since) - F.expr("INTERVAL 2 DAYS"), graphview.changes(spark, sf_dir)).select("id", "change_count")


@query(sql("SELECT model_id, arg_min(id, (created_at, id)) AS task_id FROM tasks WHERE status = 'running' GROUP BY model_id", TASKS))
def active_task_by_model(spark, sf_dir):
    return tasks.active_by_model(_tasks(spark, sf_dir))


@query("SELECT status, reason, count(*)::BIGINT AS n FROM (SELECT CASE WHEN event_id % 7 = 0 OR event_type <> 'click' THEN 'failed' ELSE 'ready_for_review' END AS status, CASE WHEN event_id % 7 = 0 THEN 'execution_failed' ELSE CASE event_type WHEN 'click' THEN '' WHEN 'view' THEN 'unresolved' WHEN 'error' THEN 'needs_clarification' ELSE 'no_change_produced' END END AS reason FROM events) GROUP BY ALL")
def task_outcomes(spark, sf_dir):
    kind = F.col("event_type")
    rows = _read(spark, sf_dir, "events").select(F.when(F.col("event_id") % 7 == 0, "failed").otherwise("succeeded").alias("execution_status"), F.when(kind == "click", "ready_for_review").when(kind == "view", "unresolved").when(kind == "error", "needs_user_clarification").otherwise("no_change_required").alias("outcome"))
    return tasks.decided(rows).groupBy("status", "reason").agg(F.count(F.lit(1)).alias("n"))


@query(sql("SELECT proposal_id, count(*)::BIGINT AS changes, max(seq)::BIGINT AS latest FROM changes GROUP BY ALL", LOG))
def change_set_signatures(spark, sf_dir):
    return tasks.signatures(graphview.changes(spark, sf_dir), "seq")


@query("SELECT 'customer:' || c_custkey AS model_id, count(o_orderkey)::BIGINT AS n FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY ALL")
def per_model_counts(spark, sf_dir):
    rows = _read(spark, sf_dir, "orders").select(F.concat(F.lit("customer:"), F.col("o_custkey").cast("string")).alias("model_id"))
    return tasks.per_model(rows, graphview.objects(spark, sf_dir).where("type_id = 'customer'"))


@query("SELECT 'customer:' || c_custkey AS id FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')")
def deletable_models(spark, sf_dir):
    rows = _read(spark, sf_dir, "orders").select(F.concat(F.lit("customer:"), F.col("o_custkey").cast("string")).alias("model_id"), F.when(F.col("o_orderstatus") == "P", "processing").otherwise("completed").alias("status"))
    return tasks.deletable(graphview.objects(spark, sf_dir).where("type_id = 'customer'"), rows).select("id")


UPLOADS = "uploads AS (SELECT event_id AS id, user_id % 5 AS model_id, user_id AS uploaded_by, ts AS created_at, CASE WHEN event_type IN ('click', 'purchase') THEN ts END AS imported_at, event_id % 40 AS proposal_id FROM events)"


def _uploads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "events").select(F.col("event_id").alias("id"), (F.col("user_id") % 5).alias("model_id"), F.col("user_id").alias("uploaded_by"), F.col("ts").alias("created_at"), F.when(F.col("event_type").isin("click", "purchase"), F.col("ts")).alias("imported_at"), (F.col("event_id") % 40).alias("proposal_id"))


@query(sql("SELECT id FROM uploads WHERE imported_at IS NOT NULL UNION ALL SELECT arg_max(id, (created_at, id)) FROM uploads WHERE imported_at IS NULL GROUP BY model_id, uploaded_by", UPLOADS))
def uploads_replaced(spark, sf_dir):
    return staging.replaced(_uploads(spark, sf_dir)).select("id")


@query(sql("SELECT id FROM uploads WHERE imported_at IS NULL AND created_at >= (SELECT max(ts) - INTERVAL 3 DAY FROM events) OR imported_at IS NOT NULL AND proposal_id < 25", UPLOADS))
def uploads_swept(spark, sf_dir):
    rows = _uploads(spark, sf_dir)
    since = rows.agg(F.max("created_at")).first()[0]
    return staging.swept(rows, spark.range(25), F.lit(since) - F.expr("INTERVAL 3 DAYS")).select("id")


@query("SELECT 'n' || n_nationkey AS type_id, CASE WHEN n_nationkey % 3 = 0 THEN '#AABB0' || n_nationkey % 10 || '' WHEN n_nationkey % 3 = 1 THEN '#AABBCC' END AS background, CASE WHEN n_nationkey BETWEEN 10 AND 80 THEN n_nationkey::VARCHAR END AS size, CASE WHEN n_nationkey % 2 = 0 THEN 'dot' END AS shape, NULL::VARCHAR AS other FROM nation")
def styles_cleaned(spark, sf_dir):
    """A style for each nation, with values good and bad."""
    n = F.col("n_nationkey")
    color = F.when(n % 3 == 0, F.concat(F.lit(" #aabb0"), (n % 10).cast("string"))).when(n % 3 == 1, "#abc").otherwise("red")
    style = F.create_map(F.lit("background"), color, F.lit("size"), n.cast("double").cast("string"), F.lit("shape"), F.when(n % 2 == 0, "dot").otherwise("blob"), F.lit("other"), F.lit("x"))
    out = styles.cleaned(_read(spark, sf_dir, "nation").select(F.concat(F.lit("n"), n.cast("string")).alias("type_id"), style.alias("style")), styles.OBJECT_STYLE)
    return out.select("type_id", *[F.element_at("style", F.lit(k)).alias(k) for k in ("background", "size", "shape", "other")])


# ---- values and texts


@query("SELECT page_id, coalesce(regexp_matches(url, '^(https?|HTTPS?)://[^\\s/]+'), false) AS safe, CASE WHEN length(url) > 20 THEN left(url, 19) || '…' ELSE url END AS short FROM pages")
def page_urls(spark, sf_dir):
    return _read(spark, sf_dir, "pages").select("page_id", text.is_web_url(F.col("url")).alias("safe"), text.snippet(F.col("url"), 20).alias("short"))


@query("SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S') AS at, CASE WHEN event_id % 3 = 0 THEN 'Yes' WHEN event_id % 3 = 1 THEN 'No' END AS shown FROM events")
def display_values(spark, sf_dir):
    flag = F.when(F.col("event_id") % 3 == 0, "true").when(F.col("event_id") % 3 == 1, "FALSE").otherwise(" ")
    return _read(spark, sf_dir, "events").select("event_id", text.iso_time(F.col("ts")).alias("at"), text.display(flag, "boolean").alias("shown"))


@query("SELECT o_orderkey AS n, CASE WHEN o_totalprice = floor(o_totalprice) THEN o_totalprice::BIGINT::VARCHAR ELSE o_totalprice::VARCHAR END AS number_cell, CASE WHEN o_orderkey % 2 = 0 THEN 'true' ELSE '' END AS flag_cell, o_totalprice AS back FROM orders")
def format_cells(spark, sf_dir):
    """Stored values as template cells, and the number read back from its cell."""
    o = _read(spark, sf_dir, "orders")
    cell = values.format_cell(F.col("o_totalprice").cast("string"), F.lit("number"))
    flag = values.format_cell(F.when(F.col("o_orderkey") % 2 == 0, "TRUE"), F.lit("boolean"))
    return o.select(F.col("o_orderkey").alias("n"), cell.alias("number_cell"), flag.alias("flag_cell"), values.number_of(cell).alias("back"))


@query("SELECT event_id, CASE event_id % 4 WHEN 3 THEN NULL ELSE '00000000-0000-0000-0000-' || lpad(event_id::VARCHAR, 12, '0') END AS id FROM events")
def uuid_forms(spark, sf_dir):
    e, hexed = F.col("event_id"), F.lpad(F.col("event_id").cast("string"), 12, "0")
    form = F.when(e % 4 == 0, F.concat(F.lit("{00000000-0000-0000-0000-"), hexed, F.lit("}"))).when(e % 4 == 1, F.concat(F.lit("URN:UUID:00000000-0000-0000-0000-"), hexed)).when(e % 4 == 2, F.concat(F.lit(" 00000000000000000000"), hexed)).otherwise(F.concat(F.lit("no id "), hexed))
    return _read(spark, sf_dir, "events").select("event_id", text.uuid_of(form).alias("id"))


@query("SELECT p_partkey AS n, lower(replace(p_name, ' ', '_')) AS slug, upper(left(p_type, 1)) || lower(substr(p_type, 2)) AS label, p_size || '..' || CASE WHEN p_size % 2 = 0 THEN '*' ELSE (p_size + 5)::VARCHAR END AS bounds FROM part")
def slugs_and_labels(spark, sf_dir):
    return _read(spark, sf_dir, "part").select(F.col("p_partkey").alias("n"), text.slug(F.col("p_name")).alias("slug"), text.field_label(F.col("p_type")).alias("label"), text.bounds_label(F.col("p_size"), F.when(F.col("p_size") % 2 == 1, F.col("p_size") + 5)).alias("bounds"))


@query("SELECT event_id, event_id % 6 IN (0, 3, 4) AS same FROM events")
def same_values(spark, sf_dir):
    """Equality of stored values: numbers by value, kinds apart, nulls equal."""
    e = F.col("event_id")
    n = e.cast("string")
    a_kind = F.when(e % 6 == 3, "null").when(e % 6 == 5, "boolean").when(e % 6 == 4, "string").otherwise("number")
    b_kind = F.when(e % 6 == 3, "null").when(e % 6 == 5, "number").when(e % 6 == 1, "string").when(e % 6 == 4, "string").otherwise("number")
    a = F.when(e % 6 == 3, None).when(e % 6 == 5, F.lit("true")).otherwise(n)
    b = F.when(e % 6 == 3, None).when(e % 6 == 5, F.lit("1")).when(e % 6 == 0, F.concat(n, F.lit(".0"))).when(e % 6 == 2, F.concat(n, F.lit(".5"))).otherwise(n)
    return _read(spark, sf_dir, "events").select("event_id", values.same_value(a, a_kind, b, b_kind).alias("same"))
