"""One query per operator over the star-schema tables seen as a graph, each with the same in SQL."""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import text, values
from .operators import dataset as ds
from .operators import details, facets, importing, keys, overlay, projection, provenance, reach, review, search, styles, validation
from .plans.query import Filter, Query, Scope
from .sources import export, graphview

FOUND: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        FOUND[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


# ---- the graph in SQL; attributes are columns

OBJECTS = """
objects AS (
  SELECT 'region:' || r_regionkey AS id, 'region' AS type_id, r_name AS name, NULL::VARCHAR AS mktsegment, NULL::DOUBLE AS acctbal, NULL::VARCHAR AS brand, NULL::VARCHAR AS ptype, NULL::INT AS size, NULL::DOUBLE AS retailprice, NULL::VARCHAR AS status, NULL::DOUBLE AS totalprice, NULL::VARCHAR AS orderdate, NULL::VARCHAR AS priority FROM region
  UNION ALL SELECT 'nation:' || n_nationkey, 'nation', n_name, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL FROM nation
  UNION ALL SELECT 'customer:' || c_custkey, 'customer', c_name, c_mktsegment, c_acctbal, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL FROM customer
  UNION ALL SELECT 'supplier:' || s_suppkey, 'supplier', s_name, NULL, s_acctbal, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL FROM supplier
  UNION ALL SELECT 'part:' || p_partkey, 'part', p_name, NULL, NULL, p_brand, p_type, p_size, p_retailprice, NULL, NULL, NULL, NULL FROM part
  UNION ALL SELECT 'order:' || o_orderkey, 'order', 'Order#' || o_orderkey, NULL, NULL, NULL, NULL, NULL, NULL, o_orderstatus, o_totalprice, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S'), o_orderpriority FROM orders)"""
EDGES = """
edges AS (
  SELECT 'in_region:' || n_nationkey AS id, 'in_region' AS type_id, 'nation:' || n_nationkey AS source_id, 'region:' || n_regionkey AS target_id FROM nation
  UNION ALL SELECT 'based_in:c:' || c_custkey, 'based_in', 'customer:' || c_custkey, 'nation:' || c_nationkey FROM customer
  UNION ALL SELECT 'based_in:s:' || s_suppkey, 'based_in', 'supplier:' || s_suppkey, 'nation:' || s_nationkey FROM supplier
  UNION ALL SELECT 'placed_by:' || o_orderkey, 'placed_by', 'order:' || o_orderkey, 'customer:' || o_custkey FROM orders
  UNION ALL SELECT 'contains:' || l_orderkey || ':' || l_linenumber || ':' || l_partkey || ':' || l_suppkey || ':' || strftime(l_shipdate, '%Y%m%d') || ':' || round(l_extendedprice * 100)::BIGINT, 'contains', 'order:' || l_orderkey, 'part:' || l_partkey FROM lineitem
  UNION ALL SELECT DISTINCT 'supplied_by:' || l_partkey || ':' || l_suppkey, 'supplied_by', 'part:' || l_partkey, 'supplier:' || l_suppkey FROM lineitem)"""
ENDS = """
ends AS (SELECT source_id AS id, target_id AS other_id, id AS edge_id, type_id AS edge_type_id, 'out' AS direction FROM edges
  UNION ALL SELECT target_id, source_id, id, type_id, 'in' FROM edges WHERE source_id <> target_id)"""
DEGREES = """
degrees AS (SELECT o.id, coalesce(d.n, 0)::BIGINT AS degree FROM objects o LEFT JOIN (SELECT id, count(*) AS n FROM ends GROUP BY id) d ON o.id = d.id)"""
LOG = """
raw AS (SELECT *, CAST(json_extract_string(props, '$.k') AS INT) AS k FROM events),
log AS (
  SELECT event_id AS seq, (user_id % 20)::VARCHAR AS proposal_id,
    CASE WHEN event_type = 'view' AND k % 10 = 2 THEN 'create' WHEN event_type = 'error' AND k % 50 = 5 THEN 'delete'
         WHEN event_type IN ('purchase', 'signup', 'click') OR (event_type = 'error' AND k % 10 = 0) OR (event_type = 'view' AND k % 10 = 1) THEN 'update' END AS operation,
    CASE WHEN event_type = 'view' AND k % 10 = 2 THEN 'customer:new:' || event_id ELSE 'customer:' || user_id END AS target_id,
    CASE WHEN event_type = 'view' AND k % 10 = 2 AND event_id % 4 <> 0 THEN 'customer' END AS parent_id,
    CASE WHEN event_type = 'purchase' THEN 'attributes.acctbal' WHEN event_type = 'signup' THEN 'attributes.visits' WHEN event_type = 'click' THEN 'name' WHEN event_type IN ('error', 'view') THEN 'is_active' END AS field,
    value, k, event_type, event_id FROM raw),
changes AS (SELECT * FROM log WHERE operation IS NOT NULL),
lasts AS (SELECT target_id, field, arg_max(seq, seq) AS seq, arg_max(value, seq) AS value, arg_max(k, seq) AS k, arg_max(event_type, seq) AS event_type FROM changes WHERE operation = 'update' GROUP BY target_id, field),
alive AS (
  SELECT 'customer:' || c_custkey AS id, c_name AS name, c_mktsegment AS mktsegment, c_acctbal AS acctbal FROM customer
  WHERE 'customer:' || c_custkey NOT IN (SELECT target_id FROM changes WHERE operation = 'delete')
  UNION ALL SELECT target_id, 'New customer ' || event_id, 'BUILDING', NULL FROM changes WHERE operation = 'create' AND parent_id IS NOT NULL),
effective AS (
  SELECT a.id, coalesce('Customer v' || n.k, a.name) AS name, a.mktsegment, round(coalesce(b.value, a.acctbal), 2) AS acctbal, v.k AS visits,
    a.id IN (SELECT target_id FROM changes) AS is_proposed
  FROM alive a LEFT JOIN lasts n ON n.target_id = a.id AND n.field = 'name' LEFT JOIN lasts b ON b.target_id = a.id AND b.field = 'attributes.acctbal'
  LEFT JOIN lasts v ON v.target_id = a.id AND v.field = 'attributes.visits' LEFT JOIN lasts i ON i.target_id = a.id AND i.field = 'is_active'
  WHERE coalesce(i.event_type, 'view') = 'view')"""


def sql(body: str, *parts: str, recursive: bool = False) -> str:
    return f"WITH {'RECURSIVE ' if recursive else ''}{','.join(parts)}\n{body}"


GRAPH = (OBJECTS, EDGES, ENDS, DEGREES)
FLAGSHIP = Query(hide_objects=("order",), include=("order:1", "order:2"), filters=(Filter("part", "size", "range", least=10.0, most=20.0), Filter("part", "ptype", "in", values=("economy", "promo"))), limit=50)
PASSES = "(type_id <> 'part' OR (size BETWEEN 10 AND 20 AND lower(ptype) IN ('economy', 'promo')))"
STATUS = f"""
statuses AS (SELECT o.*, id IN ('order:1', 'order:2') AS included,
  CASE WHEN id IN ('order:1', 'order:2') THEN 'match' WHEN type_id = 'order' THEN 'type' WHEN NOT {PASSES} THEN 'filter' ELSE 'match' END AS verdict FROM objects o),
shown AS (SELECT s.id, s.type_id, s.name, s.included, d.degree FROM statuses s JOIN degrees d ON s.id = d.id WHERE verdict = 'match' ORDER BY included DESC, degree DESC, lower(name), s.id LIMIT 50)"""


def attribute(key: str):
    return F.element_at("attributes", F.lit(key))


# ---- filters


def _filtered(f: Filter, spark: SparkSession, sf_dir: str) -> DataFrame:
    from .operators.predicates import matches

    return graphview.objects(spark, sf_dir).where((F.col("type_id") == f.type_id) & matches(f)).select("id", "name")


for _name, _filter, _where in (
    ("filter_in", Filter("customer", "mktsegment", "in", values=("building", "machinery")), "type_id = 'customer' AND lower(mktsegment) IN ('building', 'machinery')"),
    ("filter_contains", Filter("part", "brand", "contains", text="#1"), "type_id = 'part' AND contains(lower(brand), '#1')"),
    ("filter_range_num", Filter("customer", "acctbal", "range", least=0.0, most=5000.0), "type_id = 'customer' AND acctbal BETWEEN 0 AND 5000"),
    ("filter_range_open", Filter("part", "retailprice", "range", least=1000.0), "type_id = 'part' AND retailprice >= 1000"),
    ("filter_range_date", Filter("order", "orderdate", "range", least="1996-01-01", most="1996-06"), "type_id = 'order' AND orderdate >= '1996-01-01' AND left(orderdate, 7) <= '1996-06'"),
):
    FOUND[_name] = partial(_filtered, _filter)
    SQL[_name] = sql(f"SELECT id, name FROM objects WHERE {_where}", OBJECTS)


@query(sql(f"SELECT type_id, count(*)::BIGINT AS n FROM objects WHERE {PASSES} AND (type_id <> 'customer' OR mktsegment = 'BUILDING') GROUP BY type_id", OBJECTS))
def filter_multi_type(spark, sf_dir):
    from .operators.predicates import passes

    filters = (*FLAGSHIP.filters, Filter("customer", "mktsegment", "in", values=("building",)))
    return graphview.objects(spark, sf_dir).where(passes(filters)).groupBy("type_id").agg(F.count(F.lit(1)).alias("n"))


@query(sql("SELECT id, type_id FROM objects WHERE type_id NOT IN ('order', 'part')", OBJECTS))
def hide_object_types(spark, sf_dir):
    return projection.statuses(graphview.objects(spark, sf_dir), Query(hide_objects=("order", "part"))).where("status = 'match'").select("id", "type_id")


@query(sql("SELECT type_id, count(*)::BIGINT AS n FROM edges WHERE type_id NOT IN ('contains', 'supplied_by') GROUP BY type_id", EDGES))
def hide_rel_types(spark, sf_dir):
    d = graphview.dataset(spark, sf_dir)
    return projection.shown_edges(d, Query(hide_relationships=("contains", "supplied_by")), d.objects).groupBy("type_id").agg(F.count(F.lit(1)).alias("n"))


@query(sql("SELECT id, verdict AS status, included FROM statuses WHERE type_id = 'order' AND verdict = 'match' OR type_id = 'part' AND verdict = 'filter'", *GRAPH, STATUS))
def include_override(spark, sf_dir):
    rows = projection.statuses(graphview.objects(spark, sf_dir), FLAGSHIP)
    return rows.where("(type_id = 'order' and status = 'match') or (type_id = 'part' and status = 'filter')").select("id", "status", "included")


# ---- projection


@query(sql("SELECT id, type_id, name, included, degree FROM shown", *GRAPH, STATUS))
def project_nodes(spark, sf_dir):
    return projection.shown_objects(graphview.dataset(spark, sf_dir), FLAGSHIP).select("id", "type_id", "name", "included", "degree")


@query(sql("SELECT e.id, e.type_id, source_id, target_id FROM edges e WHERE source_id IN (SELECT id FROM shown) AND target_id IN (SELECT id FROM shown)", *GRAPH, STATUS))
def project_edges(spark, sf_dir):
    return projection.project(graphview.dataset(spark, sf_dir), FLAGSHIP).edges.select("id", "type_id", "source_id", "target_id")


@query(
    sql(
        """SELECT count(*)::BIGINT AS total, count(*) FILTER (verdict = 'match')::BIGINT AS matching, count(*) FILTER (verdict = 'type')::BIGINT AS hidden_by_object_type,
  count(*) FILTER (verdict = 'filter')::BIGINT AS hidden_by_filter, count(*) FILTER (included)::BIGINT AS included, least(count(*) FILTER (verdict = 'match'), 50)::BIGINT AS shown, count(*) FILTER (verdict = 'match') > 50 AS truncated FROM statuses""",
        *GRAPH,
        STATUS,
    )
)
def project_summary(spark, sf_dir):
    return projection.summary(graphview.dataset(spark, sf_dir), FLAGSHIP)


@query(sql("SELECT o.id, name, degree FROM objects o JOIN degrees d ON o.id = d.id WHERE type_id IN ('part', 'supplier') ORDER BY degree DESC, lower(name), o.id LIMIT 200", *GRAPH))
def project_topk_ties(spark, sf_dir):
    q = Query(hide_objects=("region", "nation", "customer", "order"), limit=200)
    return projection.shown_objects(graphview.dataset(spark, sf_dir), q).select("id", "name", "degree")


@query(sql("SELECT id, key, value FROM (" + " UNION ALL ".join(f"SELECT id, '{k}' AS key, {k}::VARCHAR AS value FROM objects" for k in ("mktsegment", "acctbal", "brand", "ptype", "size", "retailprice", "status", "totalprice", "orderdate", "priority")) + ") WHERE value IS NOT NULL", OBJECTS))
def populated_attributes(spark, sf_dir):
    d = graphview.dataset(spark, sf_dir)
    return projection.populated_attributes(d.objects, d.attribute_defs.where("owner_kind = 'object'")).select("id", "key", "value")


@query(sql("SELECT e.id, e.type_id AS type_key, upper(left(e.type_id, 1)) || replace(substr(e.type_id, 2), '_', ' ') AS type_name FROM edges e WHERE source_id IN (SELECT id FROM shown) AND target_id IN (SELECT id FROM shown)", *GRAPH, STATUS))
def compile_edges(spark, sf_dir):
    d = graphview.dataset(spark, sf_dir)
    return projection.compile_edges(projection.project(d, FLAGSHIP).edges, d).select("id", "type_key", "type_name")


@query("SELECT 'part:' || p_partkey AS id, p_size::VARCHAR AS size, CASE WHEN p_retailprice = floor(p_retailprice) THEN p_retailprice::BIGINT::VARCHAR END AS whole_price FROM part")
def published_attributes(spark, sf_dir):
    d = graphview.dataset(spark, sf_dir)
    rows = projection.published_attributes(d.objects.where("type_id = 'part'"), d.attribute_defs.where("owner_kind = 'object'"))
    price = attribute("retailprice")
    return rows.select("id", attribute("size").alias("size"), F.when(~F.contains(price, F.lit(".")), price).alias("whole_price"))


@query("SELECT c_mktsegment AS segment, CASE c_mktsegment WHEN 'BUILDING' THEN '#111111' WHEN 'MACHINERY' THEN '#222222' ELSE '#cccccc' END AS color, count(*)::BIGINT AS n FROM customer GROUP BY 1, 2")
def color_by_value(spark, sf_dir):
    colors = spark.createDataFrame([("BUILDING", "#111111"), ("MACHINERY", "#222222")], "value string, color string")
    rows = styles.by_value(graphview.objects(spark, sf_dir).where("type_id = 'customer'"), colors, "mktsegment", "#cccccc")
    return rows.groupBy(attribute("mktsegment").alias("segment"), "color").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT CASE c_mktsegment WHEN 'BUILDING' THEN '#111111' ELSE '#cccccc' END AS color, c_mktsegment AS value, count(*)::BIGINT AS items, (SELECT count(*) FROM customer d WHERE (d.c_mktsegment = 'BUILDING') = (c.c_mktsegment = 'BUILDING'))::BIGINT AS of_color FROM customer c GROUP BY ALL")
def legend(spark, sf_dir):
    colors = spark.createDataFrame([("BUILDING", "#111111")], "value string, color string")
    rows = styles.by_value(graphview.objects(spark, sf_dir).where("type_id = 'customer'"), colors, "mktsegment", "#cccccc")
    return facets.legend(rows.withColumn("value", attribute("mktsegment")))


# ---- joins


@query(sql("SELECT e.type_id, count(*)::BIGINT AS n FROM edges e JOIN objects s ON s.id = source_id JOIN objects t ON t.id = target_id WHERE s.type_id <> 'supplier' AND t.type_id <> 'supplier' GROUP BY e.type_id", OBJECTS, EDGES))
def referential_semijoin(spark, sf_dir):
    d = graphview.dataset(spark, sf_dir)
    sound = ds.sound(d.with_(object_types=d.object_types.where("id <> 'supplier'")))
    return sound.relationships.groupBy("type_id").agg(F.count(F.lit(1)).alias("n"))


@query(sql("SELECT edge_type_id, direction, count(*)::BIGINT AS n, count(DISTINCT id)::BIGINT AS ids FROM ends GROUP BY ALL", EDGES, ENDS))
def adjacency(spark, sf_dir):
    return ds.adjacency(graphview.relationships(spark, sf_dir)).groupBy("edge_type_id", "direction").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("id").alias("ids"))


@query(sql("SELECT e.id, e.type_id || ':' || s.type_id || ':' || t.type_id AS rule_id FROM edges e JOIN objects s ON s.id = source_id JOIN objects t ON t.id = target_id", OBJECTS, EDGES))
def rule_for_edges(spark, sf_dir):
    d = graphview.dataset(spark, sf_dir)
    return ds.rule_of_edges(d).select("id", "rule_id")


@query(sql("SELECT e.id, other_id, o.name AS other_name, edge_id, direction, other_id LIKE 'part:%' AS in_view FROM ends e JOIN objects o ON o.id = other_id WHERE e.id IN (SELECT 'customer:' || c_custkey FROM customer WHERE c_nationkey = 3 UNION ALL SELECT 'supplier:' || s_suppkey FROM supplier WHERE s_nationkey = 3)", OBJECTS, EDGES, ENDS))
def object_details(spark, sf_dir):
    d = graphview.dataset(spark, sf_dir)
    ids = d.relationships.where("type_id = 'based_in' and target_id = 'nation:3'").select(F.col("source_id").alias("id"))
    out = details.object_details(d, ids, d.objects.where("type_id = 'part'"))
    return out.select("id", "other_id", "other_name", "edge_id", "direction", "in_view")


@query(sql("SELECT e.id, edge_type_id, direction, other_id, edge_id, row_number() OVER (PARTITION BY e.id, edge_type_id, direction ORDER BY lower(o.name), edge_id)::INT AS position, count(*) OVER (PARTITION BY e.id, edge_type_id, direction)::BIGINT AS n FROM ends e JOIN objects o ON o.id = other_id", OBJECTS, EDGES, ENDS))
def grouped_details(spark, sf_dir):
    d = graphview.dataset(spark, sf_dir)
    return details.all_grouped_details(d)


@query(sql("SELECT DISTINCT e.id, other_id FROM ends e WHERE other_id NOT LIKE 'part:%'", EDGES, ENDS))
def hidden_counterparts(spark, sf_dir):
    d = graphview.dataset(spark, sf_dir)
    return details.hidden_counterparts(d, d.objects, d.objects.where("type_id = 'part'"))


@query(sql("SELECT e.id, s.name AS source_name, t.name AS target_name, e.type_id || ':' || s.type_id || ':' || t.type_id AS rule_id FROM edges e JOIN objects s ON s.id = source_id JOIN objects t ON t.id = target_id", OBJECTS, EDGES))
def relationship_details(spark, sf_dir):
    d = graphview.dataset(spark, sf_dir)
    return details.relationship_details(d).select("id", "source_name", "target_name", "rule_id")


@query("SELECT 'placed_by:' || o_orderkey AS id, 'target' AS missing FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal >= 0)")
def anti_dangling(spark, sf_dir):
    d = graphview.dataset(spark, sf_dir)
    kept = d.objects.where((F.col("type_id") != "customer") | (attribute("acctbal").cast("double") >= 0))
    return ds.dangling_relationships(d.relationships.where("type_id = 'placed_by'"), kept).select("id", "missing")


# ---- aggregates


@query(sql("SELECT id, degree FROM degrees", *GRAPH))
def degree(spark, sf_dir):
    d = graphview.dataset(spark, sf_dir)
    return ds.degree(d.objects, d.relationships)


@query(sql("SELECT t AS type_id, (SELECT count(*) FROM objects WHERE type_id = t)::BIGINT AS n FROM (VALUES ('region'), ('nation'), ('customer'), ('supplier'), ('part'), ('order'), ('invoice')) v(t)", OBJECTS))
def facet_types(spark, sf_dir):
    d = graphview.dataset(spark, sf_dir)
    return facets.type_counts(d.object_types, d.objects).select("type_id", "n")


@query(sql("SELECT t AS type_id, (SELECT count(*) FROM edges WHERE type_id = t)::BIGINT AS n FROM (VALUES ('in_region'), ('based_in'), ('placed_by'), ('contains'), ('supplied_by'), ('billed_by')) v(t)", EDGES))
def facet_rel_types(spark, sf_dir):
    d = graphview.dataset(spark, sf_dir)
    return facets.type_counts(d.relationship_types, d.relationships).select("type_id", "n")


@query(
    """SELECT 'customer' AS type_id, 'mktsegment' AS attribute, c_mktsegment AS choice, count(*)::BIGINT AS n FROM customer GROUP BY ALL
UNION ALL SELECT 'part', 'ptype', p_type, count(*)::BIGINT FROM part GROUP BY ALL
UNION ALL SELECT 'part', 'brand', 'Brand#' || i, (SELECT count(*) FROM part WHERE p_brand = 'Brand#' || i)::BIGINT FROM range(1, 27) r(i)
UNION ALL SELECT 'order', 'status', s, (SELECT count(*) FROM orders WHERE o_orderstatus = s)::BIGINT FROM (VALUES ('F'), ('O'), ('P'), ('X')) v(s)
UNION ALL SELECT 'order', 'priority', o_orderpriority, count(*)::BIGINT FROM orders GROUP BY ALL"""
)
def facet_choice(spark, sf_dir):
    return facets.choice_counts(graphview.dataset(spark, sf_dir))


CARDINALITY = """
ruled AS (SELECT e.*, e.type_id || ':' || s.type_id || ':' || t.type_id AS rule_id FROM edges e JOIN objects s ON s.id = source_id JOIN objects t ON t.id = target_id),
bounds AS (SELECT * FROM (VALUES ('in_region:nation:region', 'subject', 'nation', 1, 1), ('in_region:nation:region', 'object', 'region', 0, NULL), ('based_in:customer:nation', 'subject', 'customer', 1, 1), ('based_in:customer:nation', 'object', 'nation', 0, NULL),
  ('based_in:supplier:nation', 'subject', 'supplier', 1, 1), ('based_in:supplier:nation', 'object', 'nation', 0, NULL), ('placed_by:order:customer', 'subject', 'order', 1, 1), ('placed_by:order:customer', 'object', 'customer', 0, 25),
  ('contains:order:part', 'subject', 'order', 1, 6), ('contains:order:part', 'object', 'part', 1, NULL), ('supplied_by:part:supplier', 'subject', 'part', 1, 40), ('supplied_by:part:supplier', 'object', 'supplier', 1, NULL)) v(rule_id, side, type_id, least, most)),
counted AS (SELECT rule_id, 'subject' AS side, source_id AS id, count(*) AS n FROM ruled GROUP BY ALL UNION ALL SELECT rule_id, 'object', target_id, count(*) FROM ruled GROUP BY ALL),
sides AS (SELECT b.rule_id, b.side, o.id, coalesce(c.n, 0)::BIGINT AS n, b.least, b.most FROM bounds b JOIN objects o ON o.type_id = b.type_id LEFT JOIN counted c ON c.rule_id = b.rule_id AND c.side = b.side AND c.id = o.id)"""


@query(sql("SELECT CASE WHEN side = 'subject' THEN 'object' ELSE 'subject' END || '_cardinality_' || CASE WHEN n < least THEN 'minimum' ELSE 'maximum' END AS code, rule_id AS field, id AS target_id FROM sides WHERE n < least OR n > most", OBJECTS, EDGES, CARDINALITY))
def cardinality_violations(spark, sf_dir):
    return validation.cardinality_issues(graphview.dataset(spark, sf_dir)).select("code", "field", "target_id")


@query(sql("SELECT rule_id, side, min(n) AS fewest, max(n) AS most, count(*) FILTER (n = 0)::BIGINT AS without FROM sides GROUP BY ALL", OBJECTS, EDGES, CARDINALITY))
def cardinality_counts(spark, sf_dir):
    c = validation.cardinality_counts(graphview.dataset(spark, sf_dir))
    return c.groupBy("rule_id", "side").agg(F.min("n").alias("fewest"), F.max("n").alias("most"), F.count_if(F.col("n") == 0).alias("without"))


@query(sql("SELECT type_id, count(*)::BIGINT AS n, count(*)::BIGINT AS active FROM objects GROUP BY type_id", OBJECTS))
def record_counts(spark, sf_dir):
    return facets.record_counts(graphview.objects(spark, sf_dir))


@query("SELECT * FROM (SELECT 'mktsegment' AS key, count(DISTINCT c_mktsegment) > 1 AS mixed, CASE WHEN count(DISTINCT c_mktsegment) = 1 THEN max(c_mktsegment) END AS value FROM customer WHERE c_mktsegment = 'BUILDING' UNION ALL SELECT 'acctbal', true, NULL UNION ALL SELECT 'visits', false, NULL)")
def mixed_values(spark, sf_dir):
    rows = graphview.objects(spark, sf_dir).where((F.col("type_id") == "customer") & (attribute("mktsegment") == "BUILDING"))
    return facets.mixed_values(rows, ["mktsegment", "acctbal", "visits"])


# ---- search

SEARCH = """
hits AS (SELECT id, type_id, name, CASE WHEN lower(name) = 'red widget' THEN 0 WHEN starts_with(lower(name), 'red widget') THEN 1 WHEN contains(lower(name), 'red widget') THEN 2 END AS tier FROM objects WHERE contains(lower(name), 'red widget'))"""


@query(sql("SELECT id, name, tier FROM hits ORDER BY tier, lower(name), id LIMIT 25", OBJECTS, SEARCH))
def search_ranked(spark, sf_dir):
    return search.search(graphview.dataset(spark, sf_dir), "  Red   WIDGET ").select("id", "name", "tier")


@query(sql("SELECT count(*)::BIGINT AS total FROM hits", OBJECTS, SEARCH))
def search_total(spark, sf_dir):
    return search.total(graphview.dataset(spark, sf_dir), "red widget")


@query("SELECT 'part:' || p_partkey AS id, CASE WHEN lower(p_brand) = 'brand#2' THEN 3 ELSE 4 END AS tier, 'Brand' AS label, p_brand AS text, p_brand AS subtitle FROM part WHERE contains(lower(p_brand), 'brand#2')")
def search_attribute(spark, sf_dir):
    return search.matches(graphview.dataset(spark, sf_dir), "brand#2").select("id", "tier", "label", "text", "subtitle")


@query(sql("SELECT id FROM objects WHERE contains(lower(name), 'er') AND contains(lower(name), '#') AND contains(lower(name), '7')", OBJECTS))
def search_tokens(spark, sf_dir):
    return graphview.objects(spark, sf_dir).where(text.has_all_tokens(F.col("name"), "er # 7")).select("id")


@query("SELECT doc_id, CASE WHEN length(t) > 80 THEN left(t, 79) || '…' ELSE t END AS snippet FROM (SELECT doc_id, trim(regexp_replace(coalesce(text, ''), '\\s+', ' ', 'g')) AS t FROM documents)")
def snippet(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return rows.select("doc_id", text.squeezed_snippet(F.coalesce("text", F.lit(""))).alias("snippet"))


# ---- reachability and scope


def _reach_sql(depth: int) -> str:
    walk = f"near AS (SELECT DISTINCT id, other_id FROM ends), walk AS (SELECT 'customer:0' AS id, 0 AS hops UNION SELECT n.other_id, w.hops + 1 FROM walk w JOIN near n ON n.id = w.id WHERE w.hops < {depth})"
    return sql("SELECT id, min(hops)::INT AS hops FROM walk GROUP BY id", EDGES, ENDS, walk, recursive=True)


def _reach(depth: int | None, spark: SparkSession, sf_dir: str) -> DataFrame:
    roots = spark.createDataFrame([("customer:0",)], "id string")
    return reach.reachable(roots, graphview.relationships(spark, sf_dir), depth)


for _depth in (0, 1, 2, 3):
    FOUND[f"reach_{_depth}"] = partial(_reach, _depth)
    SQL[f"reach_{_depth}"] = _reach_sql(_depth)
FOUND["reach_full"] = partial(_reach, None)
SQL["reach_full"] = _reach_sql(14)


@query(sql("SELECT id, type_id FROM objects WHERE id IN (SELECT id FROM walk)", OBJECTS, "kept AS (SELECT * FROM objects WHERE type_id <> 'part' AND (type_id <> 'customer' OR lower(mktsegment) = 'building'))", EDGES, "links AS (SELECT source_id AS a, target_id AS b FROM edges WHERE type_id <> 'in_region' AND source_id IN (SELECT id FROM kept) AND target_id IN (SELECT id FROM kept)), both_ways AS (SELECT a, b FROM links UNION SELECT b, a FROM links), walk AS (SELECT 'nation:3' AS id, 0 AS hops UNION SELECT b, hops + 1 FROM walk JOIN both_ways ON a = id WHERE hops < 2)", recursive=True))
def scope_publish(spark, sf_dir):
    scope = Scope(("part",), ("in_region",), (Filter("customer", "mktsegment", "in", values=("building",)),), ("nation:3", "part:1"), 2)
    return reach.apply_scope(graphview.dataset(spark, sf_dir), scope).objects.select("id", "type_id")


# ---- overlay


def _effective(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = graphview.objects(spark, sf_dir).where("type_id = 'customer'")
    return overlay.overlay(rows, graphview.changes(spark, sf_dir), "object")


@query(sql("SELECT id, name, mktsegment, acctbal, visits, is_proposed FROM effective", LOG))
def effective_customers(spark, sf_dir):
    out = _effective(spark, sf_dir)
    return out.select("id", "name", attribute("mktsegment").alias("mktsegment"), F.round(attribute("acctbal").cast("double"), 2).alias("acctbal"), attribute("visits").cast("int").alias("visits"), "is_proposed")


@query(sql("SELECT mktsegment, count(*)::BIGINT AS n, count(*) FILTER (is_proposed)::BIGINT AS proposed FROM effective GROUP BY ALL", LOG))
def effective_counts(spark, sf_dir):
    return _effective(spark, sf_dir).groupBy(attribute("mktsegment").alias("mktsegment")).agg(F.count(F.lit(1)).alias("n"), F.count_if("is_proposed").alias("proposed"))


@query(sql("SELECT target_id, field, CASE field WHEN 'attributes.acctbal' THEN round(value, 2)::VARCHAR WHEN 'is_active' THEN CASE event_type WHEN 'view' THEN 'true' ELSE 'false' END WHEN 'name' THEN 'Customer v' || k ELSE k::VARCHAR END AS value FROM lasts", LOG))
def last_update_wins(spark, sf_dir):
    out = overlay.last_values(overlay.update_payload(graphview.changes(spark, sf_dir)))
    return out.withColumn("value", F.when(F.col("field") == "attributes.acctbal", F.round(F.col("value").try_cast("double"), 2).cast("string")).otherwise(F.col("value")))


@query(sql("SELECT target_id AS id FROM lasts l WHERE field = 'is_active' AND event_type = 'view' AND EXISTS (SELECT 1 FROM changes c WHERE c.target_id = l.target_id AND c.field = 'is_active' AND c.operation = 'update' AND c.event_type = 'error')", LOG))
def reactivated(spark, sf_dir):
    updates = overlay.update_payload(graphview.changes(spark, sf_dir)).where("field = 'is_active'")
    off = updates.where("value = 'false'").select("target_id")
    return overlay.last_values(updates).where("value = 'true'").join(off, "target_id", "left_semi").select(F.col("target_id").alias("id"))


# ---- validation


def _broken_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts with an attribute too many, one too few or one out of place, by their number."""
    n = F.substring("id", 6, 20).cast("long")
    rows = graphview.objects(spark, sf_dir).where("type_id = 'part'")
    changed = F.when(n % 7 == 0, F.map_concat("attributes", F.create_map(F.lit("weight"), F.lit("1")))).when(n % 7 == 1, F.map_filter("attributes", lambda k, v: k != "brand"))
    changed = changed.when(n % 7 == 2, F.transform_values("attributes", lambda k, v: F.when(k == "size", F.lit("wide")).otherwise(v))).otherwise(F.col("attributes"))
    return rows.withColumn("attributes", changed)


def _part_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    defs = graphview.dataset(spark, sf_dir).attribute_defs.where("owner_id = 'part'")
    defs = defs.withColumns({"required": F.col("key") == "brand", "most": F.when(F.col("key") == "size", 45.0), "least": F.when(F.col("key") == "size", 5.0), "choices": F.when(F.col("key") == "ptype", F.array(*[F.lit(x) for x in graphview.PART_TYPES[:5]])).otherwise(F.col("choices"))})
    return validation.attribute_issues(_broken_parts(spark, sf_dir), defs, "object")


def _issue_query(code: str, spark: SparkSession, sf_dir: str) -> DataFrame:
    return _part_issues(spark, sf_dir).where(F.col("code") == code).select("code", "field", "target_id")


for _name, _code, _sql in (
    ("v_unknown_attr", "unknown_attribute", "SELECT 'unknown_attribute' AS code, 'attributes.weight' AS field, 'part:' || p_partkey AS target_id FROM part WHERE p_partkey % 7 = 0"),
    ("v_required", "required_attribute", "SELECT 'required_attribute' AS code, 'attributes.brand' AS field, 'part:' || p_partkey AS target_id FROM part WHERE p_partkey % 7 = 1"),
    ("v_type", "invalid_attribute_type", "SELECT 'invalid_attribute_type' AS code, 'attributes.size' AS field, 'part:' || p_partkey AS target_id FROM part WHERE p_partkey % 7 = 2"),
    ("v_choice", "invalid_choice", "SELECT 'invalid_choice' AS code, 'attributes.ptype' AS field, 'part:' || p_partkey AS target_id FROM part WHERE p_type = 'STANDARD'"),
    ("v_number_most", "value_above_maximum", "SELECT 'value_above_maximum' AS code, 'attributes.size' AS field, 'part:' || p_partkey AS target_id FROM part WHERE p_size > 45 AND p_partkey % 7 <> 2"),
    ("v_number_range", "value_below_minimum", "SELECT 'value_below_minimum' AS code, 'attributes.size' AS field, 'part:' || p_partkey AS target_id FROM part WHERE p_size < 5 AND p_partkey % 7 <> 2"),
):
    FOUND[_name] = partial(_issue_query, _code)
    SQL[_name] = _sql


@query("SELECT 'value_above_maximum' AS code, 'customer:' || c_custkey AS target_id FROM customer WHERE length(c_mktsegment) > 8 UNION ALL SELECT 'value_below_minimum', 'customer:' || c_custkey FROM customer WHERE length(c_mktsegment) < 4")
def v_text_length(spark, sf_dir):
    d = graphview.dataset(spark, sf_dir)
    defs = d.attribute_defs.where("owner_id = 'customer' and key = 'mktsegment'").withColumns({"data_type": F.lit("text"), "min_length": F.lit(4), "max_length": F.lit(8), "choices": F.lit(None).cast("array<string>")})
    out = validation.attribute_issues(d.objects.where("type_id = 'customer'"), defs, "object").where("field = 'attributes.mktsegment'")
    return out.select("code", "target_id")


@query("SELECT 'based_in:s:' || s_suppkey AS target_id FROM supplier")
def v_pair_rules(spark, sf_dir):
    d = graphview.dataset(spark, sf_dir)
    return validation.pair_issues(d.with_(rules=d.rules.where("subject_type_id <> 'supplier'"))).select("target_id")


@query("SELECT 'part:' || p_partkey AS target_id FROM part WHERE p_name IN (SELECT p_name FROM part GROUP BY p_name HAVING count(*) > 1)")
def v_dup_key(spark, sf_dir):
    rows = graphview.objects(spark, sf_dir).where("type_id = 'part'").withColumn("key", F.replace("name", F.lit(" "), F.lit("_")))
    return validation.duplicate_keys(rows, "object").select("target_id")


@query("SELECT l_returnflag AS flag, count(*)::BIGINT AS n FROM lineitem WHERE l_returnflag <> 'N' GROUP BY ALL")
def v_edge_choice(spark, sf_dir):
    d = graphview.dataset(spark, sf_dir)
    defs = d.attribute_defs.where("owner_id = 'contains'").withColumn("choices", F.when(F.col("key") == "returnflag", F.array(F.lit("N"))))
    edges = d.relationships.where("type_id = 'contains'")
    bad = validation.attribute_issues(edges, defs, "relationship").where("code = 'invalid_choice'").select(F.col("target_id").alias("id"))
    return edges.join(bad, "id").groupBy(attribute("returnflag").alias("flag")).agg(F.count(F.lit(1)).alias("n"))


# ---- import


def _import(spark: SparkSession, sf_dir: str):
    """A file of all customers: some under changed values, some new, each tenth twice."""
    c = spark.read.parquet(f"{sf_dir}/customer.parquet")
    key = F.col("c_custkey")
    rows = c.select(
        key.cast("int").alias("row_number"),
        F.when(key % 6 == 0, F.concat(F.lit("Nobody "), key.cast("string"))).otherwise(F.col("c_name")).alias("match_cell"),
        F.when(key % 4 == 0, F.lit("BUILDING")).otherwise(F.col("c_mktsegment")).alias("segment"),
    )
    again = rows.where("row_number % 10 = 0").withColumns({"row_number": F.col("row_number") + 1_000_000, "segment": F.lit("MACHINERY")})
    objects = graphview.objects(spark, sf_dir).where("type_id = 'customer'")
    objects = objects.withColumn("attributes", F.map_concat(F.map_filter("attributes", lambda k, v: k != "cust"), F.create_map(F.lit("cust"), F.col("name"))))
    found = importing.identify(rows.unionByName(again), objects, "customer", match=("match_cell", "cust"))
    defs = graphview.dataset(spark, sf_dir).attribute_defs
    return importing.plan_objects(found, objects, defs, "customer", {"segment": "attributes.mktsegment"}, match="cust")


IMPORT = """
file AS (SELECT c_custkey AS k, CASE WHEN c_custkey % 6 = 0 THEN NULL ELSE c_mktsegment END AS old, CASE WHEN c_custkey % 10 = 0 THEN 'MACHINERY' WHEN c_custkey % 4 = 0 THEN 'BUILDING' ELSE c_mktsegment END AS new,
  CASE WHEN c_custkey % 6 = 0 THEN 'new:Nobody ' || c_custkey ELSE 'customer:' || c_custkey END AS identity FROM customer)"""


@query(sql("SELECT identity, new FROM file WHERE k % 6 = 0", IMPORT))
def plan_creates(spark, sf_dir):
    return _import(spark, sf_dir).changes.where("operation = 'create'").select("identity", "new")


@query(sql("SELECT identity, old, new FROM file WHERE k % 6 <> 0 AND old <> new", IMPORT))
def plan_updates(spark, sf_dir):
    return _import(spark, sf_dir).changes.where("operation = 'update'").select("identity", "old", "new")


@query(sql("SELECT count(*) FILTER (k % 6 = 0)::BIGINT AS creates, count(*) FILTER (k % 6 <> 0 AND old <> new)::BIGINT AS updates, count(*) FILTER (k % 6 <> 0 AND old = new)::BIGINT AS unchanged FROM file", IMPORT))
def plan_noops(spark, sf_dir):
    return _import(spark, sf_dir).summary.select("creates", "updates", "unchanged")


@query("SELECT p_name AS cell, 'ambiguous_identity' AS problem FROM part GROUP BY p_name HAVING count(*) > 1")
def identity_ambiguous(spark, sf_dir):
    objects = graphview.objects(spark, sf_dir).where("type_id = 'part'")
    objects = objects.withColumn("attributes", F.create_map(F.lit("label"), F.col("name")))
    rows = objects.select(F.col("name").alias("cell")).distinct().withColumn("row_number", F.lit(1))
    return importing.identify(rows, objects, "part", match=("cell", "label")).where("problem is not null").select("cell", "problem")


@query("SELECT 'nation_' || n_nationkey AS cell, 'nation:' || n_nationkey AS subject_id, NULL AS subject_problem FROM nation UNION ALL SELECT 'customer_1', NULL, 'unresolved_endpoint' UNION ALL SELECT ' ', NULL, 'missing_endpoint'")
def endpoint_by_key(spark, sf_dir):
    objects = graphview.objects(spark, sf_dir)
    rows = objects.where("type_id = 'nation'").select(F.col("key").alias("cell")).unionByName(spark.createDataFrame([("customer_1",), (" ",)], "cell string"))
    return importing.resolve_endpoints(rows, "cell", objects, ["nation", "region"]).select("cell", "subject_id", "subject_problem")


@query("SELECT 'placed_by:order:' || o_orderkey || ':customer:' || (o_custkey + 1) % (SELECT count(*) FROM customer) AS identity FROM orders WHERE o_orderkey % 3 = 1")
def plan_edges(spark, sf_dir):
    """Each order's own customer (unchanged) and, for some, another one (created)."""
    d = graphview.dataset(spark, sf_dir)
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    n = spark.read.parquet(f"{sf_dir}/customer.parquet").count()
    rows = o.select(F.col("o_orderkey").cast("int").alias("row_number"), F.concat(F.lit("order_"), F.col("o_orderkey").cast("string")).alias("s"), F.concat(F.lit("customer_"), F.when(F.col("o_orderkey") % 3 == 1, (F.col("o_custkey") + 1) % n).otherwise(F.col("o_custkey")).cast("string")).alias("t"))
    rows = importing.resolve_endpoints(rows, "s", d.objects, ["order"])
    rows = importing.resolve_endpoints(rows, "t", d.objects, ["customer"], prefix="object")
    return importing.plan_edges(rows, d.rules, d.relationships, "placed_by").changes.select("identity")


@query(
    """SELECT o_orderkey AS n, CASE WHEN m = 9 THEN NULL WHEN m = 0 THEN CASE WHEN o_totalprice = floor(o_totalprice) THEN o_totalprice::BIGINT::VARCHAR ELSE o_totalprice::VARCHAR END WHEN m = 1 THEN o_orderkey::VARCHAR WHEN m = 2 THEN 'true' WHEN m = 3 THEN 'false' WHEN m = 4 THEN 'perhaps'
  WHEN m = 5 THEN strftime(o_orderdate, '%Y-%m-%d') WHEN m = 6 THEN strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') WHEN m = 7 THEN '1995-02-30' WHEN m = 8 THEN o_orderpriority END AS value,
  CASE WHEN m = 9 THEN 'null' WHEN m IN (0, 1) THEN 'number' WHEN m IN (2, 3) THEN 'boolean' ELSE 'string' END AS kind, m NOT IN (4, 7) AS converted FROM (SELECT *, o_orderkey % 10 AS m FROM orders)"""
)
def coerced_cells(spark, sf_dir):
    """A cell of every order, read for each data type in turn: good, unreadable and blank ones."""
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    m, iso = F.col("o_orderkey") % 10, F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss")
    cell = F.when(m == 0, F.concat(F.lit(" "), F.col("o_totalprice").cast("string"))).when(m == 1, F.concat(F.col("o_orderkey").cast("string"), F.lit(".0 "))).when(m == 2, " YES").when(m == 3, "off").when(m == 4, "perhaps")
    cell = cell.when(m == 5, F.left(iso, F.lit(10))).when(m == 6, iso).when(m == 7, "1995-02-30").when(m == 8, F.concat(F.col("o_orderpriority"), F.lit("\t"))).otherwise("  ")
    kind = F.when(m < 2, "number").when(m < 5, "boolean").when(m.isin(5, 7), "date").when(m == 6, "datetime").when(m == 8, "choice").otherwise("text")
    return o.select(F.col("o_orderkey").alias("n"), values.coerce(cell, kind).alias("c")).select("n", "c.value", "c.kind", "c.converted")


@query(sql("SELECT id, CASE WHEN r = 1 THEN base ELSE base || '_' || r END AS key FROM (SELECT id, base, row_number() OVER (PARTITION BY type_id, base ORDER BY id) + CASE WHEN type_id = 'nation' THEN 1 ELSE 0 END AS r FROM (SELECT id, type_id, trim(regexp_replace(lower(name), '[^a-z0-9]+', '_', 'g'), '_') AS base FROM objects))", OBJECTS))
def key_allocation(spark, sf_dir):
    """A key for every object from its name, within its type; the nations' plain keys are taken already."""
    rows = graphview.objects(spark, sf_dir).select(F.col("type_id").alias("scope"), F.col("id").alias("seq"), "name")
    nations = rows.where("scope = 'nation'").select("scope", text.slug(F.col("name")).alias("key"))
    return keys.allocate(rows, nations).select(F.col("seq").alias("id"), "key")


# ---- provenance and review


def _proposals(spark: SparkSession):
    p = spark.range(20).select(F.col("id").cast("string").alias("id"), F.lit("someone").alias("created_by"), F.concat(F.lit("Set "), F.col("id").cast("string")).alias("title"), F.when(F.col("id") % 5 == 4, "failed").otherwise("completed").alias("status"), F.current_timestamp().alias("completed_at"))
    r = spark.range(20).select(F.col("id").cast("string").alias("proposal_id"), F.lit("completed").alias("outcome"), (F.lit(100) - F.col("id")).alias("after_revision"))
    return p, r


@query(sql("SELECT seq, target_id, CASE WHEN operation = 'create' THEN 'created' WHEN operation = 'delete' THEN 'deleted' WHEN field = 'name' THEN 'renamed' WHEN field = 'is_active' AND event_type = 'view' THEN 'reactivated' WHEN field = 'is_active' THEN 'deactivated' ELSE 'attribute_set' END AS kind FROM changes WHERE proposal_id::INT % 5 <> 4", LOG))
def provenance_entries(spark, sf_dir):
    return provenance.entries(graphview.changes(spark, sf_dir), *_proposals(spark)).select("seq", "target_id", "kind")


def _by_month(spark: SparkSession, sf_dir: str):
    """Each tenth of a customer's log as a change-set of its own, so that records have more sets than are shown."""
    c = graphview.changes(spark, sf_dir).withColumn("proposal_id", (F.col("seq") % 97).cast("string"))
    p = spark.range(97).select(F.col("id").cast("string").alias("id"), F.lit("someone").alias("created_by"), F.lit("").alias("title"), F.lit("completed").alias("status"), F.current_timestamp().alias("completed_at"))
    r = spark.range(97).select(F.col("id").cast("string").alias("proposal_id"), F.lit("completed").alias("outcome"), F.col("id").alias("after_revision"))
    return provenance.entries(c, p, r)


@query(sql("SELECT target_id, position, count(*)::BIGINT AS n, bool_and(sets > 25) AS truncated FROM (SELECT *, max(position) OVER (PARTITION BY target_id) AS sets FROM (SELECT target_id, dense_rank() OVER (PARTITION BY target_id ORDER BY seq % 97 DESC) AS position FROM changes)) WHERE position <= 25 GROUP BY ALL", LOG))
def provenance_tail(spark, sf_dir):
    return _by_month(spark, sf_dir).groupBy("target_id", F.col("position").cast("long").alias("position")).agg(F.count(F.lit(1)).alias("n"), F.bool_and("truncated").alias("truncated"))


@query(sql("SELECT count(*)::BIGINT AS total, count(DISTINCT target_id)::BIGINT AS targets, 1::BIGINT AS target_types FROM changes", LOG))
def review_counts(spark, sf_dir):
    return review.counts(graphview.changes(spark, sf_dir)).select("total", "targets", "target_types")


@query(sql("SELECT operation AS label, count(*)::BIGINT AS n, min(seq) AS first_seq, max(seq) AS last_seq FROM changes GROUP BY ALL", LOG))
def review_groups(spark, sf_dir):
    return review.grouped(graphview.changes(spark, sf_dir), "operation")


@query(sql("SELECT seq, coalesce(c_name, CASE WHEN operation = 'create' THEN 'New customer ' || event_id END, 'Untitled') AS target_name FROM changes LEFT JOIN customer ON target_id = 'customer:' || c_custkey WHERE operation = 'create' OR event_type = 'click'", LOG))
def review_names(spark, sf_dir):
    c = graphview.changes(spark, sf_dir)
    named = review.with_names(c, graphview.objects(spark, sf_dir).where("type_id = 'customer'"))
    return named.where("operation = 'create' or get_json_object(after_json, '$.field') = 'name'").select("seq", "target_name")


@query(sql("SELECT seq FROM changes WHERE operation = 'update' AND field = 'name' AND k = 7", LOG))
def review_search(spark, sf_dir):
    return review.search(graphview.changes(spark, sf_dir), 'customer v7"', operation="update").select("seq")


# ---- indexes, set operations, export


@query(sql("SELECT id, name FROM objects WHERE contains(upper(name), 'WIDGET') ORDER BY lower(name), id LIMIT 25 OFFSET 25", OBJECTS))
def index_page(spark, sf_dir):
    return review.index(graphview.objects(spark, sf_dir), "widget", page=2).select("id", "name")


@query(sql("SELECT id, name FROM objects WHERE type_id = 'part' ORDER BY lower(name) DESC, id LIMIT 25", OBJECTS))
def index_sorted(spark, sf_dir):
    return review.index(graphview.objects(spark, sf_dir).where("type_id = 'part'"), sort="-name").select("id", "name")


@query(sql("SELECT e.id, s.name AS subject, t.name AS object FROM edges e JOIN objects s ON s.id = source_id JOIN objects t ON t.id = target_id WHERE contains(upper(s.name), 'CUSTOMER') OR contains(upper(t.name), 'CUSTOMER') ORDER BY lower(t.name), e.id LIMIT 25", OBJECTS, EDGES))
def edge_index(spark, sf_dir):
    d = graphview.dataset(spark, sf_dir)
    return review.edge_index(d.relationships, d.objects, "customer", sort="object", links=d.links).select("id", "subject", "object")


@query("SELECT * FROM (VALUES ('object', 'region'), ('object', 'nation'), ('object', 'customer'), ('object', 'supplier'), ('object', 'part'), ('object', 'order'), ('relationship', 'in_region'), ('relationship', 'based_in'), ('relationship', 'placed_by'), ('relationship', 'contains'), ('relationship', 'supplied_by')) v(kind, id)")
def used_types(spark, sf_dir):
    return ds.used_types(graphview.dataset(spark, sf_dir))


@query("SELECT * FROM (VALUES ('object', 'invoice'), ('relationship', 'billed_by')) v(kind, id)")
def unused_types(spark, sf_dir):
    return ds.unused_types(graphview.dataset(spark, sf_dir))


@query("SELECT * FROM (VALUES ('region'), ('nation'), ('customer'), ('supplier'), ('part'), ('order')) v(id)")
def inactive_types_in_use(spark, sf_dir):
    d = graphview.dataset(spark, sf_dir)
    d = d.with_(object_types=d.object_types.withColumn("is_active", F.col("id") != "part"))
    return ds.keep_inactive_types_in_use(d.with_(object_types=d.object_types.withColumn("is_active", ~F.col("id").isin("part", "invoice")))).object_types.select("id")


@query(sql("SELECT id, split_part(source_id, ':', 1) || '_' || split_part(source_id, ':', 2) AS subject_key, split_part(target_id, ':', 1) || '_' || split_part(target_id, ':', 2) AS object_key FROM edges", EDGES))
def export_edges_keys(spark, sf_dir):
    d = graphview.dataset(spark, sf_dir)
    return export.edges_with_keys(d).select("id", "subject_key", "object_key")


@query("SELECT 'customer_' || c_custkey AS key, c_name AS name, '' AS description, 'true' AS is_active, c_mktsegment AS mktsegment FROM customer")
def template_rows(spark, sf_dir):
    return export.template_rows(graphview.dataset(spark, sf_dir), "customer", ["mktsegment"])


@query("SELECT 'dangling_edge' AS code, 'placed_by:' || o_orderkey AS id FROM orders WHERE o_custkey % 2 = 1")
def payload_problems(spark, sf_dir):
    d = graphview.dataset(spark, sf_dir)
    nodes = d.objects.where("type_id = 'order' or (type_id = 'customer' and cast(substring(id, 10, 20) as long) % 2 = 0)")
    return export.payload_problems(nodes, d.relationships.where("type_id = 'placed_by'"))


def _digest_sql() -> str:
    """Every record as a JSON text, written by hand; the ontology's from its own constants."""
    import json

    def line(part: str, **columns) -> str:
        text_ = json.dumps({k: v for k, v in sorted(columns.items()) if v is not None}, separators=(",", ":"))
        return f"('{part}', '{text_}')"

    types = [line("object_type", id=t, key=t, name=t.capitalize(), is_active=t != "invoice", sort_order=n, description="") for n, t in enumerate(("region", "nation", "customer", "supplier", "part", "order", "invoice"))]
    types += [line("relationship_type", id=t, key=t, name=t.replace("_", " ").capitalize(), is_active=t != "billed_by", sort_order=n, description="") for n, t in enumerate(("in_region", "based_in", "placed_by", "contains", "supplied_by", "billed_by"))]
    types += [line("rule", id=f"{r}:{s}:{o}", rel_type_id=r, subject_type_id=s, object_type_id=o, s_min=a, s_max=b, o_min=c, o_max=d) for r, s, o, a, b, c, d in graphview.RULE_ROWS]
    types += [line("attribute_definition", id=f"{owner}.{key}", owner_kind=kind, owner_id=owner, key=key, name=name, data_type=data_type, required=key == "mktsegment", nullable=True, sort_order=n, is_active=True, choices=choices) for n, (kind, owner, key, name, data_type, choices) in enumerate(graphview.DEFINITIONS)]

    def record(type_: str, key: str, name: str, table: str, *attributes: tuple[str, str]) -> str:
        pairs = " || ',' || ".join(f"'\"{k}\":\"' || {v} || '\"'" for k, v in attributes) or "''"
        return f"""SELECT 'object', '{{"attributes":{{' || {pairs} || '}},"description":"","id":"{type_}:' || {key} || '","is_active":true,"key":"{type_}_' || {key} || '","name":"' || {name} || '","type_id":"{type_}"}}' FROM {table}"""

    objects = [
        record("region", "r_regionkey", "r_name", "region"),
        record("nation", "n_nationkey", "n_name", "nation"),
        record("customer", "c_custkey", "c_name", "customer", ("mktsegment", "c_mktsegment"), ("acctbal", "c_acctbal::VARCHAR")),
        record("supplier", "s_suppkey", "s_name", "supplier", ("acctbal", "s_acctbal::VARCHAR")),
        record("part", "p_partkey", "p_name", "part", ("brand", "p_brand"), ("ptype", "p_type"), ("size", "p_size::VARCHAR"), ("retailprice", "p_retailprice::VARCHAR")),
        record("order", "o_orderkey", "'Order#' || o_orderkey", "orders", ("status", "o_orderstatus"), ("totalprice", "o_totalprice::VARCHAR"), ("orderdate", "strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S')"), ("priority", "o_orderpriority")),
    ]
    edge = """SELECT 'relationship', '{"attributes":{' || bag || '},"id":"' || id || '","is_active":true,"object_key":"' || replace(target_id, ':', '_') || '","object_type":"' || split_part(target_id, ':', 1) || '","subject_key":"' || replace(source_id, ':', '_') || '","subject_type":"' || split_part(source_id, ':', 1) || '","type_id":"' || type_id || '"}'"""
    bag = """'"quantity":"' || l_quantity::VARCHAR || '","returnflag":"' || l_returnflag || '","shipdate":"' || strftime(l_shipdate, '%Y-%m-%d') || '"'"""
    item = EDGES[EDGES.index("UNION ALL SELECT 'contains:'") : EDGES.index("UNION ALL SELECT DISTINCT 'supplied_by")].removeprefix("UNION ALL SELECT ").strip()
    columns = item.removesuffix("FROM lineitem").rsplit(", 'contains', ", 1)
    items = f"SELECT {columns[0]} AS id, 'contains' AS type_id, {columns[1].split(', ')[0]} AS source_id, {columns[1].split(', ')[1]} AS target_id, {bag} AS bag FROM lineitem"
    lines = f"lines(part, v) AS (SELECT * FROM (VALUES {', '.join(types)}) t(part, v) UNION ALL {' UNION ALL '.join(objects)} UNION ALL {edge} FROM (SELECT *, '' AS bag FROM edges WHERE type_id <> 'contains') UNION ALL {edge} FROM ({items}))"
    blocks = "blocks AS (SELECT part, left(h, 3) AS block, count(*) AS n, sha256(string_agg(h, ',' ORDER BY h)) AS h FROM (SELECT part, sha256(v) AS h FROM lines) GROUP BY ALL)"
    return sql("SELECT part, sum(n)::BIGINT AS records, sha256(string_agg(h, ',' ORDER BY block)) AS digest FROM blocks GROUP BY part", EDGES, lines, blocks)


@query(_digest_sql())
def snapshot_digests(spark, sf_dir):
    return export.digests(export.json_lines(graphview.dataset(spark, sf_dir)))
