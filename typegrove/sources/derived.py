"""An ontology read off the star-schema tables, and the events as a log of changes of it.

Each brand of part, customer segment and nation with suppliers is an object type; each order priority sells brands to segments,
and brands are made by nations. Rules are the pairs that line items show, definitions have the bounds and choices that
the parts of a brand show. So the ontology grows with what the tables hold, and all of it comes from aggregates over them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import ATTRIBUTE_DEFS, OBJECT_TYPES, RULES, Dataset
from . import graphview


def _columns(schema: str) -> list[tuple[str, str]]:
    return [tuple(c.strip().split(" ", 1)) for c in schema.split(", ")]


def _table(rows: DataFrame, schema: str, **values) -> DataFrame:
    """The columns of a schema, by value, name or null."""
    col = lambda v: F.col(v) if isinstance(v, str) else v
    return rows.select(*[(col(values[c]) if c in values else F.lit(None)).cast(kind).alias(c) for c, kind in _columns(schema)])


def _named(prefix: str, column: str):
    return F.concat(F.lit(f"{prefix}:"), F.col(column).cast("string"))


def dataset(spark: SparkSession, sf_dir: str) -> Dataset:
    """The ontology; objects and edges are those of ``graphview``, which have other types and so are none here."""
    read = lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet")
    part, supplier, customer, orders = read("part"), read("supplier"), read("customer"), read("orders")
    n = F.count(F.lit(1)).cast("int").alias("n")
    brands = part.groupBy("p_brand").agg(n, F.min("p_size").alias("least"), F.max("p_size").alias("most"), F.array_sort(F.collect_set("p_type")).alias("choices"))
    segments = customer.groupBy("c_mktsegment").agg(n)
    makers = supplier.groupBy("s_nationkey").agg(n).join(read("nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    priorities = orders.groupBy("o_orderpriority").agg(n, F.array_sort(F.collect_set("o_orderstatus")).alias("choices"))
    types = [
        _table(brands, OBJECT_TYPES, id=_named("brand", "p_brand"), key=F.lower(F.replace("p_brand", F.lit("#"), F.lit("_"))), name="p_brand", is_active=F.lit(True), sort_order="n", description=F.lit("")),
        _table(segments, OBJECT_TYPES, id=_named("segment", "c_mktsegment"), key=F.lower("c_mktsegment"), name="c_mktsegment", is_active=F.lit(True), sort_order="n", description=F.lit("")),
        _table(makers, OBJECT_TYPES, id=_named("maker", "s_nationkey"), key=F.concat(F.lit("maker_"), F.col("s_nationkey").cast("string")), name="n_name", is_active=F.lit(True), sort_order="n", description=F.lit("")),
    ]
    sold = _table(priorities, OBJECT_TYPES, id=_named("sold", "o_orderpriority"), key=F.concat(F.lit("sold_"), F.left("o_orderpriority", F.lit(1))), name="o_orderpriority", is_active=F.lit(True), sort_order="n", description=F.lit(""))
    made = _table(part.agg(n), OBJECT_TYPES, id=F.lit("made_by"), key=F.lit("made_by"), name=F.lit("Made by"), is_active=F.lit(True), sort_order="n", description=F.lit(""))
    lines = read("lineitem").select("l_orderkey", "l_partkey", "l_suppkey").join(part.select(F.col("p_partkey").alias("l_partkey"), "p_brand"), "l_partkey")
    pairs = lines.join(supplier.select(F.col("s_suppkey").alias("l_suppkey"), "s_nationkey"), "l_suppkey").groupBy("p_brand", "s_nationkey").agg(F.countDistinct("l_suppkey").alias("n"))
    who = orders.join(customer.select(F.col("c_custkey").alias("o_custkey"), "c_mktsegment"), "o_custkey").select(F.col("o_orderkey").alias("l_orderkey"), "o_orderpriority", "c_mktsegment")
    sales = lines.join(who, "l_orderkey").groupBy("o_orderpriority", "p_brand", "c_mktsegment").agg(F.count(F.lit(1)).alias("n"))
    zero = F.lit(0)
    rules = [
        _table(pairs, RULES, id=F.concat_ws(":", F.lit("made_by"), "p_brand", F.col("s_nationkey").cast("string")), rel_type_id=F.lit("made_by"), subject_type_id=_named("brand", "p_brand"), object_type_id=_named("maker", "s_nationkey"), s_min=zero, o_min=zero, o_max="n"),
        _table(sales, RULES, id=F.concat_ws(":", F.lit("sold"), "o_orderpriority", "p_brand", "c_mktsegment"), rel_type_id=_named("sold", "o_orderpriority"), subject_type_id=_named("brand", "p_brand"), object_type_id=_named("segment", "c_mktsegment"), s_min=zero, o_min=zero, o_max="n"),
    ]
    common = {"required": F.lit(False), "nullable": F.lit(True), "is_active": F.lit(True)}
    owner = {"owner_kind": F.lit("object"), "owner_id": _named("brand", "p_brand")}
    defs = [
        _table(brands, ATTRIBUTE_DEFS, id=F.concat(_named("brand", "p_brand"), F.lit(".size")), key=F.lit("size"), name=F.lit("Size"), data_type=F.lit("number"), sort_order=zero, least="least", most="most", **owner, **common),
        _table(brands, ATTRIBUTE_DEFS, id=F.concat(_named("brand", "p_brand"), F.lit(".ptype")), key=F.lit("ptype"), name=F.lit("Type"), data_type=F.lit("choice"), sort_order=F.lit(1), choices="choices", **owner, **common),
        _table(priorities, ATTRIBUTE_DEFS, id=F.concat(_named("sold", "o_orderpriority"), F.lit(".status")), owner_kind=F.lit("relationship"), owner_id=_named("sold", "o_orderpriority"), key=F.lit("status"), name=F.lit("Status"), data_type=F.lit("choice"), sort_order=zero, choices="choices", **common),
    ]
    own = graphview.links(spark, sf_dir)
    return Dataset(
        object_types=types[0].unionByName(types[1]).unionByName(types[2]),
        relationship_types=sold.unionByName(made),
        rules=rules[0].unionByName(rules[1]),
        attribute_defs=defs[0].unionByName(defs[1]).unionByName(defs[2]),
        objects=own.objects(),
        relationships=own.relationships(),
        links=own,
    )


def changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events as changes of types, definitions and rules, among them of some that do not exist."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet").withColumn("k", F.get_json_object("props", "$.k").cast("int"))
    k, kind = F.col("k"), F.col("event_type")
    brand = F.concat(F.lit("brand:Brand#"), (F.col("user_id") % 30 + 1).cast("string"))
    maker = F.concat(F.lit("maker:"), (k % 25).cast("string"))
    pair = F.concat(F.lit("made_by:Brand#"), (F.col("user_id") % 30 + 1).cast("string"), F.lit(":"), (k % 25).cast("string"))
    case = (
        F.when(kind == "click", "rename").when(kind == "purchase", "most").when(kind == "signup", "o_max").when((kind == "error") & (k % 10 == 0), "hide").when((kind == "error") & (k % 50 == 5), "drop")
        .when((kind == "view") & (k % 10 == 1), "show").when((kind == "view") & (k % 10 == 2), "define").when((kind == "view") & (k % 10 == 3), "allow")
    )
    e = e.withColumn("case", case).where("case is not null")
    c = F.col("case")
    field = F.when(c == "rename", "name").when(c.isin("hide", "show"), "is_active").otherwise(c)
    value = F.when(c == "rename", F.concat(F.lit("Brand v"), k.cast("string"))).when(c == "hide", "false").when(c == "show", "true").otherwise(k.cast("string"))
    own = F.col("event_id").cast("string")
    made = F.when(c == "define", F.to_json(F.struct(F.lit("Extra").alias("name"), F.concat(F.lit("extra_"), own).alias("key"), F.lit("number").alias("data_type"), k.alias("least"))))
    made = made.when(c == "allow", F.to_json(F.struct(brand.alias("subject_type_id"), maker.alias("object_type_id"), F.lit(0).alias("s_min"), F.lit(0).alias("o_min"), k.alias("o_max"))))
    created = c.isin("define", "allow")
    return e.select(
        F.concat(F.lit("change:"), own).alias("id"),
        F.lit("p").alias("proposal_id"),
        F.col("event_id").alias("seq"),
        F.when(created, "create").when(c == "drop", "delete").otherwise("update").alias("operation"),
        F.when(c.isin("rename", "hide", "show"), "object_type").when(c.isin("most", "drop", "define"), "attribute_definition").otherwise("relationship_type_rule").alias("target_type"),
        F.when(c.isin("rename", "hide", "show"), brand).when(c == "most", F.concat(brand, F.lit(".size"))).when(c == "drop", F.concat(brand, F.lit(".ptype"))).when(c == "define", F.concat(F.lit("extra:"), own)).when(c == "allow", F.concat(F.lit("allow:"), own)).otherwise(pair).alias("target_id"),
        F.when(c == "define", "object_type").when(c == "allow", "relationship_type").alias("parent_type"),
        F.when(c == "define", brand).when(c == "allow", "made_by").alias("parent_id"),
        F.lit(None).cast("string").alias("before_json"),
        F.when(created, made).when(c != "drop", F.to_json(F.struct(field.alias("field"), value.alias("value")))).alias("after_json"),
    )
