"""Planning an import: from mapped rows to creates, updates and problems.

Rows are (row_number, identity columns, cells by attribute). The later row of one identity wins per field, blanks
included. Any problem blocks the whole plan: ``unblocked`` gives the changes only where there are no problems.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import is_blank, strip, uuid_of
from ..functions.values import coerce, identity_key, same_value

MOST_CHANGES = 1000
BUILT_IN = ("name", "description", "is_active")


@dataclass(frozen=True)
class Plan:
    changes: DataFrame
    problems: DataFrame
    summary: DataFrame


def long_cells(rows: DataFrame, columns: dict[str, str]) -> DataFrame:
    """(row_number, identity, field, cell) for each mapped value column; ``columns``: column -> field."""
    entries = F.array(*[F.struct(F.lit(f).alias("field"), F.col(c).alias("cell")) for c, f in columns.items()])
    return rows.select("row_number", "identity", F.explode(entries).alias("x")).select("row_number", "identity", "x.*")


def last_cells(cells: DataFrame) -> DataFrame:
    """The last row's cell per identity and field; a blank one is an assignment too."""
    out = cells.groupBy("identity", "field").agg(F.max_by(F.struct("cell"), "row_number").alias("last"), F.min("row_number").alias("first_row"))
    return out.select("identity", "field", F.col("last.cell").alias("cell"), "first_row")


def identify(rows: DataFrame, objects: DataFrame, type_id: str, key: str | None = None, id_: str | None = None, match: tuple[str, str] | None = None) -> DataFrame:
    """Adds object_id, identity and problem to rows with cells for a key, a database id or a matched attribute.

    ``match``: (column, attribute). Each lookup is an equi-join; a match value that several records have is ambiguous.
    """
    own = objects.where(F.col("type_id") == type_id)
    out = rows
    parts: list[Column] = []
    problems: list[Column] = []
    if id_:
        wanted = uuid_of(F.col(id_))
        every = objects.select(F.col("id").alias("__id"), F.col("type_id").alias("__id_type"))
        out = out.withColumn("__wanted", F.coalesce(wanted, strip(F.col(id_)))).join(every, F.col("__wanted") == F.col("__id"), "left")
        given = ~is_blank(F.col(id_))
        problems += [
            F.when(given & F.col("__id").isNull() & wanted.isNull(), "invalid_identity_id"),
            F.when(given & F.col("__id").isNull(), "unresolved_identity"),
            F.when(given & (F.col("__id_type") != type_id), "wrong_object_type"),
        ]
        parts.append(F.when(F.col("__id_type") == type_id, F.col("__id")))
    if key:
        keys = own.select(F.col("key").alias("__key"), F.col("id").alias("__by_key"))
        out = out.withColumn("__key_cell", strip(F.col(key))).join(keys, F.col("__key_cell") == F.col("__key"), "left")
        problems.append(F.when(~is_blank(F.col(key)) & F.col("__by_key").isNull(), "unresolved_identity"))
        if id_:
            problems.append(F.when(F.col("__by_key").isNotNull() & F.col("__id").isNotNull() & (F.col("__by_key") != F.col("__id")), "identity_mismatch"))
        parts.append(F.col("__by_key"))
    value = F.lit(None).cast("string")
    if match:
        column, attribute = match
        value = strip(F.col(column))
        found = own.select(F.element_at("attributes", F.lit(attribute)).alias("__value"), "id").where("__value is not null").groupBy("__value").agg(F.count(F.lit(1)).alias("__n"), F.min("id").alias("__by_value"))
        out = out.withColumn("__match_cell", value).join(found, F.col("__match_cell") == F.col("__value"), "left")
        problems += [F.when(F.col("__n") > 1, "ambiguous_identity"), F.when(is_blank(F.col(column)), "invalid_identity_value") if not (id_ or key) else F.lit(None).cast("string")]
        if id_ or key:
            other = F.coalesce(*parts)
            problems.append(F.when((F.col("__n") == 1) & other.isNotNull() & (F.col("__by_value") != other), "identity_mismatch"))
        parts.append(F.when(F.col("__n") == 1, F.col("__by_value")))
    if not match:
        problems.append(F.when(F.coalesce(*parts).isNull(), "missing_identity"))
    out = out.withColumn("object_id", F.coalesce(*parts)).withColumn("problem", F.coalesce(*problems))
    out = out.withColumn("identity", F.coalesce(F.col("object_id"), F.concat(F.lit("new:"), value)))
    return out.drop(*[c for c in out.columns if c.startswith("__")])


def plan_objects(rows: DataFrame, objects: DataFrame, defs: DataFrame, type_id: str, columns: dict[str, str], match: str | None = None) -> Plan:
    """rows: as from ``identify``. ``match``: the attribute that identifies; it is written on creates only."""
    bad = rows.where("problem is not null").select("row_number", F.col("problem").alias("code"))
    d = defs.where((F.col("owner_id") == type_id)).select(F.concat(F.lit("attributes."), F.col("key")).alias("field"), "data_type")
    last = last_cells(long_cells(rows.where("problem is null"), columns)).join(d, "field", "left")
    data_type = F.coalesce("data_type", F.when(F.col("field") == "is_active", "boolean").otherwise("text"))
    last = last.withColumn("new", coerce(F.col("cell"), data_type))
    canonical = objects.where(F.col("type_id") == type_id).select(F.col("id").alias("identity"), "name", "description", F.col("is_active").cast("string").alias("is_active"), "attributes")
    met = last.join(canonical, "identity", "left")
    old = F.when(F.startswith("field", F.lit("attributes.")), F.element_at("attributes", F.substring("field", 12, 1000))).when(F.col("field") == "name", F.col("name")).when(F.col("field") == "description", F.col("description")).otherwise(F.col("is_active"))
    old_kind = F.when(old.isNull(), "null").when(data_type == "number", "number").when(data_type == "boolean", "boolean").otherwise("string")
    exists = F.col("name").isNotNull()
    met = met.withColumn("old", old).withColumn("exists", exists)
    changed = ~same_value(F.col("old"), old_kind, F.col("new.value"), F.col("new.kind"))
    written = F.when(F.col("exists"), changed & (F.col("field") != F.lit(f"attributes.{match}" if match else ""))).otherwise(F.col("new.value").isNotNull())
    operation = F.when(F.col("exists"), "update").otherwise("create")
    met = met.withColumn("written", written).withColumn("operation", operation)
    changes = met.where("written").select("operation", "identity", "field", F.col("old"), F.col("new.value").alias("new"), F.col("new.converted").alias("converted"), "first_row")
    per = met.groupBy("identity", "exists").agg(F.count_if("written").alias("writes"), F.count_if(~F.col("new.converted")).alias("unread"))
    summary = per.agg(
        F.count_if(~F.col("exists")).alias("creates"),
        F.count_if(F.col("exists") & (F.col("writes") > 0)).alias("updates"),
        F.count_if(F.col("exists") & (F.col("writes") == 0)).alias("unchanged"),
        F.coalesce(F.sum(F.when(F.col("exists"), F.col("writes"))), F.lit(0)).alias("field_changes"),
        F.coalesce(F.sum("unread"), F.lit(0)).alias("unconverted"),
    )
    return Plan(changes, bad, summary)


def unblocked(plan: Plan, most: int = MOST_CHANGES) -> DataFrame:
    """The changes, or an error if a problem or the limit blocks the plan: a plan is taken whole or not at all."""
    if not plan.problems.isEmpty():
        raise ValueError("the file has problems; nothing is imported")
    if plan.changes.select("identity").distinct().limit(most + 1).count() > most:
        raise ValueError(f"more than {most} changes")
    return plan.changes


def preview(plan: Plan, items: int = 25, problems: int = 100) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The first changes by row, the first problems by row, and (changes, problems) in all."""
    totals = plan.changes.select(F.lit("c").alias("part")).unionByName(plan.problems.select(F.lit("p").alias("part"))).agg(F.count_if(F.col("part") == "c").alias("changes"), F.count_if(F.col("part") == "p").alias("problems"))
    return plan.changes.orderBy("first_row", "identity").limit(items), plan.problems.orderBy("row_number", "code").limit(problems), totals


def duplicate_identities(rows: DataFrame) -> DataFrame:
    """Identities that several rows name, and by how many rows."""
    return rows.where("identity is not null").groupBy("identity").agg(F.count(F.lit(1)).alias("rows")).where("rows > 1")


def resolve_endpoints(rows: DataFrame, column: str, objects: DataFrame, allowed: list[str], by: str = "key", prefix: str = "subject", data_type: str | None = None) -> DataFrame:
    """Adds <prefix>_id, <prefix>_type and <prefix>_problem: an end named by key, id or ``attribute:<key>`` among the allowed types.

    An id that is neither there nor in the form of one is invalid, as is a value that can't be read as the attribute's
    ``data_type``; a value is looked up as it is read.
    """
    own = objects.where(F.col("type_id").isin(*allowed))
    read = coerce(F.col(column), F.lit(data_type)) if data_type else None
    cell = strip(F.col(column)) if read is None else read["value"]
    value = F.col("id") if by == "id" else F.col("key") if by == "key" else F.element_at("attributes", F.lit(by.removeprefix("attribute:")))
    if data_type:
        value = coerce(value, F.lit(data_type))["value"]
    found = own.select(value.alias("__v"), "id", "type_id").where("__v is not null").groupBy("__v").agg(F.count(F.lit(1)).alias("__n"), F.min(F.struct("id", "type_id")).alias("__hit"))
    cell = F.coalesce(uuid_of(F.col(column)), cell) if by == "id" else cell
    out = rows.withColumn("__cell", cell).join(found, F.col("__cell") == F.col("__v"), "left")
    ambiguous = "ambiguous_endpoint_key" if by == "key" else "ambiguous_endpoint"
    problem = F.when(is_blank(F.col(column)), "missing_endpoint")
    if by == "id":
        problem = problem.when(F.col("__n").isNull() & uuid_of(F.col(column)).isNull(), "invalid_endpoint_id")
    if read is not None:
        problem = problem.when(~read["converted"], "invalid_endpoint_value")
    problem = problem.when(F.col("__n").isNull(), "unresolved_endpoint").when(F.col("__n") > 1, ambiguous)
    out = out.withColumn(f"{prefix}_problem", problem).withColumn(f"{prefix}_id", F.when(F.col("__n") == 1, F.col("__hit.id"))).withColumn(f"{prefix}_type", F.when(F.col("__n") == 1, F.col("__hit.type_id")))
    return out.drop("__cell", "__v", "__n", "__hit")


def identify_edges(rows: DataFrame, relationships: DataFrame, rel_type_id: str, column: str) -> DataFrame:
    """Adds edge_id and problem to rows that name an edge by its id."""
    wanted = uuid_of(F.col(column))
    edges = relationships.select(F.col("id").alias("__id"), F.col("type_id").alias("__type"))
    out = rows.withColumn("__wanted", F.coalesce(wanted, strip(F.col(column)))).join(edges, F.col("__wanted") == F.col("__id"), "left")
    problem = F.when(is_blank(F.col(column)), "missing_identity").when(F.col("__id").isNull() & wanted.isNull(), "invalid_identity_id").when(F.col("__id").isNull(), "unresolved_identity").when(F.col("__type") != rel_type_id, "wrong_relationship_type")
    return out.withColumn("problem", problem).withColumn("edge_id", F.when(F.col("__type") == rel_type_id, F.col("__id"))).drop("__wanted", "__id", "__type")


def match_edges(rows: DataFrame, rules: DataFrame, relationships: DataFrame, rel_type_id: str) -> DataFrame:
    """Adds edge_id and problem to rows with both resolved ends: the one edge of a pair, none for a new pair; an end that is not
    resolved, a pair that no rule allows and a pair of several edges are problems."""
    pairs = rules.where(F.col("rel_type_id") == rel_type_id).select(F.col("subject_type_id").alias("subject_type"), F.col("object_type_id").alias("object_type"), F.lit(True).alias("__allowed"))
    out = rows.join(pairs, ["subject_type", "object_type"], "left")
    there = relationships.where(F.col("type_id") == rel_type_id).groupBy(F.col("source_id").alias("subject_id"), F.col("target_id").alias("object_id")).agg(F.count(F.lit(1)).alias("__edges"), F.min("id").alias("edge_id"))
    out = out.join(there, ["subject_id", "object_id"], "left")
    ends = F.coalesce("subject_problem", "object_problem")
    problem = F.coalesce(ends, F.when(F.col("__allowed").isNull(), "endpoint_pair_not_allowed"), F.when(F.col("__edges") > 1, "ambiguous_relationship"))
    return out.withColumn("problem", problem).drop("__allowed", "__edges")


def plan_edges(rows: DataFrame, rules: DataFrame, relationships: DataFrame, rel_type_id: str) -> Plan:
    """rows: row_number with both resolved ends. Pairs that exist are unchanged, new allowed ones are created, the rest are problems."""
    out = match_edges(rows, rules, relationships, rel_type_id)
    good = out.where("problem is null").groupBy("subject_id", "object_id", "edge_id").agg(F.min("row_number").alias("first_row"), F.count(F.lit(1)).alias("rows"))
    changes = good.where("edge_id is null").select(F.lit("create").alias("operation"), F.concat_ws(":", F.lit(rel_type_id), "subject_id", "object_id").alias("identity"), "subject_id", "object_id", "first_row")
    summary = good.agg(F.count_if(F.col("edge_id").isNull()).alias("creates"), F.count_if(F.col("edge_id").isNotNull()).alias("unchanged"), F.coalesce(F.sum(F.col("rows") - 1), F.lit(0)).alias("duplicates"))
    return Plan(changes, out.where("problem is not null").select("row_number", F.col("problem").alias("code")), summary)


def plan_edge_values(rows: DataFrame, relationships: DataFrame, defs: DataFrame, rel_type_id: str, columns: dict[str, str]) -> Plan:
    """Values of edges: rows as from ``identify_edges``, or from ``match_edges`` where pairs may be new; ``columns``: column -> field.

    The last row of an edge wins per field, a blank cell is a null. An edge that is there gets the fields whose value
    changes; a new one is active unless a cell says otherwise, and has the attributes that are not null.
    """
    ends = [F.col(c) if c in rows.columns else F.lit(None).cast("string") for c in ("subject_id", "object_id")]
    named = F.coalesce(F.col("edge_id"), F.concat_ws(":", F.lit(rel_type_id), *[c for c in ("subject_id", "object_id") if c in rows.columns]))
    default = "is_active" not in columns.values()
    fields = {f: F.col(c) for c, f in columns.items()} | ({"is_active": F.lit(None).cast("string")} if default else {})
    # one row an edge, with the last cell of each field: its fields lie where it does, so only it is moved
    last = [F.max_by(F.struct(c.alias("cell")), "row_number").alias(f"__cell{n}") for n, c in enumerate(fields.values())]
    good = rows.where("problem is null").withColumn("identity", named)
    per = good.groupBy("identity").agg(F.min("row_number").alias("first_row"), F.count(F.lit(1)).alias("rows"), F.min(ends[0]).alias("subject_id"), F.min(ends[1]).alias("object_id"), *last)
    types = defs.where(F.col("owner_id") == rel_type_id).select(F.concat(F.lit("attributes."), F.col("key")).alias("field"), "data_type")
    own = relationships.where(F.col("type_id") == rel_type_id).select(F.col("id").alias("identity"), F.col("is_active").cast("string").alias("__was"), "attributes", F.lit(True).alias("__there"))
    active, exists = F.col("field") == "is_active", F.col("__there").isNotNull()
    data_type = F.coalesce("data_type", F.when(active, "boolean").otherwise("text"))
    # Cells are read before the join that follows: later columns name what was read, and don't repeat how.
    cells = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f"__cell{n}.cell").alias("cell")) for n, f in enumerate(fields)])
    kept = ["identity", "first_row", "rows", "subject_id", "object_id"]
    read = per.select(*kept, F.explode(cells).alias("x")).select(*kept, "x.*").join(types, "field", "left").withColumn("__type", data_type)
    met = read.select(*kept, "field", "__type", coerce(F.col("cell"), F.col("__type")).alias("new")).join(own, "identity", "left")
    old = F.when(active, F.col("__was")).otherwise(F.element_at("attributes", F.substring("field", 12, 1000)))
    met = met.withColumns({"exists": exists, "old": old})
    old_kind = F.when(F.col("old").isNull(), "null").when(F.col("__type").isin("number", "boolean"), F.col("__type")).otherwise("string")
    changed = ~same_value(F.col("old"), old_kind, F.col("new.value"), F.col("new.kind"))
    written = F.when(F.col("exists"), changed & ~(active & F.lit(default))).otherwise(active | F.col("new.value").isNotNull())
    value = F.when(~F.col("exists") & active, F.coalesce(F.col("new.value"), F.lit("true"))).otherwise(F.col("new.value"))
    met = met.withColumns({"written": written, "value": value, "operation": F.when(F.col("exists"), "update").otherwise("create")})
    changes = met.where("written").select("operation", "identity", "subject_id", "object_id", "field", "old", F.col("value").alias("new"), F.col("new.converted").alias("converted"), "first_row")
    totals = met.groupBy("identity", "exists", "rows").agg(F.count_if("written").alias("writes"), F.count_if(~F.col("new.converted")).alias("unread"))
    zero = lambda c: F.coalesce(F.sum(c), F.lit(0))
    summary = totals.agg(
        F.count_if(~F.col("exists")).alias("creates"),
        F.count_if(F.col("exists") & (F.col("writes") > 0)).alias("updates"),
        F.count_if(F.col("exists") & (F.col("writes") == 0)).alias("unchanged"),
        zero(F.when(F.col("exists"), F.col("writes"))).alias("field_changes"),
        zero("unread").alias("unconverted"),
        F.count_if(F.col("rows") > 1).alias("duplicate_identities"),
        zero(F.when(F.col("rows") > 1, F.col("rows"))).alias("duplicate_rows"),
    )
    return Plan(changes, rows.where("problem is not null").select("row_number", F.col("problem").alias("code")), summary)


def suggest_fields(headers: DataFrame, fields: DataFrame) -> DataFrame:
    """(position, header, field): each field for the leftmost header that equals its name, key or a synonym, letters and digits only."""
    norm = lambda c: F.regexp_replace(F.lower(c), "[^a-z0-9]+", "")
    names = fields.select("field", F.explode(F.concat(F.array("field", "label"), F.coalesce("synonyms", F.array().cast("array<string>")))).alias("__n")).select("field", norm("__n").alias("__n")).distinct()
    hit = headers.withColumn("__n", norm("header")).join(names, "__n")
    first = hit.groupBy("field").agg(F.min_by(F.struct("position", "header"), "position").alias("x"))
    one = first.groupBy("x.position", "x.header").agg(F.min("field").alias("field"))
    return one
