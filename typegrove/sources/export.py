"""Exports: rows for import templates, edges with their ends' keys, JSON documents, snapshot bundles and digests."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import file_slug
from ..operators import dataset as ds
from ..schema import Dataset
from .tables import MOST_ROWS

#: Fixed limits of a publication.
MOST_OBJECTS, MOST_BYTES = 25_000, 50 * 1024 * 1024


def template_rows(dataset: Dataset, type_id: str, attributes: list[str]) -> DataFrame:
    """Current objects of a type as an import file has them: key, name, description, is_active, then attributes."""
    rows = dataset.objects.where(F.col("type_id") == type_id)
    return rows.select("key", "name", "description", F.col("is_active").cast("string").alias("is_active"), *[F.element_at("attributes", F.lit(a)).alias(a) for a in attributes])


def edges_with_keys(dataset: Dataset) -> DataFrame:
    """Edges that name their ends by key."""
    named = {"source_type": "subject_type", "source_key": "subject_key", "target_type": "object_type", "target_key": "object_key"}
    return ds.with_ends(dataset, "key").withColumnsRenamed(named).select("id", "type_id", "subject_type", "subject_key", "object_type", "object_key", "attributes", "is_active")


def json_lines(dataset: Dataset) -> DataFrame:
    """(part, id, value): every record as a JSON document, one per line, to be written by ``write.text``-like sinks."""
    def part(name: str, df: DataFrame) -> DataFrame:
        return df.select(F.lit(name).alias("part"), "id", F.to_json(F.struct(*[F.col(c) for c in sorted(df.columns)])).alias("value"))

    return (
        part("object_type", dataset.object_types)
        .unionByName(part("relationship_type", dataset.relationship_types))
        .unionByName(part("rule", dataset.rules))
        .unionByName(part("attribute_definition", dataset.attribute_defs))
        .unionByName(part("object", dataset.objects))
        .unionByName(part("relationship", edges_with_keys(dataset)))
    )


def write_json(dataset: Dataset, path: str) -> None:
    json_lines(dataset).write.partitionBy("part").mode("overwrite").json(path)


#: The lists of an exported document, in their order.
PARTS = ("object_type", "relationship_type", "rule", "attribute_definition", "object", "relationship")


def document(lines: DataFrame) -> DataFrame:
    """``lines`` (part, id, value) as rows of text that are one JSON object when put together in order: a list a part.

    Each row brings the separators before it, which depend on whether it is the first of its part; that takes the least id of
    each part and the greatest of the last, six rows, and no numbering. Ids are different within a part.
    """
    ends = {r["part"]: r for r in lines.groupBy("part").agg(F.min("id").alias("first"), F.max("id").alias("last")).collect()}  # a row a part
    full, head, opened = [p for p in PARTS if p in ends], F.lit(","), "{"
    before = {}
    for p in PARTS:
        before[p] = opened + json.dumps(p) + ":["
        opened = ("" if p in ends else before[p]) + "],"
    for p in full:
        head = F.when((F.col("part") == p) & (F.col("id") == ends[p]["first"]), before[p]).otherwise(head)
    tail = opened[:-1] + "}"
    own = (F.col("part") == full[-1]) & (F.col("id") == ends[full[-1]]["last"]) if full else F.lit(False)
    place = F.array_position(F.array(*map(F.lit, PARTS)), F.col("part")).cast("int")
    return lines.select(place.alias("place"), "id", F.concat(head, "value", F.when(own, tail).otherwise("")).alias("value"))


def write_document(lines: DataFrame, path: str) -> None:
    """Writes the document as text files whose concatenation by name is valid JSON: ranges of part and id, one task each."""
    rows = document(lines)
    rows.repartitionByRange("place", "id").sortWithinPartitions("place", "id").select("value").write.text(path)


def export_name(model: str, revision: int) -> str:
    return f"{file_slug(model)}-r{revision}.json"


def write_template(rows: DataFrame, path: str, order: tuple[str, ...] = ("name",), most: int = MOST_ROWS) -> None:
    """CSV with CRLF line ends and a header, in one file: rows by name, no more than an import takes."""
    if rows.limit(most + 1).count() > most:
        raise ValueError(f"more than {most} rows; an import would not take them back")
    rows.orderBy(*order).coalesce(1).write.mode("overwrite").option("header", True).option("lineSep", "\r\n").option("emptyValue", "").csv(path)


def digest_of(values: str) -> Column:
    """An aggregate: SHA-256 over the sorted SHA-256 of a group's texts, as hexadecimal digits. Until they are sorted they are bytes,
    which have the order of their digits and half their length, so that is what a shuffle moves."""
    own = F.array_sort(F.collect_list(F.unhex(F.sha2(values, 256))))
    return F.sha2(F.array_join(F.transform(own, lambda x: F.lower(F.hex(x))), ","), 256)


def digests(lines: DataFrame) -> DataFrame:
    """(part, records, digest): SHA-256 over the sorted SHA-256 of a part's records, by blocks, so no block holds them all."""
    block = lines.groupBy("part", F.left(F.sha2("value", 256), F.lit(3)).alias("block")).agg(F.count(F.lit(1)).alias("n"), digest_of("value").alias("h"))
    return block.groupBy("part").agg(F.sum("n").alias("records"), F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block", "h"))), lambda x: x["h"]), ","), 256).alias("digest"))


def content_digest(lines: DataFrame) -> str:
    """One digest of a snapshot, from its parts' digests."""
    import hashlib

    parts = sorted((r["part"], r["digest"]) for r in digests(lines).collect())  # a row per part
    return hashlib.sha256(";".join(f"{p}={d}" for p, d in parts).encode()).hexdigest()


def size_problems(dataset: Dataset) -> DataFrame:
    """(code, value) where a snapshot is over its limits."""
    n = dataset.objects.agg(F.count(F.lit(1)).alias("value")).withColumn("code", F.lit("too_many_objects")).where(F.col("value") > MOST_OBJECTS)
    size = json_lines(dataset).agg(F.coalesce(F.sum(F.octet_length("value")), F.lit(0)).alias("value")).withColumn("code", F.lit("too_large")).where(F.col("value") > MOST_BYTES)
    return n.unionByName(size).select("code", "value")


def latest(manifest: DataFrame, per: str = "model_id") -> DataFrame:
    own = Window.partitionBy(per).orderBy(F.desc("sequence"))
    return manifest.withColumn("__rank", F.row_number().over(own)).where("__rank = 1").drop("__rank")


def payload_problems(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(code, id): empty or repeated ids of nodes and edges, and edges without both ends."""
    def repeated(df: DataFrame, code: str) -> DataFrame:
        return df.groupBy("id").agg(F.count(F.lit(1)).alias("n")).where("n > 1 or id is null or id = ''").select(F.lit(code).alias("code"), "id")

    ids = nodes.select("id")
    lost = edges.join(ids.withColumnRenamed("id", "source_id"), "source_id", "left_anti").select("id").unionByName(edges.join(ids.withColumnRenamed("id", "target_id"), "target_id", "left_anti").select("id")).distinct()
    return repeated(nodes, "bad_node_id").unionByName(repeated(edges, "bad_edge_id")).unionByName(lost.select(F.lit("dangling_edge").alias("code"), "id"))
