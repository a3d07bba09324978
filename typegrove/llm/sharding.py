"""Sharding by weighted rendezvous hashing of stable record keys.

For each shard a record draws a number u from the hash of its key and the shard's number, and goes to the shard of the
greatest -weight / ln(u). A shard's odds are its share of the weights, whatever the other shards are; a record moves only
if a new shard's draw beats all others, so one more shard takes rows into itself and moves none between the rest, and a
greater weight of one shard only draws rows to that one. Which shard a record goes to is an expression of its own row: no
shuffle, no state, the same in every run.

Within a shard records are numbered in the order of a hash of their row, which leaves each shard shuffled. The hash also
cuts a shard into buckets of about ``BUCKET`` rows by its leading bits; a bucket is numbered by a window, after the
rows of the buckets before it. Equal rows come as one row with a count and are dealt out again in blocks, so neither
a hot document nor rows without key meet in one task.

Defined results: a null text has size 1 and the crc32 of the empty text; rows without doc_id have one key, null, and go to
one shard; rows of one doc_id go to one shard, each with its slot; a very long text is hashed within its row; other
columns stay as they are (``write_shards``) or are not looked at (``shards``); no rows give no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

SHARDS = 8
#: Rows of a shard that one window numbers, about; copies of a row that one task deals out.
BUCKET, BLOCK = 1 << 12, 1 << 16
#: Bits of the hash numbers.
BITS = 52


def _number(text: Column) -> Column:
    """A whole number of 52 bits from the leading hex digits of the text's MD5."""
    return F.conv(F.substring(F.md5(text), 1, BITS // 4), 16, 10).cast("long")


def shard_of(key: Column, weights: list[float]) -> Column:
    """The number of the record's shard among those of the given positive weights, of equal draws the lowest."""
    if not weights or min(weights) <= 0:
        raise ValueError("weights above 0, one a shard")
    name = F.coalesce(key.cast("string"), F.lit(""))
    even = len(set(weights)) == 1
    draws = []
    for k, w in enumerate(weights):
        u = _number(F.concat(name, F.lit(f":{k}")))
        # of equal weights the greatest u has the greatest -1 / ln(u)
        score = u if even else F.lit(-float(w)) / F.ln((u + 0.5) / float(1 << BITS))
        draws.append(F.struct(score.alias("score"), F.lit(-k).alias("k")))
    return (-(F.array_max(F.array(*draws))["k"])).cast("int")


def keyed(docs: DataFrame, weights: list[float]) -> DataFrame:
    """(doc_id, size, text_crc32, place) of each row with its shard, and its shard if there were one more of the mean weight."""
    text = common.text_of()
    key, grown = F.col("doc_id"), [*weights, sum(weights) / len(weights)]
    out = docs.select("doc_id", (F.octet_length(text).cast("long") + 1).alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    place = _number(F.concat_ws(":", F.coalesce(key.cast("string"), F.lit("")), F.col("size").cast("string"), F.col("text_crc32").cast("string")))
    return out.select("*", place.alias("place"), shard_of(key, weights).alias("shard"), shard_of(key, grown).alias("grown_shard"))


def numbered(rows: DataFrame, bucket: int = BUCKET, block: int = BLOCK) -> DataFrame:
    """Rows of ``keyed`` with their slot: from 0 without gaps within each shard."""
    scratch = common.Scratch(rows.sparkSession, "shards")
    names = ["doc_id", "size", "text_crc32", "place", "shard", "grown_shard"]
    rows = scratch.keep(rows.groupBy(*names).agg(F.count(F.lit(1)).alias("n")), "rows")
    most = rows.groupBy("shard").count().agg(F.max("count")).first()[0] or 0
    bits = max(0, -(-most // bucket) - 1).bit_length()
    rows = rows.withColumn("bucket", F.shiftright("place", BITS - bits) if bits else F.lit(0).cast("long"))
    own = Window.partitionBy("shard", "bucket")
    before = F.sum("n").over(own.orderBy("place", "doc_id", "size", "text_crc32").rowsBetween(Window.unboundedPreceding, -1))
    sums = rows.groupBy("shard", "bucket").agg(F.sum("n").alias("all"))  # a row for each bucket
    start = F.sum("all").over(Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1))
    sums = scratch.keep(sums.select("shard", "bucket", F.coalesce(start, F.lit(0)).alias("start")), "starts")
    rows = rows.withColumn("before", F.coalesce(before, F.lit(0))).join(sums, ["shard", "bucket"])
    rows = rows.select(*names, "n", (F.col("start") + F.col("before")).alias("first"))
    once = rows.where("n = 1").select(*names, F.col("first").alias("slot"))
    blocks = rows.where("n > 1").withColumn("at", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1, F.lit(block).cast("long")))).repartition("shard", "first", "at")
    inner = F.explode(F.sequence(F.col("at"), F.least(F.col("at") + block, F.col("n")) - 1))
    return once.unionByName(blocks.withColumn("k", inner).select(*names, (F.col("first") + F.col("k")).alias("slot")))


def shards(docs: DataFrame, weights: list[float]) -> DataFrame:
    """One row per document: doc_id, size, text_crc32, place, shard, slot, grown_shard."""
    return numbered(keyed(docs, weights))


def write_shards(docs: DataFrame, path: str, weights: list[float], rows_a_file: int = 1_000_000) -> None:
    """Writes ``docs`` as Parquet, a folder a shard (``shard=0`` ...), its rows in the order of their slots over its files by name.

    One shuffle of the documents, by ranges of shard and place; equal rows may be dealt to several ranges.
    """
    text, key = common.text_of(), F.col("doc_id")
    place = _number(F.concat_ws(":", F.coalesce(key.cast("string"), F.lit("")), (F.octet_length(text).cast("long") + 1).cast("string"), F.crc32(text.cast("binary")).cast("string")))
    own = {"shard": shard_of(key, weights), "__place": place}
    if clash := [c for c in docs.columns if c.lower() in own]:
        raise ValueError(f"columns that the shards' folders need: {clash}")
    order = ["shard", "__place", "doc_id"]
    rows = docs.withColumns(own).withColumn("__row", F.monotonically_increasing_id())
    files = max(len(weights), common.buckets_for(docs.count(), rows_a_file))
    rows = rows.repartitionByRange(files, *order, "__row").sortWithinPartitions(*order, "__row")
    rows.drop("__place", "__row").write.partitionBy("shard").parquet(path)


def op13_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = shards(docs, [1.0] * SHARDS)
    return out.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


#: The crc32 in SQL goes over each text's bytes by a table of 256 values made from the polynomial.
ORACLE = f"""
WITH RECURSIVE poly AS (
  SELECT i, 0 AS k, i::BIGINT AS v FROM range(256) t(i)
  UNION ALL
  SELECT i, k + 1, CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END FROM poly WHERE k < 8),
crcs AS MATERIALIZED (SELECT list(v ORDER BY i) AS t FROM poly WHERE k = 8),
sized AS MATERIALIZED (
  SELECT doc_id, strlen(coalesce(text, '')) + 1 AS size,
         xor(list_reduce(list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda h: ('0x' || h)::BIGINT),
                         lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]), 4294967295::BIGINT), 4294967295) AS text_crc32
  FROM documents, crcs),
ids AS (SELECT DISTINCT doc_id FROM sized),
draws AS (
  SELECT doc_id, k, ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '') || ':' || k), 1, 13))::BIGINT AS u
  FROM ids, range({SHARDS + 1}) r(k)),
placed AS (
  SELECT doc_id, arg_max(k, (u, -k)) FILTER (k < {SHARDS}) AS shard, arg_max(k, (u, -k)) AS grown FROM draws GROUP BY doc_id)
SELECT sized.doc_id, size::BIGINT AS size, text_crc32::BIGINT AS text_crc32, 'key' AS law, shard::INTEGER AS shard,
       row_number() OVER (
         PARTITION BY shard
         ORDER BY ('0x' || substr(md5(coalesce(sized.doc_id::VARCHAR, '') || ':' || size || ':' || text_crc32), 1, 13))::BIGINT,
                  sized.doc_id, size, text_crc32) - 1 AS slot,
       grown::INTEGER AS grown_shard
FROM sized JOIN placed ON placed.doc_id IS NOT DISTINCT FROM sized.doc_id
"""
