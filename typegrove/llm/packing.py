"""Packing along a space-filling curve.

A document's ids are hashed to a signed, damped term vector, projected to ``DIMS`` dimensions and placed on a Hilbert
curve over the unit directions, so documents of like wording get keys close together. Documents are dealt to ranges of
the key, ordered within, and their ids laid end to end along the curve; every ``LENGTH`` ids are a sequence. A running
sum within a range and a number per range give each document its place, so nothing is packed on the driver, and only
the last sequence of all is not full.

A third of all documents may share one key: ranges are cut over the key followed by hash bits of the id.

Defined results: a null text has the end id alone; rows that share a doc_id are packed each on its own, told apart by
their place on the curve; a very long text is one row of ids, cut where sequences end; other columns are not looked at;
no rows give no sequences.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common, tokens

END_ID, LENGTH = 1, 2048
#: Width of the hashed vector, dimensions and bits a dimension of the curve (31 bits in all at most).
WIDTH, DIMS, DEPTH = 256, 4, 7


def _tables() -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(20240229)
    return rng.standard_normal((WIDTH, DIMS)).astype(np.float64), np.arange(WIDTH)


def place(ids: np.ndarray, projection: np.ndarray) -> np.ndarray:
    """The document's direction in few dimensions, each from -1 to 1."""
    mixed = ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    slot = (mixed >> np.uint64(56)).astype(np.int64)
    sign = 1.0 - 2.0 * ((mixed >> np.uint64(40)) & np.uint64(1)).astype(np.float64)
    v = np.bincount(slot, weights=sign, minlength=WIDTH)
    v = np.sign(v) * np.sqrt(np.abs(v))
    x = v @ projection
    return x / max(np.linalg.norm(x), 1e-12)


def hilbert(points: np.ndarray, depth: int = DEPTH) -> np.ndarray:
    """Keys along the Hilbert curve of integer points (rows), after Skilling's transposed form, for all rows at once."""
    x = points.astype(np.int64).T.copy()
    n = len(x)
    q = 1 << (depth - 1)
    while q > 1:
        p = q - 1
        for i in range(n):
            on = (x[i] & q) != 0
            swap = (x[0] ^ x[i]) & p
            x[0] = np.where(on, x[0] ^ p, x[0] ^ swap)
            if i:
                x[i] = np.where(on, x[i], x[i] ^ swap)
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    t = np.zeros_like(x[0])
    q = 1 << (depth - 1)
    while q > 1:
        t = np.where((x[n - 1] & q) != 0, t ^ (q - 1), t)
        q >>= 1
    x ^= t
    key = np.zeros_like(x[0])
    for b in range(depth - 1, -1, -1):
        for i in range(n):
            key = (key << 1) | ((x[i] >> b) & 1)
    return key


def _encoder(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        projection, _ = _tables()
        for batch in batches:
            for at, found in tokens.encoded(batch.column("text"), path, 1 << 22):
                raw = [x + END_ID.to_bytes(4, "little") for x in found]
                where = np.array([place(np.frombuffer(x, "<u4"), projection) for x in raw])
                cell = np.clip(((where + 1) / 2 * (1 << DEPTH)).astype(np.int64), 0, (1 << DEPTH) - 1)
                cols = [batch.column(c).slice(at, len(raw)) for c in ("doc_id", "tie")]
                small = [np.frombuffer(x, "<u4").astype("<u2").tobytes() if np.frombuffer(x, "<u4").max(initial=0) < 1 << 16 else x for x in raw]
                wide = [len(s) == len(x) for s, x in zip(small, raw)]
                yield pa.RecordBatch.from_arrays([*cols, pa.array(hilbert(cell)), pa.array([len(x) // 4 for x in raw], pa.int64()), pa.array(wide), pa.array(small, pa.binary())], ["doc_id", "tie", "curve", "n", "wide", "ids"])

    return run


def _cutter(length: int):
    """Pieces of each document where sequences end; every row stands for itself."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64()), ("ids", pa.binary())])
        for b in batches:
            rows: list[list] = [[] for _ in schema]
            for doc, at, wide, ids in zip(*(b.column(c).to_pylist() for c in ("doc_id", "at", "wide", "ids"))):
                raw = ids if wide else np.frombuffer(ids, "<u2").astype("<u4").tobytes()
                n, start = len(raw) // 4, 0
                while start < n:
                    offset = (at + start) % length
                    size = min(length - offset, n - start)
                    part = raw[4 * start : 4 * (start + size)]
                    for col, v in zip(rows, (doc, start, size, zlib.crc32(part), n, (at + start) // length, offset, part)):
                        col.append(v)
                    start += size
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(rows, schema)], schema=schema)

    return run


PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, ids binary"


def pack(docs: DataFrame, length: int = LENGTH, tokenizer: str | None = None, tokens_a_range: int = 1 << 25) -> DataFrame:
    """Pieces with their ids (little-endian unsigned 32-bit), one row per document and sequence it lies in.

    Ranges of the curve hold about ``tokens_a_range`` ids at most, one task a range, so their number grows with the ids.
    """
    spark = docs.sparkSession
    scratch = common.Scratch(spark, "packing")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(common.text_of()).alias("tie"), "text")
    came = rows.mapInArrow(_encoder(tokenizer or tokens.tokenizer_path()), "doc_id long, tie long, curve long, n long, wide boolean, ids binary")
    came = scratch.keep(came, "encoded", "zstd")
    key = F.shiftleft("curve", 32).bitwiseOR(F.xxhash64("doc_id", "tie").bitwiseAND(F.lit(0xFFFFFFFF)))
    light = came.select(key.alias("key"), "n")
    total = light.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()["n"]
    bounds = common.range_bounds(light, "key", max(common.parallelism(spark), common.buckets_for(total, tokens_a_range)))
    here, ranges = common.bucket_of(F.col("key"), bounds).alias("range"), len(bounds) + 1
    (before,) = common.sums_before(light.withColumn("range", here), "range", ranges, "n")
    order = Window.partitionBy("range").orderBy("key", "doc_id", "tie").rowsBetween(Window.unboundedPreceding, -1)
    laid = came.withColumn("key", key).withColumn("range", here).repartitionById(ranges, "range")
    laid = laid.withColumn("at", before + F.coalesce(F.sum("n").over(order), F.lit(0)))
    return laid.select("doc_id", "at", "wide", "ids").mapInArrow(_cutter(length), PIECES)


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")).drop("ids")
