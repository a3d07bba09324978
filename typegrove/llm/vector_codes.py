"""Compression of vectors to codes: eight codebooks of 16 entries, fitted in integers and searched by Exponion balls.

Components become integers, floor(4096 x), and vectors are cut into equal parts, each with its codebook. A round assigns
every part to the nearest entry of its codebook and moves the entries to the floor of their parts' means.

The search starts at the part's previous entry a, at squared distance e. By the triangle inequality an entry c that is as
near as a lies within twice that distance of a, |c - a|^2 <= 4 e, so of a's neighbours, sorted by their distance to a, only
those within that ball are met, in their order; all distances are exact integers and of equal ones the lower index wins,
so the result is that of a full search. The first search starts at entry 0.

Each round reads a table of vectors with their codes and writes the next, one row a vector, and with it, in a folder
apart, one row of sums a task. So a round is one pass without a shuffle, the driver gets the codebooks only
(parts x entries x width numbers), and a lost executor repeats tasks of one round.

Defined results: rows whose vector is null, or has a null, NaN or infinite component, are dropped; the 16 entries to start
with are the parts of the least vec_ids, those without vec_id last and rows of one vec_id in the order of their
components, so repeated rows may start as equal entries, of which the lower index wins; fewer than 16 rows give as many
entries; vectors that are shorter than the longest, or not of a multiple of 8 components, are filled up with zeros; a
component so large that a squared distance could leave 64 bits is an error, never a wrong number; other columns are not
looked at; no rows give no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

SCALE, PARTS, ENTRIES, ROUNDS = 4096, 8, 16, 6
#: Labels up to this number go to every executor with their sums (some bytes each); more are joined by a shuffle, each
#: label's rows dealt to ``SALTS`` tasks.
BROADCAST_LABELS, SALTS = 10_000, 32
STATE = "vec_id long, label int, v array<bigint>, code binary, error bigint"


def nearest(points: np.ndarray, start: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest entry of each point and its squared distance, searched from the entries in ``start``."""
    gaps = ((entries[:, None, :] - entries[None, :, :]) ** 2).sum(axis=2)
    best, least = start.copy(), ((points - entries[start]) ** 2).sum(axis=1)
    for a in range(len(entries)):
        own = np.flatnonzero(start == a)
        radius = 4 * least[own]
        for c in np.argsort(gaps[a], kind="stable"):
            if c == a:
                continue
            inside = radius >= gaps[a, c]  # the list is sorted, so who is out stays out
            own, radius = own[inside], radius[inside]
            if not len(own):
                break
            far = ((points[own] - entries[c]) ** 2).sum(axis=1)
            closer = (far < least[own]) | ((far == least[own]) & (c < best[own]))
            best[own[closer]], least[own[closer]] = c, far[closer]
    return best, least


def _assign(books: np.ndarray, with_sums: bool):
    """For mapInArrow over rows of ``STATE``: their codes by ``books`` (part, entry, position), then the sums of the task."""
    parts, entries, width = books.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, counts = np.zeros(books.shape, np.int64), np.zeros((parts, entries), np.int64)
        for b in batches:
            n = b.num_rows
            if not n:
                continue
            flat = b.column("v").flatten().to_numpy(zero_copy_only=False)
            v = np.zeros((n, parts * width), np.int64)
            lengths = np.diff(b.column("v").offsets.to_numpy())
            v[np.repeat(np.arange(n), lengths), np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths)] = flat
            v = v.reshape(n, parts, width)
            old = np.frombuffer(b"".join(b.column("code").to_pylist()), np.uint8).reshape(n, parts)
            code, error = np.empty((n, parts), np.uint8), np.zeros(n, np.int64)
            for p in range(parts):
                at, far = nearest(v[:, p], old[:, p].astype(np.int64), books[p])
                code[:, p] = at
                error += far
                counts[p] += np.bincount(at, minlength=entries)
                np.add.at(sums[p], at, v[:, p])
            cols = [b.column("vec_id"), b.column("label"), b.column("v"), pa.array([x.tobytes() for x in code], pa.binary()), pa.array(error), pa.nulls(n, pa.list_(pa.int64())), pa.array(np.zeros(n, np.int32))]
            yield pa.RecordBatch.from_arrays(cols, NAMES)
        if with_sums and counts.any():
            one = np.concatenate([counts.ravel(), sums.ravel()])
            cols = [pa.nulls(1, pa.int64()), pa.nulls(1, pa.int32()), pa.nulls(1, pa.list_(pa.int64())), pa.nulls(1, pa.binary()), pa.nulls(1, pa.int64()), pa.array([one], pa.list_(pa.int64())), pa.array([1], pa.int32())]
            yield pa.RecordBatch.from_arrays(cols, NAMES)

    return run


NAMES = ["vec_id", "label", "v", "code", "error", "sums", "kind"]


def vectors(table: DataFrame) -> DataFrame:
    """(vec_id, label, v): the rows to be kept, components as integers."""
    v = F.transform(F.col("embedding").cast("array<double>"), lambda x: F.floor(x * SCALE))
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")))
    return table.where(F.col("embedding").isNotNull() & finite).select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("int").alias("label"), v.alias("v"))


class Codes:
    """Fitted codebooks, and the table of all vectors' codes and errors by them."""

    def __init__(self, books: np.ndarray, coded: DataFrame):
        self.books, self.coded = books, coded

    def sha256(self) -> str:
        return hashlib.sha256(",".join(map(str, self.books.ravel().tolist())).encode()).hexdigest()


def _next(books: np.ndarray, sums: DataFrame) -> np.ndarray:
    """The books after a round, from the sums of its tasks: as many numbers as the books have reach the driver."""
    added = sums.select(F.posexplode("sums").alias("pos", "x")).groupBy("pos").agg(F.sum("x").alias("x"))
    found = {r["pos"]: r["x"] for r in added.collect()}
    parts, entries, width = books.shape
    out, cells = books.copy(), parts * entries
    for cell in range(cells):
        if n := found.get(cell, 0):
            p, k = divmod(cell, entries)
            out[p, k] = [found[cells + cell * width + i] // n for i in range(width)]
    return out


def encode(table: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> Codes:
    """Fits the codebooks to all rows of ``table`` (vec_id, embedding, label) and codes them: (vec_id, label, v, code, error)."""
    if not 1 <= entries <= 256:
        raise ValueError("a code is a byte")
    spark = table.sparkSession
    scratch = common.Scratch(spark, "vector-codes")
    start = F.unhex(F.lit("00" * parts))
    state = scratch.keep(vectors(table).select("vec_id", "label", "v", start.alias("code"), F.lit(0).cast("long").alias("error")), "vectors", "zstd")
    found = state.agg(F.max(F.array_size("v")).alias("width"), F.max(F.array_max(F.transform("v", F.abs))).alias("most")).first()
    if found["width"] is None:
        return Codes(np.zeros((parts, 0, 0), np.int64), state)
    width = max(1, -(-found["width"] // parts))
    if (found["most"] or 0) > isqrt(((1 << 63) - 1) // (16 * width * parts)):
        raise ArithmeticError(f"a component of {found['most'] / SCALE} is too large for exact squared distances of 64 bits")
    first = [r["v"] for r in state.orderBy(F.col("vec_id").asc_nulls_last(), "v").limit(entries).collect()]
    books = np.array([x + [0] * (parts * width - len(x)) for x in first], np.int64).reshape(len(first), parts, width).transpose(1, 0, 2).copy()
    for k in range(rounds + 1):
        last = k == rounds
        out = state.mapInArrow(_assign(books, not last), f"{STATE}, sums array<bigint>, kind int")
        # one file a task and kind: the sums of a round lie apart from its vectors
        out.write.option("compression", "zstd").partitionBy("kind").parquet(scratch.path(f"round-{k}"))
        state = spark.read.schema(STATE).parquet(scratch.path(f"round-{k}/kind=0"))
        if not last:
            books = _next(books, spark.read.schema("sums array<bigint>").parquet(scratch.path(f"round-{k}/kind=1")))
        scratch.drop(f"round-{k - 1}" if k else "vectors")
    return Codes(books, state)


def with_label_error(coded: DataFrame) -> DataFrame:
    """Adds the sum of errors of equal labels, those without label together."""
    per = coded.groupBy("label").agg(F.sum("error").alias("label_error"))
    per = common.Scratch(coded.sparkSession, "label-errors").keep(per, "labels")
    if per.count() <= BROADCAST_LABELS:
        return coded.join(F.broadcast(per.withColumnRenamed("label", "__label")), F.col("label").eqNullSafe(F.col("__label"))).drop("__label")
    return salted(coded, per)


def salted(coded: DataFrame, per: DataFrame) -> DataFrame:
    """The join with sums of any number of labels: a hot label's rows go to ``SALTS`` tasks."""
    many = per.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))).withColumnRenamed("label", "__label")
    rows = coded.withColumn("__own", F.pmod(F.xxhash64("vec_id", "code", "error"), F.lit(SALTS)).cast("int"))
    return rows.join(many, F.col("label").eqNullSafe(F.col("__label")) & (F.col("__own") == F.col("__salt"))).drop("__label", "__salt", "__own")


def decode(codes: Codes) -> DataFrame:
    """(vec_id, vector): the approximation that each code stands for, in the vectors' own scale."""
    parts, entries, width = codes.books.shape
    flat = common.numbers(codes.books.ravel().tolist())
    places = F.flatten(F.transform(F.sequence(F.lit(0), F.lit(parts - 1)), lambda p: F.transform(F.sequence(F.lit(0), F.lit(width - 1)), lambda i: (p * entries + _byte(p)) * width + i)))
    return codes.coded.select("vec_id", F.transform(places, lambda i: F.element_at(flat, (i + 1).cast("int")) / SCALE).alias("vector"))


def _byte(p):
    """The p-th byte of the code."""
    return F.conv(F.substring(F.hex("code"), p * 2 + 1, F.lit(2)), 16, 10).cast("int")


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    codes = encode(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding", "label"))
    rows = with_label_error(codes.coded)
    return rows.select("vec_id", F.lower(F.hex("code")).alias("code"), "error", "label_error", F.lit(codes.sha256()).alias("codebooks_sha256"))


def _oracle() -> str:
    """The rounds one after the other, by full search over all entries."""
    sql = f"""
WITH kept AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY vec_id, embedding) AS rid, vec_id, label, embedding FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
places AS (SELECT rid, unnest(embedding) AS x, generate_subscripts(embedding, 1) - 1 AS i, len(embedding) // {PARTS} AS width FROM kept),
points AS MATERIALIZED (SELECT rid, i // width AS part, i % width AS pos, floor({SCALE} * x::DOUBLE)::BIGINT AS x FROM places),
book0 AS MATERIALIZED (SELECT part, rid - 1 AS entry, pos, x AS c FROM points WHERE rid <= {ENTRIES})"""
    for k in range(ROUNDS + 1):
        sql += f""",
far{k} AS MATERIALIZED (SELECT rid, part, entry, sum((x - c) * (x - c))::BIGINT AS d FROM points JOIN book{k} USING (part, pos) GROUP BY ALL),
code{k} AS MATERIALIZED (SELECT rid, part, entry, d FROM far{k} QUALIFY row_number() OVER (PARTITION BY rid, part ORDER BY d, entry) = 1)"""
        if k < ROUNDS:
            sql += f""",
mean{k} AS (SELECT part, entry, pos, sum(x)::BIGINT AS s, count(*) AS n FROM points JOIN code{k} USING (rid, part) GROUP BY ALL),
book{k + 1} AS MATERIALIZED (
  SELECT part, entry, pos, CASE WHEN n IS NULL THEN c ELSE (s - ((s % n) + n) % n) // n END AS c
  FROM book{k} LEFT JOIN mean{k} USING (part, entry, pos))"""
    return (
        sql
        + f""",
whole AS (SELECT sha256(string_agg(c::VARCHAR, ',' ORDER BY part, entry, pos)) AS codebooks_sha256 FROM book{ROUNDS}),
coded AS (SELECT rid, string_agg(printf('%02x', entry), '' ORDER BY part) AS code, sum(d)::BIGINT AS error FROM code{ROUNDS} GROUP BY rid)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256
FROM kept JOIN coded USING (rid), whole
"""
    )


ORACLE = _oracle()
