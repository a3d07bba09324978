"""Toxicity by a factorization machine over hashed terms.

A text's terms are its words (letters and digits, lower case) and the words' first letters, hashed to slots, each
counted as present or not. The score is a logistic factorization machine over all slots that occur in the texts learned
from: a bias, a weight per slot and, for pairs of terms, the product of two short vectors, so a pair such as an insult
with a group's name weighs what neither does alone. No term is screened: every slot is in the machine from the first
step. Steps are proximal: a weight that no evidence holds up is drawn to zero, and vectors decay, so that the many terms
of one text or two don't add up to noise. Of the machines after each round the one with the least loss on labelled rows
kept apart is taken.

Slots are made by built-in functions, before anything is shuffled. Training runs on tasks: a fixed number of shards each
takes minibatch steps over its rows, in an order fixed by id and terms, from the common parameters; their results are
averaged by how often each slot was seen, and sent out again, for a few rounds. A shard that is computed again gives the
same result. Parameters have at most one place per slot; shards write theirs to the shared folder and the driver takes
them up one block of slots after another. Learning takes about ``MOST_ROWS`` labelled documents at most, chosen by a hash
of the id; scoring goes over all whole texts, a very long one in the memory of its own list of different terms.

Defined results: empty and null texts have no terms and get the score of the bias; without labels of both kinds the
score is the share of toxic ones (0.5 with no labels at all) for every text; a document labelled more than once is toxic
if half its labels or more say so; rows without doc_id are scored and not learned from. Other columns are not looked at.
"""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: Slots as a power of two, length of their vectors, first letters that make terms too.
BITS, RANK, STEMS = 20, 4, (4, 6)
#: One of so many labelled rows is not learned from but decides between the machines.
KEPT = 8
#: Slots whose parameters a shard writes as one row.
BLOCK = 1 << 16
#: The most labelled rows that are learned from, shards, rounds of averaging, passes in a round, rows in a step.
MOST_ROWS, SHARDS, AVERAGES, PASSES, STEP = 40_000, 6, 4, 3, 64
#: Labelled rows that a shard should have, so that few rows make few shards.
SHARD_ROWS = 2000
#: Size of a step, pull of weights to zero, decay of vectors, and what the steps' running squares begin with (weights, vectors).
RATE, PULL, DECAY, FIRST = 0.2, 0.2, 0.5, (1.0, 10.0)


def terms(text: Column) -> Column:
    """array<int>: the slots of a text's terms, each once."""
    words = F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")

    def slots(w):
        hashes = [F.transform(w, lambda x: F.xxhash64(x))]
        hashes += [F.transform(F.filter(w, _longer(n)), _stem(n)) for n in STEMS]
        return F.array_distinct(F.transform(F.concat(*hashes), lambda h: h.bitwiseAND(F.lit((1 << BITS) - 1)).cast("int")))

    return common.let(F.array_distinct(words), slots)


def _longer(n: int):
    return lambda x: F.char_length(x) > n


def _stem(n: int):
    return lambda x: F.xxhash64(F.lit(f"first {n}"), F.substring(x, 1, n))


def occurring(rows: DataFrame) -> np.ndarray:
    """The slots of the rows, ascending. rows: slots. Each task sends one bit per slot."""

    def bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(1 << BITS, bool)
        for b in batches:
            seen[lists(b.column("slots"))[0]] = True
        yield pa.RecordBatch.from_arrays([pa.array([np.packbits(seen).tobytes()], pa.binary())], ["seen"])

    seen = np.zeros(1 << BITS >> 3, np.uint8)
    for r in rows.select("slots").mapInArrow(bits, "seen binary").toLocalIterator():
        seen |= np.frombuffer(r["seen"], np.uint8)
    return np.flatnonzero(np.unpackbits(seen)).astype(np.int32)


class Machine:
    """bias; and for the slots that occur in learned texts w and v (slots x rank)."""

    def __init__(self, bias: float, w: np.ndarray, v: np.ndarray, chosen: np.ndarray):
        self.bias, self.w, self.v, self.chosen = bias, w, v, chosen

    @classmethod
    def new(cls, positive: float, chosen: np.ndarray) -> Machine:
        rng = np.random.default_rng(11)
        p = min(max(positive, 1e-3), 1 - 1e-3)
        return cls(float(np.log(p / (1 - p))), np.zeros(len(chosen), np.float32), (0.01 * rng.standard_normal((len(chosen), RANK))).astype(np.float32), chosen)

    def own(self, slots: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Terms as places in the machine's tables, those of no learned text left out; starts and lengths."""
        if not hasattr(self, "_place"):
            self._place = np.full(1 << BITS, -1, np.int32)
            self._place[self.chosen] = np.arange(len(self.chosen), dtype=np.int32)
        at = self._place[slots]
        keep = at >= 0
        m = np.bincount(np.repeat(np.arange(len(n)), n)[keep], minlength=len(n))
        return at[keep], np.concatenate([[0], np.cumsum(m)[:-1]]).astype(np.int64) if len(m) else np.array([], np.int64), m

    def raw(self, slots: np.ndarray, starts: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Log-odds, sums of vectors per document, and the documents' scale: texts of any length have sums of one size."""
        out, sums = np.full(len(n), self.bias), np.zeros((len(n), RANK))
        scale = 64 / (n + 64.0)
        full = n > 0
        if full.any():
            at = starts[full]
            v = self.v[slots]
            sums[full] = np.add.reduceat(v, at, axis=0)
            squares = np.add.reduceat((v * v).sum(axis=1), at)
            out[full] += np.add.reduceat(self.w[slots], at) + 0.5 * ((sums[full] ** 2).sum(axis=1) - squares) * scale[full]
        return out, sums, scale

    def pack(self) -> bytes:
        f = io.BytesIO()
        np.savez(f, bias=self.bias, w=self.w, v=self.v, chosen=self.chosen)
        return f.getvalue()

    @classmethod
    def unpack(cls, data: bytes) -> Machine:
        x = np.load(io.BytesIO(data))
        return cls(float(x["bias"]), x["w"], x["v"], x["chosen"])


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -35, 35)))


def lists(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Values, starts and lengths of an Arrow list column."""
    offsets = column.offsets.to_numpy().astype(np.int64)
    return column.values.to_numpy()[offsets[0] : offsets[-1]], offsets[:-1] - offsets[0], np.diff(offsets)


def _steps(machine: Machine, slots: np.ndarray, n: np.ndarray, y: np.ndarray, weight: np.ndarray, sums: dict, seed: int) -> None:
    """Passes of adaptive, proximal minibatch steps over one shard's rows."""
    starts = np.concatenate([[0], np.cumsum(n)[:-1]]).astype(np.int64) if len(n) else np.array([], np.int64)
    rng = np.random.default_rng(seed)
    for _ in range(PASSES):
        order = rng.permutation(len(n))
        for k in range(0, len(order), STEP):
            rows = order[k : k + STEP]
            m = n[rows]
            doc = np.repeat(np.arange(len(rows)), m)
            own = np.concatenate([[0], np.cumsum(m)[:-1]]).astype(np.int64)
            x = slots[np.arange(m.sum()) - np.repeat(own, m) + np.repeat(starts[rows], m)]
            out, vectors, scale = machine.raw(x, own, m)
            error = (sigmoid(out) - y[rows]) * weight[rows]
            machine.bias -= RATE * 0.1 * float(error.mean())
            if not len(x):
                continue
            used, at = np.unique(x, return_inverse=True)
            gw = np.bincount(at, weights=error[doc], minlength=len(used))
            sums["w"][used] += gw * gw
            pull = (error * scale)[doc][:, None] * (vectors[doc] - machine.v[x])
            gv = np.stack([np.bincount(at, weights=pull[:, j], minlength=len(used)) for j in range(RANK)], axis=1) + DECAY * machine.v[used]
            sums["v"][used] += gv * gv
            step = RATE / np.sqrt(sums["w"][used] + FIRST[0])
            w = machine.w[used] - step * gw
            machine.w[used] = np.sign(w) * np.maximum(np.abs(w) - step * PULL, 0)
            machine.v[used] -= RATE * 0.3 * gv / np.sqrt(sums["v"][used] + FIRST[1])


def rounds(machine: Machine, rows: DataFrame, positive: float, scratch: common.Scratch) -> Iterator[Machine]:
    """The machine after each round. Parameters go out and come back once a round."""
    spark = rows.sparkSession
    size = len(machine.chosen)
    ordered = rows.repartitionById(SHARDS, "shard").sortWithinPartitions("id", "slots", "toxic").select("slots", "toxic")
    for k in range(AVERAGES):
        sent = spark.sparkContext.broadcast(machine.pack())

        def shard(batches: Iterator[pa.RecordBatch], sent=sent, k=k) -> Iterator[pa.RecordBatch]:
            own = Machine.unpack(sent.value)
            parts = [(lists(b.column("slots")), b.column("toxic").to_numpy()) for b in batches if len(b)]
            if not parts:
                return
            slots, n = np.concatenate([p[0][0] for p in parts]), np.concatenate([p[0][2] for p in parts])
            y = np.concatenate([p[1] for p in parts]).astype(np.float64)
            slots, _, n = own.own(slots, n)
            sums = {"w": np.zeros(size), "v": np.zeros((size, RANK))}
            _steps(own, slots, n, y, weights(y, positive), sums, k)
            seen = np.bincount(slots, minlength=size).astype(np.float32)
            for at in range(0, max(size, 1), BLOCK):
                own_part = [pa.array([x[at : at + BLOCK].astype(np.float32).tobytes()], pa.binary()) for x in (own.w, own.v, seen)]
                yield pa.RecordBatch.from_arrays([pa.array([at], pa.int32()), pa.array([len(y)], pa.int64()), pa.array([own.bias], pa.float64()), *own_part], ["at", "rows", "bias", "w", "v", "seen"])

        found = scratch.keep(ordered.mapInArrow(shard, "at int, rows long, bias double, w binary, v binary, seen binary"), f"round-{k}")
        bias, count = 0.0, 0
        w, v, total = np.zeros(size, np.float32), np.zeros((size, RANK), np.float32), np.zeros(size, np.float32)
        for r in found.toLocalIterator():
            part = slice(r["at"], r["at"] + BLOCK)
            share = np.frombuffer(r["seen"], np.float32) + np.float32(1e-3)
            w[part] += share * np.frombuffer(r["w"], np.float32)
            v[part] += share[:, None] * np.frombuffer(r["v"], np.float32).reshape(-1, RANK)
            total[part] += share
            if r["at"] == 0:
                bias, count = bias + r["rows"] * r["bias"], count + r["rows"]
        scratch.drop(f"round-{k}")
        sent.unpersist()
        if not count:  # no labelled text
            return
        machine = Machine(bias / count, w / total, v / total[:, None], machine.chosen)
        yield machine


def weights(y: np.ndarray, positive: float) -> np.ndarray:
    return np.where(y > 0, min((1 - positive) / max(positive, 1e-6), 20.0) ** 0.5, 1.0)


def loss(machine: Machine, rows: DataFrame, positive: float) -> float:
    """The weighted log loss over rows (slots, toxic)."""
    sent = rows.sparkSession.sparkContext.broadcast(machine.pack())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, total = Machine.unpack(sent.value), 0.0
        for b in batches:
            slots, _, n = lists(b.column("slots"))
            y = b.column("toxic").to_numpy().astype(np.float64)
            total += float((np.logaddexp(0, -own.raw(*own.own(slots, n))[0] * (2 * y - 1)) * weights(y, positive)).sum())
        yield pa.RecordBatch.from_arrays([pa.array([total])], ["loss"])

    found = rows.select("slots", "toxic").mapInArrow(run, "loss double").collect()  # a row per task
    sent.unpersist()
    return sum(r["loss"] for r in found)


def train(rows: DataFrame, kept: DataFrame, positive: float, scratch: common.Scratch) -> Machine:
    """rows, kept: id, shard int, slots array<int>, toxic int, already written; those to learn from and those to decide by."""
    first = Machine.new(positive, occurring(rows))
    best, least = first, None
    for machine in rounds(first, rows, positive, scratch):
        now = loss(machine, kept, positive)
        if least is None or now < least:
            best, least = machine, now
    return best


def fit(docs: DataFrame, labels: DataFrame, most_rows: int = MOST_ROWS) -> Machine:
    """docs: doc_id, text; labels: doc_id, toxic (rows that may be learned from)."""
    spark = docs.sparkSession
    labels = labels.where("toxic is not null and doc_id is not null").groupBy(F.col("doc_id").alias("__id")).agg((F.avg((F.col("toxic") > 0).cast("double")) >= 0.5).cast("int").alias("toxic"))
    counted = labels.agg(F.count(F.lit(1)), F.sum("toxic")).first()
    positive = (counted[1] or 0) / counted[0] if counted[0] else 0.5
    machine = Machine.new(positive, np.array([], np.int32))
    if counted[1] in (None, 0, counted[0]):
        if counted[0]:
            machine.bias = 40.0 if counted[1] else -40.0
        return machine
    # the share of documents that keeps to the bound, by a hash of the id
    share = min(1.0, most_rows / counted[0])
    shards = max(1, min(SHARDS, int(share * counted[0] / SHARD_ROWS)))
    order = F.pmod(F.xxhash64("__id"), F.lit(1 << 30))
    taken = labels.where(order < F.lit(int(share * (1 << 30)))).withColumn("shard", F.pmod(F.xxhash64(F.lit("shard"), "__id"), F.lit(shards)).cast("int")).withColumn("kept", F.pmod(F.xxhash64(F.lit("kept"), "__id"), F.lit(KEPT)) == 0)
    scratch = common.Scratch(spark, "toxicity")
    taken = scratch.keep(taken, "labels")
    if taken.count() <= 2 * most_rows:  # a few bytes each, so that texts stay where they are
        taken = F.broadcast(taken)
    rows = docs.join(taken, F.col("doc_id") == F.col("__id")).select(F.col("__id").alias("id"), "shard", "kept", terms(common.text_of()).alias("slots"), "toxic")
    rows = scratch.keep(rows, "rows")
    found = train(rows.where("not kept"), rows.where("kept"), positive, scratch)
    scratch.drop()
    return found


def score(docs: DataFrame, machine: Machine) -> DataFrame:
    """(doc_id, score) of every row."""
    sent = docs.sparkSession.sparkContext.broadcast(machine.pack())  # of fixed size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Machine.unpack(sent.value)
        for batch in batches:
            found = []
            for k in range(0, len(batch), 256):
                part = batch.slice(k, 256)
                slots, _, n = lists(part.column("slots"))
                found.append(sigmoid(own.raw(*own.own(slots, n))[0]))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(np.concatenate(found) if found else np.array([], float))], ["doc_id", "score"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), terms(common.text_of()).alias("slots"))
    return rows.mapInArrow(run, "doc_id long, score double")


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))
    out = score(docs, fit(docs, labels.where(~held_out)))
    return out.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
