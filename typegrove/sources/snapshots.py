"""Published snapshots that share content: blocks of records under their digests, a Merkle tree over them, numbered manifests.

The records of a snapshot are dealt to blocks by hash, about ``BLOCK`` a block, in a number that doubles as the model
grows. A block's digest is made of the sums of its records' SHA-256, so it does not depend on their order, each task adds up the
records that it has, and neither they nor their hashes are moved. Sums tell damage and change; they are no proof against someone who
makes up records in great number so that the sums agree. A block that the snapshot before has with the same digest is not
written: the list of blocks names the folder that holds it, however long ago it was written. Digests of 256 blocks make one of the next level up, until one is left
for each part; the snapshot's digest is made of those. A record's block follows from its id and the number of blocks of its part,
so the records of a folder lie in any order.

The first snapshot's records are written and its digests made from what was written. Later ones are held against the list of the one
before as they come, and only records of new blocks are written; these must have the digests that were found, else the model has
changed in between and there is no snapshot. A manifest
file, made only if absent, gives a snapshot its number: of two publishers one gets the next and the other the one after.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import Dataset
from ..shared import delete, names, put_if_absent, read_text
from .export import json_lines, size_problems

#: Records a block, about.
BLOCK, FAN = 1 << 12, 8
#: So many blocks at most are told to all executors (of 4 records in a thousand million, or of a snapshot that shares most of them).
TOLD = 1 << 20
LEAVES = "part string, bits int, block long, n long, digest string, folder string"
RECORDS = "part string, id string, value string"


def block_of(bits: dict[str, int]) -> Column:
    """A record's block: leading bits of its id's hash, as many as its part has (a part is a table of the model: six)."""
    own = reduce(lambda out, part: F.when(F.col("part") == part, F.lit(bits[part])).otherwise(out), bits, F.lit(0))
    return F.call_function("shiftrightunsigned", F.call_function("shiftrightunsigned", F.xxhash64("id"), F.lit(1)), F.lit(63) - own)


def bits_for(counts: dict[str, int], each: int) -> dict[str, int]:
    """The bits that parts of so many records need."""
    return {part: max(0, -(-n // each) - 1).bit_length() for part, n in counts.items()}


def counted(lines: DataFrame) -> dict[str, int]:
    return {r["part"]: r["n"] for r in lines.groupBy("part").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row a part


def summed(lines: DataFrame, bits: dict[str, int]) -> DataFrame:
    """(part, block, n, sums): of each block the number of its records and the sums of their SHA-256, as eight numbers of 32 bits.

    Partial aggregates of a row a block and task are all that is moved. Each 8 bytes become a number by a function that has an inverse.
    """
    hashed = lines.select("part", block_of(bits).alias("block"), F.unhex(F.sha2("value", 256)).alias("hash"))
    words = hashed.select("part", "block", *[F.xxhash64(F.substring("hash", 8 * k + 1, 8)).alias(f"w{k}") for k in range(4)])
    halves = [x for k in range(4) for x in (F.shiftrightunsigned(f"w{k}", 32), F.col(f"w{k}").bitwiseAND(F.lit(0xFFFFFFFF)))]
    out = words.groupBy("part", "block").agg(F.count(F.lit(1)).alias("n"), *[F.sum(x).alias(f"s{k}") for k, x in enumerate(halves)])
    return out.select("part", "block", "n", F.array(*[f"s{k}" for k in range(8)]).alias("sums"))


def leaves_of(sums: DataFrame, at: dict[str, int], bits: dict[str, int]) -> DataFrame:
    """(part, bits, block, n, digest) of blocks that were summed at ``at`` bits, not fewer than ``bits``: sums of sums."""
    each = lambda of: reduce(lambda out, part: F.when(F.col("part") == part, F.lit(of[part])).otherwise(out), of, F.lit(0))
    rows = sums.withColumn("block", F.call_function("shiftright", F.col("block"), each(at) - each(bits)))
    rows = rows.groupBy("part", "block").agg(F.sum("n").alias("n"), *[F.sum(F.col("sums")[k]).alias(f"s{k}") for k in range(8)])
    digest = F.sha2(F.concat_ws(",", "n", *[f"s{k}" for k in range(8)]), 256)
    return rows.select("part", each(bits).cast("int").alias("bits"), "block", "n", digest.alias("digest"))


def roots(leaves: DataFrame) -> DataFrame:
    """(part, n, digest): the tree over each part's blocks, 256 children a node. A level a round, in one plan."""
    depth = leaves.agg(F.max("bits")).first()[0] or 0
    level = leaves.select("part", "block", "n", "digest")
    for _ in range(-(-depth // FAN) or 1):
        level = level.groupBy("part", F.shiftright("block", FAN).alias("block")).agg(
            F.sum("n").alias("n"), F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block", "digest"))), lambda x: x["digest"]), ","), 256).alias("digest")
        )
    return level.select("part", "n", "digest")


def content_digest(leaves: DataFrame) -> str:
    parts = sorted((r["part"], r["digest"]) for r in roots(leaves).collect())  # a row a part
    return hashlib.sha256(";".join(f"{p}={d}" for p, d in parts).encode()).hexdigest()


class Snapshots:
    """The snapshots of one publication, under a folder that all executors share."""

    def __init__(self, spark: SparkSession, path: str, block: int = BLOCK):
        self.spark, self.path, self.block = spark, path.rstrip("/"), block

    def sequences(self) -> list[int]:
        return sorted(int(x[:12]) for x in names(self.spark, f"{self.path}/manifest") if x.endswith(".json") and x[:12].isdigit())

    def entry(self, sequence: int | None = None) -> dict:
        """A snapshot's manifest; of the newest if no number is given."""
        every = self.sequences()
        if not every or sequence not in (None, *every):
            raise ValueError(f"there is no snapshot {sequence or ''}")
        return json.loads(read_text(self.spark, f"{self.path}/manifest/{sequence or every[-1]:012d}.json"))

    def manifest(self) -> DataFrame:
        """(sequence, source_revision, digest, folder): a row a snapshot."""
        schema = "sequence long, source_revision long, digest string, folder string"
        return self.spark.read.schema(schema).json(f"{self.path}/manifest") if self.sequences() else self.spark.createDataFrame([], schema)

    def leaves(self, sequence: int | None = None) -> DataFrame:
        return self._leaves(self.entry(sequence)["folder"])

    def _leaves(self, folder: str) -> DataFrame:
        return self.spark.read.schema(LEAVES).parquet(f"{self.path}/{folder}/leaves")

    def preview(self, dataset: Dataset) -> str:
        """The digest that a snapshot of the dataset would have."""
        lines = json_lines(dataset)
        bits = bits_for(counted(lines), self.block)
        return content_digest(leaves_of(summed(lines, bits), bits, bits))

    def publish(self, dataset: Dataset, source_revision: int, expected_digest: str | None = None) -> tuple[int, str]:
        """Writes the next snapshot, if the dataset still has the digest that was previewed. Returns (sequence, digest)."""
        if not size_problems(dataset).isEmpty():
            raise ValueError("the snapshot is over its limits")
        return self.add(json_lines(dataset), source_revision, expected_digest)

    def add(self, lines: DataFrame, source_revision: int, expected_digest: str | None = None) -> tuple[int, str]:
        folder, lines = f"data/{uuid.uuid4().hex}", lines.select("part", "id", "value")
        own = f"{self.path}/{folder}"
        try:
            digest = self._write(lines, folder, expected_digest)
        except Exception:
            delete(self.spark, own)
            raise
        sequence = (self.sequences() or [0])[-1] + 1
        line = lambda n: json.dumps({"sequence": n, "source_revision": source_revision, "digest": digest, "folder": folder}) + "\n"
        while not put_if_absent(self.spark, f"{self.path}/manifest/{sequence:012d}.json", line(sequence)):
            sequence += 1
        return sequence, digest

    def _write(self, lines: DataFrame, folder: str, expected_digest: str | None) -> str:
        """A snapshot's list of blocks, and the records of those that the one before does not have; returns its digest."""
        own, first = f"{self.path}/{folder}", not self.sequences()
        if first:
            self._put(lines, folder)
            lines = self.spark.read.schema(RECORDS).parquet(f"{own}/blocks")
            at = bits_for(counted(lines), self.block)
        else:
            held = self.leaves().select("part", "bits", "block", "digest", "folder")
            at = {r["part"]: r["bits"] for r in held.select("part", "bits").distinct().collect()}  # a row a part
        while True:
            summed(lines, at).write.mode("overwrite").parquet(f"{own}/found")
            sums = self.spark.read.parquet(f"{own}/found")
            need = bits_for({r["part"]: r["n"] for r in sums.groupBy("part").agg(F.sum("n").alias("n")).collect()}, self.block)
            if all(at.get(p, 0) >= b for p, b in need.items()):
                break
            at = need  # the model has grown past twice its size: summed again by smaller blocks
        leaves_of(sums, at, need).write.parquet(f"{own}/digests")
        found = self.spark.read.parquet(f"{own}/digests")
        digest = content_digest(found)
        if expected_digest is not None and digest != expected_digest:
            raise ValueError("the model has changed since the preview")
        known = found.withColumn("folder", F.lit(folder)) if first else found.join(held, ["part", "bits", "block", "digest"], "left").withColumn("folder", F.coalesce("folder", F.lit(folder)))
        known.select(*[x.split()[0] for x in LEAVES.split(", ")]).write.parquet(f"{own}/leaves")
        new = self._leaves(folder).where(F.col("folder") == folder).select("part", "bits", "block", "n", "digest")
        if not first and not new.isEmpty():
            self._put(_of_blocks(lines.withColumn("block", block_of(need)), new.select("part", "block"), "left_semi"), folder)
            written = leaves_of(summed(self.spark.read.schema(RECORDS).parquet(f"{own}/blocks"), need), need, need)
            if not new.exceptAll(written).isEmpty() or not written.exceptAll(new).isEmpty():
                raise ValueError("the model has changed while it was written")
        for part in ("found", "digests"):
            delete(self.spark, f"{own}/{part}")
        return digest

    def _put(self, lines: DataFrame, folder: str) -> None:
        """Texts that differ in every row: no dictionary of them is tried."""
        plain = {"parquet.enable.dictionary#value": "false", "parquet.enable.dictionary#id": "false", "compression": "zstd"}
        lines.select("part", "id", "value").write.options(**plain).parquet(f"{self.path}/{folder}/blocks")

    def _lying(self, wanted: DataFrame) -> DataFrame:
        """(part, id, value, folder, bits, block): the records of blocks in ``wanted`` (part, bits, block, folder), from the folders they lie in."""
        bits: dict[str, dict[str, int]] = {}
        for r in wanted.select("folder", "part", "bits").distinct().collect():  # a row a part, for each snapshot that blocks are shared with
            bits.setdefault(r["folder"], {})[r["part"]] = r["bits"]
        out = self.spark.createDataFrame([], f"{RECORDS}, folder string, bits int, block long")
        for folder, of in bits.items():
            there = self._leaves(folder).where(F.col("folder") == folder)
            here = self.spark.read.schema(RECORDS).parquet(f"{self.path}/{folder}/blocks")
            width = reduce(lambda x, part: F.when(F.col("part") == part, F.lit(of[part])).otherwise(x), of, F.lit(None).cast("int"))
            here = here.withColumns({"folder": F.lit(folder), "bits": width, "block": block_of(of)})
            rest = there.join(wanted.where(F.col("folder") == folder), ["part", "block"], "left_anti").select("part", "block")
            out = out.unionByName(here if rest.isEmpty() else _of_blocks(here, rest, "left_anti"))
        return out

    def read(self, sequence: int | None = None) -> DataFrame:
        """(part, id, value) of a snapshot, read from the folders that its blocks lie in."""
        return self._lying(self.leaves(sequence)).select("part", "id", "value", "bits", "block")

    def _damaged(self, leaves: DataFrame) -> DataFrame:
        """Blocks in ``leaves``, of one snapshot or several, whose records do not have the digest that is listed; each is read once."""
        blocks = leaves.select("part", "bits", "block", "digest", "folder").distinct()
        now = None
        for r in blocks.select("folder").distinct().collect():  # one a snapshot that blocks are shared with
            own = blocks.where(F.col("folder") == r["folder"])
            bits = {r["part"]: r["bits"] for r in own.select("part", "bits").distinct().collect()}
            found = leaves_of(summed(self._lying(own), bits), bits, bits).select("part", "bits", "block", F.col("digest").alias("__now"), F.lit(r["folder"]).alias("folder"))
            now = found if now is None else now.unionByName(found)
        return blocks if now is None else blocks.join(now, ["part", "bits", "block", "folder"], "left").where(~F.col("digest").eqNullSafe(F.col("__now")))

    def damaged(self, sequence: int | None = None) -> DataFrame:
        """(part, block): blocks whose records do not have the digest that is listed, or are not there."""
        return self._damaged(self.leaves(sequence)).select("part", "block")

    def verify(self, sequence: int | None = None) -> bool:
        """Whether a snapshot's blocks are whole and its digest is that of its blocks."""
        n = self.entry(sequence)["sequence"]
        return self.verify_all([n])[n]

    def verify_all(self, sequences: Iterable[int]) -> dict[int, bool]:
        """``verify`` of several snapshots; the blocks that they share are read once."""
        leaves = {n: self.leaves(n) for n in sequences}
        path = f"{self.path}/checks/{uuid.uuid4().hex}"
        self._damaged(reduce(DataFrame.unionByName, leaves.values())).write.parquet(path)
        bad = self.spark.read.parquet(path)
        out = {}
        for n, own in leaves.items():
            hurt = not bad.isEmpty() and not own.join(bad, ["part", "bits", "block", "digest", "folder"], "left_semi").isEmpty()
            out[n] = not hurt and content_digest(own) == self.entry(n)["digest"]
        delete(self.spark, path)
        return out


def _of_blocks(rows: DataFrame, blocks: DataFrame, how: str) -> DataFrame:
    """Rows (part, block) of some blocks, or of all others. Blocks are one for thousands of records, so rows stay where they lie."""
    few = blocks.limit(TOLD + 1).count() <= TOLD
    return rows.join(F.broadcast(blocks) if few else blocks, ["part", "block"], how)
