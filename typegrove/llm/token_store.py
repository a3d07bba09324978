"""Content-addressed store of token ids.

A rolling (gear) hash over the last 32 ids cuts each document's id stream into chunks, so equal passages give equal
chunks wherever they stand. A chunk's address is its 128-bit BLAKE2b digest. The store has three tables:

- ``chunks`` (hash, ids): every different chunk once: a byte for the width of an id, 2 or 4, then the ids, little-endian;
- ``recipes`` (doc_id, start, n_tokens, root, chunks[hash, n]) in ascending doc_id order: how to put documents together;
  ``root`` is the Merkle root of the document's chunk hashes;
- ``manifest`` (level, node, docs, first_id, last_id, root): a Merkle tree over the documents' roots in order, ``FAN``
  children a node; level 0 stands over documents, the one node of the last level over all.

Reading verifies every stored chunk against its address, and every document's root and length against its chunk list; a
chunk that is not there is an error. ``verify_manifest`` compares every node with its children, down to the documents.
Chunks move through one shuffle by address; whole documents move only if they are asked for.

Documents are ordered by ranges of doc_id, and of the hash of the text for rows without one, whose number grows with the
documents, one task a range.

Defined results: a null text is empty and has the end id alone; rows without doc_id come first; rows that repeat a doc_id
are documents of their own, in the order of a hash of their text; a very long text has a recipe as long as its list of chunks (about one
for 500 ids); other columns are not looked at; no rows make an empty store.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common, tokens

END_ID = 2
#: A chunk ends where the hash's low bits are zero (one place in 512), but has 64 ids at least and 4096 at most.
MASK, LEAST, MOST = np.uint32(0x1FF << 20), 64, 4096
#: Children of a node of the manifest.
FAN = 256
INCOMING = "doc_id long, tie long, n_tokens long, root binary, pos int, after long, n int, hash binary, ids binary"


def gear(ids: np.ndarray) -> np.ndarray:
    """The rolling hash at every id: mixes of the last 32 ids, each shifted by its distance."""
    h = (ids.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    h = (h >> np.uint64(32)).astype(np.uint32)
    for k in (1, 2, 4, 8, 16):
        h[k:] = h[k:] + (h[:-k] << np.uint32(k))
    return h


def cuts(ids: np.ndarray) -> list[int]:
    """Ends of the chunks."""
    marks = np.flatnonzero((gear(ids) & MASK) == 0) + 1
    out, start = [], 0
    for m in [*marks.tolist(), len(ids)]:
        while m - start > MOST:
            start += MOST
            out.append(start)
        if m - start >= LEAST or m == len(ids):
            if m > start:
                out.append(m)
            start = m
    return out


def stored(ids: np.ndarray, ends: list[int]) -> list[bytes]:
    """A document's chunks in the store's form: two bytes an id where that is enough for all its ids."""
    narrow = ids.max(initial=0) < 1 << 16
    width, head, raw = (2, b"\x02", ids.astype("<u2").tobytes()) if narrow else (4, b"\x04", ids.tobytes())
    return [head + raw[width * a : width * b] for a, b in zip([0, *ends], ends)]


def plain(data: bytes) -> bytes:
    """The store's form as little-endian unsigned 32-bit ids again."""
    return data[1:] if data[0] == 4 else np.frombuffer(data, "<u2", offset=1).astype("<u4").tobytes()


def digest(data: bytes) -> bytes:
    return hashlib.blake2b(data, digest_size=16).digest()


def merkle(leaves: list[bytes]) -> bytes:
    """Root of the binary hash tree; an odd last node moves up as it is."""
    level = leaves or [digest(b"")]
    while len(level) > 1:
        level = [digest(b"\x01" + b"".join(level[i : i + 2])) if i + 1 < len(level) else level[i] for i in range(0, len(level), 2)]
    return level[0]


def _chunker(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("doc_id", pa.int64()), ("tie", pa.int64()), ("n_tokens", pa.int64()), ("root", pa.binary()), ("pos", pa.int32()), ("after", pa.int64()), ("n", pa.int32()), ("hash", pa.binary()), ("ids", pa.binary())])
        for batch in batches:
            doc_ids, ties = batch.column("doc_id").to_pylist(), batch.column("tie").to_pylist()
            for at, found in tokens.encoded(batch.column("text"), path, 3 << 22):
                rows: list[list] = [[] for _ in schema]
                for i, raw in enumerate(found, at):
                    raw += END_ID.to_bytes(4, "little")
                    ids = np.frombuffer(raw, "<u4")
                    ends = cuts(ids)
                    starts, parts = [0, *ends[:-1]], stored(ids, ends)
                    hashes = [digest(p) for p in parts]
                    n, root = len(raw) // 4, merkle(hashes)
                    for k, (a, end, part, h) in enumerate(zip(starts, ends, parts, hashes)):
                        for col, v in zip(rows, (doc_ids[i], ties[i], n, root, k, n - end, end - a, h, part)):
                            col.append(v)
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(rows, schema)], schema=schema)

    return run


class TokenStore:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def chunks(self) -> DataFrame:
        return self.spark.read.schema("hash binary, ids binary").parquet(f"{self.path}/chunks")

    def recipes(self) -> DataFrame:
        return self.spark.read.schema("doc_id long, tie long, number long, start long, n_tokens long, root binary, chunks array<struct<pos:int,after:bigint,n:int,hash:binary>>").parquet(f"{self.path}/recipes")

    def manifest(self) -> DataFrame:
        return self.spark.read.schema("level int, node long, docs long, first_id long, last_id long, root binary").parquet(f"{self.path}/manifest")


def write(docs: DataFrame, path: str, tokenizer: str | None = None, docs_a_range: int = 100_000) -> TokenStore:
    """Encodes ``docs`` (doc_id, text) and writes the three tables under ``path``, a folder that all executors share."""
    spark = docs.sparkSession
    scratch = common.Scratch(spark, "incoming")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(common.text_of()).alias("tie"), "text")
    came = scratch.keep(rows.mapInArrow(_chunker(tokenizer or tokens.tokenizer_path()), INCOMING), "chunks", "zstd")
    unique = came.select("hash", "ids").dropDuplicates(["hash"])
    unique.sortWithinPartitions("hash").write.option("compression", "zstd").parquet(f"{path}/chunks")
    light = came.drop("ids")
    per = light.where("pos = 0").select("doc_id", "n_tokens", F.lit(1).alias("docs"))
    lost = per.where("doc_id is null").count()
    bounds = common.range_bounds(per, "doc_id", max(common.buckets_for(per.count(), docs_a_range), common.parallelism(spark)))
    first = common.range_bounds(light.where("pos = 0 and doc_id is null"), "tie", common.buckets_for(lost, docs_a_range)) if lost else []
    here = F.when(F.col("doc_id").isNull(), common.bucket_of(F.col("tie"), first)).otherwise(common.bucket_of(F.col("doc_id"), bounds) + len(first) + 1).alias("range")
    ranges = len(first) + 1 + len(bounds) + 1
    per = light.where("pos = 0").select("doc_id", "tie", "n_tokens", F.lit(1).alias("docs"))
    tokens_before, docs_before = common.sums_before(per.withColumn("range", here), "range", ranges, "n_tokens", "docs")
    # A document's chunk list is as long as its own text. Equal rows (same id and text) are one row with a count until they
    # are numbered: what each task sends of them is one list.
    listed = light.groupBy("doc_id", "tie", "n_tokens", "root").agg(F.array_sort(F.collect_set(F.struct("pos", "after", "n", "hash"))).alias("chunks"), F.count_if(F.col("pos") == 0).alias("copies"))
    listed = listed.withColumn("range", here).repartitionById(ranges, "range")
    before = Window.partitionBy("range").orderBy(F.col("doc_id").asc_nulls_first(), "tie", "root").rowsBetween(Window.unboundedPreceding, -1)
    listed = listed.withColumns({"start": tokens_before + F.coalesce(F.sum(F.col("n_tokens") * F.col("copies")).over(before), F.lit(0)), "number": docs_before + F.coalesce(F.sum("copies").over(before), F.lit(0))})
    listed = listed.withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1)))
    listed = listed.withColumns({"start": F.col("start") + F.col("copy") * F.col("n_tokens"), "number": F.col("number") + F.col("copy")})
    listed.select("doc_id", "tie", "number", "start", "n_tokens", "root", "chunks").write.option("compression", "zstd").parquet(f"{path}/recipes")
    scratch.drop()
    store = TokenStore(spark, path)
    leaves = store.recipes().select("number", "doc_id", "root")
    level, nodes = 0, leaves.count()
    parents(leaves).withColumn("level", F.lit(0)).write.parquet(f"{path}/manifest")
    while nodes > FAN:
        below = store.manifest().where(F.col("level") == level)
        level, nodes = level + 1, -(-nodes // FAN)
        _above(below).withColumn("level", F.lit(level)).write.mode("append").parquet(f"{path}/manifest")
    return store


def _node(children: DataFrame, *also: Column) -> DataFrame:
    """Nodes over at most FAN children each: children hold number and root; a node hashes its children's roots in order."""
    order = F.array_sort(F.collect_list(F.struct("number", F.hex("root").alias("root"))))
    per = children.groupBy(F.floor(F.col("number") / FAN).alias("node")).agg(*also, order.alias("all"))
    root = F.unhex(F.sha2(F.array_join(F.transform("all", lambda x: x["root"]), ","), 256))
    return per.withColumn("root", root).drop("all")


def parents(leaves: DataFrame) -> DataFrame:
    """(node, docs, first_id, last_id, root) over documents (number, doc_id, root)."""
    return _node(leaves, F.count(F.lit(1)).alias("docs"), F.min("doc_id").alias("first_id"), F.max("doc_id").alias("last_id"))


def _above(nodes: DataFrame) -> DataFrame:
    return _node(nodes.withColumnRenamed("node", "number"), F.sum("docs").alias("docs"), F.min("first_id").alias("first_id"), F.max("last_id").alias("last_id"))


def _check(hashes: list[bytes], ids: list[bytes]) -> None:
    bad = [h for h, x in zip(hashes, ids) if digest(x) != h]
    if bad:
        raise ValueError(f"chunk {bad[0].hex()} does not match its address")


def _checked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        hashes, ids = b.column("hash").to_pylist(), b.column("ids").to_pylist()
        _check(hashes, ids)
        ids = [plain(x) for x in ids]
        crc = np.array([zlib.crc32(x) for x in ids], np.int64)
        yield pa.RecordBatch.from_arrays([b.column("hash"), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(crc)], ["hash", "held", "crc"])


_POWERS: list[int] = []


def _mul(a: int | np.ndarray, b: int | np.ndarray) -> np.ndarray:
    """Product of polynomials over GF(2) modulo the CRC-32 polynomial, in its reflected form, for whole arrays."""
    a, b = np.broadcast_arrays(np.asarray(a, np.uint64), np.asarray(b, np.uint64))
    out, b = np.zeros(a.shape, np.uint64), b.copy()
    for k in range(31, -1, -1):
        out ^= np.where(a >> np.uint64(k) & np.uint64(1), b, np.uint64(0))
        b = (b >> np.uint64(1)) ^ np.where(b & np.uint64(1), np.uint64(0xEDB88320), np.uint64(0))
    return out


def shifted_crc(crc: np.ndarray, after: np.ndarray) -> np.ndarray:
    """What a part's CRC-32 adds (by exclusive or) to that of a whole in which ``after`` bytes follow the part."""
    if not _POWERS:
        _POWERS.append(int(_mul(np.uint64(1 << 30), np.uint64(1 << 31))))  # x^1
        for _ in range(66):
            _POWERS.append(int(_mul(_POWERS[-1], _POWERS[-1])))
    out, bits = crc.astype(np.uint64), after.astype(np.uint64) * np.uint64(8)
    for k in range(int(bits.max()).bit_length() if len(bits) else 0):
        on = (bits >> np.uint64(k) & np.uint64(1)).astype(bool)
        if on.any():
            out[on] = _mul(out[on], np.uint64(_POWERS[k]))
    return out


def _shares(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        share = shifted_crc(b.column("crc").to_numpy(), b.column("after").to_numpy() * 4).astype(np.int64)
        keep = ["doc_id", "start", "n_tokens"]
        yield pa.RecordBatch.from_arrays([*[b.column(c) for c in keep], pa.array(share)], [*keep, "share"])


def verify_manifest(store: TokenStore) -> DataFrame:
    """(level, node) of the nodes whose children do not give the manifest's root; none if all is well."""
    held = store.manifest()
    now = parents(store.recipes()).select(F.lit(0).alias("level"), "node", F.col("root").alias("now"))
    levels = [r["level"] for r in held.select("level").distinct().collect()]
    for level in range(1, max(levels, default=0) + 1):
        now = now.unionByName(_above(held.where(F.col("level") == level - 1)).select(F.lit(level).alias("level"), "node", F.col("root").alias("now")))
    return held.join(now, ["level", "node"], "full").where(~F.col("root").eqNullSafe(F.col("now"))).select("level", "node")


ASKED = "doc_id long, start long, n_tokens long, pos int, after long, n int, hash binary"


def _asked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Recipes as one row a chunk, each document's root and length compared with its chunk list."""
    for b in batches:
        chunks = b.column("chunks")
        ends = chunks.offsets.to_numpy().astype(np.int64)
        flat = chunks.values.slice(int(ends[0]), int(ends[-1] - ends[0]))
        ends = ends - ends[0]
        hashes, n, doc_ids = flat.field("hash").to_pylist(), flat.field("n").to_numpy(), b.column("doc_id").to_pylist()
        total = np.concatenate([[0], np.cumsum(n, dtype=np.int64)])
        for i, (root, tokens_) in enumerate(zip(b.column("root").to_pylist(), b.column("n_tokens").to_pylist())):
            if merkle(hashes[ends[i] : ends[i + 1]]) != root or total[ends[i + 1]] - total[ends[i]] != tokens_:
                raise ValueError(f"document {doc_ids[i]}: root or length does not match its chunk list")
        row = pa.array(np.repeat(np.arange(len(b)), np.diff(ends)))
        own = [b.column(c).take(row) for c in ("doc_id", "start", "n_tokens")]
        yield pa.RecordBatch.from_arrays([*own, *[flat.field(c) for c in ("pos", "after", "n", "hash")]], ["doc_id", "start", "n_tokens", "pos", "after", "n", "hash"])


def asked(store: TokenStore) -> DataFrame:
    return store.recipes().select("doc_id", "start", "n_tokens", "root", "chunks").mapInArrow(_asked, ASKED)


def _found(column: str) -> Column:
    """The looked-up column, an error where the store has no such chunk or one of another length."""
    wrong = F.raise_error(F.concat(F.lit("the store lacks chunk "), F.hex("hash"), F.lit(" of a recipe, or has it in another length")))
    return F.when(F.col("held") == F.col("n"), F.col(column)).otherwise(wrong)


def read_sums(store: TokenStore) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, from the ids in the files.

    Each stored chunk is read and checked once; documents get their chunks' checksums, combined by position, so no ids
    are moved again. A missing chunk, a wrong length or a root that does not match is an error.
    """
    held = store.chunks().mapInArrow(_checked, "hash binary, held long, crc long")
    met = asked(store).join(held, "hash", "left").withColumn("crc", _found("crc"))
    met = met.select("doc_id", "start", "n_tokens", "after", "crc").mapInArrow(_shares, "doc_id long, start long, n_tokens long, share long")
    return met.groupBy("doc_id", "start", "n_tokens").agg(F.bit_xor("share").alias("ids_crc32"))


def _plain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        hashes, ids = b.column("hash").to_pylist(), b.column("ids").to_pylist()
        _check(hashes, ids)
        ids = [plain(x) for x in ids]
        yield pa.RecordBatch.from_arrays([b.column("hash"), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(ids, pa.binary())], ["hash", "held", "ids"])


def read_documents(store: TokenStore) -> DataFrame:
    """(doc_id, start, ids binary): every document put together again from its chunks, little-endian unsigned 32-bit ids.

    Verifies as ``read_sums`` does.
    """
    met = asked(store).join(store.chunks().mapInArrow(_plain, "hash binary, held long, ids binary"), "hash", "left").withColumn("ids", _found("ids"))
    whole = F.array_sort(F.collect_list(F.struct("pos", F.hex("ids").alias("ids"))))
    return met.groupBy("doc_id", "start").agg(whole.alias("all")).select("doc_id", "start", F.unhex(F.array_join(F.transform("all", lambda x: x["ids"]), "")).alias("ids"))


def op4_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = common.Scratch(spark, "token-store")
    store = write(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), scratch.path("store"))
    if not verify_manifest(store).isEmpty():
        raise ValueError("the manifest does not match the recipes")
    return read_sums(store)
