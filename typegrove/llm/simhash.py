"""SimHash near-dedup by a segment-popcount embedding and a grid join.

A 64-bit fingerprint is embedded as the bit counts of its 32 two-bit segments. One flipped bit moves one count by one,
so the Manhattan distance of two embeddings never exceeds the Hamming distance. The embedding is held in unary (0, 1, 2
as 00, 01, 11), where the Manhattan distance is the number of differing bits.

The 32 coordinates are cut into ``groups``. Vectors within distance 3 agree on all but three groups at most, so a grid
for each choice of the ``groups`` - 3 others, its cells the values of those coordinates, has every pair to be linked in
one cell of at least one grid: nothing is missed. More fingerprints take more groups, so cells stay small. Within a cell
Manhattan distance at most 3 filters, then the fingerprints are compared exactly.

Equal fingerprints are one point from the start. A cell links its points by a spanning forest found by search, not by
all its pairs, so a dense group of near copies gives as many links as points. A cell of more than ``block`` points is
dealt in pairs of blocks to many tasks, by the same comparison.

Defined results: a null or wordless text has fingerprint 0 and is linked as any other; rows without doc_id are left out
of the links and form a component of their own (null); rows of one doc_id are one document and are all returned; a very
long text is hashed in pieces that share two words; other columns are not looked at, and pass through
``keep_representatives`` as they are; no rows give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .components import components

MOST_BITS = 3
#: Bytes of a text that are cut into words at a time.
PIECE = 1 << 22
SPACES = b" \t\n\x0b\x0c\r"


def _word_lists(text: bytes) -> Iterator[list[bytes]]:
    """Words in pieces of bounded size, each piece led by the last two words of the one before."""
    lead: list[bytes] = []
    at = 0
    while at < len(text):
        end = min(len(text), at + PIECE)
        if end < len(text):
            cut = max(text.rfind(s, at, end) for s in (b" ", b"\t", b"\n", b"\x0b", b"\x0c", b"\r"))
            if cut < 0:  # one word longer than a piece: go on to its end
                ends = [e for e in (text.find(s, end) for s in (b" ", b"\t", b"\n", b"\x0b", b"\x0c", b"\r")) if e >= 0]
                cut = min(ends, default=len(text) - 1)
            end = cut + 1
        words = lead + text[at:end].split()
        yield words
        lead, at = words[-2:], end


def fingerprint(text: str | None) -> int:
    """The unsigned 64-bit fingerprint of a text's 3-word shingles."""
    raw = (text or "").encode().lower()  # of bytes: A-Z only; split() takes exactly the six ASCII spaces
    counts, total = np.zeros(64, np.int64), 0
    words: list[bytes] = []
    for words in _word_lists(raw):
        n = len(words) - 2
        if n < 1:
            continue
        hashes = np.fromiter((xxhash.xxh64_intdigest(s, 42) for s in map(b" ".join, zip(words, words[1:], words[2:]))), np.uint64, n)
        for k in range(0, n, 1 << 14):
            part = hashes[k : k + (1 << 14)].astype("<u8").view(np.uint8).reshape(-1, 8)
            counts += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        total += n
    if not total and words:
        return xxhash.xxh64_intdigest(b" ".join(words), 42)
    return int(sum(1 << int(i) for i in np.flatnonzero(2 * counts > total)))


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        found = np.array([fingerprint(t.as_py()) for t in b.column("text")], np.uint64)
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(found.view(np.int64))], ["doc_id", "fp"])


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id long, fp long): the fingerprint's bits as a signed long."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_fingerprints, "doc_id long, fp long")


def embed(fp: Column) -> Column:
    """The bit counts of the two-bit segments, in unary."""
    odd = F.lit(0x5555555555555555)
    high = F.shiftrightunsigned(fp, 1)
    return fp.bitwiseOR(high).bitwiseAND(odd).bitwiseOR(F.shiftleft(fp.bitwiseAND(high).bitwiseAND(odd), 1))


def groups_for(points: int) -> int:
    """Groups of coordinates: cells of a few points on average for fingerprints spread at random. The links found are the
    same for any number from four up: two vectors at distance 3 differ in three groups at most, and so agree on all
    coordinates of one grid at least."""
    return 5 if points < 1_000_000 else 6 if points < 30_000_000 else 7 if points < 300_000_000 else 8


def grid_masks(groups: int) -> list[int]:
    """For each grid the bits of the embedding that make a cell, as signed longs."""
    cuts = [round(i * 32 / groups) for i in range(groups + 1)]
    part = [sum(3 << (2 * s) for s in range(a, b)) for a, b in zip(cuts, cuts[1:])]
    masks = [sum(part[g] for g in own) for own in combinations(range(groups), groups - MOST_BITS)]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def unary(fp: np.ndarray) -> np.ndarray:
    odd, high = np.uint64(0x5555555555555555), fp >> np.uint64(1)
    return ((fp | high) & odd) | ((fp & high & odd) << np.uint64(1))


def _near(one: np.ndarray | np.uint64, one_e, many: np.ndarray, many_e: np.ndarray) -> np.ndarray:
    """Manhattan distance first, then the exact bits."""
    near = np.bitwise_count(one_e ^ many_e) <= MOST_BITS
    near[near] = np.bitwise_count((one if np.isscalar(one) or one.ndim == 0 else one[near]) ^ many[near]) <= MOST_BITS
    return near


def forest(fp: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Links that join what is connected among these points: a search from each point over those not reached yet."""
    left, a, b = fp, [], []
    left_e = unary(left)
    while len(left) > 1:
        todo, left, left_e = [left[0]], left[1:], left_e[1:]
        while todo and len(left):
            x = todo.pop()
            hit = _near(x, unary(np.array([x]))[0], left, left_e)
            if hit.any():
                found = left[hit]
                a.append(np.full(len(found), x))
                b.append(found)
                todo.extend(found)
                left, left_e = left[~hit], left_e[~hit]
    return a, b


def _links_of_sorted(keys: list[np.ndarray], fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links within runs of equal keys. Runs of two to eight points are compared all at once, longer ones by search."""
    new = np.ones(len(fp), bool)
    new[1:] = np.logical_or.reduce([k[1:] != k[:-1] for k in keys])
    starts = np.flatnonzero(new)
    lengths = np.diff(np.append(starts, len(fp)))
    run, e = np.repeat(np.arange(len(starts)), lengths), unary(fp)
    short = np.repeat((lengths > 1) & (lengths <= 8), lengths)
    a, b = [], []
    for d in range(1, 8):
        i = np.flatnonzero(short[:-d] & (run[d:] == run[:-d])) if len(fp) > d else np.array([], int)
        if not len(i):
            break
        i = i[_near(fp[i], e[i], fp[i + d], e[i + d])]
        a.append(fp[i])
        b.append(fp[i + d])
    for k in np.flatnonzero(lengths > 8):
        x, y = forest(fp[starts[k] : starts[k] + lengths[k]])
        a += x
        b += y
    none = [np.array([], np.uint64)]
    return np.concatenate(a or none), np.concatenate(b or none)


def _cell_links(keys: list[str], block: int | None):
    """For mapInArrow over rows sorted by ``keys``: rows (a, b) are links; with ``block``, rows of longer cells come back whole, b null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = [np.array([], np.int64)] * (len(keys) + 1)
        over = None  # the key of a cell that is too long, while its rows come

        def out(a, b, cell=None):
            n = len(a)
            cols = [pa.array(np.asarray(a).view(np.int64)), pa.nulls(n, pa.int64()) if b is None else pa.array(np.asarray(b).view(np.int64))]
            cols += [pa.nulls(n, pa.int64()) if cell is None else pa.array(np.full(n, c, np.int64)) for c in (cell or [None] * 2)]
            return pa.RecordBatch.from_arrays(cols, ["a", "b", "g", "cell"])

        for batch in batches:
            rows = [np.concatenate([h, batch.column(c).to_numpy(zero_copy_only=False)]) for h, c in zip(held, [*keys, "fp"])]
            if not len(rows[0]):
                continue
            while over is not None and len(rows[0]):
                same = np.logical_and.reduce([r == o for r, o in zip(rows, over)])
                n = len(same) if same.all() else int(np.argmin(same))
                if n:
                    yield out(rows[-1][:n], None, over)
                rows = [r[n:] for r in rows]
                over = over if not len(rows[0]) else None
            if not len(rows[0]):
                held = rows
                continue
            last = np.logical_and.reduce([r == r[-1] for r in rows[:-1]])
            cut = len(last) - int(np.argmin(last[::-1])) if not last.all() else 0  # the last cell may go on
            done, held = [r[:cut] for r in rows], [r[cut:] for r in rows]
            if cut:
                yield from finish(done, out)
            if block and len(held[0]) > block:
                over = [h[0] for h in held[:-1]]
                yield out(held[-1], None, over)
                held = [h[:0] for h in held]
        if len(held[0]):
            yield from finish(held, out)

    def finish(rows, out):
        if block:
            new = np.ones(len(rows[0]), bool)
            new[1:] = np.logical_or.reduce([k[1:] != k[:-1] for k in rows[:-1]])
            starts = np.flatnonzero(new)
            lengths = np.diff(np.append(starts, len(new)))
            for k in np.flatnonzero(lengths > block):
                at = slice(starts[k], starts[k] + lengths[k])
                yield out(rows[-1][at], None, [r[starts[k]] for r in rows[:-1]])
            small = np.repeat(lengths <= block, lengths)
            rows = [r[small] for r in rows]
            if not len(rows[0]):
                return
        a, b = _links_of_sorted(rows[:-1], rows[-1].view(np.uint64))
        if len(a):
            yield out(a, b)

    return run


def links(points: DataFrame, count: int, block: int = 4096) -> DataFrame:
    """(a, b): links that connect just what pairs of fingerprints at ``MOST_BITS`` or fewer bits connect. points: fp, distinct."""
    scratch = common.Scratch(points.sparkSession, "grid")
    masks = grid_masks(groups_for(count))
    cells = F.array(*[F.struct(F.lit(i).cast("long").alias("g"), F.col("e").bitwiseAND(F.lit(m)).alias("cell")) for i, m in enumerate(masks)])
    dealt = points.select("fp", embed(F.col("fp")).alias("e")).select("fp", F.explode(cells).alias("c")).select("c.g", "c.cell", "fp")
    dealt = dealt.repartition("g", "cell").sortWithinPartitions("g", "cell", "fp")
    found = scratch.keep(dealt.mapInArrow(_cell_links(["g", "cell"], block), "a long, b long, g long, cell long"), "links")
    near = found.where("b is not null").select("a", "b").distinct()
    long = found.where("b is null").select(F.col("a").alias("fp"), "g", "cell")
    sizes = long.groupBy("g", "cell").agg(F.ceil(F.count(F.lit(1)) / F.lit(block / 2)).cast("int").alias("k"))
    long = long.join(sizes, ["g", "cell"]).withColumn("own", F.pmod(F.xxhash64("fp"), F.col("k")).cast("long"))
    pairs = F.transform(F.sequence(F.lit(0).cast("long"), F.col("k").cast("long") - 1), lambda j: F.struct(F.least(F.col("own"), j).alias("i"), F.greatest(F.col("own"), j).alias("j")))
    long = long.select("g", "cell", "fp", F.explode(pairs).alias("p")).select("g", "cell", "p.*", "fp")
    keys = ["g", "cell", "i", "j"]
    long = long.repartition(*keys).sortWithinPartitions(*keys, "fp")
    return near.unionByName(long.mapInArrow(_cell_links(keys, None), "a long, b long, g long, cell long").select("a", "b").distinct())


def near_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, fp, component_id), a row for each row of ``docs``; component_id is the least doc_id that links lead to."""
    scratch = common.Scratch(docs.sparkSession, "simhash")
    marked = scratch.keep(fingerprints(docs), "fingerprints")
    points = scratch.keep(marked.where("doc_id is not null").groupBy("fp").agg(F.min("doc_id").alias("least")), "points")
    roots = scratch.keep(components(links(points.select("fp"), points.count())), "roots")
    points = points.join(roots, points.fp == roots.node, "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    points = scratch.keep(points, "rooted")
    least = points.groupBy("root").agg(F.min("least").alias("component_id"))
    ids = points.join(least, "root").select(F.col("fp").alias("__fp"), "component_id")
    found = marked.join(ids, F.col("fp") == F.col("__fp"), "left").drop("__fp")
    return found.withColumn("component_id", F.when(F.col("doc_id").isNotNull(), F.col("component_id")))


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_representatives(docs: DataFrame) -> DataFrame:
    """``docs`` without the near copies of a document of smaller doc_id, and without repeated rows of one doc_id."""
    found = near_duplicates(docs.select("doc_id", "text"))
    (own,) = common.fresh(docs.columns, "__id")
    stay = found.where("component_id = doc_id").select(F.col("doc_id").alias(own)).distinct()
    kept = docs.where("doc_id is not null").join(stay, F.col("doc_id") == F.col(own), "left_semi").dropDuplicates(["doc_id"])
    return kept.unionByName(docs.where("doc_id is null"))
