"""The filter audit, vector codes and sharding against plain Python, on nulls, ties, repeats, long texts and clashing names."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict
from itertools import permutations

import numpy as np
import pytest
from pyspark.sql import functions as F

from typegrove.llm import filter_audit, sharding, vector_codes

# ---- filter audit

AUDIT = "doc_id long, text string, lang string, part string, A int, counts string, n long, subset int, first boolean"


def fails(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    out = "A" * (len(words) < 200) + "B" * (100 * len(set(words)) < 50 * len(words))
    return out + "C" * (100 * len(re.findall("[A-Z]", text)) > 3 * len(text)) + "D" * bool(re.search(r"[#$%&*|]", text))


def audit_by_hand(rows, labels):
    """rows: (doc_id, text, lang); labels: doc_id -> (good, toxic)."""
    first, per = {}, defaultdict(list)
    for i, text, _ in rows:
        if i is not None:
            first[text or ""] = min(i, first.get(text or "", i))
    for i, text, lang in rows:
        text = text or ""
        per[lang or ""].append((fails(text) + "E" * (i is not None and i > first[text]), *labels.get(i, (False, False))))
    out = set()
    for part, docs in per.items():
        removed_by, steps = Counter(), []
        for order in permutations("ABCDE"):
            left = docs
            for step, f in enumerate(order, 1):
                gone = [d for d in left if f in d[0]]
                left = [d for d in left if f not in d[0]]
                removed_by[f] += len(gone)
                failing = sum(f in d[0] for d in docs)
                steps.append(("".join(order), step, f, len(left), len(gone), failing - len(gone), sum(d[0] == f for d in docs), sum(d[1] for d in gone), sum(d[2] for d in gone)))
        out |= {(part, o, k, *rest, removed_by[f]) for o, k, f, *rest in steps}
    return out


COLUMNS = ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]


def audit_rows():
    rng = random.Random(5)
    texts = [None, "", "  \n", "A B", "word " * 300, " ".join(f"w{k}" for k in range(250)), " ".join(f"w{k}" for k in range(199)), "x" * 300_000, "# " + " ".join(f"v{k}" for k in range(220)), "É" * 50]
    texts += [" ".join(rng.choice(["Ab", "c|", *[f"q{k}" for k in range(400)]]) for _ in range(rng.choice([150, 230, 400]))) for _ in range(25)]
    rows = [(k, t, rng.choice(["en", "de", None, ""])) for k, t in enumerate(texts)]
    rows += [(100 + k, texts[k % 7], "en") for k in range(30)]  # copies over parts
    rows += [(None, texts[5], "en"), (None, texts[5], "en"), (4, texts[5], "fr"), (3, texts[3], "en"), (3, texts[3], "en")]  # repeated and missing ids
    return rows


def test_filter_audit(spark):
    rows = audit_rows()
    docs = spark.createDataFrame([(i, t, g, "p", 1, "c", 2, 3, True) for i, t, g in rows], AUDIT).repartition(3)
    labels = [(4, 1, 0), (4, None, 1), (5, 1, 1), (8, 0, 1), (103, 1, None), (None, 1, 1), (999, 1, 1)]
    marks = {4: (True, True), 5: (True, True), 8: (False, True), 103: (True, False)}
    got = filter_audit.audit(filter_audit.failures(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))).select(*COLUMNS).collect()
    assert len(got) == len({r["part"] for r in got}) * 600 == len({r[2] or "" for r in rows}) * 600
    assert set(map(tuple, got)) == audit_by_hand(rows, marks)


def test_filter_audit_of_other_filters_and_no_rows(spark):
    schema = "part string, X boolean, Y boolean, good boolean, toxic boolean"
    some = spark.createDataFrame([("a", True, True, True, False), ("a", True, False, False, True), ("a", False, False, False, False)], schema)
    got = {(r["filter_order"], r["step"]): r for r in filter_audit.audit(some, "XY").collect()}
    assert len(got) == 4
    assert (got["YX", 2]["kept"], got["YX", 2]["removed"], got["YX", 2]["redundant"], got["YX", 2]["unique_fails"], got["YX", 2]["shapley"]) == (1, 1, 1, 1, 3)
    assert (got["XY", 1]["good_lost"], got["XY", 1]["toxic_lost"], got["XY", 2]["removed"]) == (1, 1, 0)
    assert filter_audit.audit(spark.createDataFrame([], schema), "XY").collect() == []
    with pytest.raises(ValueError):
        filter_audit.audit(some, "XX")
    docs = spark.createDataFrame([], AUDIT)
    assert filter_audit.audit(filter_audit.failures(docs, spark.createDataFrame([], "doc_id long, quality int, toxic int"))).collect() == []


# ---- vector codes

VECTORS = "vec_id long, embedding array<float>, label int, v int, code string, error double, kind int"


def codes_by_hand(rows, parts=8, entries=16, rounds=6):
    """rows: (vec_id, vector, label), in any order. Codes by full search, in Python's whole numbers."""
    kept = [(i, [math.floor(4096 * x) for x in map(float, v)], g) for i, v, g in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    width = -(-max(len(v) for _, v, _ in kept) // parts)
    kept = [(i, v + [0] * (parts * width - len(v)), g, v) for i, v, g in kept]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[3]))
    cut = [[v[p * width : (p + 1) * width] for p in range(parts)] for _, v, _, _ in kept]
    books = [[c[p] for c in cut[:entries]] for p in range(parts)]

    def find(x, book):
        return min((sum((a - b) ** 2 for a, b in zip(x, c)), k) for k, c in enumerate(book))

    for _ in range(rounds):
        for p in range(parts):
            own = defaultdict(list)
            for c in cut:
                own[find(c[p], books[p])[1]].append(c[p])
            books[p] = [[sum(x) // len(own[k]) for x in zip(*own[k])] if k in own else c for k, c in enumerate(books[p])]
    out, per = [], Counter()
    for (i, _, g, _), c in zip(kept, cut):
        found = [find(c[p], books[p]) for p in range(parts)]
        out.append((i, "".join(f"{k:02x}" for _, k in found), sum(d for d, _ in found), g))
        per[g] += out[-1][2]
    digest = hashlib.sha256(",".join(str(x) for b in books for c in b for x in c).encode()).hexdigest()
    return sorted(((i, code, e, per[g]) for i, code, e, g in out), key=repr), digest


def vector_rows(n=120, width=64):
    rng = random.Random(3)
    f32 = lambda x: float(np.float32(x))
    rows = [(k * 3 % 101, [f32(rng.gauss(0, 1)) for _ in range(width)], rng.choice([None, 1, 2, -1])) for k in range(n)]
    rows += rows[:5] + [(None, rows[0][1], None), (7, [0.25] * width, 1), (7, [0.5] * width, 1), (1000, [1000.0] * width, 9)]
    rows += [(500, None, 1), (501, [None] + [0.0] * (width - 1), 1), (502, [float("nan")] * width, 1), (503, [float("-inf")] + [0.0] * (width - 1), 2)]
    return rows


def run_codes(spark, rows):
    table = spark.createDataFrame([(i, v, g, 1, "c", 2.0, 3) for i, v, g in rows], VECTORS).repartition(3)
    codes = vector_codes.encode(table)
    got = vector_codes.with_label_error(codes.coded).select("vec_id", F.lower(F.hex("code")).alias("code"), "error", "label_error").collect()
    return sorted(map(tuple, got), key=repr), codes


@pytest.mark.parametrize("rows", [vector_rows(), vector_rows(6, 8), [(k, [float(k % 2)] * 16, 0) for k in range(40)], [(1, [0.5] * 5, 1), (2, [0.25] * 9, None), (3, [], 1)]])
def test_vector_codes(spark, rows):
    got, codes = run_codes(spark, rows)
    want, digest = codes_by_hand(rows)
    assert got == want
    assert codes.sha256() == digest


def test_vector_codes_decode_and_salted_labels(spark):
    _, codes = run_codes(spark, vector_rows())
    vectors = {(r["vec_id"], tuple(r["v"])): r["error"] for r in codes.coded.collect()}
    decoded = codes.coded.select("vec_id", "v", "error", F.col("code")).alias("a").collect()
    books = codes.books
    for r in decoded[:20]:
        back = [x for p, k in enumerate(r["code"]) for x in books[p, k]]
        assert sum((a - b) ** 2 for a, b in zip(r["v"], back)) == r["error"] == vectors[r["vec_id"], tuple(r["v"])]
    one = vector_codes.decode(codes).where("vec_id = 1000").first()["vector"]
    assert one == [x / 4096 for x in [x for p, k in enumerate(codes.coded.where("vec_id = 1000").first()["code"]) for x in books[p, k]]]
    per = codes.coded.groupBy("label").agg(F.sum("error").alias("label_error"))
    by_salt = vector_codes.salted(codes.coded, per).select("vec_id", "label_error").collect()
    assert Counter(by_salt) == Counter(vector_codes.with_label_error(codes.coded).select("vec_id", "label_error").collect())


def test_vector_codes_no_rows_and_too_large(spark):
    for rows in ([], [(1, None, 1)]):
        codes = vector_codes.encode(spark.createDataFrame([(*r, 1, "c", 2.0, 3) for r in rows], VECTORS))
        assert vector_codes.with_label_error(codes.coded).collect() == []
        assert codes.sha256() == hashlib.sha256(b"").hexdigest()
    with pytest.raises(ArithmeticError):
        run_codes(spark, [(1, [1e30] * 8, 1)])


def test_nearest_meets_only_the_ball():
    """Exact against full search, from any start, with ties."""
    rng = np.random.default_rng(1)
    for _ in range(20):
        entries, points = rng.integers(-4, 5, (9, 3)), rng.integers(-6, 7, (300, 3))
        best, least = vector_codes.nearest(points, rng.integers(0, 9, 300), entries)
        every = ((points[:, None, :] - entries[None]) ** 2).sum(axis=2)
        assert (best == every.argmin(axis=1)).all() and (least == every.min(axis=1)).all()


# ---- sharding

DOCS = "doc_id long, text string, place string, size string, n int, slot long, bucket int"


def draw(key, k):
    return int(hashlib.md5(f"{'' if key is None else key}:{k}".encode()).hexdigest()[:13], 16)


def shard_by_hand(key, weights):
    if len(set(weights)) == 1:
        return max(range(len(weights)), key=lambda k: (draw(key, k), -k))
    return max(range(len(weights)), key=lambda k: (-weights[k] / math.log((draw(key, k) + 0.5) / 2**52), -k))


def shard_docs(spark):
    texts = [None, "", "x", "é" * 9, "long " * 50_000] + [f"text {k % 40}" for k in range(300)]
    rows = list(enumerate(texts)) + [(None, "same")] * 50 + [(None, None), (7, "x"), (7, "x"), (8, "y")]
    return rows, spark.createDataFrame([(i, t, "p", "s", 1, 2, 3) for i, t in rows], DOCS).repartition(4)


@pytest.mark.parametrize("weights,bucket,block", [([1.0] * 8, 4096, 1 << 16), ([1.0] * 8, 4, 7), ([3.0, 1.0, 0.5], 10, 3), ([2.0], 1, 1)])
def test_shards(spark, weights, bucket, block):
    rows, docs = shard_docs(spark)
    got = sharding.numbered(sharding.keyed(docs, weights), bucket, block).collect()
    grown = [*weights, sum(weights) / len(weights)]
    want = Counter((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode()), shard_by_hand(i, weights), shard_by_hand(i, grown)) for i, t in rows)
    assert Counter((r["doc_id"], r["size"], r["text_crc32"], r["shard"], r["grown_shard"]) for r in got) == want
    for k in range(len(weights)):
        own = sorted((r["slot"], r["place"]) for r in got if r["shard"] == k)
        assert [s for s, _ in own] == list(range(len(own))) and [p for _, p in own] == sorted(p for _, p in own)
    assert all(r["grown_shard"] in (r["shard"], len(weights)) for r in got)


def test_shards_follow_weights_and_move_few(spark):
    ids = spark.range(20_000).select(F.col("id").alias("doc_id"))

    def placed(weights):
        return {r[0]: r[1] for r in ids.select("doc_id", sharding.shard_of(F.col("doc_id"), weights)).collect()}

    old, new, more = placed([1.0, 2.0, 1.0]), placed([1.0, 2.0, 1.0, 4.0]), placed([1.0, 3.0, 1.0])
    n = Counter(old.values())
    assert abs(n[1] / n[0] - 2) < 0.15 and abs(n[1] / n[2] - 2) < 0.15
    assert all(new[i] in (old[i], 3) for i in old) and abs(sum(new[i] == 3 for i in old) / 20_000 - 0.5) < 0.02
    assert all(more[i] in (old[i], 1) for i in old)  # a greater weight draws records to that shard only
    with pytest.raises(ValueError):
        sharding.shard_of(F.col("doc_id"), [1.0, 0.0])


def test_written_shards(spark, tmp_path):
    rows, docs = shard_docs(spark)
    path = str(tmp_path / "shards")
    sharding.write_shards(docs, path, [1.0] * 4, rows_a_file=40)
    back = spark.read.parquet(path)
    assert Counter((r["doc_id"], r["text"]) for r in back.collect()) == Counter(rows)
    slots = defaultdict(list)
    for r in sharding.shards(docs, [1.0] * 4).orderBy("shard", "slot").collect():
        slots[r["shard"]].append((r["doc_id"], r["text_crc32"]))
    for k, want in slots.items():
        files = sorted((tmp_path / "shards" / f"shard={k}").glob("*.parquet"))
        got = [(r["doc_id"], zlib.crc32((r["text"] or "").encode())) for f in files for r in spark.read.parquet(str(f)).collect()]
        assert got == want and len(files) >= 2
    with pytest.raises(ValueError):
        sharding.write_shards(docs.withColumn("shard", F.lit(1)), path, [1.0])
    assert sharding.shards(docs.limit(0), [1.0] * 8).collect() == []
