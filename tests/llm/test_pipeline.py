"""The corpus pipeline against plain Python, stage by stage, and its packed rows."""

import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from typegrove.llm import common, language_id, mixing, tokens

from . import brute


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    import random

    rng = random.Random(12)
    words = {"en": ["the", "stone", "river", "walk", "light", "green"], "de": ["über", "strasse", "nicht", "wald", "grün"]}
    rows = []
    for i in range(160):
        lang = "en" if i % 3 else "de"
        lines = [" ".join(f"{rng.choice(words[lang])}{rng.choice('abcdefgh')}{rng.choice('klmnop')}" for _ in range(rng.randint(4, 40))) for _ in range(rng.randint(1, 6))]
        text = "\n".join(lines)
        if i % 10 == 4 and i > 10:
            text = rows[-3][1]  # an exact copy
        if i % 10 == 7:
            text = text + "\n" + "a line that stands in many documents here"
        if i % 40 == 9:
            text = [None, "", "12 34 !!"][i % 3]
        rows.append((i, text, lang, f"s{i % 4}", len(text or "")))
    path = tmp_path_factory.mktemp("tables")
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{path}/documents.parquet")
    return str(path), rows


def test_stages(spark, folder):
    sf_dir, rows = folder
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = {}
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        docs = stage(spark, docs, sf_dir).cache()
        out[name] = docs
        if name != "packing":
            assert docs.columns == before.columns
    known = {i: t for i, t, *_ in rows if t and language_id.has_letter(t)}
    assert {r["doc_id"] for r in out["language_id"].collect()} == set(known)
    lines = brute.line_dedup(list(known.items()))
    kept = {i: k for i, (n, d, k) in lines.items() if not d or brute.WORD.search(k)}
    got = {r["doc_id"]: (r["text"], r["n_chars"]) for r in out["line_dedup"].collect()}
    assert got == {i: (t, len(t)) for i, t in kept.items()}
    groups = brute.components({i: brute.simhash(t) for i, t in kept.items()})
    left = {i for i, g in groups.items() if i == g}
    assert sorted(r["doc_id"] for r in out["simhash_near_dedup"].collect()) == sorted(left)
    sized = spark.createDataFrame([(i, rows[i][3], len(brute.WORD.findall(kept[i]))) for i in left], "doc_id long, source string, size long")
    copies = {r["doc_id"]: r["copies"] for r in mixing.copies(sized).collect() if r["copies"]}
    mixed = [r["doc_id"] for r in out["source_mixing"].collect()]
    assert {i: mixed.count(i) for i in set(mixed)} == copies
    _check_packed(out["packing"].collect(), {i: kept[i] for i in copies}, copies)


def _check_packed(pieces, texts, copies):
    ids = sorted(texts)
    whole = dict(zip(ids, (np.frombuffer(x + (1).to_bytes(4, "little"), "<u4") for x in tokens.encode([texts[i] for i in ids], tokens.tokenizer_path()))))
    ends, seen = {}, {}
    for r in sorted(pieces, key=lambda r: (r["sequence_id"], r["offset"])):
        assert ends.get(r["sequence_id"], 0) == r["offset"] and r["offset"] + r["length"] <= 2048
        ends[r["sequence_id"]] = r["offset"] + r["length"]
        assert zlib.crc32(whole[r["doc_id"]][r["start"] : r["start"] + r["length"]].tobytes()) == r["ids_crc32"]
        seen[r["doc_id"]] = seen.get(r["doc_id"], 0) + r["length"]
    assert seen == {i: len(whole[i]) * n for i, n in copies.items()}


def test_run_gives_the_last_stage(spark, folder):
    assert corpus_pipeline.run(spark, folder[0]).where("ids_crc32 is null").count() == 0


def test_empty_tables(spark, tmp_path):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame([], schema).write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_buckets(spark):
    df = spark.range(1000).withColumnRenamed("id", "k")
    bounds = common.range_bounds(df, "k", 7)
    got = df.select("k", common.bucket_of(F.col("k"), bounds).alias("b")).collect()
    assert all(r["b"] == sum(x <= r["k"] for x in bounds) for r in got)
    assert common.range_bounds(df.where("false"), "k", 7) == [] and common.range_bounds(df, "k", 1) == []


def test_more_buckets_than_are_cut_at_once(spark):
    df = spark.range(30_000).select((F.col("id") * 7 - 500).alias("k"))
    bounds = common.range_bounds(df, "k", 3000)
    assert 2048 < len(bounds) <= 3072
    got = df.select("k", common.bucket_of(F.col("k"), bounds).alias("b"), F.lit(2).alias("n"))
    rows = got.collect()
    import bisect

    assert all(r["b"] == bisect.bisect_right(bounds, r["k"]) for r in rows)
    (before,) = common.sums_before(got, "b", len(bounds) + 1, "n")
    assert all(r["before"] <= 2 * (r["k"] + 500) // 7 < r["before"] + 200 for r in got.select("k", before.alias("before")).where("k % 5 = 0").collect())


def test_scratch_needs_a_shared_folder_on_a_cluster():
    class Context:
        master = "spark://host:7077"

    class Conf:
        def get(self, name, default=None):
            return default

    class Session:
        sparkContext, conf = Context(), Conf()

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        common.Scratch(Session(), "x")
