"""Residuals of the mix, slices of language ID that end anywhere, and tables whose columns are named as helpers are."""

import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from typegrove.llm import language_id, line_dedup, mixing, simhash

from .test_operators import WORDS, language_docs


def taken_by_source(out):
    taken, target, units = Counter(), {}, defaultdict(list)
    for r in out:
        taken[r["source"]] += r["copies"] * r["size"] * r["rows"]
        target[r["source"]] = r["target"]
        units[r["source"]].append((r["size"] * r["rows"], r["copies"] - int(r["target"] / r["source_size"] + 1e-9) if r["source_size"] else 0))
    return taken, target, units


def test_mix_ends_near_its_targets_beside_long_documents(spark):
    """Fifty documents a source, one of them as long as many: each source is within its shortest open document of the target."""
    rng = random.Random(3)
    rows = []
    for s in range(40):
        rows += [(1000 * s + i, f"s{s}", rng.choice([rng.randint(20, 120), rng.randint(100, 900)])) for i in range(50)]
        rows.append((1000 * s + 50, f"s{s}", rng.randint(2500, 5000)))
    out = mixing.copies(spark.createDataFrame(rows, "doc_id long, source string, size long")).collect()
    taken, target, units = taken_by_source(out)
    for s, want in target.items():
        off = want - taken[s]
        open_ = [w for w, extra in units[s] if extra == (0 if off > 0 else 1)]
        assert abs(off) < 2 / 3 * min(open_) + 1e-6, (s, off)
    again = mixing.copies(spark.createDataFrame(rows, "doc_id long, source string, size long").repartition(7)).collect()
    assert sorted(map(tuple, again), key=repr) == sorted(map(tuple, out), key=repr)


def test_mix_of_one_document_a_source_and_of_huge_ones(spark):
    rows = [(k, f"one{k}", 10 + k) for k in range(9)] + [(100 + k, "big", [1_000_000, 3, 2, 1][min(k, 3)]) for k in range(60)]
    out = mixing.copies(spark.createDataFrame(rows, "doc_id long, source string, size long")).collect()
    assert len(out) == len(rows) and all(0 <= r["copies"] <= 3 for r in out)


@pytest.mark.parametrize("size", [1, 2, 3, 7, 64, 256])
def test_slices_give_the_words_of_the_whole(size):
    rng = random.Random(size)
    parts = ["\t", ",", " ", "--", "\n", ".", "1", "é", "日本", "ab", "Zz", "x" * 300]
    for _ in range(20):
        raw = "".join(rng.choice(parts) for _ in range(60)).encode()
        whole, first = language_id.words_of(raw)
        got = list(language_id.sliced(raw, size))
        assert np.array_equal(np.concatenate([g for g, _ in got]), whole)
        at = np.cumsum([0] + [len(g) for g, _ in got])
        assert np.array_equal(np.concatenate([f + a for (_, f), a in zip(got, at)]), first)


def test_sliced_scores_equal_unsliced(spark):
    model = language_id.fit(language_docs(spark))
    rng = random.Random(1)
    mixed = [rng.choice(WORDS[rng.choice(["aa", "aa", "bb"])]) for _ in range(3000)]
    for text in ("\t".join(mixed), ",".join(mixed), "kalo" * 500_000, "kalo" * 3000 + " " + " ".join(mixed)):
        raw = text.encode()
        whole = language_id._word_scores(raw, model)
        cut = np.concatenate(list(language_id._sliced_scores(raw, model, 256 if len(raw) < 100_000 else 1 << 16)))
        assert cut.shape == whole.shape and np.allclose(cut, whole, rtol=2e-3)
        if len(whole) > 1:
            best, share, count = (x[0] for x in language_id.choose(whole, np.array([0])))
            assert language_id.choose_long(text, model, 256) == (best, pytest.approx(share, abs=1e-6), count)


CLASHING = ["__id", "__row", "__dropped_lines", "__words", "__copy", "__source", "__doc_id", "__size", "__copies", "__line_n_dropped", "__line_kept_text", "fp", "component_id"]


def clashing(spark):
    line = "a line that several documents share, long enough"
    texts = [f"{line}\nkalo mito {k % 3} sano telo kalo sano" for k in range(12)] + [None, "", "mito sano telo " * 20]
    rows = [(k, t, "aa", f"s{k % 3}", 0, *[f"v{k}"] * len(CLASHING)) for k, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} string" for c in CLASHING))


def test_columns_named_as_helpers_pass_through(spark):
    docs = clashing(spark)
    done = line_dedup.dedup_lines(docs, prefix="x_")
    assert done.columns == [*docs.columns, "x_n_lines", "x_n_dropped", "x_kept_text"]
    assert all(r[c] == f"v{r['doc_id']}" for r in done.collect() for c in CLASHING)
    for out in (simhash.keep_representatives(docs), mixing.mix(docs), *[stage(spark, docs, "") for _, stage in corpus_pipeline.STAGES[:4]]):
        assert out.columns == docs.columns
        rows = out.collect()
        assert rows and all(r[c] == f"v{r['doc_id']}" for r in rows for c in CLASHING)
    assert corpus_pipeline.packed(spark, docs, "").count() >= 15


def test_mix_counts_of_clashing_table(spark):
    docs = clashing(spark)
    copies = Counter(r["doc_id"] for r in mixing.mix(docs).select("doc_id").collect())
    want = {r["doc_id"]: r["copies"] for r in mixing.copies(mixing.sizes(docs)).where(F.col("copies") > 0).collect()}
    assert copies == want
