"""Quality rules with risk-controlled cutoffs (DataFrame functions only).

Each rule rejects a document whose statistic lies above a cutoff. One half of the labelled rows orders, for each stratum,
a ladder of steps, each of which adds a rule or tightens one: first every rule at its loosest useful cutoff (the least
that rejects no good document of this half), then at the one that rejects most bad documents, each good one counting
``price`` times. The other half, the holdout, goes up the ladder: a step is taken if the exact binomial probability of so
few good documents rejected by the step's rules together, were the true rate ``risk``, is at most ``alpha`` divided by
the number of strata, and the first step that fails ends it. The order is fixed before the holdout is seen, so steps need
no further correction (fixed-sequence testing) and strata share ``alpha`` (Bonferroni): with probability 1 - ``alpha`` the
chosen rules, all together, reject no more than ``risk`` of the good documents of any stratum. Strata are classes of
length in words.

Statistics are computed once per document into a shared table; labels meet them by doc_id; what reaches the driver is
two cutoffs per rule and stratum at most.

Defined results: a null or wordless text fails the base (fewer than 50 words); rows without a label are judged, not
learned from; conflicting or repeated labels each count; without labels only the base decides; a very long text is one
row's list of words, sorted once if a window of it repeats; other columns are not looked at; no rows give no rows.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

#: Upper limits, in words, of all length strata but the last.
STRATA = (200, 1000)
RULES = ("symbols_per_word", "duplicate_line_share", "repeated_word_share", "upper_share", "marks_per_word", "long_words", "short_words")


def _repeated_words(words: Column) -> Column:
    """Words within 3-word windows found twice or more. Sorts the windows by hash, so repeats are neighbours: n log n."""

    def windows(w):
        return F.transform(F.slice(w, 1, F.greatest(F.array_size(w) - 2, F.lit(0))), lambda x, i: F.struct(F.xxhash64(x, F.get(w, i + 1), F.get(w, i + 2)).alias("h"), i.alias("at")))

    def covered(s):
        again = F.filter(s, lambda x, i: ((i > 0) & (F.get(s, i - 1)["h"] == x["h"])) | F.coalesce(F.get(s, i + 1)["h"] == x["h"], F.lit(False)))
        starts = F.array_sort(F.transform(again, lambda x: x["at"]))
        return common.let(starts, lambda p: F.aggregate(F.transform(p, lambda x, i: F.least(F.lit(3), F.coalesce(F.get(p, i + 1) - x, F.lit(3)))), F.lit(0), lambda a, b: a + b))

    def count(s):
        # most texts have no repeated window, which a set of the hashes shows without sorting
        repeats = F.array_size(F.array_distinct(F.transform(s, lambda x: x["h"]))) < F.array_size(s)
        return F.when(repeats, common.let(F.array_sort(s), covered)).otherwise(0)

    return common.let(words, lambda w: F.when(F.array_size(w) < 4, F.lit(0)).otherwise(common.let(windows(w), count)))


def statistics(docs: DataFrame) -> DataFrame:
    """doc_id, the counts, and one column per rule; no text."""
    text = common.text_of()
    rows = docs.select("doc_id", text.alias("text"), common.words_of(text).alias("words"))
    lines = F.filter(F.split("text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    rows = rows.select(
        "doc_id",
        F.array_size("words").cast("long").alias("n_words"),
        F.char_length(F.array_join("words", "")).cast("long").alias("word_chars"),
        F.regexp_count("text", F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
        common.let(lines, lambda x: F.struct(F.array_size(x).alias("n"), (F.array_size(x) - F.array_size(F.array_distinct(x))).alias("again"))).alias("lines"),
        _repeated_words(F.col("words")).cast("long").alias("n_repeat_words"),
        F.regexp_count("text", F.lit("[A-Z]")).alias("upper"),
        F.regexp_count("text", F.lit("[!?]")).alias("marks"),
    )
    n = F.greatest(F.col("n_words"), F.lit(1))
    mean = F.col("word_chars") / n
    rules = {
        "symbols_per_word": F.col("n_symbols") / n,
        "duplicate_line_share": F.col("n_dup_lines") / F.greatest(F.col("n_lines"), F.lit(1)),
        "repeated_word_share": F.col("n_repeat_words") / n,
        "upper_share": F.col("upper") / F.greatest(F.col("word_chars"), F.lit(1)),
        "marks_per_word": F.col("marks") / n,
        "long_words": mean,
        "short_words": -mean,
    }
    stratum = F.lit(len(STRATA))
    for k in reversed(range(len(STRATA))):
        stratum = F.when(F.col("n_words") < STRATA[k], k).otherwise(stratum)
    rows = rows.select("*", F.col("lines.n").cast("long").alias("n_lines"), F.col("lines.again").cast("long").alias("n_dup_lines")).drop("lines")
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", stratum.cast("int").alias("stratum"), *[v.cast("double").alias(k) for k, v in rules.items()])


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (F.lit(100) * F.col("n_repeat_words") > F.lit(50) * F.col("n_words"))


def lower_tail(k: Column, n: Column, rate: float) -> Column:
    """log P(X <= k) for X binomial(n, rate), summed in logs; 0 where k is at or above the mean, which no test needs."""

    def more(s, i):
        t = s["t"] + F.log((n - i + 1) / i) + F.log(F.lit(rate / (1 - rate)))
        top, low = F.greatest(s["sum"], t), F.least(s["sum"], t)
        return F.struct(t.alias("t"), (top + F.log1p(F.exp(low - top))).alias("sum"))

    first = n * F.log1p(F.lit(-rate))
    start = F.struct(first.alias("t"), first.alias("sum"))
    terms = F.when(k >= 1, F.sequence(F.lit(1).cast("long"), k)).otherwise(F.array().cast("array<bigint>"))
    return F.when(k >= n * rate, F.lit(0.0)).otherwise(F.aggregate(terms, start, more, lambda s: s["sum"]))


def ladder(seen: DataFrame, grid: int, price: int) -> DataFrame:
    """(stratum, rank, rule, cutoff): the steps in order. seen: stratum, good, and the rules' columns, of the first half."""
    long = seen.select("stratum", "good", F.explode(F.array(*[F.struct(F.lit(r).alias("rule"), F.col(r).alias("value")) for r in RULES])).alias("r")).select("stratum", "good", "r.*")
    at = F.array(*[F.lit((i + 0.5) / grid) for i in range(grid)])
    by = long.groupBy("rule", "stratum").agg(F.percentile_approx(F.when(~F.col("good"), F.col("value")), at, 2000).alias("bad_q"), F.percentile_approx(F.when(F.col("good"), F.col("value")), at, 2000).alias("good_q"), F.max(F.when(F.col("good"), F.col("value"))).alias("top"))
    empty = F.array().cast("array<double>")
    by = by.select("rule", "stratum", F.array_sort(F.array_distinct(F.array_compact(F.concat(F.coalesce("bad_q", empty), F.coalesce("good_q", empty), F.array("top"))))).alias("cuts"))
    # Each value falls between two cutoffs; counting the gaps is one small aggregate, whatever the number of cutoffs.
    placed = long.join(F.broadcast(by), ["rule", "stratum"]).withColumn("above", F.array_size(F.filter("cuts", lambda c: F.col("value") > c)))
    gaps = placed.groupBy("rule", "stratum", "above").agg(F.count_if("good").alias("good"), F.count_if(~F.col("good")).alias("bad"))
    table = by.select("rule", "stratum", F.posexplode("cuts").alias("i", "cutoff"))
    met = table.join(gaps, ["rule", "stratum"]).groupBy("rule", "stratum", "cutoff").agg(*[F.sum(F.when(F.col("above") > F.col("i"), F.col(c)).otherwise(0)).alias(c) for c in ("good", "bad")])
    met = met.where("bad > 0").withColumn("gain", F.col("bad") - price * F.col("good"))
    pick = lambda rows, step, order: rows.withColumns({"step": F.lit(step), "r": F.row_number().over(Window.partitionBy("rule", "stratum").orderBy(*order))}).where("r = 1").drop("r")
    loose = pick(met.where("good = 0"), 0, [F.desc("bad"), F.desc("cutoff")])
    tight = pick(met.where("gain > 0"), 1, [F.desc("gain"), F.desc("cutoff")])
    # a step that would loosen its rule again adds nothing
    steps = loose.unionByName(tight.join(loose.select("rule", "stratum", F.col("cutoff").alias("__loose")), ["rule", "stratum"], "left").where("__loose is null or cutoff < __loose").drop("__loose"))
    order = Window.partitionBy("stratum").orderBy("step", F.desc("gain"), "rule")
    return steps.select("stratum", F.row_number().over(order).alias("rank"), "rule", "cutoff")


def cutoffs(stats: DataFrame, labels: DataFrame, risk: float = 0.02, alpha: float = 0.05, grid: int = 16, price: int = 20) -> DataFrame:
    """(stratum, rank, rule, cutoff, holdout_good, false_rejections, log_p): the steps taken; counts are of all rules up to the step."""
    spark = stats.sparkSession
    labels = labels.where("quality is not null and doc_id is not null").select(F.col("doc_id").alias("__id"), (F.col("quality") > 0).alias("good"))
    seen = stats.join(labels, F.col("doc_id") == F.col("__id")).where(~base_failed())
    seen = seen.withColumn("holdout", F.pmod(F.crc32(F.concat(F.lit("half"), F.col("doc_id").cast("string"))), F.lit(2)) == 1).select("doc_id", "stratum", "good", "holdout", *RULES)
    seen = common.Scratch(spark, "quality-labelled").keep(seen, "rows")
    steps = ladder(seen.where("not holdout"), grid, price).collect()  # two a rule and stratum at most
    fails = [F.when((F.col("stratum") == s["stratum"]) & (F.col(s["rule"]) > F.lit(s["cutoff"])), F.lit(s["rank"])) for s in steps]
    first = F.array_min(F.array_compact(F.array(*fails))) if fails else F.lit(None).cast("int")
    good = seen.where("holdout and good").groupBy("stratum", first.alias("first")).agg(F.count(F.lit(1)).alias("n"))
    table = spark.createDataFrame([tuple(s) for s in steps], "stratum int, rank int, rule string, cutoff double")
    per = good.groupBy("stratum").agg(F.sum("n").alias("holdout_good"))
    out = table.join(per, "stratum").join(good.select(F.col("stratum").alias("__stratum"), "first", F.col("n").alias("k")), (F.col("stratum") == F.col("__stratum")) & (F.col("first") == F.col("rank")), "left")
    up = Window.partitionBy("stratum").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    out = out.withColumn("false_rejections", F.coalesce(F.sum("k").over(up), F.lit(0)).cast("long"))
    out = out.withColumn("log_p", lower_tail(F.col("false_rejections"), F.col("holdout_good"), risk))
    out = out.withColumn("taken", F.min(F.col("log_p") <= math.log(alpha / (len(STRATA) + 1))).over(up))
    return out.where("taken").select("stratum", "rank", "rule", "cutoff", "holdout_good", "false_rejections", "log_p")


def judge(stats: DataFrame, chosen: list) -> DataFrame:
    """Adds base_failed, failed_rules and kept; ``chosen``: rows of ``cutoffs``, at most two per rule and stratum."""
    fails = [F.when((F.col("stratum") == c["stratum"]) & (F.col(c["rule"]) > F.lit(c["cutoff"])), F.lit(c["rule"])) for c in chosen]
    failed = F.array_distinct(F.array_compact(F.array(*fails))) if fails else F.array().cast("array<string>")
    rows = stats.withColumn("base_failed", base_failed()).withColumn("failed_rules", failed)
    return rows.withColumn("kept", ~F.col("base_failed") & (F.array_size("failed_rules") == 0))


def quality(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    stats = common.Scratch(docs.sparkSession, "quality").keep(statistics(docs), "statistics")
    return judge(stats, cutoffs(stats, labels, **options).collect())


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", F.array_join("failed_rules", ",").alias("failed_rules"))
