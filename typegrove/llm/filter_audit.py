"""Filter interaction audit: what each filter removes at each place of each order, from one cube over failure flags.

A document's failures do not depend on the order of filters, so a pass reduces all documents to cells: a row for each
part and combination of flags that occurs (parts x 2^k at most, a partial aggregate, so a hot part costs a row a task).
A cube over the k flags and the part counts the cells; of its grouping sets those rows count where every flag that is
grouped by is false: the survivors of that subset of filters. A step of an order that meets filter f after the subset S
is the pair (S, S + f) of subsets, and a join of such pairs gives everything else:

    removed = survivors(S) - survivors(S + f)      redundant = failing f - removed
    failing f = the pair of the empty subset       failing f only = the pair of all filters but f
    shapley = removed over all orders: |S|! (k - 1 - |S|)! orders have the pair (S, S + f)

Defined results: a null text is the empty text (no words, so it fails A; equal to other empty and null texts); a null
lang is the part ''; a row without doc_id is a row of its part, but is no copy and has no copies or labels; rows of one
doc_id all count, and are no copies of each other; several label rows of a document are one that has what any has; a very
long text is judged within its row; other columns are not looked at; no rows give no rows.
"""

from __future__ import annotations

from itertools import permutations
from math import factorial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: Filters of ``failures``, in the order of their letters.
FILTERS = "ABCDE"
#: Orders are listed one by one, so their number is bounded.
MOST_FILTERS = 7


def text_failures(docs: DataFrame) -> DataFrame:
    """doc_id, part, sha (of the whole text) and the filters A to D of each document."""
    counts = common.let(common.words_of(F.col("text")), lambda w: F.struct(F.array_size(w).cast("long").alias("words"), F.array_size(F.array_distinct(w)).cast("long").alias("distinct")))
    text, capitals = F.col("text"), F.regexp_count("text", F.lit("[A-Z]")).cast("long")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("lang", F.lit("")).alias("part"), common.text_of().alias("text"))
    return docs.withColumn("counts", counts).select(
        "doc_id",
        "part",
        F.unhex(F.sha2(text, 256)).alias("sha"),
        (F.col("counts.words") < 200).alias("A"),
        (100 * F.col("counts.distinct") < 50 * F.col("counts.words")).alias("B"),
        (100 * capitals > 3 * F.char_length(text).cast("long")).alias("C"),
        text.rlike("[#$%&*|]").alias("D"),
    )


def failures(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per document: part, A to E (true: fails that filter), good and toxic (true: labelled so).

    Texts are read once, into a table of flags and hashes. A copy is a document that is not the first of its text: the
    first ones are joined by doc_id and hash, so a large group of copies is no hot key.
    """
    scratch = common.Scratch(docs.sparkSession, "filter-audit")
    flags = scratch.keep(text_failures(docs), "flags", "zstd")
    first = flags.where("doc_id is not null").groupBy("sha").agg(F.min("doc_id").alias("doc_id")).withColumn("first", F.lit(True))
    has = {c: F.max(F.coalesce(F.col(of) == 1, F.lit(False))).alias(c) for c, of in (("good", "quality"), ("toxic", "toxic"))}
    marked = labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(*has.values())
    flags = flags.join(first, ["doc_id", "sha"], "left").withColumn("E", F.col("doc_id").isNotNull() & F.col("first").isNull())
    return flags.join(marked, "doc_id", "left").select("part", *FILTERS, *[F.coalesce(c, F.lit(False)).alias(c) for c in has])


def survivors(failed: DataFrame, filters: str = FILTERS) -> DataFrame:
    """(part, subset, n, good, toxic): documents of the part that pass every filter of the subset (a bit mask), zeros included."""
    cells = failed.groupBy("part", *filters).agg(F.count(F.lit(1)).alias("n"), F.count_if("good").alias("good"), F.count_if("toxic").alias("toxic"))
    sums = [F.sum(c).alias(c) for c in ("n", "good", "toxic")]
    cube = cells.cube(*filters, "part").agg(*sums, F.grouping("part").alias("all_parts"), *[F.grouping(f).alias(f"any_{f}") for f in filters])
    selected = [F.col(f"any_{f}") == 0 for f in filters]
    none_fails = F.lit(True)
    subset = F.lit(0)
    for k, (f, on) in enumerate(zip(filters, selected)):
        none_fails = none_fails & (~on | ~F.coalesce(F.col(f), F.lit(False)))
        subset = subset + F.when(on, 1 << k).otherwise(0)
    found = cube.where((F.col("all_parts") == 0) & none_fails).select("part", subset.alias("subset"), "n", "good", "toxic")
    # every part has a row of the empty subset; one of the others is missing where nothing survives
    masks = F.sequence(F.lit(0), F.lit((1 << len(filters)) - 1))
    frame = found.where("subset = 0").select("part", F.explode(masks).alias("subset"))
    return frame.join(found, ["part", "subset"], "left").fillna(0, ["n", "good", "toxic"])


def audit(failed: DataFrame, filters: str = FILTERS) -> DataFrame:
    """For each part, order of the filters and step: what is kept, removed, redundant, and what it costs.

    ``failed`` has ``part``, a boolean column a filter (named by one letter) and the booleans ``good`` and ``toxic``.
    """
    k = len(filters)
    if not 1 <= k <= MOST_FILTERS or len(set(filters)) < k:
        raise ValueError(f"from 1 to {MOST_FILTERS} different filters")
    spark, every = failed.sparkSession, (1 << k) - 1
    scratch = common.Scratch(spark, "audit")
    left = scratch.keep(survivors(failed, filters), "survivors")  # parts x 2^k rows
    pairs, steps = {}, []
    for order in permutations(filters):
        s = 0
        for step, f in enumerate(order, 1):
            bit = 1 << filters.index(f)
            pairs[s, f] = (s, f, s | bit, factorial(step - 1) * factorial(k - step))
            steps.append(("".join(order), step, f, s))
            s |= bit
    pairs = spark.createDataFrame(list(pairs.values()), "subset int, filter string, next int, orders long")
    after = left.select("part", F.col("subset").alias("next"), *[F.col(c).alias(f"{c}_kept") for c in ("n", "good", "toxic")])
    met = left.join(pairs, "subset").join(after, ["part", "next"])
    met = met.select("part", "subset", "filter", "next", "orders", F.col("n_kept").alias("kept"), (F.col("n") - F.col("n_kept")).alias("removed"), (F.col("good") - F.col("good_kept")).alias("good_lost"), (F.col("toxic") - F.col("toxic_kept")).alias("toxic_lost"))
    met = scratch.keep(met, "pairs")  # parts x k x 2^(k-1) rows
    alone = F.when(F.col("next") == every, F.col("removed"))
    per = met.groupBy("part", "filter").agg(F.max(F.when(F.col("subset") == 0, F.col("removed"))).alias("failing"), F.max(alone).alias("unique_fails"), F.sum(F.col("orders") * F.col("removed")).alias("shapley"))
    steps = spark.createDataFrame(steps, "filter_order string, step int, filter string, subset int")
    out = met.join(per, ["part", "filter"]).join(steps, ["subset", "filter"])
    return out.select("part", "filter_order", "step", *[F.col(c).cast("long").alias(c) for c in ("kept", "removed")], (F.col("failing") - F.col("removed")).cast("long").alias("redundant"), *[F.col(c).cast("long").alias(c) for c in ("unique_fails", "good_lost", "toxic_lost", "shapley")])


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "lang", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality", "toxic")
    return audit(failures(docs, labels))


ORACLE = r"""
WITH words AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w
  FROM documents),
marks AS (
  SELECT doc_id, bool_or(coalesce(quality = 1, false)) AS good, bool_or(coalesce(toxic = 1, false)) AS toxic
  FROM labels GROUP BY doc_id),
failed AS (
  SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic,
         CASE WHEN len(w) < 200 THEN 'A' ELSE '' END
         || CASE WHEN 100 * list_unique(w) < 50 * len(w) THEN 'B' ELSE '' END
         || CASE WHEN 100 * len(regexp_replace(t, '[^A-Z]', '', 'g')) > 3 * len(t) THEN 'C' ELSE '' END
         || CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 'D' ELSE '' END
         || CASE WHEN doc_id > min(doc_id) OVER (PARTITION BY t) THEN 'E' ELSE '' END AS fails
  FROM words LEFT JOIN marks USING (doc_id)),
cells AS (
  SELECT part, fails, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic
  FROM failed GROUP BY part, fails),
letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS l),
orders AS (
  SELECT a.l || b.l || c.l || d.l || e.l AS o
  FROM letters a JOIN letters b ON b.l <> a.l JOIN letters c ON c.l NOT IN (a.l, b.l)
  JOIN letters d ON d.l NOT IN (a.l, b.l, c.l) JOIN letters e ON e.l NOT IN (a.l, b.l, c.l, d.l)),
steps AS (SELECT o, k, substr(o, k, 1) AS f, substr(o, 1, k - 1) AS prior FROM orders, range(1, 6) r(k)),
met AS (
  SELECT part, o, k, f, n, good, toxic, contains(fails, f) AS fail, fails = f AS alone,
         translate(prior, fails, '') = prior AS reached
  FROM cells, steps),
sums AS (
  SELECT part, o AS filter_order, k::INTEGER AS step, f,
         sum(n) FILTER (reached AND NOT fail) AS kept, sum(n) FILTER (reached AND fail) AS removed,
         sum(n) FILTER (fail AND NOT reached) AS redundant, sum(n) FILTER (alone) AS unique_fails,
         sum(good) FILTER (reached AND fail) AS good_lost, sum(toxic) FILTER (reached AND fail) AS toxic_lost
  FROM met GROUP BY ALL)
SELECT part, filter_order, step, coalesce(kept, 0)::BIGINT AS kept, coalesce(removed, 0)::BIGINT AS removed,
       coalesce(redundant, 0)::BIGINT AS redundant, coalesce(unique_fails, 0)::BIGINT AS unique_fails,
       coalesce(good_lost, 0)::BIGINT AS good_lost, coalesce(toxic_lost, 0)::BIGINT AS toxic_lost,
       coalesce(sum(removed) OVER (PARTITION BY part, f), 0)::BIGINT AS shapley
FROM sums
"""
