"""Mixing sources to target weights by pivotal dependent rounding (DataFrame functions only).

Every source gets a target number of words. A document's expected copies are target / source size: a whole part, the
same for all its source's documents, and a fraction that has to become 0 or 1. Fractions are paired: words move from
one of the pair to the other, in a random direction whose odds keep both expectations, until one fraction is whole; the
other goes on to the next pair. A pair's words stay the same, so only a tree's last residual is off.

Units of a source are dealt to classes by powers of two of their words, and each class is reduced on its own, so a
residual only meets units of its own size. Groups of about ``group`` units are reduced in one expression each, then their
residuals in groups again, until one residual a class is left: a reduction tree of base ``group`` (four levels for 4e9
documents). Group numbers come from hashes, so the largest source spreads over all tasks and reruns agree.

What is left of a source is a residual a class. They are rounded from the largest down, each with the words that the ones
before took too many or too few. What then is off is mended by flips: units that were left out are taken, or taken ones
left out, from the largest class down, where a unit's words are no more than what is off, or pass it and still halve it,
in rounds until no unit does. So a source ends within two thirds of its smallest unit that could still be flipped in the
direction that is needed, or with no such unit left: a document that is most of its source's target may leave it off by
what the others can't make up for. Roundings have the expectations that are asked for; flips move those of short documents
in sources whose long ones have to be made up for.

Defined results: a null text has size 0 and takes 0; a null source is a source of its own, last in order; rows that
agree in doc_id, source and size share one decision, so a source of rows without doc_id and of one size is taken whole
or not; a very long text is a unit as any other; other columns pass through ``mix`` as they are; no rows give no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

KEY = ["source", "doc_id", "size"]
#: Sources up to this number go to every executor with their targets (some bytes each); more are joined by a shuffle, with
#: the same result.
BROADCAST_SOURCES = 10_000
#: Units of each class and source that the first round of flips looks at.
FLIPS = 64


def sizes(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", "source", F.regexp_count(common.text_of(), F.lit(r"[^\x20\x09-\x0D]+")).cast("long").alias("size"))


def source_targets(sized: DataFrame, weights: tuple[int, ...] = (5, 2, 1), ceiling: int = 3) -> DataFrame:
    """One row per source: n, source_size, target, of any number of sources.

    Places in the order of sources come from a distributed sort, numbered by part. Sources whose ceiling lies below the
    common level per unit of weight are set to it and the level is taken anew, until no more are: an aggregate a round.
    """
    scratch = common.Scratch(sized.sparkSession, "targets")
    per = sized.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("source_size"))
    per = per.repartitionByRange(F.col("source").asc_nulls_last()).sortWithinPartitions(F.col("source").asc_nulls_last())
    per = scratch.keep(per.withColumn("part", F.spark_partition_id()), "sorted")
    parts = per.agg(F.max("part")).first()[0]
    (before,) = common.sums_before(per.withColumn("one", F.lit(1)), "part", (parts or 0) + 1, "one")
    at = before + F.row_number().over(Window.partitionBy("part").orderBy(F.col("source").asc_nulls_last())) - 1
    per = per.withColumn("w", F.element_at(F.array(*map(F.lit, weights)), (at % len(weights)).cast("int") + 1).cast("double"))
    per = scratch.keep(per.withColumn("most", F.col("source_size") * float(ceiling)), "weighed")
    level, capped = -1.0, None
    while True:
        below = F.col("most") < F.lit(level) * F.col("w")
        found = per.agg(F.sum("source_size").alias("all"), F.sum(F.when(below, F.col("most")).otherwise(0.0)).alias("set"), F.sum(F.when(below, 0.0).otherwise(F.col("w"))).alias("rest"), F.count_if(below).alias("k")).first()
        if found["k"] == capped or not found["rest"]:
            break
        level, capped = (found["all"] - found["set"]) / found["rest"], found["k"]
    share = F.least(F.col("most"), F.lit(level) * F.col("w"))
    return per.select("source", "n", "source_size", share.alias("target"))


def _uniform(*parts) -> Column:
    return F.pmod(F.xxhash64(*parts), F.lit(1 << 52)) / float(1 << 52)


def _pair(state: Column, x: Column, level: int) -> Column:
    """One pivotal step: the residual ``state.cur`` meets the item ``x``."""
    i = state["cur"]
    up = F.least(i["w"] * (1 - i["p"]), x["w"] * x["p"])  # words that i can gain from x
    down = F.least(i["w"] * i["p"], x["w"] * (1 - x["p"]))  # words that x can gain from i
    gains = _uniform(i["doc_id"], x["doc_id"], i["size"], x["size"], F.lit(level)) * (up + down) < down

    def item(of: Column, p: Column) -> Column:
        return F.struct(of["w"].alias("w"), of["doc_id"].alias("doc_id"), of["size"].alias("size"), p.alias("p"))

    def decided(of: Column, copy: int) -> Column:
        return F.array(F.struct(of["doc_id"].alias("doc_id"), of["size"].alias("size"), of["w"].alias("w"), F.lit(copy).alias("extra")))

    def step(cur: Column, done: Column) -> Column:
        return F.struct(cur.alias("cur"), F.concat(state["done"], done).alias("done"))

    met = (
        F.when(gains & (i["w"] * (1 - i["p"]) <= x["w"] * x["p"]), step(item(x, x["p"] - up / x["w"]), decided(i, 1)))
        .when(gains, step(item(i, i["p"] + up / i["w"]), decided(x, 0)))
        .when(i["w"] * i["p"] <= x["w"] * (1 - x["p"]), step(item(x, x["p"] + down / x["w"]), decided(i, 0)))
        .otherwise(step(item(i, i["p"] - down / i["w"]), decided(x, 1)))
    )
    return F.when(i.isNull(), F.struct(x.alias("cur"), state["done"].alias("done"))).otherwise(met)


def _step_of(level: int):
    return lambda state, x: _pair(state, x, level)


def pivotal(pool: DataFrame, most: int, scratch: common.Scratch, group: int = 256) -> tuple[DataFrame, DataFrame]:
    """(decided, residuals) of each source and class of the pool (source, class, doc_id, size, w words at stake, p, n rows).

    p is above 0 and below 1, ``most`` the largest n. Decided rows have ``extra`` 0 or 1, residuals, one a source and class
    at most, the p that is left.
    """
    done, level, key = None, 0, ["source", "class"]
    pool = pool.withColumn("groups", F.ceil(F.col("n") / group)).drop("n")
    while True:
        g = F.pmod(F.xxhash64("doc_id", "size", F.lit(level)), "groups")
        item = F.struct((-F.col("w")).alias("order"), "doc_id", "size", "w", "p")
        met = pool.groupBy(*key, "groups", g.alias("g")).agg(F.collect_list(item).alias("items"))  # about ``group`` items
        items = F.transform(F.array_sort("items"), lambda x: F.struct(x["w"].alias("w"), x["doc_id"].alias("doc_id"), x["size"].alias("size"), x["p"].alias("p")))
        start = F.from_json(F.lit('{"done": []}'), "cur struct<w:double,doc_id:bigint,size:bigint,p:double>, done array<struct<doc_id:bigint,size:bigint,w:double,extra:int>>")
        met = met.select(*key, "groups", F.aggregate(items, start, _step_of(level)).alias("s"))
        met = scratch.keep(met, f"level-{level}")
        own = met.select(*key, F.explode("s.done").alias("d")).select(*key, "d.*")
        done = own if done is None else done.unionByName(own)
        left = met.where("s.cur is not null").select(*key, "groups", "s.cur.*")
        most = -(-most // group)
        if most <= 1:
            return done, left.drop("groups")
        pool = left.withColumn("groups", F.ceil(F.col("groups") / group))
        level += 1


def round_residuals(left: DataFrame) -> DataFrame:
    """(source, err, done): a source's residuals, one a class, rounded from the largest down; ``err`` are the words that it lacks."""
    items = F.array_sort(F.collect_list(F.struct((-F.col("w")).alias("order"), "class", "doc_id", "size", "w", "p")))

    def step(state: Column, x: Column) -> Column:
        odds = F.least(F.lit(1.0), F.greatest(F.lit(0.0), x["p"] + state["err"] / x["w"]))
        extra = F.when(_uniform(x["doc_id"], x["size"], F.lit("last")) < odds, 1).otherwise(0)
        decided = F.struct(x["class"].alias("class"), x["doc_id"].alias("doc_id"), x["size"].alias("size"), x["w"].alias("w"), extra.alias("extra"))
        return F.struct((state["err"] + x["w"] * (x["p"] - extra)).alias("err"), F.concat(state["done"], F.array(decided)).alias("done"))

    start = F.from_json(F.lit('{"err": 0.0, "done": []}'), "err double, done array<struct<class:int,doc_id:bigint,size:bigint,w:double,extra:int>>")
    return left.groupBy("source").agg(items.alias("items")).select("source", F.aggregate("items", start, step).alias("s")).select("source", "s.*")


def flips(decided: DataFrame, off: DataFrame, sources: int, round_: int) -> DataFrame:
    """(source, err, flipped): of each class some units are looked at, from the largest down, and flipped where ``err`` shrinks.

    The units are the least hashes of shares of a class, a partial aggregate; a source's list has a unit a share and class
    at most, with four times as many shares in each round.
    """
    h = F.xxhash64("doc_id", "size", F.lit(round_))
    rows = _beside(decided, off.select("source", "err"), sources).where(F.col("extra") == F.when(F.col("err") > 0, 0).otherwise(1))
    rows = rows.where(F.col("w") <= 1.5 * F.abs("err"))
    best = rows.groupBy("source", "err", "class", F.pmod(h, F.lit(FLIPS << 2 * round_)).alias("share")).agg(F.min(F.struct(h.alias("h"), "doc_id", "size", "w")).alias("u"))
    unit = F.struct((-F.col("class")).alias("order"), F.col("u.h").alias("h"), F.col("u.doc_id").alias("doc_id"), F.col("u.size").alias("size"), F.col("u.w").alias("w"))
    lists = best.groupBy("source", "err").agg(F.array_sort(F.collect_list(unit)).alias("units"))

    def flip(state: Column, x: Column) -> Column:
        own = F.struct(x["doc_id"].alias("doc_id"), x["size"].alias("size"), x["w"].alias("w"))
        return F.struct((state["err"] - F.signum(state["err"]) * x["w"]).alias("err"), F.concat(state["flipped"], F.array(own)).alias("flipped"))

    def last(state: Column) -> Column:
        """One more unit, the smallest of the list, where it passes the target but halves what is off at least."""
        rest = F.array_except(F.transform("units", lambda x: F.struct(x["doc_id"].alias("doc_id"), x["size"].alias("size"), x["w"].alias("w"))), state["flipped"])
        rest = F.filter(rest, lambda x: x["w"] <= 1.5 * F.abs(state["err"]))
        one = F.element_at(F.array_sort(F.transform(rest, lambda x: F.struct(x["w"].alias("w"), x["doc_id"].alias("doc_id"), x["size"].alias("size")))), 1)
        return F.when(F.array_size(rest) > 0, flip(state, one)).otherwise(state)

    start = F.struct(F.col("err").alias("err"), F.from_json(F.lit("[]"), "array<struct<doc_id:bigint,size:bigint,w:double>>").alias("flipped"))
    met = F.aggregate("units", start, lambda state, x: F.when(x["w"] <= F.abs(state["err"]), flip(state, x)).otherwise(state))
    # a list that ran out may be followed by more of its classes: only one that did not may pass the target
    out = lists.select("source", "units", met.alias("s"))
    left = F.array_size("s.flipped") < F.array_size("units")
    out = out.select("source", common.let(F.col("s"), lambda s: F.when(left, last(s)).otherwise(s)).alias("s"))
    return out.select("source", "s.*").where(F.array_size("flipped") > 0)


def settle(done: DataFrame, left: DataFrame, sources: int, scratch: common.Scratch) -> DataFrame:
    """(source, doc_id, size, extra) of all units of the pool: residuals rounded, then flips until none brings a source nearer."""
    rounded = scratch.keep(round_residuals(left), "rounded")  # a row a source
    columns = ["source", "class", "doc_id", "size", "w", "extra"]
    every = done.select(*columns).unionByName(rounded.select("source", F.explode("done").alias("d")).select("source", "d.*").select(*columns))
    off, k = rounded.select("source", "err"), 0
    while True:
        found = scratch.keep(flips(every, off, sources, k), f"flips-{k}")
        if found.isEmpty():
            return every.select(*KEY, "extra")
        units = found.select(F.col("source").alias("__source"), F.explode("flipped").alias("u")).select("__source", F.col("u.doc_id").alias("__doc_id"), F.col("u.size").alias("__size"), F.lit(True).alias("__flip"))
        every = every.join(units, _same(KEY), "left").withColumn("extra", F.when(F.col("__flip"), 1 - F.col("extra")).otherwise(F.col("extra"))).select(*columns)
        every, off, k = scratch.keep(every, f"settled-{k}"), found.select("source", "err"), k + 1


def _same(keys: list[str]) -> list[Column]:
    return [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys]


def _beside(rows: DataFrame, per: DataFrame, sources: int, keys: tuple[str, ...] = ("source",)) -> DataFrame:
    """Each row with the columns of its source (and class): sent to all executors while sources are few, else joined by key."""
    small = F.broadcast(per) if sources <= BROADCAST_SOURCES else per
    for c in keys:
        small = small.withColumnRenamed(c, f"__{c}")
    return rows.join(small, _same(list(keys))).drop(*[f"__{c}" for c in keys])


def copies(sized: DataFrame, weights: tuple[int, ...] = (5, 2, 1), ceiling: int = 3, group: int = 256) -> DataFrame:
    """(source, doc_id, size, source_size, target, copies), one row for each different key of ``sized``."""
    spark = sized.sparkSession
    scratch = common.Scratch(spark, "mixing")
    per = scratch.keep(source_targets(sized, weights, ceiling), "sources")
    found = per.agg(F.count(F.lit(1)).alias("k")).first()
    units = sized.groupBy(*KEY).agg(F.count(F.lit(1)).alias("rows"))
    units = _beside(units, per.drop("n"), found["k"])
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    units = units.withColumn("whole", F.floor(rate + 1e-9).cast("int")).withColumn("p", F.greatest(rate - F.col("whole"), F.lit(0.0)))
    units = scratch.keep(units.withColumn("whole", F.least(F.col("whole"), F.lit(ceiling))), "units")
    pool = units.where((F.col("p") > 1e-9) & (F.col("size") > 0) & (F.col("whole") < ceiling))
    pool = pool.select(*KEY, "p", (F.col("size") * F.col("rows")).cast("double").alias("w"))
    pool = scratch.keep(pool.withColumn("class", F.floor(F.log2("w")).cast("int")), "pool")
    per_class = scratch.keep(pool.groupBy("source", "class").agg(F.count(F.lit(1)).alias("n")), "classes")  # some dozen rows a source
    most = per_class.agg(F.max("n")).first()[0] or 0
    extra = settle(*pivotal(_beside(pool, per_class, found["k"], ("source", "class")), most, scratch, group), found["k"], scratch)
    extra = extra.select(*[F.col(k).alias(f"__{k}") for k in KEY], "extra")
    out = units.join(extra, _same(KEY), "left").withColumn("copies", F.col("whole") + F.coalesce("extra", F.lit(0)))
    return out.select(*KEY, "source_size", "target", F.when(F.col("size") > 0, F.col("copies")).otherwise(0).cast("int").alias("copies"), "rows")


def mix(docs: DataFrame, **options) -> DataFrame:
    """``docs`` with each row as often as the mix takes it; the columns stay as they are."""
    scratch = common.Scratch(docs.sparkSession, "mix")
    size = F.regexp_count(common.text_of(), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")
    taken = copies(scratch.keep(sizes(docs), "sizes"), **options).where("copies > 0").select(*[F.col(k).alias(f"__{k}") for k in KEY], F.col("copies").alias("__copies"))
    own, copy, *names = common.fresh(docs.columns, "__words", "__copy", *[f"__{k}" for k in KEY], "__copies")
    taken = taken.toDF(*names)
    source, doc_id, words, n = map(F.col, names)
    rows = docs.withColumn(own, size).join(taken, F.col("source").eqNullSafe(source) & F.col("doc_id").eqNullSafe(doc_id) & (F.col(own) == words))
    rows = rows.withColumn(copy, F.explode(F.sequence(F.lit(1), n)))
    return rows.select(*[docs[c] for c in docs.columns])


def op7_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = common.Scratch(spark, "sizes")
    sized = scratch.keep(sizes(spark.read.parquet(f"{sf_dir}/documents.parquet")), "documents")
    out = copies(sized).withColumn("taken", (F.col("copies") * F.col("size")).cast("long"))
    # rows that share a key share the decision; each of them is a row of the result
    out = out.withColumn("row", F.explode(F.sequence(F.lit(1), F.col("rows"))))
    return out.select("doc_id", "size", "source_size", "target", "taken", "source", "copies")
