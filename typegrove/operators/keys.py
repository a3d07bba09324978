"""Collision-free keys: base, base_2, base_3, ... within a scope, as if given one after another in the order of the requests.

Requests of one base take its free numbers in order: the r-th request takes r plus as many as there are blocked numbers
below it. With the blocked numbers b_1 < b_2 < ... of a base, b_i has b_i - i free numbers below, so that many are those i for
which b_i - i < r. Ranks and counts are sums by parts (``numbering``), so a base that most requests share is split over tasks.

Where two bases come to the same key ("a_2" as the second "a" and as a name), the earlier request keeps it, and for later
requests of the other base the number is blocked. Such a number is passed over if the request whose turn it is comes
later than the one that keeps it: which numbers are so is settled first, lower ones deciding for higher ones, and then
further clashes are looked for, until there are none. Rounds are few, as every one settles all it finds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import slug
from ..shared import Steps
from .numbering import places, sums_before

MOST = 100
SUFFIXES = range(2, 12)  # lengths of a suffix, _2 to _999999999


def _key(base: Column, number: Column) -> Column:
    """A longer suffix cuts the base so that the key fits."""
    suffix = F.when(number == 1, F.lit("")).otherwise(F.concat(F.lit("_"), number.cast("string")))
    return F.concat(F.left(base, F.lit(MOST) - F.char_length(suffix)), suffix)


def numbers_of(bases: DataFrame, used: DataFrame) -> DataFrame:
    """(scope, base, number): the numbers of each base whose key is among ``used`` (scope, key)."""
    stems = bases.select("scope", "base", F.explode(F.array_distinct(F.array("base", *[F.left("base", F.lit(MOST - n)) for n in SUFFIXES]))).alias("stem"))
    number = F.regexp_extract("key", "_([1-9][0-9]{0,8})$", 1)
    parts = F.array(F.struct(F.col("key").alias("stem"), F.lit(1).alias("number")), F.when(number != "", F.struct(F.regexp_replace("key", "_[0-9]+$", "").alias("stem"), number.cast("int").alias("number"))))
    found = used.select("scope", "key", F.explode(F.array_compact(parts)).alias("p")).select("scope", "key", "p.*")
    return stems.join(found, ["scope", "stem"]).where(_key(F.col("base"), F.col("number")) == F.col("key")).select("scope", "base", "number").distinct()


#: Ranks of a base that one task numbers, as a power of two.
PART = 16


def _ranked(blocked: DataFrame) -> DataFrame:
    """Blocked numbers (scope, base, number) that are passed over, with ``gap``: the free numbers below."""
    rows = blocked.select("scope", "base", "number").withColumns({"part": F.shiftright("number", PART), "one": F.lit(1)})
    return sums_before(rows, ["scope", "base"], "part", ["number"], "one", "i").select("scope", "base", "number", (F.col("number") - F.col("i") - 1).cast("int").alias("gap"))


def _claims(rows: DataFrame, gaps: DataFrame) -> DataFrame:
    """(scope, base, seq, rank, number, key) that requests come to, given the numbers that are passed over."""
    kinds = dict(rows.dtypes)
    requests = rows.select("scope", "base", "seq", "rank", F.col("rank").alias("at"), F.lit(0).alias("gap"))
    marks = gaps.select("scope", "base", F.lit(None).cast(kinds["seq"]).alias("seq"), F.lit(None).cast("int").alias("rank"), F.col("gap").alias("at"), F.lit(1).alias("gap"))
    both = requests.unionByName(marks).withColumn("part", F.shiftright("at", PART))
    # of a request and a gap at the same place the gap is not below it
    out = sums_before(both, ["scope", "base"], "part", ["at", "gap"], "gap", "below").where("rank is not null")
    number = (F.col("rank") + F.col("below")).cast("int")
    return out.select("scope", "base", "seq", "rank", number.alias("number"), _key(F.col("base"), number).alias("key"))


def allocate(requests: DataFrame, taken: DataFrame, fallback: str = "item") -> DataFrame:
    """requests: scope, seq (different within a scope, not null), name; taken: scope, key. Adds base and key."""
    steps = Steps(requests.sparkSession, "keys")
    base = F.when(F.coalesce(slug(F.col("name")), F.lit("")) == "", fallback).otherwise(slug(F.col("name"), MOST))
    rows = places(requests.withColumn("base", base), ["scope", "base"], [F.col("seq")], "rank", steps)
    rows = steps.keep(rows, "rows")
    none = F.lit(None).cast(dict(rows.dtypes)["seq"])
    blocked = numbers_of(rows.select("scope", "base").distinct(), taken.select("scope", "key").distinct())
    blocked = steps.keep(blocked.select("*", none.alias("since"), F.lit(True).alias("passed")), "blocked-0")
    own, k = ["scope", "base", "number"], 0
    while True:
        k += 1
        gaps = steps.keep(_ranked(blocked.where("passed")), f"gaps-{k}")
        claims = steps.keep(_claims(rows, gaps), f"claims-{k}")
        # whose turn it is at a blocked number: the request after its free numbers, or the one that has come to it
        turn = gaps.join(claims.select("scope", "base", F.col("seq").alias("turn"), (F.col("rank") - 1).alias("gap")), ["scope", "base", "gap"]).select(*own, "turn")
        turn = turn.unionByName(claims.select(*own, F.col("seq").alias("turn")))
        met = blocked.where("since is not null").join(turn, own).withColumn("passed_now", F.col("turn") > F.col("since")).where("passed <> passed_now")
        met = steps.keep(met.select(*own, "passed_now"), f"turned-{k}")
        if not met.isEmpty():  # numbers below decide those above: once more, before clashes are looked for
            now = blocked.join(met, own, "left").withColumn("passed", F.coalesce("passed_now", "passed")).drop("passed_now")
        else:
            first = claims.groupBy("scope", "key").agg(F.min("seq").alias("holder"), F.count(F.lit(1)).alias("n")).where("n > 1")
            lost = claims.join(first, ["scope", "key"]).where("seq <> holder").groupBy(*own).agg(F.min("holder").alias("since"))
            lost = steps.keep(lost.withColumn("passed", F.lit(True)), f"lost-{k}")
            if lost.isEmpty():
                return rows.drop("rank").join(claims.select("scope", "seq", "key"), ["scope", "seq"])
            every = blocked.unionByName(lost).groupBy(*own).agg(F.max(F.col("since").isNull()).alias("all"), F.min("since").alias("since"))
            now = every.select(*own, F.when(~F.col("all"), F.col("since")).alias("since"), F.lit(True).alias("passed"))
            # what was open stays so until its turn is looked at again
            now = now.join(blocked.where("not passed").select(*own, F.lit(False).alias("open")), own, "left").join(lost.select(*own, F.lit(True).alias("new")), own, "left")
            now = now.withColumn("passed", F.coalesce(F.when(F.col("new").isNull(), F.col("open")), F.col("passed"))).drop("open", "new")
        blocked = steps.keep(now.select(*own, "since", "passed"), f"blocked-{k}")
