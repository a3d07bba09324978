"""Order MinHash fingerprints (DataFrame functions only).

k-mers of words are numbered by occurrence; each pair of k-mer and number has a hash of its own. The hash's top bits deal
the pairs to ``buckets`` groups; in each the ``keep`` least are selected, and their k-mers are put back in text order and
hashed as a tuple. Texts that
share words in another order agree in fewer tuples than under plain MinHash, so likeness follows edit distance. The
likeness of two fingerprints is the share of equal tuples among the buckets that either fills.

A sort by k-mer and place makes equal k-mers neighbours, earlier ones first, and so numbers them; a first occurrence
keeps the k-mer's hash, later ones hash it with their number. A second sort, of texts that repeat a k-mer, replaces a
pass per hash function.

Defined results: null and wordless texts have the empty fingerprint, likeness 1 to each other and 0 to the rest; texts
of fewer than ``k`` words have their whole sequence as the one k-mer; equal texts have equal fingerprints. A very long
text is one row's list of k-mer hashes, sorted twice. Rows without doc_id come first, rows of one doc_id are ordered by
text; other columns are not looked at; no rows give no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

#: Number of buckets as a power of two, k-mers kept in each, words in a k-mer.
BITS, KEEP, K = 6, 2, 2


def signature(text: Column, bits: int = BITS, keep: int = KEEP, k: int = K) -> Column:
    """array<long>, ascending by bucket: the bucket's number in the upper half, its tuple's hash in the lower."""

    def kmers(w):
        whole = F.array(F.struct(F.xxhash64(F.array_join(w, " ")).alias("h"), F.lit(0).alias("at")))
        many = F.transform(F.slice(w, 1, F.greatest(F.array_size(w) - (k - 1), F.lit(0))), lambda x, i: F.struct(F.xxhash64(x, *[F.get(w, i + j) for j in range(1, k)]).alias("h"), i.alias("at")))
        return F.when(F.array_size(w) == 0, F.array().cast("array<struct<h:bigint,at:int>>")).when(F.array_size(w) < k, whole).otherwise(many)

    def numbered(s):
        """Ascending structs of the hash of k-mer and occurrence, place, and the k-mer's own hash."""
        first = F.filter(F.transform(s, lambda x, i: F.when((i == 0) | (F.get(s, i - 1)["h"] != x["h"]), i)), lambda i: i.isNotNull())

        def runs(starts):
            def run(i, r):
                own = F.slice(s, i + 1, F.coalesce(F.get(starts, r + 1), F.array_size(s)) - i)
                return F.transform(own, lambda y, j: F.struct(F.when(j == 0, y["h"]).otherwise(F.xxhash64(j, y["h"])).alias("h"), y["at"].alias("at"), y["h"].alias("kmer")))

            once = F.transform(s, lambda y: F.struct(y["h"].alias("h"), y["at"].alias("at"), y["h"].alias("kmer")))
            return F.when(F.array_size(starts) == F.array_size(s), once).otherwise(F.array_sort(F.flatten(F.transform(starts, run))))

        return common.let(first, runs)

    def bucket(x):
        return F.shiftright(x["h"], 64 - bits)

    def least(s):
        return F.filter(s, lambda x, i: (i < keep) | (bucket(F.get(s, i - keep)) != bucket(x)))

    def tuples(s):
        first = F.filter(F.transform(s, lambda x, i: F.when((i == 0) | (bucket(F.get(s, i - 1)) != bucket(x)), i)), lambda i: i.isNotNull())

        def of(i):
            own = F.filter(F.slice(s, i + 1, keep), lambda y: bucket(y) == bucket(F.get(s, i)))
            ordered = F.array_sort(F.transform(own, lambda y: F.struct(y["at"].alias("at"), y["kmer"].alias("kmer"))))
            hashed = F.xxhash64(F.transform(ordered, lambda y: y["kmer"]))
            return F.shiftleft(bucket(F.get(s, i)), 32).bitwiseOR(hashed.bitwiseAND(F.lit(0xFFFFFFFF)))

        return F.transform(first, of)

    return common.let(common.words_of(text), lambda w: common.let(F.array_sort(kmers(w)), lambda s: common.let(numbered(s), lambda p: common.let(least(p), tuples))))


def likeness(a: Column, b: Column) -> Column:
    filled = F.array_size(F.array_union(F.transform(a, lambda x: F.shiftright(x, 32)), F.transform(b, lambda x: F.shiftright(x, 32))))
    return F.when(filled == 0, F.lit(1.0)).otherwise(F.array_size(F.array_intersect(a, b)) / filled)


def shown(sig: Column) -> Column:
    """The fingerprint as text: each tuple as 16 hexadecimal digits, comma-joined."""
    return F.array_join(F.transform(sig, lambda x: F.lpad(F.hex(x), 16, "0")), ",")


def with_next(docs: DataFrame, columns: list[str], each: int = 1 << 15) -> DataFrame:
    """``docs`` with ``next_<column>`` of the next row by ascending doc_id (after the last, the first), in one shuffle.

    Rows are dealt to ranges of doc_id that begin at an id that occurs, one task a range and about ``each`` rows at most.
    A range's first row also goes, as a guest, to the range before it, and the first of all to the last range; so each
    range finds its neighbours on its own.
    """
    spark = docs.sparkSession
    n, first = docs.agg(F.count(F.lit(1)), F.min("doc_id")).first()
    wanted = max(common.parallelism(spark), common.buckets_for(n, each))
    bounds = [b for b in common.range_bounds(docs, "doc_id", wanted) if b != first]
    here = common.bucket_of(F.coalesce(F.col("doc_id"), F.lit(first)), bounds)
    begins = (common.bucket_of(F.col("doc_id") - 1, bounds) < here) if bounds else F.lit(False)  # the id is a bound
    guest = F.when(F.col("doc_id") == first, F.lit(len(bounds))).when(begins, here - 1)
    dealt = F.array_compact(F.array(F.struct(here.alias("range"), F.lit(0).alias("guest")), F.when(guest.isNotNull(), F.struct(guest.cast("int").alias("range"), F.lit(1).alias("guest")))))
    rows = docs.withColumn("__deal", F.explode(dealt)).select("*", "__deal.range", "__deal.guest").drop("__deal")
    rows = rows.repartitionById(len(bounds) + 1, "range")
    tie = F.xxhash64(*columns)
    order = Window.partitionBy("range").orderBy("guest", F.col("doc_id").asc_nulls_first(), tie)
    rows = rows.withColumns({f"next_{c}": F.lead(c).over(order) for c in columns})
    return rows.where("guest = 0").drop("range", "guest")


def order_minhash(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, texts' and edited texts' fingerprints, and both likenesses."""
    rows = docs.select("doc_id", common.text_of().alias("text")).withColumn("sig", signature(F.col("text")))
    rows = with_next(rows, ["text", "sig"])
    n = F.char_length("text")
    cut = F.floor(n / 4).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), n - cut), F.substring(F.coalesce("next_text", F.lit("")), F.lit(1), cut))
    rows = rows.select("doc_id", n.cast("long").alias("n_chars"), "sig", F.col("next_sig"), edited.alias("edited"))
    rows = rows.withColumn("edited_sig", signature(F.col("edited")))
    return rows.select("doc_id", "n_chars", "edited", "sig", "edited_sig", likeness(F.col("sig"), F.col("edited_sig")).alias("near_edited"), likeness(F.col("sig"), F.col("next_sig")).alias("near_next"))


def op6_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = order_minhash(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return out.select("doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), shown(F.col("sig")).alias("fingerprint"), shown(F.col("edited_sig")).alias("edited_fingerprint"), "near_edited", "near_next")
