"""Line dedup by levelled sorted runs of line hashes.

Documents come in batches of ascending ``doc_id``. The state is a set of runs, tables of (line hash, first document),
bucketed and sorted by hash. A batch reduces its lines to first holders, dealt to the same buckets, and merge-joins them
with each run in turn, bucket by bucket, so that no run is shuffled again: what no run holds is added as a run of level
0, what a run holds or the batch repeats is looked up for its lines. ``fanout`` runs of a level are merged, bucket by
bucket, into one of the next level, so a lookup meets fewer than ``fanout`` runs a level and a hash is rewritten once a
level.

Texts are split into lines once, for all batches. Shuffled are only hashes, ids and positions, and the texts once for
rewriting. The hottest lines are reduced before the shuffle (first holders) or split by adaptive execution (lookups).

Defined results: a null text is one empty line; a row without ``doc_id`` neither owns nor loses lines; rows that share
a ``doc_id`` are one document (each keeps or loses lines alike); a very long text is split and joined in its own row;
columns of the input named as those that are added are replaced, others pass through untouched; no rows give no rows.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: Names of helper columns, apart from any that a table may have.
ROW, DROPPED = "__text_hash", "__dropped_lines"
RUN = "h1 long, h2 long, owner long"


class LineRuns:
    """The levelled runs. ``levels[k]`` lists the tables of the runs of level k, oldest first.

    A run's files lie in the shared folder; its table is only known to the session.
    """

    def __init__(self, spark: SparkSession, fanout: int = 2):
        self.spark, self.fanout, self.buckets = spark, max(2, fanout), common.parallelism(spark)
        self.scratch = common.Scratch(spark, "line-runs")
        self.levels: list[list[str]] = [[]]
        self.mark, self.made = uuid.uuid4().hex, 0

    def names(self) -> list[str]:
        return [x for level in self.levels for x in level]

    def run(self, name: str) -> DataFrame:
        return self.spark.table(name)

    def read(self, names: list[str]) -> DataFrame:
        out = self.spark.createDataFrame([], RUN)
        for name in names:
            out = out.unionByName(self.run(name))
        return out

    def _write(self, df: DataFrame, kind: str) -> str:
        """A table in buckets by hash, each sorted. ``df`` is dealt by hash already, so a task writes one bucket."""
        self.made += 1
        name = f"line_{kind}_{self.mark}_{self.made}"
        df.write.bucketBy(self.buckets, "h1", "h2").sortBy("h1", "h2").option("path", self.scratch.path(name)).format("parquet").saveAsTable(name)
        return name

    def forget(self, name: str) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {name}")
        self.scratch.drop(name)

    def merged(self, lines: DataFrame) -> DataFrame:
        """The batch's different hashes: h1, h2, n lines, first (of the batch), held (the owner by the runs, if any)."""
        firsts = lines.groupBy("h1", "h2").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("n")).withColumn("held", F.lit(None).cast("long"))
        for name in self.names():
            run = self.run(name).withColumnRenamed("owner", "__owner").hint("merge")
            firsts = firsts.join(run, ["h1", "h2"], "left").withColumn("held", F.coalesce("held", "__owner")).drop("__owner")
        return firsts

    def add(self, lines: DataFrame) -> DataFrame:
        """Adds the hashes of a batch (columns h1, h2, doc_id) that no run holds yet.

        Returns (h1, h2, owner) of those of its hashes that more than one line has, whose table ``forget_batch`` drops.
        """
        self.batch = self._write(self.merged(lines), "batch")
        met = self.spark.table(self.batch)
        new = met.where("held is null").select("h1", "h2", F.col("first").alias("owner"))
        self.levels[0].append(self._write(new, "run"))
        self.compact()
        return met.where("held is not null or n > 1").select("h1", "h2", F.coalesce("held", "first").alias("owner"))

    def forget_batch(self) -> None:
        self.forget(self.batch)

    def compact(self) -> None:
        """Merges every full level into one run of the next, bucket by bucket; runs never share a hash."""
        for k in range(len(self.levels)):
            if len(self.levels[k]) >= self.fanout:
                full, self.levels[k] = self.levels[k], []
                if k + 1 == len(self.levels):
                    self.levels.append([])
                one = full[0]
                for name in full[1:]:
                    pair = (one, name)
                    one = self._write(self.both(*pair), "run")
                    for merged in pair:
                        self.forget(merged)
                self.levels[k + 1].append(one)

    def both(self, one: str, other: str) -> DataFrame:
        """Two runs as one, by a merge join of their buckets."""
        more = self.run(other).withColumnRenamed("owner", "__owner").hint("merge")
        return self.run(one).join(more, ["h1", "h2"], "full").withColumn("owner", F.coalesce("owner", "__owner")).drop("__owner")

    def drop(self) -> None:
        for name in self.names():
            self.forget(name)
        self.scratch.drop()


def line_hashes(docs: DataFrame, min_chars: int) -> DataFrame:
    """One row per line whose key is long enough: doc_id, text hash, position, and 128 bits of the key in two longs."""
    keys = F.split(common.ascii_lower(common.text_of()), "\n")
    lines = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(common.text_of()).alias(ROW), F.posexplode(keys).alias("pos", "line"))
    key = F.btrim("line", F.lit(common.STRIP))
    lines = lines.select("doc_id", ROW, "pos", key.alias("key")).where(F.char_length("key") >= min_chars)
    return lines.select("doc_id", ROW, "pos", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(7), F.col("key")).alias("h2"))


def dedup_lines(docs: DataFrame, min_chars: int = 10, docs_a_batch: int = 200_000_000, batches: int = 4, fanout: int = 2, prefix: str = "") -> DataFrame:
    """``docs`` with ``kept_text``, ``n_lines`` and ``n_dropped``: every repeated line stays only in the smallest ``doc_id``.

    There are ``batches`` batches at least, more where ``docs_a_batch`` documents a batch need them. ``prefix`` goes before
    the names of the three columns.
    """
    spark = docs.sparkSession
    runs, out = LineRuns(spark, fanout), common.Scratch(spark, "line-drops")
    ids = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"))
    bounds = common.range_bounds(ids, "doc_id", max(batches, common.buckets_for(ids.count(), docs_a_batch)))
    lines = line_hashes(docs, min_chars).withColumn("batch", common.bucket_of(F.col("doc_id"), bounds))
    lines.write.partitionBy("batch").parquet(out.path("lines"))  # one pass over the texts
    lines = spark.read.schema(lines.schema).parquet(out.path("lines"))
    lost = spark.createDataFrame([], f"doc_id long, {ROW} long, {DROPPED} array<int>")
    for k in range(len(bounds) + 1):
        own = lines.where(F.col("batch") == k).drop("batch")
        owners = runs.add(own)
        gone = own.join(owners, ["h1", "h2"]).where("owner < doc_id").groupBy("doc_id", ROW).agg(F.array_distinct(F.collect_list("pos")).alias(DROPPED))
        lost = lost.unionByName(out.keep(gone, f"batch-{k}"))
        runs.forget_batch()
    runs.drop()
    out.drop("lines")
    names = common.fresh(docs.columns, "__id", "__row", DROPPED)
    lost = lost.toDF(*names)
    # A document's list is a few bytes for each line it loses: hashed, so that the texts need no sort.
    rows = docs.join(lost.hint("shuffle_hash"), (F.col("doc_id") == F.col(names[0])) & (F.xxhash64(common.text_of()) == F.col(names[1])), "left")
    return rewrite(rows, prefix, names[2]).drop(*names)


def rewrite(rows: DataFrame, prefix: str = "", dropped: str = DROPPED) -> DataFrame:
    """Drops the positions that the column ``dropped`` lists from each text; linear in the text, whatever share of it goes."""
    text = common.text_of()

    def joined(lines):
        kept = F.array_except(F.sequence(F.lit(0), F.array_size(lines) - 1), F.col(dropped))
        return F.array_join(F.transform(kept, lambda i: F.get(lines, i)), "\n")

    lines = F.split(text, "\n")
    n_lines = F.octet_length(text) - F.octet_length(F.replace(text, F.lit("\n"), F.lit(""))) + 1
    rows = rows.withColumns({f"{prefix}n_lines": n_lines.cast("long"), f"{prefix}n_dropped": F.coalesce(F.array_size(dropped), F.lit(0)).cast("long")})
    return rows.withColumn(f"{prefix}kept_text", F.when(F.col(dropped).isNull(), text).otherwise(common.let(lines, joined)))


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = dedup_lines(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return done.select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


ORACLE = r"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
  FROM documents),
keyed AS (
  SELECT doc_id, pos, line,
         translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM lines),
owners AS (SELECT k, min(doc_id) AS owner FROM keyed WHERE length(k) >= 10 GROUP BY k),
marked AS (
  SELECT doc_id, pos, line, coalesce(owner < doc_id, false) AS gone
  FROM keyed LEFT JOIN owners USING (k))
SELECT doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (gone)::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""
