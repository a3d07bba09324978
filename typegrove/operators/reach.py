"""Reachability within a number of hops, and publication scopes built on it.

An ``Adjacency`` is both ends of every edge, dealt to buckets by id and sorted, once. Each hop's frontier is a table of the
same buckets, so a hop joins the two bucket by bucket: what is shuffled is what the frontier leads to, never the edges. A
neighbour of a record at hop h is at hop h - 1, h or h + 1, as edges count both ways, so what a hop finds is held against the
last two frontiers only, bucket by bucket again. Tables lie in the folder that all executors share, so plans stay flat and
a lost executor costs a reread. What reaches the driver is the number of records in a frontier.
"""

from __future__ import annotations

import atexit
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.query import Scope
from ..schema import Dataset
from ..shared import Steps
from . import dataset as ds
from .predicates import passes

#: Frontiers up to this number of ids go to every executor, which then read the edges without any order; longer ones meet
#: them by a merge of sorted buckets. The result is the same.
SENT = 100_000


def neighbours(relationships: DataFrame) -> DataFrame:
    """(id, other_id), both directions, each pair once."""
    return ds.adjacency(relationships).select("id", "other_id").where("id <> other_id").distinct()


class Adjacency:
    """(id, other_id) of all edges in buckets by id, to be used for any number of walks; gone when the driver exits.

    Parallel edges are not reduced first: what a hop reaches is.
    """

    def __init__(self, relationships: DataFrame):
        self.spark: SparkSession = relationships.sparkSession
        self.steps = Steps(self.spark, "adjacency")
        self.buckets = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        self.mark, self.made = uuid.uuid4().hex, 0
        atexit.register(self._forget)  # what was found is read from these tables, as late as that may be
        self.near = self._write(ds.adjacency(relationships).select("id", "other_id").where("id <> other_id").repartition(self.buckets, "id"))

    def _forget(self) -> None:
        try:
            for k in range(self.made):
                self.spark.sql(f"DROP TABLE IF EXISTS adjacency_{self.mark}_{k + 1}")
        except Exception:  # the session may have ended already
            pass

    def _write(self, rows: DataFrame) -> str:
        self.made += 1
        name = f"adjacency_{self.mark}_{self.made}"
        rows.write.bucketBy(self.buckets, "id").sortBy("id").option("path", f"{self.steps.root}/{self.made}").format("parquet").saveAsTable(name)
        return name

    def step(self, frontier: str, before: list[str], hop: int, sent: bool) -> DataFrame:
        """What the frontier leads to and the last two frontiers do not hold."""
        own = self.spark.table(frontier).select("id")
        found = self.spark.table(self.near).join(F.broadcast(own) if sent else own.hint("merge"), "id", "left_semi").select(F.col("other_id").alias("id")).distinct()
        for name in before:
            found = found.join(self.spark.table(name).select("id").hint("merge"), "id", "left_anti")
        return found.withColumn("hops", F.lit(hop))

    def reach(self, roots: DataFrame, depth: int | None = None) -> DataFrame:
        """(id, hops) of what is at most ``depth`` hops from the roots; None: all that edges lead to."""
        levels = [self._write(roots.select("id").distinct().withColumn("hops", F.lit(0)))]
        n = self.spark.table(levels[0]).count()
        while n and (depth is None or len(levels) <= depth):
            levels.append(self._write(self.step(levels[-1], levels[-2:], len(levels), n <= SENT)))
            n = self.spark.table(levels[-1]).count()
        out = self.spark.table(levels[0])
        for name in levels[1:]:
            out = out.unionByName(self.spark.table(name))
        return out


def reachable(roots: DataFrame, edges: DataFrame | Adjacency, depth: int | None = None) -> DataFrame:
    """(id, hops) of what is at most ``depth`` hops from the roots; None: all that edges lead to.

    Depth 0 gives the roots themselves, whether or not they have edges or exist. One hop over edges that are no
    ``Adjacency`` yet takes one join and no table.
    """
    seen = roots.select("id").distinct().withColumn("hops", F.lit(0))
    if depth == 0:
        return seen
    if isinstance(edges, Adjacency):
        return edges.reach(roots, depth)
    if depth == 1:
        near = ds.adjacency(edges).select("id", "other_id")
        step = seen.select("id").join(near, "id").select(F.col("other_id").alias("id")).distinct()
        return step.join(seen, "id", "left_anti").withColumn("hops", F.lit(1)).unionByName(seen)
    return Adjacency(edges).reach(roots, depth)


def expansion_seeds(dataset: Dataset, object_ids: DataFrame, edge_ids: DataFrame) -> DataFrame:
    """Objects named, and both ends of edges named."""
    ends = dataset.relationships.join(edge_ids.select("id"), "id", "left_semi").select(F.explode(F.array("source_id", "target_id")).alias("id"))
    return object_ids.select("id").unionByName(ends).distinct()


def apply_scope(dataset: Dataset, scope: Scope, exact: bool = False) -> Dataset:
    """The part of a dataset that a publication shows: exclusions and filters, then what the roots still reach.

    Exclusions win over reachability. Roots that do not survive them give an empty result, not the whole. Types stay
    listed without records; rules that name an excluded type go.
    """
    spark = dataset.objects.sparkSession
    out = lambda col, ids: F.lit(True) if not ids else ~F.col(col).isin(*ids)
    kept = out("type_id", scope.exclude_objects) & passes(scope.filters, exact)
    objects = dataset.objects.where(out("type_id", scope.exclude_objects)).where(passes(scope.filters, exact))
    ids = objects.select("id")

    def between(edges: DataFrame, ids: DataFrame) -> DataFrame:
        edges = edges.join(ids.withColumnRenamed("id", "source_id"), "source_id", "left_semi")
        return edges.join(ids.withColumnRenamed("id", "target_id"), "target_id", "left_semi")

    if dataset.links is not None:  # edges of a type that lacks its ends' types are not even read
        edges = dataset.links.where(kept, out("type_id", scope.exclude_relationships)).between()
    else:
        edges = between(dataset.relationships.where(out("type_id", scope.exclude_relationships)), ids)
    if scope.roots:
        roots = spark.createDataFrame([(r,) for r in scope.roots], "id string").join(ids, "id", "left_semi")
        reached = reachable(roots, edges, scope.depth).select("id")
        objects = objects.join(reached, "id", "left_semi")
        edges = between(edges, reached)
    rules = dataset.rules.where(out("subject_type_id", scope.exclude_objects) & out("object_type_id", scope.exclude_objects) & out("rel_type_id", scope.exclude_relationships))
    return dataset.with_(
        objects=objects,
        relationships=edges,
        rules=rules,
        object_types=dataset.object_types.where(out("id", scope.exclude_objects)),
        relationship_types=dataset.relationship_types.where(out("id", scope.exclude_relationships)),
    )
