"""The change log as a stream: change rows arrive as files, each batch is committed to a model in turn."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.commit import Model
from ..schema import CHANGES


def read_changes(spark: SparkSession, path: str) -> DataFrame:
    return spark.readStream.schema(CHANGES).parquet(path)


def commit_stream(changes: DataFrame, model: Model, checkpoint: str, rejected: str):
    """Starts a query that commits each batch as one change-set; issues of rejected ones go to a table.

    A batch that is replayed after a failure is committed once: its token is in the model's manifest.
    """

    def commit(batch: DataFrame, batch_id: int) -> None:
        if batch.isEmpty():
            return
        outcome = model.commit(batch, token=f"{checkpoint}#{batch_id}")
        if not outcome.committed:
            outcome.issues.write.mode("overwrite").parquet(f"{rejected}/batch_id={batch_id}")

    return changes.writeStream.foreachBatch(commit).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def change_counts(changes: DataFrame, time: str = "ts", window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Changes per operation and window of event time; what comes later than ``late`` is not counted."""
    return changes.withWatermark(time, late).groupBy(F.window(time, window), "operation").agg(F.count(F.lit(1)).alias("n"))
