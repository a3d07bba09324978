"""Uploaded sources between upload and import: which are kept, which are replaced or swept."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def replaced(uploads: DataFrame) -> DataFrame:
    """Uploads without the staged ones that a later staged one of the same user and model replaces; imported ones stay."""
    staged = F.col("imported_at").isNull()
    last = F.row_number().over(Window.partitionBy("model_id", "uploaded_by", staged).orderBy(F.desc("created_at"), F.desc("id")))
    return uploads.withColumn("__last", last).where(~staged | (F.col("__last") == 1)).drop("__last")


def swept(uploads: DataFrame, proposals: DataFrame, cutoff: Column) -> DataFrame:
    """Uploads that something still refers to: staged since the cutoff, or imported by a change-set that exists."""
    there = proposals.select(F.col("id").alias("proposal_id"), F.lit(True).alias("__there")).distinct()
    staged = F.col("imported_at").isNull()
    rows = uploads.join(there, "proposal_id", "left")
    return rows.where((staged & (F.col("created_at") >= cutoff)) | (~staged & F.coalesce("__there", F.lit(False)))).drop("__there")
