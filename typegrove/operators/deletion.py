"""Deleting a model from tables that hold many: in an order that leaves no names of what is gone, by a journal that can be resumed.

Tables lie under one folder, each partitioned by ``model_id``. A deletion first makes its journal, a file that appears whole
and once; from then on views leave the model out, so a half-deleted model is never seen. Then the tables go one after the
other, each noted in the journal when it is gone. Whoever finds an unfinished journal goes on with it; steps can be done
twice.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from urllib.parse import quote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shared import delete, names, put_if_absent, read_text
from .tasks import DELETE_ORDER, deletable


class Tables:
    """Tables of many models under a folder that all executors share."""

    def __init__(self, spark: SparkSession, path: str, order: tuple[str, ...] = DELETE_ORDER):
        self.spark, self.path, self.order = spark, path.rstrip("/"), order

    def write(self, table: str, rows: DataFrame) -> None:
        rows.write.mode("append").partitionBy("model_id").parquet(f"{self.path}/{table}")

    def _journals(self) -> list[str]:
        """Ids of models whose deletion has begun."""
        files = names(self.spark, f"{self.path}/deletions")
        return [json.loads(read_text(self.spark, f"{self.path}/deletions/{x}"))["model_id"] for x in files if x.endswith(".begun.json")]

    def read(self, table: str) -> DataFrame:
        """A table without the models whose deletion has begun: a list as long as there are deletions."""
        return self.spark.read.option("basePath", f"{self.path}/{table}").parquet(f"{self.path}/{table}").where(~F.col("model_id").cast("string").isin(self._journals()))

    def _mark(self, model_id: str, step: str) -> bool:
        name = f"{self.path}/deletions/{quote(model_id, safe='')}.{step}.json"
        return put_if_absent(self.spark, name, json.dumps({"model_id": model_id, "step": step}))

    def _done(self, model_id: str) -> set[str]:
        head = f"{quote(model_id, safe='')}."
        return {x[len(head) : -len(".json")] for x in names(self.spark, f"{self.path}/deletions") if x.startswith(head)}

    def delete(self, model_id: str, models: DataFrame, proposals: DataFrame, between: Callable[[str], None] = lambda table: None) -> None:
        """Deletes a model that has no queued or processing change-set. ``between`` is called before each table."""
        if deletable(models, proposals).where(F.col("id") == model_id).isEmpty():
            raise ValueError("the model does not exist, or has a change-set that is being processed")
        self._mark(model_id, "begun")
        self._go_on(model_id, between)

    def _go_on(self, model_id: str, between: Callable[[str], None] = lambda table: None) -> None:
        done = self._done(model_id)
        for table in self.order:
            if table not in done:
                between(table)
                delete(self.spark, f"{self.path}/{table}/model_id={quote(model_id, safe='')}")
                self._mark(model_id, table)

    def resume(self) -> list[str]:
        """Goes on with deletions that were left unfinished; their models' ids."""
        open_ = [m for m in self._journals() if not set(self.order) <= self._done(m)]
        for model_id in open_:
            self._go_on(model_id)
        return open_
