"""Tables in buckets, of which a revision lists the files: what a commit does not touch is shared by all revisions.

A table's rows are dealt to buckets by the hash of their key. A bucket is a folder that is written once and never changed.
The index of a revision names the folder of every bucket, so a new revision writes the buckets that changed and repeats
the names of the others. An index is metadata of a line a bucket; rows never pass the driver.

Each task writes its rows to a file of each bucket: a table is neither shuffled nor sorted to be written.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..shared import names, read_text, write_text

BUCKET = "store_bucket"
#: So many files are open in a task at once, of so many bytes held each, instead of a sort by bucket.
OPEN, HELD = "spark.sql.maxConcurrentOutputFileWriters", 16 << 20
#: Key columns of the tables that are dealt to many buckets; others have one.
KEYS = {"objects": ("id",), "relationships": ("id",), "counts": ("id",), "keys": ("type_id", "key")}


class Index:
    """The tables of one revision: schema, number of buckets, and the folder of each bucket that has rows."""

    def __init__(self, tables: dict | None = None):
        self.tables = {k: {**v, "files": dict(v["files"])} for k, v in (tables or {}).items()}

    def copy(self) -> Index:
        return Index(self.tables)

    def files(self, table: str) -> dict[str, str]:
        return self.tables[table]["files"]


class Store:
    def __init__(self, spark: SparkSession, path: str, buckets: int):
        self.spark, self.path, self.buckets = spark, path, buckets

    def number(self, index: Index | None, table: str, *key: Column) -> Column:
        n = index.tables[table]["buckets"] if index and table in index.tables else self.buckets if table in KEYS else 1
        return F.pmod(F.xxhash64(*key), F.lit(n)).cast("int") if n > 1 else F.lit(0)

    def touched(self, index: Index, table: str, rows: DataFrame) -> list[int]:
        """The buckets that the keys of ``rows`` fall into: as many numbers as there are buckets at most."""
        if index.tables[table]["buckets"] == 1:
            return [0]
        return sorted(r[0] for r in rows.select(self.number(index, table, *map(F.col, KEYS[table]))).distinct().collect())

    def read(self, index: Index, table: str, only: list[int] | None = None) -> DataFrame:
        """The table, or some of its buckets: only their files are listed and read."""
        t = index.tables[table]
        schema = StructType.fromJson(json.loads(t["schema"]))
        paths = [f"{self.path}/{folder}/{BUCKET}={b}" for b, folder in t["files"].items() if only is None or int(b) in only]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def write(self, index: Index, table: str, rows: DataFrame, name: str, only: list[int] | None = None) -> None:
        """Writes ``rows``, the whole content of the buckets ``only`` (None: of all), and lists them in ``index``."""
        folder = f"{name}/{table}-{uuid.uuid4().hex[:8]}"
        first = table not in index.tables
        number = self.number(index, table, *(F.col(c) for c in KEYS.get(table, ())))
        schema = rows.schema if first else StructType.fromJson(json.loads(index.tables[table]["schema"]))
        rows = rows.select(*[F.col(f.name).cast(f.dataType) for f in schema.fields]).withColumn(BUCKET, number)
        self._write(rows if table in KEYS else rows.repartition(BUCKET), f"{self.path}/{folder}")
        made = [x.split("=")[1] for x in names(self.spark, f"{self.path}/{folder}") if x.startswith(f"{BUCKET}=")]
        if first:
            for f in schema.fields:
                f.nullable = True
            index.tables[table] = {"schema": schema.json(), "buckets": self.buckets if table in KEYS else 1, "files": {}}
        files = index.files(table)
        for b in list(files) if only is None else map(str, only):
            files.pop(b, None)
        files.update({b: folder for b in made})

    def _write(self, rows: DataFrame, path: str) -> None:
        before = self.spark.conf.get(OPEN, None)
        self.spark.conf.set(OPEN, str(self.buckets))
        try:
            rows.write.option("parquet.block.size", HELD).partitionBy(BUCKET).parquet(path)
        finally:
            self.spark.conf.unset(OPEN) if before is None else self.spark.conf.set(OPEN, before)

    def save(self, index: Index, name: str, **more) -> None:
        write_text(self.spark, f"{self.path}/{name}/index.json", json.dumps({"tables": index.tables, **more}))

    def load(self, name: str) -> tuple[Index, dict]:
        found = json.loads(read_text(self.spark, f"{self.path}/{name}/index.json"))
        return Index(found.pop("tables")), found
