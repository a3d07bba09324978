"""Tables that a loop writes to the folder all executors share, so that plans stay flat and lost executors cost a reread."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; a temporary folder only where driver and executors are one machine."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    return os.path.join(tempfile.gettempdir(), "typegrove")


def delete(spark: SparkSession, path: str) -> None:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def rename(spark: SparkSession, path: str, to: str) -> None:
    (src, files), (dst, _) = _at(spark, path), _at(spark, to)
    if not files.rename(src, dst):
        raise OSError(f"{path} can't be named {to}")


class Steps:
    """The tables of one loop, removed when the driver exits."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root = spark, f"{folder(spark)}/{name}-{uuid.uuid4().hex}"
        atexit.register(self._forget)

    def _forget(self) -> None:
        try:
            delete(self.spark, self.root)
        except Exception:  # the session may have ended already
            pass

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        """Computes and writes the table once; returns it as read back."""
        df.write.parquet(f"{self.root}/{name}")
        return self.spark.read.schema(df.schema).parquet(f"{self.root}/{name}")

    def drop(self, name: str) -> None:
        delete(self.spark, f"{self.root}/{name}")


# ---- small files beside the tables: whole when they appear, made by one writer only


def _at(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def names(spark: SparkSession, path: str) -> list[str]:
    """What a folder holds, by name; nothing where there is no folder."""
    p, files = _at(spark, path)
    return sorted(s.getPath().getName() for s in files.listStatus(p)) if files.exists(p) else []


def read_text(spark: SparkSession, path: str) -> str | None:
    p, files = _at(spark, path)
    if not files.exists(p):
        return None
    stream = files.open(p)
    try:
        return bytes(stream.readAllBytes()).decode("utf-8", "replace")
    finally:
        stream.close()


def write_text(spark: SparkSession, path: str, text: str) -> None:
    p, files = _at(spark, path)
    stream = files.create(p, True)
    stream.write(bytearray(text.encode()))
    stream.close()


def put_if_absent(spark: SparkSession, path: str, text: str) -> bool:
    """Makes the file with its whole text unless there is one; of several callers one gets True.

    The text is written under a name of its own first, so a crash leaves no part of the file. That file then gets the
    name by a link (local and mounted folders) or by a rename that does not replace (other stores; one that can't do so
    atomically is not fit for manifests).
    """
    jvm, folder_ = spark.sparkContext._jvm, path.rsplit("/", 1)[0]
    own = f"{folder_}/_{uuid.uuid4().hex}"
    write_text(spark, own, text)
    (src, files), (dst, _) = _at(spark, own), _at(spark, path)
    try:
        if files.getScheme() == "file":
            here = lambda p: jvm.java.io.File(p.toUri().getPath()).toPath()
            jvm.java.nio.file.Files.createLink(here(dst), here(src))
        else:
            mode = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
            mode[0] = jvm.org.apache.hadoop.fs.Options.Rename.NONE
            jvm.org.apache.hadoop.fs.FileContext.getFileContext(files.getUri(), spark.sparkContext._jsc.hadoopConfiguration()).rename(src, dst, mode)
        return True
    except Exception:
        if not files.exists(dst):
            raise
        return False
    finally:
        files.delete(src, False)
