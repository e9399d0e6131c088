"""Intermediate tables in the folder that all executors share.

``spark.checkpoint.dir`` names that folder.  Only a local session may go
without it; it then gets a folder of its own.  A table written here cuts the
lineage: a lost executor costs a re-read, never a recomputation of the
operators above it.  Folders go when the application ends, at the latest;
``release`` removes them before, once results that read them are no longer needed.
"""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_local: dict[str, str] = {}
_made: list[str] = []


def shared_folder(spark: SparkSession) -> str:
    """The session's shared folder; a temporary one only in local mode."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _local:
        _local[app] = tempfile.mkdtemp(prefix="isoreach-")
    return _local[app]


def _deleted(spark: SparkSession, *folders: str) -> None:
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for folder in folders:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(conf).delete(path, True)


def release(spark: SparkSession) -> None:
    """Delete all intermediate tables of this process, and with them what lazy results still read."""
    _deleted(spark, *_made)
    _made.clear()


class Scratch:
    """Parquet tables of one operator run; ``drop`` removes those no longer read."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
        self.tags: set[str] = set()
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.root)
        files = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        files.mkdirs(path)
        files.deleteOnExit(path)
        _made.append(self.root)

    def table(self, df: DataFrame, tag: str) -> DataFrame:
        """Write ``df`` and return the written table."""
        path = f"{self.root}/{tag}"
        df.write.option("compression", "zstd").parquet(path)
        self.tags.add(tag)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *tags: str) -> None:
        """Delete tables by tag once nothing reads them any more."""
        _deleted(self.spark, *[f"{self.root}/{tag}" for tag in tags])
        self.tags -= set(tags)

    def sweep(self) -> None:
        """Let Spark delete the shuffles of what is written by now, which else stay until the driver happens to collect its garbage."""
        gc.collect()
        self.spark.sparkContext._jvm.System.gc()

    def result(self, df: DataFrame, tag: str) -> DataFrame:
        """Write ``df`` and delete all other tables of this run."""
        written = self.table(df, tag)
        self.drop(*(self.tags - {tag}))
        return written
