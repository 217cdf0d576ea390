"""Intermediate tables in the folder that all executors share.

`spark.checkpoint.dir` names that folder. Only where it is unset (tests on one
machine) a folder of our own takes its place; on a cluster that is an error.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The shared folder, as a URI or path that Spark's readers and writers take."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir is unset: name a folder that driver and executors share")
    own = tempfile.mkdtemp(prefix="granary-")
    atexit.register(shutil.rmtree, own, ignore_errors=True)
    spark.conf.set("spark.checkpoint.dir", own)
    return own


#: Removes a query's shuffle files as it ends, not when the driver next collects its garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


class Scratch:
    """Tables of one operator call; `drop` and `keep` remove those that no later step reads."""

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/granary/{label}-{uuid.uuid4().hex}"

    def save(self, df: DataFrame, name: str, compression: str = "zstd") -> DataFrame:
        """Write df, then read it back: the lineage above it is gone, and with it its shuffle files."""
        path, before = f"{self.root}/{name}", self.spark.conf.get(CLEANUP)
        self.spark.conf.set(CLEANUP, "true")
        try:
            df.write.option("compression", compression).mode("overwrite").parquet(path)
        finally:
            self.spark.conf.set(CLEANUP, before)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, name: str) -> None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)

    def keep(self, *names: str) -> None:
        """Drop all tables but these."""
        root = self.spark._jvm.org.apache.hadoop.fs.Path(self.root)
        for found in root.getFileSystem(self.spark._jsc.hadoopConfiguration()).listStatus(root):
            if (name := found.getPath().getName()) not in names:
                self.drop(name)


def fresh(df: DataFrame, base: str) -> str:
    """A column name that df does not have (names compare without case)."""
    taken, name = {c.lower() for c in df.columns}, base
    while name.lower() in taken:
        name += "_"
    return name
