"""A keyed table on disk whose upserts rewrite the buckets of their keys only.

Rows lie in folders by a hash of the key. An upsert merges the buckets that its keys
fall into and writes those folders over (dynamic partition overwrite); the files of all
others stay as they are. The merged rows are written to `pending` first: an upsert that broke off
while folders were being replaced is finished from there before the table is read
or written again, so a rerun is safe and no row is lost.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from granary.storage import fresh


class KeyedTable:
    def __init__(self, spark: SparkSession, base: str):
        self.spark, self.base = spark, base.rstrip("/")
        head = spark.read.parquet(f"{self.base}/head").first()
        self.key, self.buckets, self.bucket = head["key"], head["buckets"], head["bucket"]
        self.schema = T.StructType.fromJson(json.loads(head["schema"]))
        self._recover()

    @classmethod
    def create(cls, rows: DataFrame, base: str, key: str, buckets: int = 64) -> KeyedTable:
        """A table of these rows, whose keys are distinct; what was below base is overwritten."""
        spark, base, bucket = rows.sparkSession, base.rstrip("/"), fresh(rows, "bucket")
        for name in ("pending", "rows"):
            cls._delete(spark, f"{base}/{name}")
        rows.withColumn(bucket, F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")).repartition(bucket).write.partitionBy(bucket).mode("overwrite").parquet(f"{base}/rows")
        spark.createDataFrame([(key, buckets, bucket, rows.schema.json())], "key string, buckets int, bucket string, schema string").coalesce(1).write.mode("overwrite").parquet(f"{base}/head")
        return cls(spark, base)

    @staticmethod
    def _fs(spark: SparkSession, path: str):
        found = spark._jvm.org.apache.hadoop.fs.Path(path)
        return found.getFileSystem(spark._jsc.hadoopConfiguration()), found

    @classmethod
    def _delete(cls, spark: SparkSession, path: str) -> None:
        fs, found = cls._fs(spark, path)
        fs.delete(found, True)

    def _raw(self) -> DataFrame:
        full = T.StructType([*self.schema.fields, T.StructField(self.bucket, T.IntegerType())])
        fs, path = self._fs(self.spark, f"{self.base}/rows")
        return self.spark.read.schema(full).parquet(f"{self.base}/rows") if fs.exists(path) else self.spark.createDataFrame([], full)

    def rows(self) -> DataFrame:
        self._recover()
        return self._raw().select(*[f"`{c}`" for c in self.schema.names])

    def lookup(self, keys: DataFrame) -> DataFrame:
        """The rows of these keys (a column of the key's name); buckets without one aren't read."""
        self._recover()
        asked = self._placed(keys.select(self.key).distinct())
        return self._raw().join(asked, [self.bucket, self.key], "left_semi").select(*[f"`{c}`" for c in self.schema.names])

    def _placed(self, rows: DataFrame) -> DataFrame:
        return rows.withColumn(self.bucket, F.pmod(F.xxhash64(self.key), F.lit(self.buckets)).cast("int"))

    def _merge(self, new: DataFrame, gone: DataFrame | None) -> list[int]:
        """Write the touched buckets as they will be to `pending`; their numbers."""
        new = self._placed(new.select(*self.schema.names))
        out = new.select(self.bucket, self.key)
        if gone is not None:
            out = out.unionByName(self._placed(gone.select(self.key)).select(self.bucket, self.key))
        touched = [r[0] for r in out.select(self.bucket).distinct().collect()]  # `buckets` at most
        old = self._raw().where(F.col(self.bucket).isin(touched)).join(out, [self.bucket, self.key], "left_anti")
        merged = old.unionByName(new.select(*old.columns), allowMissingColumns=False)
        merged.withColumn("_pending", F.lit(True)).repartition(self.bucket).write.partitionBy(self.bucket).mode("overwrite").parquet(f"{self.base}/pending/rows")
        self.spark.createDataFrame([(b,) for b in touched], "b int").coalesce(1).write.mode("overwrite").parquet(f"{self.base}/pending/touched")  # last: from here on it will be finished
        return touched

    def _recover(self) -> None:
        """Finish an upsert that was written to `pending` whole; forget one that wasn't."""
        fs, path = self._fs(self.spark, f"{self.base}/pending/touched/_SUCCESS")
        if fs.exists(path):
            self._replace([r[0] for r in self.spark.read.parquet(f"{self.base}/pending/touched").collect()])
        self._delete(self.spark, f"{self.base}/pending")

    def _replace(self, touched: list[int]) -> None:
        full = T.StructType([*self.schema.fields, T.StructField("_pending", T.BooleanType()), T.StructField(self.bucket, T.IntegerType())])
        merged = self.spark.read.schema(full).parquet(f"{self.base}/pending/rows").drop("_pending")
        merged.repartition(self.bucket).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(self.bucket).parquet(f"{self.base}/rows")
        left = {r[0] for r in merged.select(self.bucket).distinct().collect()}
        for b in set(touched) - left:  # all rows of the bucket are gone
            self._delete(self.spark, f"{self.base}/rows/{self.bucket}={b}")

    def upsert(self, new: DataFrame, gone: DataFrame | None = None) -> list[int]:
        """Put the rows of new (keys distinct) in the place of those with their keys, and drop the keys of gone; the buckets written."""
        self._recover()
        touched = self._merge(new, gone)
        if touched:
            self._recover()
        return touched
