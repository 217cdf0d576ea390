"""First-kept near-dup removal in batches, against a kept corpus on disk.

Batches come one after the other, and what an earlier one kept stays. A new text is
dropped if a kept one is alike, so only kept texts are stored: their shingle sets
(`sets`) and the rows of their prefixes (`prefix`), which a new batch joins with its own.
A prefix needs one order of all shingles, the same in each batch: by hash, but those that
stand in many prefixes of the first batch (`late`) come last. Any fixed order gives right
results; this one keeps frequent shingles out. Whole sets are dealt out only where they are
weighed, or stored.

What no kept text drops is settled within the batch by the same rule. Equal sets are one class from
the start. Where each batch's ids come after the last one's, two batches give what one
run over both gives. Tables of a batch are written before its line in `batches`, which
counts it; the same batch again, before or after that, gives the same verdicts.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.operators import dedup
from granary.storage import Scratch


class Corpus:
    """The kept texts below `base`."""

    def __init__(self, spark: SparkSession, base: str, threshold: float = 0.90, k: int = 5):
        self.spark, self.base, self.threshold, self.k = spark, base.rstrip("/"), threshold, k

    def _exists(self, name: str) -> bool:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.base}/{name}")
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path)

    def batches(self) -> list[int]:
        """The numbers of the batches that count."""
        return sorted(r[0] for r in self.spark.read.parquet(f"{self.base}/batches").select("batch").collect()) if self._exists("batches") else []

    def _table(self, name: str, before: int) -> DataFrame | None:
        done = [b for b in self.batches() if b < before]
        return self.spark.read.parquet(f"{self.base}/{name}").where(F.col("batch").isin(done)).drop("batch") if done else None

    def _put(self, df: DataFrame, name: str, batch: int) -> DataFrame:
        df.write.mode("overwrite").parquet(f"{self.base}/{name}/batch={batch}")
        return self.spark.read.schema(df.schema).parquet(f"{self.base}/{name}/batch={batch}")

    def add(self, docs: DataFrame, batch: int | None = None, key: str = "doc_id", text: str = "text", native: bool = False) -> DataFrame:
        """(id, kept) of a batch's texts, by the order of their ids; ids are distinct. What stays is part of the corpus from now on."""
        done = self.batches()
        batch = (done[-1] + 1 if done else 0) if batch is None else batch
        if done and batch < done[-1]:
            raise ValueError(f"batch {batch} after batch {done[-1]}")
        scratch = Scratch(self.spark, "batch")
        signs = scratch.save(dedup.signatures(docs, self.k, key, text, native), "signs")
        of = scratch.save(dedup.classes(signs), "classes")
        reps = of.where("id = rep").select("id")
        if batch == 0:
            order = self._put(self.spark.createDataFrame(pa.table({"item": dedup.late_items(signs, self.threshold)})), "late", 0)
        else:
            order = self.spark.read.parquet(f"{self.base}/late/batch=0")
        late = self.spark.sparkContext.broadcast(np.sort(np.asarray(order.select("item").toArrow().column(0), np.int64)))
        prefix = scratch.save(dedup.prefixes(signs, self.threshold, late).join(reps, "id", "left_semi"), "prefix")
        known, rows = self._table("prefix", batch), self._table("sets", batch)
        left = reps
        if known is not None:
            met = scratch.save(dedup.candidates(known.select("id", "item", "n"), prefix, self.threshold), "met")
            alike = dedup.weighed(met, rows.select("id", "items"), signs).where(F.col("jaccard") >= self.threshold)
            old = scratch.save(alike.select(F.col("b").alias("id")).distinct(), "old")
            left = scratch.save(reps.join(old, "id", "left_anti"), "left")
        # only what no earlier batch drops can keep or drop others
        open_ = prefix if known is None else prefix.join(left, "id", "left_semi")
        near = scratch.save(dedup.candidates(open_, open_, self.threshold).where("a < b"), "near")
        linked = dedup.weighed(near, signs, signs).where(F.col("jaccard") >= self.threshold)
        gone = scratch.save(dedup.first_independent(linked), "gone")
        kept = scratch.save(left.join(gone, "id", "left_anti"), "kept")
        empty = self._put(signs.where(F.size("items") == 0).agg(F.min("id").alias("id")).where("id IS NOT NULL"), "empty", batch)
        seen = self._table("empty", batch)
        first = empty if seen is None or seen.isEmpty() else empty.limit(0)
        good = kept.select("id").unionByName(first).withColumn("good", F.lit(True))
        self._put(signs.join(kept, "id", "left_semi"), "sets", batch)
        self._put(prefix.join(kept, "id", "left_semi").select("id", "item", "n"), "prefix", batch)
        verdict = self._put(signs.select("id").join(good, "id", "left").select("id", F.col("good").isNotNull().alias("kept")), "verdicts", batch)
        self._put(verdict.agg(F.count("*").alias("texts"), F.coalesce(F.sum(F.col("kept").cast("long")), F.lit(0)).alias("kept")).coalesce(1), "batches", batch)
        return verdict

    def verdicts(self) -> DataFrame:
        """(id, kept) of all batches."""
        return self.spark.read.parquet(f"{self.base}/verdicts").where(F.col("batch").isin(self.batches())).select("id", "kept")
