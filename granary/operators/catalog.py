"""Upkeep of keyed tables: upsert, foreign keys, cascades, counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The tables' columns.
TABLES = {
    "documents": "doc_id string, title string, tags_json string, tech_json string, dates_json string, source_path string, content_hash string",
    "chunks": "chunk_id string, doc_id string, section_path string, norm_text string, token_count int",
    "paraphrase_cache": "cache_key string, input_hash string, style_hash string, params_hash string, output_text string",
}


def upsert(table: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """table with the rows of new put in the place of those with their keys."""
    return table.join(new.select(key), key, "left_anti").select(*table.columns).unionByName(new.select(*table.columns))


def latest(rows: DataFrame, key: str, by: list[str | Column]) -> DataFrame:
    """The last row of each key: what upserts one after the other would leave."""
    w = Window.partitionBy(key).orderBy(*[F.desc(c) if isinstance(c, str) else c for c in by])
    return rows.withColumn("_at", F.row_number().over(w)).where("_at = 1").drop("_at")


def orphans(child: DataFrame, parent: DataFrame, child_key: str, parent_key: str) -> DataFrame:
    """Rows of child whose key no row of parent has."""
    return child.join(parent.select(F.col(parent_key).alias("_parent")), F.col(child_key) == F.col("_parent"), "left_anti")


def check_foreign_key(child: DataFrame, parent: DataFrame, child_key: str, parent_key: str) -> None:
    bad = orphans(child, parent, child_key, parent_key).select(child_key).limit(5).collect()
    if bad:
        raise ValueError(f"FOREIGN KEY constraint failed: {[r[0] for r in bad]} not in {parent_key}")


def cascade(child: DataFrame, deleted: DataFrame, child_key: str, parent_key: str) -> DataFrame:
    """child without the rows whose parents are deleted."""
    return child.join(deleted.select(F.col(parent_key).alias("_parent")), F.col(child_key) == F.col("_parent"), "left_anti")


def counts(**tables: DataFrame) -> DataFrame:
    """(table, n) of each table."""
    out = None
    for name, df in tables.items():
        one = df.agg(F.count("*").alias("n")).select(F.lit(name).alias("table"), "n")
        out = one if out is None else out.unionByName(one)
    return out


def create(spark: SparkSession, base: str) -> None:
    """Empty tables below `base` where there are none."""
    for name, schema in TABLES.items():
        spark.createDataFrame([], T._parse_datatype_string(schema)).write.mode("ignore").parquet(f"{base}/{name}")


def exists(spark: SparkSession, name: str) -> bool:
    return spark.catalog.tableExists(name)
