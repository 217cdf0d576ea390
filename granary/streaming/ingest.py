"""A folder that is watched: new documents are normalised and chunked as they come."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from granary.functions import text as T
from granary.operators import chunking


def documents(spark: SparkSession, path: str, schema: StructType | str, files_per_trigger: int = 64) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def chunks(docs: DataFrame, size: int = 900, overlap: int = 120) -> DataFrame:
    """The stateless stages of ingest, the same functions as in batch."""
    return chunking.chunk(docs.withColumn("text", T.normalize_text(F.coalesce("text", F.lit("")))), size, overlap)


def write(rows: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Exactly once: the file sink's log names the files of each finished batch."""
    return rows.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
