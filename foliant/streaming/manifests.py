"""Link manifests as they arrive: the same rules as in batch, on a stream of files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from foliant.operators.verify import validate_manifests
from foliant.sources.relations import MANIFEST_SCHEMA


def manifest_stream(spark: SparkSession, folder: str) -> DataFrame:
    return spark.readStream.schema(MANIFEST_SCHEMA).option("multiLine", True).json(folder)


def watch_manifests(spark: SparkSession, folder: str, documents: DataFrame, out: str, checkpoint: str, allow_legacy: bool = False) -> StreamingQuery:
    """Append the first fault of each new manifest to a table; needs no state.

    ``documents``: doc_id, input_sha256, page_count. A manifest is joined to its file by the digest that it names.
    """
    rows = manifest_stream(spark, folder).withColumn("__key", F.lower(F.coalesce("input_sha256", "source_sha256")))
    named = rows.join(documents.select("doc_id", F.lower("input_sha256").alias("__key")), "__key").drop("__key")
    return validate_manifests(named, documents, allow_legacy).writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
