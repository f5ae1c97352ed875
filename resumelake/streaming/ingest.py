"""Continuous ingest (an extension): new document files are redacted as they come, a folder for each batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from resumelake.operators.redaction import redacted


def documents(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.readStream.schema(schema).parquet(path)


def ingest(docs: DataFrame, target: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Writes redacted documents to target, a folder for each batch: a batch run again replaces its own folder."""

    def put(batch: DataFrame, number: int) -> None:
        redacted(batch).drop("text").write.mode("overwrite").parquet(f"{target}/batch={number}")

    return docs.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
