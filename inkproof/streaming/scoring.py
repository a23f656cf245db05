"""Scoring a growing folder of documents with Structured Streaming.

Grounding, routing, checks and parsing work row by row, so the batch functions
take a streaming frame as it is and need no state.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from inkproof.operators import grounding


def read_documents(
    spark: SparkSession, path: str, schema: T.StructType, *, files_per_batch: int = 1000
) -> DataFrame:
    """Parquet files arriving below ``path``; the batch size bounds each batch's work."""
    return (
        spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)
    )


def score_stream(documents: DataFrame, **options) -> DataFrame:
    """``field_scores`` of a streaming frame; options as for ``ground``."""
    return grounding.field_scores(grounding.ground(documents, **options))


def write_available(scores: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Process what has arrived, exactly once across restarts, then stop."""
    return (
        scores.writeStream.format("parquet")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )
