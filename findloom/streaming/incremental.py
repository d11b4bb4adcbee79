"""Vectors for new chunks as they arrive: availableNow micro-batches over a folder of chunk files."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from findloom.model import EMBEDDING
from findloom.providers import Embedder, embedded


def with_vectors(chunks: DataFrame, make: Callable[[], Embedder]) -> DataFrame:
    """chunks with a vector where there was none; those that have one are not asked about."""
    # A when() would still call the model for every row of a batch: the text is blanked where no vector is wanted.
    asked = embedded(F.when(F.col("embed_vector").isNull(), F.col("embed_data")), make)
    return chunks.withColumn("embed_vector", F.coalesce("embed_vector", asked))


def embed_new_chunks(spark: SparkSession, source: str, target: str, checkpoint: str, make: Callable[[], Embedder], files_per_batch: int = 20) -> StreamingQuery:
    """Chunk files that came to `source` since the last call -> `target`, with vectors; each file is taken up once."""
    chunks = spark.readStream.schema(EMBEDDING).option("maxFilesPerTrigger", files_per_batch).parquet(source)
    out = with_vectors(chunks, make).writeStream.format("parquet").option("checkpointLocation", checkpoint)
    return out.trigger(availableNow=True).start(target)


def windowed_feedback(feedback: DataFrame, late: str = "10 minutes", window: str = "1 hour") -> DataFrame:
    """Stream of feedback(created_date, llm_name, human_evaluation_result) -> good and all answers an hour and model; rows later than `late` are left out."""
    good = F.sum((F.col("human_evaluation_result") == "good").cast("long")).alias("good")
    grouped = feedback.withWatermark("created_date", late).groupBy(F.window("created_date", window), "llm_name")
    return grouped.agg(F.count("*").alias("answers"), good).select("window.start", "llm_name", "answers", "good")
