"""Documents to chunks with vectors, which take the place of what a collection held of them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from findloom.functions import vectors as V
from findloom.model import chunk_sizes
from findloom.operators import chunking, mutation
from findloom.providers import Embedder, embedded
from findloom.sources.shared import written
from findloom.sources.snapshots import Tables
from findloom.streaming.incremental import with_vectors

COMMIT_ROWS = 1920


def chunked(documents: DataFrame, maximum: int = 320, overlap_percent: float = 10) -> DataFrame:
    """documents(id, data, cmetadata) -> doc_id, embed_id, embed_data, embed_vector (none yet), cmetadata with the chunk's place.

    A document that is null, empty or blank has no chunk.
    """
    size, overlap = chunk_sizes(maximum, overlap_percent)
    pieces = documents.select(F.col("id").alias("doc_id"), F.posexplode(chunking.chunks_of(F.col("data"), size, overlap)).alias("pos", "piece"))
    place = F.to_json(F.struct("doc_id", "chunk_id", "chunk_offset", "chunk_length"))
    return chunking.annotated(pieces).select(
        "doc_id", F.col("chunk_id").alias("embed_id"), F.col("chunk_data").alias("embed_data"), F.lit(None).cast("array<float>").alias("embed_vector"), place.alias("cmetadata")
    )


def ingested(rows: DataFrame, documents: DataFrame, embedder: Callable[[], Embedder], maximum: int = 320, overlap_percent: float = 10) -> DataFrame:
    """The chunk table `rows` with all chunks of these documents made anew; a document left without text leaves no chunk."""
    new = with_vectors(chunked(documents, maximum, overlap_percent), embedder).select(rows.columns)
    return mutation.without_documents(rows, documents.select(F.col("id").alias("doc_id")).distinct()).unionByName(new)


def numbered(rows: DataFrame, *by: str) -> DataFrame:
    """rows with `number`, from 0 in order of `by`: places within partitions and a sum over partitions, so no task sees all rows."""
    ordered = rows.repartitionByRange(*by).sortWithinPartitions(*by)
    low = (1 << 33) - 1
    own = F.monotonically_increasing_id()
    placed = written(ordered.withColumns({"part": F.shiftright(own, 33), "place": own.bitwiseAND(F.lit(low))}), "numbered")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row a partition
    starts = placed.groupBy("part").count().select("part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("start"))
    return placed.join(F.broadcast(starts), "part").withColumn("number", F.col("start") + F.col("place")).drop("part", "place", "start")


def embed_pending(tables: Tables, embedder: Callable[[], Embedder], rows: int = COMMIT_ROWS, name: str = "embedding") -> list[int]:
    """Vectors for the chunks of a stored table that have none, at most `rows` of them a version; gives the versions.

    What is committed stays if a later batch fails; the next call takes up what is then still pending. Chunks without a text are
    never pending.
    """
    keys = ["doc_id", "embed_id"]
    waiting = mutation.pending(tables.read(name)).where("embed_data is not null").select(*keys, "embed_data")
    todo = written(numbered(waiting, *keys).withColumn("batch", F.floor(F.col("number") / F.lit(rows))), "pending")
    last = todo.agg(F.max("batch")).first()[0]
    versions = []
    for batch in range(-1 if last is None else last + 1):
        # Rows lie in order of their numbers, so a batch is read from the row groups that hold it.
        made = todo.where(F.col("batch") == batch).select(*keys, embedded(F.col("embed_data"), embedder).alias("embed_vector"))
        made = written(made.withColumn("embed_norm", V.norm(F.col("embed_vector"))), "vectors")
        versions.append(tables.change().update(name, made, keys, ["embed_vector", "embed_norm"]).commit())
    return versions
