"""What is stored of a collection: its tables in versions, chunks by shelf of their document, and the text index.

Each part of the fixture views' collection is made when it is first asked for, once for each state of the input files, in the
shared folder; whoever comes later, in this session or another, reads it. Two that make it at once both succeed, and
one of the two is taken.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from findloom.model import CHUNK_SHELVES, COLLECTION, IMAGE, IMAGE_EMBEDDING, VECTOR
from findloom.operators import knn
from findloom.sources import views
from findloom.sources.shared import Files, fingerprint, new_path, shared_dir
from findloom.sources.snapshots import Layout, Tables
from findloom.streaming.index_upkeep import TextIndex

TERM_SHELVES = 32
#: To be raised when what is stored, or the views that it is stored of, change: older stores are then left alone.
FORMAT = 4
#: Files of a chunk table that its first load may write whatever their size, a file a task and shelf; beyond them a task takes
#: TASK_BYTES of the stored documents, so that files of some MB follow the input and chunks with their vectors need not be sorted over the cluster.
FEW_FILES, TASK_BYTES = 2048, 64 << 20
#: Chunks with the norms of their vectors, which a search then need not make.
CHUNKS = T.StructType(
    [T.StructField(n, k) for n, k in (("doc_id", T.StringType()), ("embed_id", T.LongType()), ("embed_data", T.StringType()), ("embed_vector", VECTOR), ("embed_norm", T.DoubleType()))]
)
_IMAGE_ROWS = T.StructType([f for f in IMAGE_EMBEDDING.fields if f.name in ("doc_id", "embed_id", "embed_data", "img_id")])
LAYOUTS = {
    "collection": Layout(COLLECTION),
    "embedding": Layout(CHUNKS, ("doc_id", "embed_id"), CHUNK_SHELVES),
    "image": Layout(IMAGE),
    "image_embedding": Layout(_IMAGE_ROWS),
}


def chunk_tables(spark: SparkSession, folder: str) -> Tables:
    return Tables(spark, folder, {"embedding": LAYOUTS["embedding"]})


def filled_chunks(tables: Tables, embedding: DataFrame, laid: bool = False) -> Tables:
    """The first rows of a chunk table. laid: tasks are few or large, so rows are written as they lie, a file a task and shelf; else they
    are sorted over the cluster first, for files would be too many."""
    tables.change().append("embedding", knn.with_norms(embedding), laid=laid).commit()
    return tables


def chunks_of_views(spark: SparkSession, sf_dir: str) -> Tables:
    """The chunk table of the fixture views: doc_id, embed_id, embed_data, embed_vector, embed_norm, shelf."""
    folder = _once(spark, sf_dir, "chunks", lambda at: filled_chunks(chunk_tables(spark, at), views.embedding(spark, sf_dir, _tasks(spark, sf_dir)), laid=True))
    return chunk_tables(spark, folder)


def index_of_views(spark: SparkSession, sf_dir: str) -> TextIndex:
    """The text index of the fixture views' chunks."""
    folder = _once(spark, sf_dir, "index", lambda at: TextIndex(spark, at, TERM_SHELVES).build(views.chunk_texts(spark, sf_dir), views.chunk_count(spark, sf_dir)))
    return TextIndex(spark, folder, TERM_SHELVES)


def collection_of_views(spark: SparkSession, sf_dir: str) -> Tables:
    """All four tables of a collection, for changes that reach all of them; the chunk table is that of chunks_of_views()."""

    def make(at: str) -> None:
        tables = Tables(spark, at, LAYOUTS)
        change = tables.change().adopt("embedding", chunks_of_views(spark, sf_dir))
        for name, rows in (("collection", views.collection), ("image", views.image), ("image_embedding", views.image_embedding)):
            change.append(name, rows(spark, sf_dir))
        change.commit()

    return Tables(spark, _once(spark, sf_dir, "collection", make), LAYOUTS)


def _tasks(spark: SparkSession, sf_dir: str) -> int:
    """Tasks that a chunk table is made in: a split each while their files are few, else by bytes of the documents."""
    splits = views.table(spark, sf_dir, "documents").select("doc_id", "text").rdd.getNumPartitions()
    size = sum(Files(spark, f"{sf_dir}/documents.parquet").sizes().values())
    return max(1, min(splits, FEW_FILES // CHUNK_SHELVES), -(-size // TASK_BYTES))


def _once(spark: SparkSession, sf_dir: str, kind: str, make: Callable[[str], object]) -> str:
    """The folder that make() filled for this kind and this state of the input files, now or before."""
    state = fingerprint(spark, *(f"{sf_dir}/{t}.parquet" for t in ("documents", "embeddings", "pages")))
    done = Files(spark, f"{shared_dir(spark)}/findloom-stores")
    name = f"{kind}-{FORMAT}-{state}.txt"
    if name in done.names() and not Files(spark, f"{done.read(name)}/log").names():
        done.delete(name)  # somebody has emptied the folder
    if name not in done.names():
        folder = new_path(spark, kind)
        make(folder)
        done.create(name, folder)
    return done.read(name)
