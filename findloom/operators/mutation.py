"""Deletes, replacements and updates: as new DataFrames, which callers write as they like, and of stored tables in versions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from findloom.sources.snapshots import Tables


def without_documents(rows: DataFrame, gone: DataFrame, key: str = "doc_id") -> DataFrame:
    """rows whose key is not among gone(doc_id)."""
    return rows.join(gone.select(F.col("doc_id").alias("__gone")), F.col(key) == F.col("__gone"), "left_anti")


def cascade_delete(tables: dict[str, tuple[DataFrame, str]], gone: DataFrame) -> dict[str, DataFrame]:
    """The documents leave every table: name -> (rows, key) gives name -> rows."""
    return {name: without_documents(rows, gone, key) for name, (rows, key) in tables.items()}


def cascade_delete_stored(tables: Tables, gone: DataFrame) -> int:
    """The documents of gone(doc_id) leave every stored table in one version: a reader sees them in all or in none."""
    change = tables.change()
    for name, layout in tables.layouts.items():
        change.delete(name, gone, {"doc_id" if "doc_id" in layout.schema.names else "id": "doc_id"})
    return change.commit()


def replaced_chunks(rows: DataFrame, new: DataFrame) -> DataFrame:
    """All chunks of the documents in `new` give way to those of `new`."""
    return without_documents(rows, new.select("doc_id").distinct()).unionByName(new)


def updated_vectors(rows: DataFrame, new: DataFrame) -> DataFrame:
    """rows with the vectors of new(doc_id, embed_id, embed_vector) where it has any."""
    own = new.select("doc_id", "embed_id", F.col("embed_vector").alias("__new"))
    return rows.join(own, ["doc_id", "embed_id"], "left").withColumn("embed_vector", F.coalesce("__new", "embed_vector")).drop("__new")


def edited_chunks(rows: DataFrame, edits: DataFrame) -> DataFrame:
    """rows with the trimmed texts and the vectors of edits(doc_id, embed_id, embed_data, embed_vector)."""
    own = edits.select("doc_id", "embed_id", F.trim("embed_data").alias("__text"), F.col("embed_vector").alias("__vector"))
    both = rows.join(own, ["doc_id", "embed_id"], "left")
    new = {"embed_data": F.coalesce("__text", "embed_data"), "embed_vector": F.when(F.col("__text").isNotNull(), F.col("__vector")).otherwise(F.col("embed_vector"))}
    return both.withColumns(new).select(rows.columns)


def replaced_images(images: DataFrame, chunks: DataFrame, new_images: DataFrame, new_chunks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The images of the documents in `new_images`, and their chunks, give way to the new ones."""
    gone = new_images.select("doc_id").distinct()
    return without_documents(images, gone).unionByName(new_images), without_documents(chunks, gone).unionByName(new_chunks)


def pending(rows: DataFrame) -> DataFrame:
    """Chunks that have no vector yet."""
    return rows.where("embed_vector is null")


def updated_feedback(rows: DataFrame, changes: DataFrame) -> DataFrame:
    """The latest of changes(query_id, llm_name, result, comment, seq) overwrites the human evaluation of that answer."""
    last = Window.partitionBy("query_id", "llm_name").orderBy(F.desc("seq"))
    own = changes.withColumn("rn", F.row_number().over(last)).where("rn = 1").select("query_id", "llm_name", "result", "comment", F.lit(True).alias("changed"))
    both = rows.join(own, ["query_id", "llm_name"], "left")
    return both.withColumns(
        {
            "human_evaluation_result": F.when(F.col("changed"), F.col("result")).otherwise(F.col("human_evaluation_result")),
            "user_comment": F.when(F.col("changed"), F.col("comment")).otherwise(F.col("user_comment")),
        }
    ).drop("result", "comment", "changed")


def empty_to_null(rows: DataFrame, *columns: str) -> DataFrame:
    """The store's reading of empty strings: null."""
    return rows.withColumns({c: F.nullif(F.col(c), F.lit("")) for c in columns})
