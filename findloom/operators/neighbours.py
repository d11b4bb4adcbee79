"""Neighbouring chunks: expansion around hits, and merging of adjacent chunks to one passage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from findloom.model import SENTINEL, TEXT_BASE, chunk_shelf


def offsets(k: int) -> list[int]:
    if k % 2:
        raise ValueError("the number of neighbours must be even")
    return list(range(-k // 2, k // 2 + 1))


def expanded(hits: DataFrame, k: int) -> DataFrame:
    """hits(doc_id, embed_id, distance) -> the hits and k/2 ids on each side; ids that were no hits have the sentinel distance.

    A chunk that is both keeps its own distance: the least one wins. Ids need not exist; the join with the chunks decides.
    """
    around = hits.select("doc_id", F.explode(F.array(*map(F.lit, offsets(k)))).alias("o"), "embed_id", "distance")
    own = F.when(F.col("o") == 0, F.col("distance")).otherwise(SENTINEL)
    return around.groupBy("doc_id", (F.col("embed_id") + F.col("o")).alias("embed_id")).agg(F.min(own).alias("distance"))


def with_islands(chunks: DataFrame) -> DataFrame:
    """A number for each run of consecutive chunk ids of a document."""
    w = Window.partitionBy("doc_id").orderBy("embed_id")
    starts = (F.coalesce(F.col("embed_id") - F.lag("embed_id").over(w), F.lit(0)) != 1).cast("int")
    return chunks.withColumn("starts", starts).withColumn("island", F.sum("starts").over(w)).drop("starts")


def joined_text(text: str = "embed_data") -> Column:
    """The texts of a group in order of chunk id, with commas between and none at the end."""
    return F.expr(f"trim(TRAILING ',' FROM listagg(coalesce({text}, ''), ',') WITHIN GROUP (ORDER BY embed_id))")


def merged(chunks: DataFrame, *carry: str) -> DataFrame:
    """chunks(doc_id, embed_id, distance, embed_data, carried columns) -> a row for each run of adjacent chunks."""
    groups = with_islands(chunks).groupBy("doc_id", "island", *carry)
    return groups.agg(joined_text().alias("content"), F.min("embed_id").alias("embed_id"), F.min("distance").alias("distance")).drop("island")


def located(ids: DataFrame, chunks: DataFrame, *columns: str) -> DataFrame:
    """ids(doc_id, embed_id, ...) with columns of their chunks.

    A search's ids are bounded by its request. Where chunks come from a store by shelf, the ids are sent to it and only their
    shelves are read; chunks never move.
    """
    if "shelf" not in chunks.columns:
        return ids.join(chunks.select("doc_id", "embed_id", *columns), ["doc_id", "embed_id"])
    keys = F.broadcast(ids.withColumn("shelf", chunk_shelf(F.col("doc_id"))))
    return keys.join(chunks.select("shelf", "doc_id", "embed_id", *columns), ["shelf", "doc_id", "embed_id"]).drop("shelf")


def of_documents(chunks: DataFrame, ids: DataFrame) -> DataFrame:
    """The chunks of a few documents, ids(doc_id): of their shelves only, where there are any."""
    own = ids.select("doc_id").distinct()
    if "shelf" not in chunks.columns:
        return chunks.join(own, "doc_id", "left_semi")
    keys = own.withColumn("shelf", chunk_shelf(F.col("doc_id")))
    return chunks.join(F.broadcast(keys), ["shelf", "doc_id"], "left_semi")


def leading(chunks: DataFrame, n: int) -> DataFrame:
    """The first n chunks of each document as one text."""
    first = chunks.where(F.col("embed_id") <= TEXT_BASE + n)
    return first.groupBy("doc_id").agg(joined_text().alias("content"), F.min("embed_id").alias("embed_id"))
