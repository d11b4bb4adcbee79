"""Exact nearest neighbours: one scan of the vectors for all queries of a request.

Query vectors are a handful of rows (four at most in a search), so they are crossed to the scan; distances are made
once and only keys and distances go on. Per-query and per-document limits are row_number() filters, which Spark turns
into partial limits before the shuffle, so a task never ships more than k rows a group.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from findloom.functions import vectors as V

KEYS = ["doc_id", "embed_id"]


def with_norms(chunks: DataFrame) -> DataFrame:
    """chunks with embed_norm, which may be stored with them: scored() then reads it."""
    return chunks.withColumn("embed_norm", V.norm(F.col("embed_vector")))


def scored(chunks: DataFrame, queries: DataFrame, metric: str = "cosine") -> DataFrame:
    """chunks(doc_id, embed_id, embed_vector, embed_norm if stored) x queries(qid, vector) -> doc_id, embed_id, qid, distance."""
    asked = queries.select("qid", F.col("vector").cast("array<float>").alias("vector"), V.norm(F.col("vector")).alias("norm"))
    if metric == "cosine":
        # The norm of a chunk is made below the cross join: once, for whatever number of queries.
        own = chunks if "embed_norm" in chunks.columns else with_norms(chunks)
        pairs = own.select(*KEYS, "embed_vector", "embed_norm").crossJoin(F.broadcast(asked))
        distance = V.rounded(1 - V.dot_batched(F.col("embed_vector"), F.col("vector")) / (F.col("embed_norm") * F.col("norm")))
    else:
        pairs = chunks.select(*KEYS, "embed_vector").crossJoin(F.broadcast(asked))
        distance = V.distance(F.col("embed_vector"), F.col("vector"), metric)
    return pairs.select(*KEYS, "qid", distance.alias("distance"))


def nearest(scores: DataFrame, k: int, threshold: float | None = None) -> DataFrame:
    """The k nearest rows of each query, at most `threshold` away."""
    within = scores if threshold is None else scores.where(F.col("distance") <= threshold)
    w = Window.partitionBy("qid").orderBy("distance", *KEYS)
    return within.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= k).drop("rn")


def nearest_by_document(scores: DataFrame, documents: int, k: int, threshold: float | None = None) -> DataFrame:
    """Of each query, the documents whose best chunk is nearest, and k chunks of each."""
    within = scores if threshold is None else scores.where(F.col("distance") <= threshold)
    inside = Window.partitionBy("qid", "doc_id").orderBy("distance", "embed_id")
    top = within.withColumn("rn", F.row_number().over(inside)).where(F.col("rn") <= k)
    best = top.where("rn = 1").withColumn("place", F.row_number().over(Window.partitionBy("qid").orderBy("distance", "doc_id")))
    chosen = best.where(F.col("place") <= documents).select("qid", "doc_id")
    return top.join(chosen, ["qid", "doc_id"]).select(*KEYS, "qid", "distance")


def with_nearest_as_queries(chunks: DataFrame, queries: DataFrame, k: int = 3) -> DataFrame:
    """queries(qid 0, vector) -> with the vectors of its k nearest chunks as queries 1..k."""
    first = nearest(scored(chunks, queries), k).select(*KEYS, F.col("distance").alias("was"))
    again = chunks.join(F.broadcast(first), KEYS)
    place = F.row_number().over(Window.orderBy("was", *KEYS))  # k rows
    return queries.select(F.col("qid").cast("long").alias("qid"), "vector").unionByName(again.select(place.cast("long").alias("qid"), F.col("embed_vector").alias("vector")))


def fused(arms: DataFrame) -> DataFrame:
    """One row a chunk with its least distance over all queries that found it."""
    return arms.groupBy(*KEYS).agg(F.min("distance").alias("distance"))
