"""Images of hits: first chunk of each image, search order, size guard, and the five ways of gathering them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from findloom.functions.text import data_uri
from findloom.model import DESCRIPTION_BASE, IMAGE_BASE, TEXT_BASE
from findloom.operators.chunking import chunks_of
from findloom.providers import IMAGE_BATCH, Embedder, embedded

#: Fixed value: the text that stands for an image in its own chunk.
IMAGE_TEXT = "これは画像です"
MAX_BASE64 = 10 * 1024 * 1024


def first_chunks(hits: DataFrame) -> DataFrame:
    """hits(doc_id, img_id, embed_id, ...) -> the row of least embed_id of each image."""
    w = Window.partitionBy("doc_id", "img_id").orderBy("embed_id")
    return hits.where("img_id is not null").withColumn("rn", F.row_number().over(w)).where("rn = 1").drop("rn")


def of_hits(ranked: DataFrame, image_chunks: DataFrame) -> DataFrame:
    """ranked(rank, doc_id, embed_id) -> (doc_id, img_id, rank) in search order, the first chunk of each image deciding."""
    return first_chunks(ranked.join(image_chunks.select("doc_id", "embed_id", "img_id"), ["doc_id", "embed_id"]))


def ordered_distinct(pairs: DataFrame, limit: int | None = None) -> DataFrame:
    """pairs(rank, doc_id, img_id) -> each once at its best rank, the first `limit` of them."""
    once = pairs.groupBy("doc_id", "img_id").agg(F.min("rank").alias("rank"))
    return once if limit is None else once.orderBy("rank", "doc_id", "img_id").limit(limit)


def fetched(pairs: DataFrame, images: DataFrame) -> DataFrame:
    """Image data of the pairs that have any within the size limit, rank kept."""
    usable = images.where(F.col("base64_data").isNotNull() & (F.col("base64_data") != "") & (F.length("base64_data") <= MAX_BASE64))
    return pairs.join(usable, ["doc_id", "img_id"])


def by_file(pairs: DataFrame) -> DataFrame:
    """pairs(rank, doc_id, img_id) -> a row a document in order of first appearance, its images in order of id."""
    return pairs.groupBy("doc_id").agg(F.min("rank").alias("rank"), F.sort_array(F.collect_set("img_id")).alias("img_ids"))


def first_and_last(images: DataFrame) -> DataFrame:
    """The first and the last image of each document."""
    ends = images.groupBy("doc_id").agg(F.min("img_id").alias("a"), F.max("img_id").alias("b"))
    return ends.select("doc_id", F.explode(F.array_distinct(F.array("a", "b"))).alias("img_id"))


def neighbours(pairs: DataFrame, images: DataFrame) -> DataFrame:
    """Images next to those of pairs, as far as they exist."""
    beside = pairs.select("doc_id", F.explode(F.array(F.col("img_id") - 1, F.col("img_id") + 1)).alias("img_id")).distinct()
    return beside.join(images.select("doc_id", "img_id"), ["doc_id", "img_id"], "left_semi")


def gathered(pairs: DataFrame, images: DataFrame, mode: int) -> DataFrame:
    """(doc_id, img_id) that a prompt of the mode shows: 1-3 the hits, 4 with first and last, 5 with neighbours as well."""
    hits = pairs.select("doc_id", "img_id").distinct()
    if mode < 4:
        return hits
    inside = images.join(hits.select("doc_id").distinct(), "doc_id", "left_semi")
    more = hits.unionByName(first_and_last(inside))
    return (more.unionByName(neighbours(hits, inside)) if mode == 5 else more).distinct()


def grouped(shown: DataFrame, mode: int) -> DataFrame:
    """shown(rank, doc_id, img_id, base64_data) -> place, doc_ids, img_ids, uris: a row for each prompt, its images in order.

    Mode 1: a prompt an image; 2: one for all, in order of image id; from 3 on: one a document. Rows are what
    ordered_distinct() let through, so a group is bounded by its limit.
    """
    own = shown.select("rank", "doc_id", "img_id", data_uri(F.col("base64_data")).alias("uri"))
    key = {1: [F.col("doc_id").alias("g"), F.col("img_id").alias("h")], 2: [F.lit("").alias("g")]}.get(mode, [F.col("doc_id").alias("g")])
    images = F.sort_array(F.collect_list(F.struct("img_id", "doc_id", "uri")))
    groups = own.groupBy(*key).agg(F.min("rank").alias("rank"), images.alias("i"))
    place = F.row_number().over(Window.orderBy("rank", "i"))
    return groups.select(place.cast("long").alias("place"), F.col("i.doc_id").alias("doc_ids"), F.col("i.img_id").alias("img_ids"), F.col("i.uri").alias("uris"))


def embedding_rows(images: DataFrame, size: int = 256, overlap: int = 25) -> DataFrame:
    """images(doc_id, img_id, text_data, vlm_data, base64_data) -> doc_id, img_id, data_type, embed_id, embed_data, cmetadata.

    Read text and descriptions are split as a library does; an image has one chunk of its own. Chunk ids count over all
    images of a document, by kind of data.
    """
    kinds = F.array(
        *(F.struct(F.lit(kind).alias("data_type"), F.lit(base).alias("base"), chunks_of(F.col(kind), size, overlap, library=True).alias("chunks")) for kind, base in (("text_data", TEXT_BASE), ("vlm_data", DESCRIPTION_BASE))),
        F.struct(F.lit("base64_data").alias("data_type"), F.lit(IMAGE_BASE).alias("base"), F.when(F.col("base64_data") != "", F.array(F.lit(IMAGE_TEXT))).alias("chunks")),
    )
    rows = images.select("doc_id", "img_id", F.explode(kinds).alias("k")).select("doc_id", "img_id", "k.data_type", "k.base", F.posexplode("k.chunks").alias("pos", "embed_data"))
    n = F.row_number().over(Window.partitionBy("doc_id", "data_type").orderBy("img_id", "pos"))
    meta = F.to_json(F.struct("doc_id", "img_id", "data_type"))
    return rows.select("doc_id", "img_id", "data_type", (F.col("base") + n).cast("long").alias("embed_id"), "embed_data", meta.alias("cmetadata"))


def embedded_rows(rows: DataFrame, images: DataFrame, texts: Callable[[], Embedder], pictures: Callable[[], Embedder]) -> DataFrame:
    """embedding_rows() with vectors: of the chunk's text, or of the image itself."""
    own = rows.where("data_type <> 'base64_data'").withColumn("embed_vector", embedded(F.col("embed_data"), texts))
    data = images.where("base64_data <> ''").select("doc_id", "img_id", "base64_data")
    seen = rows.where("data_type = 'base64_data'").join(data, ["doc_id", "img_id"])
    return own.unionByName(seen.withColumn("embed_vector", embedded(F.col("base64_data"), pictures, IMAGE_BATCH)).drop("base64_data"))
