"""Collection, chunk, image and evaluation tables as views over documents, embeddings, pages and conversations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from findloom.model import DESCRIPTION_BASE, IMAGE_BASE, TEXT_BASE

PER_DOC, CHUNK = 5, 320
#: A table of vectors is broadcast if its numbers take no more than this.
BROADCAST_BYTES = 32 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def doc_name(number) -> F.Column:
    return F.concat(F.lit("doc_"), number.cast("string"))


def collection(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    name = doc_name(F.col("doc_id"))
    json = F.concat(
        F.lit('{"file_name": "'), name, F.lit('.txt", "source": "'), F.col("source"), F.lit('", "server_path": "/files/'), name,
        F.lit('.txt", "lang": "'), F.col("lang"), F.lit('"}'),
    )
    return docs.select(name.alias("id"), F.col("text").alias("data"), json.alias("cmetadata"))


def _cut(spark: SparkSession, sf_dir: str, tasks: int | None = None) -> DataFrame:
    docs = table(spark, sf_dir, "documents").where("text <> ''").select("doc_id", "text")
    docs = docs.coalesce(tasks) if tasks else docs
    # One pass over a text: substring() would count from its start again for each piece.
    pieces = F.regexp_extract_all("text", F.lit(f"(?s).{{1,{CHUNK}}}"), 0)
    return docs.select("doc_id", F.posexplode(pieces).alias("k", "embed_data"))


def chunk_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """embedding() without vectors, which a text index does not look at."""
    return _cut(spark, sf_dir).select(doc_name(F.col("doc_id")).alias("doc_id"), (F.col("k").cast("long") + TEXT_BASE + 1).alias("embed_id"), "embed_data")


def chunk_count(spark: SparkSession, sf_dir: str) -> int:
    """Rows of chunk_texts(), by the lengths of the documents."""
    return table(spark, sf_dir, "documents").select(F.sum(F.ceil(F.length("text") / F.lit(CHUNK)))).first()[0] or 0


def embedding(spark: SparkSession, sf_dir: str, tasks: int | None = None) -> DataFrame:
    """The chunks of every document to its end; chunk k of a document borrows the vector numbered PER_DOC * doc_id + k, counted round the vectors there are.

    They are made in `tasks` tasks at most, if that is given: splits are put together, or chunks dealt to so many where they move.
    """
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").alias("embed_vector"))
    count, numbers = vectors.agg(F.count("*"), F.sum(F.size("embed_vector"))).first()
    # Chunks need not move for a table of vectors that is known to be small.
    few = 4 * (numbers or 0) <= BROADCAST_BYTES
    number = F.pmod(F.col("doc_id") * PER_DOC + F.col("k"), F.lit(max(1, count)))
    own = _cut(spark, sf_dir, tasks if few else None).withColumn("vec_id", number)
    if few:
        vectors = F.broadcast(vectors)
    elif tasks:
        own, vectors = (rows.repartition(tasks, "vec_id") for rows in (own, vectors))
    joined = own.join(vectors, "vec_id")
    # A join of fewer partitions than the session's own number is dealt to that many.
    joined = joined.coalesce(tasks) if tasks and not few else joined
    return joined.select(
        doc_name(F.col("doc_id")).alias("doc_id"), (F.col("k").cast("long") + TEXT_BASE + 1).alias("embed_id"), "embed_data", "embed_vector"
    )


def image(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return pages.select(
        doc_name(F.expr(f"page_id div {PER_DOC}")).alias("doc_id"),
        (F.col("page_id") % PER_DOC + 1).alias("img_id"),
        F.col("url").alias("text_data"),
        F.regexp_extract("html", r"<title>([^<]*)</title>", 1).alias("vlm_data"),
        F.translate(F.base64(F.encode("html", "UTF-8")), "\r\n", "").alias("base64_data"),
    )


def image_embedding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each image a text chunk, a description chunk and a chunk of the image itself, with ids running over a document's images."""
    img = image(spark, sf_dir).drop("base64_data")
    kinds = F.array(
        F.struct(F.lit(TEXT_BASE).alias("base"), F.col("text_data").alias("embed_data")),
        F.struct(F.lit(DESCRIPTION_BASE).alias("base"), F.col("vlm_data").alias("embed_data")),
        F.struct(F.lit(IMAGE_BASE).alias("base"), F.lit("image").alias("embed_data")),
    )
    return img.select("doc_id", "img_id", F.explode(kinds).alias("k")).select("doc_id", (F.col("k.base") + F.col("img_id")).cast("long").alias("embed_id"), "k.embed_data", "img_id")


def image_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """image_embedding with vectors, borrowed by document and chunk number, counted round the vectors there are."""
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").alias("embed_vector"))
    number = F.regexp_extract("doc_id", r"\d+", 0).cast("long")
    own = image_embedding(spark, sf_dir).withColumn("vec_id", F.pmod(number * 7 + F.col("embed_id"), F.lit(max(1, vectors.count()))))
    return own.join(vectors, "vec_id").drop("vec_id")


def qa_result(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations")
    first = turns.where("role = 'user'").groupBy("conv_id").agg(F.min_by("text", "turn").alias("query"))
    return first.select(
        F.concat(F.lit("query_"), F.col("conv_id").cast("string")).alias("query_id"),
        "query",
        F.concat(F.lit("standard "), F.col("conv_id").cast("string")).alias("standard_answer"),
        F.timestamp_seconds(F.lit(1_700_000_000) + F.col("conv_id")).alias("created_date"),
    )


def qa_feedback(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").where("role = 'assistant'")
    return turns.select(
        F.concat(F.lit("query_"), F.col("conv_id").cast("string")).alias("query_id"),
        F.concat(F.lit("model_"), (F.col("turn") % 4).cast("string")).alias("llm_name"),
        F.col("text").alias("llm_answer"),
        F.when(F.length("text") % 2 == 0, "good").otherwise("bad").alias("human_evaluation_result"),
    )


def query_vectors(spark: SparkSession, sf_dir: str, vec_ids: list[int]) -> DataFrame:
    """(qid, vector) of the named vectors: as many rows as ids are given."""
    return table(spark, sf_dir, "embeddings").where(F.col("vec_id").isin(vec_ids)).select(F.col("vec_id").alias("qid"), F.col("embedding").alias("vector"))
