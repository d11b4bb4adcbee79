"""Hybrid search: one lazy plan from query vectors and terms to the presented result.

Keys and distances are selected first; texts and names are joined to the selected ids only.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from findloom.functions import text as X
from findloom.functions import vectors as V
from findloom.model import SENTINEL, SearchRequest, parse_metadata
from findloom.operators import expansion, knn, neighbours, ranking
from findloom.providers import ChatModel, Embedder, Reranker, reranked_scores
from findloom.sources.tables import plan_text
from findloom.streaming.index_upkeep import TextIndex


#: Lists of ids up to this long become part of the plan, and so of what is pushed to the scan.
FEW_IDS = 200


def restricted(collection: DataFrame, request: SearchRequest) -> DataFrame:
    """The documents that the request's id list and metadata allow."""
    if request.doc_ids is not None and len(request.doc_ids) <= FEW_IDS:
        collection = collection.where(F.col("id").isin(request.doc_ids))
    elif request.doc_ids is not None:
        # A long list would make the plan as long.
        ids = collection.sparkSession.createDataFrame([(i,) for i in dict.fromkeys(request.doc_ids)], "id string")
        collection = collection.join(ids, "id", "left_semi")
    for key, value in parse_metadata(request.metadata).items():
        collection = collection.where(X.metadata_value(F.col("cmetadata"), key) == value)
    return collection


def query_frame(like: DataFrame, vectors: list[list[float]]) -> DataFrame:
    rows = [(k, [float(x) for x in v]) for k, v in enumerate(vectors)]
    return like.sparkSession.createDataFrame(rows, "qid int, vector array<float>")


def selected(chunks: DataFrame, queries: DataFrame, request: SearchRequest, index: TextIndex | None = None, within: DataFrame | None = None) -> DataFrame:
    """doc_id, embed_id, distance of what the vector arms and the text arm find; qid 0 is the query itself.

    With an index the text arm reads posting lists, of the documents of within(doc_id) if that is given, and no texts.
    """
    scores = knn.scored(chunks, queries)
    if request.partition_by:
        hits = knn.nearest_by_document(scores, request.partition_by, request.top_k, request.threshold)
    else:
        hits = knn.nearest(scores, request.top_k, request.threshold)
    found = hits.select(*knn.KEYS, "distance")
    if request.text_search and request.terms:
        terms = sorted(request.terms, key=len)[: request.text_search_k] if len(request.terms) > request.text_search_k else request.terms
        by_text = ranking.text_hits(chunks, terms, request.top_k) if index is None else index.top({0: terms}, request.top_k, within)
        # top_k rows at most: distances to the query are made for those chunks only.
        hit_chunks = neighbours.located(F.broadcast(by_text.select(*knn.KEYS)), chunks, *(c for c in ("embed_vector", "embed_norm") if c in chunks.columns))
        found = found.unionByName(knn.scored(hit_chunks, queries.where("qid = 0")).select(*knn.KEYS, "distance"))
    return knn.fused(found)


def search(
    chunks: DataFrame,
    collection: DataFrame,
    request: SearchRequest,
    queries: DataFrame | None = None,
    image_chunks: DataFrame | None = None,
    reranker: Callable[[], Reranker] | None = None,
    index: TextIndex | None = None,
) -> DataFrame:
    """chunks(doc_id, embed_id, embed_data, embed_vector), collection(id, cmetadata) -> no, content, embed_id, source, distance, score, key_words.

    A request with use_image searches image_chunks (of the same columns), if there are any. Reranking asks the reranker
    about the few passages found, or goes by shared terms where there is none. With an index of chunks' texts the text arm
    searches that.
    """
    if request.use_image and image_chunks is not None:
        chunks, index = image_chunks, None
    allowed = restricted(collection, request).select(F.col("id").alias("doc_id"), X.metadata_value(F.col("cmetadata"), "file_name").alias("name"))
    own, within = chunks, None
    if request.doc_ids is not None or request.metadata:
        own, within = chunks.join(allowed, "doc_id", "left_semi"), allowed
    queries = query_frame(chunks, request.vectors) if queries is None else queries
    ids = neighbours.expanded(selected(own, queries, request, index, within), request.extend_around)
    whole = neighbours.located(ids, chunks, "embed_data").join(allowed, "doc_id")
    if request.use_image:
        passages = whole.select("doc_id", "name", F.col("embed_data").alias("content"), "embed_id", "distance")
    else:
        passages = neighbours.merged(whole, "name")
    if request.rerank:
        content = F.col("content")
        score = reranked_scores(F.lit(request.query), content, reranker) if reranker else ranking.lexical_score(content, request.terms)
        ranked = ranking.reranked(passages, score, request.rerank_threshold, request.rerank_top_k)
        order = [F.desc("score"), *ranking.ORDER]
    else:
        ranked, order = passages.withColumn("score", F.lit(None).cast("double")), ranking.ORDER
    rows = ranking.numbered(ranked.withColumn("source", F.concat("doc_id", F.lit(":"), "name")), *order).drop("name")
    if request.extend_first:
        # Only the documents of the few result rows: their chunks are chosen before any text is joined together.
        own = neighbours.of_documents(chunks, rows)
        rows = ranking.with_prefixes(rows, neighbours.leading(own, request.extend_first))
    if request.answer_by_one:
        rows = ranking.answered_by_one(rows)
    terms = F.array(*map(F.lit, request.terms)).cast("array<string>")
    return rows.select(
        "no",
        X.collapse_newlines(F.col("content")).alias("content"),
        "embed_id",
        "source",
        F.when(F.col("distance") < SENTINEL, F.col("distance")).alias("distance"),
        "score",
        X.keyword_hits(F.col("content"), terms).alias("key_words"),
    )


def expanded_search(
    chunks: DataFrame,
    collection: DataFrame,
    request: SearchRequest,
    chat: Callable[[], ChatModel],
    embedder: Callable[[], Embedder],
    kind: str = "sub_query",
    **more,
) -> DataFrame:
    """search() by the vectors of request.query and of the queries that a model makes of it; a blank query finds nothing.

    `kind` is one of the prompts' expansions, or `multi_step`: the nearest chunks become the further queries.
    """
    asked = chunks.sparkSession.createDataFrame([("", request.query)], "query_id string, query string")
    if kind == "multi_step":
        queries = knn.with_nearest_as_queries(chunks, expansion.vectors(expansion.itself(asked), embedder))
    else:
        queries = expansion.vectors(expansion.expanded(asked, kind, chat), embedder)
    return search(chunks, collection, request, queries, **more)


def with_plan(result: DataFrame) -> tuple[DataFrame, str]:
    """A result and the text of the plan that makes it, for a caller that shows both."""
    return result, plan_text(result)


def presented(result: DataFrame) -> DataFrame:
    """All columns as strings, as a user interface shows them; `-` where there is no distance or score."""
    shown = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("-")).alias(c.upper())
    plain = lambda c: F.col(c).cast("string").alias(c.upper())
    return result.select(plain("no"), plain("content"), plain("embed_id"), plain("source"), shown("distance"), shown("score"), plain("key_words"))


class VectorStore:
    """A thin facade: add texts with vectors, search by vector with a filter applied after the top k, delete."""

    def __init__(self, rows: DataFrame):
        self.rows = rows  # doc_id, embed_id, embed_data, embed_vector, cmetadata

    def add_texts(self, rows: DataFrame) -> VectorStore:
        return VectorStore(self.rows.unionByName(rows))

    def delete(self, ids: list[str]) -> VectorStore:
        return VectorStore(self.rows.where(~F.col("doc_id").isin(ids)))

    def similarity_search(self, vector: list[float], k: int = 4, threshold: float = 0.95, metric: str = "cosine", metadata: str = "") -> DataFrame:
        near = self.rows.withColumn("distance", V.distance(F.col("embed_vector"), V.literal(vector), metric)).where(F.col("distance") <= threshold)
        top = near.orderBy("distance", "doc_id", "embed_id").limit(k)
        for key, value in parse_metadata(metadata).items():
            top = top.where(X.metadata_value(F.col("cmetadata"), key) == value)
        return top
