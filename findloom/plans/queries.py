"""Named queries of the retrieval engine: each is a call of its operator on the fixture views, over whole tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from findloom.functions import table_functions
from findloom.functions import text as X
from findloom.functions import vectors as V
from findloom.model import FIXED_DELIMITER, SearchRequest
from findloom.operators import chunking, evaluation, expansion, images, ingestion, knn, mutation, neighbours, pivots, ranking, search
from findloom.providers import HashingEmbedder, SentenceChat
from findloom.sources import conversion, document_source, markup, office, samples, store, views, xml_nodes
from findloom.sources.shared import new_path
from findloom.sources.snapshots import Tables
from findloom.sources.views import table

QUERY_IDS = [7, 77, 177, 277]
TERMS = ["the", "and", "tion", "inter"]
NEAR = 0.95


def _ids_and(spark, d, ids=None):
    return store.chunks_of_views(spark, d).read("embedding"), views.query_vectors(spark, d, ids or QUERY_IDS[:1])


def doc_list(spark: SparkSession, d: str) -> DataFrame:
    c = views.collection(spark, d)
    return c.select(X.metadata_value(F.col("cmetadata"), "file_name").alias("name"), "id").orderBy(F.asc_nulls_last("name"), "id")


def server_path_lookup(spark: SparkSession, d: str) -> DataFrame:
    return views.collection(spark, d).where("id = 'doc_7'").select("id", X.metadata_value(F.col("cmetadata"), "server_path").alias("server_path"))


def document_source_filtered(spark: SparkSession, d: str) -> DataFrame:
    """The collection written through the document source, and read back by metadata."""
    folder = new_path(spark, "documents")
    rows = views.collection(spark, d)
    # Salted, since a language may hold most documents.
    document_source.write(rows.repartition(64, F.get_json_object("cmetadata", "$.lang"), F.pmod(F.xxhash64("id"), F.lit(16))), folder, "lang,source")
    found = document_source.read(spark, folder, "lang,source").where("lang in ('fr', 'de')")
    return found.select("id", "lang", "source", F.md5("data").alias("data_md5"))


def metadata_filter(spark: SparkSession, d: str) -> DataFrame:
    docs = search.restricted(views.collection(spark, d), SearchRequest(vectors=[[0.0]], metadata="lang=fr"))
    return views.embedding(spark, d).join(docs.select(F.col("id").alias("doc_id")), "doc_id", "left_semi").select("doc_id", "embed_id")


def doc_id_filter(spark: SparkSession, d: str) -> DataFrame:
    docs = search.restricted(views.collection(spark, d), SearchRequest(vectors=[[0.0]], doc_ids=["doc_3", "doc_14", "doc_15"]))
    return views.embedding(spark, d).join(docs.select(F.col("id").alias("doc_id")), "doc_id", "left_semi").select("doc_id", "embed_id")


def scan_with_collection(spark: SparkSession, d: str) -> DataFrame:
    c = views.collection(spark, d)
    e = views.embedding(spark, d)
    return e.join(c, e.doc_id == c.id).select("doc_id", "embed_id", X.metadata_value(F.col("cmetadata"), "file_name").alias("name"), F.length("embed_data").cast("long").alias("chars"))


def _knn(metric: str, k: int = 20):
    def run(spark: SparkSession, d: str) -> DataFrame:
        own = table(spark, d, "embeddings").select(F.col("vec_id").alias("embed_id"), F.lit("all").alias("doc_id"), F.col("embedding").alias("embed_vector"))
        near = knn.nearest(knn.scored(own, views.query_vectors(spark, d, [7]), metric), k)
        return near.select(F.col("embed_id").alias("vec_id"), "distance")

    return run


def knn_threshold(spark: SparkSession, d: str) -> DataFrame:
    chunks, queries = _ids_and(spark, d)
    return knn.scored(chunks, queries).where(F.col("distance") <= 0.7).select("doc_id", "embed_id", "distance")


def knn_partitioned_topk(spark: SparkSession, d: str) -> DataFrame:
    chunks, queries = _ids_and(spark, d)
    return knn.nearest_by_document(knn.scored(chunks, queries), 5, 2, NEAR).select("doc_id", "embed_id", "distance")


def multi_query_fusion(spark: SparkSession, d: str) -> DataFrame:
    chunks, queries = _ids_and(spark, d, QUERY_IDS)
    return knn.fused(knn.nearest(knn.scored(chunks, queries), 20, NEAR))


def knn_many(spark: SparkSession, d: str) -> DataFrame:
    """The ten rows nearest to each row whose number is divisible by 100, by clusters around pivots."""
    rows = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    return pivots.Clusters(rows).nearest(rows.where("id % 100 = 0"), 10).select("query_id", "rank", F.col("id").alias("vec_id"), "distance")


def multi_step_query(spark: SparkSession, d: str) -> DataFrame:
    """The vectors of the three nearest chunks become sub-queries, fused with the query itself."""
    chunks, queries = _ids_and(spark, d)
    queries = knn.with_nearest_as_queries(chunks, queries.withColumn("qid", F.lit(0)))
    return knn.fused(knn.nearest(knn.scored(chunks, queries), 10))


def neighbor_expand(spark: SparkSession, d: str) -> DataFrame:
    chunks, queries = _ids_and(spark, d)
    hits = knn.nearest(knn.scored(chunks, queries), 20, NEAR)
    return neighbours.located(neighbours.expanded(hits, 2), chunks).select("doc_id", "embed_id", "distance")


def merge_adjacent_chunks(spark: SparkSession, d: str) -> DataFrame:
    chunks, queries = _ids_and(spark, d)
    ids = neighbours.expanded(knn.nearest(knn.scored(chunks, queries), 20, NEAR), 2)
    return neighbours.merged(neighbours.located(ids, chunks, "embed_data")).select("doc_id", "embed_id", "distance", "content")


def first_chunk_extend(spark: SparkSession, d: str) -> DataFrame:
    chunks = views.embedding(spark, d)
    return neighbours.leading(chunks.select("doc_id", "embed_id", "embed_data"), 2).select("doc_id", "embed_id", "content")


def _search(spark: SparkSession, d: str, **more) -> DataFrame:
    request = SearchRequest(vectors=[[0.0]], terms=TERMS, threshold=NEAR, extend_around=2, **more)
    queries = views.query_vectors(spark, d, QUERY_IDS).withColumn("qid", F.when(F.col("qid") == 7, 0).otherwise(F.col("qid")))
    index = store.index_of_views(spark, d) if request.text_search else None
    return search.search(store.chunks_of_views(spark, d).read("embedding"), views.collection(spark, d), request, queries, index=index)


def hybrid_search_flagship(spark: SparkSession, d: str) -> DataFrame:
    return _search(spark, d, text_search=True)


def hybrid_search_reranked(spark: SparkSession, d: str) -> DataFrame:
    return _search(spark, d, text_search=True, rerank=True, rerank_top_k=10)


def hybrid_search_extend_first(spark: SparkSession, d: str) -> DataFrame:
    return _search(spark, d, extend_first=2)


def answer_by_one(spark: SparkSession, d: str) -> DataFrame:
    return _search(spark, d, answer_by_one=True).select("no", "embed_id", "source", "distance")


def vision_search(spark: SparkSession, d: str) -> DataFrame:
    request = SearchRequest(vectors=[[0.0]], terms=TERMS, threshold=NEAR, use_image=True, extend_around=2)
    return search.search(views.embedding(spark, d), views.collection(spark, d), request, views.query_vectors(spark, d, [7]), views.image_chunks(spark, d))


def provider_rerank(spark: SparkSession, d: str) -> DataFrame:
    """A search whose passages a reranker scores by the words of the query."""
    request = SearchRequest(vectors=[[0.0]], query="The and", threshold=NEAR, rerank=True, rerank_threshold=0.0, rerank_top_k=10)
    found = search.search(views.embedding(spark, d), views.collection(spark, d), request, views.query_vectors(spark, d, [7]), reranker=WordsReranker)
    return found.select("no", "embed_id", "source", "distance", "score")


class WordsReranker:
    """Score of a text: the share of the query's words, by white space, that it holds as parts; stated in SQL as well."""

    def score(self, query: str, texts: list[str]) -> list[float]:
        words = query.lower().split(" ")
        return [sum(w in t.lower() for w in words) / len(words) for t in texts]


def query_expansion(spark: SparkSession, d: str) -> DataFrame:
    asked = views.qa_result(spark, d).select("query_id", "query")
    return expansion.expanded(asked, "sub_query", SentenceChat)


def document_ingestion(spark: SparkSession, d: str) -> DataFrame:
    """Every second document comes anew, its lines as fixed chunks; the others keep theirs."""
    marked = F.concat(F.replace(F.col("data"), F.lit("\n"), F.lit(FIXED_DELIMITER)), F.lit(FIXED_DELIMITER))
    new = views.collection(spark, d).where(F.regexp_extract("id", r"\d+", 0).cast("long") % 2 == 0).withColumn("data", marked)
    rows = views.embedding(spark, d).select("doc_id", "embed_id", "embed_data", "embed_vector")
    done = ingestion.ingested(rows, new, HashingEmbedder)
    return done.select("doc_id", "embed_id", F.md5("embed_data").alias("data_md5"), F.size("embed_vector").cast("long").alias("dimensions"))


def image_prompt_groups(spark: SparkSession, d: str) -> DataFrame:
    """The images of the first five hits as prompts of the modes 1 to 3."""
    hits = images.ordered_distinct(_image_hits(spark, d), 5)
    shown = images.fetched(hits, views.image(spark, d))
    joined = lambda c: F.array_join(F.transform(c, lambda x: x.cast("string")), ",").alias(c)
    parts = [images.grouped(shown, mode).select(F.lit(mode).cast("long").alias("mode"), "place", joined("doc_ids"), joined("img_ids")) for mode in (1, 2, 3)]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def vector_cast(spark: SparkSession, d: str) -> DataFrame:
    written = table(spark, d, "embeddings").select("vec_id", F.to_json("embedding").alias("text"), "embedding")
    again = V.from_text(F.col("text"))
    return written.select("vec_id", F.size(again).cast("long").alias("dimensions"), V.rounded(V.norm(again)).alias("norm"))


def blob_cast(spark: SparkSession, d: str) -> DataFrame:
    blob = X.to_blob(F.col("text"))
    return table(spark, d, "documents").select("doc_id", F.octet_length(blob).cast("long").alias("n_bytes"), F.md5(blob).alias("blob_md5"))


def result_presentation(spark: SparkSession, d: str) -> DataFrame:
    return search.presented(_search(spark, d))


def result_numbering(spark: SparkSession, d: str) -> DataFrame:
    return _search(spark, d).select("no", "source", "embed_id")


def text_search_accum(spark: SparkSession, d: str) -> DataFrame:
    """The chunks with most terms, by the index."""
    return store.index_of_views(spark, d).top({0: TERMS}, 20).select("doc_id", "embed_id", "n_terms", "hits")


def text_search_scan(spark: SparkSession, d: str) -> DataFrame:
    """The same without an index, by a look at every chunk."""
    found = ranking.text_hits(views.chunk_texts(spark, d), TERMS, 20)
    return found.select("doc_id", "embed_id", F.col("n_terms").cast("long").alias("n_terms"), F.col("hits").cast("long").alias("hits"))


def _item_terms(spark: SparkSession, d: str) -> dict[int, list[str]]:
    """The four longest words of each benchmark item: as many queries as there are items."""
    words = F.array_distinct(ranking.tokens(F.col("text")))
    longest = F.slice(F.array_sort(F.transform(words, lambda t: F.struct((-F.length(t)).alias("n"), t.alias("t")))), 1, 4)
    return {r[0]: r[1] for r in table(spark, d, "benchmark").select("item_id", F.transform(longest, lambda s: s["t"])).collect()}


def text_search_many(spark: SparkSession, d: str) -> DataFrame:
    """The ten chunks nearest in words to each benchmark item, all items in one plan."""
    found = store.index_of_views(spark, d).top(_item_terms(spark, d), 10)
    return found.select(F.col("qid").alias("item_id"), "rank", "doc_id", "embed_id", "n_terms", "hits")


def text_predicate(spark: SparkSession, d: str) -> DataFrame:
    """Every chunk that holds any of the terms."""
    return store.index_of_views(spark, d).holding_any(TERMS).select("doc_id", "embed_id", "n_terms", "hits")


def text_index_upkeep(spark: SparkSession, d: str) -> DataFrame:
    """The same search after two batches of changes: texts turned round in documents ending in 7, those ending in 3 deleted, and every ninth chunk of the rest."""
    own = store.index_of_views(spark, d).clone(new_path(spark, "index"))
    chunks = views.chunk_texts(spark, d)
    put = chunks.where(F.col("doc_id").endswith("7")).select(F.lit("put").alias("op"), "doc_id", "embed_id", F.reverse("embed_data").alias("embed_data"))
    gone = chunks.where(F.col("doc_id").endswith("3")).select(F.lit("delete").alias("op"), "doc_id", F.lit(None).cast("long").alias("embed_id"), F.lit(None).cast("string").alias("embed_data")).distinct()
    ninth = chunks.where("embed_id % 9 = 0").select(F.lit("delete").alias("op"), "doc_id", "embed_id", F.lit(None).cast("string").alias("embed_data"))
    own.apply(put.unionByName(gone).withColumn("seq", F.lit(0).cast("long")), 0)
    own.apply(ninth.withColumn("seq", F.lit(0).cast("long")), 1)
    own.merge(fan=2)
    return own.top({0: TERMS}, 50).select("doc_id", "embed_id", "n_terms", "hits")


def keyword_cut_shortest(spark: SparkSession, d: str) -> DataFrame:
    words = F.array_distinct(ranking.tokens(F.col("text")))
    return table(spark, d, "documents").select("doc_id", F.array_join(X.shortest_terms(words, 6), " ").alias("terms"))


def token_filter_stopwords(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "conversations").select("conv_id", "turn", F.array_join(X.valid_terms(ranking.tokens(F.col("text")), "en"), " ").alias("terms"))


def keyword_highlight(spark: SparkSession, d: str) -> DataFrame:
    return views.embedding(spark, d).select("doc_id", "embed_id", X.keyword_hits(F.col("embed_data"), F.array(*map(F.lit, TERMS))).alias("key_words"))


def collapse_newlines(spark: SparkSession, d: str) -> DataFrame:
    doubled = F.replace(F.col("text"), F.lit("\n"), F.lit("\n\n\n"))
    return table(spark, d, "documents").select("doc_id", F.md5(X.collapse_newlines(doubled)).alias("text_md5"))


def control_char_scrub(spark: SparkSession, d: str) -> DataFrame:
    """Texts whose letters e and n have become the two control characters."""
    dirty = F.translate("text", "en", "\u000b\u0001")
    return table(spark, d, "documents").select("doc_id", F.md5(X.scrub_control(dirty)).alias("text_md5"))


def rerank_lexical_topk(spark: SparkSession, d: str) -> DataFrame:
    chunks, queries = _ids_and(spark, d)
    near = knn.nearest(knn.scored(chunks, queries), 50).join(chunks.select(*knn.KEYS, "embed_data"), knn.KEYS)
    return ranking.reranked(near, ranking.lexical_score(F.col("embed_data"), TERMS), 0.4, 5).select("doc_id", "embed_id", "distance", "score")


def fixed_delimiter_split(spark: SparkSession, d: str) -> DataFrame:
    marked = F.replace(F.col("text"), F.lit("\n"), F.lit(FIXED_DELIMITER))
    return table(spark, d, "documents").select("doc_id", F.posexplode(chunking.fixed_pieces(marked)).alias("pos", "piece"))


def _lines(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "piece"))


def chunk_offsets(spark: SparkSession, d: str) -> DataFrame:
    return chunking.annotated(_lines(spark, d)).select("doc_id", "chunk_id", "chunk_offset", "chunk_length", F.md5("chunk_data").alias("chunk_md5"))


def chunk_overlap_prefix(spark: SparkSession, d: str) -> DataFrame:
    return chunking.overlapped(_lines(spark, d), 32).select("doc_id", F.col("pos").cast("long").alias("pos"), F.md5("piece").alias("piece_md5"))


def _marked_up(spark: SparkSession, d: str) -> DataFrame:
    block = F.concat(
        F.lit("<!-- image_begin -->\n<!-- image_ocr_content_begin -->\n"), F.col("url"), F.lit("\n<!-- image_ocr_content_end -->\n<!-- image_vlm_description_begin --> seen "),
        F.col("page_id").cast("string"), F.lit(" <!-- image_vlm_description_end -->\n<!-- image_base64_begin --><!-- QUJD"), F.col("page_id").cast("string"),
        F.lit(" --><!-- image_base64_end -->\n<!-- image_end -->"),
    )
    return table(spark, d, "pages").select(views.doc_name(F.col("page_id")).alias("doc_id"), F.concat(F.lit("head\n"), block, F.lit("\nmiddle\n"), block).alias("data"))


def image_block_extract(spark: SparkSession, d: str) -> DataFrame:
    return markup.image_blocks(_marked_up(spark, d))


def ocr_text_extract(spark: SparkSession, d: str) -> DataFrame:
    return _marked_up(spark, d).select("doc_id", markup.ocr_text(F.col("data")).alias("text"))


def _image_hits(spark: SparkSession, d: str) -> DataFrame:
    """Every image chunk as a hit, ranked by length of its text, document and chunk; ranks need no gapless count, so none is made over all rows."""
    number = F.regexp_extract("doc_id", r"\d+", 0).cast("long")
    rank = F.length("embed_data").cast("long") * F.lit(10**12) + number * F.lit(10**6) + F.col("embed_id")
    return views.image_embedding(spark, d).withColumn("rank", rank)


def image_first_chunk_per_image(spark: SparkSession, d: str) -> DataFrame:
    return images.first_chunks(views.image_embedding(spark, d)).select("doc_id", "img_id", "embed_id")


def image_hits_in_order(spark: SparkSession, d: str) -> DataFrame:
    ranked = _image_hits(spark, d).select("rank", "doc_id", "embed_id")
    pairs = images.of_hits(ranked, views.image_embedding(spark, d))
    return images.fetched(pairs, views.image(spark, d)).select("rank", "doc_id", "img_id", F.length("base64_data").cast("long").alias("chars"))


def image_limit_ordered(spark: SparkSession, d: str) -> DataFrame:
    return images.ordered_distinct(_image_hits(spark, d), 3).select("doc_id", "img_id", "rank")


def image_group_by_file(spark: SparkSession, d: str) -> DataFrame:
    grouped = images.by_file(_image_hits(spark, d))
    return grouped.select("doc_id", "rank", F.array_join(F.transform("img_ids", lambda x: x.cast("string")), ",").alias("img_ids"))


def image_first_last(spark: SparkSession, d: str) -> DataFrame:
    return images.first_and_last(views.image(spark, d)).select("doc_id", "img_id")


def image_neighbors(spark: SparkSession, d: str) -> DataFrame:
    return images.gathered(images.ordered_distinct(_image_hits(spark, d), 3), views.image(spark, d), 5)


def image_embedding_rows(spark: SparkSession, d: str) -> DataFrame:
    """Chunk ids count over all images of a document, by kind of data."""
    return images.embedding_rows(views.image(spark, d)).drop("cmetadata")


def image_text_split(spark: SparkSession, d: str) -> DataFrame:
    """Image texts of up to 1,280 letters without a place to cut at, in chunks of 256 that share 25."""
    img = views.image(spark, d).select("doc_id", "img_id", F.expr("repeat(md5(text_data), cast(1 + img_id * length(text_data) % 40 as int))").alias("text"))
    rows = img.select("doc_id", "img_id", F.posexplode(chunking.chunks_of(F.col("text"), 256, 25, library=True)).alias("pos", "piece"))
    return rows.select("doc_id", "img_id", F.col("pos").cast("long").alias("pos"), "piece")


def base64_scrub(spark: SparkSession, d: str) -> DataFrame:
    data = F.concat(F.lit("data:image/png;base64,"), F.translate(F.base64(F.encode("url", "UTF-8")), "\r\n", ""))
    """Each url between images of every kind, its own url again as their data."""
    text = F.concat("url", F.lit(" ![x]("), data, F.lit(') b <img alt="y" src="'), data, F.lit('" width=3> '), F.substring("html", 1, 200), F.lit(" "), data, F.lit(" d"))
    return table(spark, d, "pages").select("page_id", X.scrub_base64_images(text).alias("clean"))


def image_format_sniff(spark: SparkSession, d: str) -> DataFrame:
    opening = F.element_at(F.array(*map(F.lit, ["/9j/", "iVBORw0KGgo", "R0lGODlh", "UklGR", "data:image/gif;base64,", "zz"])), (F.col("page_id") % 6 + 1).cast("int"))
    data = F.concat(opening, F.col("page_id").cast("string"))
    return table(spark, d, "pages").select("page_id", X.image_format(data).alias("format"), X.data_uri(data).alias("uri"))


def citation_split(spark: SparkSession, d: str) -> DataFrame:
    text = F.when(F.col("turn") % 4 == 1, F.concat("text", F.lit(X.CITATION_MARK), F.col("role"), F.lit("  "))).otherwise(F.col("text"))
    parts = X.answer_and_citation(text)
    return table(spark, d, "conversations").select("conv_id", "turn", F.md5(parts["answer"]).alias("answer_md5"), parts["citation"].alias("citation"))


def citation_join(spark: SparkSession, d: str) -> DataFrame:
    """Every turn as an answer that cites a chunk by the turn's number, and chunk 10099, of the document of its conversation's number."""
    source = F.concat(F.lit("doc_"), F.col("conv_id").cast("string"), F.lit(":doc_"), F.col("conv_id").cast("string"), F.lit(".txt"))
    answer = F.concat(F.lit("See [\n  {'EMBED_ID': "), (F.col("turn") % 5 + 10001).cast("string"), F.lit(", 'SOURCE': '"), source, F.lit("'}, {'EMBED_ID': 10099, 'SOURCE': '"), source, F.lit("'}\n] and [\nno {json}\n]"))
    answers = table(spark, d, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("answer_id"), answer.alias("answer"))
    rows = scan_source(spark, d).withColumn("no", F.lit(1))
    found = evaluation.with_content(evaluation.cited(answers), rows)
    return found.select("answer_id", F.col("place").cast("long").alias("place"), F.col("EMBED_ID").alias("embed_id"), F.col("SOURCE").alias("source"), F.col("CONTENT").alias("content"))


def scan_source(spark: SparkSession, d: str) -> DataFrame:
    e = views.embedding(spark, d)
    return e.select("embed_id", F.concat("doc_id", F.lit(":"), F.col("doc_id"), F.lit(".txt")).alias("source"), F.col("embed_data").alias("content"))


def strip_timing_line(spark: SparkSession, d: str) -> DataFrame:
    text = F.when(F.col("turn") % 4 == 1, F.concat("text", F.lit("\n推論時間: 1.00秒"))).otherwise(F.col("text"))
    return table(spark, d, "conversations").where("role = 'assistant'").select("conv_id", "turn", F.md5(X.without_timing_line(text)).alias("text_md5"))


def evaluation_report(spark: SparkSession, d: str) -> DataFrame:
    return evaluation.report(views.qa_result(spark, d), views.qa_feedback(spark, d))


def feedback_explode(spark: SparkSession, d: str) -> DataFrame:
    turns = table(spark, d, "conversations").where("role = 'assistant'")
    at = lambda k: F.max(F.when(F.col("turn") % 4 == k, F.col("text")))
    wide = turns.groupBy("conv_id").agg(at(1).alias("m1_answer"), at(3).alias("m2_answer"), at(1).alias("m1_vlm"), at(3).alias("m2_vlm"))
    wide = wide.withColumns({"query_id": F.concat(F.lit("query_"), F.col("conv_id").cast("string")), "m1_eval": F.lit("8"), "m2_eval": F.lit("6")})
    return evaluation.feedback_rows(wide, ["m1", "m2"])


def result_capture(spark: SparkSession, d: str) -> DataFrame:
    """Each conversation's question and answers kept in one version; every fifth found nothing and is not kept."""
    turns = table(spark, d, "conversations")
    at = lambda k: F.max(F.when(F.col("turn") == k, F.col("text")))
    found = F.when(F.col("conv_id") % 5 == 0, "").otherwise("found")
    wide = turns.groupBy("conv_id").agg(at(0).alias("query"), at(1).alias("m1_answer"), at(3).alias("m2_answer"), at(1).alias("m1_vlm"), at(3).alias("m2_vlm"))
    answers = wide.withColumns({
        "query_id": F.concat(F.lit("query_"), F.col("conv_id").cast("string")), "standard_answer": F.lit(""), "sql": F.concat(F.lit("select "), F.col("conv_id").cast("string")),
        "first_content": found, "m1_eval": F.lit("8"), "m2_eval": F.lit("6"),
    })
    kept = Tables(spark, new_path(spark, "capture"), evaluation.CAPTURE)
    evaluation.captured(kept, answers, ["m1", "m2"], evaluate=False)
    feedback = kept.read("rag_qa_feedback").select("query_id", "llm_name", F.md5("llm_answer").alias("answer_md5"), "ragas_evaluation_result")
    return kept.read("rag_qa_result").select("query_id", F.md5("query").alias("query_md5"), "standard_answer", "sql").join(feedback, "query_id", "left")


def judge_marks(spark: SparkSession, d: str) -> DataFrame:
    """Each turn as a judge's answer: four marks by its numbers, of which some lie above 10, then the turn's text as the reasons."""
    mark = lambda label, n, tail="": F.concat(F.lit(label), n.cast("string"), F.lit(tail + "\n"))
    number, turn = F.col("conv_id"), F.col("turn")
    answer = F.concat(mark("correctness: ", number % 12), mark("", turn % 11), mark("relevance: ", (number + turn) % 10, " / 10"), mark("- clarity: ", turn % 3, ".5"), F.lit("It says: "), "text")
    marks = evaluation.judge_marks(answer)
    return table(spark, d, "conversations").select("conv_id", "turn", *(marks[m].alias(m) for m in evaluation.MARKS))


def human_feedback_update(spark: SparkSession, d: str) -> DataFrame:
    rows = views.qa_feedback(spark, d).withColumn("user_comment", F.lit(None).cast("string"))
    turns = table(spark, d, "conversations").where("role = 'user'")
    changes = turns.select(
        F.concat(F.lit("query_"), F.col("conv_id").cast("string")).alias("query_id"), F.lit("model_1").alias("llm_name"),
        F.when(F.col("turn") % 4 == 0, "good").otherwise("bad").alias("result"), F.col("turn").cast("string").alias("comment"), F.col("turn").alias("seq"),
    )
    return mutation.updated_feedback(rows, changes).select("query_id", "llm_name", F.md5("llm_answer").alias("answer_md5"), "human_evaluation_result", "user_comment")


def cascade_delete(spark: SparkSession, d: str) -> DataFrame:
    """Rows left in each table after the documents whose number ends in 3 left all of them in one version."""
    own = store.collection_of_views(spark, d).clone(new_path(spark, "clone"))
    gone = own.read("collection").where(F.col("id").endswith("3")).select(F.col("id").alias("doc_id"))
    mutation.cascade_delete_stored(own, gone)
    return reduce(DataFrame.unionByName, [own.read(name).agg(F.count("*").alias("rows_left")).withColumn("table_name", F.lit(name)) for name in own.layouts])


def chunk_replace(spark: SparkSession, d: str) -> DataFrame:
    """The odd chunks of documents ending in 7, marked as new, take the place of all chunks of their documents."""
    own = store.chunks_of_views(spark, d).clone(new_path(spark, "clone"))
    new = own.read("embedding").where(F.col("doc_id").endswith("7") & (F.col("embed_id") % 2 == 1)).withColumn("embed_data", F.concat(F.lit("new "), "embed_data"))
    own.change().replace("embedding", new, ["doc_id"]).commit()
    return own.read("embedding").select("doc_id", "embed_id", F.md5("embed_data").alias("data_md5"))


def _with_gaps(spark: SparkSession, d: str) -> DataFrame:
    return views.embedding(spark, d).withColumn("embed_vector", F.when(F.col("embed_id") % 3 != 0, F.col("embed_vector")))


def pending_vectors(spark: SparkSession, d: str) -> DataFrame:
    return mutation.pending(_with_gaps(spark, d)).select("doc_id", "embed_id")


def vector_update(spark: SparkSession, d: str) -> DataFrame:
    """Every third chunk loses its vector; those of documents ending in 1 get one again."""
    own = store.chunks_of_views(spark, d).clone(new_path(spark, "clone"))
    third = own.read("embedding").where(F.col("embed_id") % 3 == 0)
    none = third.withColumns({"embed_vector": F.lit(None).cast("array<float>"), "embed_norm": F.lit(None).cast("double")})
    own.change().update("embedding", none, knn.KEYS, ["embed_vector", "embed_norm"]).commit()
    own.change().update("embedding", third.where(F.col("doc_id").endswith("1")), knn.KEYS, ["embed_vector", "embed_norm"]).commit()
    return own.read("embedding").select("doc_id", "embed_id", F.col("embed_vector").isNotNull().alias("has_vector"))


def metadata_parse(spark: SparkSession, d: str) -> DataFrame:
    text = F.concat(F.lit("dept="), F.col("source"), F.lit(",rule=a=b,lang="), F.col("lang"))
    json = X.metadata_json(text, {"file_name": F.concat(F.lit("doc_"), F.col("doc_id").cast("string"), F.lit(".txt"))})
    return table(spark, d, "documents").select("doc_id", *(F.get_json_object(json, f"$.{k}").alias(k) for k in ("file_name", "dept", "rule", "lang")))


def jsonl_sink_format(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", X.jsonl_line(F.to_json(F.struct("doc_id", "lang", "source")), FIXED_DELIMITER).alias("line"))


def json_array_lines(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    array = F.concat(F.lit('[{"a": '), F.col("doc_id").cast("string"), F.lit("}, 2]"))
    texts = docs.select("doc_id", F.when(F.col("doc_id") % 2 == 0, array).otherwise('{"a": 1}').alias("text"))
    return conversion.json_array_lines(texts).select("doc_id", F.col("pos").cast("long").alias("pos"), "line")


def snowflake_id(spark: SparkSession, d: str) -> DataFrame:
    ms = F.unix_millis(F.col("ts").cast("timestamp"))
    return table(spark, d, "events").select("event_id", X.snowflake_id(ms, 1, 1, F.col("event_id") % 4096, "doc_").alias("id"))


def hashed_ids(spark: SparkSession, d: str) -> DataFrame:
    return views.collection(spark, d).select("id", X.hashed_id(F.col("id")).alias("hashed"))


def preview_text(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.md5(X.preview(F.col("text"))).alias("preview_md5"))


def prompt_render(spark: SparkSession, d: str) -> DataFrame:
    rows = views.qa_result(spark, d)
    return rows.select("query_id", X.rendered("Context: {context}\nQuestion: {query_text}", context=F.col("standard_answer"), query_text=F.col("query")).alias("prompt"))


def download_sheet(spark: SparkSession, d: str) -> DataFrame:
    answers = views.qa_feedback(spark, d).select("query_id", "llm_name", F.concat("llm_answer", F.lit(X.CITATION_MARK + "cited")).alias("llm_answer"), F.lit("v").alias("vlm_answer"), F.lit("8").alias("ragas_evaluation_result"))
    return evaluation.download_sheets(views.qa_result(spark, d), answers, answers)["answers"].select("llm_name", F.md5("llm_answer").alias("answer_md5"), "citation", "vlm_answer", "ragas_evaluation_result")


def recursive_split(spark: SparkSession, d: str) -> DataFrame:
    size, overlap = 288, 32
    docs = table(spark, d, "documents").select("doc_id", F.posexplode(chunking.chunks_of(F.col("text"), size, overlap)).alias("pos", "piece"))
    return chunking.annotated(docs).select("doc_id", "chunk_id", "chunk_offset", "chunk_length", "chunk_data")


def lateral_chunks(spark: SparkSession, d: str) -> DataFrame:
    """recursive_split by a table function in SQL."""
    table_functions.register(spark)
    return spark.sql("SELECT doc_id, c.* FROM {docs}, LATERAL chunks(text, 320, 10) AS c", docs=table(spark, d, "documents").select("doc_id", "text"))


def _blocks(kind: str):
    def run(spark: SparkSession, d: str) -> DataFrame:
        return office.evidence_lines(samples.office_files(table(spark, d, "documents"), kind)).select("path", F.col("pos").cast("long").alias("pos"), "line")

    return run


def _xml(merge: bool):
    def run(spark: SparkSession, d: str) -> DataFrame:
        """Every text's lines as elements, its first line a heading, with the source as a heading before the last element."""
        # What XML cannot hold becomes spaces.
        escaped = F.replace(F.replace(F.replace(F.translate("text", X.NO_XML, " " * len(X.NO_XML)), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
        body = F.replace(F.concat(F.lit("<h>"), escaped, F.lit("</p>")), F.lit("\n"), F.lit("</p><p>"))
        body = F.regexp_replace(body, r"(?s)^(<h>.*?)</p>", "$1</h>")
        text = F.concat(F.lit('<r><s><m kind="'), F.col("lang"), F.lit('"/>'), body, F.lit("<h>"), F.col("source"), F.lit("</h><p>end</p></s></r>"))
        docs = table(spark, d, "documents").select("doc_id", text.alias("text"))
        found = xml_nodes.xml_records(docs, xml_nodes.XmlRules(main="p", prefix="h", everywhere="m", merge=merge))
        return found.select("doc_id", F.col("pos").cast("long").alias("pos"), F.md5("line").alias("line_md5"))

    return run


QUERIES = {
    f.__name__: f
    for f in (
        doc_list, server_path_lookup, document_source_filtered, metadata_filter, doc_id_filter, scan_with_collection, knn_threshold, knn_partitioned_topk, multi_query_fusion, multi_step_query,
        neighbor_expand, merge_adjacent_chunks, first_chunk_extend, hybrid_search_flagship, hybrid_search_reranked, hybrid_search_extend_first,
        answer_by_one, vision_search, result_presentation, result_numbering, text_search_accum, text_search_scan, text_search_many, text_predicate, text_index_upkeep, keyword_cut_shortest, token_filter_stopwords, keyword_highlight,
        collapse_newlines, control_char_scrub, rerank_lexical_topk, fixed_delimiter_split, chunk_offsets, chunk_overlap_prefix, image_block_extract, ocr_text_extract,
        image_first_chunk_per_image, image_hits_in_order, image_limit_ordered, image_group_by_file, image_first_last, image_neighbors, image_embedding_rows, base64_scrub,
        image_format_sniff, citation_split, citation_join, strip_timing_line, evaluation_report, feedback_explode, human_feedback_update, cascade_delete, chunk_replace,
        pending_vectors, vector_update, metadata_parse, jsonl_sink_format, json_array_lines, snowflake_id, hashed_ids, preview_text, prompt_render, download_sheet, recursive_split,
        provider_rerank, query_expansion, document_ingestion, result_capture, judge_marks, image_text_split, knn_many, lateral_chunks, image_prompt_groups, vector_cast, blob_cast,
    )
} | {"knn_cosine": _knn("cosine"), "knn_euclidean": _knn("euclidean"), "knn_dot": _knn("dot")}
QUERIES |= {"excel_blocks": _blocks("xlsx"), "word_blocks": _blocks("docx"), "csv_blocks": _blocks("csv"), "xml_to_blocks": _xml(False), "xml_to_blocks_merged": _xml(True)}
