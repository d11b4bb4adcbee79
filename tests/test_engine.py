"""The engine put together: ingestion, image chunks, expansion, providers in a search, and prompts of images."""

import time

import pytest
from pyspark.sql import functions as F

from findloom import providers as P
from findloom.functions import text as X
from findloom.functions import vectors as V
from findloom.model import SearchRequest
from findloom.operators import chunking, expansion, images, ingestion, knn, search

CHUNKS = "doc_id string, embed_id long, embed_data string, embed_vector array<float>"


class Slow:
    def answer(self, prompt):
        time.sleep(5 if prompt == "slow" else 0)
        return prompt.upper()


class Lines:
    def answer(self, prompt):
        return "1. cat\n\n 2. dog \n3. cow\n4. pig"


class LastWord:
    def score(self, query, texts):
        return [float(query.split()[-1] in t) for t in texts]


@pytest.fixture(scope="module")
def animals(spark):
    rows = [("d1", 10001, "cat"), ("d1", 10005, "dog"), ("d2", 10001, "cow"), ("d2", 10009, "tree"), ("d3", 10001, "what")]
    return spark.createDataFrame(rows, "doc_id string, embed_id long, embed_data string").withColumn("embed_vector", P.embedded(F.col("embed_data"), P.HashingEmbedder))


@pytest.fixture(scope="module")
def names(spark):
    return spark.createDataFrame([(f"d{k}", f'{{"file_name": "{k}.txt"}}') for k in (1, 2, 3)], "id string, cmetadata string")


def test_expansion_asks_for_three_further_queries(spark):
    asked = spark.createDataFrame([("q1", "what"), ("q2", " \n"), ("q3", None)], "query_id string, query string")
    rows = expansion.expanded(asked, "sub_query", Lines).orderBy("qid").collect()
    assert [(r.query_id, r.qid, r["query"]) for r in rows] == [("q1", 0, "what"), ("q1", 1, "cat"), ("q1", 2, "dog"), ("q1", 3, "cow")]


def test_a_search_by_the_query_and_its_expansions(animals, names):
    request = SearchRequest(vectors=[[0.0]], query="what", threshold=0.1)
    found = search.expanded_search(animals, names, request, Lines, P.HashingEmbedder)
    assert {r.content for r in found.collect()} == {"what", "cat", "dog", "cow"}
    assert search.expanded_search(animals, names, SearchRequest(vectors=[[0.0]], query=" "), Lines, P.HashingEmbedder).collect() == []


def test_multi_step_search(animals, names):
    request = SearchRequest(vectors=[[0.0]], query="what", threshold=0.1)
    found = search.expanded_search(animals, names, request, Lines, P.HashingEmbedder, "multi_step").collect()
    assert "what" in {r.content for r in found} and len(found) == 3


def test_a_reranker_scores_the_passages(animals, names):
    request = SearchRequest(vectors=[[0.0]], query="a dog", threshold=2.0, rerank=True)
    queries = expansion.vectors(expansion.itself(animals.sparkSession.createDataFrame([("", "cat")], "query_id string, query string")), P.HashingEmbedder)
    found = search.search(animals, names, request, queries, reranker=LastWord)
    assert [(r.content, r.score) for r in found.collect()] == [("dog", 1.0)]
    assert "Physical Plan" in search.with_plan(found)[1]


def test_stored_norms_give_the_same_distances(animals):
    queries = animals.limit(2).select(F.lit(0).alias("qid"), F.col("embed_vector").alias("vector"))
    plain = knn.scored(animals, queries).collect()
    assert sorted(map(tuple, knn.scored(knn.with_norms(animals), queries).collect())) == sorted(map(tuple, plain))


def test_vision_mode_searches_the_image_chunks(spark, animals, names):
    seen = spark.createDataFrame([("d1", 30001, "a picture", [1.0, 0.0])], CHUNKS)
    request = SearchRequest(vectors=[[1.0, 0.0]], use_image=True)
    assert [r.content for r in search.search(animals, names, request, image_chunks=seen).collect()] == ["a picture"]


def test_ingestion_replaces_chunks_and_gives_vectors(spark):
    rows = spark.createDataFrame([("a", 10001, "old", [1.0]), ("a", 10002, "old", [1.0]), ("b", 10001, "kept", [2.0]), ("c", 10001, "gone", [3.0])], CHUNKS)
    new = spark.createDataFrame([("a", "one. two. three.", None), ("c", "  ", None), ("e", None, None)], "id string, data string, cmetadata string")
    got = ingestion.ingested(rows, new, P.HashingEmbedder, maximum=6, overlap_percent=0).orderBy("doc_id", "embed_id").collect()
    want = [("a", 10001, "one.", 64), ("a", 10002, "two.", 64), ("a", 10003, "three.", 64), ("b", 10001, "kept", 1)]
    assert [(r.doc_id, r.embed_id, r.embed_data, len(r.embed_vector)) for r in got] == want


def test_library_splitter():
    assert chunking.split_text("aa bb cc dd", 5, 0, library=True) == ["aa bb", "cc", "dd"]
    assert chunking.split_text("aa bb cc dd", 6, 3, library=True) == ["aa bb", "bb cc", "cc dd"]
    assert chunking.split_text("x<FIXED_DELIMITER>y", 100, library=True) == ["x<FIXED_DELIMITER>y"]
    assert chunking.split_text("para one\n\npara two", 10, library=True) == ["para one", "para two"]
    assert chunking.split_text("abcdefgh", 3, library=True) == ["abc", "def", "gh"]


def test_image_chunks_count_over_a_document(spark):
    seen = spark.createDataFrame([("d", 1, "aa bb cc", None, "QUJD"), ("d", 2, "dd", "see", ""), ("d", 3, None, " ", None)], "doc_id string, img_id long, text_data string, vlm_data string, base64_data string")
    rows = images.embedding_rows(seen, size=5, overlap=0)
    got = sorted((r.data_type, r.embed_id, r.img_id, r.embed_data) for r in rows.collect())
    assert got == [("base64_data", 50001, 1, images.IMAGE_TEXT), ("text_data", 10001, 1, "aa bb"), ("text_data", 10002, 1, "cc"), ("text_data", 10003, 2, "dd"), ("vlm_data", 30001, 2, "see")]
    done = images.embedded_rows(rows, seen, P.HashingEmbedder, P.ImageBytesEmbedder)
    vectors = {r.embed_id: list(r.embed_vector) for r in done.collect()}
    assert len(vectors) == 5 and vectors[50001] == pytest.approx(P.ImageBytesEmbedder().embed(["QUJD"])[0])


def test_prompts_of_images_by_mode(spark):
    shown = spark.createDataFrame([(1, "b", 2, "/9j/"), (2, "a", 1, "/9j/"), (3, "b", 1, "zz")], "rank long, doc_id string, img_id long, base64_data string")
    found = lambda mode: [(r.doc_ids, r.img_ids) for r in images.grouped(shown, mode).orderBy("place").collect()]
    assert found(1) == [(["b"], [2]), (["a"], [1]), (["b"], [1])]
    assert found(2) == [(["a", "b", "b"], [1, 1, 2])]
    assert found(3) == [(["b", "b"], [1, 2]), (["a"], [1])]


def test_late_answers_are_null(spark):
    rows = spark.createDataFrame([(["a", "slow", "b"],), (None,)], "p array<string>")
    assert [r.a for r in rows.select(P.fanned_out(F.col("p"), Slow, step=1.0).alias("a")).collect()] == [["A", None, "B"], None]
    assert P.in_time([lambda: 1, lambda: 1 / 0, lambda: 2], 1.0, 5.0) == [1, None, 2]
    assert P.in_time([lambda: time.sleep(3), lambda: 2], 5.0, 0.3) == [None, None]


def test_casts(spark):
    row = spark.createDataFrame([("[1, 2.5]", "none", "é")], "a string, b string, c string").select(V.from_text(F.col("a")), V.from_text(F.col("b")), X.to_blob(F.col("c"))).first()
    assert list(row[0]) == [1.0, 2.5] and row[1] is None and bytes(row[2]) == "é".encode()


def _cut(text, separator, size, overlap, later):
    """Brute force: every window of pieces by prefix sums, written without the module's running total."""
    if separator == "":
        parts = list(text)
    elif separator in ("。", ". ", " "):
        ends = [k + len(separator) for k in range(len(text)) if text.startswith(separator, k)]
        parts = [text[a:b] for a, b in zip([0, *ends], [*ends, len(text)])]
    else:
        parts = text.split(separator)
    parts = [p for p in parts if p.strip()]
    out, run = [], []

    def windows():
        at = [0]
        for p in run:
            at.append(at[-1] + len(p))
        first = 0
        for last in range(1, len(run) + 1):
            if last == len(run) or at[last + 1] - at[first] > size:
                if whole := "".join(run[first:last]).strip():
                    out.append(whole)
                if last < len(run):
                    first = next(f for f in range(first, last + 1) if f == last or (at[last] - at[f] <= overlap and at[last + 1] - at[f] <= size))

    for p in parts:
        if len(p) < size:
            run.append(p)
            continue
        windows()
        run.clear()
        out += _split(p, size, overlap, later) if later else [p]
    windows()
    return out


def _split(text, size, overlap, separators=("\n\n", "。", ". ", "\n", " ", "")):
    at = next(k for k, s in enumerate(separators) if s in text)
    return _cut(text, separators[at], size, overlap, separators[at + 1 :])


def test_recursive_split_of_all_documents_equals_brute_force(spark, sf_dir):
    from findloom.plans.queries import QUERIES

    got: dict = {}
    for r in QUERIES["recursive_split"](spark, sf_dir).orderBy("doc_id", "chunk_id").collect():
        got.setdefault(r.doc_id, []).append((r.chunk_id, r.chunk_offset, r.chunk_length, r.chunk_data))
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()}
    want: dict = {}
    for doc, text in texts.items():
        plain = _split(text, 288, 32) if text and text.strip() else []
        led = plain[:1] + [a[-32:] + b for a, b in zip(plain, plain[1:])]
        before = 1
        for k, chunk in enumerate(led):
            want.setdefault(doc, []).append((10001 + k, before, len(chunk), chunk))
            before += len(chunk)
    assert got == want
