import pytest
from pyspark.sql import functions as F

from findloom.model import SearchRequest
from findloom.operators import images, knn, mutation, neighbours, ranking, search
from findloom.sources import store, views
from findloom.sources.shared import Files


@pytest.fixture(scope="module")
def chunks(spark):
    rows = [("d1", 10001, "x,", [1.0, 0.0]), ("d1", 10002, "y", [0.9, 0.1]), ("d1", 10004, "z,,", [0.0, 1.0]), ("d2", 10001, "the cat", [0.7, 0.7])]
    return spark.createDataFrame(rows, "doc_id string, embed_id long, embed_data string, embed_vector array<float>")


@pytest.fixture(scope="module")
def names(spark):
    return spark.createDataFrame([("d1", '{"file_name": "one.txt", "lang": "en"}'), ("d2", '{"file_name": "two.txt", "lang": "fr"}')], "id string, cmetadata string")


def found(chunks, names, **more):
    return search.search(chunks, names, SearchRequest(vectors=[[1.0, 0.0]], threshold=1.0, **more)).orderBy("no").collect()


def test_islands_join_neighbours_and_trim_commas(chunks, names):
    rows = found(chunks, names, top_k=3)
    assert [(r.embed_id, r.content, r.source) for r in rows] == [(10001, "x,,y", "d1:one.txt"), (10001, "the cat", "d2:two.txt")]
    rows = found(chunks, names)
    assert (10004, "z") in [(r.embed_id, r.content) for r in rows]


def test_expansion_adds_only_chunks_that_exist(chunks, names):
    assert {r.embed_id for r in found(chunks, names, top_k=1)} == {10001}
    rows = found(chunks, names, top_k=1, extend_around=6)
    assert [(r.embed_id, r.content, r.distance) for r in rows] == [(10001, "x,,y", 0.0), (10004, "z", None)]


def test_expansion_only_adds(chunks, names):
    near = {(r.source, r.content) for r in found(chunks, names, top_k=2)}
    wide = {(r.source, r.content) for r in found(chunks, names, top_k=2, extend_around=2)}
    assert all(any(c in w and s == t for t, w in wide) for s, c in near)


def test_filters(chunks, names):
    assert {r.source for r in found(chunks, names, metadata="lang=fr")} == {"d2:two.txt"}
    assert {r.source for r in found(chunks, names, doc_ids=["d1"])} == {"d1:one.txt"}
    assert found(chunks, names, doc_ids=["none"]) == []
    assert found(chunks, names, doc_ids=["none"], answer_by_one=True, extend_first=1) == []


def test_answer_by_one_keeps_the_first_source(chunks, names):
    assert {r.source for r in found(chunks, names, answer_by_one=True)} == {"d1:one.txt"}


def test_each_source_gets_one_prefix_first(chunks, names):
    rows = found(chunks, names, extend_first=1)
    assert [(r.source[:2], r.content) for r in rows] == [("d1", "x"), ("d1", "x,,y"), ("d1", "z"), ("d2", "the cat"), ("d2", "the cat")]


def test_rerank_limits_and_thresholds(chunks, names):
    rows = found(chunks, names, rerank=True, terms=["cat", "dog"], rerank_top_k=1)
    assert [(r.content, r.score, r.key_words) for r in rows] == [("the cat", 0.5, "(1)[cat]")]
    assert found(chunks, names, rerank=True, terms=["none"]) == []


def test_text_arm_ignores_the_threshold(chunks, names):
    request = SearchRequest(vectors=[[1.0, 0.0]], threshold=0.1, text_search=True, terms=["cat"])
    assert "the cat" in {r.content for r in search.search(chunks, names, request).collect()}


def test_presented(chunks, names):
    request = SearchRequest(vectors=[[1.0, 0.0]], threshold=1.0, top_k=1, extend_around=6)
    last = search.presented(search.search(chunks, names, request)).orderBy("NO").collect()[-1]
    assert (last.DISTANCE, last.SCORE) == ("-", "-")


def test_fusion_is_the_least_distance(spark, chunks):
    queries = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 1.0])], "qid int, vector array<float>")
    scores = knn.scored(chunks, queries)
    want = {(r.doc_id, r.embed_id): r.d for r in scores.groupBy("doc_id", "embed_id").agg(F.min("distance").alias("d")).collect()}
    assert {(r.doc_id, r.embed_id): r.distance for r in knn.fused(knn.nearest(scores, 10)).collect()} == want


def test_partitioned_top_k_counts_documents(spark, chunks):
    queries = spark.createDataFrame([(0, [1.0, 0.0])], "qid int, vector array<float>")
    rows = knn.nearest_by_document(knn.scored(chunks, queries), 1, 2).collect()
    assert sorted((r.doc_id, r.embed_id) for r in rows) == [("d1", 10001), ("d1", 10002)]


def test_offsets():
    assert neighbours.offsets(4) == [-2, -1, 0, 1, 2] and neighbours.offsets(0) == [0]
    with pytest.raises(ValueError):
        neighbours.offsets(3)


def test_vector_store(spark, chunks):
    store = search.VectorStore(chunks.withColumn("cmetadata", F.lit('{"k": "v"}')))
    assert [r.embed_id for r in store.similarity_search([1.0, 0.0], k=2).collect()] == [10001, 10002]
    assert store.similarity_search([1.0, 0.0], metadata="k=w").count() == 0
    assert store.delete(["d1"]).rows.count() == 1 and store.add_texts(store.rows).rows.count() == 8


def test_image_modes(spark):
    all_images = spark.createDataFrame([("d", i) for i in range(1, 10)], "doc_id string, img_id long")
    hit = spark.createDataFrame([(1, "d", 5)], "rank int, doc_id string, img_id long")
    ids = lambda mode: sorted(r.img_id for r in images.gathered(hit, all_images, mode).collect())
    assert (ids(1), ids(4), ids(5)) == ([5], [1, 5, 9], [1, 4, 5, 6, 9])


def test_first_chunk_of_each_image(spark):
    rows = spark.createDataFrame([("d1", 1, 10001), ("d1", 1, 30001), ("d1", 2, 10002)], "doc_id string, img_id long, embed_id long")
    assert sorted(tuple(r) for r in images.first_chunks(rows).collect()) == [("d1", 1, 10001), ("d1", 2, 10002)]


def test_mutations(spark, chunks):
    gone = spark.createDataFrame([("d1",)], "doc_id string")
    assert mutation.without_documents(chunks, gone).count() == 1
    new = chunks.where("embed_id = 10002").withColumn("embed_data", F.lit("new"))
    assert sorted(r.embed_data for r in mutation.replaced_chunks(chunks, new).collect()) == ["new", "the cat"]
    empty = mutation.empty_to_null(chunks.withColumn("embed_data", F.lit("")), "embed_data")
    assert empty.where("embed_data is null").count() == 4


def test_text_scores(chunks):
    rows = ranking.text_hits(chunks, ["cat", "the", "y"], 5).collect()
    assert [(r.doc_id, r.n_terms, r.hits) for r in rows] == [("d2", 2, 2), ("d1", 1, 1)]


def test_held_terms_are_whole_tokens(spark):
    texts = ["The cat's category; CAT cat_cat été", "", None, "xcat cat1 éCat", "cat\ncat"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    for terms in (["cat", "the", "été", "Cat"], ["cat's", "a b", ""], []):
        wanted = F.array(*(F.lit(t.lower()) for t in terms)).cast("array<string>")
        plain = F.filter(ranking.tokens(F.col("t")), lambda t: F.array_contains(wanted, t))
        got = rows.select(F.coalesce(ranking.held_terms(F.col("t"), terms), F.array().cast("array<string>")).alias("a"), F.coalesce(plain, F.array().cast("array<string>")).alias("b"))
        assert all(r.a == r.b for r in got.collect())


class TestStoredSearch:
    """Searches over the store give what searches over plain views give, and read less."""

    @pytest.mark.parametrize("more", [{}, {"doc_ids": ["doc_3", "doc_14", "doc_15", "doc_40"]}, {"metadata": "lang=fr"}, {"doc_ids": [f"doc_{k}" for k in range(0, 400, 2)], "extend_first": 2}])
    def test_same_as_views(self, spark, sf_dir, more):
        request = SearchRequest(vectors=[[0.0]], terms=["the", "and", "la"], threshold=0.95, extend_around=2, text_search=True, **more)
        asked = views.query_vectors(spark, sf_dir, [7, 77]).withColumn("qid", F.when(F.col("qid") == 7, 0).otherwise(F.col("qid")))
        collection = views.collection(spark, sf_dir)
        plain = search.search(views.embedding(spark, sf_dir), collection, request, asked)
        stored = search.search(store.chunks_of_views(spark, sf_dir).read("embedding"), collection, request, asked, index=store.index_of_views(spark, sf_dir))
        rows = [sorted(map(tuple, r.collect())) for r in (plain, stored)]
        assert rows[0] == rows[1] and rows[0]

    def test_chunks_never_move_and_other_shelves_stay_unread(self, spark, sf_dir):
        from findloom.plans.queries import QUERIES

        found = QUERIES["merge_adjacent_chunks"](spark, sf_dir)
        found.collect()
        plan = found._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
        scan = next(line for line in plan.split("\n") if "FileScan parquet" in line and "embed_data" in line)
        assert "dynamicpruning" in scan.lower()
        # From the scan of texts up to its join with the hits there is no exchange of its side.
        lines = plan.split("\n")
        at = lines.index(scan)
        depth = lambda line: len(line) - len(line.lstrip(" :+-"))
        above, level = [], depth(scan)
        for line in reversed(lines[:at]):
            if depth(line) < level:
                level = depth(line)
                above.append(line)
        join = next(k for k, line in enumerate(above) if "BroadcastHashJoin" in line)
        assert not any("Exchange" in line for line in above[:join])

    def test_the_text_arm_reads_no_text(self, spark, sf_dir):
        from findloom.plans.queries import QUERIES

        plan = QUERIES["text_search_accum"](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
        assert "embed_data" not in plan and "text#" not in plan

    def test_a_store_that_was_emptied_is_made_again(self, spark, sf_dir):
        tables = store.chunks_of_views(spark, sf_dir)
        n = tables.read("embedding").count()
        Files(spark, tables.folder).delete()
        again = store.chunks_of_views(spark, sf_dir)
        assert again.folder != tables.folder and again.read("embedding").count() == n
