import pytest
from pyspark.sql import functions as F

from findloom import providers as P
from findloom.model import EMBEDDING
from findloom.streaming.incremental import embed_new_chunks, windowed_feedback


class Broken:
    def embed(self, texts):
        return []


def test_embedder_is_deterministic_and_unit():
    a, b = P.HashingEmbedder().embed(["one two", "one two"])
    assert a == b and abs(sum(x * x for x in a) - 1) < 1e-5


def test_embedded_column(spark):
    rows = spark.createDataFrame([("a b",), (None,)], "t string")
    got = [r.v for r in rows.select(P.embedded(F.col("t"), P.HashingEmbedder).alias("v")).collect()]
    assert len(got[0]) == 64 and got[1] is None


def test_a_short_answer_fails_the_batch(spark):
    with pytest.raises(Exception, match="0 vectors for 1 texts"):
        spark.range(1).select(P.embedded(F.lit("x"), Broken).alias("v")).collect()


def test_reranker_column(spark):
    rows = spark.createDataFrame([("a b", "a c"), ("a b", None)], "q string, t string")
    assert [r.s for r in rows.select(P.reranked_scores(F.col("q"), F.col("t"), P.LexicalReranker).alias("s")).collect()] == [0.5, 0.0]


def test_answers_by_model(spark):
    prompts = spark.createDataFrame([("q", "x\nwhat?")], "query_id string, prompt string")
    rows = P.answered(prompts, {"m1": P.TemplateChat, "m2": P.TemplateChat}).collect()
    assert sorted((r.llm_name, r.llm_answer) for r in rows) == [("m1", "Answer to: what?"), ("m2", "Answer to: what?")]


def test_tokenizer():
    assert P.RegexTokenizer().terms("The quick fox1 jumped and jumped", "en") == ["quick", "jumped"]
    assert P.safe_terms(None, "x") == []


def test_sub_queries():
    assert P.sub_queries("1. a\n\n2. b\nc\nd") == ["a", "b", "c"]


def test_retry():
    tries = []

    def call():
        tries.append(1)
        if len(tries) < 3:
            raise OSError

    P.retried(call, pause=0)
    assert len(tries) == 3


def test_new_chunks_get_vectors_once(spark, tmp_path):
    source, target, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    rows = [("d", 1, "text", None, None), ("d", 2, "has one", [1.0, 2.0], None)]
    for _ in range(2):
        spark.createDataFrame(rows, EMBEDDING).write.mode("append").parquet(source)
        embed_new_chunks(spark, source, target, state, P.HashingEmbedder).awaitTermination(60)
    got = spark.read.schema(EMBEDDING).parquet(target).collect()
    assert len(got) == 4 and sorted({len(r.embed_vector) for r in got}) == [2, 64]


def test_windowed_feedback(spark, tmp_path):
    spark.sql("select timestamp'2024-01-01 00:10:00' created_date, 'm' llm_name, 'good' human_evaluation_result union all select timestamp'2024-01-01 00:20:00', 'm', 'bad'").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("created_date timestamp, llm_name string, human_evaluation_result string").parquet(str(tmp_path / "in"))
    query = windowed_feedback(stream).writeStream.outputMode("complete").format("memory").queryName("feedback").trigger(availableNow=True).start()
    query.awaitTermination(60)
    assert [(r.answers, r.good) for r in spark.table("feedback").collect()] == [(2, 1)]
