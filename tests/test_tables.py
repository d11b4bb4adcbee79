import json

import pytest
from pyspark.sql import functions as F

from findloom.functions import prompts
from findloom.operators import mutation
from findloom.sources import tables


@pytest.fixture
def collection(spark):
    tables.create(spark, "demo")
    yield "demo"
    tables.drop(spark, "demo")


def test_create_is_repeatable_and_rows_can_be_replaced_from_themselves(spark, collection):
    assert tables.create(spark, collection) == []
    rows = spark.createDataFrame([("d1", 10001, "a", None, None), ("d2", 10001, "b", None, None)], spark.table("demo_embedding").schema)
    tables.append(rows, "demo_embedding")
    tables.replace(mutation.without_documents(spark.table("demo_embedding"), spark.createDataFrame([("d1",)], "doc_id string")), "demo_embedding")
    assert [r.doc_id for r in spark.table("demo_embedding").collect()] == ["d2"]
    with pytest.raises(ValueError):
        tables.create(spark, "no name")


def test_edited_chunks(spark):
    schema = "doc_id string, embed_id long, embed_data string, embed_vector array<float>"
    rows = spark.createDataFrame([("d", 1, "a", [1.0]), ("d", 2, "b", [2.0])], schema)
    got = mutation.edited_chunks(rows, spark.createDataFrame([("d", 2, " new ", None)], schema)).orderBy("embed_id").collect()
    assert [tuple(r) for r in got] == [("d", 1, "a", [1.0]), ("d", 2, "new", None)]


def test_replaced_images(spark):
    images = spark.createDataFrame([("d", 1), ("e", 1)], "doc_id string, img_id long")
    a, b = mutation.replaced_images(images, images, images.where("doc_id = 'd'").limit(0), images)
    assert a.count() == 2 and b.count() == 4
    a, b = mutation.replaced_images(images, images, images.where("doc_id = 'd'"), images.where("doc_id = 'd'"))
    assert a.count() == b.count() == 2


def test_sinks(spark, tmp_path):
    rows = spark.createDataFrame([(1, '{"a": 1}')], "x long, j string")
    tables.write_json_lines(rows, "j", str(tmp_path / "lines"))
    assert spark.read.text(str(tmp_path / "lines")).first()[0] == '{"a": 1} <FIXED_DELIMITER>'
    tables.write_sheets({"one": rows, "two": rows}, str(tmp_path / "sheets"))
    assert spark.read.option("header", True).csv(str(tmp_path / "sheets/two")).first().x == "1"
    assert "Physical Plan" in tables.plan_text(rows)


def test_prompts(spark):
    passages = F.array(F.struct(F.lit(1).alias("EMBED_ID"), F.lit("d:f").alias("SOURCE"), F.lit("text {query_text}").alias("CONTENT")))
    got = spark.range(1).select(prompts.answer_prompt(passages, F.lit("why?")).alias("p"), prompts.judge_prompt(F.lit("q"), F.lit("s"), F.lit("a")).alias("j"), prompts.expansion_prompt("fusion", F.lit("q")).alias("e")).first()
    line = next(x for x in got.p.split("\n") if x.startswith("{"))
    assert json.loads(line)["EMBED_ID"] == 1 and got.p.count("why?") == 1
    assert "Standard answer:\ns\n" in got.j and got.e.endswith("q")
