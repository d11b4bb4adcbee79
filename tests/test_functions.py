import pytest
from pyspark.sql import functions as F

from findloom.functions import text as X
from findloom.functions import vectors as V
from findloom.model import SearchRequest, parse_metadata


@pytest.fixture
def one(spark):
    return lambda column: spark.range(1).select(column.alias("x")).first()[0]


def test_collapse_newlines(one):
    assert one(X.collapse_newlines(F.lit("a\n\n\n\nb"))) == "a\nb"


def test_control_characters(one):
    assert one(X.scrub_control(F.lit("a\x0bb\x01c"))) == "a\nb c"


def test_base64_scrub(one):
    assert one(X.scrub_base64_images(F.lit("x ![a](data:image/png;base64,AAAA) y"))) == "x  y"


def test_citation_split(one):
    assert one(X.answer_and_citation(F.lit("none"))) == (None, None)
    assert one(X.answer_and_citation(F.lit("A " + X.CITATION_MARK + "B\n"))) == ("A", "B")


def test_timing_line(one):
    assert one(X.without_timing_line(F.lit("ans\n推論時間: 1.00秒"))) == "ans"
    assert one(X.without_timing_line(F.lit("ans\nmore"))) == "ans\nmore"
    assert one(X.without_timing_line(F.lit(""))) == ""
    assert one(X.without_timing_line(F.lit(None).cast("string"))) is None


def test_keywords(one):
    terms = F.array(F.lit("cat"), F.lit("dog"))
    assert one(X.keyword_hits(F.lit("The Cat"), terms)) == "(1)[cat]"
    assert one(X.keyword_hits(F.lit("none"), terms)) == "(0)[No Match]"


def test_shortest_terms(one):
    terms = F.array(F.lit("aaa"), F.lit("b"), F.lit("cc"))
    assert one(X.shortest_terms(terms, 2)) == ["b", "cc"]
    assert one(X.shortest_terms(terms, 3)) == ["aaa", "b", "cc"]


def test_valid_terms(one):
    assert one(X.valid_terms(F.array(*map(F.lit, ["a", "ab1", "abc", "The", "abc"])))) == ["abc"]


def test_image_format(one):
    for data, kind in (("/9j/x", "jpeg"), ("iVBORw0KGgox", "png"), ("zzz", "jpeg")):
        assert one(X.image_format(F.lit(data))) == kind


def test_metadata():
    assert parse_metadata("dept=hr,year=2024") == {"dept": "hr", "year": "2024"}
    assert parse_metadata("a=b=c") == {"a": "b=c"}
    for bad in ("dept", 'a="b"', "a=1,b", "a='b'", "a=b\\"):
        with pytest.raises(ValueError):
            parse_metadata(bad)


def test_metadata_json(one):
    got = X.metadata_json(F.lit("dept=hr,year=2024"), {"file_name": F.lit("f.txt")})
    assert one(got) == '{"file_name":"f.txt","dept":"hr","year":"2024"}'
    assert one(X.metadata_json(F.lit(""), {"file_name": F.lit("f.txt")})) == '{"file_name":"f.txt"}'


def test_distances(one):
    a, b = V.literal([1, 0]), V.literal([0, 2])
    assert one(V.distance(a, b)) == 1.0
    assert one(V.distance(a, a)) == 0.0
    assert one(V.distance(a, b, "euclidean")) == round(5**0.5, 6)
    assert one(V.distance(a, V.literal([3, 4]), "dot")) == -3.0


def test_snowflake(one):
    assert one(X.snowflake_id(F.lit(1288834974658), 1, 1, 5, "doc_")) == f"doc_{(1 << 22) | (1 << 17) | (1 << 12) | 5}"


def test_search_request():
    with pytest.raises(ValueError):
        SearchRequest(vectors=[[1.0]], extend_around=3)
    with pytest.raises(ValueError):
        SearchRequest(vectors=[])
    image = SearchRequest(vectors=[[1.0]], use_image=True, extend_around=4, extend_first=2, answer_by_one=True)
    assert (image.extend_around, image.extend_first, image.answer_by_one) == (0, 0, False)


def test_batched_products_are_those_of_lambdas(spark):
    from findloom.functions import vectors as V

    odd = [([1.0, 2.0], [3.0, 4.0]), (None, [1.0, 2.0]), ([1.0], None), ([1.0, None], [1.0, 2.0]), ([1.0], [1.0, 2.0]), ([], [])]
    for given in (odd, odd[:1] * 5, odd[1:2], [([], [])], []):
        rows = spark.createDataFrame(given, "a array<float>, b array<float>")
        got = rows.select(V.dot(F.col("a"), F.col("b")).alias("x"), V.dot_batched(F.col("a"), F.col("b")).alias("y")).collect()
        assert all(r.x == r.y for r in got) and len(got) == len(given)
