"""Schemas of the tables, search parameters, and their validation."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

_s = lambda name, kind=T.StringType(), null=True: T.StructField(name, kind, null)
VECTOR = T.ArrayType(T.FloatType())

COLLECTION = T.StructType([_s("id", null=False), _s("data"), _s("cmetadata")])
EMBEDDING = T.StructType([_s("doc_id"), _s("embed_id", T.LongType()), _s("embed_data"), _s("embed_vector", VECTOR), _s("cmetadata")])
IMAGE = T.StructType([_s("doc_id"), _s("img_id", T.LongType()), _s("text_data"), _s("vlm_data"), _s("base64_data")])
IMAGE_EMBEDDING = T.StructType([*EMBEDDING.fields, _s("img_id", T.LongType())])
QA_RESULT = T.StructType([_s("id", T.LongType()), _s("query_id"), _s("query"), _s("standard_answer"), _s("sql"), _s("created_date", T.TimestampType())])
QA_FEEDBACK = T.StructType(
    [_s("id", T.LongType()), *map(_s, ["query_id", "llm_name", "llm_answer", "vlm_answer", "ragas_evaluation_result", "human_evaluation_result", "user_comment"]), _s("created_date", T.TimestampType())]
)
SEARCH_RESULT = T.StructType(
    [_s("no", T.IntegerType()), _s("content"), _s("embed_id", T.LongType()), _s("source"), _s("distance", T.DoubleType()), _s("score", T.DoubleType()), _s("key_words")]
)

#: Stored chunks lie in so many folders, by hash of the document; a parameter of a store, to be larger for a larger one.
CHUNK_SHELVES = 32


def chunk_shelf(doc_id: Column, shelves: int = CHUNK_SHELVES) -> Column:
    return F.pmod(F.xxhash64(doc_id), F.lit(shelves)).cast("int")


#: Chunk ids begin here by kind of data.
TEXT_BASE, DESCRIPTION_BASE, IMAGE_BASE = 10_000, 30_000, 50_000
#: The distance of a chunk that came in as a neighbour only.
SENTINEL = 999_999.0
FIXED_DELIMITER = "<FIXED_DELIMITER>"


def parse_metadata(text: str | None) -> dict[str, str]:
    """`k=v,k=v` -> dict, split at the first = of each part; ValueError for what the grammar does not allow."""
    if not text:
        return {}
    if any(c in text for c in "\"'\\"):
        raise ValueError('metadata must not contain ", \' or \\')
    parts = text.split(",")
    if any("=" not in p for p in parts):
        raise ValueError("metadata must be key=value pairs separated by commas")
    return dict(p.split("=", 1) for p in parts)


def chunk_sizes(maximum: int, overlap_percent: float) -> tuple[int, int]:
    """(chunk size, overlap) for a maximum chunk length and an overlap in percent of it."""
    overlap = int(maximum * overlap_percent / 100)
    return maximum - overlap, overlap


@dataclass(frozen=True)
class SearchRequest:
    """Parameters of a search. Vectors are those of the query and of up to three sub-queries."""

    vectors: list[list[float]]
    query: str = ""
    doc_ids: list[str] | None = None
    metadata: str = ""
    top_k: int = 20
    threshold: float = 0.70
    partition_by: int = 0
    extend_first: int = 0
    extend_around: int = 0
    text_search: bool = False
    text_search_k: int = 6
    terms: list[str] = field(default_factory=list)
    rerank: bool = False
    rerank_top_k: int = 5
    rerank_threshold: float = 0.4
    answer_by_one: bool = False
    use_image: bool = False

    def __post_init__(self):
        if not self.vectors or len(self.vectors) > 4:
            raise ValueError("one query vector and up to three sub-query vectors are needed")
        if self.extend_around % 2:
            raise ValueError("extend_around must be even: half of it lies on each side")
        for name, low, high in (("top_k", 1, 100), ("text_search_k", 1, 10), ("rerank_top_k", 1, 50), ("extend_first", 0, 50), ("extend_around", 0, 50), ("partition_by", 0, 20)):
            if not low <= getattr(self, name) <= high:
                raise ValueError(f"{name} must lie in {low}..{high}")
        parse_metadata(self.metadata)
        if self.use_image:
            # Images are answered one by one from whole hits: nothing is extended and no single source is chosen.
            for name, value in (("answer_by_one", False), ("extend_first", 0), ("extend_around", 0)):
                object.__setattr__(self, name, value)
