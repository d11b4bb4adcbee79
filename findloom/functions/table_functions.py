"""Table functions for SQL: chunks of a text and vectors of texts, joined laterally.

    register(spark)
    SELECT doc_id, c.* FROM documents, LATERAL chunks(text, 320, 10) c
    SELECT e.* FROM embedded_rows(TABLE(SELECT doc_id, text FROM documents))

A table function of a row is called beside that row and gives as many rows as the text has chunks; one of a table keeps the
table's columns, holds a batch of rows at most and asks its model once a batch. Rows travel in Arrow batches. Schemas are made
at analysis, from the arguments. A size or an overlap that is no constant, is not positive, or does not fit is refused there, before anything runs.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

from findloom.model import TEXT_BASE, chunk_sizes
from findloom.operators.chunking import split_text
from findloom.providers import TEXT_BATCH, HashingEmbedder, retried

CHUNK = T.StructType([T.StructField(n, k) for n, k in (("chunk_id", T.LongType()), ("chunk_offset", T.LongType()), ("chunk_length", T.LongType()), ("chunk_data", T.StringType()))])


class Chunks:
    """chunks(text, size, overlap in percent): the rows that recursive splitting and offsets give."""

    @staticmethod
    def analyze(text: AnalyzeArgument, size: AnalyzeArgument, overlap: AnalyzeArgument) -> AnalyzeResult:
        if not isinstance(text.dataType, (T.StringType, T.NullType)):
            raise ValueError("chunks() takes a text")
        if not size.isConstantExpression or not overlap.isConstantExpression:
            raise ValueError("size and overlap of chunks() must be constants")
        if not (size.value or 0) > 0 or not 0 <= (overlap.value or 0) < 100:
            raise ValueError("chunks() takes a size above 0 and an overlap from 0 to below 100 percent")
        return AnalyzeResult(schema=CHUNK)

    def eval(self, text: str | None, size: int, overlap: float) -> Iterator[tuple]:
        offset = 1
        for k, piece in enumerate(split_text(text, *chunk_sizes(size, overlap or 0)), TEXT_BASE + 1):
            yield k, offset, len(piece), piece
            offset += len(piece)


class EmbeddedRows:
    """embedded_rows(TABLE(...)): the table's rows with embed_vector, of its last column; null for null."""

    model = HashingEmbedder

    @staticmethod
    def analyze(rows: AnalyzeArgument) -> AnalyzeResult:
        if not rows.isTable or not isinstance(rows.dataType.fields[-1].dataType, T.StringType):
            raise ValueError("embedded_rows() takes a table whose last column is a text")
        return AnalyzeResult(schema=T.StructType([*rows.dataType.fields, T.StructField("embed_vector", T.ArrayType(T.FloatType()))]))

    def __init__(self):
        self.embedder, self.held = self.model(), []

    def eval(self, row: T.Row) -> Iterator[tuple]:
        self.held.append(tuple(row))
        if len(self.held) == TEXT_BATCH:
            yield from self._given()

    def terminate(self) -> Iterator[tuple]:
        yield from self._given()

    def _given(self) -> Iterator[tuple]:
        held, self.held = self.held, []
        asked = [r[-1] for r in held if r[-1] is not None]
        vectors = iter(retried(lambda: self.embedder.embed(asked)) if asked else [])
        for r in held:
            yield *r, None if r[-1] is None else next(vectors)


def chunks():
    return F.udtf(Chunks, useArrow=True)


def embedded_rows():
    return F.udtf(EmbeddedRows, useArrow=True)


def register(spark: SparkSession) -> None:
    """chunks and embedded_rows for SQL of this session."""
    spark.udtf.register("chunks", chunks())
    spark.udtf.register("embedded_rows", embedded_rows())


def with_chunks(rows: DataFrame, text: Column, size: int, overlap_percent: float = 0) -> DataFrame:
    """Each row beside each of its text's chunks; rows without chunks go."""
    call = chunks()(text.outer() if hasattr(text, "outer") else text, F.lit(size), F.lit(overlap_percent))
    return rows.lateralJoin(call)
