"""Query expansion: a model's further queries beside the query itself, and the vectors of both."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from findloom.functions.prompts import expansion_prompt
from findloom.functions.text import stripped
from findloom.providers import ChatModel, Embedder, answers, embedded

LIMIT = 3


def sub_queries(answer: Column, limit: int = LIMIT) -> Column:
    """The first lines of a model's answer that are not blank, numbering taken off."""
    lines = F.transform(F.split(answer, "\n"), lambda line: F.regexp_replace(stripped(line), r"^\d+\.\s*", ""))
    return F.slice(F.filter(lines, lambda line: line != ""), 1, limit)


def itself(queries: DataFrame) -> DataFrame:
    """queries(query_id, query) -> query_id, qid 0, query; blank ones go."""
    return queries.where(stripped(F.col("query")) != "").select("query_id", F.lit(0).cast("long").alias("qid"), "query")


def expanded(queries: DataFrame, kind: str, chat: Callable[[], ChatModel], limit: int = LIMIT) -> DataFrame:
    """queries(query_id, query) -> query_id, qid, query: 0 the query itself, 1 to `limit` the model's; the model is asked once a query."""
    own = itself(queries)
    made = own.select("query_id", "query", sub_queries(answers(expansion_prompt(kind, F.col("query")), chat), limit).alias("more"))
    all_of = F.concat(F.array("query"), F.coalesce("more", F.array().cast("array<string>")))
    return made.select("query_id", F.posexplode(all_of).alias("qid", "query")).withColumn("qid", F.col("qid").cast("long"))


def vectors(queries: DataFrame, embedder: Callable[[], Embedder]) -> DataFrame:
    """queries(query_id, qid, query) -> query_id, qid, vector."""
    return queries.select("query_id", "qid", embedded(F.col("query"), embedder).alias("vector"))
