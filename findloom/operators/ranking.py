"""Keyword scoring, reranking, single-source answers and numbering of results."""

from __future__ import annotations

from unicodedata import category

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ORDER = ["distance", "doc_id", "embed_id"]


def tokens(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), "")


def spaced_tokens(text: Column) -> Column:
    """tokens() as one text with a space between each two: far less to make and to send than an array of texts."""
    return F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " "))


def valid_terms(terms: list[str]) -> list[str]:
    """Lower-cased distinct terms; a token is letters and digits only, so a term with anything else is never one."""
    return [t for t in dict.fromkeys(t.lower() for t in terms) if t and all(category(c)[0] in "LN" for c in t)]


def held_terms(text: Column, terms: list[str]) -> Column:
    """The tokens of a text that are terms, as often as they occur: found by one pattern, without an array of all tokens."""
    wanted = valid_terms(terms)
    if not wanted:
        return F.array().cast("array<string>")
    return F.regexp_extract_all(F.lower(text), F.lit(rf"(?<![\p{{L}}\p{{N}}])(?:{'|'.join(wanted)})(?![\p{{L}}\p{{N}}])"), 0)


def term_scores(chunks: DataFrame, terms: list[str]) -> DataFrame:
    """chunks(doc_id, embed_id, embed_data) that hold any term -> doc_id, embed_id, n_terms, hits."""
    found = chunks.select("doc_id", "embed_id", held_terms(F.col("embed_data"), terms).alias("held")).where(F.size("held") > 0)
    return found.select("doc_id", "embed_id", F.size(F.array_distinct("held")).alias("n_terms"), F.size("held").alias("hits"))


def text_hits(chunks: DataFrame, terms: list[str], k: int) -> DataFrame:
    """The k chunks with most distinct terms, then most hits."""
    return term_scores(chunks, terms).orderBy(F.desc("n_terms"), F.desc("hits"), "doc_id", "embed_id").limit(k)


def lexical_score(content: Column, terms: list[str]) -> Column:
    """Share of the terms that occur in the content: the offline stand-in for a reranking model."""
    if not terms:
        return F.lit(0.0)
    hits = sum(((F.contains(F.lower(content), F.lit(t.lower()))).cast("int") for t in terms), F.lit(0))
    return F.round(hits / F.lit(float(len(terms))), 6)


def reranked(results: DataFrame, score: Column, threshold: float, k: int) -> DataFrame:
    """Results of at least `threshold`, best first, k at most; a missing score is 0."""
    out = results.withColumn("score", F.coalesce(score, F.lit(0.0))).where(F.col("score") >= threshold)
    return out.orderBy(F.desc("score"), *ORDER).limit(k)


def numbered(results: DataFrame, *order) -> DataFrame:
    """NO 1..n over a result list, which the limits before it keep short."""
    return results.withColumn("no", F.row_number().over(Window.orderBy(*order)))


def answered_by_one(ranked: DataFrame) -> DataFrame:
    """Rows whose source is that of the first row; no rows give none."""
    first = ranked.orderBy("no").limit(1).select(F.col("source").alias("only"))
    return ranked.join(F.broadcast(first), F.col("source") == F.col("only"), "left_semi")


def with_prefixes(ranked: DataFrame, prefixes: DataFrame) -> DataFrame:
    """Rows grouped by source in order of first appearance, each group led by its prefix row.

    ranked(no, doc_id, source, content, embed_id, distance, score), prefixes(doc_id, content, embed_id).
    """
    lead = F.min("no").over(Window.partitionBy("source"))
    rows = ranked.withColumn("lead", lead).withColumn("is_hit", F.lit(1))
    heads = rows.groupBy("doc_id", "source").agg(F.min("lead").alias("lead"))
    own = heads.join(prefixes, "doc_id").withColumns({"is_hit": F.lit(0), "no": F.lit(0), "distance": F.lit(None).cast("double"), "score": F.lit(None).cast("double")})
    both = rows.unionByName(own.select(rows.columns))
    return numbered(both.withColumnRenamed("no", "was"), "lead", "is_hit", "was").drop("lead", "is_hit", "was")
