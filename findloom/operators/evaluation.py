"""Capture, update and report of answers and their evaluation; citations of answers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from findloom.functions import text as X
from findloom.operators.mutation import empty_to_null
from findloom.sources.snapshots import Layout, Tables

NO_CITATION = "回答にコンテキストが存在しないか、コンテキストの形式が正しくありません。"


def _text(*names: str) -> T.StructType:
    return T.StructType([T.StructField(n, T.StringType()) for n in names])


#: What captured() keeps.
CAPTURE = {"rag_qa_result": Layout(_text("query_id", "query", "standard_answer", "sql")), "rag_qa_feedback": Layout(_text("query_id", "llm_name", "llm_answer", "vlm_answer", "ragas_evaluation_result"))}


def feedback_rows(answers: DataFrame, models: list[str], evaluate: bool = True) -> DataFrame:
    """answers(query_id, <model>_answer, <model>_vlm, <model>_eval) -> a row for each model that answered."""
    parts = F.array(
        *(
            F.struct(
                F.lit(m).alias("llm_name"),
                F.col(f"{m}_answer").alias("llm_answer"),
                X.scrub_base64_images(F.col(f"{m}_vlm")).alias("vlm_answer"),
                (F.col(f"{m}_eval") if evaluate else F.lit("")).alias("ragas_evaluation_result"),
            )
            for m in models
        )
    )
    return answers.select("query_id", F.explode(parts).alias("f")).select("query_id", "f.*").where("llm_answer is not null")


def result_rows(answers: DataFrame) -> DataFrame:
    """answers(query_id, query, standard_answer, sql, first_content) -> the result row of each query that asked something and found something.

    A query that is null or empty, and one whose first result has no content, is not kept; an empty string is kept as null.
    """
    kept = answers.where((F.coalesce("query", F.lit("")) != "") & (F.coalesce("first_content", F.lit("")) != ""))
    return empty_to_null(kept.select("query_id", "query", "standard_answer", "sql"), "standard_answer", "sql")


def captured(tables: Tables, answers: DataFrame, models: list[str], evaluate: bool = True) -> int:
    """The result row and the feedback rows of answers, kept in one version; gives the version.

    answers: the columns of result_rows() and of feedback_rows().
    """
    own = result_rows(answers)
    feedback = feedback_rows(answers.join(own.select("query_id"), "query_id", "left_semi"), models, evaluate)
    return tables.change().append("rag_qa_result", own).append("rag_qa_feedback", feedback).commit()


MARKS = ("correctness", "completeness", "relevance", "clarity")


def judge_marks(answer: Column) -> Column:
    """struct of the four marks of a judge's answer, from 0 to 10; null if it does not give four.

    A mark stands on a line of its own, alone or after a label or number and a colon, with or without `/10`; the first four lines
    like that count, and one that lies outside 0 to 10 makes the answer one without marks.
    """
    line = r"(?m)^[ \t*\-]*(?:[^:：\n]{1,40}[:：][ \t*]*)?(\d+(?:\.\d+)?)[ \t*]*(?:/[ \t]*10)?[ \t*.]*$"
    marks = F.transform(F.slice(F.regexp_extract_all(answer, F.lit(line), 1), 1, len(MARKS)), lambda m: m.cast("double"))
    good = (F.size(marks) == len(MARKS)) & ~F.exists(marks, lambda m: m > 10)
    return F.when(good, F.struct(*(F.get(marks, F.lit(k)).alias(name) for k, name in enumerate(MARKS))))


def report(results: DataFrame, feedback: DataFrame) -> DataFrame:
    """Every result with its feedback, if any; dates as text."""
    shown = F.date_format("created_date", "yyyy-MM-dd HH:mm:ss")
    return results.withColumn("created_date", shown).join(feedback, "query_id", "left")


def cited(answers: DataFrame) -> DataFrame:
    """answers(answer_id, answer) -> answer_id, place, EMBED_ID, SOURCE of each citation in JSON arrays of the answer.

    An array that is no JSON after single quotes are read as double ones gives no rows; EMBED_ID must be a whole number to be looked up.
    """
    arrays = F.regexp_extract_all("answer", F.lit(r"(?s)\[\n.*?\{.*?\}\n.*?\]"), 0)
    clean = F.transform(arrays, lambda a: F.translate(a, "'\n\r", '"'))
    items = F.flatten(F.transform(clean, lambda a: F.coalesce(F.from_json(a, "array<struct<EMBED_ID:string,SOURCE:string>>"), F.array().cast("array<struct<EMBED_ID:string,SOURCE:string>>"))))
    rows = answers.select("answer_id", F.posexplode(items).alias("place", "c"))
    return rows.select("answer_id", "place", "c.EMBED_ID", "c.SOURCE").where("EMBED_ID is not null and SOURCE is not null")


def with_content(citations: DataFrame, results: DataFrame) -> DataFrame:
    """citations(EMBED_ID, SOURCE, ...) -> with CONTENT of the first result of that id and source, N/A if none; quotes and line ends made plain."""
    wanted = citations.select(F.col("EMBED_ID").cast("long").alias("embed_id"), F.col("SOURCE").alias("source")).distinct()
    # Only what is cited is grouped: the other contents go no further than their scan.
    own = results.join(wanted, ["embed_id", "source"], "left_semi")
    first = own.groupBy(F.col("embed_id").alias("i"), F.col("source").alias("s")).agg(F.min_by("content", "no").alias("c"))
    both = citations.join(first, (F.col("EMBED_ID").cast("long") == F.col("i")) & (F.col("SOURCE") == F.col("s")), "left")
    plain = F.translate(F.coalesce("c", F.lit("N/A")), '"\n\r', "'  ")
    return both.withColumn("CONTENT", plain).drop("i", "s", "c")


def download_sheets(query: DataFrame, results: DataFrame, answers: DataFrame) -> dict[str, DataFrame]:
    """The three sheets of a query's export: the query, its results, and each model's answer with its citation apart."""
    split = X.answer_and_citation(F.col("llm_answer"))
    models = answers.withColumn("a", split).select(
        "llm_name", F.coalesce("a.answer", "llm_answer").alias("llm_answer"), F.col("a.citation").alias("citation"), X.scrub_base64_images(F.col("vlm_answer")).alias("vlm_answer"), "ragas_evaluation_result"
    )
    return {"query": query, "results": results, "answers": models}
