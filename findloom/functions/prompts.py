"""Prompts for answers, query expansion, image answers and judging, as templates for functions.text.rendered."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from findloom.functions.text import rendered

ANSWER = """Answer the question from the passages below and from nothing else. If they do not hold the answer, say so.

Passages:
{context}

Question:
{query_text}
"""
CITED = (
    ANSWER
    + """
After the answer, list the passages that it rests on as a JSON array of objects with EMBED_ID and SOURCE, each on lines of its own.
"""
)
EXPANSIONS = {
    "sub_query": "Break the question into at most three simpler ones. Give one a line, numbered.\n\n{query_text}",
    "fusion": "Give three other wordings of the question that a search could use. One a line, numbered.\n\n{query_text}",
    "hypothetical": "Write a short passage that would answer the question, as a document might.\n\n{query_text}",
    "step_back": "Give the more general question behind this one.\n\n{query_text}",
}
JUDGE = """Compare the answer with the standard answer. Give marks from 0 to 10 for correctness, completeness, relevance and clarity,
one a line, then one sentence of reasons.

Question:
{query_text}

Standard answer:
{standard_answer}

Answer:
{answer}
"""


def context(passages: Column) -> Column:
    """JSON lines of an array of passages (EMBED_ID, SOURCE, CONTENT)."""
    return F.array_join(F.transform(passages, lambda p: F.to_json(p)), "\n")


def answer_prompt(passages: Column, query: Column, cite: bool = True, template: str | None = None) -> Column:
    return rendered(template or (CITED if cite else ANSWER), context=context(passages), query_text=query)


def judge_prompt(query: Column, standard_answer: Column, answer: Column) -> Column:
    return rendered(JUDGE, query_text=query, standard_answer=standard_answer, answer=answer)


def expansion_prompt(kind: str, query: Column) -> Column:
    return rendered(EXPANSIONS[kind], query_text=query)
