"""Model providers: embedder, reranker, tokenizer and chat model behind one-method interfaces.

The classes here need no network and always give the same results; they stand in for real models, and are named so.
A provider is made once a task, inside the Arrow function that calls it, and is asked in batches.
"""

from __future__ import annotations

import base64
import hashlib
import re
import threading
import time
from collections.abc import Callable, Iterator
from functools import reduce
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TEXT_BATCH, IMAGE_BATCH, RERANK_BATCH = 96, 1, 200


class Embedder(Protocol):
    def embed(self, texts: list[str]) -> list[list[float]]: ...


class Reranker(Protocol):
    def score(self, query: str, texts: list[str]) -> list[float]: ...


class Tokenizer(Protocol):
    def terms(self, text: str, language: str, limit: int) -> list[str]: ...


class ChatModel(Protocol):
    def answer(self, prompt: str) -> str: ...


class HashingEmbedder:
    """Stand-in: signed word hashes summed to a unit vector."""

    def __init__(self, dimension: int = 64):
        self.dimension = dimension

    def embed(self, texts: list[str]) -> list[list[float]]:
        out = np.zeros((len(texts), self.dimension), np.float32)
        for row, text in enumerate(texts):
            for word in re.findall(r"\w+", text.lower()):
                h = int.from_bytes(hashlib.blake2b(word.encode(), digest_size=8).digest(), "big")
                out[row, h % self.dimension] += 1 if h >> 63 else -1
        norm = np.linalg.norm(out, axis=1, keepdims=True)
        return (out / np.where(norm == 0, 1, norm)).tolist()


class LexicalReranker:
    """Stand-in: the share of the query's words that a text holds."""

    def score(self, query: str, texts: list[str]) -> list[float]:
        words = set(re.findall(r"\w+", query.lower()))
        return [len(words & set(re.findall(r"\w+", t.lower()))) / max(1, len(words)) for t in texts]


class RegexTokenizer:
    """Stand-in: words by pattern, through the filters and the shortest-first limit of a search."""

    def terms(self, text: str, language: str = "en", limit: int = 10) -> list[str]:
        from findloom.functions.text import STOP_WORDS, TERM_LENGTHS

        low, high = TERM_LENGTHS[language]
        stops = set(STOP_WORDS)
        found = [w for w in dict.fromkeys(re.findall(r"[^\W_]+", text)) if low <= len(w) <= high and not re.search(r"\d", w) and w.lower() not in stops]
        return found if len(found) <= limit else sorted(found, key=len)[:limit]


class ImageBytesEmbedder:
    """Stand-in: the unit vector of how often each byte value, by its upper six bits, occurs in base64 data."""

    def embed(self, texts: list[str]) -> list[list[float]]:
        out = np.zeros((len(texts), 64), np.float32)
        for row, text in enumerate(texts):
            data = np.frombuffer(base64.b64decode(text + "=" * (-len(text) % 4)), np.uint8)
            out[row] = np.bincount(data >> 2, minlength=64)
        norm = np.linalg.norm(out, axis=1, keepdims=True)
        return (out / np.where(norm == 0, 1, norm)).tolist()


class SentenceChat:
    """Stand-in: the sentences of the prompt's last line, numbered."""

    def answer(self, prompt: str) -> str:
        last = prompt.strip().split("\n")[-1]
        return "\n".join(f"{n}. {s}" for n, s in enumerate(last.split(". "), 1))


class TemplateChat:
    """Stand-in: repeats the end of the prompt."""

    def answer(self, prompt: str) -> str:
        return f"Answer to: {prompt.strip().splitlines()[-1] if prompt.strip() else ''}"


def safe_terms(tokenizer: Tokenizer, text: str, language: str = "en", limit: int = 10, seconds: float = 5.0) -> list[str]:
    """No terms if the tokenizer fails or takes longer than that: the search then goes by vectors alone."""
    return in_time([lambda: tokenizer.terms(text, language, limit)], seconds, seconds)[0] or []


def retried(call: Callable, tries: int = 3, pause: float = 10.0):
    """call(), again after pause, 2*pause ... seconds if it fails."""
    for n in range(1, tries + 1):
        try:
            return call()
        except Exception:
            if n == tries:
                raise
            time.sleep(pause * n)


def embedded(text: Column, make: Callable[[], Embedder], batch: int = TEXT_BATCH, pause: float = 0.0) -> Column:
    """array<float> of each text, null for null; a batch that gives another number of vectors fails the task."""

    def run(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        model = make()
        for part in parts:
            texts = part.to_pylist()
            asked = [k for k, t in enumerate(texts) if t is not None]
            out: list = [None] * len(texts)
            for at in range(0, len(asked), batch):
                own = asked[at : at + batch]
                vectors = retried(lambda own=own: model.embed([texts[k] for k in own]), pause=pause)
                if len(vectors) != len(own):
                    raise RuntimeError(f"{len(vectors)} vectors for {len(own)} texts")
                for k, v in zip(own, vectors):
                    out[k] = v
                if pause:
                    time.sleep(pause)
            yield pa.array(out, pa.list_(pa.float32()))

    run.__annotations__ = {"parts": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return F.arrow_udf(run, "array<float>")(text)


def reranked_scores(query: Column, text: Column, make: Callable[[], Reranker], batch: int = RERANK_BATCH) -> Column:
    """The reranker's score of each text for its query."""

    def run(parts: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        model = make()
        for queries, texts in parts:
            out: list = [0.0] * len(texts)
            by_query: dict[str, list[int]] = {}
            for k, q in enumerate(queries.to_pylist()):
                by_query.setdefault(q or "", []).append(k)
            for q, own in by_query.items():
                for at in range(0, len(own), batch):
                    part = own[at : at + batch]
                    for k, s in zip(part, model.score(q, [texts[i].as_py() or "" for i in part])):
                        out[k] = float(s)
            yield pa.array(out, pa.float64())

    run.__annotations__ = {"parts": Iterator[tuple[pa.Array, pa.Array]], "return": Iterator[pa.Array]}
    return F.arrow_udf(run, "double")(query, text)


def answers(prompt: Column, make: Callable[[], ChatModel]) -> Column:
    """The model's answer to each prompt, null for null."""

    def run(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        model = make()
        for part in parts:
            yield pa.array([None if p is None else model.answer(p) for p in part.to_pylist()], pa.string())

    run.__annotations__ = {"parts": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return F.arrow_udf(run, "string")(prompt)


def answered(prompts: DataFrame, models: dict[str, Callable[[], ChatModel]]) -> DataFrame:
    """prompts(query_id, prompt) x models -> query_id, llm_name, llm_answer; each model's answers are tasks of their own."""
    parts = [prompts.select("query_id", F.lit(name).alias("llm_name"), answers(F.col("prompt"), make).alias("llm_answer")) for name, make in models.items()]
    return reduce(DataFrame.unionByName, parts)


def in_time(calls: list[Callable], step: float = 60.0, total: float = 120.0) -> list:
    """What each call gives, None where it fails or takes over `step` seconds, or over what is left of `total` for all."""
    end = time.monotonic() + total
    out: list = [None] * len(calls)

    def one(k: int, box: list) -> None:
        try:
            box.append(calls[k]())
        except Exception:
            return

    for k in range(len(calls)):
        wait = min(step, end - time.monotonic())
        if wait <= 0:
            break
        box: list = []
        # A daemon: a call that hangs must not keep the worker alive.
        worker = threading.Thread(target=one, args=(k, box), daemon=True)
        worker.start()
        worker.join(wait)
        out[k] = box[0] if box else None
    return out


def fanned_out(prompts: Column, make: Callable[[], ChatModel], step: float = 60.0, total: float = 120.0) -> Column:
    """array<string> of answers to an array of prompts, one after the other, null for those that were not answered in time."""

    def run(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        model = make()
        for part in parts:
            rows = [None if own is None else in_time([lambda p=p: model.answer(p) for p in own], step, total) for own in part.to_pylist()]
            yield pa.array(rows, pa.list_(pa.string()))

    run.__annotations__ = {"parts": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return F.arrow_udf(run, "array<string>")(prompts)


def sub_queries(answer: str, limit: int = 3) -> list[str]:
    """Lines of a model's answer as sub-queries, numbering taken off."""
    lines = [re.sub(r"^\d+\.\s*", "", line.strip()) for line in answer.split("\n")]
    return [line for line in lines if line][:limit]
