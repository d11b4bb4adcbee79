"""Words of Japanese and Chinese text, which has no spaces: a unigram model learned from the corpus, and its best paths.

Texts are cut into runs of Han characters and kana. Every substring of up to `longest` characters that occurs twice is a candidate;
the `vocabulary` of most characters covered are kept, and every single character. Expectation maximisation then gives
each its probability: tasks hold the model (as many rows as the vocabulary, a parameter) and sum, over all ways to cut each
distinct run, how often a piece is expected; sums by piece come to the driver, a row a piece. Likelihood alone would keep every
frequent neighbourhood as a word: a piece that others make up almost as probably (within `gain`) goes, and the rest are
learned again. Pieces that are expected less than `least` times go at the end. A text is cut along its most probable path.

Stop words are the terms that more than a share of the documents hold. UnigramTokenizer is a Tokenizer as searches take it.

Defined cases: texts without such characters have no runs and no terms; a corpus without any gives a model without pieces, which cuts
a run into its characters; characters that the model has not seen are cut one by one; a null text has no terms.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from findloom.functions.text import TERM_LENGTHS
from findloom.sources.shared import written

RUN = r"[\p{IsHan}\p{IsHiragana}\p{IsKatakana}ー々]+"
LONGEST, VOCABULARY, ROUNDS, LEAST, GAIN = 6, 30_000, 5, 1.5, 2.5
#: The log probability of a character that the model lacks.
UNSEEN = -30.0
STOP_SHARE, STOP_WORDS = 0.3, 500


@dataclass(frozen=True)
class Unigram:
    """Log probabilities of pieces."""

    pieces: dict[str, float] = field(default_factory=dict)
    longest: int = 1

    def _ends(self, run: str, at: int) -> Iterator[tuple[int, str, float]]:
        """(end, piece, log probability) of the pieces that begin at a place; a character at least."""
        for end in range(at + 1, min(at + self.longest, len(run)) + 1):
            piece = run[at:end]
            p = self.pieces.get(piece)
            if p is not None:
                yield end, piece, p
            elif end == at + 1:
                yield end, piece, UNSEEN

    def cut(self, run: str) -> list[str]:
        """The most probable pieces; of equally probable cuts the one with longer first pieces."""
        best: list[tuple[float, int]] = [(-math.inf, 0)] * len(run) + [(0.0, 0)]
        for at in range(len(run) - 1, -1, -1):
            best[at] = max((p + best[end][0], end) for end, _, p in self._ends(run, at))
        out, at = [], 0
        while at < len(run):
            out.append(run[at : best[at][1]])
            at = best[at][1]
        return out

    def without_compounds(self, gain: float) -> Unigram:
        """The pieces whose best cut into others is less probable by more than `gain`, and single characters."""
        kept = {}
        for piece, p in self.pieces.items():
            best = [-math.inf] * len(piece) + [0.0]
            for at in range(len(piece) - 1, -1, -1):
                best[at] = max((q + best[end] for end, own, q in self._ends(piece, at) if own != piece), default=-math.inf)
            if len(piece) == 1 or p - best[0] > gain:
                kept[piece] = p
        return Unigram(kept, self.longest)

    def expected(self, run: str) -> tuple[dict[str, float], float]:
        """(how often each piece is expected over all cuts, log likelihood of the run)."""
        n = len(run)
        ahead, behind = [-math.inf] * (n + 1), [-math.inf] * (n + 1)
        ahead[0] = behind[n] = 0.0
        steps = [list(self._ends(run, at)) for at in range(n)]
        add = lambda a, b: max(a, b) + math.log1p(math.exp(-abs(a - b))) if min(a, b) > -math.inf else max(a, b)
        for at in range(n):
            for end, _, p in steps[at]:
                ahead[end] = add(ahead[end], ahead[at] + p)
        for at in range(n - 1, -1, -1):
            for end, _, p in steps[at]:
                behind[at] = add(behind[at], p + behind[end])
        counts: dict[str, float] = defaultdict(float)
        for at in range(n):
            for end, piece, p in steps[at]:
                counts[piece] += math.exp(ahead[at] + p + behind[end] - ahead[n])
        return counts, ahead[n]


def runs_of(text: Column) -> Column:
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(RUN), 0)


def candidates(runs: DataFrame, longest: int = LONGEST, vocabulary: int = VOCABULARY) -> Unigram:
    """runs(run, n) -> the first model: substrings by how many characters they cover."""
    pieces = lambda n: F.transform(F.sequence(F.lit(1), F.length("run") - n + 1), lambda i: F.substring(F.col("run"), i, n))
    grams = F.flatten(F.transform(F.sequence(F.lit(1), F.least(F.lit(longest), F.length("run"))), pieces))
    counted = runs.select(F.explode(grams).alias("piece"), "n").groupBy("piece").agg(F.sum("n").alias("n")).withColumn("size", F.length("piece"))
    wide = counted.where("size > 1 and n > 1").orderBy(F.desc(F.col("n") * F.col("size")), "piece").limit(vocabulary)
    # As many rows as the vocabulary, and one for each character that occurs.
    found = {r["piece"]: float(r["n"] * r["size"]) for part in (wide, counted.where("size = 1")) for r in part.collect()}
    return _model(found, longest)


def _model(weights: dict[str, float], longest: int) -> Unigram:
    total = sum(weights.values())
    return Unigram({k: math.log(w / total) for k, w in weights.items() if w > total * math.exp(UNSEEN)}, max(map(len, weights), default=1) if weights else longest)


def expected_counts(runs: DataFrame, model: Unigram) -> tuple[dict[str, float], float]:
    """runs(run, n) -> (expected uses of each piece, log likelihood of all runs)."""

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str | None, float] = defaultdict(float)
        for batch in batches:
            for run, n in zip(*(c.to_pylist() for c in batch.columns)):
                counts, likelihood = model.expected(run)
                for piece, c in counts.items():
                    sums[piece] += n * c
                sums[None] += n * likelihood
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.string()), pa.array(list(sums.values()), pa.float64())], ["piece", "n"])

    # A task's sums have a row a piece of the model at most.
    sums = runs.select("run", "n").mapInArrow(step, "piece string, n double").groupBy("piece").agg(F.sum("n").alias("n"))
    found = {r["piece"]: r["n"] for r in sums.collect()}
    return {k: n for k, n in found.items() if k is not None}, found.get(None, 0.0)


def learned(docs: DataFrame, column: str = "text", longest: int = LONGEST, vocabulary: int = VOCABULARY, rounds: int = ROUNDS, least: float = LEAST, gain: float = GAIN) -> tuple[Unigram, list[list[float]]]:
    """(a model of the texts, log likelihood of each round, with all candidates and then without compounds)."""
    runs = docs.select(F.explode(runs_of(F.col(column))).alias("run")).groupBy("run").agg(F.count("*").alias("n"))
    runs = written(runs, "runs")
    model, told = candidates(runs, longest, vocabulary), [[], []]
    counts: dict[str, float] = {}
    for phase in told if model.pieces else []:
        for _ in range(rounds):
            counts, likelihood = expected_counts(runs, model)
            phase.append(likelihood)
            model = _model(counts, longest)
        model = model.without_compounds(gain)
    counts = {k: n for k, n in counts.items() if k in model.pieces}
    return _model({k: n for k, n in counts.items() if n >= least or len(k) == 1}, longest), told


def terms_of(text: Column, model: Unigram) -> Column:
    """array<string> of the pieces of a text's runs, in order."""

    def cut(runs: pa.Array) -> pa.Array:
        return pa.array([[p for run in own for p in model.cut(run)] for own in runs.to_pylist()], pa.list_(pa.string()))

    cut.__annotations__ = {"runs": pa.Array, "return": pa.Array}
    return F.arrow_udf(cut, "array<string>")(runs_of(text))


def stop_words(docs: DataFrame, model: Unigram, column: str = "text", share: float = STOP_SHARE, most: int = STOP_WORDS) -> list[str]:
    """The terms that more than that share of the documents hold, most frequent first; `most` of them at most come to the driver."""
    held = docs.select(F.explode(F.array_distinct(terms_of(F.col(column), model))).alias("term")).groupBy("term").agg(F.count("*").alias("n"))
    top = held.where(F.col("n") > F.lit(share * docs.count())).orderBy(F.desc("n"), "term").limit(most)
    return [r["term"] for r in top.collect()]


class UnigramTokenizer:
    """Terms of a query: distinct pieces of the lengths that the language allows, without stop words, the shortest where there are more than `limit`."""

    def __init__(self, model: Unigram, stops: list[str] = ()):
        self.model, self.stops = model, frozenset(stops)

    def terms(self, text: str, language: str = "ja", limit: int = 10) -> list[str]:
        import regex

        low, high = TERM_LENGTHS[language]
        pieces = [p for run in regex.findall(r"[\p{Han}\p{Hiragana}\p{Katakana}ー々]+", text or "") for p in self.model.cut(run)]
        found = [p for p in dict.fromkeys(pieces) if low <= len(p) <= high and p not in self.stops]
        return found if len(found) <= limit else sorted(found, key=len)[:limit]
