"""Distances between a vector column and another one, in double precision, null where either is null."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

DIGITS = 6


def literal(vector: list[float]) -> Column:
    return F.array(*(F.lit(float(x)) for x in vector))


def _sum(products: Column) -> Column:
    return F.aggregate(products, F.lit(0.0), lambda total, x: total + x)


def dot(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))


def dot_batched(a: Column, b: Column) -> Column:
    """dot() of two float columns in Arrow batches: products of whole columns, where lambdas would look at each number.

    Null where either is null, holds a null, or is of another length than the other.
    """

    def run(left: pa.Array, right: pa.Array) -> pa.Array:
        plain = [x for x in (left, right) if x.null_count == 0 and x.flatten().null_count == 0]
        n = left.value_lengths().to_numpy() if len(plain) == 2 else None
        if n is not None and len(n) and (n == n[0]).all() and right.value_lengths().equals(left.value_lengths()):
            rows = [x.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(x), n[0]) for x in plain]
            return pa.array(np.einsum("ij,ij->i", *rows))
        # Rows of all kinds, one by one.
        both = zip(left.to_pylist(), right.to_pylist())
        fits = lambda u, v: u is not None and v is not None and len(u) == len(v) and None not in u and None not in v
        return pa.array([sum((x * y for x, y in zip(u, v)), 0.0) if fits(u, v) else None for u, v in both], pa.float64())

    run.__annotations__ = {"left": pa.Array, "right": pa.Array, "return": pa.Array}
    return F.arrow_udf(run, "double")(a, b)


def norm(a: Column) -> Column:
    return F.sqrt(_sum(F.transform(a, lambda x: x.cast("double") * x.cast("double"))))


def from_text(text: Column) -> Column:
    """A vector that is written as `[x, y, ...]`; null for what is no list of numbers."""
    return F.from_json(text, "array<float>")


def cosine_distance(a: Column, b: Column, norm_b: Column | None = None, norm_a: Column | None = None) -> Column:
    return 1 - dot(a, b) / ((norm(a) if norm_a is None else norm_a) * (norm(b) if norm_b is None else norm_b))


def euclidean_distance(a: Column, b: Column) -> Column:
    return F.sqrt(_sum(F.zip_with(a, b, lambda x, y: F.pow(x.cast("double") - y.cast("double"), F.lit(2.0)))))


def negative_dot(a: Column, b: Column) -> Column:
    return -dot(a, b)


def rounded(x: Column) -> Column:
    """To DIGITS places, zero without a sign."""
    return F.round(x, DIGITS) + F.lit(0.0)


METRICS = {"cosine": cosine_distance, "euclidean": euclidean_distance, "dot": negative_dot}


def distance(a: Column, b: Column, metric: str = "cosine") -> Column:
    """Rounded, so that a threshold or a tie falls the same way in every engine."""
    return rounded(METRICS[metric](a, b))
