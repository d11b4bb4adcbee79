"""Exact neighbours by pivots against all distances."""

import numpy as np
import pytest

from findloom.operators import pivots
from findloom.operators.pivots import Clusters


def brute(rows, queries, k):
    """(query, rank, id, distance) by all products."""
    out = []
    units = [(i, np.array(v) / np.linalg.norm(v)) for i, v in rows]
    for q, v in queries:
        v = np.array(v) / np.linalg.norm(v)
        near = sorted((round(1 - float(v @ u), 6) + 0.0, i) for i, u in units)[:k]
        out += [(q, r, i, d) for r, (d, i) in enumerate(near, 1)]
    return sorted(out)


def frame(spark, rows):
    return spark.createDataFrame([(i, v, "x", 1) for i, v in rows], "id long, vector array<float>, distance string, pivot int")


def found(clusters, queries, k):
    return sorted((r[0], r[1], r[2], round(r[3], 6)) for r in clusters.nearest(queries, k).collect())


def clustered(rng, n, dim=8, centres=12):
    middle = rng.normal(size=(centres, dim))
    return [(k, (middle[k % centres] + rng.normal(size=dim) / 20).astype(np.float32).tolist()) for k in range(n)]


class TestPivots:
    def test_a_thousand_queries(self, spark):
        rows = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").selectExpr("vec_id as id", "embedding as vector")
        own = [(r.id, r.vector) for r in rows.collect()]
        assert found(Clusters(rows), rows.where("id < 1000"), 10) == brute(own, [r for r in own if r[0] < 1000], 10)

    @pytest.mark.parametrize("piece", [2048, 20])
    def test_clusters_are_passed_over(self, spark, monkeypatch, piece):
        monkeypatch.setattr(pivots, "PIECE", piece)
        rows = clustered(np.random.default_rng(1), 3000)
        clusters = Clusters(frame(spark, rows))
        queries = frame(spark, rows[:200])
        assert found(clusters, queries, 5) == brute(rows, rows[:200], 5)
        assert clusters.share_read(queries, 5) < 0.5

    def test_ties_go_by_id(self, spark):
        rows = [(k, [1.0, 2.0]) for k in range(30)] + [(k, [2.0, 4.0]) for k in range(30, 40)]
        assert [r[2] for r in found(Clusters(frame(spark, rows)), frame(spark, [(7, [3.0, 6.0])]), 5)] == [0, 1, 2, 3, 4]

    def test_odd_rows(self, spark):
        good = [(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [-1.0, 0.0]), (3, [-1.0, 0.0]), (4, [1e-30, 0.0])]
        odd = [(None, [1.0, 0.0]), (5, None), (6, [None, 1.0]), (7, [float("nan"), 1.0]), (8, [float("inf"), 1.0]), (9, [0.0, 0.0]), (10, [1.0]), (11, [])]
        clusters = Clusters(frame(spark, good + odd))
        assert found(clusters, frame(spark, good + odd), 9) == brute(good, good, 9)
        assert found(Clusters(frame(spark, [])), frame(spark, good), 3) == []
        assert found(clusters, frame(spark, []), 3) == []
