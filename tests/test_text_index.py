"""The text index against counting tokens of every chunk: random term sets, segments, merges, crashes."""

import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from findloom.operators import postings, ranking
from findloom.sources.shared import new_path
from findloom.sources.snapshots import Change, Tables
from findloom.streaming import index_upkeep
from findloom.streaming.index_upkeep import CHANGES, TextIndex, keep_index

CHUNK = "doc_id string, embed_id long, embed_data string"


def ranked(chunks, terms, k):
    """[(doc_id, embed_id, distinct terms, hits)] best first, by looking at each token."""
    wanted, found = set(postings.valid_terms(terms)), []
    for doc, at, text in chunks:
        held = [t for t in re.split(r"[\W_]+", (text or "").lower()) if t in wanted]
        if held:
            found.append((-len(set(held)), -len(held), doc, at))
    return [(d, a, -n, -h) for n, h, d, a in sorted(found)[:k]]


def random_chunks(rng, n):
    words = [f"w{k}" for k in range(60)] + ["été", "THE", "x-y"]
    weight = 1 / np.arange(1, len(words) + 1)
    text = lambda: " ".join(rng.choice(words, rng.integers(0, 40), p=weight / weight.sum()))
    return [(f"d{k % 17}", 10_000 + k, text()) for k in range(n)]


def result(index, queries, k):
    rows = index.top(queries, k).orderBy("qid", "rank").collect()
    return {q: [(r.doc_id, r.embed_id, r.n_terms, r.hits) for r in rows if r.qid == q] for q in queries}


@pytest.fixture(scope="module")
def filled(spark):
    chunks = [*random_chunks(np.random.default_rng(1), 1500), ("d0", 1, None), ("d0", 2, "  "), ("d0", 3, "rare w0 rare")]
    index = TextIndex(spark, new_path(spark, "index"), shelves=4)
    index.build(spark.createDataFrame(chunks, CHUNK))
    return index, chunks


class TestTopChunks:
    def test_random_term_sets(self, filled):
        index, chunks = filled
        rng = np.random.default_rng(2)
        words = [f"w{k}" for k in range(60)] + ["ÉTÉ", "the", "x", "y", "none", "rare"]
        queries = {q: [str(t) for t in rng.choice(words, rng.integers(1, 6))] for q in range(100)}
        queries |= {100: [], 101: ["x-y", ""], 102: ["none"], 103: ["w0", "W0", "w0"]}
        got = result(index, queries, 7)
        assert got == {q: ranked(chunks, terms, 7) for q, terms in queries.items()}

    def test_more_than_there_are(self, filled):
        index, chunks = filled
        assert result(index, {0: ["rare"]}, 50) == {0: ranked(chunks, ["rare"], 50)}

    def test_blocks_are_passed_over(self, filled, monkeypatch):
        index, _ = filled
        # One chunk holds "rare": its block is the only one that can reach two terms.
        evaluated, every = postings.open_blocks(index.rows(), None, {0: ["rare", "w0"]}, 1, index.layout)
        assert (evaluated, every > 20) == (1, True)

    def test_the_plan_reads_the_terms_only(self, filled):
        index, _ = filled
        plan = index.top({0: ["w3", "w5"]}, 5)._jdf.queryExecution().executedPlan().toString()
        assert "PartitionFilters: [isnotnull(shelf" in plan or "PartitionFilters: [shelf" in plan
        assert "In(term, [w3,w5])" in plan
        assert "embed_data" not in plan

    def test_predicate(self, filled):
        index, chunks = filled
        got = sorted((r.doc_id, r.embed_id, r.n_terms, r.hits) for r in index.holding_any(["w3", "rare"]).collect())
        assert got == sorted(ranked(chunks, ["w3", "rare"], 10**6))

    def test_empty_index(self, spark):
        index = TextIndex(spark, new_path(spark, "index"), shelves=4)
        index.build(spark.createDataFrame([], CHUNK))
        assert result(index, {0: ["a"]}, 5) == {0: []}


def batch_of(rng, chunks, size):
    """(changes, chunks after them)."""
    now, out = {(d, a): t for d, a, t in chunks}, []
    for seq in range(size):
        kind, keys = rng.integers(4), sorted(now)
        if kind == 0 or not keys:
            key, text = (f"d{rng.integers(30)}", int(rng.integers(5))), f"w{rng.integers(20)} w{rng.integers(20)}"
            out.append((seq, "put", *key, text))
            now[key] = text
        elif kind == 1:
            key = keys[rng.integers(len(keys))]
            out.append((seq, "put", *key, "w1 w1 w2"))
            now[key] = "w1 w1 w2"
        elif kind == 2:
            key = keys[rng.integers(len(keys))]
            out.append((seq, "delete", *key, None))
            del now[key]
        elif rng.integers(6) == 0:
            doc = keys[rng.integers(len(keys))][0]
            out.append((seq, "delete", doc, None, None))
            now = {k: v for k, v in now.items() if k[0] != doc}
    return out, [(*k, v) for k, v in now.items()]


QUERIES = {0: ["w1", "w2"], 1: ["w0", "w5", "w7"], 2: ["w19"]}


def check(index, chunks, k=40):
    assert result(index, QUERIES, k) == {q: ranked(chunks, t, k) for q, t in QUERIES.items()}


class TestUpkeep:
    def test_changes_and_merges(self, spark):
        rng = np.random.default_rng(4)
        chunks = random_chunks(rng, 60)
        index = TextIndex(spark, new_path(spark, "index"), shelves=2)
        index.build(spark.createDataFrame(chunks, CHUNK))
        for batch in range(5):
            changes, chunks = batch_of(rng, chunks, 25)
            index.apply(spark.createDataFrame(changes, CHANGES), batch)
            check(index, chunks)
            if index.merge(fan=3):
                check(index, chunks)
        assert len(index.segments()) < 6
        anew = TextIndex(spark, new_path(spark, "index"), shelves=2)
        anew.build(spark.createDataFrame(chunks, CHUNK))
        assert result(index, QUERIES, 100) == result(anew, QUERIES, 100)

    def test_a_batch_counts_once(self, spark):
        index = TextIndex(spark, new_path(spark, "index"), shelves=2)
        changes = spark.createDataFrame([(0, "put", "d", 1, "w1")], CHANGES)
        assert index.apply(changes, 0) == 0
        assert index.apply(changes, 0) is None
        check(index, [("d", 1, "w1")])

    def test_everything_deleted(self, spark):
        index = TextIndex(spark, new_path(spark, "index"), shelves=2)
        index.build(spark.createDataFrame([("d", 1, "w1"), ("e", 2, "w1 w2")], CHUNK))
        index.apply(spark.createDataFrame([(0, "delete", "d", None, None), (1, "delete", "e", 2, None), (2, "delete", "none", None, None)], CHANGES), 0)
        check(index, [])
        index.apply(spark.createDataFrame([(0, "put", "d", 1, "w2")], CHANGES), 1)
        check(index, [("d", 1, "w2")])

    @pytest.mark.parametrize("step", ["postings", "publish", "after"])
    def test_a_stream_that_dies_and_starts_again(self, spark, tmp_path, monkeypatch, step):
        rng = np.random.default_rng(6)
        source, checkpoint = str(tmp_path / "source"), str(tmp_path / "checkpoint")
        index = TextIndex(spark, new_path(spark, "index"), shelves=2)
        chunks = []
        write = lambda rows, n: spark.createDataFrame(rows, CHANGES).coalesce(1).write.parquet(f"{source}/b{n}")

        def run():
            keep_index(spark, f"{source}/*", index, checkpoint, files_per_batch=1, fan=2).awaitTermination()

        changes, chunks = batch_of(rng, chunks, 30)
        write(changes, 0)
        run()
        check(index, chunks)
        version = index.tables.version()

        def dies(*_, **__):
            raise RuntimeError("died")

        changes, after = batch_of(rng, chunks, 30)
        write(changes, 1)
        if step == "postings":
            monkeypatch.setattr(Change, "append", dies)
        elif step == "publish":
            monkeypatch.setattr(Tables, "publish", dies)
        else:
            # The version is published, but the stream dies before it notes that the batch is done.
            monkeypatch.setattr(TextIndex, "merge", dies)
        with pytest.raises(Exception, match="died"):
            run()
        monkeypatch.undo()
        if step != "after":
            assert index.tables.version() == version
            check(index, chunks)
        run()
        check(index, after)
        run()
        check(index, after)
        assert index_upkeep.FAN == 8


def test_shelves_are_those_of_the_layout(spark):
    """Python and the JVM put a term on one shelf."""
    words = ["the", "été", "日本", "a" * 40, "x1", *(f"w{k}" for k in range(200))]
    rows = postings.indexed(spark.createDataFrame([("d", 1, " ".join(words))], CHUNK), 0, 7)
    layout = postings.layouts(7)["postings"]
    own = {r.term: r.s for r in rows.select("term", layout.shelf(F.col("term")).alias("s")).collect()}
    batch = pa.RecordBatch.from_pydict({"doc_id": ["d"], "embed_id": [1], "words": [words]})
    made, bounds = postings._posted(batch, 7)
    for shelf, (a, b) in enumerate(zip(bounds, bounds[1:])):
        assert {own[t] for t in made.column(0).slice(a, b - a).to_pylist()} <= {shelf}
    assert len(own) == len(words)


@pytest.mark.parametrize("salts", [1, 3])
def test_salts_lose_nothing(spark, salts):
    chunks = spark.createDataFrame(random_chunks(np.random.default_rng(8), 400), CHUNK).repartition(5)
    hits = postings.chunk_hits(postings.indexed(chunks, 0, 4, salts), "term").collect()
    want = Counter((t, r.doc_id, r.embed_id) for r in chunks.collect() for t in re.split(r"[\W_]+", r.embed_data.lower()) if t)
    assert {(r.term, r.doc_id, r.embed_id): r.hits for r in hits} == want and len(hits) == len(want)


def test_tables_of_a_batch_come_in_the_order_they_are_stored_in(spark):
    texts = ["b a b", "", None, "  ", "é-Z z,1", "İ ß a", "--x"]
    docs = spark.createDataFrame([(f"d{k % 3}", k, t) for k, t in enumerate(texts)], "doc_id string, embed_id long, embed_data string")
    spaced = docs.orderBy("embed_id").select("doc_id", "embed_id", ranking.spaced_tokens(F.coalesce("embed_data", F.lit(""))).alias("words")).toArrow().combine_chunks().to_batches()[0]
    words = postings._split(spaced.column(2))
    want = [r.w for r in docs.orderBy("embed_id").select(ranking.tokens(F.coalesce("embed_data", F.lit(""))).alias("w")).collect()]
    assert words.to_pylist() == want
    rows, bounds = postings._posted(spaced.set_column(2, "words", words), 4)
    for a, b in zip(bounds, bounds[1:]):
        keys = [(r["term"].encode(), r["doc_id"], r["block"]) for r in rows.slice(a, b - a).to_pylist()]
        assert keys == sorted(keys)


def test_the_predicate_moves_blocks_once(spark, tmp_path, capsys):
    chunks = spark.createDataFrame([(f"d{k % 5}", k, "a b" if k % 2 else "a a") for k in range(40)], "doc_id string, embed_id long, embed_data string")
    index = TextIndex(spark, str(tmp_path / "index"), 4)
    index.build(chunks)
    found = index.holding_any(["a", "b"])
    found.explain()
    plan = capsys.readouterr().out
    assert {(r.embed_id, r.n_terms, r.hits) for r in found.collect()} == {(k, 2, 2) if k % 2 else (k, 1, 2) for k in range(40)}
    # The table of terms is all that is joined; the blocks were joined with themselves before.
    assert plan.count("Join") == 1 and plan.count("Exchange hashpartitioning") == 1
