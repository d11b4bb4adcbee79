"""Tables in versions: changes, what they write, conflicts, and writers that die between any two steps."""

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from findloom.operators import ingestion
from findloom.sources import snapshots, store, views
from findloom.sources.shared import Files, new_path
from findloom.sources.snapshots import Change, Conflict, Layout, Tables

field = lambda name, kind=T.StringType(): T.StructField(name, kind)
CHUNKS = T.StructType([field("doc_id"), field("embed_id", T.LongType()), field("embed_data")])
DOCS = T.StructType([field("id"), field("name")])
LAYOUTS = {"chunks": Layout(CHUNKS, ("doc_id", "embed_id"), 4), "docs": Layout(DOCS)}


def chunk_rows(spark, n=100, text="text"):
    return spark.range(n).select(F.concat(F.lit("d"), (F.col("id") % 10).cast("string")).alias("doc_id"), F.col("id").alias("embed_id"), F.concat(F.lit(f"{text} "), F.col("id").cast("string")).alias("embed_data"))


@pytest.fixture
def tables(spark):
    t = Tables(spark, new_path(spark, "snapshots"), LAYOUTS)
    docs = spark.range(10).select(F.concat(F.lit("d"), F.col("id").cast("string")).alias("id"), F.lit("n").alias("name"))
    t.change().append("chunks", chunk_rows(spark)).append("docs", docs).commit()
    return t


def rows(df):
    return sorted(tuple(r) for r in df.select("doc_id", "embed_id", "embed_data").collect())


def keys(spark, *ids):
    return spark.createDataFrame([(i,) for i in ids], "doc_id string")


class TestChanges:
    def test_empty_tables(self, spark):
        t = Tables(spark, new_path(spark, "snapshots"), LAYOUTS)
        assert (t.version(), t.read("chunks").count(), t.read("docs").count()) == (-1, 0, 0)
        t.change().delete("chunks", keys(spark, "d1"), ["doc_id"]).append("docs", spark.createDataFrame([], DOCS)).commit()
        assert (t.version(), t.read("docs").count()) == (0, 0)

    def test_delete_append_replace_update(self, spark, tables):
        want = {(r[0], r[1]): r[2] for r in rows(tables.read("chunks"))}
        assert len(want) == 100
        tables.change().delete("chunks", keys(spark, "d3", "d3", "nobody", None), ["doc_id"]).commit()
        want = {k: v for k, v in want.items() if k[0] != "d3"}
        new = spark.createDataFrame([("d4", 1000, "one"), ("d4", 1001, None), ("d11", 5, "two")], CHUNKS)
        tables.change().replace("chunks", new, ["doc_id"]).commit()
        want = {k: v for k, v in want.items() if k[0] != "d4"} | {("d4", 1000): "one", ("d4", 1001): None, ("d11", 5): "two"}
        tables.change().update("chunks", spark.createDataFrame([("d5", 5, "new"), ("d5", 9999, "none")], CHUNKS), ["doc_id", "embed_id"], ["embed_data"]).commit()
        want[("d5", 5)] = "new"
        assert rows(tables.read("chunks")) == sorted([(*k, v) for k, v in want.items()], key=lambda r: (r[0], r[1]))
        assert tables.version() == 3

    def test_old_versions_stay_readable(self, spark, tables):
        tables.change().delete("chunks", keys(spark, "d1"), ["doc_id"]).commit()
        assert (tables.read("chunks", 0).count(), tables.read("chunks").count()) == (100, 90)

    def test_a_document_leaves_all_tables_in_one_version(self, spark, tables):
        gone = keys(spark, "d1", "d2")
        tables.change().delete("chunks", gone, ["doc_id"]).delete("docs", gone, {"id": "doc_id"}).commit()
        assert (tables.version(), tables.read("chunks").count(), tables.read("docs").count()) == (1, 80, 8)

    def test_a_small_change_writes_little(self, spark):
        t = Tables(spark, new_path(spark, "snapshots"), LAYOUTS)
        t.change().append("chunks", chunk_rows(spark, 50_000, "some longer text that fills the files " * 4)).commit()
        whole = sum(Files(spark, t.folder).sizes().values())
        new = t.read("chunks").where("embed_id % 100 = 7").withColumn("embed_data", F.concat(F.lit("new "), "embed_data"))
        t.change().update("chunks", new, ["doc_id", "embed_id"], ["embed_data"]).commit()
        assert sum(Files(spark, t.folder).sizes().values()) - whole < 0.04 * whole
        assert t.read("chunks").where("embed_data like 'new %'").count() == 500
        assert t.read("chunks").count() == 50_000

    def test_marks_by_shuffle(self, spark, tables, monkeypatch):
        monkeypatch.setattr(snapshots, "BROADCAST_ROWS", 0)
        tables.change().delete("chunks", keys(spark, "d3"), ["doc_id"]).commit()
        tables.change().delete("chunks", keys(spark, "d3", "d4"), ["doc_id"]).commit()
        assert tables.read("chunks").count() == 80

    def test_lookup_reads_the_keys_shelves(self, spark, tables):
        hits = spark.createDataFrame([("d3", 13, 0.5), ("d3", 999, 0.1)], "doc_id string, embed_id long, distance double").where("distance < 0.9")
        found = tables.lookup("chunks", hits)
        assert [(r.embed_data, r.distance) for r in found.collect()] == [("text 13", 0.5)]
        plan = found._jdf.queryExecution().toString()
        assert "dynamicpruning" in plan.lower()

    def test_clone_compact_vacuum(self, spark, tables):
        other = tables.clone(new_path(spark, "clone"))
        other.change().delete("chunks", tables.read("chunks").where("embed_id % 2 = 0"), ["doc_id", "embed_id"]).commit()
        assert (tables.read("chunks").count(), other.read("chunks").count()) == (100, 50)
        before = rows(other.read("chunks"))
        other.compact("chunks")
        assert rows(other.read("chunks")) == before
        assert all(f["dead"] == 0 for f in other.state()["tables"]["chunks"])
        other.vacuum()
        assert rows(other.read("chunks")) == before
        assert len(other.versions()) == 1
        assert tables.read("chunks").count() == 100


class TestWriters:
    def test_appends_meet_deletes_conflict(self, spark, tables):
        a, b, c = (tables.change() for _ in range(3))
        a.append("chunks", chunk_rows(spark, 3, "a"))
        b.append("chunks", chunk_rows(spark, 4, "b"))
        c.delete("chunks", keys(spark, "d1"), ["doc_id"])
        assert (a.commit(), b.commit()) == (1, 2)
        assert tables.read("chunks").count() == 107
        with pytest.raises(Conflict):
            c.commit()
        assert (tables.version(), tables.read("chunks").count()) == (2, 107)

    def test_a_delete_of_one_table_does_not_mind_another(self, spark, tables):
        a, b = tables.change(), tables.change()
        a.append("docs", spark.createDataFrame([("x", "y")], DOCS)).commit()
        assert b.delete("chunks", keys(spark, "d1"), ["doc_id"]).commit() == 2
        assert (tables.read("docs").count(), tables.read("chunks").count()) == (11, 90)

    def test_meta_is_decided_once(self, spark, tables):
        a, b = tables.change().note(batch=1), tables.change().note(batch=1)
        a.commit()
        with pytest.raises(Conflict):
            b.append("docs", spark.createDataFrame([("x", "y")], DOCS)).commit()

    def test_one_name_is_created_once(self, spark):
        files = Files(spark, new_path(spark, "log"))
        assert files.create("1.json", "a")
        assert not files.create("1.json", "b")
        assert (files.read("1.json"), files.names()) == ("a", ["1.json"])

    @pytest.mark.parametrize("step", range(5))
    def test_a_writer_that_dies_leaves_the_old_version(self, spark, tables, monkeypatch, step):
        want = rows(tables.read("chunks"))

        class Died(Exception):
            pass

        def dies(*_):
            raise Died

        def write():
            change = tables.change()
            if step == 0:
                monkeypatch.setattr(Change, "_mark", dies)
            change.delete("chunks", keys(spark, "d1"), ["doc_id"])
            if step == 1:
                raise Died
            if step == 2:
                monkeypatch.setattr(Files, "sizes", dies)
            change.append("chunks", chunk_rows(spark, 5, "new"))
            if step == 3:
                raise Died
            monkeypatch.setattr(Tables, "publish", dies)
            change.commit()

        with pytest.raises(Died):
            write()
        monkeypatch.undo()
        assert (tables.version(), rows(tables.read("chunks"))) == (0, want)
        tables.vacuum()
        assert rows(tables.read("chunks")) == want
        tables.change().delete("chunks", keys(spark, "d1"), ["doc_id"]).append("chunks", chunk_rows(spark, 5, "new")).commit()
        assert tables.read("chunks").count() == 95


class Picky:
    """A model that fails on some texts."""

    def embed(self, texts):
        if any("poison" in t for t in texts):
            raise ValueError("no")
        return [[float(len(t)), 1.0] for t in texts]


class Plain:
    def embed(self, texts):
        return [[float(len(t)), 1.0] for t in texts]


class TestChunkTable:
    @pytest.mark.parametrize("few", [True, False])
    def test_many_splits_are_not_sorted_over_the_cluster(self, spark, tmp_path, monkeypatch, few):
        """However many splits and vectors there are, chunks with their vectors are written where they are made; files follow the bytes."""
        spark.range(40).selectExpr("id doc_id", "repeat(concat('word ', id, ' '), 200) text").repartition(12).write.parquet(f"{tmp_path}/documents.parquet")
        spark.range(30).selectExpr("id vec_id", "array(cast(id as float), 1f) embedding").write.parquet(f"{tmp_path}/embeddings.parquet")
        spark.range(3).selectExpr("id page_id").write.parquet(f"{tmp_path}/pages.parquet")
        want = sorted(map(tuple, views.embedding(spark, str(tmp_path)).collect()))
        monkeypatch.setattr(store, "FEW_FILES", 3 * store.CHUNK_SHELVES)
        if not few:
            monkeypatch.setattr(views, "BROADCAST_BYTES", 0)

        def never(*_):
            raise AssertionError("sorted over the cluster")

        monkeypatch.setattr(type(spark.range(1)), "repartitionByRange", never)
        conf = {"spark.sql.files.openCostInBytes": "1m", "spark.sql.files.maxPartitionBytes": "1m"}
        old = {k: spark.conf.get(k) for k in conf}
        try:
            for k, v in conf.items():
                spark.conf.set(k, v)
            tables = store.chunks_of_views(spark, str(tmp_path))
            loads = {f["path"].rsplit("/", 1)[1].split("-")[1] for f in tables.state()["tables"]["embedding"]}
        finally:
            for k, v in old.items():
                spark.conf.set(k, v)
        got = sorted(map(tuple, tables.read("embedding").select("doc_id", "embed_id", "embed_data", "embed_vector").collect()))
        assert got == want and 1 < len(loads) <= 3

    def test_tasks_follow_the_bytes(self, spark, tmp_path, monkeypatch):
        spark.range(40).selectExpr("id doc_id", "'a' text").repartition(4).write.parquet(f"{tmp_path}/documents.parquet")
        size = sum(Files(spark, f"{tmp_path}/documents.parquet").sizes().values())
        monkeypatch.setattr(store, "TASK_BYTES", size // 100)
        assert store._tasks(spark, str(tmp_path)) >= 100
        monkeypatch.setattr(store, "TASK_BYTES", size)
        monkeypatch.setattr(store, "FEW_FILES", 0)
        assert store._tasks(spark, str(tmp_path)) == 1


class TestBatches:
    def test_numbers_follow_the_order(self, spark):
        rows = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("k")).repartition(7)
        got = ingestion.numbered(rows, "k").collect()
        assert sorted((r.k, r.number) for r in got) == [(k, k) for k in range(1000)]
        assert ingestion.numbered(rows.limit(0), "k").count() == 0

    def test_each_batch_commits_on_its_own(self, spark):
        t = store.chunk_tables(spark, new_path(spark, "chunks"))
        text = F.when(F.col("id") == 4000, "poison").otherwise(F.concat(F.lit("t"), F.col("id").cast("string")))
        rows = spark.range(5000).select(F.lpad(F.col("id").cast("string"), 6, "0").alias("doc_id"), F.col("id").alias("embed_id"), text.alias("embed_data"))
        rows = rows.withColumn("embed_vector", F.when(F.col("embed_id") % 10 == 0, F.array(F.lit(0.0), F.lit(2.0))).cast("array<float>"))
        rows = rows.withColumn("embed_data", F.when(F.col("embed_id") == 7, None).when(F.col("embed_id") == 4001, "poison").otherwise(F.col("embed_data")))
        store.filled_chunks(t, rows)
        with pytest.raises(Exception, match="no"):
            ingestion.embed_pending(t, Picky, 1920)
        # 4,499 are pending; the second batch of 1,920 holds the text that fails.
        assert t.read("embedding").where("embed_vector is null").count() == 4500 - 1920
        assert len(ingestion.embed_pending(t, Plain, 1920)) == 2
        done = t.read("embedding")
        assert (done.count(), done.where("embed_vector is null").count()) == (5000, 1)
        assert done.where("embed_id % 10 = 0 and embed_vector[1] <> 2").count() == 0
        assert done.where("embed_id = 123").first().embed_vector == [4.0, 1.0]
        assert ingestion.embed_pending(t, Plain, 1920) == []
