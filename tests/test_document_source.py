"""The document data source: what comes back, what is left unread, what an aborted write and a stopped stream leave."""

import json
import time
import tracemalloc
from pathlib import Path

import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from findloom.sources import document_source as D

KIND = "id string, data string, cmetadata string"


def documents(spark, n=200, first=0):
    meta = F.to_json(F.struct(F.element_at(F.array(*map(F.lit, ["fr", "en", "de"])), (F.col("id") % 3 + 1).cast("int")).alias("lang"), F.col("id").alias("number")))
    return spark.range(first, first + n).select(F.concat(F.lit("d"), F.col("id").cast("string")).alias("id"), F.concat(F.lit("text\n\"é\" "), F.col("id").cast("string")).alias("data"), meta.alias("cmetadata"))


def by_lang(rows):
    """A file for each language."""
    return rows.repartition(12, F.get_json_object("cmetadata", "$.lang")).sortWithinPartitions("id")


class TestDocuments:
    def test_rows_come_back(self, spark, tmp_path):
        odd = [("a", None, None), (None, "x\r\n y", "no json"), ("c", "", "[1]"), ("d", "z" * 3_000_000, '{"lang": 7, "source": null}')]
        D.write(spark.createDataFrame(odd, KIND), str(tmp_path / "d"), "lang")
        D.write(documents(spark), str(tmp_path / "d"))
        got = D.read(spark, f"file://{tmp_path}/d", "lang,source").collect()
        want = [(*r, {"d": "7"}.get(r[0]), None) for r in odd] + [(r.id, r.data, r.cmetadata, json.loads(r.cmetadata)["lang"], None) for r in documents(spark).collect()]
        assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))

    @pytest.mark.parametrize("split", [1, 7, 40, 1000])
    def test_byte_ranges_lose_and_repeat_nothing(self, spark, tmp_path, split):
        D.write(documents(spark, 60).coalesce(2), str(tmp_path / "d"))
        D.register(spark)
        reader = D._Reader(str(tmp_path / "d"), [], split)
        ids = [i for p in reader.partitions() for b in reader.read(p) for i in b.column(0).to_pylist()]
        assert sorted(ids) == sorted(f"d{k}" for k in range(60))

    def test_empty(self, spark, tmp_path):
        assert D.read(spark, str(tmp_path / "none"), "lang").where("lang = 'fr'").count() == 0
        D.write(documents(spark, 0), str(tmp_path / "d"))
        assert D.read(spark, str(tmp_path / "d")).count() == 0

    def test_a_filter_leaves_files_unread(self, spark, tmp_path):
        folder = tmp_path / "d"
        D.write(by_lang(documents(spark)), str(folder), "lang")
        files = {f["file"]: f["values"]["lang"] for f in D._Folder(str(folder)).files()}
        assert sorted(files.values()) == [["de"], ["en"], ["fr"]]
        reader = D._Reader(str(folder), ["lang"], D.SPLIT)
        kept = list(reader.pushFilters([D.EqualTo(("lang",), "fr"), D.EqualTo(("id",), "d0")]))
        assert (len(kept), reader.wanted) == (2, {"lang": {"fr"}})
        # The other files are not even opened: they may be broken.
        for name, values in files.items():
            if values != ["fr"]:
                Path(folder / name).write_text("broken")
        rows = D.read(spark, str(folder), "lang").where("lang = 'fr'")
        assert {r.id for r in rows.collect()} == {f"d{k}" for k in range(0, 200, 3)}
        assert D.read(spark, str(folder), "lang").where("lang in ('fr', 'xx')").count() == 67

    def test_an_aborted_write_leaves_nothing(self, spark, tmp_path):
        folder = tmp_path / "d"
        D.write(documents(spark, 10), str(folder))
        before = sorted(p.relative_to(folder) for p in folder.rglob("*") if p.is_file())
        bad = documents(spark, 50, 100).repartition(4).withColumn("data", F.when(F.col("id") == "d120", F.raise_error(F.lit("stop"))).otherwise(F.col("data")))
        with pytest.raises(Exception, match="stop"):
            D.write(bad, str(folder))
        time.sleep(1)  # for tasks that were still at it
        assert sorted(p.relative_to(folder) for p in folder.rglob("*") if p.is_file()) == before
        assert D.read(spark, str(folder)).count() == 10

    def test_other_columns_and_overwriting_are_refused(self, spark, tmp_path):
        D.register(spark)
        with pytest.raises(Exception, match="columns"):
            spark.range(3).write.format(D.FORMAT).mode("append").save(str(tmp_path / "d"))
        with pytest.raises(Exception, match="overwriting"):
            documents(spark).write.format(D.FORMAT).mode("overwrite").save(str(tmp_path / "d"))

    def test_a_stream_goes_on_where_it_stopped(self, spark, tmp_path):
        folder, out, at = (str(tmp_path / n) for n in ("d", "out", "at"))
        D.write(documents(spark, 20), folder)

        def run():
            rows = spark.readStream.format(D.FORMAT).option("keys", "lang").load(folder)
            rows.writeStream.format("parquet").option("checkpointLocation", at).trigger(availableNow=True).start(out).awaitTermination()
            return sorted(r.id for r in spark.read.parquet(out).collect())

        assert run() == sorted(f"d{k}" for k in range(20))
        D.write(documents(spark, 5, 20), folder)
        D.write(documents(spark, 5, 25), folder)
        assert run() == sorted(f"d{k}" for k in range(30))
        assert run() == sorted(f"d{k}" for k in range(30))


def test_python_holds_little_of_long_documents(spark, tmp_path):
    # Batches by rows alone would be 1,000 documents read and 10,000 written, as Python objects, however long they are.
    rows = spark.range(400).selectExpr("cast(id as string) id", "repeat('x', 50000) data", "'{}' cmetadata").coalesce(1)
    D.write(rows, str(tmp_path / "long"))
    assert spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch") == D.ARROW_BYTES
    source = D.DocumentSource({"path": str(tmp_path / "long")})
    reader = source.reader(source.schema())
    batches = [b for part in reader.partitions() for b in reader.read(part)]
    assert sum(b.num_rows for b in batches) == 400 and max(b.nbytes for b in batches) < 2 * D.BATCH_BYTES
    held = []

    def come():
        for _ in range(5):
            held.append(tracemalloc.get_traced_memory()[0])
            yield pa.RecordBatch.from_arrays([pa.array([str(k) for k in range(400)]), pa.array(["x" * 50_000] * 400), pa.array(["{}"] * 400)], ["id", "data", "cmetadata"])

    tracemalloc.start()
    try:
        done = D.DocumentSource({"path": str(tmp_path / "more")}).writer(T.StructType([T.StructField(n, T.StringType()) for n in D.FIXED]), False).write(come())
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert len(done.files) == 1 and peak - max(held) < 10_000_000
