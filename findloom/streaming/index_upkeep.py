"""A text index kept fresh: changes of chunks become segments, segments are merged in tiers.

A change names a chunk and its new text, or none: (doc_id, embed_id, embed_data, op) with op `put` or `delete`; deleting with a
null embed_id names all chunks of the document. Each batch of changes becomes one segment and, in the same version of the
index's log, the rows of `gone` that end older postings of its chunks, and the number of the batch. A batch that comes
again after a crash finds its number in the log and does nothing; one that died halfway has left no version.

Segments of one tier (their number of chunks as a power of FAN) are merged when there are FAN of them: their postings,
without those that have gone, become one segment with the number of the newest, and rows of `gone` that no segment is older
than are dropped. So a posting is written again once a tier, and a search reads at most FAN segments a tier.

Changes within a batch count in the order of `seq`; of one chunk the last one counts. A whole-document delete ends the
document's chunks of earlier batches and those put before it in its own batch.
"""

from __future__ import annotations

import math
from collections import defaultdict

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from findloom.operators import postings
from findloom.sources.shared import written
from findloom.sources.snapshots import Tables

FAN = 8
CHANGES = T.StructType([T.StructField(n, k) for n, k in (("seq", T.LongType()), ("op", T.StringType()), ("doc_id", T.StringType()), ("embed_id", T.LongType()), ("embed_data", T.StringType()))])


class TextIndex:
    """The index in a folder, in versions."""

    def __init__(self, spark: SparkSession, folder: str, shelves: int = 32):
        self.tables = Tables(spark, folder, postings.layouts(shelves))
        self.layout = self.tables.layouts["postings"]

    def clone(self, folder: str) -> TextIndex:
        """The same index under another folder, to change."""
        self.tables.clone(folder)
        return TextIndex(self.tables.spark, folder, self.layout.shelves)

    def _laid(self, chunks: DataFrame, segment: int, n: int) -> DataFrame:
        return postings.indexed(chunks, segment, self.layout.shelves, max(1, math.ceil(n / postings.SALT_CHUNKS)))

    def segments(self) -> dict[str, int]:
        """Number of a segment (as text, as JSON has it) -> its chunks."""
        return self.tables.meta().get("segments", {})

    def rows(self) -> DataFrame:
        return self.tables.read("postings")

    def gone(self) -> DataFrame | None:
        return self.tables.read("gone") if self.tables.state()["tables"]["gone"] else None

    def top(self, queries: dict[int, list[str]], k: int, within: DataFrame | None = None) -> DataFrame:
        return postings.top_chunks(self.rows(), self.gone(), queries, k, self.layout, within=within)

    def holding_any(self, terms: list[str]) -> DataFrame:
        return postings.holding_any(self.rows(), self.gone(), terms, self.layout)

    def build(self, chunks: DataFrame, n: int | None = None) -> int:
        """The first segment, of all chunks there are; n of them, if the caller knows, for a count would cut all texts."""
        n = chunks.count() if n is None else n
        return self.tables.change().append("postings", self._laid(chunks, 0, n), laid=True).note(segments={"0": n}, batch=-1).commit()

    def _whole_documents(self, changes: DataFrame) -> DataFrame:
        """(doc_id, embed_id) of the indexed chunks of documents that are deleted whole."""
        docs = changes.where("op = 'delete' and embed_id is null").select("doc_id").distinct()
        return postings.chunk_hits(self.rows().join(docs, "doc_id", "left_semi")).select(*postings.KEYS).distinct()

    def apply(self, changes: DataFrame, batch: int) -> int | None:
        """One batch of changes as a segment; None if it has been applied."""
        change = self.tables.change()
        meta = change.state["meta"]
        if batch <= meta.get("batch", -1):
            return None
        changes = written(changes, "index-changes")
        segment = meta.get("next", max([-1, *map(int, meta.get("segments", {}))]) + 1)
        last = Window.partitionBy("doc_id", "embed_id").orderBy(F.desc("seq"))
        whole = changes.where("op = 'delete' and embed_id is null").groupBy(F.col("doc_id").alias("of")).agg(F.max("seq").alias("until"))
        single = changes.where("embed_id is not null").withColumn("rn", F.row_number().over(last)).where("rn = 1")
        alive = single.where("op = 'put'").join(whole, F.col("doc_id") == F.col("of"), "left").where("until is null or seq > until")
        n = alive.count()
        ended = single.select(*postings.KEYS).unionByName(self._whole_documents(changes)).distinct()
        change.append("gone", ended.select(*postings.KEYS, F.lit(segment).cast("long").alias("since")))
        segments = dict(meta.get("segments", {}))
        if n:
            change.append("postings", self._laid(alive, segment, n), laid=True)
            segments[str(segment)] = n
        return change.note(batch=batch, segments=segments, next=segment + 1).commit()

    def merge(self, fan: int = FAN) -> int:
        """Merge tiers that are full, smallest first, until none is; gives the number of merges."""
        done = 0
        while True:
            tiers = defaultdict(list)
            for number, n in self.segments().items():
                tiers[int(math.log(max(n, 1), fan))].append(int(number))
            full = [sorted(own) for _, own in sorted(tiers.items()) if len(own) >= fan]
            if not full:
                return done
            self._merged(full[0])
            done += 1

    def _merged(self, own: list[int]) -> None:
        change = self.tables.change()
        meta, newest = change.state["meta"], max(own)
        rows = self.rows().where(F.col("segment").isin(own))
        held = postings.chunk_hits(rows, "term", "segment")
        gone = self.gone()
        if gone is not None:
            later = gone.groupBy(*postings.KEYS).agg(F.max("since").alias("since"))
            # A chunk that has gone between two of the segments goes now; one that goes later keeps its row in `gone`.
            held = held.join(later, postings.KEYS, "left").where("since is null or segment >= since").drop("since")
        held = written(held, "index-merge")
        n = held.select(*postings.KEYS).distinct().count()
        change.delete("postings", rows.select("segment").distinct(), ["segment"])
        change.append("postings", postings.relisted(held, newest))
        segments = {k: v for k, v in meta["segments"].items() if int(k) not in own}
        if n:
            segments[str(newest)] = n
        if gone is not None:
            # Rows that no segment is older than end nothing any more.
            oldest = min(map(int, segments), default=newest + 1)
            change.delete("gone", gone.select("since").distinct().where(F.col("since") <= oldest), ["since"])
        change.note(segments=segments).commit()


def keep_index(spark: SparkSession, source: str, index: TextIndex, checkpoint: str, files_per_batch: int = 20, fan: int = FAN) -> StreamingQuery:
    """Files of changes that came to `source` since the last call -> segments of the index, merged where tiers are full."""
    changes = spark.readStream.schema(CHANGES).option("maxFilesPerTrigger", files_per_batch).parquet(source)

    def take(rows: DataFrame, batch: int) -> None:
        index.apply(rows, batch)
        index.merge(fan)

    return changes.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
