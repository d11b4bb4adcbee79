"""Exact nearest neighbours for many queries at once, with clusters ruled out by angle.

Vectors become directions and go to the nearest of some pivots, a bounded sample of them spread by farthest-first choice. They
are stored sorted by pivot and angle to it, in pieces of at most PIECE rows, with an index of the pieces: pivot, least and
largest angle. The angle between directions obeys the triangle inequality, so a row of a piece is no nearer to a query than
the query's angle to the pivot lies outside the piece's angles. Queries are dealt by pivot and angle as well; a task holds
at most QUERIES of them, looks at pieces from the nearest bound on, and passes over those that no query of it can need: where
all bounds lie beyond the distance of the k-th neighbour so far. The rest go through matrix products.

Nothing is approximate; equal distances (rounded to six places) go by id. How much is passed over depends on the vectors:
directions without structure are nearly at right angles to all pivots and leave nothing to rule out. `share_read()` says it.

Defined cases: rows without an id or a vector, with null or non-finite components, of no length, or of other dimensions than most
of the sample have no direction and take no part, as queries neither; a query finds itself where it is among the rows; rows that
repeat an id are rows of their own; fewer than k rows give fewer.
"""

from __future__ import annotations

import math
import uuid
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.dataset as pads
import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from findloom.sources.shared import new_path

#: Pivots at most, and rows of the sample that they are chosen from: what the driver holds.
PIVOTS, SAMPLE = 512, 4096
PIECE, QUERIES, FEW = 2048, 512, 32
PLACES = 6
#: Half a unit of the last place, and what sums of products may be off by.
SLACK = 10.0**-PLACES
INDEX = pa.schema([("file", pa.string()), ("offset", pa.int64()), ("length", pa.int64()), ("rows", pa.int64()), ("pivot", pa.int64()), ("low", pa.float64()), ("high", pa.float64())])


def _directions(lists: pa.ListArray) -> np.ndarray:
    """Lists of equal length as unit rows."""
    values = lists.flatten().to_numpy().astype(np.float64).reshape(len(lists), -1)
    return values / np.sqrt((values * values).sum(axis=1, keepdims=True))


def usable(rows: DataFrame, dimensions: int | None = None) -> DataFrame:
    """rows(id, vector) that have a direction."""
    finite = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("vector", lambda x: x != 0)
    kept = rows.where(F.col("id").isNotNull() & F.col("vector").isNotNull()).where(finite)
    kept = kept.select(F.col("id").cast("long").alias("id"), F.col("vector").cast("array<double>").alias("vector"))
    return kept if dimensions is None else kept.where(F.size("vector") == dimensions)


def chosen_pivots(rows: DataFrame, pivots: int = PIVOTS, sample: int = SAMPLE) -> np.ndarray:
    """Directions far from one another, of a sample by hash: at most `sample` rows come to the driver."""
    n = rows.count()
    few = rows.orderBy(F.xxhash64("id"), "id").limit(sample).select("vector").toArrow().column("vector").combine_chunks()
    if not len(few):
        return np.zeros((0, 0))
    dimensions = Counter(few.value_lengths().to_pylist()).most_common(1)[0][0]
    own = _directions(few.filter(pc.equal(few.value_lengths(), dimensions)))
    wanted = max(1, min(pivots, len(own), math.isqrt(n)))
    chosen, nearest = [0], own @ own[0]
    while len(chosen) < wanted:
        chosen.append(int(nearest.argmin()))
        nearest = np.maximum(nearest, own @ own[chosen[-1]])
    return own[chosen]


def _placed(rows: DataFrame, pivots: np.ndarray) -> DataFrame:
    """rows(id, vector) -> id, vector (direction), pivot, angle to it."""

    def run(batches):
        for batch in batches:
            units = _directions(batch.column(1))
            near = units @ pivots.T
            best = near.argmax(axis=1) if len(near) else np.zeros(0, np.int64)
            angle = np.arccos(np.clip(near[np.arange(len(near)), best], -1, 1))
            vectors = pa.ListArray.from_arrays(pa.array(np.arange(len(units) + 1, dtype=np.int32) * pivots.shape[1]), pa.array(units.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column(0), vectors, pa.array(best, pa.int64()), pa.array(angle, pa.float64())], ["id", "vector", "pivot", "angle"])

    return usable(rows, pivots.shape[1]).mapInArrow(run, "id long, vector array<double>, pivot long, angle double")


class Clusters:
    """Stored rows, sorted by pivot and angle; pivots are few and travel with the tasks."""

    def __init__(self, rows: DataFrame, pivots: int = PIVOTS, sample: int = SAMPLE):
        """rows(id, vector) are stored in the shared folder."""
        spark = rows.sparkSession
        self.folder = new_path(spark, "clusters")
        self.pivots = chosen_pivots(usable(rows), pivots, sample)
        if len(self.pivots):
            self._write(_placed(rows, self.pivots))

    def _write(self, placed: DataFrame) -> None:
        folder = self.folder

        def run(batches):
            store, root = pafs.FileSystem.from_uri(folder)
            store.create_dir(root, recursive=True)
            name, out, at, made = f"{uuid.uuid4().hex}.arrow", None, 0, []
            for batch in batches:
                pivot = batch.column(2).to_numpy()
                cuts = np.union1d(np.flatnonzero(np.diff(pivot)) + 1, np.arange(0, len(pivot), PIECE)).tolist()
                for a, b in zip(cuts, [*cuts[1:], len(pivot)]):
                    part, sink = batch.slice(a, b - a), pa.BufferOutputStream()
                    with pa.ipc.new_stream(sink, part.schema) as w:
                        w.write_batch(part)
                    body = sink.getvalue()
                    out = out or store.open_output_stream(f"{root}/{name}", compression=None)
                    out.write(body)
                    angle = part.column(3)
                    made.append((name, at, body.size, b - a, int(pivot[a]), angle[0].as_py(), angle[-1].as_py()))
                    at += body.size
            if out:
                out.close()
            columns = list(zip(*made)) or [[] for _ in INDEX]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, INDEX)], schema=INDEX)

        by = ["pivot", "angle", "id"]
        index = placed.repartitionByRange(*by).sortWithinPartitions(*by).mapInArrow(run, "file string, offset long, length long, rows long, pivot long, low double, high double")
        index.write.parquet(f"{folder}-index")

    def pieces(self, queries: DataFrame, k: int) -> DataFrame:
        """queries(id, vector) -> query_id, id, distance of the k nearest, and a last row for each batch of queries that counts rows read (query_id null)."""
        folder, pivots = self.folder, self.pivots
        spark = queries.sparkSession
        ddl = "query_id long, place long, id long, distance double"
        if not len(pivots):
            return spark.createDataFrame([], ddl)
        placed = _placed(queries, pivots)
        n = queries.count()
        parts = max(1, math.ceil(n / QUERIES), min(math.ceil(n / FEW), 4 * spark.sparkContext.defaultParallelism))

        def run(batches):
            reader = None
            for batch in batches:
                for start in range(0, batch.num_rows, QUERIES):
                    reader = reader or _Pieces(folder)
                    part = batch.slice(start, QUERIES)
                    units = part.column(1).flatten().to_numpy().reshape(part.num_rows, -1)
                    yield from _nearest(part.column(0).to_numpy(), units, pivots, reader, k)

        by = ["pivot", "angle", "id"]
        return placed.repartitionByRange(parts, *by).sortWithinPartitions(*by).mapInArrow(run, ddl)

    def nearest(self, queries: DataFrame, k: int) -> DataFrame:
        """queries(id, vector) -> query_id, rank, id, distance: the k nearest rows of each query by cosine distance."""
        return self.pieces(queries, k).where("query_id is not null").select("query_id", F.col("place").cast("int").alias("rank"), "id", "distance")

    def share_read(self, queries: DataFrame, k: int) -> float:
        """Of all (query, row) pairs, the share whose distance is made."""
        made, every = self.pieces(queries, k).where("query_id is null").agg(F.sum("place"), F.sum("id")).first()
        return made / every if every else 0.0


class _Pieces:
    def __init__(self, folder: str):
        self.store, self.root = pafs.FileSystem.from_uri(folder)
        own, path = pafs.FileSystem.from_uri(f"{folder}-index")
        files = [f.path for f in own.get_file_info(pafs.FileSelector(path)) if f.base_name.endswith(".parquet")]
        index = pads.dataset(files, schema=INDEX, format="parquet", filesystem=own).to_table() if files else INDEX.empty_table()
        self.file, self.offset, self.length = (index.column(c).to_pylist() for c in ("file", "offset", "length"))
        self.rows, self.pivot, self.low, self.high = (index.column(c).to_numpy() for c in ("rows", "pivot", "low", "high"))

    def read(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        with self.store.open_input_file(f"{self.root}/{self.file[k]}") as f:
            batch = pa.ipc.open_stream(f.read_at(self.length[k], self.offset[k])).read_next_batch()
        return batch.column(0).to_numpy(), batch.column(1).flatten().to_numpy().reshape(batch.num_rows, -1)


def _nearest(ids: np.ndarray, units: np.ndarray, pivots: np.ndarray, pieces: _Pieces, k: int) -> Iterator[pa.RecordBatch]:
    """The k nearest of some queries; what is passed over cannot come within the k-th distance."""
    to_pivot = np.arccos(np.clip(units @ pivots.T, -1, 1))[:, pieces.pivot]
    # The least angle that a row of the piece can have to the query, as a distance.
    apart = np.maximum(np.maximum(to_pivot - pieces.high, pieces.low - to_pivot), 0)
    bound = 1 - np.cos(np.minimum(apart, np.pi)) - SLACK
    distance, found = np.full((len(ids), k), np.inf), np.full((len(ids), k), np.iinfo(np.int64).max)
    made = 0
    for at in np.argsort(bound.min(axis=0), kind="stable").tolist():
        last = distance[:, -1]
        if bound[:, at].min() > last.max():
            break
        open_ = np.flatnonzero(bound[:, at] <= last)
        if not len(open_):
            continue
        others, theirs = pieces.read(at)
        made += len(open_) * len(others)
        near = units[open_] @ theirs.T
        fits = near >= (1 - last[open_] - SLACK)[:, None]
        for row in np.flatnonzero(fits.any(axis=1)).tolist():
            own = np.flatnonzero(fits[row])
            if len(own) > 4 * k:
                own = own[near[row, own] >= np.partition(near[row, own], -k)[-k] - SLACK]
            q = open_[row]
            d = np.append(distance[q], np.round(1 - near[row, own], PLACES) + 0.0)
            who = np.append(found[q], others[own])
            best = np.lexsort((who, d))[:k]
            distance[q], found[q] = d[best], who[best]
    row, place = np.nonzero(np.isfinite(distance))
    names = ["query_id", "place", "id", "distance"]
    yield pa.RecordBatch.from_arrays([pa.array(ids[row]), pa.array(place + 1), pa.array(found[row, place]), pa.array(distance[row, place])], names)
    every = int(pieces.rows.sum()) * len(ids)
    yield pa.RecordBatch.from_arrays([pa.array([None], pa.int64()), pa.array([made], pa.int64()), pa.array([every], pa.int64()), pa.array([None], pa.float64())], names)
