"""Mining hard negatives by norm-bucketed exact search.

Vectors become integers (floor(SCALE * x)), so that scores, inner products with an anchor, are exact. All rows are sorted
by label and norm and written to the shared folder in buckets of at most BUCKET rows, with an index of the buckets: file,
place, label and largest norm. Anchors are dealt by label and norm; a task holds at most ANCHORS of them at a time and
reads buckets from the largest norm down:

* positives come from the buckets of the anchor's own label; a bucket is passed over by every anchor whose length bound
  (Cauchy-Schwarz: its norm times the bucket's largest norm) is below the score of its K-th positive so far, and the search
  ends when all anchors pass over it, since bounds only fall from there;
* negatives come from the other labels' buckets; each positive has a window of scores, and its limit is the window's lower
  end or the K-th negative so far, whichever is higher.

Nothing is approximate: equal scores go by id, and a bucket is passed over only if no row in it can enter. The anchors are a
stated share of the rows, so the products grow with the square of the table less what the bounds pass over; vectors of
nearly one length leave little to pass over. Candidates never move by shuffle once they are bucketed: tasks read them,
each bucket once for ANCHORS anchors. A label, norm or vector that a third of all rows share fills more buckets, each
of which is as small. A task that is lost writes again under another name, and only finished tasks' buckets are in the index.

Defined cases: rows without an id, a label or a vector, or with a component that is null or not finite, take no part; a
vector shorter than another counts as continued with zeros, an empty one as zeros only; rows that share an anchor's id are
neither its positives nor its negatives, and an anchor id that repeats is searched for each of its rows; otherwise rows
that repeat are rows of their own; anchors without positives, and positives of negative score, have no negatives; scores
beyond 64 bits raise; an empty table gives no rows; other columns are not looked at.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.dataset as pads
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from findloom.llm.common import bound_batches, new_path

SCALE, K = 256, 5
#: A window of scores: from LOW to HIGH hundredths of the positive's.
LOW, HIGH = 80, 100
BUCKET, ANCHORS = 2048, 1024
#: Anchors a task at least, where there are few.
FEW = 64
INDEX = pa.schema([("file", pa.string()), ("offset", pa.int64()), ("length", pa.int64()), ("label", pa.int64()), ("norm", pa.float64())])
FOUND = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
_EXACT = float(1 << 53)


def integer_rows(rows: DataFrame, relabel: Column | None = None) -> DataFrame:
    """rows(vec_id, label, embedding) that take part -> id, label, v (integers), norm. relabel: the label that counts."""
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    whole = rows.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("embedding").isNotNull()).where(finite)
    v = F.transform("embedding", lambda x: F.floor(F.lit(SCALE) * x.cast("double")).cast("long"))
    label = F.col("label") if relabel is None else relabel
    ints = whole.select(F.col("vec_id").cast("long").alias("id"), label.cast("long").alias("label"), v.alias("v"))
    return ints.withColumn("norm", F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))))


def confused_label() -> Column:
    """Every seventh id counts as of the next label."""
    return F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))


def _matrix(lists: pa.ListArray) -> np.ndarray:
    """Lists of integers as rows, the shorter ones continued with zeros."""
    lengths = lists.value_lengths().to_numpy()
    out = np.zeros((len(lists), max([0, *lengths.tolist()])), np.int64)
    out[np.arange(out.shape[1]) < lengths[:, None]] = lists.flatten().to_numpy()
    return out


def write_buckets(rows: DataFrame, folder: str) -> str:
    """All rows in buckets by label and falling norm, under folder; gives the index's place."""

    def run(batches):
        store, root = pafs.FileSystem.from_uri(folder)
        store.create_dir(root, recursive=True)
        name = f"{uuid.uuid4().hex}.arrow"
        at, made, out = 0, [], None
        for batch in batches:
            labels = batch.column(1).to_numpy()
            cuts = np.union1d(np.flatnonzero(np.diff(labels)) + 1, np.arange(0, len(labels) + 1, BUCKET))
            for a, b in zip(cuts, [*cuts[1:], len(labels)]):
                if a == b:
                    continue
                part = batch.slice(a, b - a)
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, part.schema) as w:
                    w.write_batch(part)
                body = sink.getvalue()
                out = out or store.open_output_stream(f"{root}/{name}", compression=None)
                out.write(body)
                made.append((name, at, body.size, int(labels[a]), float(batch.column(3)[int(a)].as_py())))
                at += body.size
        if out:
            out.close()
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*made), INDEX)] if made else [pa.array([], f.type) for f in INDEX], schema=INDEX)

    # The id splits labels and norms that very many rows share.
    by = ["label", F.desc("norm"), "id"]
    index = rows.select("id", "label", "v", "norm").repartitionByRange(*by).sortWithinPartitions(*by).mapInArrow(run, "file string, offset long, length long, label long, norm double")
    place = f"{folder}-index"
    index.write.parquet(place)
    return place


class _Buckets:
    """The buckets of a folder, from the largest norm down."""

    def __init__(self, folder: str, place: str):
        self.store, self.root = pafs.FileSystem.from_uri(folder)
        own, path = pafs.FileSystem.from_uri(place)
        files = [f.path for f in own.get_file_info(pafs.FileSelector(path)) if f.base_name.endswith(".parquet")]
        found = pads.dataset(files, schema=INDEX, format="parquet", filesystem=own).to_table() if files else INDEX.empty_table()
        self.index = sorted(found.to_pylist(), key=lambda b: (-b["norm"], b["file"], b["offset"]))

    def __call__(self, label: int, same: bool) -> Iterator[tuple[float, object]]:
        """(largest norm, function that reads ids and vectors) of the buckets of a label, or of all others."""
        for b in self.index:
            if (b["label"] == label) == same:
                yield b["norm"], lambda b=b: self._read(b)

    def _read(self, b: dict) -> tuple[np.ndarray, np.ndarray]:
        with self.store.open_input_file(f"{self.root}/{b['file']}") as f:
            batch = pa.ipc.open_stream(f.read_at(b["length"], b["offset"])).read_next_batch()
        return batch.column(0).to_numpy(), _matrix(batch.column(2))


def scores(anchors: np.ndarray, vectors: np.ndarray, norms: np.ndarray, norm: float) -> np.ndarray:
    """Exact inner products: by floating point where every sum is an integer that it holds, else by integers."""
    dim = min(anchors.shape[1], vectors.shape[1])
    a, v = anchors[:, :dim], vectors[:, :dim]
    most = float(norms.max(initial=0)) * norm
    if most < _EXACT / 2:
        return (a.astype(np.float64) @ v.T.astype(np.float64)).astype(np.int64)
    if most >= float(1 << 62):
        raise OverflowError("a score is beyond 64 bits")
    return a @ v.T


class _Best:
    """The K best (score, id) of each row, higher scores first, then smaller ids."""

    NONE = -np.iinfo(np.int64).max

    def __init__(self, n: int, k: int):
        self.score = np.full((n, k), self.NONE)
        self.id = np.full((n, k), np.iinfo(np.int64).max)

    def last(self) -> np.ndarray:
        return self.score[:, -1]

    def add(self, rows: np.ndarray, found: np.ndarray, ids: np.ndarray, fits: np.ndarray) -> None:
        """found: scores of `rows` with all `ids`, of which those count that `fits` says."""
        kth, kth_id = self.score[rows, -1][:, None], self.id[rows, -1][:, None]
        fits = fits & ((found > kth) | (found == kth) & (ids < kth_id))
        k = self.score.shape[1]
        for at in np.flatnonzero(fits.any(axis=1)):
            own = np.flatnonzero(fits[at])
            if len(own) > 8 * k:
                own = own[found[at, own] >= np.partition(found[at, own], -k)[-k]]
            score, who = np.append(self.score[rows[at]], found[at, own]), np.append(self.id[rows[at]], ids[own])
            best = np.lexsort((who, -score))[:k]
            self.score[rows[at]], self.id[rows[at]] = score[best], who[best]


def _bound(norms: np.ndarray, norm: float) -> np.ndarray:
    """No score is higher; a little more than the product, for its rounding."""
    return norms * norm * (1 + 1e-12) + 1


def search(ids: np.ndarray, vectors: np.ndarray, norms: np.ndarray, label: int, buckets: _Buckets, k: int = K) -> Iterator[tuple[int, int, int, int, int, int]]:
    """Anchors of one label -> (anchor, positive, rank, negative, positive's score, negative's score)."""
    near = _Best(len(ids), k)
    for norm, read in buckets(label, True):
        open_ = np.flatnonzero(_bound(norms, norm) >= near.last())
        if not len(open_):
            break
        others, theirs = read()
        near.add(open_, scores(vectors[open_], theirs, norms[open_], norm), others, others != ids[open_][:, None])
    # A window for each positive: the row of its anchor, its limits, its negatives.
    at, place = np.nonzero((near.score > _Best.NONE) & (near.score >= 0))
    high = near.score[at, place] * HIGH // 100
    low = -(-near.score[at, place] * LOW // 100)
    far = _Best(len(at), k)
    for norm, read in buckets(label, False):
        open_ = np.flatnonzero(_bound(norms[at], norm) >= np.maximum(low, far.last()))
        if not len(open_):
            break
        others, theirs = read()
        anchors, row = np.unique(at[open_], return_inverse=True)
        found = scores(vectors[anchors], theirs, norms[anchors], norm)
        different = others != ids[anchors][:, None]
        for start in range(0, len(open_), ANCHORS):
            part, own = open_[start : start + ANCHORS], row[start : start + ANCHORS]
            theirs_now = found[own]
            far.add(part, theirs_now, others, different[own] & (theirs_now <= high[part][:, None]) & (theirs_now >= low[part][:, None]))
    window, rank = np.nonzero(far.score > _Best.NONE)
    anchor, pos = at[window], place[window]
    yield from zip(ids[anchor].tolist(), near.id[anchor, pos].tolist(), (rank + 1).tolist(), far.id[window, rank].tolist(), near.score[anchor, pos].tolist(), far.score[window, rank].tolist())


def mine(rows: DataFrame, anchors: DataFrame, k: int = K) -> DataFrame:
    """rows, anchors (both of integer_rows()) -> anchor_id, positive_id, rank, negative_id, positive_score, negative_score."""
    spark = rows.sparkSession
    bound_batches(spark)
    folder = new_path(spark, "hardneg")
    place = write_buckets(rows, folder)
    n = anchors.count()
    parts = max(1, math.ceil(n / ANCHORS), min(math.ceil(n / FEW), 4 * spark.sparkContext.defaultParallelism))

    def run(batches):
        buckets = None
        for batch in batches:
            for start in range(0, batch.num_rows, ANCHORS):
                part = batch.slice(start, ANCHORS)
                buckets = buckets or _Buckets(folder, place)
                ids, labels, vectors, norms = part.column(0).to_numpy(), part.column(1).to_numpy(), _matrix(part.column(2)), part.column(3).to_numpy()
                found = [r for label in np.unique(labels) for own in [labels == label] for r in search(ids[own], vectors[own], norms[own], int(label), buckets, k)]
                kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in found], kind) for c, kind in enumerate(kinds)], ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"])

    by = ["label", F.desc("norm"), "id"]
    return anchors.select("id", "label", "v", "norm").repartitionByRange(parts, *by).sortWithinPartitions(*by).mapInArrow(run, FOUND)
