"""Text search by posting lists: an inverted index over chunks, and a top-k that passes over blocks of chunks.

A block is a run of up to RUN neighbouring chunks of a document. For each term and block there is a row with the postings (chunk
and number of hits) and the largest number of hits among them; it is made where the chunks are read, so the one shuffle of
an index is that which lays it out. Rows lie in shelves by hash of the term and are sorted by term, so a search reads the
files of its terms' shelves, within them the row groups of its terms, and never a text.

top_chunks() first reads only how many hits a block can have: over the query's terms, the number of terms that occur in the
block and the sum of their largest hits bound every chunk's (terms, hits). The SEEDS blocks of highest bound are evaluated;
the k-th best of their chunks is a score that k chunks reach, and blocks whose bound lies below it are passed over. All
of it is one lazy plan, for any number of queries at once.

An index grows by segments: each has a number, and chunks that were deleted or replaced since are named in `gone` with the
number of the segment from which on they count again (findloom.streaming.index_upkeep).

Defined cases: null and blank texts have no postings; a query without valid terms finds nothing; terms count once however
often a query names them; ties go by document and chunk id; rows without a doc_id or embed_id are not indexed. A segment is of
rows whose keys do not repeat.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from findloom.operators.ranking import spaced_tokens, valid_terms
from findloom.sources.snapshots import Layout

RUN, SEEDS = 64, 8
#: Chunks whose postings a task and shelf lays out, about.
SALT_CHUNKS = 1_000_000
KEYS, BLOCK = ["doc_id", "embed_id"], ["segment", "doc_id", "block"]
_field = lambda name, kind: T.StructField(name, kind)
#: block is the embed_id that a block's chunks are counted from: chunk block + ats[k] has ns[k] hits.
POSTINGS = T.StructType(
    [_field("term", T.StringType()), _field("segment", T.LongType()), _field("doc_id", T.StringType()), _field("block", T.LongType()), _field("most", T.IntegerType())]
    + [_field(name, T.ArrayType(T.IntegerType())) for name in ("ats", "ns")]
)
#: A chunk of which only segments from `since` on count.
GONE = T.StructType([_field("doc_id", T.StringType()), _field("embed_id", T.LongType()), _field("since", T.LongType())])


def layouts(shelves: int) -> dict[str, Layout]:
    return {"postings": Layout(POSTINGS, ("term", *BLOCK), shelves), "gone": Layout(GONE)}


def _posted(batch: pa.RecordBatch, shelves: int) -> tuple[pa.RecordBatch, np.ndarray]:
    """batch(doc_id, embed_id, words) -> (its postings in the order they are stored in, where each shelf begins). Chunks of one document and run in one batch are a block."""
    doc, embed, words = batch.column(0).dictionary_encode(), batch.column(1).to_numpy(), batch.column(2)
    runs, run = np.unique(embed // RUN, return_inverse=True)
    _, group = np.unique(_ranks(doc.dictionary)[doc.indices.to_numpy()] * len(runs) + run, return_inverse=True)
    first = np.full(group.max() + 1, np.iinfo(np.int64).max)
    np.minimum.at(first, group, embed)
    chunks = np.lexsort((embed, group))
    place = np.empty(len(embed), np.int64)
    place[chunks] = np.arange(len(embed))
    terms = words.flatten().dictionary_encode()
    # As Layout.shelf() has it.
    shelf = np.array([xxhash.xxh64_intdigest(t, 42) for t in terms.dictionary.to_pylist()], np.uint64).astype(np.int64) % shelves
    order = np.lexsort((_ranks(terms.dictionary), shelf))
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    # One number a token, so one plain sort; sorted tables of batches are runs to the sort that lays out a shelf.
    tokens_at = np.sort(rank[terms.indices.to_numpy()] * len(embed) + np.repeat(place, words.value_lengths().to_numpy()))
    begins = np.flatnonzero(np.diff(tokens_at, prepend=-1))
    hits = np.diff(begins, append=len(tokens_at)).astype(np.int32)
    term, chunk = order[tokens_at[begins] // len(embed)], chunks[tokens_at[begins] % len(embed)]
    starts = np.flatnonzero(np.diff(term, prepend=-1) | np.diff(group[chunk], prepend=-1)) if len(term) else np.zeros(0, np.int64)
    ats = (embed[chunk] - first[group[chunk]]).astype(np.int32)
    most = np.maximum.reduceat(hits, starts) if len(starts) else hits
    bounds = pa.array(np.append(starts, len(hits)), pa.int32())
    columns = [terms.dictionary.take(pa.array(term[starts])), batch.column(0).take(pa.array(chunk[starts])), pa.array(first[group[chunk[starts]]]), pa.array(most)]
    rows = pa.RecordBatch.from_arrays([*columns, *(pa.ListArray.from_arrays(bounds, pa.array(x)) for x in (ats, hits))], LISTS)
    return rows, np.searchsorted(shelf[term[starts]], np.arange(shelves + 1))


def _split(spaced: pa.Array) -> pa.Array:
    """The tokens of texts as spaced_tokens() gives them."""
    lists = pc.split_pattern(spaced, " ")
    # Only a text without tokens has an empty part, and that alone.
    held = pc.not_equal(spaced, "").to_numpy(zero_copy_only=False)
    lengths = np.where(held, lists.value_lengths().to_numpy(), 0)
    flat = lists.flatten()
    return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(lengths))), pa.int32()), flat.filter(pc.not_equal(flat, "")))


def _ranks(texts: pa.Array) -> np.ndarray:
    """The place of each of some distinct texts in their order."""
    out = np.empty(len(texts), np.int64)
    out[pc.array_sort_indices(texts).to_numpy()] = np.arange(len(texts))
    return out


LISTS = ["term", "doc_id", "block", "most", "ats", "ns"]


def _packed(rows: pa.RecordBatch) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, rows.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_batch(rows)
    return sink.getvalue().to_pybytes()


def indexed(chunks: DataFrame, segment: int, shelves: int, salts: int = 1) -> DataFrame:
    """chunks(doc_id, embed_id, embed_data) -> rows of POSTINGS, in tasks by shelf and salt.

    What is shuffled are the lists of a batch and shelf as one compressed table: a few bytes a posting, where rows would take dozens.
    A shelf that a very frequent term fills is dealt to `salts` tasks.
    """

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            rows, bounds = _posted(batch.set_column(2, "words", _split(batch.column(2))), shelves)
            held = np.flatnonzero(np.diff(bounds))
            salt = xxhash.xxh64_intdigest(f"{batch.column(0)[0]} {batch.column(1)[0]}") % salts
            blobs = [_packed(rows.slice(bounds[k], bounds[k + 1] - bounds[k])) for k in held.tolist()]
            yield pa.RecordBatch.from_arrays([pa.array(held, pa.int32()), pa.array([salt] * len(held), pa.int32()), pa.array(blobs, pa.binary())], ["shelf", "salt", "lists"])

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for blob in batch.column(2):
                yield from pa.ipc.open_stream(blob.as_buffer())

    spaced = chunks.where("doc_id is not null and embed_id is not null").select(*KEYS, spaced_tokens(F.coalesce("embed_data", F.lit(""))).alias("words"))
    packed = spaced.mapInArrow(pack, "shelf int, salt int, lists binary").repartitionById(shelves * salts, F.col("shelf") * salts + F.col("salt"))
    lists = packed.mapInArrow(unpack, "term string, doc_id string, block long, most int, ats array<int>, ns array<int>")
    return lists.select("term", F.lit(segment).cast("long").alias("segment"), "doc_id", "block", "most", "ats", "ns")


def chunk_hits(postings: DataFrame, *carry: str) -> DataFrame:
    """postings -> carried columns, doc_id, embed_id, hits: a row for each posting."""
    rows = postings.select(*carry, "doc_id", "block", F.explode(F.arrays_zip("ats", "ns")).alias("p"))
    return rows.select(*carry, "doc_id", (F.col("block") + F.col("p.ats")).alias("embed_id"), F.col("p.ns").alias("hits"))


def relisted(hits: DataFrame, segment: int) -> DataFrame:
    """hits(term, doc_id, embed_id, hits) of any segments -> rows of POSTINGS, a run of a document a block."""
    block = F.floor(F.col("embed_id") / F.lit(RUN)) * RUN
    lists = hits.groupBy("term", "doc_id", block.alias("block")).agg(F.max("hits").alias("most"), F.sort_array(F.collect_list(F.struct("embed_id", "hits"))).alias("l"))
    ats = F.transform("l", lambda x: (x["embed_id"] - F.col("block")).cast("int"))
    return lists.select("term", F.lit(segment).cast("long").alias("segment"), "doc_id", "block", "most", ats.alias("ats"), F.col("l.hits").alias("ns"))


def of_terms(postings: DataFrame, terms: list[str], layout: Layout) -> DataFrame:
    """The rows of some terms: their shelves and row groups only."""
    if not terms:
        return postings.where("false")
    spark = postings.sparkSession
    # A local relation of as many rows as there are terms: no job runs.
    shelves = {r[0] for r in spark.createDataFrame([(t,) for t in terms], "term string").select(layout.shelf(F.col("term"))).collect()}
    return postings.where(F.col("shelf").isin(sorted(shelves)) & F.col("term").isin(terms))


def _alive(held: DataFrame, gone: DataFrame | None) -> DataFrame:
    """Postings held(segment, doc_id, embed_id, more) of chunks that have not gone."""
    if gone is None:
        return held
    later = gone.groupBy(*KEYS).agg(F.max("since").alias("since"))
    return held.join(later, KEYS, "left").where(F.col("since").isNull() | (F.col("segment") >= F.col("since"))).drop("since")


def _scored(blocks: DataFrame, asked: DataFrame, postings: DataFrame, gone: DataFrame | None, within: DataFrame | None = None) -> DataFrame:
    """blocks(qid, segment, doc_id, block) -> qid, doc_id, embed_id, n_terms, hits of the chunks in them that hold a term of the query."""
    rows = postings.join(F.broadcast(asked), ["shelf", "term"]).join(blocks, ["qid", *BLOCK])
    held = chunk_hits(rows, "qid", "segment")
    if within is not None:
        held = held.join(within.select("doc_id").distinct(), "doc_id", "left_semi")
    return _alive(held, gone).groupBy("qid", *KEYS).agg(F.count("*").alias("n_terms"), F.sum("hits").alias("hits"))


def _best(scored: DataFrame, k: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("n_terms"), F.desc("hits"), *KEYS))
    return scored.withColumn("rank", rank).where(F.col("rank") <= k)


def asked_terms(postings: DataFrame, queries: dict[int, list[str]], layout: Layout) -> tuple[DataFrame, DataFrame]:
    """(qid, term, shelf of each term of each query; the rows of the index that hold any of them)."""
    pairs = [(qid, t) for qid, terms in queries.items() for t in valid_terms(terms)]
    asked = postings.sparkSession.createDataFrame(pairs, "qid long, term string").withColumn("shelf", layout.shelf(F.col("term")))
    return asked, of_terms(postings, sorted({t for _, t in pairs}), layout)


def top_chunks(postings: DataFrame, gone: DataFrame | None, queries: dict[int, list[str]], k: int, layout: Layout, seeds: int = SEEDS, within: DataFrame | None = None) -> DataFrame:
    """postings and gone as stored, queries (qid -> terms) -> qid, doc_id, embed_id, n_terms, hits, rank: the k chunks with
    most distinct terms, then most hits, of each query; of the documents of within(doc_id) only, if that is given.

    A list of queries comes with the request and is as long as that; it is broadcast.
    """
    asked, rows = asked_terms(postings, queries, layout)
    reach = rows.select("shelf", "term", *BLOCK, "most").join(F.broadcast(asked), ["shelf", "term"])
    bounds = reach.groupBy("qid", *BLOCK).agg(F.count("*").alias("can_terms"), F.sum("most").alias("can_hits"))
    order = Window.partitionBy("qid").orderBy(F.desc("can_terms"), F.desc("can_hits"), *BLOCK)
    first = bounds.withColumn("place", F.row_number().over(order)).where(F.col("place") <= seeds)
    sure = _best(_scored(first.select("qid", *BLOCK), asked, rows, gone, within), k).where(F.col("rank") == k)
    least = sure.select(F.col("qid").alias("of"), F.col("n_terms").alias("least_terms"), F.col("hits").alias("least_hits"))
    # A row a query; a block that can just tie stays, since its chunks may have smaller ids.
    open_ = bounds.join(F.broadcast(least), F.col("qid") == F.col("of"), "left")
    reaches = F.col("of").isNull() | (F.col("can_terms") > F.col("least_terms")) | ((F.col("can_terms") == F.col("least_terms")) & (F.col("can_hits") >= F.col("least_hits")))
    found = _scored(open_.where(reaches).select("qid", *BLOCK), asked, rows, gone, within)
    return _best(found, k).select("qid", *KEYS, "n_terms", "hits", "rank")


def open_blocks(postings: DataFrame, gone: DataFrame | None, queries: dict[int, list[str]], k: int, layout: Layout, seeds: int = SEEDS) -> tuple[int, int]:
    """(blocks that top_chunks() evaluates, blocks that hold a term), summed over the queries: for figures and tests."""
    asked, rows = asked_terms(postings, queries, layout)
    bounds = rows.join(F.broadcast(asked), ["shelf", "term"]).groupBy("qid", *BLOCK).agg(F.count("*").alias("can_terms"), F.sum("most").alias("can_hits"))
    order = Window.partitionBy("qid").orderBy(F.desc("can_terms"), F.desc("can_hits"), *BLOCK)
    first = bounds.withColumn("place", F.row_number().over(order)).where(F.col("place") <= seeds)
    least = {r.qid: (r.n_terms, r.hits) for r in _best(_scored(first.select("qid", *BLOCK), asked, rows, gone), k).where(F.col("rank") == k).collect()}
    every = bounds.collect()
    return sum((r.can_terms, r.can_hits) >= least.get(r.qid, (0, 0)) for r in every), len(every)


def holding_any(postings: DataFrame, gone: DataFrame | None, terms: list[str], layout: Layout) -> DataFrame:
    """The full-text predicate: doc_id, embed_id, n_terms, hits of every chunk that holds any of the terms."""
    asked, rows = asked_terms(postings, {0: terms}, layout)
    # A chunk's postings are in one block of one segment, but for those that have gone: blocks are dealt as they are stored, arrays and all.
    held = rows.join(F.broadcast(asked), ["shelf", "term"]).select(*BLOCK, "ats", "ns")
    held = chunk_hits(held.repartition(*BLOCK), "segment", "block")
    return _alive(held, gone).groupBy(*BLOCK, "embed_id").agg(F.count("*").alias("n_terms"), F.sum("hits").alias("hits")).select(*KEYS, "n_terms", "hits")
