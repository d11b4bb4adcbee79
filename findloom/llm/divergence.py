"""Source divergence audit: how far the sources of a language differ in their use of terms.

Terms are counted where texts are read and summed by (language, source, term). A language keeps the terms that at least
LEAST_DOCS of its documents hold; a kept term's counts by source are its sparse vector. Each group's smoothed share of a
term, in units of 1/UNIT, is p = 1 + floor(UNIT * (count + 2) / (N + 2 * V)), and two shares diverge by
floor((p - q)^2 / (p + q)). All arithmetic is on integers, so nothing depends on order.

Terms of one language with equal vectors diverge equally, so terms are grouped by vector, each pair of sources is evaluated
once for each distinct vector, and the result counts as often as the vector has terms. Terms that hold neither source of a
pair all diverge alike and are added by number. Original terms are ranked apart, with limits before the shuffle.

Memory: a batch of texts is counted with arrays of a few times its size, and a text of over PIECE bytes in pieces, beside
a set of its distinct terms. Sources are dealt into tiles of about TILE; a task holds the sums of one pair of tiles and
vectors arrive by tile pair and salt, so neither a language nor a source with a third of all rows lies in one task. A
vector has an entry for each source of its language that uses the term; the result has a row for each pair of sources.

Defined cases: null text, lang and source are ''; a group without kept terms has count 0 for all; a language without kept
terms has all its pairs, with value 0; a row counts as a document of its own, whether or not its doc_id or text repeat;
an empty table gives no rows; other columns of docs are not looked at.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from findloom.llm.common import bound_batches, written

#: What a term is made of: letters A-Z and a-z, and every code point beyond ASCII, whose UTF-8 bytes are all 0x80 or more.
TERM = r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+"
LEAST_DOCS, UNIT, TOP = 10, 1_000_000_000, 10
#: Texts beyond this many bytes are counted in pieces.
PIECE = 4 << 20
#: Sources a tile, vectors a task, and numbers that an evaluation holds at once.
TILE, VECTORS, CELLS = 256, 20_000, 1 << 21

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_LETTER = np.zeros(256, bool)
_LETTER[97:123] = _LETTER[128:] = True
COUNTS = "lang string, source string, term string, n long, docs long"


def _terms(data: np.ndarray, offsets: np.ndarray) -> tuple[pa.DictionaryArray, np.ndarray]:
    """(terms, row of each) of lower-cased bytes with row offsets."""
    letter = np.zeros(len(data) + 2, bool)
    letter[1:-1] = _LETTER[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    starts = np.flatnonzero(letter[1:-1] & (~letter[:-2] | edge[:-1]))
    ends = np.flatnonzero(letter[1:-1] & (~letter[2:] | edge[1:])) + 1
    bounds = np.concatenate(([0], np.cumsum(ends - starts))).astype(np.int32)
    words = pa.StringArray.from_buffers(len(starts), pa.py_buffer(bounds), pa.py_buffer(data[letter[1:-1]]))
    return words.dictionary_encode(), np.searchsorted(offsets, starts, "right") - 1


def _pieces(data: np.ndarray) -> Iterator[np.ndarray]:
    """A long text in pieces of about PIECE bytes that end between terms."""
    at = 0
    while at < len(data):
        end = min(at + PIECE, len(data))
        while end < len(data) and (stop := np.flatnonzero(~_LETTER[data[end : end + PIECE]])).size == 0:
            end = min(end + PIECE, len(data))  # a term of millions of letters stays whole
        end += int(stop[0]) if end < len(data) else 0
        yield data[at:end]
        at = end


def _counted(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """batch(lang, source, text) -> its counts: uses, and documents that hold the term."""

    def rows(lang, source, terms, n, docs):
        return pa.RecordBatch.from_arrays([lang, source, terms, pa.array(n, pa.int64()), pa.array(docs, pa.int64())], ["lang", "source", "term", "n", "docs"])

    lang, source, texts = batch.columns
    pairs = pa.StructArray.from_arrays([lang, source], ["l", "s"])
    seen: dict = {}
    group = np.array([seen.setdefault((x["l"], x["s"]), len(seen)) for x in pairs.to_pylist()], np.int64)
    first = np.unique(group, return_index=True)[1]
    offsets = np.frombuffer(texts.buffers()[1], np.int32 if pa.types.is_string(texts.type) else np.int64)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    raw = texts.buffers()[2]
    data = _LOWER[np.frombuffer(raw, np.uint8)[offsets[0] : offsets[-1]]] if raw is not None and raw.size else np.zeros(0, np.uint8)
    offsets = offsets - offsets[0]
    long = np.flatnonzero(np.diff(offsets) > PIECE)
    for row in long.tolist():
        held: set = set()
        whole = data[offsets[row] : offsets[row + 1]]
        for piece in _pieces(whole):
            found, _ = _terms(piece, np.array([0, len(piece)]))
            known = found.dictionary
            held.update(known.to_pylist())
            uses = np.bincount(found.indices.to_numpy(), minlength=len(known))
            yield rows(pa.repeat(lang[row], len(known)), pa.repeat(source[row], len(known)), known, uses, np.zeros(len(known), np.int64))
        known = pa.array(sorted(held), pa.string())
        yield rows(pa.repeat(lang[row], len(known)), pa.repeat(source[row], len(known)), known, np.zeros(len(known), np.int64), np.ones(len(known), np.int64))
    # The rest in runs of about PIECE bytes.
    at = 0
    while at < len(texts):
        if at in long:
            at += 1
            continue
        end = at + 1
        while end < len(texts) and end not in long and offsets[end + 1] - offsets[at] <= PIECE:
            end += 1
        found, row = _terms(data[offsets[at] : offsets[end]], offsets[at : end + 1] - offsets[at])
        known = len(found.dictionary)
        if known:
            code = found.indices.to_numpy().astype(np.int64)
            in_doc, uses = np.unique(row * known + code, return_counts=True)
            key, back = np.unique(group[at + in_doc // known] * known + in_doc % known, return_inverse=True)
            mine = pa.array(first[key // known])
            yield rows(lang.take(mine), source.take(mine), found.dictionary.take(pa.array(key % known)), np.bincount(back, uses).astype(np.int64), np.bincount(back))
        at = end


def term_counts(docs: DataFrame) -> DataFrame:
    """docs(lang, source, text) -> lang, source, term, n (uses), docs (rows that hold it)."""

    def run(batches):
        for batch in batches:
            yield from _counted(batch)

    bound_batches(docs.sparkSession)
    texts = docs.select(*(F.coalesce(c, F.lit("")).alias(c) for c in ("lang", "source", "text")))
    return texts.mapInArrow(run, COUNTS).groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def kept_terms(counts: DataFrame, least_docs: int = LEAST_DOCS) -> DataFrame:
    """-> lang, term, total, vector: the uses of each kept term by source, in order of source."""
    vector = F.sort_array(F.collect_list(F.struct("source", "n"))).alias("vector")
    terms = counts.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("total"), vector)
    return terms.where(F.col("docs") >= least_docs).drop("docs")


def share(count: Column, mass: Column) -> Column:
    """p of a count in a group of that mass, exact beyond 64 bits."""
    return F.call_function("div", F.lit(UNIT).cast("decimal(10,0)") * (count + 2).cast("decimal(20,0)"), mass.cast("decimal(20,0)")) + 1


def divergence(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), p + q)


def groups_of(docs: DataFrame, kept: DataFrame, tile: int = TILE) -> DataFrame:
    """A row for each (lang, source) of docs: mass and lang_mass (N + 2 V), n_terms (V), tiles of the language and the group's own."""
    groups = docs.select(F.coalesce("lang", F.lit("")).alias("lang"), F.coalesce("source", F.lit("")).alias("source")).distinct()
    uses = kept.select("lang", F.explode("vector").alias("e")).groupBy("lang", F.col("e.source").alias("source")).agg(F.sum("e.n").alias("held"))
    langs = kept.groupBy("lang").agg(F.count("*").alias("v"), F.sum("total").alias("all"))
    tiles = groups.groupBy("lang").agg(F.ceil(F.count("*") / F.lit(tile)).cast("int").alias("tiles"))
    whole = groups.join(uses, ["lang", "source"], "left").join(langs, "lang", "left").join(tiles, "lang")
    zero = F.lit(0).cast("long")
    v = F.coalesce("v", zero)
    return whole.select(
        "lang", "source", (F.coalesce("held", zero) + 2 * v).alias("mass"), (F.coalesce("all", zero) + 2 * v).alias("lang_mass"), v.alias("n_terms"),
        "tiles", F.pmod(F.xxhash64("source"), "tiles").cast("int").alias("tile"),
    )


def _shares(counts: np.ndarray, mass: np.ndarray) -> np.ndarray:
    """share() on arrays: the quotient in three steps of a factor 1000, so that no product leaves 64 bits."""
    rest, whole = counts + 2, np.zeros(len(counts), np.int64)
    for _ in range(3):
        rest = rest * 1000
        whole = whole * 1000 + rest // mass
        rest = rest % mass
    return whole + 1


class _Tiles:
    """Sums of divergences between the sources of two tiles."""

    def __init__(self, left: list[dict], right: list[dict], same: bool):
        self.sides = [self._side(left), self._side(right)]
        self.same, self.seen = same, 0
        self.sums = np.zeros((len(left), len(right)), np.int64)

    @staticmethod
    def _side(sources: list[dict]) -> tuple[dict, np.ndarray, np.ndarray]:
        mass = np.array([s["mass"] for s in sources], np.int64)
        return {s["source"]: k for k, s in enumerate(sources)}, mass, _shares(np.zeros(len(mass), np.int64), np.maximum(mass, 1))

    def _dense(self, side: int, vectors: list[list[dict]]) -> np.ndarray:
        place, mass, none = self.sides[side]
        found = [(row, k, e["n"]) for row, v in enumerate(vectors) for e in v if (k := place.get(e["source"])) is not None]
        out = np.tile(none, (len(vectors), 1))
        if found:
            rows, at, n = np.array(found, np.int64).T
            out[rows, at] = _shares(n, mass[at])
        return out

    def add(self, vectors: list[list[dict]], times: np.ndarray) -> None:
        step = max(1, CELLS // self.sums.size)
        for k in range(0, len(vectors), step):
            p = self._dense(0, vectors[k : k + step])
            q = p if self.same else self._dense(1, vectors[k : k + step])
            gap, both = p[:, :, None] - q[:, None, :], p[:, :, None] + q[:, None, :]
            self.sums += np.tensordot(times[k : k + step], gap * gap // both, 1)
        self.seen += int(times.sum())

    def rows(self, lang: str) -> pa.RecordBatch:
        i, j = np.triu_indices(len(self.sums), 1) if self.same else (x.ravel() for x in np.indices(self.sums.shape))
        names = [pa.array(list(s[0]), pa.string()).take(pa.array(k)) for s, k in zip(self.sides, (i, j))]
        columns = [pa.repeat(pa.scalar(lang, pa.string()), len(i)), *names, pa.array(self.sums[i, j]), pa.array(np.full(len(i), self.seen, np.int64)), pa.array(self.sides[0][2][i]), pa.array(self.sides[1][2][j])]
        return pa.RecordBatch.from_arrays(columns, ["lang", "a", "b", "part", "seen", "none_a", "none_b"])


def _evaluated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (lang, left, right, salt), each group led by its tiles, then distinct vectors."""
    key, tiles = None, None
    for batch in batches:
        for start in range(0, batch.num_rows, 1024):
            vectors, times = [], []
            for r in batch.slice(start, 1024).to_pylist():
                if r["sources"] is not None:
                    if vectors:
                        tiles.add(vectors, np.array(times, np.int64))
                        vectors, times = [], []
                    if tiles is not None:
                        yield tiles.rows(key)
                    key, tiles = r["lang"], _Tiles(r["sources"], r["others"], r["left"] == r["right"])
                else:
                    vectors.append(r["vector"])
                    times.append(r["times"])
            if vectors:
                tiles.add(vectors, np.array(times, np.int64))
    if tiles is not None:
        yield tiles.rows(key)


def source_pairs(kept: DataFrame, groups: DataFrame) -> DataFrame:
    """-> lang, a, b, value: the summed divergence of each two sources of a language, a pair once."""
    distinct = written(kept.groupBy("lang", "vector").agg(F.count("*").alias("times")), "divergence-vectors")
    salts = max(1, math.ceil(distinct.count() / VECTORS))
    # Hashing may leave a tile without sources: pairs are made of those that have some.
    langs = groups.groupBy("lang", "tiles").agg(F.collect_set("tile").alias("used"))
    own = F.array_distinct(F.transform("vector", lambda e: F.pmod(F.xxhash64(e["source"]), F.col("tiles")).cast("int")))
    spread = distinct.join(langs, "lang").withColumn("own", own)
    # A vector goes to the pairs of tiles in which one of its sources lies: all of them, where there is one tile.
    pairs = F.flatten(F.transform("own", lambda t: F.transform("used", lambda o: F.struct(F.least(t, o).alias("left"), F.greatest(t, o).alias("right")))))
    spread = spread.withColumn("pair", F.explode(F.array_distinct(pairs)))
    none = F.lit(None).cast("array<struct<source:string,mass:bigint>>")
    salt = F.pmod(F.xxhash64("vector"), F.lit(salts)).cast("int")
    rows = spread.select("lang", "pair.left", "pair.right", salt.alias("salt"), F.lit(1).alias("kind"), none.alias("sources"), none.alias("others"), "vector", "times")
    tiles = groups.groupBy("lang", "tile").agg(F.sort_array(F.collect_list(F.struct("source", "mass"))).alias("sources"))
    others = tiles.select("lang", F.col("tile").alias("right"), F.col("sources").alias("others"))
    heads = tiles.withColumnRenamed("tile", "left").join(others, "lang").where("left <= right")
    heads = heads.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    empty = F.lit(None).cast(kept.schema["vector"].dataType)
    rows = rows.unionByName(heads.select("lang", "left", "right", "salt", F.lit(0).alias("kind"), "sources", "others", empty.alias("vector"), F.lit(0).cast("long").alias("times")))
    dealt = rows.repartition("lang", "left", "right", "salt").sortWithinPartitions("lang", "left", "right", "salt", "kind")
    found = dealt.mapInArrow(_evaluated, "lang string, a string, b string, part long, seen long, none_a long, none_b long")
    sums = found.groupBy("lang", "a", "b").agg(*(F.sum(c).alias(c) for c in ("part", "seen")), *(F.max(c).alias(c) for c in ("none_a", "none_b")))
    terms = groups.groupBy("lang").agg(F.max("n_terms").alias("n_terms"))
    rest = (F.col("n_terms") - F.col("seen")) * divergence(F.col("none_a"), F.col("none_b"))
    return sums.join(terms, "lang").select("lang", "a", "b", (F.col("part") + rest).alias("value"))


def telling_terms(kept: DataFrame, groups: DataFrame) -> DataFrame:
    """-> lang, source, item, value of the kept terms that a group uses more than its language does."""
    uses = kept.select("lang", F.col("term").alias("item"), "total", F.explode("vector").alias("e")).select("lang", "item", "total", "e.source", "e.n")
    both = uses.join(groups.select("lang", "source", "mass", "lang_mass"), ["lang", "source"])
    shares = both.select("lang", "source", "item", share(F.col("n"), F.col("mass")).alias("p"), share(F.col("total"), F.col("lang_mass")).alias("q"))
    return shares.where("p > q").select("lang", "source", "item", divergence(F.col("p"), F.col("q")).alias("value"))


def _ranked(rows: DataFrame, part: str) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    return rows.select("lang", "source", F.lit(part).alias("part"), "item", F.col("value").cast("long").alias("value"), rank.alias("rank"))


def audit(docs: DataFrame, least_docs: int = LEAST_DOCS, top: int = TOP, tile: int = TILE) -> DataFrame:
    """docs(lang, source, text) -> lang, source, part, item, value, rank: parts `pair` (all ranks) and `term` (ranks to `top`)."""
    kept = written(kept_terms(term_counts(docs), least_docs), "divergence-terms")
    groups = written(groups_of(docs, kept, tile), "divergence-groups")
    once = source_pairs(kept, groups)
    ends = F.array(F.struct(F.col("a").alias("source"), F.col("b").alias("item")), F.struct(F.col("b").alias("source"), F.col("a").alias("item")))
    pairs = once.select("lang", "value", F.explode(ends).alias("e")).select("lang", "e.source", "e.item", "value")
    return _ranked(pairs, "pair").unionByName(_ranked(telling_terms(kept, groups), "term").where(F.col("rank") <= top))
