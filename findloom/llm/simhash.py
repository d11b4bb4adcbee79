"""SimHash near-duplicates with BK-trees.

A fingerprint bit is 1 where over half of a text's shingle hashes have it. Equal fingerprints become one node.
Fingerprints within the radius share a band (pigeonhole: radius + 1 bands for the exact form), so a shard is all
nodes with one value of one band, and a shard's nodes form a BK-tree: children are keyed by their Hamming
distance to the parent, and a search follows only edges within the radius of its own distance. Shards are
dealt to tasks by a shuffle: the trees of a whole corpus have no size bound, so they are not broadcast.

Large shards (a third of a corpus may be copies of one text): a shard above SHARD_ROWS nodes is cut again. The
exact form cuts by bands of the remaining bits, which loses no link. The similarity form first cuts by the next band,
which joins most of a group of copies, and then lets all blocks of the shard meet two by two, but for blocks that lie
in one component already: every two nodes of a shard are compared or joined, whatever its size. Inside a shard, nodes
that differ by one bit are joined first, and a search passes over subtrees that lie wholly in its own component, so that
a dense ball of copies costs little more than a look at each node. A shard gives one row for each linked node (node,
least node of its component there), never pairs; distributed components join shards.

Two forms:
  exact        64 bits, XXH64 of shingles, links at `radius` or fewer bits, nothing missed;
  similarity   512 bits over five-word shingle sets. band_plan() takes as many bits a band as keep shards of unlike
               texts near SHARD_ROWS / 2 nodes, and as many bands as put a pair of the threshold similarity into a
               common shard with probability 1 - MISSED, at every size of corpus: up to 16 million texts 32 bands of 14
               bits (0.8: 0.97, 0.85: 0.99, 0.9: 0.9996). Pairs whose bits differ so little that their similarity is
               above the threshold beyond doubt are links; pairs around the threshold are verified on the shingle sets
               themselves, the rest are none. Sets of few shingles say too little in bits: what is left of a set of
               FEW or less without the shingles it may lack is a key, and texts that share a key are linked exactly.

Defined cases: texts without words have fingerprint zero and are linked like any other; null is the empty text;
rows that repeat a doc_id are linked by their own texts; a null doc_id is passed over in naming a component; an
empty table gives no rows.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from findloom.llm import words as W
from findloom.llm.common import free_name, written
from findloom.llm.components import connected_components

SHARD_ROWS = 2000
LONG_WORDS = 8
LEAST_BAND_BITS, MISSED = 14, 0.035
#: Shingles of sets that are linked by keys. A set of LONE or fewer has no partner of 0.8 beyond FEW, so it needs no band.
FEW, LONE = 10, 8
_LANES = np.uint64(0x0101010101010101)


def majority_bits(hashes: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """For each row of 64-bit hashes, the bits set in over half of them; zero for a row of none."""
    counts = np.diff(bounds)
    out = np.zeros(len(counts), np.uint64)
    full = np.flatnonzero(counts)
    if not len(full):
        return out
    # Byte lanes hold sums of up to 255 bits: rows are cut to pieces of that size.
    pieces = -(-counts[full] // 255)
    first = np.concatenate(([0], np.cumsum(pieces)))[:-1]
    nth = np.arange(pieces.sum()) - np.repeat(first, pieces)
    at = np.repeat(bounds[:-1][full], pieces) + 255 * nth
    for shift in range(8):
        lanes = np.add.reduceat((hashes >> np.uint64(shift)) & _LANES, at)
        sums = np.add.reduceat(lanes.view(np.uint8).reshape(-1, 8).astype(np.int64), first, axis=0)
        most = (2 * sums > counts[full][:, None]).astype(np.uint8)
        out[full] |= np.ascontiguousarray(most).view(np.uint64).ravel() << np.uint64(shift)
    return out


def xxh64_shingles(text: bytes, n: int) -> bytes:
    """XXH64 (seed 42) of each n-word shingle, 8 bytes each, in order and with repeats."""
    parts = text.lower().split()
    if len(parts) >= n:
        shingles = map(b" ".join, zip(*(parts[k:] for k in range(n))))
    else:
        shingles = [b" ".join(parts)] if parts else []
    return b"".join([xxhash.xxh64_digest(s, 42) for s in shingles])


def exact_fingerprints(texts: list[bytes | None], n: int) -> np.ndarray:
    hashed = [xxh64_shingles(t or b"", n) for t in texts]
    bounds = np.concatenate(([0], np.cumsum([len(h) // 8 for h in hashed], dtype=np.int64)))
    return majority_bits(np.frombuffer(b"".join(hashed), ">u8").astype(np.uint64), bounds)


def deletion_keys(hashes: np.ndarray, similarity: float) -> list[int] | None:
    """Keys of a set of at most FEW shingles: of the whole, and without each choice of shingles that a similar subset may lack, fewest first."""
    n = len(hashes)
    if n > FEW:
        return None
    whole = int(np.bitwise_xor.reduce(hashes)) if n else 0
    lacking = math.floor(n * (1 - similarity) + 1e-9)
    keys = [whole]
    for r in range(1, lacking + 1):
        keys += [int(np.bitwise_xor.reduce(c, initial=np.uint64(whole))) for c in itertools.combinations(hashes, r)]
    return [k - (1 << 64) if k >> 63 else k for k in keys]


def long_fingerprints(texts: pa.Array, n: int, similarity: float | None = None) -> list[tuple]:
    """(64 bytes, number of shingles, keys of a small set) of each text; keys only with a similarity."""
    out: list[tuple] = []
    for _, data, offsets in W.chunks(texts):
        hashes, bounds = W.unique_in_rows(*W.shingle_hashes(*W.word_hashes(data, offsets), n))
        bits = np.stack([majority_bits(W.mixed(hashes, k + 1), bounds) for k in range(LONG_WORDS)], axis=1)
        for row, a, b in zip(bits, bounds[:-1], bounds[1:]):
            out.append((row.tobytes(), int(b - a), None if similarity is None else deletion_keys(hashes[a:b], similarity)))
    return out


def fingerprints(docs: DataFrame, n: int, similarity: float | None = None) -> DataFrame:
    """docs(doc_id, text) -> doc_id, fp: a long in the exact form; with a similarity 64 bytes, and n_shingles and keys beside them."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    long_ddl = "fp binary, n_shingles int, keys array<long>"

    def run(batches):
        for batch in batches:
            for start in range(0, batch.num_rows, 500):
                part = batch.slice(start, 500)
                texts = part.column(1)
                if similarity is None:
                    made = [pa.array(exact_fingerprints(texts.cast(pa.binary()).to_pylist(), n).view(np.int64))]
                else:
                    found = long_fingerprints(texts, n, similarity)
                    made = [pa.array([f[k] for f in found], t) for k, t in enumerate((pa.binary(), pa.int32(), pa.list_(pa.int64())))]
                yield pa.RecordBatch.from_arrays([part.column(0), *made], ["doc_id", "fp", "n_shingles", "keys"][: 1 + len(made)])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, {'fp long' if similarity is None else long_ddl}")


class BKTree:
    """Fingerprints (ints) in a tree keyed by Hamming distance, with the components of all nodes within the radius."""

    def __init__(self, radius: int, sure: int | None = None, similar: Callable[[int, int], bool] | None = None):
        self.radius, self.sure, self.similar = radius, radius if sure is None else sure, similar
        #: Pairs within the radius, but beyond what is sure: the nearest of each node, and all others. With `similar` they are decided at once.
        self.doubtful: list[tuple[int, int]] = []
        self.left_out: list[tuple[int, int]] = []
        self.values: list[int] = []
        self.children: list[dict[int, int]] = []
        self.uniform: list[bool] = []  # all of the node's subtree is in one component
        self.parent: dict[int, int] = {}

    def root(self, x: int) -> int:
        parent = self.parent
        while parent.setdefault(x, x) != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    def join(self, x: int, y: int) -> None:
        x, y = self.root(x), self.root(y)
        if x != y:
            self.parent[max(x, y)] = min(x, y)

    def add(self, x: int) -> None:
        """Link x to all nodes within the radius, then hang it into the tree."""
        values, children, radius = self.values, self.children, self.radius
        me = len(values)
        if me:
            stack, own, doubts = [0], self.root(x), []
            while stack:
                node = stack.pop()
                y = values[node]
                if self.uniform[node] and self.root(y) == own:
                    continue
                d = (x ^ y).bit_count()
                if d <= self.sure:
                    self.join(x, y)
                    own = self.root(x)
                elif d <= radius and self.root(y) != own:
                    doubts.append((d, y))
                below = children[node]
                if len(below) > 2 * radius:
                    stack += [below[k] for k in range(d - radius, d + radius + 1) if k in below]
                else:
                    stack += [c for k, c in below.items() if d - radius <= k <= d + radius]
            doubts.sort()
            if self.similar:
                for _, y in doubts:
                    if self.root(x) != self.root(y) and self.similar(x, y):
                        self.join(x, y)
                own = self.root(x)
            else:
                pairs = [(x, y) for _, y in doubts if self.root(y) != own]
                self.doubtful += pairs[:1]
                self.left_out += pairs[1:]
            node = 0
            while True:
                if self.uniform[node] and self.root(values[node]) != own:
                    self.uniform[node] = False
                below, d = children[node], (x ^ values[node]).bit_count()
                if d not in below:
                    below[d] = me
                    break
                node = below[d]
        values.append(x)
        children.append({})
        self.uniform.append(True)
        self.root(x)


def linked(values: list[int], radius: int, bits: int, sure: int | None = None, labels: list | None = None, sets: dict | None = None, similarity: float = 1.0):
    """(links, doubtful pairs, nodes of doubtful pairs left out) of a shard of distinct nodes.

    A link is a node and the least node of its component. With labels, nodes of one label are in one component from
    the start; with sets, every doubtful pair of components is decided by the Jaccard similarity of its sets.
    """

    def similar(x: int, y: int) -> bool:
        common = len(sets[x] & sets[y])
        return common >= similarity * (len(sets[x]) + len(sets[y]) - common)

    tree = BKTree(radius, sure, similar if sets else None)
    if labels is not None:
        heads: dict = {}
        for x, label in zip(values, labels):
            if label is not None:
                tree.join(x, heads.setdefault(label, x))
    if len(values) > 4 * bits:
        present = set(values)
        for x in values:
            for b in range(bits):
                y = x ^ (1 << b)
                if y < x and y in present:
                    tree.join(x, y)
    for x in values:
        tree.add(x)
    apart = lambda pairs: [(x, y) for x, y in pairs if tree.root(x) != tree.root(y)]
    roots = [(x, tree.root(x)) for x in values]
    return [(x, r) for x, r in roots if x != r], apart(tree.doubtful), sorted({x for pair in apart(tree.left_out) for x in pair})


LINK, DOUBT, MORE = 0, 1, 2


def shard_links(sharded: DataFrame, keys: list[str], radius: int, bits: int, sure: int | None = None, similarity: float | None = None) -> DataFrame:
    """sharded(keys, fp, maybe label, with similarity also shingles) -> (keys, u, v, kind); one shard is in memory at a time.

    With labels, nodes of one label are in one component from the start. Kinds: LINK and DOUBT are pairs, MORE names a node u that has doubtful pairs left out (v is null).
    """
    kind = sharded.schema["fp"].dataType.simpleString()
    arrow = pa.int64() if kind == "bigint" else pa.binary()
    as_int = (lambda v: v & 0xFFFFFFFFFFFFFFFF) if kind == "bigint" else (lambda v: int.from_bytes(v, "big"))
    as_fp = (lambda x: x - (1 << 64) if x >> 63 else x) if kind == "bigint" else (lambda x: x.to_bytes(bits // 8, "big"))
    more_columns = [c for c in ("label", "shingles") if c in sharded.columns]
    key_ddl = ", ".join(f"{k} {sharded.schema[k].dataType.simpleString()}" for k in keys)
    key_types = [{"int": pa.int32(), "bigint": pa.int64()}[sharded.schema[k].dataType.simpleString()] for k in keys]

    def shards(batches) -> Iterator[tuple[tuple, list]]:
        held, last = [], None
        for batch in batches:
            columns = [c.to_pylist() if not pa.types.is_list(c.type) else [frozenset(x.values.to_numpy().tolist()) for x in c] for c in batch.columns]
            key, rows = list(zip(*columns[: len(keys)])), list(zip(*columns[len(keys) :]))
            cuts = [i for i in range(1, len(key)) if key[i] != key[i - 1]]
            for a, b in zip([0, *cuts], [*cuts, len(key)]):
                if a < b:
                    if key[a] != last:
                        if len(held) > 1:
                            yield last, held
                        held, last = [], key[a]
                    held += rows[a:b]
        if len(held) > 1:
            yield last, held

    def as_batch(rows: list[tuple]) -> pa.RecordBatch:
        n = len(keys)
        columns = [pa.array([r[k] for r in rows], t) for k, t in enumerate(key_types)]
        columns += [pa.array([None if r[n + k] is None else as_fp(r[n + k]) for r in rows], arrow) for k in (0, 1)]
        return pa.RecordBatch.from_arrays([*columns, pa.array([r[n + 2] for r in rows], pa.int32())], [*keys, "u", "v", "kind"])

    def run(batches):
        rows: list[tuple] = []
        for key, shard in shards(batches):
            values = [as_int(r[0]) for r in shard]
            labels = [r[1] for r in shard] if "label" in more_columns else None
            if similarity is None:
                links, doubtful, more = linked(values, radius, bits, sure, labels)
            else:
                links, doubtful, more = linked(values, radius, bits, sure, labels, dict(zip(values, (r[2] for r in shard))), similarity)
            rows += [(*key, *x, LINK) for x in links] + [(*key, *x, DOUBT) for x in doubtful] + [(*key, x, None, MORE) for x in more]
            if len(rows) > 10_000:
                yield as_batch(rows)
                rows = []
        yield as_batch(rows)

    together = sharded.select(*keys, "fp", *more_columns).repartition(*keys).sortWithinPartitions(*keys)
    return together.mapInArrow(run, f"{key_ddl}, u {kind}, v {kind}, kind int")


def _exact_bands(fp: Column, radius: int) -> Column:
    """array of (band, value): radius + 1 bands of the 64 bits."""
    width = 64 // (radius + 1)
    return F.array(*(F.struct(F.lit(b).alias("band"), F.shiftrightunsigned(fp, b * width).bitwiseAND((1 << width) - 1).alias("value")) for b in range(radius + 1)))


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def _with_large(rows: DataFrame) -> DataFrame:
    """rows(band, value, ...) with `large`, whether the shard has more than SHARD_ROWS rows.

    Large shards are few and most often none, so their table is written: Spark sees its size and joins without moving
    the rows as long as it is small.
    """
    sizes = rows.groupBy("band", "value").count().where(F.col("count") > SHARD_ROWS)
    large = written(sizes.select("band", "value", F.lit(True).alias("large")), "large")
    if large.isEmpty():
        return rows.withColumn("large", F.lit(False))
    return rows.join(large, ["band", "value"], "left").withColumn("large", F.coalesce("large", F.lit(False)))


def exact_links(nodes: DataFrame, radius: int) -> DataFrame:
    """nodes(fp long), distinct -> links within the radius, complete up to what components need."""
    rows = nodes.select("fp", F.explode(_exact_bands(F.col("fp"), radius)).alias("b")).select("fp", "b.band", "b.value")
    whole = F.array(F.struct(F.lit(-1).alias("sub"), F.lit(0).cast("long").alias("part")))
    cuts = _with_large(rows).withColumn("s", F.explode(F.when(F.col("large"), _slices(F.col("fp"), F.col("band"), radius)).otherwise(whole)))
    return shard_links(cuts.select("fp", "band", "value", "s.sub", "s.part"), ["band", "value", "sub", "part"], radius, 64)


def _slices(fp: Column, band: Column, radius: int) -> Column:
    """The bits outside `band` cut into radius + 1 slices (slice s holds the s-th piece of every other band): array of (sub, part).

    Two nodes of a shard that differ in at most `radius` bits agree on a whole slice, so cutting loses no link.
    """
    width = 64 // (radius + 1)
    step = width // (radius + 1)
    cuts = []
    for s in range(radius + 1):
        high = width if s == radius else (s + 1) * step
        part = F.lit(None).cast("long")
        for b in range(radius + 1):
            mask = sum(((1 << high) - (1 << s * step)) << o * width for o in range(radius + 1) if o != b)
            part = F.when(band == b, fp.bitwiseAND(F.lit(_signed(mask)))).otherwise(part)
        cuts.append(F.struct(F.lit(s).alias("sub"), part.alias("part")))
    return F.array(*cuts)


SHARD_KEYS = ["band", "value", "part"]


def _differing(similarity: float) -> float:
    """Share of bits in which two sets of that similarity differ."""
    return math.acos(2 * similarity / (1 + similarity)) / math.pi


def band_plan(nodes: int, similarity: float) -> tuple[int, int]:
    """(bits a band, bands) for so many nodes."""
    total, p = 64 * LONG_WORDS, _differing(similarity)
    bits = max(LEAST_BAND_BITS, math.ceil(math.log2(max(1, nodes) / max(1, SHARD_ROWS / 2))))
    bands = math.ceil(math.log(MISSED) / math.log(1 - (1 - p) ** bits))
    if bands * bits <= total:
        return bits, bands
    # Bands share bits: a pair that differs in many bits misses all of them together, so what counts is the mean over the number of differing bits.
    choose = lambda n, k: math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1)
    differ = np.arange(total - bits + 1)
    chance = np.exp([choose(total, d) + d * math.log(p) + (total - d) * math.log(1 - p) for d in differ])
    agree = np.exp([choose(total - d, bits) - choose(total, bits) for d in differ])
    while float(chance @ (1 - agree) ** bands) > MISSED:
        bands += max(1, bands // 50)
    return bits, bands


def band_places(bits: int, bands: int) -> np.ndarray:
    """(bands x bits) places of bits: cut from one shuffle of all bits after another."""
    r, total = np.random.default_rng(1), 64 * LONG_WORDS
    each = total // bits
    rows = [r.permutation(total)[: each * bits].reshape(each, bits) for _ in range(-(-bands // each))]
    return np.concatenate(rows)[:bands]


def banded(nodes: DataFrame, similarity: float) -> DataFrame:
    """nodes(fp 64 bytes) -> fp with each shard that it is in, and `large`: whether the shard is cut."""
    bits, bands = band_plan(nodes.count(), similarity)
    places = band_places(bits, bands)
    weights = np.int64(1) << np.arange(bits, dtype=np.int64)

    def run(batches):
        for batch in batches:
            for start in range(0, batch.num_rows, 2000):
                part = batch.slice(start, 2000)
                raw = np.frombuffer(b"".join(part.column(0).to_pylist()), np.uint8).reshape(part.num_rows, -1)
                values = np.unpackbits(raw, axis=1)[:, places].astype(np.int64) @ weights
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, values.size + 1, bands), pa.int32()), pa.array(values.ravel()))
                yield pa.RecordBatch.from_arrays([part.column(0), lists], ["fp", "bands"])

    rows = nodes.select("fp").mapInArrow(run, "fp binary, bands array<long>")
    following = F.concat(F.slice("bands", 2, bands), F.slice("bands", 1, 1))
    rows = rows.select("fp", F.posexplode(F.arrays_zip(F.col("bands").alias("value"), following.alias("next"))).alias("band", "b")).select("fp", "band", "b.value", "b.next")
    rows = written(rows, "bands")
    # A large shard is cut by the next band at first; met_in_blocks() brings together what that keeps apart.
    part = F.when(F.col("large"), F.col("next")).otherwise(-1)
    return _with_large(rows).select("fp", "band", "value", part.alias("part"), "large")


def met_in_blocks(large: DataFrame, classes: DataFrame) -> DataFrame:
    """large(fp, band, value), classes(node, component) -> (shard keys, fp, label), where all nodes of a large shard meet that are not in one component.

    A component with many nodes in the shard is dealt by hash into blocks of its own, what else the shard holds into
    others, each of about a quarter of SHARD_ROWS, and every two blocks (and one of the others by itself) are a shard. Blocks of the same
    component have nothing left to find and do not meet: a group of copies is met only by the blocks that hold others.
    """
    shard, size = ["band", "value"], max(1, SHARD_ROWS // 4)
    named = large.join(classes.select(F.col("node").alias("fp"), F.col("component").alias("label")), "fp", "left")
    named = written(named.select("fp", "label", *shard), "labelled")
    counts = written(named.groupBy(*shard, "label").agg(F.count("*").alias("n")), "label-counts")
    whole = counts.where((F.col("n") > size) & F.col("label").isNotNull()).select(*shard, "label", F.col("n").alias("own"))
    rest = counts.join(whole, [*shard, "label"], "left_anti").groupBy(*shard).agg(F.sum("n").alias("others"))
    rows = named.join(written(whole, "whole"), [*shard, "label"], "left").join(written(rest, "rest"), shard, "left")
    dealt = lambda key, n: F.pmod(F.xxhash64(key), F.ceil(n / F.lit(size)))
    block = F.when(F.col("own").isNotNull(), dealt("fp", F.col("own"))).otherwise(dealt(F.coalesce("label", "fp"), F.col("others")))
    head = F.when(F.col("own").isNotNull(), F.col("label")).otherwise(F.lit(b""))
    rows = written(rows.select("fp", "label", *shard, head.alias("head"), block.alias("block")), "blocks")
    blocks = written(rows.select(*shard, "head", "block").distinct(), "block-list")
    side = lambda a: blocks.select(*shard, F.struct("head", "block").alias(a))
    pairs = side("i").join(side("j"), shard).where((F.col("i") <= F.col("j")) & ((F.col("i.head") != F.col("j.head")) | (F.col("i.head") == F.lit(b""))))
    meet = pairs.select(*shard, F.xxhash64("i.head", "i.block", "j.head", "j.block").alias("part"), F.explode(F.array_distinct(F.array("i", "j"))).alias("b"))
    return rows.join(meet.select(*shard, "part", "b.head", "b.block"), [*shard, "head", "block"]).select(*SHARD_KEYS, "fp", "label")


def small_set_links(nodes: DataFrame, similarity: float) -> DataFrame:
    """nodes(fp, n_shingles, keys) -> links between the sets of FEW or fewer shingles that are that similar, for a similarity of 0.8 or more.

    A key stands for the shingles that are left. Of two similar small sets, one is what is left of the other, or both
    have the same size and lack one shingle of each other.
    """
    rows = nodes.where("keys is not null").select("fp", F.col("n_shingles").alias("n"), F.posexplode("keys").alias("at", "key"))
    rows = rows.withColumn("lacks", F.when(F.col("at") == 0, 0).when(F.col("at") <= F.col("n"), 1).otherwise(2)).drop("at")
    rows = written(rows, "keys")
    heads = rows.groupBy("key", "n", "lacks").agg(F.min("fp").alias("head"), F.count("*").alias("copies"))
    heads = written(heads.where((F.col("lacks") == 0) | (F.col("copies") > 1)), "key-heads")
    left = rows.where("lacks > 0")
    to_whole = left.join(heads.where("lacks = 0").select("key", "head"), "key")
    alike = (F.col("n") - F.col("lacks")) >= F.lit(similarity - 1e-9) * (F.col("n") + F.col("lacks"))
    to_equals = left.where(alike).join(heads.where("lacks > 0").select("key", "n", "lacks", "head"), ["key", "n", "lacks"])
    return to_whole.select(F.col("fp").alias("u"), F.col("head").alias("v")).unionByName(to_equals.select(F.col("fp").alias("u"), F.col("head").alias("v"))).where("u <> v")


def similarity_radii(similarity: float) -> tuple[int, int]:
    """Differing bits below which a pair is surely that similar (4 standard deviations, as a group has many pairs), and above which it surely is not (2.5)."""
    bits = 64 * LONG_WORDS
    p = _differing(similarity)
    spread = math.sqrt(bits * p * (1 - p))
    return math.floor(bits * p - 4 * spread), math.ceil(bits * p + 2.5 * spread)


def shingle_sets(wanted: DataFrame, nodes: DataFrame, docs: DataFrame, n: int) -> DataFrame:
    """(fp, shingles) of the nodes wanted(fp), as a written table. Only their texts move."""
    asked = nodes.join(wanted.distinct(), "fp").select("fp", F.col("least").alias("id"))

    def run(batches):
        for batch in batches:
            texts = batch.column(1)
            fps, rows = [f[0] for f in long_fingerprints(texts, n)], []
            for _, data, offsets in W.chunks(texts):
                hashes, bounds = W.unique_in_rows(*W.shingle_hashes(*W.word_hashes(data, offsets), n))
                rows += [hashes[a:b].view(np.int64) for a, b in zip(bounds[:-1], bounds[1:])]
            # A doc_id may stand for several texts; the node's own is the one with its fingerprint.
            own = [k for k, fp in enumerate(batch.column(0).to_pylist()) if fp == fps[k]]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(own, pa.int64())), pa.array([rows[k] for k in own], pa.list_(pa.int64()))], ["fp", "shingles"])

    texts = docs.select("doc_id", "text").join(asked, F.col("doc_id") == F.col("id")).select("fp", F.coalesce("text", F.lit("")).alias("text"))
    return written(texts.mapInArrow(run, "fp binary, shingles array<long>").dropDuplicates(["fp"]), "shingles")


def verified(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The (u, v) of pairs whose shingle sets have at least that Jaccard similarity."""
    left = pairs.join(sets.select(F.col("fp").alias("u"), F.col("shingles").alias("a")), "u")
    both = left.join(sets.select(F.col("fp").alias("v"), F.col("shingles").alias("b")), "v")
    common = F.size(F.array_intersect("a", "b"))
    return both.where(common >= similarity * (F.size("a") + F.size("b") - common)).select("u", "v")


def _joined(shards: DataFrame, classes: DataFrame, nodes: DataFrame, docs: DataFrame, n: int, similarity: float) -> DataFrame:
    """(node, component) of what classes (node, component) join already and what shards (keys, fp, maybe label) join by verified similarity.

    First the sure links and the nearest doubtful pair of each node, which are as many as the nodes: a group of copies
    falls together on them. Then the nodes that have more doubtful pairs meet in their shards again, with their shingle
    sets, and every pair of what is still apart is decided there.
    """
    sure, radius = similarity_radii(similarity)
    bits = 64 * LONG_WORDS
    as_links = lambda named: named.select(F.col("node").alias("u"), F.col("component").alias("v"))
    found = written(shard_links(shards, SHARD_KEYS, radius, bits, sure), "links")
    of_kind = lambda kind: found.where(F.col("kind") == kind).select("u", "v")
    pairs = written(of_kind(DOUBT).select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "pairs")
    open_nodes = found.where(F.col("kind") == MORE).select(*SHARD_KEYS, F.col("u").alias("fp"))
    wanted = pairs.select(F.col("u").alias("fp")).unionByName(pairs.select(F.col("v").alias("fp"))).unionByName(open_nodes.select("fp"))
    sets = shingle_sets(wanted, nodes, docs, n)
    links = of_kind(LINK).unionByName(verified(pairs, sets, similarity))
    joined = written(connected_components(links.unionByName(as_links(classes))), "classes")
    if open_nodes.isEmpty():
        return joined
    again = open_nodes.join(joined.select(F.col("node").alias("fp"), F.col("component").alias("label")), "fp", "left").join(sets, "fp")
    more = shard_links(again, SHARD_KEYS, radius, bits, sure, similarity).where(F.col("kind") == LINK).select("u", "v")
    return connected_components(as_links(joined).unionByName(more))


def similar_classes(nodes: DataFrame, docs: DataFrame, n: int, similarity: float) -> DataFrame:
    """(node, component) by verified similarity: of small sets, in the shards, and then in the blocks of those that were cut."""
    shards = banded(nodes.where(F.col("n_shingles") > LONE).select("fp"), similarity)
    large = shards.where("large").select("fp", "band", "value")
    small = connected_components(small_set_links(nodes, similarity))
    classes = _joined(shards.drop("large"), small, nodes, docs, n, similarity)
    if large.isEmpty():
        return classes
    classes = written(classes, "classes")
    return _joined(met_in_blocks(large, classes), classes, nodes, docs, n, similarity)


def near_duplicates(docs: DataFrame, n: int = 3, radius: int = 3, similarity: float | None = None) -> DataFrame:
    """docs(doc_id, text) -> doc_id, fp, component_id (least doc_id of the component), one row for each row of docs.

    With `similarity` the long form is used on sets of n-word shingles; else the exact form with `radius`.
    """
    if similarity is None and 64 % (radius + 1):
        raise ValueError("the exact form needs a radius with radius + 1 a divisor of 64")
    if similarity is not None and not 0.8 <= similarity < 1:
        raise ValueError("the similarity form is made for similarities from 0.8 to 1")
    marked = written(fingerprints(docs, n, similarity), "fingerprints")
    sets = [] if similarity is None else [F.max("n_shingles").alias("n_shingles"), F.max("keys").alias("keys")]
    nodes = written(marked.groupBy("fp").agg(F.min("doc_id").alias("least"), *sets), "nodes")
    if similarity is None:
        classes = connected_components(exact_links(nodes.select("fp"), radius).select("u", "v"))
    else:
        classes = similar_classes(nodes, docs, n, similarity)
    named = nodes.join(classes, F.col("fp") == F.col("node"), "left").select("fp", "least", F.coalesce("component", "fp").alias("component"))
    # Written, so that the join has plain shuffles on both sides and a component of very many nodes can be split.
    named = written(named, "named")
    ids = written(named.groupBy("component").agg(F.min("least").alias("component_id")), "ids")
    by_fp = named.join(ids, "component").select("fp", "component_id")
    return marked.join(by_fp, "fp").select("doc_id", "fp", "component_id")


def kept(docs: DataFrame, n: int = 5, similarity: float = 0.8) -> DataFrame:
    """One document of each near-duplicate group: the one with the least doc_id. All columns of docs stay.

    Rows that share a doc_id are decided together; of those with equal texts one stays. Rows without a doc_id stay.
    """
    found = written(near_duplicates(docs, n, similarity=similarity), "groups")
    own, rows, text = (free_name(n, docs.columns) for n in ("own_id", "own_rows", "own_text"))
    heads = found.where("doc_id is not null").groupBy(F.col("doc_id").alias(own)).agg(F.count("*").alias(rows), F.max((F.col("doc_id") == F.col("component_id")).cast("int")).alias("head"))
    heads = heads.where("head = 1").select(own, rows)
    stay = docs.join(heads, F.col("doc_id") == F.col(own))
    once = stay.where(F.col(rows) == 1).select(docs.columns)
    if heads.where(F.col(rows) > 1).isEmpty():
        out = once
    else:
        again = stay.where(F.col(rows) > 1).withColumn(text, F.xxhash64("text")).dropDuplicates(["doc_id", text])
        out = once.unionByName(again.select(docs.columns))
    lone = docs.where("doc_id is null")
    return out.unionByName(lone)
