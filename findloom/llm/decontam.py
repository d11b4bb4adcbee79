"""Benchmark decontamination by the q-gram lemma.

An item of L characters that stands in a text with at most k edits shares at least L - q + 1 - k*q of its q-grams
with it, all on diagonals (place in the text minus place in the item) that differ by k at most. Texts are scanned
for the items' q-grams, hits are counted in diagonal bands that overlap by k, bands whose count reaches the bound
are kept, and a banded alignment of the item against the band decides and gives place and edits.

Letters count without case and runs of white space as one space; places are given in the text as it is. The q-gram
code keeps eight bits of each character, which can only add hits; the alignment sees whole characters.

The items are written to the shared folder in files of about BLOCK_BYTES, which tasks read one at a time; neither the
driver nor a task ever holds more than one. Texts never move: a text is scanned where it is read, so that hot items,
sources or copies put no more rows into one task. Hits are counted in pieces of PIECE at most and summed by band, so a
text or item that repeats one q-gram over and over costs time but no more memory.

Items of fewer than q characters have no q-gram; find_passages() looks for them exactly, as whole words. They cannot be
told from chance, so without_passages() drops no document for them.

Defined cases: null and empty texts hold nothing; a null or blank item is not searched; equal rows and equal items are
each reported; an empty table on either side gives no rows; a text of any length is scanned whole. Of places of one item
that overlap, the one of fewest edits is reported.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from findloom.llm.common import new_path

Q = 8
EDIT_SHARE = 0.1
BLOCK_BYTES = 8 << 20
PIECE = 1 << 20
#: Texts that a task holds while it goes through the blocks of items.
GROUP_BYTES = 64 << 20
SLOT_BITS = 20
#: Bits of a band's number in a key (item, band); diagonals are shifted by OFFSET so that none is negative.
BAND_KEY, OFFSET = 40, 1 << 36
_MULT = np.uint64(0x9E3779B97F4A7C15)

_FOLD = np.arange(1 << 16, dtype=np.uint32)
for _c in range(1 << 16):
    if not 0xD800 <= _c < 0xE000 and len(chr(_c).lower()) == 1:
        _FOLD[_c] = ord(chr(_c).lower())
_BLANK = np.array([not 0xD800 <= c < 0xE000 and chr(c).isspace() for c in range(1 << 16)])
_FOLD[_BLANK] = 32


def folded(text: str) -> tuple[np.ndarray, np.ndarray]:
    """(characters without case, runs of white space as one space; place of each in the text)."""
    raw = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    small = raw < 1 << 16
    chars = np.where(small, _FOLD[np.where(small, raw, 0)], raw)
    blank = chars == 32
    keep = ~blank
    keep[1:] |= ~blank[:-1]
    if len(keep) and blank[0]:
        keep[0] = False
    at = np.flatnonzero(keep)
    if len(at) and chars[at[-1]] == 32:
        at = at[:-1]
    return chars[at], at


def grams(chars: np.ndarray, q: int = Q) -> np.ndarray:
    """The q-grams (q = 8) as integers of eight bits a character."""
    if len(chars) < q:
        return np.zeros(0, np.uint64)
    codes = np.ascontiguousarray((chars ^ (chars >> np.uint32(8)) * np.uint32(37)).astype(np.uint8))
    return np.ndarray((len(codes) - q + 1,), np.uint64, codes, 0, (1,)).copy()


class Items:
    """The q-gram index of one block of benchmark items."""

    def __init__(self, ids: list, texts: list[str], share: float = EDIT_SHARE):
        found = [(i, folded(t)[0]) for i, t in zip(ids, texts) if t is not None]
        self.short = [(i, re.compile(rf"(?<!\w){re.escape(_string(c))}(?!\w)")) for i, c in found if 0 < len(c) < Q]
        found = [(i, c) for i, c in found if len(c) >= Q]
        self.ids = [i for i, _ in found]
        self.chars = [c for _, c in found]
        length = np.array([len(c) for c in self.chars], np.int64)
        self.budget = np.minimum((share * length).astype(np.int64), (length - Q) // Q)
        self.bound = length - Q + 1 - self.budget * Q
        # A band is 2**z diagonals, z the least with 2**z > k, and runs on for k more, so any k+1 neighbours lie in one.
        self.shift = np.array([int(k).bit_length() for k in self.budget], np.int64)
        parts = [grams(c) for c in self.chars]
        all_grams = np.concatenate(parts) if parts else np.zeros(0, np.uint64)
        item = np.repeat(np.arange(len(parts)), [len(p) for p in parts]) if parts else np.zeros(0, np.int64)
        place = np.concatenate([np.arange(len(p)) for p in parts]) if parts else np.zeros(0, np.int64)
        order = np.argsort(all_grams, kind="stable")
        self.known, first, self.count = np.unique(all_grams[order], return_index=True, return_counts=True)
        self.first, self.item, self.place = first, item[order].astype(np.int32), place[order].astype(np.int32)
        self.slots = np.zeros(1 << SLOT_BITS, bool)
        self.slots[(self.known * _MULT) >> np.uint64(64 - SLOT_BITS)] = True

    def _keys(self, at: np.ndarray, k: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(key, hits) of the bands that text places `at` with known q-grams `k` hit; a key is item and band."""
        n = self.count[k]
        total = np.cumsum(n)
        entry = np.arange(total[-1]) - np.repeat(total - n - self.first[k], n)
        item = self.item[entry]
        diagonal = np.repeat(at + OFFSET, n) - self.place[entry]
        shift = self.shift[item]
        band = diagonal >> shift
        early = (diagonal - (band << shift)) < self.budget[item]
        key = (item.astype(np.int64) << BAND_KEY) + band
        return np.unique(np.concatenate((key, key[early] - 1)), return_counts=True)

    def candidates(self, text_grams: np.ndarray) -> list[tuple[int, int]]:
        """(item, first diagonal of a band) whose shared q-grams reach the bound."""
        if not len(self.known):
            return []
        at = np.flatnonzero(self.slots[(text_grams * _MULT) >> np.uint64(64 - SLOT_BITS)])
        if not len(at):
            return []
        seen = text_grams[at]
        k = np.minimum(np.searchsorted(self.known, seen), len(self.known) - 1)
        real = self.known[k] == seen
        at, k = at[real], k[real]
        if not len(at):
            return []
        total = np.cumsum(self.count[k])
        counted, start = [], 0
        while start < len(at):
            end = max(start + 1, int(np.searchsorted(total, (total[start - 1] if start else 0) + PIECE, "right")))
            counted.append(self._keys(at[start:end], k[start:end]))
            start = end
            if len(counted) > 16:
                counted = [_summed(counted)]
        keys, hits = _summed(counted)
        item = keys >> BAND_KEY
        full = hits >= self.bound[item]
        return [(i, (int(b) << int(self.shift[i])) - OFFSET) for i, b in zip(item[full].tolist(), (keys[full] & ((1 << BAND_KEY) - 1)).tolist())]

    def aligned(self, item: int, diagonal: int, chars: np.ndarray) -> tuple[int, int, int] | None:
        """(start, end, edits) of the best place of the item on the band's diagonals, if within budget."""
        own, k = self.chars[item], int(self.budget[item])
        low, high = diagonal - k, diagonal + (1 << int(self.shift[item])) + 2 * k
        begin = max(0, low)
        window = chars[begin : max(0, high + len(own))]
        # A q-gram of the item counts once, however often the text repeats it.
        if np.count_nonzero(np.isin(grams(own), grams(window))) < self.bound[item]:
            return None
        exact = _find(window, own)
        if exact >= 0:
            return begin + exact, begin + exact + len(own), 0
        edits, start, end = banded_alignment(own, window, k, low - begin, high - begin)
        return (begin + start, begin + end, edits) if edits <= k else None

    def holds(self, text: str | None) -> bool:
        """Whether any item of q characters or more is in the text."""
        if not text:
            return False
        chars, _ = folded(text)
        return any(self.aligned(item, diagonal, chars) for item, diagonal in self.candidates(grams(chars)))

    def regions(self, text: str | None) -> list[tuple]:
        """(item id, start, end, edits) of every item in the text, start and end in the text's code points."""
        if not text:
            return []
        chars, at = folded(text)
        best: dict[int, list[tuple[int, int, int]]] = {}
        for item, diagonal in self.candidates(grams(chars)):
            found = self.aligned(item, diagonal, chars)
            if found:
                own = best.setdefault(item, [])
                # Candidates of an item come in the order of their diagonals, so only its last places can overlap.
                near = 0
                while near < len(own) and own[-1 - near][1] > found[0]:
                    near += 1
                if all(x[2] > found[2] for x in own[len(own) - near :]):
                    own[len(own) - near :] = [found]
        out = [(self.ids[i], s, e, d) for i, places in best.items() for s, e, d in places]
        if self.short:
            whole = _string(chars)
            out += [(i, m.start(), m.end(), 0) for i, pattern in self.short for m in pattern.finditer(whole)]
        return sorted(((i, int(at[s]), int(at[e - 1]) + 1, d) for i, s, e, d in out), key=lambda x: (x[0] is not None, x))


def _string(chars: np.ndarray) -> str:
    return chars.astype("<u4").tobytes().decode("utf-32-le", "surrogatepass")


def _summed(counted: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    if len(counted) == 1:
        return counted[0]
    keys, back = np.unique(np.concatenate([k for k, _ in counted]), return_inverse=True)
    return keys, np.bincount(back, np.concatenate([n for _, n in counted])).astype(np.int64)


def _find(window: np.ndarray, own: np.ndarray) -> int:
    place = (whole := window.tobytes()).find(sought := own.tobytes())
    while place >= 0 and place % 4:
        place = whole.find(sought, place + 1)
    return place // 4 if place >= 0 else -1


def banded_alignment(own: np.ndarray, window: np.ndarray, k: int, low: int, high: int) -> tuple[int, int, int]:
    """(edits, start, end): the substring of window nearest to own; ends before and after it are free.

    Only diagonals (place in window minus place in own) from low to high are filled: each row is one pass over the band.
    """
    width, far = high - low + 1, 1 << 20
    steps = np.arange(width, dtype=np.int64)
    # wide[j - low + len(own)...]: the window with room on both sides, so that every row reads a plain slice.
    room = max(0, -low) + 1
    wide = np.full(room + max(len(window), high + len(own)) + 1, 0xFFFFFFFF, np.uint32)
    wide[room : room + len(window)] = window
    places = steps + low
    cost = np.where((places >= 0) & (places <= len(window)), 0, far)
    origin = places.copy()
    for row, c in enumerate(own, 1):
        places = steps + (low + row)
        inside = (places >= 0) & (places <= len(window))
        kept = cost + (wide[room + low + row - 1 : room + low + row - 1 + width] != c)
        dropped = np.append(cost[1:], far) + 1
        take = kept <= dropped
        best, where = np.where(take, kept, dropped), np.where(take, origin, np.append(origin[1:], 0))
        best = np.where(inside, best, far)
        if low + row <= 0 <= high + row:
            # Nothing of the window yet: all of own so far is left out.
            best[-(low + row)], where[-(low + row)] = row, 0
        # Characters of the window that the item lacks: run on from the cheapest place to the left.
        level = best - steps
        least = np.minimum.accumulate(level)
        source = np.maximum.accumulate(np.where(level == least, steps, 0))
        cost, origin = np.where(inside, least + steps, far), where[source]
        if cost.min() > k:
            return far, 0, 0
    end = int(cost.argmin())
    return int(cost[end]), int(origin[end]), low + len(own) + end


def _stored(benchmark: DataFrame) -> str:
    """The items as Parquet files of about BLOCK_BYTES in the shared folder."""
    items = benchmark.select("item_id", "text").where("text is not null")
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    folder = new_path(benchmark.sparkSession, "benchmark")
    n = math.ceil(size / BLOCK_BYTES)
    (items.coalesce(1) if n <= 1 else items.repartition(n, F.xxhash64("item_id", "text"))).write.parquet(folder)
    return folder


def _searched(batches: Iterator[pa.RecordBatch], blocks: Blocks, look: Callable, empty: Callable) -> Iterator[tuple[pa.RecordBatch, list | set]]:
    """(batch, what look(items, batch, found so far) has found over all blocks of items) of each batch.

    Batches are held up to GROUP_BYTES, so that a block's index is made once for all of them.
    """

    def done(group):
        found = [empty() for _ in group]
        for items in blocks:
            for k, batch in enumerate(group):
                new = look(items, batch, found[k])
                found[k] = found[k] | new if empty is set else found[k] + new
        yield from zip(group, found)

    group, size = [], 0
    for batch in batches:
        group.append(batch)
        size += batch.nbytes
        if size >= GROUP_BYTES:
            yield from done(group)
            group, size = [], 0
    yield from done(group)


class Blocks:
    """The item files of a folder, an index of one at a time; that of a single file is kept."""

    def __init__(self, folder: str, share: float):
        self.folder, self.share, self.only = folder, share, None

    def __iter__(self):
        if self.only is not None:
            yield self.only
            return
        store, root = pafs.FileSystem.from_uri(self.folder)
        files = sorted(f.path for f in store.get_file_info(pafs.FileSelector(root)) if f.base_name.endswith(".parquet"))
        for path in files:
            rows = pq.read_table(path, filesystem=store)
            items = Items(rows.column("item_id").to_pylist(), rows.column("text").to_pylist(), self.share)
            if len(files) == 1:
                self.only = items
            yield items


def find_passages(docs: DataFrame, benchmark: DataFrame, share: float = EDIT_SHARE) -> DataFrame:
    """docs(doc_id, text), benchmark(item_id, text) -> doc_id, item_id, start, end, edits of every passage found."""
    doc_kind, item_kind = docs.schema["doc_id"].dataType.simpleString(), benchmark.schema["item_id"].dataType.simpleString()
    folder = _stored(benchmark)
    item_type = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}[item_kind]

    def run(batches):
        for own, found in _searched(batches, Blocks(folder, share), lambda items, batch, _: [(row, f) for row, text in enumerate(batch.column(1)) for f in items.regions(text.as_py())], list):
            columns = [own.column(0).take(pa.array([r for r, _ in found], pa.int64())), pa.array([f[0] for _, f in found], item_type)]
            columns += [pa.array([f[k] for _, f in found], pa.int64()) for k in (1, 2, 3)]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "item_id", "start", "end", "edits"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {doc_kind}, item_id {item_kind}, start long, end long, edits long")


def without_passages(docs: DataFrame, benchmark: DataFrame, share: float = EDIT_SHARE) -> DataFrame:
    """The documents that hold no benchmark item of q characters or more; all columns of docs stay. A text is looked at where it is read."""
    at = docs.columns.index("text")
    folder = _stored(benchmark)

    def run(batches):
        for own, held in _searched(batches, Blocks(folder, share), lambda items, batch, held: {row for row in range(batch.num_rows) if row not in held and items.holds(batch.column(at)[row].as_py())}, set):
            yield own.filter(pa.array([row not in held for row in range(own.num_rows)], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
