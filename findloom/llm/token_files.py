"""Token-id files by bit-plane shuffling.

Documents are range-sorted by doc_id, encoded where they arrive, and appended to one file a partition as a single run of
ids, an end id after each document. Ids are cut into blocks of BLOCK; the bytes (or bits) of a block are transposed into
planes, so that like bytes lie together, and each plane is compressed with zstandard on its own. A file ends with an index
of its blocks (place, planes' lengths, ids, checksum) and of its documents (doc_id, ids), so any range of ids is read
without the rest. A manifest table in the shared folder names the files of the tasks that finished, in order, and how many ids
lie before each.

Encoding: the tokenizer drops white space and no token, normalisation or merge reaches across ASCII white space, so a text's
ids are those of its pieces between it, one after another. The library encodes each distinct word once, and a worker remembers
up to MEMORY of them. Whole texts are encoded: long ones in stretches of about STRETCH bytes that end at white space. That
holds for tokenizers of this kind only; `pieces=False` encodes every text in one call instead.

Defined cases: a null text is empty and has the end id alone; rows without a doc_id come first; rows that share a doc_id
lie in order of their texts' hashes, and equal rows are interchangeable; a document may span any number of blocks; an empty
table gives no rows; other columns are not looked at.
"""

from __future__ import annotations

import os
import re
import struct
import uuid
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from findloom.llm.common import bound_batches, new_path, written

TOKENIZER, END_ID = "word_bpe_49k.json", 2
BLOCK = 1 << 16
#: Documents a batch of the result, and bytes encoded at once.
ROWS, STRETCH = 2000, 4 << 20
#: Words that a worker remembers.
MEMORY = 1_000_000
#: Plain pieces: ASCII, and Latin letters with one lower-case form each; and the words that such a lower-cased piece has.
PLAIN = r"^[!-~À-ÖØ-öø-įĲ-ňŊ-ž]*$"
WORD = re.compile(r"\n|'s|'t|'re|'ve|'m|'ll|'d|[a-zà-öø-įĳ-ňŋ-žß]+|[0-9]|[!-/:-@\[-`{-~]+")
LEVEL = 3
MAGIC, PLANES = b"FLTOK1\r\n", {"byte": 4, "bit": 32}
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


@lru_cache(maxsize=2)
def _tokenizer(name: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
    import public_tokenizers
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path(name))


@lru_cache(maxsize=2)
def _encoder(tokenizer: str, pieces: bool) -> Encoder:
    """One of each kind in a worker, whose memory serves the tasks that follow."""
    return Encoder(tokenizer, pieces)


def _joined(parts: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """(all ids, length of each part)."""
    lengths = np.fromiter(map(len, parts), np.int64, len(parts))
    return np.fromiter((i for p in parts for i in p), np.uint32, int(lengths.sum())), lengths


def _gathered(values: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """values[start : start + length] of each, one after another."""
    ends = np.cumsum(lengths)
    return values[np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - lengths - starts, lengths)]


class Encoder:
    """Texts -> ids, piece by piece, with a bounded memory of words.

    A piece of plain characters is cut into words where the tokenizer cuts it: plain characters are printable ASCII and Latin
    letters that normalisation only puts in lower case. Words that are new are encoded many at a time, as one text with spaces
    between; a word's last id is one that ends a word. Other pieces are encoded each by itself.
    """

    def __init__(self, tokenizer: str = TOKENIZER, pieces: bool = True):
        self.library, self.pieces = _tokenizer(tokenizer), pieces
        vocabulary = self.library.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[n for token, n in vocabulary.items() if token.endswith("</w>")]] = True
        self.forget()

    def forget(self) -> None:
        self.known: dict[str, int] = {}
        self.ids, self.bounds, self.n = np.zeros(1 << 16, np.uint32), np.zeros(1 << 16, np.int64), 0

    def _encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        return _joined([e.ids for e in self.library.encode_batch_fast(texts, add_special_tokens=False)])

    def _encode_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        ids, _ = self._encode([" ".join(words[k : k + 1000]) for k in range(0, len(words), 1000)])
        last = np.flatnonzero(self.ends[ids])
        if len(last) != len(words):
            raise ValueError("the tokenizer cuts words otherwise than stated here")
        return ids, np.diff(last, prepend=-1)

    def _places(self, texts: list[str], encode) -> np.ndarray:
        """The numbers under which the ids of texts are remembered, after learning those that are new."""
        new = [t for t in texts if t not in self.known]
        if new:
            ids, lengths = encode(new)
            first, total = len(self.known), self.n + len(ids)
            if total > len(self.ids):
                self.ids = np.resize(self.ids, 2 * total)
            self.ids[self.n : total] = ids
            after = first + len(new) + 1
            if after > len(self.bounds):
                self.bounds = np.resize(self.bounds, 2 * after)
            self.bounds[first + 1 : after] = self.n + np.cumsum(lengths)
            self.known.update(zip(new, range(first, first + len(new))))
            self.n = total
        return np.fromiter(map(self.known.__getitem__, texts), np.int64, len(texts))

    def _stretch(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids, number of ids of each text) of a few short texts."""
        if not self.pieces:
            return self._encode(texts.to_pylist())
        split = pc.ascii_split_whitespace(texts)
        coded = split.flatten().dictionary_encode()
        distinct = coded.dictionary
        if len(self.known) + 2 * len(distinct) > MEMORY:
            self.forget()
        plain = pc.match_substring_regex(distinct, PLAIN).to_numpy(zero_copy_only=False) & ~pc.match_substring(distinct, "<|").to_numpy(zero_copy_only=False)
        # What each distinct piece is made of: words, or itself.
        parts = pa.array(WORD.findall("\n".join([*distinct.filter(pa.array(plain)).to_pylist(), ""]).lower()), pa.string()).dictionary_encode()
        words = parts.dictionary.to_pylist()
        stop = words.index("\n") if "\n" in words else -1
        codes = parts.indices.to_numpy()
        words_place = self._places([w for w in words if w != "\n"], self._encode_words)
        if stop >= 0:
            words_place = np.insert(words_place, stop, -1)
        odd = self._places(distinct.filter(pa.array(~plain)).to_pylist(), self._encode)
        stops = np.flatnonzero(codes == stop)
        sequence = np.concatenate((words_place[codes[codes != stop]], odd)) if len(codes) else odd
        made_of = np.ones(len(distinct), np.int64)
        made_of[plain] = np.diff(stops, prepend=-1) - 1
        first = np.zeros(len(distinct), np.int64)
        first[plain] = np.cumsum(made_of[plain]) - made_of[plain]
        first[~plain] = made_of[plain].sum() + np.arange(len(odd))
        # Pieces of the texts -> remembered words -> ids.
        which = coded.indices.to_numpy()
        in_piece = made_of[which]
        remembered = _gathered(sequence, first[which], in_piece)
        start, count = self.bounds[remembered], self.bounds[remembered + 1] - self.bounds[remembered]
        before = np.concatenate(([0], np.cumsum(count)))
        ends = np.concatenate(([0], np.cumsum(in_piece)))[np.concatenate(([0], np.cumsum(split.value_lengths().to_numpy())))]
        return _gathered(self.ids, start, count), np.diff(before[ends])

    def documents(self, texts: pa.Array) -> Iterator[np.ndarray]:
        """The ids of each text, in order."""
        sizes = pc.binary_length(texts).to_numpy()
        at = 0
        while at < len(texts):
            if self.pieces and sizes[at] > STRETCH:
                yield np.concatenate([self._stretch(pa.array([part], pa.large_string()))[0] for part in stretches(texts[at].as_py().encode())])
                at += 1
                continue
            end, held = at + 1, sizes[at]
            while end < len(texts) and held + sizes[end] <= STRETCH:
                held += sizes[end]
                end += 1
            ids, n = self._stretch(texts.slice(at, end - at))
            yield from np.split(ids, np.cumsum(n)[:-1])
            at = end


def stretches(text: bytes) -> Iterator[str]:
    """A text in parts of about STRETCH bytes that end at ASCII white space."""
    at = 0
    while at < len(text):
        end = min(at + STRETCH, len(text))
        while end < len(text):
            stop = np.flatnonzero(_SPACE[np.frombuffer(text, np.uint8, min(STRETCH, len(text) - end), end)])
            if len(stop):
                end += int(stop[0])
                break
            end = min(end + STRETCH, len(text))
        yield text[at:end].decode()
        at = end


def to_planes(ids: np.ndarray, mode: str = "byte") -> list[bytes]:
    """The planes of a block of unsigned 32-bit ids, lowest first."""
    raw = ids.astype("<u4").view(np.uint8).reshape(-1, 4)
    if mode == "byte":
        return [raw[:, k].tobytes() for k in range(4)]
    return [np.packbits(bits).tobytes() for bits in np.unpackbits(raw, axis=1, bitorder="little").T]


def of_planes(planes: list[bytes], n: int, mode: str = "byte") -> np.ndarray:
    if mode == "byte":
        raw = np.stack([np.frombuffer(p, np.uint8) for p in planes], axis=1)
    else:
        bits = np.stack([np.unpackbits(np.frombuffer(p, np.uint8), count=n) for p in planes], axis=1)
        raw = np.packbits(bits, axis=1, bitorder="little")
    return np.ascontiguousarray(raw).view("<u4").ravel()


def _stream(table: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_table(table)
    return sink.getvalue().to_pybytes()


class Writer:
    """One file: magic, planes' mode, compressed planes by block, block index, document index, their lengths, magic."""

    def __init__(self, out, id_type: pa.DataType, mode: str = "byte", block: int = BLOCK):
        self.out, self.id_type, self.mode, self.block = out, id_type, mode, block
        self.press = zstandard.ZstdCompressor(level=LEVEL)
        self.held, self.n_held, self.at, self.total = [], 0, 0, 0
        self.blocks, self.docs = [], ([], [])
        self._write(MAGIC + mode.encode().ljust(8))

    def _write(self, data: bytes) -> None:
        self.out.write(data)
        self.at += len(data)

    def add(self, doc_id, ids: np.ndarray) -> None:
        self.docs[0].append(doc_id)
        self.docs[1].append(len(ids))
        self.held.append(ids)
        self.n_held += len(ids)
        if self.n_held >= self.block:
            whole = np.concatenate(self.held)
            for k in range(0, len(whole) - self.block + 1, self.block):
                self._block(whole[k : k + self.block])
            rest = whole[len(whole) // self.block * self.block :].copy()
            self.held, self.n_held = [rest], len(rest)

    def _block(self, ids: np.ndarray) -> None:
        packed = [self.press.compress(p) for p in to_planes(ids, self.mode)]
        self.blocks.append((self.at, list(map(len, packed)), len(ids), zlib.crc32(ids.astype("<u4").tobytes())))
        self.total += len(ids)
        self._write(b"".join(packed))

    def close(self) -> None:
        if self.n_held:
            self._block(np.concatenate(self.held))
        kinds = [pa.int64(), pa.list_(pa.int32()), pa.int32(), pa.int64()]
        index = pa.table([pa.array([b[k] for b in self.blocks], kind) for k, kind in enumerate(kinds)], ["offset", "planes", "n", "crc32"])
        docs = pa.table([pa.array(self.docs[0], self.id_type), pa.array(self.docs[1], pa.int64())], ["doc_id", "n"])
        parts = [_stream(index), _stream(docs)]
        self._write(b"".join(parts) + struct.pack("<QQ", *map(len, parts)) + MAGIC)
        self.out.close()


class Reader:
    """A file opened at its end: the indexes, and any range of ids."""

    def __init__(self, file):
        self.file = file
        size = file.size()
        tail = file.read_at(16 + len(MAGIC), size - 16 - len(MAGIC))
        head = file.read_at(len(MAGIC) + 8, 0)
        if head[: len(MAGIC)] != MAGIC or tail[16:] != MAGIC:
            raise ValueError("not a token file")
        self.mode = head[len(MAGIC) :].decode().strip()
        n_index, n_docs = struct.unpack("<QQ", tail[:16])
        body = file.read_at(n_index + n_docs, size - 16 - len(MAGIC) - n_index - n_docs)
        index, self.docs = (pa.ipc.open_stream(b).read_all() for b in (body[:n_index], body[n_index:]))
        self.offset, self.planes, self.crc32 = (index.column(c).to_pylist() for c in ("offset", "planes", "crc32"))
        self.n = index.column("n").to_numpy()
        self.first = np.concatenate(([0], np.cumsum(self.n)))
        self.press = zstandard.ZstdDecompressor()

    def block(self, k: int) -> np.ndarray:
        data, planes, at = self.file.read_at(sum(self.planes[k]), self.offset[k]), [], 0
        for size in self.planes[k]:
            planes.append(self.press.decompress(data[at : at + size]))
            at += size
        ids = of_planes(planes, int(self.n[k]), self.mode)
        if zlib.crc32(ids.tobytes()) != self.crc32[k]:
            raise ValueError(f"block {k} does not meet its checksum")
        return ids

    def blocks_of(self, start: int, count: int) -> Iterator[np.ndarray]:
        """The ids from `start` on, as they come from the blocks."""
        k = int(np.searchsorted(self.first, start, "right")) - 1
        while count > 0:
            ids = self.block(k)[start - self.first[k] :][:count]
            yield ids
            start, count, k = start + len(ids), count - len(ids), k + 1

    def documents(self) -> Iterator[tuple[int, list[np.ndarray]]]:
        """(number of ids before it, ids in pieces) of each document; each block is read once."""
        stream, held, start = self.blocks_of(0, int(self.first[-1])), np.zeros(0, np.uint32), 0
        for n in self.docs.column("n").to_pylist():
            parts, left = [], n
            while left:
                held = held if len(held) else next(stream)
                parts.append(held[:left])
                left, held = left - len(parts[-1]), held[left:]
            yield start, parts
            start += n


ID_TYPES = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}


def write_tokens(docs: DataFrame, folder: str, tokenizer: str = TOKENIZER, end_id: int = END_ID, mode: str = "byte", block: int = BLOCK, pieces: bool = True) -> DataFrame:
    """docs(doc_id, text) as files in folder -> the manifest: part (order), file, ids, docs, bytes, first (ids before it)."""
    spark = docs.sparkSession
    bound_batches(spark)
    id_type = ID_TYPES[docs.schema["doc_id"].dataType.simpleString()]
    if mode not in PLANES:
        raise ValueError(f"planes are {' or '.join(PLANES)}")

    def run(batches):
        store, root = pafs.FileSystem.from_uri(folder)
        store.create_dir(root, recursive=True)
        name, out, encoder, n = f"{uuid.uuid4().hex}.tok", None, None, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            encoder = encoder or _encoder(tokenizer, pieces)
            out = out or Writer(store.open_output_stream(f"{root}/{name}", compression=None), id_type, mode, block)
            ids = batch.column(0).to_pylist()
            for doc_id, own in zip(ids, encoder.documents(batch.column(1))):
                out.add(doc_id, np.append(own, np.uint32(end_id)))
            n += len(ids)
        if out:
            out.close()
            yield pa.RecordBatch.from_pydict({"part": [TaskContext.get().partitionId()], "file": [name], "ids": [out.total], "docs": [n], "bytes": [out.at]})

    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    # Hash and row number split a doc_id, or a copied row, that very many rows share; the number is used nowhere else.
    by = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text"), F.monotonically_increasing_id()]
    in_order = texts.select("doc_id", "text", by[1].alias("h"), by[2].alias("row")).repartitionByRange(by[0], "h", "row").sortWithinPartitions(by[0], "h", "row")
    files = written(in_order.select("doc_id", "text").mapInArrow(run, "part long, file string, ids long, docs long, bytes long"), "token-files")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row a file
    return written(files.withColumn("first", F.coalesce(F.sum("ids").over(before), F.lit(0))), "token-manifest")


def read_tokens(manifest: DataFrame, folder: str, id_kind: str = "bigint") -> DataFrame:
    """The files of a manifest -> doc_id, start, n_tokens, ids_crc32, a task for each file as far as there are tasks."""

    def run(batches):
        store, root = pafs.FileSystem.from_uri(folder)
        for batch in batches:
            for name, first in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                with store.open_input_file(f"{root}/{name}") as f:
                    reader = Reader(f)
                    ids, rows = reader.docs.column("doc_id").combine_chunks(), []
                    for k, (start, parts) in enumerate(reader.documents(), 1):
                        crc = 0
                        for p in parts:
                            crc = zlib.crc32(p.astype("<u4").tobytes(), crc)
                        rows.append((first + start, sum(map(len, parts)), crc))
                        if len(rows) == ROWS or k == len(ids):
                            columns = [ids.slice(k - len(rows), len(rows)), *(pa.array(c, pa.int64()) for c in zip(*rows))]
                            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "start", "n_tokens", "ids_crc32"])
                            rows = []

    files = manifest.select("file", "first")
    return files.repartition(max(1, manifest.count()), "file").mapInArrow(run, f"doc_id {id_kind}, start long, n_tokens long, ids_crc32 long")


def read_range(manifest: DataFrame, folder: str, start: int, count: int) -> np.ndarray:
    """`count` ids from `start` on, read from the blocks that hold them; on the driver, so for a sample or a look."""
    store, root = pafs.FileSystem.from_uri(folder)
    own = manifest.where((F.col("first") < start + count) & (F.col("first") + F.col("ids") > start)).orderBy("first").collect()
    parts = []
    for r in own:
        with store.open_input_file(f"{root}/{r['file']}") as f:
            low = max(start - r["first"], 0)
            parts += list(Reader(f).blocks_of(low, min(start + count - r["first"], r["ids"]) - low))
    return np.concatenate(parts) if parts else np.zeros(0, np.uint32)


def encoded(docs: DataFrame, **options) -> DataFrame:
    """docs written and read back: doc_id, start, n_tokens, ids_crc32."""
    folder = new_path(docs.sparkSession, "tokens")
    manifest = write_tokens(docs, folder, **options)
    return read_tokens(manifest, folder, docs.schema["doc_id"].dataType.simpleString())
