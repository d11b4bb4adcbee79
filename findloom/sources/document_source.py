"""Documents with metadata as a Spark data source: `spark.read.format("findloom")`, `readStream`, `write`.

A folder holds files of JSON lines (id, data, cmetadata) and a log of commits. A commit names its files, their bytes, and for each
metadata key the values that a file's documents have, as long as they are few. Keys named in the option `keys` are columns:

    spark.read.format("findloom").option("keys", "lang,source").load(folder).where("lang = 'fr'")

An equality or an IN on such a column is taken to the source, which then leaves out the files that have none of the values; Spark
still looks at the rows. Files are read in ranges of about `split` bytes, each from the first line that begins in it.

A writing task fills files of its own under a folder of the job; commit() puts one new entry into the log, under the next free
number, and only that makes them part of the folder. abort() removes the job's folder. A stream's offset is the number of
commits read, so it goes on where it stopped.

Defined cases: a folder without commits is empty; null data, metadata and ids come back as null; metadata that is no JSON object
has no values; lines may be of any length; a value that is no string is compared as its JSON text; overwriting is not offered.
Filters are taken where spark.sql.python.filterPushdown.enabled is set.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, In, InputPartition, WriterCommitMessage

FORMAT = "findloom"
SPLIT, FILE_BYTES, FEW_VALUES, ROWS = 8 << 20, 128 << 20, 64, 1000
#: Bytes of lines that a batch read holds, about; rows that are Python objects at once when writing; bytes of a batch that Spark sends.
BATCH_BYTES, SLICE, ARROW_BYTES = 2 << 20, 100, "8m"
FIXED = ("id", "data", "cmetadata")


def register(spark: SparkSession) -> None:
    spark.dataSource.register(DocumentSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    # By rows alone a batch is 10,000 documents, whatever their length.
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", ARROW_BYTES)


def read(spark: SparkSession, folder: str, keys: str = "") -> DataFrame:
    register(spark)
    return spark.read.format(FORMAT).option("keys", keys).load(folder)


def write(rows: DataFrame, folder: str, keys: str = "") -> None:
    """rows(id, data, cmetadata) as a commit."""
    register(rows.sparkSession)
    rows.select(*FIXED).write.format(FORMAT).option("keys", keys).mode("append").save(folder)


def _metadata(text: str | None) -> dict:
    try:
        found = json.loads(text or "null")
    except ValueError:
        return {}
    return found if isinstance(found, dict) else {}


def _value(metadata: dict, key: str) -> str | None:
    found = metadata.get(key)
    return found if found is None or isinstance(found, str) else json.dumps(found, ensure_ascii=False)


class _Folder:
    def __init__(self, path: str):
        self.fs, self.root = pafs.FileSystem.from_uri(path if "://" in path else f"file://{path}")

    def commits(self) -> list[str]:
        found = self.fs.get_file_info(pafs.FileSelector(f"{self.root}/_commits", allow_not_found=True))
        return sorted(f.path for f in found if f.base_name.endswith(".json"))

    def files(self, first: int = 0, end: int | None = None) -> list[dict]:
        """The files of commits first, first + 1, ... before end."""
        out = []
        for path in self.commits()[first:end]:
            with self.fs.open_input_stream(path) as f:
                out += json.loads(f.read())
        return out


@dataclass
class Range(InputPartition):
    file: str
    start: int
    end: int


@dataclass
class Written(WriterCommitMessage):
    files: list[dict] = field(default_factory=list)


class DocumentSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return FORMAT

    def keys(self) -> list[str]:
        return [k.strip() for k in self.options.get("keys", "").split(",") if k.strip()]

    def schema(self) -> T.StructType:
        return T.StructType([T.StructField(n, T.StringType()) for n in (*FIXED, *self.keys())])

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return _Reader(self.options["path"], self.keys(), int(self.options.get("split", SPLIT)))

    def streamReader(self, schema: T.StructType) -> DataSourceStreamReader:
        return _StreamReader(self.options["path"], self.keys(), int(self.options.get("split", SPLIT)))

    def writer(self, schema: T.StructType, overwrite: bool) -> DataSourceArrowWriter:
        if overwrite:
            raise ValueError("documents are appended; there is no overwriting")
        if [f.name for f in schema.fields] != list(FIXED):
            raise ValueError(f"documents have the columns {', '.join(FIXED)}")
        return _Writer(self.options["path"], self.keys())


class _Ranges:
    """Reading of byte ranges, for batches and streams."""

    def __init__(self, path: str, keys: list[str], split: int):
        self.path, self.keys, self.split = path, keys, split
        self.wanted: dict[str, set[str]] = {}

    def _of(self, files: list[dict]) -> list[Range]:
        out = []
        for f in files:
            if all(k not in f["values"] or values & set(f["values"][k]) for k, values in self.wanted.items()):
                out += [Range(f["file"], at, min(at + self.split, f["bytes"])) for at in range(0, f["bytes"], self.split)]
        return out

    def _lines(self, part: Range) -> Iterator[bytes]:
        """The lines that begin in a range."""
        folder = _Folder(self.path)
        with folder.fs.open_input_file(f"{folder.root}/{part.file}") as f:
            # A line begins where the file does, or after a line end: the byte before the range tells.
            at = max(part.start - 1, 0)
            held, begun = b"", part.start == 0
            while True:
                data = f.read_at(1 << 20, at)
                if not data:
                    break
                held, base = held + data, at - len(held)
                at += len(data)
                if not begun:
                    cut = held.find(b"\n")
                    if cut < 0:
                        if at >= part.end:
                            return
                        held = b""
                        continue
                    held, base, begun = held[cut + 1 :], base + cut + 1, True
                *whole, rest = held.split(b"\n")
                for line in whole:
                    if base >= part.end:
                        return
                    yield line
                    base += len(line) + 1
                held = rest
                if base >= part.end:
                    return

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        names, rows, size = [*FIXED, *self.keys], [], 0

        def batch() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*rows)], names)

        for line in self._lines(partition):
            row = json.loads(line)
            metadata = _metadata(row[2])
            rows.append((*row, *(_value(metadata, k) for k in self.keys)))
            size += len(line)
            if len(rows) == ROWS or size >= BATCH_BYTES:
                yield batch()
                rows, size = [], 0
        if rows:
            yield batch()


class _Reader(_Ranges, DataSourceReader):
    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            values = {f.value} if isinstance(f, EqualTo) else set(f.value) if isinstance(f, In) else None
            if values is not None and len(f.attribute) == 1 and f.attribute[0] in self.keys:
                known = self.wanted.get(f.attribute[0])
                self.wanted[f.attribute[0]] = values if known is None else known & values
            # Files go; their rows are for Spark to look at.
            yield f

    def partitions(self) -> list[Range]:
        return self._of(_Folder(self.path).files()) or [Range("", 0, 0)]

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        if partition.file:
            yield from super().read(partition)


class _StreamReader(_Ranges, DataSourceStreamReader):
    def initialOffset(self) -> dict:
        return {"commits": 0}

    def latestOffset(self) -> dict:
        return {"commits": len(_Folder(self.path).commits())}

    def partitions(self, start: dict, end: dict) -> list[Range]:
        return self._of(_Folder(self.path).files(start["commits"], end["commits"]))

    def commit(self, end: dict) -> None:
        pass


class _Writer(DataSourceArrowWriter):
    def __init__(self, path: str, keys: list[str]):
        self.path, self.keys, self.job = path, keys, f"job-{uuid.uuid4().hex}"
        # Made before any task runs and by none of them: once abort() has removed it, a task that still runs can open no file.
        folder = _Folder(path)
        folder.fs.create_dir(f"{folder.root}/{self.job}", recursive=True)

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        folder, done = _Folder(self.path), Written()
        out, size, values = None, 0, {}

        def close() -> None:
            nonlocal out
            out.close()
            done.files.append({"file": name, "bytes": size, "values": {k: sorted(v) for k, v in values.items() if v is not None}})
            out = None

        slices = (batch.slice(at, SLICE) for batch in iterator for at in range(0, batch.num_rows, SLICE))
        for row in (row for part in slices for row in zip(*(c.to_pylist() for c in part.columns))):
            if out is None:
                name = f"{self.job}/{uuid.uuid4().hex}.jsonl"
                out, size, values = folder.fs.open_output_stream(f"{folder.root}/{name}", compression=None), 0, {k: set() for k in self.keys}
            line = json.dumps(list(row), ensure_ascii=False).encode() + b"\n"
            out.write(line)
            size += len(line)
            metadata = _metadata(row[2])
            for k, held in values.items():
                if held is not None and (v := _value(metadata, k)) is not None:
                    held.add(v)
                    if len(held) > FEW_VALUES:
                        values[k] = None
            if size >= FILE_BYTES:
                close()
        if out is not None:
            close()
        return done

    def commit(self, messages: list[Written | None]) -> None:
        folder = _Folder(self.path)
        files = [f for m in messages if m for f in m.files]
        if not files:
            return self.abort(messages)
        folder.fs.create_dir(f"{folder.root}/_commits", recursive=True)
        # The job's name breaks the tie of two jobs that commit at once: both entries count, in one order for all readers.
        target = f"{folder.root}/_commits/{len(folder.commits()):012d}-{self.job}.json"
        aside = f"{folder.root}/{self.job}/commit"
        with folder.fs.open_output_stream(aside, compression=None) as out:
            out.write(json.dumps(files).encode())
        folder.fs.move(aside, target)

    def abort(self, messages: list[Written | None]) -> None:
        folder = _Folder(self.path)
        for _ in range(20):
            if folder.fs.get_file_info(f"{folder.root}/{self.job}").type != pafs.FileType.Directory:
                return
            try:
                folder.fs.delete_dir(f"{folder.root}/{self.job}")
            except OSError:
                time.sleep(0.1)  # a task has just put a file there
