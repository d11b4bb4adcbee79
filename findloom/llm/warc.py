"""WARC archives, index first.

write_archives() turns pages into WARC records (a gzip member each) in the shared folder and gives an index row for
every record: file, offset, length, url and payload digest. read_records() takes any selection of index rows, deals
them out by stretches of the archives' bytes, sorts them by file and place, coalesces neighbouring byte ranges into one
read, and parses the records.

Of records with equal payloads of REVISIT_BYTES or more, the one with the largest page_id is a response and the others
are revisits, which hold no payload but its digest, its length and the response they refer to. Smaller payloads are
always responses.

A task writes a file under a name of its own and moves it to its final name when complete; only index rows of tasks
that succeeded name files, so lost executors and second attempts leave no half archives in use. Files are opened
through pyarrow's file systems, so the shared folder may be in any store that they reach.

Defined cases: a null html is an empty payload; a null url is written as urn:x-unknown; control characters in a url are
percent-encoded in the header (the index keeps the url as it is); rows that repeat a page_id and payload are all
responses if that page_id is the largest; rows without a page_id are responses; empty tables give no rows.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from findloom.llm.common import new_path, written

REVISIT_BYTES = 1000
#: Ranges this near each other are read at once, up to READ_BYTES.
GAP_BYTES, READ_BYTES = 64 << 10, 8 << 20
#: An archive is dealt to tasks in stretches of this many bytes.
STRETCH_BYTES = 32 << 20
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
INDEX = "page_id {id}, url string, digest string, file string, offset long, length long"
RECORD = "page_id {id}, url string, record_type string, refers_to {id}, payload_digest string, payload_bytes long, payload binary"


def header_safe(url: str) -> str:
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url)


def record(page_id, url: str | None, payload: bytes, refers_to=None) -> bytes:
    """One WARC record, as a gzip member."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if refers_to is not None else http + payload
    digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: <urn:x-page:{page_id}>",
        f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {header_safe(url) if url else 'urn:x-unknown'}",
        f"WARC-Payload-Digest: sha1:{digest}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if refers_to is not None:
        lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <urn:x-page:{refers_to}>"]
    press = zlib.compressobj(1, zlib.DEFLATED, 31)
    return press.compress("\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + press.flush()


def parsed(member: bytes) -> tuple[dict[str, str], bytes]:
    """(headers, HTTP payload) of a record; for a revisit the payload is empty and its length is in "payload-length"."""
    raw = zlib.decompress(member, 31)
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    headers = {k.lower(): v for k, _, v in (line.partition(": ") for line in lines[1:])}
    http, _, payload = rest[: int(headers["content-length"])].partition(b"\r\n\r\n")
    headers["payload-length"] = re.search(rb"(?i)content-length: (\d+)", http)[1].decode()
    return headers, payload


def revisits(pages: DataFrame) -> DataFrame:
    """(page_id, digest, refers_to) of the pages whose payload a page of a larger id has as well; narrow rows only."""
    payload = F.coalesce("html", F.lit(""))
    narrow = pages.select("page_id", F.sha1(payload.cast("binary")).alias("digest"), F.octet_length(payload).alias("n")).where(F.col("n") >= REVISIT_BYTES)
    first = narrow.groupBy("digest", "n").agg(F.max("page_id").alias("refers_to"), F.count("*").alias("copies")).where("copies > 1")
    # Written, so that the join has plain shuffles on both sides and a payload with very many copies can be split.
    first = written(first, "firsts")
    return narrow.join(first, ["digest", "n"]).where("page_id < refers_to").select("page_id", "digest", "refers_to").distinct()


def write_archives(pages: DataFrame, folder: str) -> DataFrame:
    """pages(page_id, url, html) -> the index, after all archives are written to folder."""
    kind = pages.schema["page_id"].dataType.simpleString()
    earlier = revisits(pages).select(F.col("page_id").alias("id"), F.col("digest").alias("sha"), "refers_to")
    payload = F.coalesce("html", F.lit("")).cast("binary")
    whole = pages.select("page_id", "url", payload.alias("payload"), F.sha1(payload).alias("digest"))
    marked = whole.join(earlier, (F.col("page_id") == F.col("id")) & (F.col("digest") == F.col("sha")), "left")

    def run(batches):
        store, root = pafs.FileSystem.from_uri(folder)
        store.create_dir(root, recursive=True)
        name = f"{uuid.uuid4().hex}.warc.gz"
        out, at, made = None, 0, []
        for batch in batches:
            offsets, lengths = [], []
            for page_id, url, body, _, refers_to in zip(*(c.to_pylist() for c in batch.columns)):
                out = out or store.open_output_stream(f"{root}/{name}.part", compression=None)
                member = record(page_id, url, body, refers_to)
                out.write(member)
                offsets.append(at)
                lengths.append(len(member))
                at += len(member)
            made.append((batch.column(0), batch.column(1), batch.column(3), offsets, lengths))
        if out:
            out.close()
            store.move(f"{root}/{name}.part", f"{root}/{name}")
        for ids, urls, digests, offsets, lengths in made:
            files = pa.array([name] * len(offsets), pa.string())
            yield pa.RecordBatch.from_arrays([ids, urls, digests, files, pa.array(offsets, pa.int64()), pa.array(lengths, pa.int64())], ["page_id", "url", "digest", "file", "offset", "length"])

    return written(marked.select("page_id", "url", "payload", "digest", "refers_to").mapInArrow(run, INDEX.format(id=kind)), "warc-index")


def coalesced(ranges: list[tuple[int, int]]) -> list[tuple[int, int, list[int]]]:
    """Sorted (offset, length) ranges -> (offset, length, numbers of the ranges within) of the reads to make."""
    reads: list[tuple[int, int, list[int]]] = []
    for k, (offset, length) in enumerate(ranges):
        if reads:
            start, size, own = reads[-1]
            if offset - (start + size) <= GAP_BYTES and offset + length - start <= READ_BYTES:
                reads[-1] = (start, max(size, offset + length - start), [*own, k])
                continue
        reads.append((offset, length, [k]))
    return reads


def read_records(index: DataFrame, folder: str, keep_payload: bool = True) -> DataFrame:
    """Selected index rows -> the records as read from the archives, payload digests of responses made anew."""
    kind = index.schema["page_id"].dataType.simpleString()
    ddl = RECORD.format(id=kind) if keep_payload else RECORD.format(id=kind).removesuffix(", payload binary")
    id_type = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}[kind]
    number = str if kind == "string" else int

    def rows_of(batch, store, root):
        table = list(zip(*(batch.column(k).to_pylist() for k in range(5))))
        at = 0
        while at < len(table):
            end = at
            while end < len(table) and table[end][2] == table[at][2]:
                end += 1
            with store.open_input_file(f"{root}/{table[at][2]}") as f:
                for start, size, own in coalesced([(r[3], r[4]) for r in table[at:end]]):
                    data = f.read_at(size, start)
                    for k in own:
                        page_id, url, _, offset, length = table[at + k]
                        headers, payload = parsed(data[offset - start : offset - start + length])
                        revisit = headers["warc-type"] == "revisit"
                        stated = base64.b32decode(headers["warc-payload-digest"].removeprefix("sha1:")).hex()
                        if not revisit and hashlib.sha1(payload).hexdigest() != stated:
                            raise ValueError(f"payload of {page_id} does not meet its digest")
                        refers_to = number(headers["warc-refers-to"].removeprefix("<urn:x-page:").removesuffix(">")) if revisit else None
                        size_of = int(headers["payload-length"]) if revisit else len(payload)
                        yield page_id, url, headers["warc-type"], refers_to, stated, size_of, None if revisit else payload
            at = end

    def run(batches):
        store, root = pafs.FileSystem.from_uri(folder)
        kinds = [id_type, pa.string(), pa.string(), id_type, pa.string(), pa.int64(), pa.binary()][: 7 if keep_payload else 6]
        names = ["page_id", "url", "record_type", "refers_to", "payload_digest", "payload_bytes", "payload"][: len(kinds)]
        for batch in batches:
            for start in range(0, batch.num_rows, 500):
                rows = list(rows_of(batch.slice(start, 500), store, root))
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kinds[k]) for k in range(len(kinds))], names)

    chosen = index.select("page_id", "url", "file", "offset", "length")
    stretch = F.floor(F.col("offset") / F.lit(STRETCH_BYTES))
    n = chosen.select("file", stretch).distinct().count()
    return chosen.repartition(max(1, n), "file", stretch).sortWithinPartitions("file", "offset").mapInArrow(run, ddl)


def archive_folder(spark) -> str:
    return new_path(spark, "warc")
