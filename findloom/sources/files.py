"""Text and web files with unknown encodings, as rows of (path, text)."""

from __future__ import annotations

import re
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from findloom.functions.text import scrub_control

#: Encodings in the order they are tried; latin1 reads anything, so those after it are there by name only.
ENCODINGS = "utf-8 utf-8-sig gbk gb18030 gb2312 cp932 shift_jis euc-jp iso-2022-jp latin1 cp1252 big5".split()


def detect(head: bytes) -> tuple[str | None, float]:
    """(encoding, confidence) by chardet where it is installed, else by byte order marks only."""
    try:
        import chardet
    except ImportError:
        marks = {b"\xef\xbb\xbf": "utf-8-sig", b"\xff\xfe": "utf-16", b"\xfe\xff": "utf-16"}
        return next(((name, 1.0) for mark, name in marks.items() if head.startswith(mark)), (None, 0.0))
    found = chardet.detect(head)
    return found["encoding"], found["confidence"] or 0.0


def decoded(content: bytes) -> str:
    """The text of a file: a detected encoding if it is sure enough and reads, else the first that does; line ends become \\n."""
    name, confidence = detect(content[:4096])
    for encoding in ([name] if name and confidence >= 0.5 else []) + ENCODINGS:
        try:
            text = content.decode(encoding)
        except (UnicodeDecodeError, LookupError):
            continue
        return re.sub(r"\r\n?", "\n", text)
    return re.sub(r"\r\n?", "\n", content.decode("utf-8", "replace"))


def decoded_text(content: Column) -> Column:
    def run(contents: pa.Array) -> pa.Array:
        return pa.array([None if c is None else decoded(c) for c in contents.to_pylist()], pa.string())

    run.__annotations__ = {"contents": pa.Array, "return": pa.Array}
    return F.arrow_udf(run, "string")(content)


class _Elements(HTMLParser):
    """Texts of block elements, scripts and styles left out."""

    def __init__(self):
        super().__init__()
        self.out, self.skip = [""], 0

    def handle_starttag(self, tag, attrs):
        self.skip += tag in ("script", "style")
        if tag in ("p", "div", "li", "h1", "h2", "h3", "h4", "h5", "h6", "tr", "br", "section", "article", "title"):
            self.out.append("")

    def handle_endtag(self, tag):
        self.skip -= tag in ("script", "style") and self.skip > 0
        if tag in ("p", "div", "li", "h1", "h2", "h3", "h4", "h5", "h6", "tr", "section", "article", "title"):
            self.out.append("")

    def handle_data(self, data):
        if not self.skip:
            self.out[-1] += data


def elements(path: str, content: bytes) -> list[str]:
    """Stand-in for a document partitioner: elements of HTML and text files; others need a real one."""
    text = decoded(content)
    if path.lower().endswith((".html", ".htm")):
        parser = _Elements()
        parser.feed(text)
        return [" ".join(e.split()) for e in parser.out if e.strip()]
    return [text]


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    """(path, text) of .txt, .md and .html files below path, control characters scrubbed."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)

    def run(paths: pa.Array, contents: pa.Array) -> pa.Array:
        return pa.array([" \n".join(elements(p, c)) for p, c in zip(paths.to_pylist(), contents.to_pylist())], pa.string())

    run.__annotations__ = {"paths": pa.Array, "contents": pa.Array, "return": pa.Array}
    text = F.arrow_udf(run, "string")("path", "content")
    return files.where(F.lower("path").rlike(r"\.(txt|md|html?)$")).select("path", scrub_control(text).alias("text"))
