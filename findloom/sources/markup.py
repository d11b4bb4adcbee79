"""Image blocks inside marked-up documents: `<!-- image_begin -->` sections with OCR text, description and base64 data."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from findloom.functions.text import stripped


def _section(name: str) -> str:
    return rf"(?s)<!-- {name}_begin -->(.*?)<!-- {name}_end -->"


def blocks(data: Column) -> Column:
    return F.regexp_extract_all(data, F.lit(r"(?s)<!-- image_begin -->(.*?)<!-- image_end -->"), 1)


def image_blocks(docs: DataFrame) -> DataFrame:
    """docs(doc_id, data) -> the image table: a row for each block, numbered from 1; empty sections are null."""
    rows = docs.select("doc_id", F.posexplode(blocks(F.col("data"))).alias("pos", "block"))
    part = lambda name: stripped(F.regexp_extract("block", _section(name), 1))
    base64 = stripped(F.regexp_replace(part("image_base64"), r"^<!--\s*|\s*-->$", ""))
    shown = {"text_data": part("image_ocr_content"), "vlm_data": part("image_vlm_description"), "base64_data": base64}
    return rows.select("doc_id", (F.col("pos") + 1).cast("long").alias("img_id"), *(F.nullif(c, F.lit("")).alias(n) for n, c in shown.items()))


def ocr_text(data: Column) -> Column:
    """All OCR sections of a document, a line end between them."""
    return F.array_join(F.transform(F.regexp_extract_all(data, F.lit(_section("image_ocr_content")), 1), stripped), "\n")
