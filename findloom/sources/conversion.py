"""JSON arrays as delimited JSON lines; XML documents see findloom.sources.xml_nodes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from findloom.model import FIXED_DELIMITER


def spaced(json: Column) -> Column:
    """Compact JSON with a space after each colon and comma that is not inside a string."""
    return F.regexp_replace(json, r'\G((?:[^":,]++|"(?:[^"\\]++|\\.)*+")*+)([:,])', "$1$2 ")


def json_array_lines(docs: DataFrame) -> DataFrame:
    """docs(doc_id, text) -> (doc_id, pos, line), a line for each item of a JSON array; other JSON, and what is none, gives no rows.

    Items keep the order of their keys; numbers are written as the JVM writes them.
    """
    value = F.try_parse_json("text")
    parsed = docs.select("doc_id", "text", F.when(F.schema_of_variant(value).startswith("ARRAY"), F.try_variant_get(value, "$", "array<variant>")).alias("kinds"))
    items = parsed.where("kinds is not null").select("doc_id", "kinds", F.from_json("text", "array<string>").alias("items"))
    # Of a string, from_json gives what is in it; of all else, its JSON.
    quoted = lambda s: F.regexp_extract(F.to_json(F.array(s)), r"(?s)^\[(.*)\]$", 1)
    shown = lambda s, kind: F.when(F.schema_of_variant(kind) == "STRING", quoted(s)).otherwise(spaced(F.coalesce(s, F.lit("null"))))
    rows = items.select("doc_id", F.posexplode(F.zip_with("items", "kinds", shown)).alias("pos", "item"))
    return rows.select("doc_id", "pos", F.concat("item", F.lit(f" {FIXED_DELIMITER}")).alias("line"))
