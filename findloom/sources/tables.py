"""Catalog tables and sinks: a collection's tables, replacement of their files, JSON lines, and sheets of an export."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from findloom.functions.text import jsonl_line
from findloom.model import COLLECTION, EMBEDDING, FIXED_DELIMITER, IMAGE, IMAGE_EMBEDDING, QA_FEEDBACK, QA_RESULT

#: Suffix -> schema of the tables of a collection; the evaluation tables are shared by all of them.
TABLES = {"collection": COLLECTION, "embedding": EMBEDDING, "image": IMAGE, "image_embedding": IMAGE_EMBEDDING}
SHARED = {"rag_qa_result": QA_RESULT, "rag_qa_feedback": QA_FEEDBACK}


def _names(collection: str) -> dict:
    if not collection.isidentifier():
        raise ValueError(f"{collection!r} is no name for a collection")
    return {f"{collection}_{suffix}": schema for suffix, schema in TABLES.items()} | SHARED


def create(spark: SparkSession, collection: str) -> list[str]:
    """Make the tables of a collection that do not exist yet; gives the names of those made."""
    made = [name for name in _names(collection) if not spark.catalog.tableExists(name)]
    for name in made:
        spark.createDataFrame([], _names(collection)[name]).write.format("parquet").saveAsTable(name)
    return made


def drop(spark: SparkSession, collection: str) -> None:
    """Drop the tables of a collection; the evaluation tables stay."""
    for suffix in TABLES:
        spark.sql(f"DROP TABLE IF EXISTS {collection}_{suffix}")


def append(rows: DataFrame, name: str) -> None:
    rows.select(*rows.sparkSession.table(name).columns).write.mode("append").format("parquet").saveAsTable(name)


def replace(rows: DataFrame, name: str) -> None:
    """New rows for a table that they may have been read from: written beside it, then renamed; the old one comes back if that fails.

    A catalog cannot take both names in one step: for tables that must never be missing see findloom.sources.snapshots.
    """
    spark = rows.sparkSession
    aside, old = f"{name}_new_{uuid.uuid4().hex}", f"{name}_old_{uuid.uuid4().hex}"
    rows.select(*spark.table(name).columns).write.format("parquet").saveAsTable(aside)
    spark.sql(f"ALTER TABLE {name} RENAME TO {old}")
    try:
        spark.sql(f"ALTER TABLE {aside} RENAME TO {name}")
    except Exception:
        spark.sql(f"ALTER TABLE {old} RENAME TO {name}")
        raise
    spark.sql(f"DROP TABLE {old}")


def write_json_lines(rows: DataFrame, json: str, path: str, delimiter: str = FIXED_DELIMITER) -> None:
    """The JSON column of rows, a delimited line each."""
    rows.select(jsonl_line(rows[json], delimiter).alias("value")).write.text(path)


def write_sheets(sheets: dict[str, DataFrame], path: str, kind: str = "csv") -> None:
    """A folder with a table for each sheet, with a header where the kind has one."""
    for name, rows in sheets.items():
        rows.write.option("header", True).format(kind).save(f"{path}/{name}")


def plan_text(rows: DataFrame) -> str:
    """What will run, for a caller that shows it: the plans of a DataFrame as text."""
    return rows._jdf.queryExecution().toString()
