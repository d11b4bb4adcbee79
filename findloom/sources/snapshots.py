"""Tables in versions: Parquet files, rows marked as deleted, and a log whose versions appear whole or not at all.

A change writes new files and, for rows that go, (file, row) pairs; nothing that is there is written again. What makes it
count is the next version of the log, a file that names all files of all tables, created in one step under a name
that nobody else can then take. Until that moment readers see the old version, and whatever a writer that died has left is
in no version; vacuum() removes it. A version covers all tables of a folder, so a document leaves all of them at once.

Two writers that start from one version both try to create the next: the later one looks at what the other did. If it
only adds rows, it puts them on top; if it deletes or replaces by key, in a table that the other changed, it fails with
Conflict, since it has decided by rows that are no longer the table's.

Tables may be laid out by shelf, a hash of a key: their files lie in folders by shelf, sorted by key, in ranges that split a
key very many rows share, and a join on shelf and key prunes the folders by the keys that come (lookup()). A clone names
the files of another folder's version and adds its own: changes to it cost what they change.

Defined cases: keys that are null match nothing; keys that repeat count once; deleting what is not there, and appending
nothing, makes a version without new rows; a table without files reads as empty. Columns of rows beyond the table's are left out.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from findloom.sources.shared import Files

#: Deleted rows of files up to this many are broadcast, 16 bytes and a file name each; beyond it they are joined by shuffle.
BROADCAST_ROWS = 1_000_000
#: A file with more than this share of its rows deleted is written anew by compact().
DEAD_SHARE = 0.3
MARKS = T.StructType([T.StructField("gone_file", T.StringType()), T.StructField("gone_row", T.LongType())])


def _place() -> Column:
    """A file's folder and name: tasks give files of one name to several shelves."""
    return F.substring_index(F.col("_metadata.file_path"), "/", -2)


def _short(path: str) -> str:
    return "/".join(path.split("/")[-2:])


class Conflict(Exception):
    """Another writer changed a table that this change decides by."""


@dataclass(frozen=True)
class Layout:
    """A table's schema, the key that shelves go by, and how many shelves there are (0: none)."""

    schema: T.StructType
    key: tuple[str, ...] = ()
    shelves: int = 0

    def shelf(self, first: Column) -> Column:
        return F.pmod(F.xxhash64(first), F.lit(self.shelves)).cast("int")

    @property
    def stored(self) -> T.StructType:
        return T.StructType([*self.schema.fields, T.StructField("shelf", T.IntegerType())]) if self.shelves else self.schema


@dataclass
class Tables:
    """The tables of a folder; state is a version's content: tables (name -> files), and meta."""

    spark: SparkSession
    folder: str
    layouts: dict[str, Layout]
    log: Files = field(init=False)

    def __post_init__(self):
        self.log = Files(self.spark, f"{self.folder}/log")

    def versions(self) -> list[int]:
        return [int(n.removesuffix(".json")) for n in self.log.names() if n.endswith(".json") and not n.startswith(".")]

    def version(self) -> int:
        return max(self.versions(), default=-1)

    def state(self, version: int | None = None) -> dict:
        version = self.version() if version is None else version
        empty = {"tables": {name: [] for name in self.layouts}, "meta": {}}
        return empty if version < 0 else empty | json.loads(self.log.read(f"{version:012d}.json"))

    def publish(self, version: int, state: dict) -> bool:
        return self.log.create(f"{version:012d}.json", json.dumps(state))

    def meta(self) -> dict:
        return self.state()["meta"]

    def read(self, name: str, version: int | None = None) -> DataFrame:
        """The rows of a table, with their shelf where it has shelves."""
        return self._rows(name, self.state(version)["tables"].get(name, [])).drop("__file", "__row")

    def _rows(self, name: str, files: list[dict], places: bool = False) -> DataFrame:
        layout = self.layouts[name]
        if not files:
            return self.spark.createDataFrame([], layout.stored)
        whole = [self._scan(layout, [f for f in files if not f["marks"]], places), self._scan(layout, [f for f in files if f["marks"]], places, marked=True)]
        return reduce(DataFrame.unionByName, [rows for rows in whole if rows is not None])

    def _scan(self, layout: Layout, files: list[dict], places: bool, marked: bool = False) -> DataFrame | None:
        parts = []
        for base in sorted({f["base"] for f in files}):
            # The folders between base and file give the shelf.
            rows = self.spark.read.schema(layout.stored).option("basePath", base).parquet(*(f["path"] for f in files if f["base"] == base))
            if marked or places:
                rows = rows.select(*layout.stored.names, _place().alias("__file"), F.col("_metadata.row_index").alias("__row"))
            parts.append(rows)
        if not parts:
            return None
        rows = reduce(DataFrame.unionByName, parts)
        if marked:
            gone = self.spark.read.schema(MARKS).parquet(*sorted({m for f in files for m in f["marks"]}))
            if sum(f["dead"] for f in files) <= BROADCAST_ROWS:
                gone = F.broadcast(gone)
            rows = rows.join(gone, (F.col("__file") == F.col("gone_file")) & (F.col("__row") == F.col("gone_row")), "left_anti")
        return rows if places else rows.select(*layout.stored.names)

    def lookup(self, name: str, keys: DataFrame) -> DataFrame:
        """Rows of a shelved table for a short list of keys(key columns, more): read in the keys' shelves only, and never shuffled.

        The caller vouches for the list's length (a search's hits); it is broadcast.
        """
        layout = self.layouts[name]
        return self.read(name).join(F.broadcast(keys.withColumn("shelf", layout.shelf(F.col(layout.key[0])))), ["shelf", *layout.key])

    def change(self) -> Change:
        return Change(self)

    def clone(self, folder: str) -> Tables:
        """The same rows under another folder, whose changes leave this one alone."""
        other = Tables(self.spark, folder, self.layouts)
        if not other.publish(0, self.state()):
            raise Conflict(f"{folder} has versions")
        return other

    def compact(self, name: str, share: float = DEAD_SHARE) -> int:
        """Write files anew of which more than `share` is deleted; gives the version."""
        change = self.change()
        old = [f for f in change.state["tables"][name] if f["dead"] > share * f["rows"]]
        if old:
            change.append(name, self._rows(name, old))
            change.drop(name, {f["path"] for f in old})
        return change.commit()

    def vacuum(self, keep: int = 1) -> list[str]:
        """Delete what the last `keep` versions do not name; gives the folders that went. Readers of older versions lose their files."""
        kept = sorted(self.versions())[-keep:]
        used = set()
        for v in kept:
            for files in self.state(v)["tables"].values():
                used |= {x for f in files for x in (f["load"], *f["marks"])}
        gone = []
        for kind in (*self.layouts, "marks"):
            own = Files(self.spark, f"{self.folder}/{kind}")
            for n in own.names():
                if f"{own.folder}/{n}" not in used:
                    own.delete(n)
                    gone.append(f"{kind}/{n}")
        for v in self.versions():
            if v not in kept:
                self.log.delete(f"{v:012d}.json")
        return gone


class Change:
    """Appends and deletes that become one version."""

    def __init__(self, tables: Tables):
        self.tables, self.base = tables, tables.version()
        self.state = tables.state(self.base)
        self.added: dict[str, list[dict]] = {}
        self.marked: dict[str, dict[str, tuple[str, int]]] = {}
        self.dropped: dict[str, set[str]] = {}
        self.meta: dict = {}

    def append(self, name: str, rows: DataFrame, laid: bool = False) -> Change:
        """rows as new files of a table; laid: tasks already hold few shelves each, so rows stay in theirs."""
        layout, spark = self.tables.layouts[name], self.tables.spark
        base = f"{self.tables.folder}/{name}"
        load = f"{base}/load={uuid.uuid4().hex}"
        rows = rows.select(*layout.schema.names)
        if layout.shelves:
            by = ["shelf", *layout.key]
            rows = rows.withColumn("shelf", layout.shelf(F.col(layout.key[0])))
            dealt = rows if laid else rows.repartitionByRange(*by)
            dealt.sortWithinPartitions(*by).write.partitionBy("shelf").parquet(load)
        else:
            rows.write.parquet(load)
        sizes = {p: n for p, n in Files(spark, load).sizes().items() if p.endswith(".parquet")}
        counts = {}
        if sizes:
            # A row a file; the footers hold the counts.
            # Grouped by the path as it is: a place made of it would be made for each row.
            found = spark.read.schema(layout.stored).option("basePath", base).parquet(load).groupBy(F.col("_metadata.file_path").alias("path")).count()
            counts = {_short(r["path"]): r["count"] for r in found.collect()}
        qualified = Files(spark, load).fs.makeQualified(Files(spark, load).folder).toString()
        own_base = qualified.rsplit("/", 1)[0]
        self.added.setdefault(name, []).extend(
            {"path": p, "base": own_base, "load": qualified, "rows": counts[_short(p)], "bytes": n, "marks": [], "dead": 0} for p, n in sorted(sizes.items()) if counts.get(_short(p))
        )
        return self

    def adopt(self, name: str, other: Tables) -> Change:
        """The rows of another folder's table, where they lie; that folder must then keep its files."""
        self.added.setdefault(name, []).extend(other.state()["tables"][name])
        return self

    def delete(self, name: str, gone: DataFrame, on: dict[str, str] | list[str]) -> Change:
        """The rows whose columns equal those of a row of `gone`; on: table's column -> column of gone, or names they share."""
        on = on if isinstance(on, dict) else {c: c for c in on}
        layout, tables = self.tables.layouts[name], self.tables
        files = self.state["tables"].get(name, [])
        keys = gone.select(*(F.col(theirs).alias(f"__key_{own}") for own, theirs in on.items())).distinct()
        rows = tables._rows(name, files, places=True)
        match = [F.col(own) == F.col(f"__key_{own}") for own in on]
        if layout.shelves and layout.key[0] in on:
            keys = keys.withColumn("__shelf", layout.shelf(F.col(f"__key_{layout.key[0]}")))
            match.append(F.col("shelf") == F.col("__shelf"))
        if files:
            found = rows.select(*on, *(["shelf"] if layout.shelves else []), "__file", "__row").join(keys, match, "left_semi")
            self._mark(name, found.select(F.col("__file").alias("gone_file"), F.col("__row").alias("gone_row")))
        self.marked.setdefault(name, {})
        return self

    def _mark(self, name: str, places: DataFrame) -> None:
        at = f"{self.tables.folder}/marks/{uuid.uuid4().hex}"
        places.sortWithinPartitions("gone_file", "gone_row").write.parquet(at)
        spark = self.tables.spark
        counts = spark.read.schema(MARKS).parquet(at).groupBy("gone_file").count().collect()  # a row a file
        qualified = Files(spark, at).fs.makeQualified(Files(spark, at).folder).toString()
        for r in counts:
            self.marked.setdefault(name, {})[r["gone_file"]] = (qualified, r["count"])

    def replace(self, name: str, new: DataFrame, by: list[str]) -> Change:
        """All rows that share `by` with a row of `new` give way to new."""
        return self.delete(name, new, by).append(name, new)

    def update(self, name: str, new: DataFrame, key: list[str], columns: list[str]) -> Change:
        """Other values of `columns` for the rows that share `key` with a row of new; rows of new that match none are left out."""
        current = self.tables._rows(name, self.state["tables"].get(name, []))
        values = new.select(*key, *(F.col(c).alias(f"__new_{c}") for c in columns))
        on, layout = list(key), self.tables.layouts[name]
        if layout.shelves and layout.key[0] in key:
            values, on = values.withColumn("shelf", layout.shelf(F.col(layout.key[0]))), ["shelf", *key]
        changed = current.join(values, on).select(*(F.col(f"__new_{c}").alias(c) if c in columns else F.col(c) for c in layout.schema.names))
        return self.delete(name, new, key).append(name, changed)

    def drop(self, name: str, paths: set[str]) -> Change:
        """Whole files leave a table."""
        self.dropped.setdefault(name, set()).update(paths)
        return self

    def note(self, **meta) -> Change:
        """Values that become part of the version's meta."""
        self.meta |= meta
        return self

    def _over(self, state: dict) -> dict:
        tables = {}
        for name in self.tables.layouts:
            files = []
            for f in state["tables"].get(name, []):
                if f["path"] in self.dropped.get(name, ()):
                    continue
                at = self.marked.get(name, {}).get(_short(f["path"]))
                f = f | {"marks": [*f["marks"], at[0]], "dead": f["dead"] + at[1]} if at else f
                if f["dead"] < f["rows"]:
                    files.append(f)
            tables[name] = files + self.added.get(name, [])
        return {"tables": tables, "meta": state["meta"] | self.meta}

    def commit(self) -> int:
        """Publish the change; gives its version."""
        state, version = self.state, self.base
        while not self.tables.publish(version + 1, self._over(state)):
            version += 1
            later = self.tables.state(version)
            for name in {*self.marked, *self.dropped}:
                if later["tables"].get(name) != self.state["tables"].get(name):
                    raise Conflict(f"{name} was changed by version {version}")
            if any(later["meta"].get(k) != self.state["meta"].get(k) for k in self.meta):
                raise Conflict(f"version {version} changed {', '.join(self.meta)}")
            state = later
        return version + 1
