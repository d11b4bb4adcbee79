"""XML documents as a table of nodes, and records of them by windows and groups.

A document becomes a row for each element: its number in document order, the last number below it, its level, its parent and
its ancestors, the numbers of the main elements that it lies in (itself included), tag, own text and attributes. What a record
is made of (main elements, tags before and after them, tags anywhere below their parent) is then a matter of windows over the
children of a parent: a tag before a main element belongs to the next one of the same parent, a run of main elements ends at
a tag that leads the next run. Python only parses and numbers.

The rows of a document are dealt to one task once, in tasks whose number follows the size of the table of nodes, and all windows
and groups are within documents, so texts move once. What is told of a parent (tags anywhere below it) is brought down to a value
a key and joins the children of that parent as one more row. Nothing is joined, so nothing that grows is broadcast.

A record's keys stand in the order in which they first come up: id, tags anywhere, fixed fields, tags before, the main
element, tags after. Of a key that comes up in several of these the last value counts; tags before and after that repeat
are joined by line ends.

Defined cases: a text that is null or no XML, and a document without main elements, has no records; an element's text is
what stands before its first child, stripped, and counts if there is any; of nested main elements each is a record of its own;
rows that repeat a doc_id are documents of their own.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce
from xml.parsers import expat

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from findloom.model import FIXED_DELIMITER
from findloom.sources.shared import tasks_for, written

NODE = "row long, start int, `end` int, level int, parent int, ancestors array<int>, mains array<int>, tag string, text string, attributes array<struct<name:string,value:string>>"
#: A batch of nodes holds about so many, or texts of about so many letters, of one document or several.
ROWS, LETTERS = 10_000, 4 << 20
#: Bytes of the stored table of nodes whose rows a task gets.
TASK_BYTES = 8 << 20
#: Parts of a record, in the order of its keys.
ID, ANYWHERE, FIXED, BEFORE, MAIN, AFTER, LAST = range(7)


def _names(tags: str) -> list[str]:
    return [t.strip() for t in (tags or "").split(",") if t.strip()]


def _pairs(text: str) -> dict[str, str]:
    return {k.strip(): v.strip() for k, v in (p.split("=", 1) for p in (text or "").split(",") if "=" in p)}


@dataclass(frozen=True)
class XmlRules:
    """Which tags of a document make up a record; lists are parted by commas, pairs are k=v. Without `main`, the root's children are main."""

    main: str = ""
    prefix: str = ""
    suffix: str = ""
    everywhere: str = ""
    fixed: str = ""
    renamed: str = ""
    merge: bool = False


def parsed(text: str, main: str = "") -> list[tuple]:
    """(start, end, level, parent, ancestors, mains, tag, text, attributes) of each element, in document order; ExpatError if the text is no XML."""
    out: list[list] = []
    path: list[int] = []
    within: list[list[int]] = [[]]
    number = 0
    parser = expat.ParserCreate("utf-8", "}")
    parser.buffer_text = True
    named = lambda name: f"{{{name}" if "}" in name else name

    def start(name, attributes):
        nonlocal number
        level, tag, mains = len(path), named(name), within[-1]
        if path:
            out[path[-1]][9] = False
        if level and (tag == main if main else level == 1):
            number += 1
            mains = [*mains, number]
        out.append([len(out), 0, level, path[-1] if path else -1, list(path), mains, tag, "", [(named(k), v) for k, v in attributes.items()], True])
        path.append(len(out) - 1)
        within.append(mains)

    def end(_):
        within.pop()
        out[path.pop()][1] = len(out) - 1

    def data(piece):
        if path and out[path[-1]][9]:
            out[path[-1]][7] += piece

    parser.StartElementHandler, parser.EndElementHandler, parser.CharacterDataHandler = start, end, data
    parser.Parse(text.encode("utf-8"), True)
    return [(*n[:7], n[7].strip(), n[8]) for n in out]


def nodes_of(docs: DataFrame, main: str = "") -> DataFrame:
    """docs(doc_id, text) -> a row for each element, as NODE says, with the doc_id; row numbers the documents. Without `main`, the root's children are main."""
    kind = docs.schema["doc_id"].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair = pa.struct([("name", pa.string()), ("value", pa.string())])
        numbers = pa.list_(pa.int32())
        kinds = [to_arrow_type(kind), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), numbers, numbers, pa.string(), pa.string(), pa.list_(pair)]
        names = ["doc_id", "row", "start", "end", "level", "parent", "ancestors", "mains", "tag", "text", "attributes"]
        held, letters = [], 0

        def batch() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held), kinds)], names)

        for part in batches:
            for doc_id, row, text in zip(*(c.to_pylist() for c in part.columns)):
                try:
                    nodes = parsed(text or "", main)
                except expat.ExpatError:
                    continue
                for *first, attributes in nodes:
                    held.append((doc_id, row, *first, [{"name": k, "value": v} for k, v in attributes]))
                    letters += len(first[-1])
                    if len(held) >= ROWS or letters >= LETTERS:
                        yield batch()
                        held, letters = [], 0
        if held:
            yield batch()

    return docs.select("doc_id", F.monotonically_increasing_id().alias("row"), "text").mapInArrow(run, f"doc_id {kind.simpleString()}, {NODE}")


#: What a record is told: own and i order the entries of a part.
ENTRY = "struct<part:int,own:bigint,i:int,key:string,value:string>"


def _entry(part: Column | int, own: Column | int, i: Column | int, key: Column | str, value: Column) -> Column:
    lit = lambda x: x if isinstance(x, Column) else F.lit(x)
    return F.struct(lit(part).cast("int").alias("part"), lit(own).cast("long").alias("own"), lit(i).cast("int").alias("i"), lit(key).alias("key"), value.cast("string").alias("value"))


def _entries(part: Column | int, own: Column | int, text_first: bool) -> Column:
    """Array of ENTRY of an element: its text under its tag, its attributes under tag@name."""
    text = F.when(F.col("text") != "", F.array(F.struct(F.col("tag").alias("key"), F.col("text").alias("value")))).otherwise(F.array().cast("array<struct<key:string,value:string>>"))
    attributes = F.transform("attributes", lambda a: F.struct(F.concat("tag", F.lit("@"), a["name"]).alias("key"), a["value"].alias("value")))
    both = F.concat(text, attributes) if text_first else F.concat(attributes, text)
    return F.transform(both, lambda e, i: _entry(part, own, i, e["key"], e["value"]))


def _none() -> Column:
    return F.array().cast(f"array<{ENTRY}>")


def _json(text: Column) -> Column:
    # The brackets of the array go; next to them stand quotes.
    return F.btrim(F.to_json(F.array(text)), F.lit("[]"))


class _Records:
    """Windows over the children of a parent say which element is what in which record; all is within documents."""

    def __init__(self, nodes: DataFrame, rules: XmlRules):
        self.rules, self.nodes = rules, nodes
        self.prefix, self.suffix, self.everywhere = _names(rules.prefix), _names(rules.suffix), _names(rules.everywhere)
        self.fixed, self.renamed = _pairs(rules.fixed), _pairs(rules.renamed)
        own = nodes.withColumn("told", F.lit(None).cast(f"array<{ENTRY}>"))
        rows = own.unionByName(self._anywhere(), allowMissingColumns=True) if self.everywhere else own
        # Dealt by document once: all that follows is within documents.
        rows = rows.repartition(tasks_for(nodes, TASK_BYTES), "row")
        main = rules.main.strip()
        is_main = (F.col("tag") == main) & (F.col("level") > 0) if main else F.col("level") == 1
        beside = Window.partitionBy("row", "parent")
        rows = rows.withColumn("number", F.when(is_main, F.element_at("mains", -1)))
        self.rows = rows.withColumns({"rank": F.min("number").over(beside), "told": F.first("told", ignorenulls=True).over(beside)}).where("start is not null")

    def _anywhere(self) -> DataFrame:
        """Tags below an ancestor: of each key the last value, as one row among the children of that ancestor."""
        place = F.array_position(F.array(*map(F.lit, self.everywhere)), F.col("tag"))
        below = self.nodes.where(F.col("tag").isin(self.everywhere))
        own = place * F.lit(1 << 40) + F.col("start")
        said = below.select("row", "doc_id", "ancestors", F.explode(_entries(ANYWHERE, own, text_first=True)).alias("e")).select("row", "doc_id", F.explode("ancestors").alias("parent"), "e")
        order = F.struct("e.own", "e.i")
        last = said.groupBy("row", "doc_id", "parent", "e.key").agg(F.min(order).alias("order"), F.max_by("e.value", order).alias("value"))
        told = F.collect_list(_entry(ANYWHERE, F.col("order.own"), F.col("order.i"), F.col("key"), F.col("value")))
        return last.groupBy("row", "doc_id", "parent").agg(told.alias("told"))

    def _of_record(self, *first: Column) -> Column:
        """What is told of a record besides its elements, for one row of each record."""
        fixed = [_entry(part, k, 0, key, F.lit(value)) for part in (FIXED, *(() if self.rules.merge else (LAST,))) for k, (key, value) in enumerate(self.fixed.items())]
        return F.concat(F.array(*first, *fixed) if first or fixed else _none(), F.coalesce("told", _none()))

    def single(self) -> DataFrame:
        """A record for each main element."""
        beside = Window.partitionBy("row", "parent").orderBy("start")
        number = F.col("number")
        seen = self.rows.withColumns({
            "next": F.first(number, ignorenulls=True).over(beside.rowsBetween(1, Window.unboundedFollowing)),
            "previous": F.last(number, ignorenulls=True).over(beside.rowsBetween(Window.unboundedPreceding, -1)),
        })
        other = F.col("number").isNull() & F.col("next").isNotNull()
        of = lambda record, rank, entries: F.struct(record.cast("int").alias("record"), rank.alias("rank"), entries.alias("entries"))
        no_rank, nothing = F.lit(None).cast("int"), F.array().cast(f"array<struct<record:int,rank:int,entries:array<{ENTRY}>>>")
        places = F.concat(
            F.when(other & F.col("tag").isin(self.prefix), F.array(of(F.col("next"), no_rank, _entries(BEFORE, F.col("start"), True)))).otherwise(nothing),
            F.when(other & F.col("tag").isin(self.suffix) & F.col("previous").isNotNull(), F.array(of(F.col("previous"), no_rank, _entries(AFTER, F.col("start"), True)))).otherwise(nothing),
            F.transform("mains", lambda m: of(m, no_rank, _entries(MAIN, F.col("start"), False))),
            F.when(number.isNotNull(), F.array(of(number, F.col("rank"), self._of_record(_entry(ID, 0, 0, "id", number))))).otherwise(nothing),
        )
        every = seen.select("row", "doc_id", F.explode(places).alias("p")).select("row", "doc_id", "p.record", "p.rank", F.explode("p.entries").alias("e"))
        return self._lines(every)

    def merged(self) -> DataFrame:
        """A record for each run of main elements."""
        beside = Window.partitionBy("row", "parent").orderBy("start")
        kind = F.when(F.col("number").isNotNull(), MAIN).when(F.col("tag").isin(self.prefix), BEFORE).when(F.col("tag").isin(self.suffix), AFTER)
        events = self.rows.where("rank is not null and text <> ''").withColumn("part", kind).where("part is not null")
        earlier = F.last(F.when(F.col("part") != AFTER, F.col("part")), ignorenulls=True).over(beside.rowsBetween(Window.unboundedPreceding, -1))
        ends = ((F.col("part") == BEFORE) & F.coalesce(earlier == MAIN, F.lit(False))).cast("int")
        runs = events.withColumn("ends", ends).withColumn("run", F.sum("ends").over(beside))
        of_run = Window.partitionBy("row", "parent", "run")
        runs = runs.withColumn("mains_here", F.count(F.when(F.col("part") == MAIN, 1)).over(of_run)).withColumn("place", F.row_number().over(of_run.orderBy("start")))
        # A parent has a rank of its own.
        held = runs.where("mains_here > 0").withColumn("record", F.dense_rank().over(Window.partitionBy("row").orderBy("rank", "run")))
        own = F.array(_entry(MAIN, F.col("start"), 0, self.rules.main.strip() or "text", F.col("text")))
        said = F.when(F.col("part") == MAIN, own).otherwise(_entries(F.col("part"), F.col("start"), True))
        entries = F.concat(said, F.when(F.col("place") == 1, self._of_record()).otherwise(_none()))
        return self._lines(held.select("row", "doc_id", "record", F.lit(0).alias("rank"), F.explode(entries).alias("e")), numbered=True)

    def _lines(self, every: DataFrame, numbered: bool = False) -> DataFrame:
        """every(row, doc_id, record, rank, e) -> doc_id, pos, line: entries folded to a value a key, keys in order of first appearance."""
        joined = [BEFORE, AFTER, *([MAIN] if numbered else [])]
        key = F.col("e.key")
        if self.renamed:
            every = every.withColumn("was", key)
            key = reduce(lambda c, kv: F.when(F.col("e.key") == kv[0], kv[1]).otherwise(c), self.renamed.items(), key)
        of_key = ["row", "doc_id", "record", "was" if self.renamed else "key"]
        entry = F.struct("e.part", "e.own", "e.i", "e.value")
        keys = every.withColumn("key", key).groupBy(*dict.fromkeys([*of_key, "key"])).agg(F.sort_array(F.collect_list(entry)).alias("l"), F.max("rank").alias("rank"))
        # Of the last part that a key comes up in, all values or the last.
        last = F.element_at("l", -1)
        values = F.transform(F.filter("l", lambda e: e["part"] == last["part"]), lambda e: e["value"])
        at = F.struct(*(F.col("l")[0][c].alias(c) for c in ("part", "own", "i")))
        keys = keys.select("row", "doc_id", "record", "rank", "key", at.alias("at"), F.when(last["part"].isin(joined), F.array_join(values, "\n")).otherwise(last["value"]).alias("value"))
        if self.renamed:
            # Of names that became one, the one that comes up last; it stands where the first does.
            keys = keys.groupBy("row", "doc_id", "record", "key").agg(F.min("at").alias("first"), F.max_by("value", "at").alias("value"), F.max("rank").alias("rank")).withColumnRenamed("first", "at")
        pairs = F.transform(F.array_sort(F.collect_list(F.struct("at", "key", "value"))), lambda e: F.concat(_json(e["key"]), F.lit(": "), _json(e["value"])))
        whole = keys.groupBy("row", "doc_id", "record").agg(pairs.alias("pairs"), F.max("rank").alias("rank"))
        shown = F.concat(F.array(F.concat(F.lit('"id": '), _json(F.col("record").cast("string")))), "pairs") if numbered else F.col("pairs")
        line = whole.select("row", "doc_id", "record", "rank", F.concat(F.lit("{"), F.array_join(shown, ", "), F.lit(f"}} {FIXED_DELIMITER}")).alias("line"))
        pos = F.row_number().over(Window.partitionBy("row").orderBy("rank", "record")) - 1
        return line.select("doc_id", pos.alias("pos"), "line")


def xml_records(docs: DataFrame, rules: XmlRules) -> DataFrame:
    """docs(doc_id, text) -> doc_id, pos, line: a delimited JSON line for each record of each document."""
    nodes = written(nodes_of(docs, rules.main.strip()), "xml-nodes")
    records = _Records(nodes, rules)
    return records.merged() if rules.merge else records.single()
