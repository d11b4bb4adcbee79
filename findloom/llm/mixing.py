"""Mixing sources to target weights by a time-varying curriculum (native).

Each source gets a target number of words (its weight's share of all words, at most `max_repeats` times its
own, the excess reshared by weight). Within a source, documents lie one after another in a hashed order, so
each owns an interval of the source's token line; the mix reads that line, over and over, until the target is
met. The source's weight schedule over training time is integrated to a cumulative demand, and the inverse of
that demand turns a place on the line into a training position in [0, 1). Documents are range-sorted by it.

Running sums never put a source into one task: the line is cut into hash ranges, ranges are summed first, and
the window runs inside (source, range) only; sums of ranges are laid out in spans in the same way.

Defined cases: a null or blank text has size 0 and is taken 0 times; null is a source of its own, after all
others; rows that repeat a doc_id are laid side by side, equal rows are interchangeable; an empty table gives no rows.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from findloom.llm.common import free_name, written

SPACES, OTHERS = r"[\x20\x09-\x0D]", r"[^\x20\x09-\x0D]"
#: Weights of the sources in code point order, repeating.
WEIGHTS = (5.0, 2.0, 1.0)
#: For each weight, knots (time, relative weight); between knots the weight changes linearly.
SCHEDULES = (((0.0, 1.0), (1.0, 1.0)), ((0.0, 1.5), (0.5, 1.0), (1.0, 0.5)), ((0.0, 0.5), (0.5, 1.0), (1.0, 1.5)))
MAX_REPEATS = 3
ROWS_PER_RANGE, RANGES_PER_SPAN = 256, 1024


def word_count(text: Column) -> Column:
    """Number of runs of other than ASCII white space; each becomes one letter, so that no array of words is built."""
    return F.length(F.translate(F.regexp_replace(text, f"{SPACES}*{OTHERS}+", "w"), " \t\n\x0b\x0c\r", "")).cast("long")


def segments(knots) -> list[tuple[float, float, float, float, float]]:
    """(demand before, demand after, time, weight, slope) of each linear piece, demand scaled to end at 1."""
    area = sum((t1 - t0) * (w0 + w1) / 2 for (t0, w0), (t1, w1) in zip(knots, knots[1:]))
    out, before = [], 0.0
    for (t0, w0), (t1, w1) in zip(knots, knots[1:]):
        after = before + (t1 - t0) * (w0 + w1) / 2 / area
        out.append((before, after, t0, w0 / area, (w1 - w0) / (t1 - t0) / area))
        before = after
    return out


def inverted_demand(u: Column, knots) -> Column:
    """The time at which the share u of a source's demand has been met."""
    position = F.lit(1.0)
    for before, after, t0, w0, slope in reversed(segments(knots)):
        gone = u - F.lit(before)
        x = 2 * gone / (F.lit(w0) + F.sqrt(F.lit(w0 * w0) + F.lit(2 * slope) * gone))
        position = F.when(u < F.lit(after), F.lit(t0) + x).otherwise(position)
    return position


def source_targets(sizes: DataFrame, weights=WEIGHTS, max_repeats: int = MAX_REPEATS) -> DataFrame:
    """sizes(no_source, src, size) -> a row a source: source_size, class (its place in weights), target."""
    sums = sizes.groupBy("no_source", "src").agg(F.sum("size").alias("source_size"))
    k = (F.row_number().over(Window.orderBy("no_source", "src")) - 1) % len(weights)
    sums = sums.withColumn("class", k).withColumn("w", F.element_at(F.array(*map(F.lit, weights)), F.col("class") + 1))
    cap = max_repeats * F.col("source_size")
    line = Window.orderBy(cap / F.col("w"), "no_source", "src").rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    level = (F.sum("source_size").over(everything) - F.coalesce(F.sum(cap).over(line), F.lit(0))).cast("double") / (
        F.sum("w").over(everything) - F.coalesce(F.sum("w").over(line), F.lit(0.0))
    )
    filled = sums.withColumn("level", level).withColumn("open", F.col("level") <= cap / F.col("w"))
    # Sources below the water line are at their cap; the first one that is not sets the level for all the rest.
    chosen = filled.withColumn("level", F.max(F.when(F.col("open"), F.col("level"))).over(everything))
    target = F.least(cap.cast("double"), F.coalesce(F.col("level") * F.col("w"), cap.cast("double")))
    return chosen.select("no_source", "src", "source_size", "class", target.alias("target"))


def _starts(sums: DataFrame) -> DataFrame:
    """sums(no_source, src, span, range, held) -> no_source, src, range, start: what lies before each range of a source.

    Spans of ranges are summed on their own, so the longest window is a source's spans: one for each 262144 documents.
    """
    before = lambda keys, by, held: F.coalesce(F.sum(held).over(Window.partitionBy(*keys).orderBy(by).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    source = ["no_source", "src"]
    spans = sums.groupBy(*source, "span").agg(F.sum("held").alias("all"))
    spans = spans.select(*source, "span", before(source, "span", "all").alias("outer"))
    ranges = sums.select(*source, "span", "range", before([*source, "span"], "range", "held").alias("inner"))
    return ranges.join(spans, [*source, "span"]).select(*source, "range", (F.col("outer") + F.col("inner")).alias("start"))


def mix(docs: DataFrame, weights=WEIGHTS, schedules=SCHEDULES, max_repeats: int = MAX_REPEATS) -> DataFrame:
    """docs(doc_id, text, source) -> doc_id, text_key, source, size, source_size, target, taken, offset, class, position (of the first use)."""
    sizes = docs.select(
        "doc_id",
        F.col("source").isNull().alias("no_source"),
        F.coalesce("source", F.lit("")).alias("src"),
        F.coalesce(word_count(F.col("text")), F.lit(0).cast("long")).alias("size"),
        F.xxhash64("text").alias("text_key"),
        # Rows without a doc_id are spread by their texts.
        F.md5(F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("text "), F.coalesce("text", F.lit(""))))).alias("key"),
    )
    sizes = written(sizes, "sizes")
    ranges = max(1, math.ceil(sizes.count() / ROWS_PER_RANGE))
    cut = sizes.withColumn("range", F.floor(F.conv(F.substring("key", 1, 8), 16, 10).cast("long") * ranges / F.lit(1 << 32)).cast("long"))
    inside = Window.partitionBy("no_source", "src", "range").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    laid = cut.withColumn("inner", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    sums = cut.groupBy("no_source", "src", "range").agg(F.sum("size").alias("held"))
    starts = _starts(sums.withColumn("span", F.floor(F.col("range") / RANGES_PER_SPAN)))
    placed = starts.join(source_targets(sizes, weights, max_repeats), ["no_source", "src"])
    laid = laid.join(placed, ["no_source", "src", "range"]).withColumn("offset", F.col("start") + F.col("inner"))
    whole = F.floor("target")
    passes = F.floor(whole / F.greatest(F.col("source_size"), F.lit(1)))
    rest = whole - passes * F.col("source_size")
    taken = passes * F.col("size") + F.greatest(F.lit(0), F.least(F.col("size"), rest - F.col("offset")))
    laid = laid.withColumn("taken", F.when(F.col("size") > 0, taken).otherwise(0).cast("long"))
    share = F.col("offset") / F.col("target")
    position = F.lit(None).cast("double")
    for k, knots in enumerate(schedules):
        position = F.when(F.col("class") == k, inverted_demand(share, knots)).otherwise(position)
    return laid.select(
        "doc_id",
        "text_key",
        F.when(~F.col("no_source"), F.col("src")).alias("source"),
        "size",
        "source_size",
        "target",
        "taken",
        "offset",
        "class",
        F.when(F.col("taken") > 0, position).alias("position"),
    )


def _uses(mixed: DataFrame, schedules) -> DataFrame:
    """A row for each use of a document (at most max_repeats)."""
    uses = mixed.where("taken > 0").withColumn("use", F.explode(F.sequence(F.lit(0), F.ceil(F.col("taken") / F.col("size")).cast("int") - 1)))
    share = (F.col("offset") + F.col("use") * F.col("source_size")) / F.col("target")
    position = F.lit(None).cast("double")
    for k, knots in enumerate(schedules):
        position = F.when(F.col("class") == k, inverted_demand(share, knots)).otherwise(position)
    words = F.least(F.col("size"), F.col("taken") - F.col("use") * F.col("size"))
    return uses.select("doc_id", "text_key", "source", "use", words.alias("words"), position.alias("position"))


def in_order(mixed: DataFrame) -> DataFrame:
    """The mix's documents range-sorted by the training position of their first use, those that it takes no words of at the end."""
    by = [F.col("position").asc_nulls_last(), F.col("doc_id").asc_nulls_last()]
    return mixed.repartitionByRange(*by).sortWithinPartitions(*by)


def training_order(mixed: DataFrame, schedules=SCHEDULES) -> DataFrame:
    """A row for each use of a document, range-sorted by training position."""
    return _uses(mixed, schedules).repartitionByRange("position", "doc_id").sortWithinPartitions("position", "doc_id")


def training_rows(docs: DataFrame, weights=WEIGHTS, schedules=SCHEDULES, max_repeats: int = MAX_REPEATS) -> DataFrame:
    """Each use of a document with all its columns, `use`, `words` (from the text's start) and `position`, range-sorted by position.

    Rows that repeat a doc_id and a text are one document here. Columns of docs that have one of those three names give way.
    """
    mixed = written(mix(docs, weights, schedules, max_repeats), "mixed")
    uses = _uses(mixed, schedules)
    given = ("use", "words", "position")
    mine, key, own_id, *named = (free_name(f"own_{n}", docs.columns) for n in ("hash", "key", "id", *given))
    whole = docs.withColumn(mine, F.xxhash64("text"))
    if not mixed.groupBy("doc_id", "text_key").count().where(F.col("count") > 1).isEmpty():
        uses, whole = uses.dropDuplicates(["doc_id", "text_key", "use"]), whole.dropDuplicates(["doc_id", mine])
    uses = uses.select(F.col("doc_id").alias(own_id), F.col("text_key").alias(key), *(F.col(c).alias(n) for c, n in zip(given, named)))
    own = [c for c in docs.columns if c.lower() not in given]
    rows = whole.join(uses, F.col("doc_id").eqNullSafe(F.col(own_id)) & (F.col(mine) == F.col(key)))
    rows = rows.select(*own, *(F.col(n).alias(c) for c, n in zip(given, named)))
    return rows.repartitionByRange("position", "doc_id").sortWithinPartitions("position", "doc_id")
