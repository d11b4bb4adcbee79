"""License scans by an exact set-similarity join (native).

A text is read in blocks of consecutive words, whatever its lines: for each span of SPANS, blocks of twice the span
that start every span words, so that any run of at most a span of words lies wholly in one block. A notice wrapped over
many lines is thus met like one on a single line. Blocks and templates (known license notices) are sets of words; a
template is looked for in the blocks of the least span that holds it. A block meets a template when it holds at least
the threshold share of the template's words. Template words are ordered by how many documents of the whole corpus hold
them, rarest first; with an overlap of t wanted out of |T| words,

  prefix filter    a block must hold one of the template's |T|-t+1 rarest words: the join is on those only;
  length filter    a block must hold at least t words that occur in any template;
  positional filter  with the first common word at i in the template and j in the block, at most
                   1 + min(|T|-1-i, |B|-1-j) words can be common, which must reach t;

and what is left is verified exactly: the share, and the key words of the notice (KEYS), since rival notices differ in a word
or two, which a share allows for. All three filters are lossless, and so is cutting no blocks from a document that
holds too few of every template's words. The prefixes (a row for each prefix word of each template, so bounded by the
templates) are broadcast: no word of the corpus is shuffled. Besides, fixed phrases are located by word.

Defined cases: a null or empty text has no words, no places and score 0; equal rows each get a row; a text of
any length is read whole; an empty table gives no rows.
"""

from __future__ import annotations

import math
import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from findloom.llm.common import ascii_lower, written

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Phrases of the op3 contract and their labels.
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
#: Openings of public license notices.
TEMPLATES = {
    "apache-2.0": "Licensed under the Apache License, Version 2.0",
    "bsd": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "cc-by-nc": "Licensed under CC BY-NC 4.0",
    "cc-by-sa": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License",
    "cc0": "To the extent possible under law the author has waived all copyright and related or neighboring rights to this work",
    "cc-by-4.0": "Licensed under CC BY 4.0",
    "gpl-2.0": "This work is licensed under the GNU General Public License, version 2",
    "gpl-3.0": "This work is licensed under the GNU General Public License, version 3",
    "isc": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted",
    "mit": "Released under the MIT License",
    "mit-text": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
    "mpl-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0",
}
#: What tells a notice from its rivals: these words must stand in the block, and one after another somewhere in the text.
KEYS = {
    "apache-2.0": "apache license",
    "cc-by-4.0": "by 4 0",
    "cc-by-nc": "by nc",
    "cc-by-sa": "attribution sharealike",
    "gpl-2.0": "version 2",
    "gpl-3.0": "version 3",
    "mit": "mit license",
    "mpl-2.0": "mozilla public license",
}
THRESHOLD = 0.8
#: Words of the runs that blocks are sure to hold; a template of more words than the last is looked for in its blocks all the same.
SPANS = (16, 64)


def template_words(templates=TEMPLATES) -> dict[str, list[str]]:
    """label -> its distinct words, in code point order."""
    return {k: sorted(set(re.findall("[0-9a-z\x80-\U0010ffff]+", re.sub("[A-Z]", lambda m: m[0].lower(), v)))) for k, v in templates.items()}


def wanted(n: int, threshold: float = THRESHOLD) -> int:
    return max(1, math.ceil(round(threshold * n, 9)))


def key_pattern(key: str) -> str:
    """Matches the key's words one after another in a lower-cased text, whatever stands between them."""
    return rf"(?:^|{GAP}){GAP.join(key.split())}(?:$|{GAP})"


def _places(words: Column, phrase: str) -> Column:
    """Starts of the phrase in an array of words."""
    parts = phrase.split(" ")
    first = F.transform(words, lambda w, i: F.when(w == parts[0], i))
    stands = lambda i: reduce(lambda a, b: a & b, (F.get(words, i + k) == p for k, p in enumerate(parts) if k))
    return F.filter(first, lambda i: i.isNotNull() & F.coalesce(stands(i), F.lit(False)))


def _labelled(places: Column, label: str) -> Column:
    return F.transform(places, lambda i: F.struct(i.cast("long").alias("at"), F.lit(label).alias("label")))


def span_of(text: str) -> int:
    """The least span that holds the notice, each word of it counted."""
    n = len(re.findall("[0-9a-z\x80-\U0010ffff]+", text.lower()))
    return next((s for s in SPANS if n <= s), SPANS[-1])


def _blocks(words: Column, known: Column, span: int) -> Column:
    """array of (span, block, words): the template words of each block of 2 * span words; block is its first word's number."""
    last = F.greatest(F.lit(1), F.ceil(F.size(words) / F.lit(span)).cast("int") - 1) - 1
    own = lambda k: F.array_intersect(F.slice(words, k * span + 1, F.lit(2 * span)), known)
    return F.transform(F.sequence(F.lit(0), last), lambda k: F.struct(F.lit(span).alias("span"), (k * span).alias("block"), own(k).alias("words")))


def scan(docs: DataFrame, phrases=PHRASES, templates=TEMPLATES, threshold: float = THRESHOLD, keys=KEYS) -> DataFrame:
    """docs(doc_id, text) -> doc_id, n_words, n_base, first_word, last_word, base_labels, matched (array of label, block, containment)."""
    sets = template_words(templates)
    spans = {label: span_of(text) for label, text in templates.items()}
    vocabulary = sorted({w for words in sets.values() for w in words})
    least = min(wanted(len(w), threshold) for w in sets.values())
    known = F.array(*map(F.lit, vocabulary))
    text = F.coalesce("text", F.lit(""))
    cut = docs.select(
        "doc_id",
        F.monotonically_increasing_id().alias("row"),
        text.rlike("(?i)" + "|".join(GAP.join(p.split(" ")) for p in phrases)).alias("maybe"),
        text.alias("text"),
        F.array_remove(F.split(ascii_lower(text), GAP), "").alias("words"),
    )
    cut = cut.withColumn("held", F.array_intersect("words", known))
    hits = F.flatten(F.array(*(_labelled(_places(F.col("words"), p), label) for p, label in phrases.items())))
    # Which spans are worth cutting: a block holds no template that its whole document does not.
    fits, open_ = {span: F.lit(False) for span in SPANS}, []
    for label, own in sets.items():
        enough = F.size(F.array_intersect("held", F.array(*map(F.lit, own)))) >= wanted(len(own), threshold)
        if label in keys:
            # Looked for only where the words are.
            enough = F.when(enough, ascii_lower(F.col("text")).rlike(key_pattern(keys[label]))).otherwise(False)
        fits[spans[label]] = fits[spans[label]] | enough
        open_.append(F.when(enough, label))
    blocks = F.concat(*(F.coalesce(F.when(fit, _blocks(F.col("words"), known, span)), F.array().cast("array<struct<span:int,block:int,words:array<string>>>")) for span, fit in fits.items()))
    base = cut.select(
        "doc_id",
        "row",
        F.size("words").cast("long").alias("n_words"),
        F.when(F.col("maybe"), hits).alias("hits"),
        "held",
        F.array_compact(F.array(*open_)).alias("open"),
        F.filter(blocks, lambda b: F.size(b["words"]) >= least).alias("blocks"),
    )
    base = written(base, "license")
    spark = docs.sparkSession

    # How many documents hold each template word: a table of at most len(vocabulary) rows, whatever the corpus.
    counts = base.select(F.explode("held").alias("word")).groupBy("word").count().collect()
    often = {r["word"]: r["count"] for r in counts}
    order = {w: k for k, w in enumerate(sorted(vocabulary, key=lambda w: (often.get(w, 0), w)))}
    rank = F.create_map(*(F.lit(x) for pair in order.items() for x in pair))
    prefixes = []
    for label, own in sets.items():
        ranks, t = sorted(order[w] for w in own), wanted(len(own), threshold)
        must = [order[w] for w in keys.get(label, "").split()]
        prefixes += [(spans[label], r, label, i, t, ranks, must) for i, r in enumerate(ranks[: len(ranks) - t + 1])]
    # A row for each prefix word of each template: bounded by the templates.
    postings = F.broadcast(spark.createDataFrame(prefixes, "span int, rank int, label string, at int, t int, ranks array<int>, must array<int>"))

    ranked = F.array_sort(F.transform("b.words", lambda w: F.element_at(rank, w)))
    held = base.where(F.size("blocks") > 0).select("row", "open", F.explode("blocks").alias("b")).select("row", "open", "b.span", "b.block", ranked.alias("own"))
    first = F.array(*map(F.lit, sorted({p[1] for p in prefixes})))
    probe = held.select("row", "open", "span", "block", "own", F.explode(F.array_intersect("own", first)).alias("rank"))
    candidates = (
        probe.join(postings, ["span", "rank"])
        .where(F.array_contains("open", F.col("label")) & (F.size(F.array_except("must", "own")) == 0))
        .withColumn("j", F.array_position("own", F.col("rank")).cast("int") - 1)
        .where((F.size("own") >= F.col("t")) & (1 + F.least(F.size("ranks") - 1 - F.col("at"), F.size("own") - 1 - F.col("j")) >= F.col("t")))
        # The first common word decides; a later one of the same prefix would only give the pair again.
        .where(F.element_at(F.array_intersect("own", "ranks"), 1) == F.col("rank"))
    )
    common = F.size(F.array_intersect("own", "ranks"))
    met = candidates.where(common >= F.col("t")).select("row", F.struct("label", "block", (common / F.size("ranks")).alias("containment")).alias("m"))
    # Labels a document are few, blocks may be many: fold to the best block of each label before gathering.
    best = met.groupBy("row", "m.label").agg(F.max_by("m", F.struct(F.col("m.containment"), -F.col("m.block"))).alias("m"))
    found = best.groupBy("row").agg(F.array_sort(F.collect_list("m")).alias("matched"))
    return base.join(found, "row", "left").select(
        "doc_id",
        "n_words",
        F.coalesce(F.size("hits"), F.lit(0)).cast("long").alias("n_base"),
        F.array_min("hits.at").alias("first_word"),
        F.array_max("hits.at").alias("last_word"),
        F.array_sort(F.array_distinct(F.coalesce("hits.label", F.array().cast("array<string>")))).alias("base_labels"),
        F.coalesce("matched", F.array().cast("array<struct<label:string,block:int,containment:double>>")).alias("matched"),
    )


def digest(scanned: DataFrame) -> DataFrame:
    """One row a document with labels as strings; the score is the best containment met, 1 where a phrase stands."""
    best = F.coalesce(F.array_max("matched.containment"), F.lit(0.0))
    return scanned.select(
        "doc_id",
        "n_words",
        "n_base",
        "first_word",
        "last_word",
        F.array_join("base_labels", ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union("base_labels", F.col("matched.label"))), ",").alias("labels"),
        F.when(F.col("n_base") > 0, F.lit(1.0)).otherwise(best).alias("score"),
    )
