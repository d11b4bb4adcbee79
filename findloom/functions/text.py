"""Text functions: scrubbing, citations, keywords, metadata, ids and prompts. All are built-ins, null gives null."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The marker between an answer and its citations, the label of a timing line, and image data patterns.
CITATION_MARK = "\n\n---回答内で参照されているコンテキスト---\n\n"
TIMING_LABEL = "推論時間"
MARKDOWN_IMAGE = r"!\[[^\]]*\]\(data:image/[^;]+;base64,[A-Za-z0-9+/=]+\)"
HTML_IMAGE = r"""<img[^>]*src=["']data:image/[^;]+;base64,[A-Za-z0-9+/=]+["'][^>]*>"""
BARE_IMAGE = r"data:image/[^;]+;base64,[A-Za-z0-9+/=]+"
#: base64 openings of image formats.
IMAGE_OPENINGS = {"/9j/": "jpeg", "iVBORw0KGgo": "png", "R0lGODlh": "gif", "UklGR": "webp"}
#: Common English words that are no search terms.
FIXED_STOP_WORDS = (
    "a b c d e f g h i j k l m n o p q r s t u v w x y z is do this that there and but or because as until while of at by for with about against between "
    "into through during before after above below to from up down in out on off over under again further then once here when where why how all any both "
    "each few more most other some such no nor not only own same so than too very can will just don don't should should've now ll re ve ain aren aren't "
    "couldn couldn't didn didn't doesn doesn't hadn hadn't hasn hasn't haven haven't isn isn't ma mightn mightn't mustn mustn't needn needn't shan shan't "
    "shouldn shouldn't wasn wasn't weren weren't won won't wouldn wouldn't"
).split()
#: Articles, pronouns and auxiliaries, added here in place of a language model's own list.
MORE_STOP_WORDS = "the an i you he she it we they me him her us them my your his its our their who whom which what if am are was were be been being have has had having did does".split()
STOP_WORDS = (*FIXED_STOP_WORDS, *MORE_STOP_WORDS)
#: Control characters that no XML document may hold.
NO_XML = "".join(map(chr, [*range(1, 9), 11, 12, *range(14, 32)]))
#: Lengths of a term that are kept, by language.
TERM_LENGTHS = {"ja": (2, 9), "en": (3, 14), "zh": (2, 4)}


def collapse_newlines(text: Column) -> Column:
    return F.regexp_replace(text, r"\n{2,}", "\n")


def scrub_control(text: Column) -> Column:
    return F.translate(text, "\u000b\u0001", "\n ")


def scrub_base64_images(text: Column) -> Column:
    for pattern in (MARKDOWN_IMAGE, HTML_IMAGE, BARE_IMAGE):
        text = F.regexp_replace(text, pattern, "")
    return text


def stripped(text: Column) -> Column:
    """Without white space at both ends (ASCII and Unicode)."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def answer_and_citation(text: Column) -> Column:
    """struct(answer, citation), both null without the marker; the first marker counts."""
    parts = F.split(text, rf"\Q{CITATION_MARK}\E", 2)
    found = F.size(parts) == 2
    return F.struct(F.when(found, stripped(F.get(parts, F.lit(0)))).alias("answer"), F.when(found, stripped(F.get(parts, F.lit(1)))).alias("citation"))


def without_timing_line(text: Column) -> Column:
    """The last line goes if it is a timing line; other line ends become \\n."""
    lines = F.split(F.regexp_replace(text, r"(\r\n|\n|\r)\z", ""), r"\r\n|\n|\r")
    timed = F.element_at(lines, -1).startswith(TIMING_LABEL)
    return F.when(text == "", text).otherwise(F.array_join(F.when(timed, F.slice(lines, F.lit(1), F.size(lines) - 1)).otherwise(lines), "\n"))


def valid_terms(tokens: Column, language: str = "en", stop_words: list[str] = STOP_WORDS) -> Column:
    """Distinct tokens that are no stop words, hold no digit or bracket, and have a length that the language allows."""
    low, high = TERM_LENGTHS[language]
    stops = F.array(*map(F.lit, stop_words))
    fits = lambda t: ~t.rlike(r"[0-9\[\](){}<>]") & F.length(t).between(low, high) & ~F.array_contains(stops, F.lower(t))
    return F.filter(F.array_distinct(tokens), fits)


def shortest_terms(terms: Column, limit: int) -> Column:
    """At most `limit` terms; only where there are more, the shortest ones, in order of length and place."""
    keyed = F.transform(terms, lambda t, i: F.struct(F.length(t).alias("n"), i.alias("i"), t.alias("t")))
    cut = F.transform(F.slice(F.array_sort(keyed), 1, limit), lambda s: s["t"])
    return F.when(F.size(terms) <= limit, terms).otherwise(cut)


def keyword_hits(content: Column, terms: Column) -> Column:
    """`(n)[a, b]` of the terms that occur in content without regard to case, `(0)[No Match]` if none do."""
    hits = F.filter(terms, lambda t: F.contains(F.lower(content), F.lower(t)))
    shown = F.concat(F.lit("("), F.size(hits).cast("string"), F.lit(")["), F.array_join(hits, ", "), F.lit("]"))
    return F.when(F.size(hits) > 0, shown).otherwise("(0)[No Match]")


def metadata_json(text: Column, base: dict[str, Column]) -> Column:
    """JSON of the base keys and then the `k=v,k=v` pairs of text, split at the first =."""
    pairs = F.transform(F.split(text, ","), lambda p: F.struct(F.substring_index(p, "=", 1).alias("k"), F.expr("1").alias("x"), p.alias("p")))
    own = F.map_from_entries(F.transform(pairs, lambda s: F.struct(s["k"], F.substring(s["p"], F.length(s["k"]) + 2, F.length(s["p"])))))
    fixed = F.create_map(*(x for k, v in base.items() for x in (F.lit(k), v)))
    return F.to_json(F.map_concat(fixed, F.when(F.coalesce(text, F.lit("")) != "", own).otherwise(F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>")))))


def metadata_value(cmetadata: Column, key: str) -> Column:
    return F.get_json_object(cmetadata, f"$['{key}']")


def preview(text: Column, limit: int = 1000) -> Column:
    return F.when(F.length(text) > limit, F.concat(F.substring(text, 1, limit), F.lit(" ..."))).otherwise(text)


def image_format(base64_data: Column) -> Column:
    """Format by the opening of the base64 text, jpeg if unknown."""
    kind = F.lit("jpeg")
    for opening, name in IMAGE_OPENINGS.items():
        kind = F.when(base64_data.startswith(opening), name).otherwise(kind)
    return kind


def data_uri(base64_data: Column) -> Column:
    return F.when(base64_data.startswith("data:"), base64_data).otherwise(F.concat(F.lit("data:image/"), image_format(base64_data), F.lit(";base64,"), base64_data))


def snowflake_id(milliseconds: Column, datacenter: int = 0, worker: int = 0, sequence: Column | int = 0, prefix: str = "") -> Column:
    """Time-ordered id: milliseconds since the epoch of the format, then datacenter, worker and sequence."""
    own = F.shiftleft(milliseconds - F.lit(1288834974657), 22).bitwiseOR(F.lit(datacenter << 17 | worker << 12))
    own = own.bitwiseOR(F.lit(sequence).cast("long") if isinstance(sequence, int) else sequence.cast("long"))
    return F.concat(F.lit(prefix), own.cast("string"))


def hashed_id(text: Column) -> Column:
    return F.upper(F.substring(F.sha2(text, 256), 1, 16))


def rendered(template: str, **values: Column) -> Column:
    """The template with each {name} of values replaced; braces inside values, and other names, stay as they are."""
    parts = re.split(rf"\{{({'|'.join(values)})\}}", template)
    return F.concat(*(values[p] if k % 2 else F.lit(p) for k, p in enumerate(parts)))


def to_blob(text: Column) -> Column:
    """The UTF-8 bytes of a text."""
    return F.encode(text, "UTF-8")


def jsonl_line(json: Column, delimiter: str) -> Column:
    return F.concat(json, F.lit(f" {delimiter}"))
