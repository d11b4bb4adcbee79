"""URL filters by redirect equivalence (native).

Rules are (host, path prefix, verdict). A rule fits its host and every subdomain when the url's path starts
with the rule's path; the longest fitting rule decides. Pages that a redirect (meta refresh) or a canonical
link connects are aliases: their normalised urls are nodes, distributed connected components groups them, and
a block found on one member, be it a page or only the target of a link, reaches every member that no rule fits.
A url that an explicit allow rule fits stays allowed, whatever its aliases are.

Links are read as a browser reads them: comments, scripts, styles and templates are passed over, character references
of ASCII characters in an attribute are decoded, and dot segments of a target's path are resolved.

An html of any length is read whole. Two pages are aliases only by links, or if their urls differ in scheme and fragment alone.

Defined cases: a null url, or one without "://", has empty host and path, no rule, and is its own class
(verdict allow). A null html has no links. Repeated rows each get a verdict. An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from findloom.llm.common import ascii_lower, written
from findloom.llm.components import connected_components

#: The rules of the op9 contract.
RULES = [
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
]


def host_of(url: Column) -> Column:
    return ascii_lower(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def normalised(url: Column) -> Column:
    """Host, path and query: a fragment names no other page, nor does the scheme here, and an empty path is `/`; null without a host.

    Whatever else may differ between urls of one page, a trailing slash or a parameter, makes two nodes: only a link joins them.
    """
    path = path_of(url)
    node = F.concat(host_of(url), F.when(path == "", "/").otherwise(path), F.regexp_extract(url, r"(?s)^[^#?]*(\?[^#]*)?", 1))
    return F.when(host_of(url) != "", node)


def fitting_rule(host: Column, path: Column, rules=RULES) -> Column:
    """struct(rule, verdict) of the longest fitting rule, else null."""
    chosen = F.lit(None).cast("struct<rule:string,verdict:string>")
    for rule_host, rule_path, verdict in sorted(rules, key=lambda r: len(r[0] + r[1])):
        fits = ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith(rule_path)
        chosen = F.when(fits, F.struct(F.lit(rule_host + rule_path).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(chosen)
    return chosen


def _attribute(tag: Column, name: str) -> Column:
    return F.regexp_extract(tag, rf"""(?is)\b{name}\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", 0)


def _value(attribute: Column) -> Column:
    return F.trim(F.regexp_replace(attribute, r"""(?is)^[\w-]+\s*=\s*["']?|["']$""", ""))


#: Named references of the ASCII characters that stand in urls.
NAMED = {"quot": '"', "apos": "'", "lt": "<", "gt": ">", "sol": "/", "colon": ":", "period": ".", "quest": "?", "num": "#", "equals": "=", "percnt": "%", "lowbar": "_", "amp": "&"}


def decoded(text: Column) -> Column:
    """Character references of ASCII characters, by number or by a name of NAMED, as those characters."""
    digits = lambda piece: F.regexp_extract(piece, r"^(?:[xX]([0-9a-fA-F]{1,6})|([0-9]{1,7}))", 0)

    def one(piece, k):
        number = digits(piece)
        value = F.when(number.rlike("^[xX]"), F.conv(F.substring(number, 2, 6), 16, 10)).otherwise(number).cast("int")
        known = (k > 0) & (number != "") & value.between(1, 127)
        rest = F.regexp_replace(F.substring(piece, F.length(number) + 1, F.length(piece)), "^;", "")
        return F.when(known, F.concat(F.char(value), rest)).when(k == 0, piece).otherwise(F.concat(F.lit("&#"), piece))

    out = F.array_join(F.transform(F.split(text, "&#"), one), "")
    for name, char in NAMED.items():
        out = F.replace(out, F.lit(f"&{name};"), F.lit(char))
    return F.when(F.contains(text, F.lit("&")), out).otherwise(text)


def link_targets(html: Column) -> Column:
    """Targets of <link rel=canonical> and <meta http-equiv=refresh> in the page, with character references decoded."""
    hidden = r"(?is)<!--.*?(?:-->|\z)|<(script|style|template|textarea|title)\b.*?(?:</\1\s*>|\z)"
    tags = F.regexp_extract_all(
        F.regexp_replace(html, hidden, " "),
        F.lit(r"""(?is)<(?:link\b[^>]*\brel\s*=\s*["']?[^"'>]*\bcanonical\b[^>]*|meta\b[^>]*\bhttp-equiv\s*=\s*["']?refresh\b[^>]*)>"""), 0
    )
    target = lambda tag: F.when(
        tag.rlike(r"(?i)^<link"), decoded(_value(_attribute(tag, "href")))
    ).otherwise(F.regexp_replace(F.regexp_extract(decoded(_value(_attribute(tag, "content"))), r"(?is)\burl\s*=\s*(.*)$", 1), r"""(?s)^(["'])(.*?)(\1.*)?$""", "$2"))
    some = F.when(html.rlike(r"(?i)\bcanonical\b|\brefresh\b"), F.filter(F.transform(tags, lambda t: F.trim(target(t))), lambda t: t != ""))
    return F.coalesce(some, F.array().cast("array<string>"))


def without_dots(path: Column) -> Column:
    """The path with its dot segments resolved: "." is dropped, ".." takes the segment before it along."""
    def step(done, segment):
        up = F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(1)))
        return F.when(segment == "..", up).when(segment == ".", done).otherwise(F.array_append(done, segment))

    parts = F.split(path, "/")
    last = F.element_at(parts, -1)
    kept = F.aggregate(F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 1, F.lit(0))), F.array(F.lit("")), step)
    plain = F.concat(F.array_join(kept, "/"), F.when(last.isin(".", ".."), F.lit("/")).otherwise(F.lit("")))
    return F.when(path.rlike(r"(?:^|/)\.\.?(?:/|$)"), plain).otherwise(path)


def resolved(target: Column, url: Column) -> Column:
    """An absolute url for a link target found on url."""
    scheme = F.regexp_extract(url, r"^([A-Za-z][\w+.-]*):", 1)
    site = F.concat(scheme, F.lit("://"), host_of(url))
    folder = F.regexp_replace(path_of(url), r"[^/]*$", "")
    full = (
        F.when(target.rlike(r"^[A-Za-z][\w+.-]*://"), target)
        .when(target.startswith("//"), F.concat(scheme, F.lit(":"), target))
        .when(target.startswith("/"), F.concat(site, target))
        .when(target.startswith("?"), F.concat(site, path_of(url), target))
        .when(target.startswith("#"), url)
        .otherwise(F.concat(site, F.when(folder == "", F.lit("/")).otherwise(folder), target))
    )
    start = F.regexp_extract(full, r"^[^:]*://[^/?#]*", 0)
    return F.concat(start, without_dots(path_of(full)), F.regexp_extract(full, r"(?s)^[^:]*://[^?#]*(.*)$", 1))


def filter_urls(pages: DataFrame, rules=RULES) -> DataFrame:
    """pages(page_id, url, html) -> page_id, host, path, rule, verdict, alias_class (the component's least node)."""
    blocks = lambda fit: F.coalesce(fit["verdict"] == "block", F.lit(False))
    link = lambda url: F.struct(normalised(url).alias("node"), blocks(fitting_rule(host_of(url), path_of(url), rules)).alias("bad"))
    judged = pages.select("page_id", "url", "html").select(
        "page_id",
        host_of(F.col("url")).alias("host"),
        path_of(F.col("url")).alias("path"),
        normalised(F.col("url")).alias("node"),
        F.transform(F.transform(link_targets(F.col("html")), lambda t: resolved(t, F.col("url"))), link).alias("links"),
    )
    judged = written(judged.withColumn("fit", fitting_rule(F.col("host"), F.col("path"), rules)), "urls")
    edges = judged.where(F.size("links") > 0).select(F.col("node").alias("u"), F.explode("links").alias("l")).select("u", F.col("l.node").alias("v"), "l.bad").dropna()
    classes = connected_components(edges.select("u", "v"))
    # One row a node before the class is looked up: a url that a third of all rows share stays one row.
    ends = judged.where("node is not null").select("node", blocks(F.col("fit")).alias("bad")).unionByName(edges.select(F.col("v").alias("node"), "bad"))
    nodes = ends.groupBy("node").agg(F.max("bad").alias("bad"))
    # Tables of nodes have no size bound, and the size of their compressed files says little: no join broadcasts them.
    nodes = nodes.join(classes.hint("merge"), "node", "left").withColumn("alias_class", F.coalesce("component", "node"))
    blocked = nodes.where("bad").select("alias_class").distinct().withColumn("blocked", F.lit(True))
    marked = nodes.join(blocked.hint("merge"), "alias_class", "left").select("node", "alias_class", F.coalesce("blocked", F.lit(False)).alias("blocked"))
    return judged.join(marked.hint("merge"), "node", "left").select(
        "page_id",
        "host",
        "path",
        F.col("fit.rule").alias("rule"),
        F.coalesce(F.col("fit.verdict"), F.when(F.col("blocked"), F.lit("block")).otherwise(F.lit("allow"))).alias("verdict"),
        "alias_class",
    )
