"""URL filter: rules by host and path, carried along redirects and canonical links.

A page's own rule decides first: of the rules whose host is the page's host or
a parent domain and whose path is a prefix of the page's path, the longest.
Pages that no rule fits take the decision of their aliases: URLs tied by
``<link rel="canonical">`` and ``<meta http-equiv="refresh">``, or equal up to
scheme and fragment, form components (distributed large-star/small-star). A
component with an explicitly allowed member is allowed, else one with a blocked
member is blocked; link targets count even where they are no page themselves.
Without any decision a page is allowed.

DataFrame functions only. Rules are matched by an equi-join on the parent
domains of the distinct (host, path) pairs, so a long rule list is as welcome
as a short one and a hot host is spread over its paths.

Defined cases: a null URL, or one without ``://``, has an empty host and path,
no rule and no aliases, and is allowed; null html has no links; a link that
leads nowhere (``javascript:``, ``mailto:``, empty) is ignored; every canonical
link and refresh of a page counts, with its character references decoded; dot
segments of links are resolved with ``dots`` only (the query asks for it); a tag that holds a bracket in an
attribute ends there; addresses and tags may have any length; repeated pages
are judged each on its own; of rules of equal length the larger string wins,
of the same rule given twice with both verdicts the block.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from html.entities import html5

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, inline_rows, written
from .components import components

# A tag is taken first and its attributes one at a time. Patterns repeat single character classes only: those
# are loops, while a repeated group recurses for each round. A tag ends at the next bracket of either kind, so
# tags that are never closed are passed over once.
TAG = r"(?i)<(?:link|meta)\b[^<>]*>"
CANONICAL = r"""(?i)^<link\b[^<>]*\brel\s*=\s*["']?canonical\b"""
REFRESH = r"""(?i)^<meta\b[^<>]*\bhttp-equiv\s*=\s*["']?refresh\b"""
HREF = r"""(?i)\bhref\s*=\s*["']?([^"'\s>]+)"""
REFRESH_URL = r"""(?i)\burl\s*=\s*["']?([^"'\s>]+)"""
# a character reference as attributes may hold it, else a run without one
PIECE = r"(?i)&#x[0-9a-f]+;?|&#[0-9]+;?|&[a-z][a-z0-9]*;|&[a-z][a-z0-9]*(?![a-z0-9=])|&|[^&]+"


def bound(value: Column, step: Callable[[Column], Column]) -> Column:
    """``step`` of ``value``, worked out once however often the step names it."""
    return F.element_at(F.transform(F.array(value), step), 1)


def url_host(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    return ascii_lower(F.coalesce(F.regexp_extract(url, r"^[\s\S]*?://([^/?#]*)", 1), F.lit("")))


def url_path(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end; else empty."""
    return F.coalesce(F.regexp_extract(url, r"^[\s\S]*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def url_node(url: Column) -> Column:
    """A URL without scheme and fragment; null where there is no ``://``."""
    query = F.regexp_extract(url, r"^[^#]*?(\?[^#]*)", 1)
    return F.when(url.contains("://"), F.concat(url_host(url), url_path(url), query))


def unescaped(links: DataFrame) -> DataFrame:
    """(link, text) of the distinct ``link``s: text has the character references decoded. The names of
    references are a small table that the pieces are joined with; links without any are left alone."""
    names = json.dumps([{"name": k, "char": v} for k, v in html5.items()])
    names = inline_rows(links.sparkSession, names, "name: string, char: string")
    links = links.select("link").distinct()
    pieces = links.where(F.contains("link", F.lit("&")))
    pieces = pieces.select("link", F.posexplode(F.regexp_extract_all("link", F.lit(PIECE), F.lit(0))).alias("at", "piece"))
    piece = F.col("piece")

    def char(digits: Column) -> Column:
        code = F.when(piece.rlike("^&#[xX]"), F.conv(digits, 16, 10)).otherwise(digits).cast("decimal(38,0)")
        valid = (F.length(digits) < 9) & code.between(1, 0x10FFFF) & ~code.between(0xD800, 0xDFFF)
        # an impossible code point is asked for as U+FFFD, so that decode never fails
        point = F.when(valid, code).otherwise(0xFFFD).cast("bigint")
        return F.decode(F.unhex(F.lpad(F.hex(point), 8, "0")), "UTF-32")

    digits = F.regexp_extract(piece, r"^&#[xX]?0*([0-9A-Fa-f]*);?$", 1)
    digits = F.when(F.length(digits) < 9, digits).otherwise("99999999")  # too long for any character
    digits = F.when(digits == "", "0").otherwise(digits)
    number = F.when(piece.rlike(r"^&#[xX]?[0-9A-Fa-f]"), bound(digits, char))
    pieces = pieces.withColumns({"number": number, "name": F.when(piece.startswith("&"), F.substring(piece, 2, 64))})
    pieces = pieces.join(F.broadcast(names), "name", "left")  # the 2,231 names of HTML
    text = F.coalesce("number", "char", "piece").alias("text")
    rows = pieces.select("link", "at", text).groupBy("link").agg(F.array_sort(F.collect_list(F.struct("at", "text"))).alias("t"))
    decoded = rows.select("link", F.array_join(F.transform("t", lambda x: x["text"]), "").alias("text"))
    return decoded.union(links.where(~F.contains("link", F.lit("&"))).select("link", F.col("link").alias("text")))


def before_semicolon(link: Column) -> Column:
    """Up to the first ``;`` that ends no character reference."""

    def cut(pieces: Column) -> Column:
        ends = F.transform(pieces, lambda p: ~p.startswith("&") & p.contains(";"))
        whole = F.array_position(ends, F.lit(True)).cast("int") - 1  # pieces before the cut one; -1: none is cut
        last = F.substring_index(F.get(pieces, whole), ";", 1)
        return F.when(whole < 0, link).otherwise(F.concat(F.array_join(F.slice(pieces, 1, F.greatest(whole, F.lit(0))), ""), last))

    pieces = F.regexp_extract_all(link, F.lit(PIECE), F.lit(0))
    return F.when(link.contains(";"), bound(pieces, cut)).otherwise(link)


def without_dots(url: Column) -> Column:
    """``url`` with the ``.`` and ``..`` segments of its path resolved."""
    parts = F.split(url_path(url), "/")

    def step(kept: Column, part: Column) -> Column:
        up = F.slice(kept, 1, F.greatest(F.size(kept) - 1, F.lit(1)))
        return F.when(part == "..", up).when(part == ".", kept).otherwise(F.concat(kept, F.array(part)))

    kept = F.aggregate(F.slice(parts, 2, F.size(parts)), F.slice(parts, 1, 1), step)
    kept = F.when(F.element_at(parts, -1).isin(".", ".."), F.concat(kept, F.array(F.lit("")))).otherwise(kept)
    root, rest = F.regexp_extract(url, r"^([\s\S]*?://[^/?#]*)", 1), F.regexp_extract(url, r"([?#][\s\S]*)$", 1)
    return F.when(url.rlike(r"/\.\.?(?:[/?#]|$)"), F.concat(root, F.array_join(kept, "/"), rest)).otherwise(url)


def absolute(link: Column, base: Column) -> Column:
    """``link`` as found on the page ``base``; null if it is no web address."""
    scheme = F.concat(F.regexp_extract(base, r"^([\s\S]*?)://", 1), F.lit(":"))
    folder = F.regexp_extract(url_path(base), r"^([\s\S]*/)", 1)
    root = F.concat(scheme, F.lit("//"), url_host(base))
    return (
        F.when(link.rlike(r"^(?i:https?)://"), link)
        .when(link.startswith("//"), F.concat(scheme, link))
        .when(link.startswith("/"), F.concat(root, link))
        .when((link == "") | link.startswith("#") | link.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), None)
        .when(link.startswith("?"), F.concat(root, url_path(base), link))
        .otherwise(F.concat(root, F.when(folder == "", "/").otherwise(folder), link))
    )


def alias_links(pages: DataFrame, dots: bool = False) -> DataFrame:
    """(source, target) addresses that a page declares to be its own other names."""
    tags = F.explode(F.regexp_extract_all("html", F.lit(TAG), F.lit(0))).alias("tag")
    tags = pages.where(F.contains("url", F.lit("://"))).select("url", tags)
    tag = F.col("tag")
    link = F.when(tag.rlike(CANONICAL), F.regexp_extract(tag, HREF, 1)).when(
        tag.rlike(REFRESH), bound(F.regexp_extract(tag, REFRESH_URL, 1), before_semicolon)
    )
    links = written(tags.select("url", link.alias("link")).where("link != ''").distinct())
    links = links.join(unescaped(links), "link").select("url", "text")

    def target(url: Column) -> Column:
        found = absolute(F.col("text"), url)
        return bound(found, without_dots) if dots else found

    return links.select(F.col("url").alias("source"), target(F.col("url")).alias("target")).where("target is not null").distinct()


def rule_of(places: DataFrame, rules: DataFrame) -> DataFrame:
    """(host, path, rule, ruled): the longest fitting rule of each distinct host and path that has one."""
    labels = F.split("host", r"\.")
    parents = F.explode(
        F.transform(
            F.sequence(F.lit(1), F.size(labels)),
            lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."),
        )
    )
    places = places.select("host", "path").where("host != ''").distinct().withColumn("domain", parents)
    rules = rules.select(
        F.col("host").alias("domain"),
        F.col("path").alias("prefix"),
        F.concat("host", "path").alias("rule"),
        F.col("verdict").alias("ruled"),
    )
    fitting = places.join(rules, "domain").where(F.col("path").startswith(F.col("prefix")))
    best = F.max(F.struct(F.length("rule").alias("n"), "rule", "ruled")).alias("best")
    return fitting.groupBy("host", "path").agg(best).select("host", "path", "best.rule", "best.ruled")


def placed(urls: DataFrame) -> DataFrame:
    url = F.col("url")
    return urls.withColumns({"host": url_host(url), "path": url_path(url), "node": url_node(url)})


def judge_pages(pages: DataFrame, rules: DataFrame, dots: bool = False) -> DataFrame:
    """(page_id, url, host, path, rule, verdict) of every page. ``rules``: host, path, verdict."""
    links = written(alias_links(pages, dots))  # worked out once; the plans that follow stay small
    tied = components(links.select(url_node(F.col("source")).alias("a"), url_node(F.col("target")).alias("b")))
    rows = placed(pages.select("page_id", "url"))
    ends = placed(links.select(F.col("source").alias("url")).union(links.select("target")))
    names = ends.select("node", "host", "path").distinct()
    ruled = rule_of(rows.select("host", "path").union(names.select("host", "path")), rules)
    # one decision per component; an explicit allow comes before a block
    decided = names.join(ruled, ["host", "path"]).join(tied, "node").groupBy("component")
    decided = decided.agg(F.min("ruled").alias("inherited"))  # 'allow' < 'block'
    inherited = tied.join(decided, "component").select("node", "inherited")
    joined = rows.join(ruled, ["host", "path"], "left").join(inherited, "node", "left")
    return joined.select(
        "page_id", "url", "host", "path", "rule", F.coalesce("ruled", "inherited", F.lit("allow")).alias("verdict")
    )
