"""URL rules whose blocks reach the aliases of a URL.

URLs of one normal form, and URLs joined by redirects or canonical links, are aliases.
Alias classes are connected components of the link graph. A URL's own rule always
holds, so an explicit allow beats a block that reaches it from an alias. A URL
without a rule is blocked if any alias is blocked by a rule, and else allowed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from crawlspark.llm.components import connected_components
from crawlspark.workspace import Scratch

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_PARTS = "://([^/?#]*)([^?#]*)([^#]*)"
_CANONICAL = (
    r"(?is)<link\b[^>]*[\s\"']rel\s*=\s*(?:\"(?:[^\">]*\s)?canonical(?:\s[^\">]*)?\"|'(?:[^'>]*\s)?canonical(?:\s[^'>]*)?'"
    r"|canonical(?=[\s>/]))[^>]*>"
)
_REFRESH = r"(?is)<meta\b[^>]*\bhttp-equiv\s*=\s*[\"']?\s*refresh\b[^>]*>"
_HREF = r"(?is)[\s\"']href\s*=\s*[\"']?\s*([^\"'\s>]+)"
_REFRESH_URL = r"(?is)\burl\s*=\s*[\"']?([^\"'\s>]+)"
_REFERENCES = {"&lt;": "<", "&gt;": ">", "&quot;": '"', "&apos;": "'", "&amp;": "&"}


def _part(url: Column, number: int) -> Column:
    return F.coalesce(F.regexp_extract(url, _PARTS, number), F.lit(""))


def host_of(url: Column) -> Column:
    """What stands between the first ``://`` and the next ``/``, ``?`` or ``#``, A-Z in lower case; else empty."""
    return F.translate(_part(url, 1), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    """What follows the host up to ``?`` or ``#``; empty without a ``://``."""
    return _part(url, 2)


def normal_form(url: Column) -> Column:
    """A URL without scheme, www, default port, index page, final slash, tracking parameters and fragment.

    Null for a URL without a host: it has no aliases.
    """
    host = F.regexp_replace(F.regexp_replace(host_of(url), r":(80|443)$", ""), r"^www\.", "")
    path = F.regexp_replace(path_of(url), r"(/index\.html?)?/*$", "")
    query = F.regexp_replace(F.substr(_part(url, 3), F.lit(2)), r"(^|&)utm_[^&]*", "")
    query = F.regexp_replace(query, "^&", "")
    return F.when(host != "", F.concat(host, path, F.when(query != "", F.concat(F.lit("?"), query)).otherwise("")))


def _decoded(link: Column) -> Column:
    """``link`` with its character references decoded: those of ``_REFERENCES``, and numeric ones of ASCII."""

    def replaced(form: str, base: int):
        def one(text: Column, number: Column) -> Column:
            code = F.conv(number, base, 10).cast("int")
            whole = F.concat(F.lit(form), number, F.lit(";"))
            return F.when(code.between(33, 126), F.replace(text, whole, F.char(code))).otherwise(text)

        return one

    link = F.regexp_replace(F.regexp_replace(link, "&#X", "&#x"), "&#(38|x26);", "&amp;")
    for pattern, form, base in (("&#([0-9]{1,3});", "&#", 10), ("&#x([0-9A-Fa-f]{1,2});", "&#x", 16)):
        numbers = F.array_distinct(F.regexp_extract_all(link, F.lit(pattern), F.lit(1)))
        link = F.aggregate(numbers, link, replaced(form, base))
    for name, value in _REFERENCES.items():
        link = F.replace(link, F.lit(name), F.lit(value))
    return link


def _without_dots(path: Column) -> Column:
    """A path without its segments ``.`` and ``..``."""
    kept = F.aggregate(
        F.split(F.substr(path, F.lit(2)), "/"),
        F.array().cast("array<string>"),
        lambda stack, part: F.when(part == "..", F.slice(stack, F.lit(1), F.greatest(F.size(stack) - 1, F.lit(0))))
        .when(part == ".", stack)
        .otherwise(F.concat(stack, F.array(part))),
    )
    return F.concat(F.lit("/"), F.array_join(kept, "/"))


def resolved(url: Column, link: Column) -> Column:
    """The URL that ``link`` names on the page ``url``; null for a fragment, and for a scheme without a host such as mailto."""
    scheme, host, path = F.regexp_extract(url, "^([^:/?#]+)://", 1), host_of(url), path_of(url)
    root = F.when((scheme != "") & (host != ""), F.concat(scheme, F.lit("://"), host))
    own, rest = F.regexp_extract(link, "^[^?#]*", 0), F.regexp_extract(link, "[?#].*$", 0)
    folder = F.regexp_replace(path, "[^/]*$", "")
    folder = F.when(folder == "", F.lit("/")).otherwise(folder)
    return (
        F.when(F.rlike(link, F.lit("^[A-Za-z][A-Za-z0-9+.-]*:")), F.when(F.rlike(link, F.lit("^[^:]*://")), link))
        .when(F.startswith(link, F.lit("//")), F.concat(F.when(root.isNotNull(), scheme), F.lit(":"), link))
        .when(F.startswith(link, F.lit("/")), F.concat(root, _without_dots(own), rest))
        .when(F.startswith(link, F.lit("?")), F.concat(root, path, link))
        .when(~F.startswith(link, F.lit("#")), F.concat(root, _without_dots(F.concat(folder, own)), rest))
    )


def page_links(pages: DataFrame) -> DataFrame:
    """(url, target) of the canonical links and the refresh redirects of each page (url, html), resolved against its URL."""
    html = F.col("html")

    def named(word: str, tag: str, link: str) -> Column:
        tags = F.when(F.contains(F.lower("html"), F.lit(word)), F.regexp_extract_all(html, F.lit(tag), F.lit(0)))
        return F.coalesce(F.transform(tags, lambda t: F.regexp_extract(t, link, 1)), F.array().cast("array<string>"))

    links = F.concat(named("canonical", _CANONICAL, _HREF), named("refresh", _REFRESH, _REFRESH_URL))
    found = pages.where("url is not null and html is not null").select("url", F.explode(F.array_distinct(links)).alias("link"))
    target = resolved(F.col("url"), F.col("link"))
    found = found.where("link <> ''").select("url", _decoded(F.col("link")).alias("link"))
    return found.select("url", target.alias("target")).where("target is not null")


def ruled(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """(url, rule, rule_verdict) of the longest rule that fits each of the distinct ``urls`` (url); null for none.

    ``rules`` has host, path and verdict. A rule fits its host and its subdomains, if the URL's path starts
    with the rule's. Of rules of one length the alphabetically last wins, and of equal ones an allow.
    """
    parts = urls.select("url", host_of(F.col("url")).alias("url_host"), path_of(F.col("url")).alias("url_path"))
    labels = F.split("url_host", r"\.")
    suffixes = F.transform(
        F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), ".")
    )
    rule = F.concat("host", "path")
    rank = F.struct(F.length(rule).alias("length"), rule.alias("rule"), (F.col("verdict") == "allow").alias("allow"))
    best = (
        parts.where("url_host <> ''")
        .select("url", "url_path", F.explode(suffixes).alias("host"))
        .join(rules, "host")
        .where(F.startswith("url_path", "path"))
        .groupBy("url")
        .agg(F.max(rank).alias("best"))
    )
    verdict = F.when(F.col("best.allow"), "allow").when(~F.col("best.allow"), "block")
    return urls.join(best, "url", "left").select(
        "url", F.col("best.rule").alias("rule"), verdict.alias("rule_verdict")
    )


def judged(pages: DataFrame, links: DataFrame, rules: DataFrame, scratch: Scratch) -> DataFrame:
    """(page_id, host, path, rule, verdict, alias_class) for every row of ``pages`` (page_id, url).

    ``links`` (url, target) joins aliases. Repeated rows are judged alike. A null or malformed URL
    has empty host and path, no rule, no class, and is allowed.
    """
    normal = normal_form(F.col("url"))
    own = pages.where("url is not null").select("url")
    urls = scratch.keep(
        ruled(own.union(links.select("url")).union(links.select("target")).distinct(), rules)
        .withColumn("normal", normal),
        "urls",
    )
    edges = links.select(
        normal_form(F.col("url")).alias("a"), normal_form(F.col("target")).alias("b")
    ).where("a is not null and b is not null")
    joined = connected_components(edges, scratch)
    classed = urls.join(joined, F.col("normal") == F.col("node"), "left").withColumn(
        "alias_class", F.coalesce("component", "normal")
    )
    blocked = (
        classed.where("rule_verdict = 'block' and alias_class is not null").select(F.col("alias_class").alias("blocked")).distinct()
    )
    verdicts = classed.join(blocked, F.col("alias_class") == F.col("blocked"), "left").select(
        "url",
        "rule",
        F.coalesce("rule_verdict", F.when(F.col("blocked").isNotNull(), "block").otherwise("allow")).alias("verdict"),
        "alias_class",
    )
    return pages.select("page_id", "url").join(verdicts, "url", "left").select(
        "page_id",
        host_of(F.col("url")).alias("host"),
        path_of(F.col("url")).alias("path"),
        "rule",
        F.coalesce("verdict", F.lit("allow")).alias("verdict"),
        "alias_class",
    )
