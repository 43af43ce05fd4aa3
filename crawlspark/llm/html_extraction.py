"""Main text of web pages: marked articles, and a host's suffix array for pages without one.

Pages are cut into blocks, each in a zone: article, main, boilerplate (menus, footers,
adverts, forms, comments and the like) or open. A page's text is its article, else its main part. A
page that marks neither has open blocks only; of these, long token runs that also stand on
another page of the host are removed, and the runs that are left are its text. Copies are not other
pages: pages whose open streams are equal or near-equal are one class, and a run is repeated only if pages of two
classes have it.

The repeats come from the suffixes of all token streams of a host outside of articles, brought
together by their first ``MIN_REPEAT`` tokens: suffixes from distinct pages that agree so far are what
neighbours of a suffix array with such a common prefix are. Each of them covers its tokens.
"""

from __future__ import annotations

import re
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crawlspark.llm.near_dedup import near_duplicates
from crawlspark.llm.tokens import Texts, windows, words
from crawlspark.llm.url_filters import host_of
from crawlspark.workspace import Scratch

#: Tokens that a repeated run has at least.
MIN_REPEAT = 8
#: Open streams are near-equal if their sets of so many words in a row are; short ones too may differ in a date.
CLASS_SHINGLE_WORDS = 2

ARTICLE, MAIN, OPEN, BOILERPLATE = "article", "main", "open", "boilerplate"

# Element names, and words of class, id and role that mark what is not main text.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
SILENT = set("script style noscript template svg math iframe object canvas audio video head title".split())
CHROME = set("nav footer aside form button select textarea dialog menu fieldset".split())
BLOCKS = set(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure "
    "footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol option p pre section summary "
    "table tbody td tfoot th thead tr ul".split()
)
MARKS = set(
    "ad ads adv advert adverts advertisement advertising banner sponsor sponsored promo promotion cookie cookies "
    "consent gdpr notice notices notification alert popup modal overlay newsletter subscribe subscription signup "
    "share sharing social related recommended recommendations sidebar menu nav navigation navbar breadcrumb "
    "breadcrumbs footer pagination pager comment comments commentlist commentform respond reply replies disqus "
    "sidenav masthead topbar adsbygoogle".split()
)
#: Implied ends: an element of the first kind ends open ones of the second, up to a container.
IMPLIED = {
    "li": {"li"},
    "dt": {"dt", "dd"},
    "dd": {"dt", "dd"},
    "tr": {"tr", "td", "th"},
    "td": {"td", "th"},
    "th": {"td", "th"},
    "option": {"option"},
}
CONTAINERS = {"ul", "ol", "dl", "table", "select", "article", "main", "body", "div", "section"}

#: Marks of an article or main part itself that make it no main text.
FOREIGN = set("ad ads advert advertisement comment comments promo recommended related reply replies sponsored".split())

_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_QUALIFIED = re.compile(r"\b(has|with|no|without)[-_][a-z]+", re.I)
_SPACES = re.compile(r"[ \t\n\r\f\v]+")


class _Blocks(HTMLParser):
    """Blocks (zone, text) of a page in order."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.blocks, self.text = [], []
        #: Open elements: (name, zone, whether its text is left out).
        self.stack = []

    @property
    def zone(self) -> str:
        return self.stack[-1][1] if self.stack else OPEN

    @property
    def silent(self) -> bool:
        return bool(self.stack) and self.stack[-1][2]

    def end_block(self) -> None:
        text = _SPACES.sub(" ", "".join(self.text)).strip(" ")
        self.text = []
        if text:
            self.blocks.append((self.zone, text))

    def handle_starttag(self, tag, attrs):
        if tag in BLOCKS:
            self.end_block()
        if tag in VOID:
            if tag == "br":
                self.text.append(" ")
            return
        if tag in IMPLIED:
            for k in range(len(self.stack) - 1, -1, -1):
                if self.stack[k][0] in IMPLIED[tag]:
                    del self.stack[k:]
                    break
                if self.stack[k][0] in CONTAINERS:
                    break
        zone = self.zone
        if tag == "article" or tag == "main":
            # What surrounds an article says nothing about it, but a comment may be an article of its own.
            around = {z for name, z, _ in self.stack if name in CHROME or name in ("article", "main")}
            if zone != ARTICLE and BOILERPLATE not in around:
                zone = tag
            if self._marked(attrs, FOREIGN):
                zone = BOILERPLATE
        elif tag in CHROME or tag == "header" and zone not in (ARTICLE, MAIN):
            zone = BOILERPLATE
        elif tag not in ("html", "body", "h1") and self._marked(attrs, MARKS):
            zone = BOILERPLATE
        if zone != self.zone:
            self.end_block()
        self.stack.append((tag, zone, self.silent or tag in SILENT))

    @staticmethod
    def _marked(attrs, marks: set[str]) -> bool:
        for name, value in attrs:
            if name == "hidden" or name == "aria-hidden" and value == "true":
                return True
            if value and name in ("class", "id", "role"):
                found = _WORD.findall(_QUALIFIED.sub(" ", value))
                if not marks.isdisjoint(word.lower() for word in found):
                    return True
        return False

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID and tag in ("svg", "math"):
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        if tag in BLOCKS:
            self.end_block()
        if tag == "br":
            self.text.append(" ")
        for k in range(len(self.stack) - 1, -1, -1):
            if self.stack[k][0] == tag:
                if self.zone != (self.stack[k - 1][1] if k else OPEN):
                    self.end_block()
                del self.stack[k:]
                break
            if self.stack[k][0] in ("article", "main", "body") and tag not in ("html", "body", "article", "main"):
                break

    def handle_data(self, data):
        if not self.silent:
            self.text.append(data)


def page_blocks(html: str | None) -> list[tuple[str, str]]:
    """The blocks of a page; a null page has none. Markup that breaks off ends the page."""
    parser = _Blocks()
    parser.feed(html or "")
    parser.close()
    parser.end_block()
    return parser.blocks


def main_blocks(blocks: list[tuple[str, str]]) -> list[str] | None:
    """The blocks of the article, else of the main part; None for a page that marks neither."""
    for zone in (ARTICLE, MAIN):
        if own := [text for z, text in blocks if z == zone]:
            return own
    return None


def _stream(texts: list[str]) -> Texts:
    data = [t.encode("utf-8", "surrogatepass") for t in texts]
    return Texts(np.frombuffer(b"\n".join(data), np.uint8), np.array([0, sum(map(len, data)) + max(len(data) - 1, 0)]))


def suffixes(pages: DataFrame, min_repeat: int = MIN_REPEAT) -> DataFrame:
    """(key, page, at, open, text): each suffix, outside of articles, of each page's token stream by its first tokens.

    ``pages`` has page (what tells pages apart), host_key and html. ``open`` marks the suffixes of open
    blocks of pages without a marked text. Each such page also has a row without a key, whose ``text`` are its open blocks.
    """

    def cut(batches):
        for batch in batches:
            out = [[], [], [], []]
            streams = [[], []]
            for page, host, html in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                blocks = page_blocks(html)
                chosen = main_blocks(blocks)
                # Open blocks come first, so that places in them don't depend on the rest.
                own = [t for z, t in blocks if z == OPEN]
                rest = [t for z, t in blocks if z == BOILERPLATE]
                if chosen is None and own:
                    streams[0].append(page)
                    streams[1].append("\n".join(own))
                for texts, is_open in ((own, chosen is None), (rest, False)):
                    found = words(_stream(texts))
                    runs, _ = windows(found.hashes, np.array([0, len(found.hashes)]), min_repeat)
                    keys = (runs ^ np.uint64(host % (1 << 64))) * np.uint64(0x9E3779B97F4A7C15)
                    out[0].append(keys.view(np.int64))
                    out[1].append(np.full(len(keys), page, np.int64))
                    out[2].append(np.arange(len(keys)))
                    out[3].append(np.full(len(keys), is_open))
            columns = [np.concatenate(c) if c else np.zeros(0, np.int64) for c in out]
            names = ["key", "page", "at", "open", "text"]
            yield pa.RecordBatch.from_arrays(
                [
                    *(pa.array(c) for c in columns[:3]),
                    pa.array(columns[3].astype(bool)),
                    pa.nulls(len(columns[0]), pa.string()),
                ],
                names=names,
            )
            if streams[0]:
                none = len(streams[0])
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.nulls(none, pa.int64()),
                        pa.array(streams[0], pa.int64()),
                        pa.nulls(none, pa.int64()),
                        pa.array(np.zeros(none, bool)),
                        pa.array(streams[1], pa.string()),
                    ],
                    names=names,
                )

    schema = "key long, page long, at long, open boolean, text string"
    return pages.select("page", "host_key", "html").mapInArrow(cut, schema)


def content_classes(found: DataFrame, scratch: Scratch) -> DataFrame:
    """(page, content): what the open streams of ``found`` (page, text) have in common with their copies and near copies."""
    streams = found.where("text is not null").select(F.col("page").alias("doc_id"), "text").dropDuplicates(["doc_id"])
    streams = scratch.keep(streams, "streams")
    if streams.isEmpty():
        return streams.select(F.col("doc_id").alias("page"), F.col("doc_id").alias("content"))
    near = near_duplicates(streams, scratch, CLASS_SHINGLE_WORDS)
    return near.select(F.col("doc_id").alias("page"), F.col("component_id").alias("content"))


def unique_runs(texts: list[str], covered: list[int], min_repeat: int) -> list[str]:
    """The blocks without the tokens that the suffixes at ``covered`` repeat."""
    tokens = [t.split() for t in texts]
    gone = np.zeros(sum(map(len, tokens)) + 1, np.int64)
    for at in covered:
        gone[at] += 1
        gone[min(at + min_repeat, len(gone) - 1)] -= 1
    gone, at, out = np.cumsum(gone) > 0, 0, []
    for block in tokens:
        left = [t for t, g in zip(block, gone[at : at + len(block)], strict=True) if not g]
        at += len(block)
        if left:
            out.append(" ".join(left))
    return out


def main_text(pages: DataFrame, scratch: Scratch, min_repeat: int = MIN_REPEAT) -> DataFrame:
    """(page_id, url, text) of every row of ``pages`` (page_id, url, html); text is empty if there is none.

    Pages with equal url and html are one page. Pages without a marked text whose open streams are copies or near
    copies don't repeat each other: each keeps what it has apart from pages of other content. A page
    without a host belongs to the host of the empty name. Other columns are ignored.
    """
    keyed = pages.select(
        "page_id",
        "url",
        "html",
        F.xxhash64("url", "html").alias("page"),
        F.xxhash64(host_of(F.col("url"))).alias("host_key"),
    )
    cut = suffixes(keyed, min_repeat)
    # Suffixes of pages that need no decision only tell that a run is repeated; of the others the places count.
    found = scratch.keep(cut, "suffixes")
    pages_of = (
        found.where("key is not null")
        .select("key", "page")
        .distinct()
        .join(content_classes(found, scratch), "page", "left")
        .withColumn("content", F.coalesce("content", "page"))
        .groupBy("key")
        .agg(F.min("content").alias("low"), F.max("content").alias("high"))
    )
    places = found.where("open").join(pages_of.where("low <> high").select("key"), "key").groupBy("page")
    covered = scratch.keep(places.agg(F.sort_array(F.collect_set("at")).alias("covered")), "covered")

    def extract(batches):
        for batch in batches:
            texts = []
            for html, places in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                blocks = page_blocks(html)
                chosen = main_blocks(blocks)
                if chosen is None:
                    chosen = unique_runs([t for z, t in blocks if z == OPEN], places or [], min_repeat)
                texts.append("\n\n".join(chosen))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(texts, pa.string())], names=["page_id", "url", "text"]
            )

    schema = pages.select("page_id", "url").schema.add("text", "string")
    joined = keyed.join(covered, "page", "left").select("page_id", "url", "html", "covered")
    return joined.mapInArrow(extract, schema)
