"""Main text of web pages: structure, and differencing against the page of the nearest URL on the same host."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import fresh, materialise, shuffle_partitions

TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>?|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']+|"[^"]*"|'[^']*')*)>?""", re.S)
RAW = {"script", "style", "textarea", "title", "xmp", "iframe", "noembed", "noframes"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
BLOCK = {
    "address", "article", "aside", "blockquote", "body", "br", "caption", "dd", "details", "dialog", "div", "dl", "dt", "fieldset", "figcaption", "figure",
    "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "head", "header", "hr", "html", "legend", "li", "main", "menu", "nav", "ol", "option", "p", "pre",
    "section", "select", "summary", "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul",
}
HARD = {"nav", "aside", "footer", "menu", "head", "select", "button", "noscript", "template", "svg", "dialog", "canvas", "object", "audio", "video"}
CLOSES_P = BLOCK - {"br"}
SELF_CLOSING = {"li", "dd", "dt", "option", "td", "th", "tr"}
NEVER_NAMED = {"html", "body", "main", "article", "h1", "h2", "h3", "h4", "h5", "h6"}
#: what names an element that is not the article: a word of its class or id whose hyphenated parts are all of these and fillers
NAMES = {
    "ad", "ads", "advert", "adverts", "advertisement", "advertising", "banner", "breadcrumb", "breadcrumbs", "comment", "comments", "consent", "cookie", "cookies",
    "copyright", "disqus", "footer", "gdpr", "login", "masthead", "menu", "menubar", "modal", "nav", "navbar", "navigation", "newsletter", "notice", "notification",
    "pager", "pagination", "popup", "promo", "promotion", "replies", "respond", "sidebar", "signup", "sponsor", "sponsored", "subscribe", "toolbar", "widget",
}
FILLERS = {
    "area", "bar", "block", "body", "bottom", "box", "col", "column", "container", "content", "desktop", "global", "group", "header", "inner", "item", "items", "label",
    "left", "list", "main", "mobile", "outer", "page", "panel", "primary", "right", "row", "secondary", "section", "site", "slot", "text", "top", "unit", "wrap",
    "wrapper", "zone",
}
READERS = {"comment", "comments", "disqus", "replies", "respond"}
ROLES = {"navigation", "complementary", "contentinfo", "banner", "search", "dialog", "alert", "menu", "menubar", "toolbar"}
ATTRIBUTE = re.compile(r"""\b(class|id|role|hidden|aria-hidden)\b(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.I)
PARTS = re.compile(r"[-_\d]+")
SPACE = re.compile(r"\s+")
#: of a block: in an article, in no such element, in an article within a form or a part named otherwise, in a form, in such a part, no content at all
CONTENT, OPEN, LIFTED, FORM, NAMED, CHROME = 5, 4, 3, 2, 1, 0
REACH = 8  # neighbours on either side of a page in its host's order, and how many of them are its witnesses
COPY, IN_ARTICLE = 0.8, 0.5  # of both pages' words that are shared: from there on a page is a copy and no witness
SPAN = 512  # pages that are compared in one group


def _named(tag: str, attributes: str) -> int | None:
    """NAMED or CHROME, if attributes name the element as no article; what is hidden or a reader's comment holds no article either."""
    if tag in NEVER_NAMED or not attributes:
        return None
    for name, value in ATTRIBUTE.findall(attributes):
        name, value = name.lower(), value.strip("\"'").lower()
        if name == "hidden" or (name == "aria-hidden" and value == "true"):
            return CHROME
        if name == "role" and value in ROLES:
            return NAMED
        if name in ("class", "id"):
            for word in value.split():
                found = [x for x in PARTS.split(word) if x]
                if not NAMES.isdisjoint(found) and all(x in NAMES or x in FILLERS for x in found):
                    return NAMED if READERS.isdisjoint(found) else CHROME
    return None


class _Open:
    """The open elements, with the places of each tag and of the blocks among them."""

    def __init__(self):
        self.stack: list[tuple[str, int, bool]] = []
        self.places: dict[str, list[int]] = {}
        self.blocks: list[int] = []

    def push(self, tag: str, kind: int, inside: bool) -> None:
        self.places.setdefault(tag, []).append(len(self.stack))
        if tag in BLOCK:
            self.blocks.append(len(self.stack))
        self.stack.append((tag, kind, inside))

    def last(self, tag: str) -> int:
        at = self.places.get(tag)
        return at[-1] if at else -1

    def block_after(self, at: int) -> bool:
        return bool(self.blocks) and self.blocks[-1] > at

    def cut(self, at: int) -> None:
        while len(self.stack) > at:
            tag = self.stack.pop()[0]
            self.places[tag].pop()
            if tag in BLOCK:
                self.blocks.pop()

    @property
    def kind(self) -> int:
        return self.stack[-1][1] if self.stack else OPEN

    @property
    def inside(self) -> bool:
        return bool(self.stack) and self.stack[-1][2]


def blocks(html: str) -> list[tuple[int, str]]:
    """The page's text blocks in order as (kind, text). Character references are decoded, white space inside a block is one
    space. Elements that are left open end with their parents, as browsers do; a cut-off tag is markup."""
    out: list[tuple[int, str]] = []
    parts: list[str] = []
    elements = _Open()
    at, n = 0, len(html)

    def flush() -> None:
        if parts:
            text = SPACE.sub(" ", unescape("".join(parts))).strip()
            if text:
                out.append((elements.kind, text))
            parts.clear()

    while at < n:
        m = TAG.search(html, at)
        if m is None:
            parts.append(html[at:])
            break
        if m.start() > at:
            parts.append(html[at : m.start()])
        at = m.end()
        tag = (m.group(2) or "").lower()
        if not tag:
            continue
        if m.group(1):
            place = elements.last(tag)
            if place < 0:
                if tag == "p":
                    flush()
            elif tag in BLOCK or not elements.block_after(place):  # an inline end does not close blocks
                if tag in BLOCK or (elements.stack[place - 1][1] if place else OPEN) != elements.kind:
                    flush()
                elements.cut(place)
            continue
        attributes = m.group(3) or ""
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}\b", re.I).search(html, at)
            at = n if end is None else end.start()
            close = TAG.match(html, at)
            at = close.end() if close else n
            continue
        p = elements.last("p") if tag in CLOSES_P else -1
        if p >= 0 and not elements.block_after(p):
            flush()
            elements.cut(p)
        if tag in SELF_CLOSING and elements.stack and elements.stack[-1][0] == tag:
            flush()
            elements.cut(len(elements.stack) - 1)
        if tag in BLOCK:
            flush()
        if tag in VOID:
            continue
        now, article = elements.kind, tag in ("article", "main")
        if tag in HARD or (tag == "header" and not elements.inside):
            now = CHROME
        elif article and not elements.inside and now == OPEN:
            now = CONTENT
        elif article and not elements.inside and now in (FORM, NAMED):
            now = LIFTED
        elif tag == "form" or (named := _named(tag, attributes)) is not None:
            now = CHROME if now in (CONTENT, LIFTED) else min(now, FORM if tag == "form" else named)
        if now != elements.kind:
            flush()
        elements.push(tag, now, elements.inside or article)
    flush()
    return out


def lines_of(html: str | None) -> tuple[bool, list[str]]:
    """(whether elements name the article, its lines): the blocks of the articles; else of articles within parts named otherwise; else those
    that no element decides; else those of forms."""
    found = blocks(html) if html else []
    for kind in (CONTENT, LIFTED, OPEN, FORM):
        if mine := [t for k, t in found if k == kind]:
            return kind in (CONTENT, LIFTED), mine
    return False, []


def line_keys(lines: list[str]) -> list[int]:
    """Of each line 48 bits of its hash, above its number of words."""
    return [(xxhash.xxh3_64_intdigest(t) >> 16 << 16 | min(t.count(" ") + 1, 0xFFFF)) - (1 << 63) for t in lines]


def common_lines(one: list[int], two: list[int]) -> list[int]:
    """Positions in one of a longest common subsequence of one and two, by bit-parallel rows: row i has a bit for every place
    of two where the subsequence does not grow."""
    where: dict[int, int] = {}
    for j, h in enumerate(two):
        where[h] = where.get(h, 0) | (1 << j)
    full = (1 << len(two)) - 1
    rows, v = [], full
    for h in one:
        u = v & where.get(h, 0)
        v = ((v + u) | (v - u)) & full
        rows.append(v)
    out, j = [], len(two) - 1
    for i in range(len(one) - 1, -1, -1):
        # walk back to the place where the length last grew
        while j >= 0 and rows[i] >> j & 1:
            j -= 1
        if j < 0:
            break
        before = rows[i - 1] if i else full
        if before >> j & 1:
            out.append(i)
            j -= 1
    return out[::-1]


def template_lines(lines: list[int], decided: bool, others: list[list[int]]) -> list[int]:
    """Positions of the lines that the page has from its host's template, by the pages of the nearest URLs.

    The longest common subsequence with each is what both share. A page that shares nearly all words is a copy and says nothing about the
    template. A line that at least half of the other witnesses share goes; in an article that elements name only if there are REACH
    witnesses and all of them share it, as articles may have passages in common."""
    words = [x & 0xFFFF for x in lines]
    votes, witnesses = [0] * len(lines), 0
    for other in others:
        both = common_lines(lines, other)
        shared = sum(words[i] for i in both)
        if shared >= (IN_ARTICLE if decided else COPY) * max(sum(words), sum(x & 0xFFFF for x in other)):
            continue
        witnesses += 1
        for i in both:
            votes[i] += 1
    if not witnesses or (decided and witnesses < REACH):
        return []
    return [i for i, v in enumerate(votes) if (v == witnesses if decided else 0 < witnesses <= 2 * v)]


def main_text(html: str | None, template: list[int] | None) -> str:
    """The lines of the article less those of the template, joined by a space."""
    gone = set(() if template is None else template)
    return " ".join(t for i, t in enumerate(lines_of(html)[1]) if i not in gone)


def host(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^[a-zA-Z][\w+.-]*://(?:[^/@?#]*@)?([^/?#:]*)", 1))


def path(url: Column) -> Column:
    return F.regexp_replace(F.regexp_extract(url, r"^[a-zA-Z][\w+.-]*://[^/?#]*([^?#]*)", 1), r"(?:\.html?|/)+$", "")


def _rank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    part, at = TaskContext.get().partitionId(), 0
    for batch in batches:
        n = batch.num_rows
        yield pa.RecordBatch.from_arrays(
            [*batch.columns, pa.array(np.full(n, part, np.int32)), pa.array(np.arange(at, at + n))], names=[*batch.schema.names, "part", "i"])
        at += n


def _common_prefix(one: list[str], two: list[str]) -> int:
    n = 0
    while n < min(len(one), len(two)) and one[n] == two[n]:
        n += 1
    return n


def _differences(span: int):
    """(k, gone) of the pages of one span, from all pages within REACH of them: the nearest URLs have the longest common path."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("rank", ignore_index=True)
        hosts, paths, lines = rows["h"].tolist(), [p.split("/") for p in rows["p"]], [x.tolist() for x in rows["lines"]]
        out = []
        for i in np.flatnonzero((rows["rank"] // span == rows["span"]).to_numpy()):
            near = [j for j in range(max(0, i - REACH), min(len(rows), i + REACH + 1)) if j != i and hosts[j] == hosts[i]]
            near.sort(key=lambda j, i=i: (-_common_prefix(paths[i], paths[j]), abs(j - i), j))
            gone = template_lines(lines[i], rows["decided"].iat[i], [lines[j] for j in near[:REACH]])
            if gone:
                out.append((rows["k"].iat[i], gone))
        return pd.DataFrame(out, columns=["k", "gone"])

    return run


def extract(df: DataFrame, key: str, url: str, html: str) -> DataFrame:
    """df with text (string, empty if none) and n_chars (long).

    Elements give the lines that may be the article: those of article and main elements, less the parts in them that are
    menus, notices, adverts, forms or comments by tag or name; where no element names the article, all lines outside such
    parts. Then the pages of a host are ordered by URL path (ties by key, then by page), and each is compared with the REACH
    nearest URLs of its host around it, those with the longest common path: the longest common subsequence of lines shows
    what both share, and what at least half of them share is the host's template and is deleted (see template_lines, also for pages
    that are copies and for articles that elements name).

    Only hashes of lines are ordered and compared; pages are ranked by a range sort and compared in spans of SPAN ranks, to which the REACH
    pages around them come too, so a host of any size is spread. A page's html is read where it lies.

    Null html and html without text give the empty text; a null or relative url is its own host "" with an empty path; null and repeated
    keys stay rows of their own (rows equal in key, url and html get equal results and count as one page); an empty table stays empty.
    Columns of df named text or n_chars are replaced, unless they are the input.
    """
    spark = df.sparkSession
    u = F.coalesce(F.col(url), F.lit(""))
    page = F.xxhash64(F.col(key), u, F.col(html))
    base = df.select(page.alias("k"), host(u).alias("h"), path(u).alias("p"), F.col(html).alias("html"))

    def lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [lines_of(x) for x in batch.column(3).to_pylist()]
            some = pa.array([i for i, (_, x) in enumerate(found) if x], pa.int64())
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(i).take(some) for i in range(3)], pa.array([d for d, x in found if x], pa.bool_()), pa.array([line_keys(x) for _, x in found if x], pa.list_(pa.int64()))],
                names=["k", "h", "p", "decided", "lines"])

    fields = "k long, h string, p string, decided boolean, lines array<long>"
    found = materialise(base.mapInArrow(lines, fields).dropDuplicates(["k"]), "lines")
    order = found.repartitionByRange(shuffle_partitions(spark), "h", "p", "k").sortWithinPartitions("h", "p", "k")
    order = materialise(order.mapInArrow(_rank, f"{fields}, part int, i long"), "order")
    sizes = order.groupBy("part").agg(F.max("i").alias("top"))
    sizes = sizes.select("part", (F.sum(F.col("top") + 1).over(Window.orderBy("part")) - F.col("top") - 1).alias("base"))
    ranked = order.join(F.broadcast(sizes), "part").withColumn("rank", F.col("base") + F.col("i"))  # a row a partition
    spans = F.array_distinct(F.transform(F.array(*map(F.lit, (-REACH, 0, REACH))), lambda x: F.floor((F.col("rank") + x) / SPAN)))
    ranked = ranked.select("k", "h", "p", "decided", "lines", "rank", F.explode(spans).alias("span"))
    gone = ranked.groupBy("span").applyInPandas(_differences(SPAN), "k long, gone array<int>")
    kept = [c for c in df.columns if c not in {"text", "n_chars"} - {html}]
    row = df.select(page.alias("k"), F.struct(*kept).alias("row"))  # one struct: no name of the caller's can clash
    out = row.join(gone, "k", "left").select("row.*", F.col("gone").alias(*fresh(kept, "gone")))
    at, names = kept.index(html), [*kept, "text", "n_chars"]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*kept).schema) + ", text string, n_chars long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(x, s) for x, s in zip(batch.column(at).to_pylist(), batch.column(len(kept)).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(kept)], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=names)

    return out.mapInArrow(run, schema)


def op1(pages: DataFrame) -> DataFrame:
    return extract(pages.select("page_id", "url", "html"), "page_id", "url", "html").drop("html")
