"""Main-text extraction with host-wide consensus on container paths.

1. Every page is parsed into containers; paragraphs give points to their container and half of them to the one around
   it, less the share of linked text. The page votes for the generalised tag-class path of its best container.
2. Votes are added up by host and path in Spark (partial sums, so a hot host is no group); a host's winning paths are
   those with the most votes.
3. Pages are extracted again from the containers on the winning paths of their host; a page that has none of them uses
   its own best container. The article or main around such a container is taken whole, or else the lowest container that
   holds text beside it.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common
from . import words as W

#: Names of HTML.
_RAW = "script|style|noscript|template|iframe|svg|object|canvas|textarea|select|title|video|audio|math"
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6"
    " head header hgroup hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
_CONTAINERS = frozenset("article body div main section td blockquote center".split())
_BOILER_TAGS = frozenset("aside button dialog footer head header label menu nav".split())
#: Raw elements whose content is never text, however they end.
_CODE = frozenset(("script", "style"))
#: What one start tag ends: itself left open, up to the element that bounds it.
_ENDS = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"table", "tr"}), "th": ({"td", "th"}, {"table", "tr"})}
#: Words in classes, ids and roles that mark what is no article.
_BOILER_WORDS = frozenset(
    "ad ads advert advertisement advertising adverts banner breadcrumb breadcrumbs comment comments complementary consent contentinfo cookie cookies copyright"
    " discussion disqus footer form gdpr header legal login masthead menu modal nav navbar navigation newsletter notice notices pager pagination popup promo"
    " promotion related replies reply responses search share sharing sidebar signup skip social sponsor sponsored subscribe subscription toolbar widget"
    # The commonest of these in German, French, Spanish and Italian pages.
    " anzeige anzeigen fusszeile kommentar kommentare kopfzeile seitenleiste suche werbung commentaire commentaires publicite recherche anuncio anuncios buscar"
    " comentario comentarios pie publicidad commenti commento pubblicita".split()
)
#: Those that mark what readers write. Such an element is no article, however long it is.
_READER_WORDS = frozenset("comentario comentarios comment commentaire commentaires commenti commento comments discussion disqus kommentar kommentare replies reply responses".split())
#: Words that may stand beside those in a token that marks; any other, as in has-sidebar or social-science, makes it none.
_LAYOUT_WORDS = frozenset(
    "area articles bar block body bottom box btn button buttons col column container content count global group icon icons inner item items left link links list main media"
    " mobile module outer page panel post posts primary region respond right row secondary section site slot stories sub text reader readers thread title tools top unit user users visitor visitors wrap wrapper zone".split()
)
_RAW_END = {tag: re.compile(rf"</{tag}\s*>", re.I) for tag in _RAW.split("|")}
_TAG = re.compile(r"<(?:!--|(?P<end>/?)(?P<tag>[a-zA-Z][a-zA-Z0-9:-]*)(?P<attrs>(?:\s(?:[^>\"']|\"[^\"]*\"|'[^']*')*)?)>|(?P<odd>[a-zA-Z/!?][^>]*(?:>|\Z)))", re.S)
_ATTR = re.compile(r"(?:^|\s)(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_PART = re.compile(r"[A-Za-z][a-z]*|[A-Z]+")


@dataclass
class Page:
    """Elements in page order, and the text blocks: (element, text, linked characters)."""

    tags: list[str] = field(default_factory=list)
    labels: list[str] = field(default_factory=list)
    parents: list[int] = field(default_factory=list)
    boiler: list[bool] = field(default_factory=list)
    blocks: list[tuple[int, str, int]] = field(default_factory=list)

    def path(self, i: int) -> str:
        out = []
        while i >= 0:
            out.append(self.labels[i])
            i = self.parents[i]
        return ">".join(reversed(out))


def _label(tag: str, attrs: str) -> tuple[str, bool, bool]:
    """The generalised tag-class label, whether the attributes mark boilerplate, and whether they mark what readers write."""
    if not attrs:
        return tag, False, False
    label, marked, readers = [tag], False, False
    for name, a, b, c in _ATTR.findall(attrs):
        value = a or b or c
        for token in value.split():
            parts = {p.lower() for p in _PART.findall(token)}
            if parts & _BOILER_WORDS and all(len(p) == 1 or p in _BOILER_WORDS or p in _LAYOUT_WORDS for p in parts):
                marked, readers = True, readers or bool(parts & _READER_WORDS)
            if name.lower() == "class":
                label.append(re.sub(r"\d+", "#", token.lower()).replace(">", "_"))
    return ".".join([label[0], *sorted(set(label[1:]))]), marked, readers


class _Open:
    """The open elements, with the places of each tag among them, so that no search walks the stack."""

    def __init__(self, page: Page) -> None:
        self.page = page
        self.stack: list[int] = []
        self.places: dict[str, list[int]] = {}
        self.blocks: list[int] = []

    def last(self, tag: str) -> int:
        """The place of the innermost open element of a tag, -1 if there is none."""
        at = self.places.get(tag)
        return at[-1] if at else -1

    def push(self, i: int) -> None:
        tag = self.page.tags[i]
        self.places.setdefault(tag, []).append(len(self.stack))
        if tag in _BLOCK:
            self.blocks.append(len(self.stack))
        self.stack.append(i)

    def close(self, k: int) -> None:
        """Ends the element at place k and all inside it; every element is ended once."""
        for i in self.stack[k:]:
            self.places[self.page.tags[i]].pop()
        while self.blocks and self.blocks[-1] >= k:
            self.blocks.pop()
        del self.stack[k:]


def parse(text: str) -> Page:
    """Elements and blocks of a page; unclosed and misnested tags end where HTML ends them, as far as blocks go.

    The time is in proportion to the page, however deep it nests and whatever its end tags match.
    """
    page = Page()
    opened = _Open(page)
    chunks: list[str] = []
    by_tag: list[bool] = []
    by_class: list[bool] = []
    by_readers: list[bool] = []
    endless: set[str] = set()  # raw elements that nothing ends from here on
    linked = 0

    def flush() -> None:
        nonlocal linked
        if chunks:
            joined = " ".join(html.unescape("".join(chunks)).split())
            if joined:
                page.blocks.append((opened.stack[-1] if opened.stack else -1, joined, min(linked, len(joined))))
            chunks.clear()
        linked = 0

    at, n = 0, len(text)
    while at < n:
        m = _TAG.search(text, at)
        if m is None:
            chunks.append(text[at:])
            break
        if m.start() > at:
            chunks.append(text[at : m.start()])
            if opened.last("a") >= 0:
                linked += m.start() - at
        tag = m["tag"]
        if tag is None:
            if m[0] == "<!--":
                end = text.find("-->", m.end())
                at = n if end < 0 else end + 3
            else:
                at = m.end()
            continue
        at = m.end()
        tag = tag.lower()
        if m["end"]:
            if tag in _BLOCK:
                flush()
            if opened.last(tag) >= 0:
                opened.close(opened.last(tag))
            continue
        if tag in _RAW_END:
            chunks.append(" ")
            if tag in ("svg", "math") and m["attrs"].endswith("/"):
                continue
            end = None if tag in endless else _RAW_END[tag].search(text, at)
            if end is not None:
                at = end.end()
            elif tag in _CODE:
                at = n
            else:  # without an end tag it ends where it starts, or the rest of the page would go
                endless.add(tag)
            continue
        if tag in _VOID:
            if tag == "hr":
                flush()
            else:
                chunks.append(" " if tag == "br" else "")
            continue
        if tag in _BLOCK:
            flush()
            if opened.blocks and opened.last("p") == opened.blocks[-1]:  # a block ends an open paragraph
                opened.close(opened.blocks[-1])
            ends, bounds = _ENDS.get(tag, ((), ()))
            if ends:
                inner = max(opened.last(x) for x in ends)
                if inner > max(opened.last(x) for x in bounds):
                    opened.close(inner)
            if tag == "body":
                opened.close(1 if opened.stack and page.tags[opened.stack[0]] == "html" else 0)
        label, marked, readers = _label(tag, m["attrs"])
        # A heading group inside an article belongs to it.
        inside = tag == "header" and max(opened.last("article"), opened.last("main")) >= 0
        page.tags.append(tag)
        page.labels.append(label)
        page.parents.append(opened.stack[-1] if opened.stack else -1)
        by_tag.append(tag in _BOILER_TAGS and not inside)
        # A form may hold a whole page, so it is judged like a marked element.
        by_class.append(tag == "form" or marked and tag not in ("html", "body", "article", "main"))
        by_readers.append(readers and by_class[-1])
        opened.push(len(page.tags) - 1)
    flush()
    page.boiler = _boilerplate(page, by_tag, by_class, by_readers)
    return page


def _inherited(page: Page, own: list[bool]) -> list[bool]:
    """True for the marked elements and all inside them. An element's parent comes before it."""
    out: list[bool] = []
    for parent, mark in zip(page.parents, own, strict=True):
        out.append(mark or (parent >= 0 and out[parent]))
    return out


def _gathered(page: Page, own: list[int]) -> list[int]:
    """The sums over every element and all inside it."""
    out = list(own)
    for i in range(len(out) - 1, -1, -1):
        if page.parents[i] >= 0:
            out[page.parents[i]] += out[i]
    return out


def _boilerplate(page: Page, by_tag: list[bool], by_class: list[bool], by_readers: list[bool]) -> list[bool]:
    """Elements in boilerplate. Marks by class are not those of wrappers around a main, or around the largest article if no
    article or main is outside them. After that a marked element is judged by its text too: while one holds more than ten
    times the unlinked text that would be left of the articles and mains around it (of the page, if it has neither), it and
    what is around it are no boilerplate; but what readers write stays out at any length."""
    hard = _inherited(page, by_tag)
    if not any(by_class):
        return hard
    direct = [0] * len(page.tags)  # unlinked characters outside boilerplate tags
    for i, text, linked in page.blocks:
        if i >= 0 and not hard[i]:
            direct[i] += len(text) - linked
    plain = _gathered(page, direct)
    own = [a or b for a, b in zip(by_tag, by_class, strict=True)]

    def lift(i: int) -> None:
        while i >= 0:
            own[i] = by_tag[i]
            i = page.parents[i]

    named = [i for i, tag in enumerate(page.tags) if tag in ("article", "main") and plain[i]]
    lifted = [False] * len(page.tags)
    for i in named:
        if page.tags[i] == "main":
            lifted[i] = True
    for i, yes in enumerate(_gathered(page, [int(x) for x in lifted])):
        if yes:
            own[i] = by_tag[i]
    boiler = _inherited(page, own)
    if named and all(boiler[i] for i in named):
        lift(max(named, key=lambda i: (plain[i], -i)))
        boiler = _inherited(page, own)
    around = {i for i in named if not boiler[i]}
    kept = _within(page, around) if named else [True] * len(own)
    nearest: list[int] = []  # of every element: itself or the closest one around it that is marked
    for i, parent in enumerate(page.parents):
        nearest.append(i if own[i] else nearest[parent] if parent >= 0 else -1)
    free = [0] * len(own)  # unlinked characters by the marked element that leaves them out
    outside = sum(len(t) - linked for i, t, linked in page.blocks if i < 0) if not named else 0
    for i, amount in enumerate(direct):
        if nearest[i] >= 0:
            free[nearest[i]] += amount
        elif kept[i]:
            outside += amount
    # What is around an element holds no less than it and comes first, so one lifted has no marked one around it.
    readers = _inherited(page, [r and o for r, o in zip(by_readers, own, strict=True)])
    for i in sorted((i for i in range(len(own)) if own[i] and not by_tag[i] and kept[i] and not readers[i]), key=lambda i: (-plain[i], i)):
        if plain[i] <= 10 * outside:
            break
        own[i] = False
        outside += free[i]
    return _inherited(page, own)


def best_container(page: Page) -> tuple[int, float]:
    """The container with the most points, -1 if there is no text outside boilerplate."""
    nearest: list[int] = []  # of every element: itself or the closest one around it that is a container
    for i, parent in enumerate(page.parents):
        nearest.append(i if page.tags[i] in _CONTAINERS else nearest[parent] if parent >= 0 else -1)
    points: dict[int, float] = {}
    size, links = [0] * len(page.tags), [0] * len(page.tags)
    for i, text, linked in page.blocks:
        if i < 0 or page.boiler[i]:
            continue
        size[i] += len(text)
        links[i] += linked
        j = nearest[i]
        if j >= 0:
            worth = 1 + text.count(",") * 0.2 + min(len(text) / 100, 3)
            points[j] = points.get(j, 0.0) + worth
            k = nearest[page.parents[j]] if page.parents[j] >= 0 else -1
            if k >= 0:
                points[k] = points.get(k, 0.0) + worth * 0.5
    size, links = _gathered(page, size), _gathered(page, links)
    best = max(points, key=lambda j: (points[j] * (1 - links[j] / max(1, size[j])), -j), default=-1)
    return best, 0.0 if best < 0 else points[best] * (1 - links[best] / max(1, size[best]))


def _within(page: Page, chosen: set[int]) -> list[bool]:
    return _inherited(page, [i in chosen for i in range(len(page.tags))])


def _whole(page: Page, chosen: set[int]) -> set[int]:
    """For each of these containers the outermost article or main around it, or else the lowest container in which, beside
    them and outside boilerplate, is more unlinked than linked text; itself if there is neither."""
    inside = _within(page, chosen)
    direct = [0] * len(page.tags)
    for i, text, linked in page.blocks:
        if i >= 0 and not page.boiler[i] and not inside[i]:
            direct[i] += len(text) - 2 * linked
    beside = _gathered(page, direct)
    named: list[int] = []  # the outermost article or main around every element
    lowest: list[int] = []  # itself or the closest one around it with text beside
    for i, parent in enumerate(page.parents):
        around = named[parent] if parent >= 0 else -1
        named.append(around if around >= 0 else i if page.tags[i] in ("article", "main") else -1)
        lowest.append(i if beside[i] > 0 else lowest[parent] if parent >= 0 else -1)
    return {named[i] if named[i] >= 0 else lowest[i] if lowest[i] >= 0 else i for i in chosen}


def _on_path(page: Page, path: str) -> set[int]:
    """The elements on a path outside boilerplate."""
    labels = path.split(">")
    met: list[int] = []  # how many labels of the path lead to every element, 0 if it is off the path
    for label, parent in zip(page.labels, page.parents, strict=True):
        k = met[parent] if parent >= 0 else 0
        met.append(k + 1 if (k or parent < 0) and k < len(labels) and labels[k] == label else 0)
    return {i for i, k in enumerate(met) if k == len(labels) and not page.boiler[i]}


def extract(text: str, paths: list[str]) -> str:
    """The text of the containers on the first of these paths that the page has, else of its own best container, each
    with what belongs to it."""
    page = parse(text)
    chosen: set[int] = set()
    for path in paths:
        chosen = _on_path(page, path)
        inside = _within(page, chosen) if chosen else []
        if chosen and any(i >= 0 and inside[i] for i, *_ in page.blocks):
            break
        chosen = set()
    if not chosen:
        own, _ = best_container(page)
        if own < 0:  # no container at all
            return "\n".join(t for i, t, _ in page.blocks if i < 0 or not page.boiler[i])
        chosen = {own}
    inside = _within(page, _whole(page, chosen))
    return "\n".join(t for i, t, _ in page.blocks if i >= 0 and not page.boiler[i] and inside[i])


def with_host(pages: DataFrame, name: str = "host") -> DataFrame:
    """The host in lower case without port and user; a url without one, or null, has the host ''."""
    host = F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))
    return pages.withColumn(name, host)


def host_paths(pages: DataFrame, most: int = 5, share: float = 0.05) -> DataFrame:
    """(host, paths): up to `most` winning paths, those with at least `share` of their host's votes, best first.

    A page's vote weighs its best container's points, 20 at most. Pages of a host with more templates than that lose
    nothing: where none of the winning paths leads to text, a page's own best container is taken.
    """
    schema = T.StructType([T.StructField("host", T.StringType()), T.StructField("path", T.StringType()), T.StructField("points", T.DoubleType())])

    def vote(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        hosts, paths, points = [], [], []
        for host, text in zip(batch.column("host").to_pylist(), batch.column("html").to_pylist(), strict=True):
            page = parse(text or "")
            i, p = best_container(page)
            if i >= 0:
                hosts.append(host)
                paths.append(page.path(i))
                points.append(min(p, 20.0))
        yield pa.RecordBatch.from_arrays([pa.array(hosts, pa.string()), pa.array(paths, pa.string()), pa.array(points, pa.float64())], schema.names)

    votes = common.arrow_map(with_host(pages.select("url", "html")).select("host", "html"), vote, schema)
    # Rounded to whole thousandths, so that sums do not depend on their order.
    totals = votes.groupBy("host", "path").agg(F.sum(F.round(F.col("points") * 1000).cast("long")).alias("votes"))
    host = Window.partitionBy("host")
    ranked = totals.withColumn("rank", F.row_number().over(host.orderBy(F.desc("votes"), "path"))).withColumn("all", F.sum("votes").over(host))
    kept = ranked.filter((F.col("rank") <= most) & (F.col("votes") >= share * F.col("all")))
    return kept.groupBy("host").agg(F.sort_array(F.collect_list(F.struct("rank", "path"))).alias("x")).select("host", F.col("x.path").alias("paths"))


def extract_pages(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) for every row of pages(page_id, url, html).

    A null html or one without main text gives an empty text; a null url votes with the other urls without a host. Pages
    of any length and nesting are read whole, in time in proportion to their length. Repeated rows are extracted alike;
    other columns play no part; an empty table gives an empty table.
    """
    pages = pages.select("page_id", "url", "html")
    winners = common.written(host_paths(pages), "paths")  # its size on disk decides how it is joined
    rows = with_host(pages).join(winners, "host", "left").select("page_id", "url", "html", "paths")
    schema = T.StructType([pages.schema["page_id"], pages.schema["url"], T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for part in W.batches(batch, "html"):
            texts = [extract(t or "", p or []) for t, p in zip(part.column("html").to_pylist(), part.column("paths").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([part.column("page_id"), part.column("url"), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], schema.names)

    return common.arrow_map(rows, run, schema)
