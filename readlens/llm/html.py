"""Main text of web pages by site template removal.

Every page is parsed into a tree, once.  Each element subtree that stands around text of the page (a ``div``, ``nav``,
``section``, list, table and so on anywhere; any block at all, a paragraph or heading too, outside the article) is hashed
with all that it contains, unless it holds the article itself; Spark counts, per host, on how many pages each hash occurs;
what recurs on ``MIN_PAGES`` pages of its host is a template and is deleted wherever it occurs on that host, however large
the host.  Boxes whose tag, class, id or role says what they are (menus, headers, footers, sidebars, notices, adverts,
forms, comments) go as well, so that hosts with few pages come out clean too.  Pages of a host with equal main text count
once, so that a box around the text of copies isn't taken for a template.  Prose in an article (paragraphs, headings,
quotations) is never a template: copies of one article on a host stay whole.

What is left of the article (of the main element, or the body, where there is no article) is the text: character
references decoded, white space inside a block turned into one space, blocks joined by one space.

The parsed pages are written to the shared folder, and all that follows reads them.  Hashes travel as (host, hash, page
content) rows, counted before they are shuffled; templates meet the segments they stand around as (host, hash) rows in an
ordinary join, and only segment numbers come back, so nothing of a host is ever held together.  Pages whose
text stands in no such element take no part in it.

Cases: null and empty html give an empty text; a null or odd url is a host of its own; malformed markup is repaired as
far as nesting goes (unclosed elements end with their parent); a page of any length is parsed whole, in one pass over
its markup; equal rows are pages of their own; an empty table gives
no rows; further columns are ignored."""

from __future__ import annotations

import hashlib
import html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from readlens.llm.common import frees, only, stored

#: An element subtree is a template of its host if it occurs on so many pages with different main texts.
MIN_PAGES = 5

# Element names by what they mean for the text.
BOXES = frozenset("div section nav ul ol dl table aside footer header form figure menu details fieldset".split())
BLOCKS = BOXES | frozenset("p h1 h2 h3 h4 h5 h6 li dt dd blockquote pre article main body html head tr td th thead tbody "
                           "tfoot caption figcaption address hr br title summary hgroup center".split())
WHOLE = frozenset("article main body html".split())  # never templates themselves
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe xmp".split())
DROPPED = frozenset("script style noscript template head title nav aside footer form button select textarea iframe svg "
                    "canvas object dialog menu option audio video".split())
#: Words of a class, id or role that name something other than the article.
NAMED = frozenset("ad ads advert adverts advertisement advertising adsense banner sponsor sponsored promo promotion nav "
                  "navbar navigation menu breadcrumb breadcrumbs sidebar aside cookie cookies consent gdpr notice popup "
                  "modal overlay newsletter subscribe subscription share sharing social comment comments disqus footer "
                  "related recommended toolbar login signup search pagination pager skip complementary contentinfo".split())
OUTER = frozenset("header masthead".split())  # only outside the article
SCOPES = frozenset("article main body section td th nav aside footer header form".split())

_MARKUP = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(?P<end>/)?(?P<tag>[a-zA-Z][^\s/>]*)(?P<attrs>(?:[^>\"']|\"[^\"]*(?:\"|\Z)|'[^']*(?:'|\Z))*)(?:>|\Z)", re.DOTALL)
_NAMES = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.IGNORECASE)
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")
_RAW_END = {t: re.compile(f"</{t}\\s*>", re.IGNORECASE) for t in RAW}
_HOST = re.compile(r"^[a-zA-Z][\w+.-]*://(?:[^/?#@]*@)?([^/?#:]*)")


class _Open:
    """An element that is open: what closes with it."""

    __slots__ = ("tag", "dropped", "box", "parts", "holds", "kind")

    def __init__(self, tag: str, dropped: bool, box: bool, kind: str):
        self.tag, self.dropped, self.box, self.parts, self.holds, self.kind = tag, dropped, box, [], False, kind


class Page:
    """``segments``: (text, indices of the boxes around it, container kind) in page order; ``boxes``: their hashes."""

    def __init__(self, markup: str):
        self.segments: list[tuple[str, tuple[int, ...], str]] = []
        self.boxes: list[int | None] = []
        self._stack: list[_Open] = []
        self._box_ids: list[int] = []
        self._text: list[str] = []
        self._dropped = 0
        self._kinds: list[str] = [""]
        self._read(markup)

    # -- tree ------------------------------------------------------------------
    def _flush(self) -> None:
        if not self._text:
            return
        text = " ".join("".join(self._text).split())
        self._text.clear()
        if not text:
            return
        for e in reversed(self._stack):
            if e.box:
                e.parts.append(text)
                break
        if not self._dropped:
            self.segments.append((text, tuple(self._box_ids), self._kinds[-1]))

    def _names(self, attrs: str) -> set[str]:
        words: set[str] = set()
        for _, a, b, c in _NAMES.findall(attrs):
            words.update(w.lower() for w in re.split(r"[^a-zA-Z]+", _CAMEL.sub(" ", a or b or c)))
        return words

    def _open(self, tag: str, attrs: str) -> None:
        names = self._names(attrs) if attrs and "=" in attrs else set()
        kind = "article" if tag == "article" else "main" if tag == "main" or "main" in names and "role" in attrs.lower() else ""
        inside = any(k == "article" for k in self._kinds)
        dropped = tag in DROPPED or bool(names & NAMED) and tag not in ("body", "html") \
            or not inside and (tag == "header" or bool(names & OUTER) and tag not in ("body", "html"))
        box = tag in BOXES or not inside and not kind and tag in BLOCKS and tag not in WHOLE
        if dropped:
            self._flush()
        e = _Open(tag, dropped, box, kind)
        if box:
            e.parts += [tag, " ".join(sorted(names))]
            self._box_ids.append(len(self.boxes))
            self.boxes.append(None)
        if kind:
            for x in self._stack:
                x.holds = True
            self._kinds.append("article" if inside else kind)
        self._dropped += dropped
        self._stack.append(e)

    def _close(self) -> None:
        if self._stack[-1].dropped or self._stack[-1].box:
            self._flush()
        e = self._stack.pop()
        self._dropped -= e.dropped
        if e.kind:
            self._kinds.pop()
        if e.box:
            at = self._box_ids.pop()
            digest = hashlib.blake2b("\x00".join(e.parts).encode("utf-8", "replace"), digest_size=8).digest()
            value = int.from_bytes(digest, "little", signed=True)
            if not e.holds:
                self.boxes[at] = value
            for x in reversed(self._stack):
                if x.box:
                    x.parts.append(str(value))
                    break

    def _close_to(self, tags: tuple[str, ...], within: frozenset) -> None:
        for at in range(len(self._stack) - 1, -1, -1):
            tag = self._stack[at].tag
            if tag in tags:
                while len(self._stack) > at:
                    self._close()
                return
            if tag in within:
                return

    def _read(self, markup: str) -> None:
        at, end = 0, len(markup)
        find = _MARKUP.search
        while at < end:
            m = find(markup, at)
            if m is None:
                self._text.append(html.unescape(markup[at:]))
                break
            if m.start() > at:
                text = markup[at: m.start()]
                self._text.append(html.unescape(text) if "&" in text else text)
            at = m.end()
            tag = m["tag"]
            if tag is None:
                continue
            tag = tag.lower()
            if tag in BLOCKS:
                self._flush()
            if m["end"]:
                if tag not in VOID:
                    self._close_to((tag,), frozenset() if tag in SCOPES else SCOPES)
                continue
            if tag in VOID:
                continue
            if tag in RAW:
                close = _RAW_END[tag].search(markup, at)
                at = close.end() if close else end
                continue
            if tag == "li":
                self._close_to(("li",), frozenset(("ul", "ol", "menu")) | SCOPES)
            elif tag in ("dt", "dd"):
                self._close_to(("dt", "dd"), frozenset(("dl",)) | SCOPES)
            elif tag in BLOCKS:
                self._close_to(("p",), SCOPES | BOXES)
            if not m["attrs"].endswith("/") or tag in BLOCKS:
                self._open(tag, m["attrs"])
        self._flush()
        while self._stack:
            self._close()

    # -- results -----------------------------------------------------------------
    def kept(self) -> list[tuple[str, list[int]]]:
        """(text, hashes of the boxes around it) of the article, or of what stands for it."""
        kinds = {k for _, _, k in self.segments}
        want = "article" if "article" in kinds else "main" if "main" in kinds else ""
        return [(t, [self.boxes[i] for i in b if self.boxes[i] is not None]) for t, b, k in self.segments if k == want]


def host_of(url: str | None) -> str:
    m = _HOST.match(url or "")
    return m[1].lower() if m else ""


def parsed(pages: DataFrame) -> DataFrame:
    """(row, page_id, url, host, content, texts, around): the segments of each page's main text and, if any stands in
    hashed elements, their hashes, the host and the hash of the whole main text."""

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hosts, contents, texts, around = [], [], [], []
            for url, markup in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                kept = Page(markup or "").kept()
                boxed = any(b for _, b in kept)
                main = [t for t, _ in kept]
                hosts.append(host_of(url) if boxed else None)
                contents.append(hashlib.blake2b("\x00".join(main).encode("utf-8", "replace"), digest_size=16).digest() if boxed else None)
                texts.append(main if boxed else [" ".join(main)])
                around.append([b for _, b in kept] if boxed else None)
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(hosts, pa.string()), pa.array(contents, pa.binary()),
                                              pa.array(texts, pa.list_(pa.string())), pa.array(around, pa.list_(pa.list_(pa.int64())))],
                                             names=["row", "page_id", "url", "host", "content", "texts", "around"])

    rows = only(pages, "page_id", "url", "html").select(F.monotonically_increasing_id().alias("row"), F.col("page_id").cast("long").alias("page_id"), "url", "html")
    return stored(rows.mapInArrow(frees(parse), "row long, page_id long, url string, host string, content binary, texts array<string>, "
                                                "around array<array<long>>"), "html-pages")


def templates(boxed: DataFrame, min_pages: int = MIN_PAGES) -> DataFrame:
    """(host, box): hashes of the element subtrees that recur on the host's pages, from ``parsed`` rows."""
    found = boxed.select("host", "content", F.explode(F.array_distinct(F.flatten("around"))).alias("box")).distinct()
    return found.groupBy("host", "box").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_pages).select("host", "box")


def extract(pages: DataFrame, min_pages: int = MIN_PAGES) -> DataFrame:
    """Per page: page_id, url, text, n_chars."""
    cut = parsed(pages)
    plain = cut.where("host is null").select("page_id", "url", F.array_join("texts", " ").alias("text"))
    boxed = cut.where("host is not null")
    inside = boxed.select("row", "host", F.posexplode("around").alias("segment", "boxes")).select("row", "host", "segment", F.explode("boxes").alias("box"))
    gone = inside.join(templates(boxed, min_pages), ["host", "box"]).groupBy("row").agg(F.collect_set("segment").alias("gone"))  # of one page
    kept = F.filter("texts", lambda t, i: ~F.coalesce(F.array_contains("gone", i), F.lit(False)))
    text = boxed.select("row", "page_id", "url", "texts").join(gone, "row", "left").select("page_id", "url", F.array_join(kept, " ").alias("text"))
    return plain.unionByName(text).select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))
