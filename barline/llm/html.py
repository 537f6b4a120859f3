"""Main text of web pages by removal of site templates.

A page is parsed to blocks and the subtrees of its block elements. Subtrees are hashed and counted by host over all
pages. A subtree is template where it recurs in many surroundings: at least `MIN_PAGES` on its host, and at least
`MIN_SHARE` as many as pages. A surrounding is told by the longest block outside the subtree, or the second longest (as
the longest may be another template), by the smallest hash of its two-word shingles, which near copies share. So what
recurs only because pages, articles or rows are copies of each other is not template, whatever the size of the host.
Inside an article, subtrees with paragraphs or headings are never template, and template never takes all of a page.

Elements that by their name, role or class hold menus, adverts, forms and the like go too, as a site's rare pages tell
no template; in pages with an article only the article's text counts.
"""

from __future__ import annotations

import html as entities
import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barline.llm.common import cut, held, slices

MIN_PAGES, MIN_SHARE, RANKS, TEMPLATES_AT_ONCE = 5, 0.25, 2, 4_000_000

#: Element names by what they mean for the main text; fixed values.
_RAW = {"script", "style", "template", "noscript", "textarea", "iframe", "noembed", "noframes", "xmp"}
_SKIP = {"head", "nav", "footer", "aside", "form", "button", "select", "option", "menu", "dialog", "svg", "math", "canvas", "object", "audio", "video", "header", "title", "fieldset", "datalist"}
_BLOCK = {"address", "article", "blockquote", "body", "caption", "center", "dd", "details", "div", "dl", "dt", "figcaption", "figure", "h1", "h2", "h3", "h4", "h5", "h6", "hgroup", "hr", "html", "li", "main", "ol", "p", "pre", "section", "summary", "table", "tbody", "tfoot", "thead", "tr", "ul"} | _SKIP
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
_PROSE = {"p", "h1", "h2", "h3", "h4", "h5", "h6", "blockquote", "pre"}
_CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "dialog", "alert", "alertdialog", "menu", "menubar", "toolbar", "form"}
_MARKS = {"ad", "ads", "advert", "adverts", "advertisement", "advertising", "banner", "breadcrumb", "breadcrumbs", "comment", "comments", "consent", "cookie", "cookies", "disqus", "footer", "gdpr", "header", "masthead", "menu", "modal", "nav", "navbar", "navigation", "newsletter", "notice", "overlay", "pagination", "pager", "popup", "promo", "promoted", "recommended", "related", "replies", "respond", "share", "sharing", "sidebar", "social", "sponsor", "sponsored", "subscribe", "toolbar", "widget"}
#: Words that leave a name's meaning as it is; any other word beside a mark makes it another name (no-sidebar, related-work).
_BESIDE = {"area", "articles", "bar", "block", "bottom", "box", "button", "buttons", "container", "content", "form", "global", "icons", "inner", "left", "links", "list", "main", "media", "outer", "page", "policy", "posts", "primary", "right", "secondary", "section", "signup", "site", "slot", "stories", "text", "thread", "top", "unit", "wrap", "wrapper"}

_TAG = re.compile(r"<!--.*?(?:-->|$)|<![^>]*>|<\?[^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:\"[^\"]*\"|'[^']*'|[^'\">])*)>", re.S)
_NAMES = re.compile(r"""(?:^|\s)(class|id|role|hidden|aria-hidden)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.I)
_PART = re.compile(r"[a-z]+|[0-9]+")


def _boilerplate(attributes: str) -> bool:
    for name, value in _NAMES.findall(attributes):
        name, value = name.lower(), value.strip("\"'").lower()
        if name == "hidden" or name == "aria-hidden" and value == "true" or name == "role" and value in _ROLES:
            return True
        if name in ("class", "id"):
            for token in value.split():
                parts = {x for x in _PART.findall(token) if not x.isdigit()}
                if parts & _MARKS and parts <= _MARKS | _BESIDE:
                    return True
    return False


def _signed(digest: int) -> int:
    return digest - (1 << 64) if digest >> 63 else digest


class Page:
    """Blocks of a page as (text, in an article, named), and its subtrees as (hash, first block, end, in an article, with prose).

    named: part of an element that its name, role or class gives away.
    """

    def __init__(self, text: str):
        self.blocks: list[tuple[str, bool, bool]] = []
        self.trees: list[tuple[int, int, int, bool, bool]] = []
        self._parse(text)

    def _parse(self, text: str) -> None:
        run: list[str] = []  # text since the last block's end
        stack: list[tuple] = []  # name, offset, first block, is named, is an article, is muted
        prose_at: set[int] = set()
        at, skip, article, mute = 0, 0, 0, 0

        def flush() -> None:
            if run:
                own = " ".join(entities.unescape("".join(run)).split())
                if own:
                    if any(x[0] in _PROSE for x in stack):
                        prose_at.add(len(self.blocks))
                    self.blocks.append((own, article > 0, skip > 0))
                run.clear()

        def close(depth: int, end: int) -> None:
            nonlocal skip, article, mute
            if any(x[0] in _BLOCK for x in stack[depth:]):
                flush()
            while len(stack) > depth:
                name, start, first, skips, own, mutes = stack.pop()
                if name in _BLOCK and len(self.blocks) > first and name not in ("html", "body", "head", "title"):
                    inside, prose = article > 0, any(t in prose_at for t in range(first, len(self.blocks)))
                    self.trees.append((_signed(xxhash.xxh64_intdigest(" ".join(text[start:end].split()))), first, len(self.blocks), inside, prose))
                skip -= skips
                article -= own
                mute -= mutes

        raw_end = None
        for m in _TAG.finditer(text):
            if raw_end is not None:
                if m[1] != "/" or (m[2] or "").lower() != raw_end:
                    continue
                raw_end, at = None, m.end()
                continue
            if m.start() > at and not mute:
                run.append(text[at : m.start()])
            at = m.end()
            if not m[2]:
                continue
            name = m[2].lower()
            if m[1]:
                depth = next((i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == name), None)
                if depth is not None:
                    close(depth, m.end())
                elif name in _BLOCK:
                    flush()
                continue
            if name in _RAW:
                if not m[3].rstrip().endswith("/"):
                    raw_end = name
                continue
            if name in ("br", "td", "th", "img"):
                run.append(" ")
            if name in _BLOCK or name in _CLOSES:
                ends = _CLOSES.get(name, set())
                for i in range(len(stack) - 1, -1, -1):
                    if stack[i][0] == "p" and name in _BLOCK or stack[i][0] in ends:
                        close(i, m.start())
                        break
                    if stack[i][0] in _BLOCK and stack[i][0] != "p":
                        break
            if name in _BLOCK:
                flush()
            if name in _VOID or m[3].endswith("/"):
                continue
            own = int(name in ("article", "main") or "role" in m[3] and bool(re.search(r"role\s*=\s*[\"']?main\b", m[3])))
            named = name in _SKIP and not (name == "header" and article) or not own and name not in ("html", "body") and _boilerplate(m[3])
            # a named part of a line is left out of it; a named element of its own is a block that can still be counted
            mutes = int(named and name not in _BLOCK)
            named = int(named and not mutes)
            stack.append((name, m.start(), len(self.blocks), named, own, mutes))
            skip += named
            article += own
            mute += mutes
        if raw_end is None and at < len(text) and not mute:
            run.append(text[at:])
        close(0, len(text))
        flush()

    def kept(self) -> list[int]:
        """The blocks that names and articles leave: those in an article, if any there are; never only named ones."""
        own = [i for i, (_, _, named) in enumerate(self.blocks) if not named]
        return [i for i in own if self.blocks[i][1]] or own or [i for i, (_, inside, _) in enumerate(self.blocks) if inside]

    def removable(self, main: bool) -> list[tuple[int, int, int]]:
        """(hash, first block, end) of the subtrees that can be template; main: the page's text is that of an article."""
        return [(digest, first, end) for digest, first, end, inside, prose in self.trees if not (prose and inside and main)]

    def text(self, template) -> str:
        """The blocks kept, less those in subtrees whose hash is in template, unless that were all."""
        kept = self.kept()
        gone: set[int] = set()
        for digest, first, end in self.removable(any(self.blocks[i][1] for i in kept)):
            if digest in template:
                gone.update(range(first, end))
        left = [i for i in kept if i not in gone]
        return "\n".join(self.blocks[i][0] for i in left or kept)

    def surroundings(self) -> list[tuple[int, int, int]]:
        """(hash, rank, smallest shingle hash) of every subtree that can be template and each of the longest blocks kept outside."""
        kept = self.kept()
        order = sorted(kept, key=lambda i: -len(self.blocks[i][0]))
        least: dict[int, int] = {}
        out = []
        for digest, first, end in self.removable(any(self.blocks[i][1] for i in kept)):
            outside = [i for i in order if not first <= i < end][:RANKS]
            for rank in range(RANKS):
                if rank < len(outside) and outside[rank] not in least:
                    words = self.blocks[outside[rank]][0].split()
                    least[outside[rank]] = _signed(min(xxhash.xxh64_intdigest(a + " " + b) for a, b in zip(words, words[1:] or [""])))
                out.append((digest, rank, least[outside[rank]] if rank < len(outside) else 0))
        return out


_NONE = (1 << 64) - 1


def _key(host: str, digest: int) -> int:
    """What tells a host's subtree."""
    return _signed(xxhash.xxh64_intdigest(host, digest & _NONE))


def _page(host: str, text: str | None) -> int:
    return _signed(xxhash.xxh64_intdigest(text or "", xxhash.xxh32_intdigest(host)))


def _tree_batches(batches):
    held("html", "", dict)
    for batch in slices(batches):
        rows = []
        for host, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            page = _page(host, text)
            rows += [(page, _key(host, digest), rank, around) for digest, rank, around in Page(text or "").surroundings()]
        cols = zip(*rows) if rows else [[]] * 4
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["page", "key", "rank", "around"])


def host_of(url: str = "url"):
    return F.coalesce(F.lower(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)), F.lit(""))


def subtrees(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page, key, rank, around): hash of a page, of a subtree of it with its host, and of a block outside; copies of pages once."""
    rows = pages.select(host_of(url_col).alias("host"), F.col(html_col).alias("html"))
    return rows.mapInArrow(_tree_batches, "page long, key long, rank long, around long").distinct()


def templates(found: DataFrame, min_pages: int = MIN_PAGES, min_share: float = MIN_SHARE) -> DataFrame:
    """(key) of the subtrees that recur in at least min_pages surroundings and min_share of the pages that have them."""
    around = found.groupBy("key", "rank", "around").agg(F.count("*").alias("pages"))
    whole = around.groupBy("key", "rank").agg(F.count("*").alias("n"), F.sum("pages").alias("pages"))
    return whole.where((F.col("n") >= min_pages) & (F.col("n") >= min_share * F.col("pages"))).select("key").distinct()


class _OfHost:
    """The template hashes of a host, among sorted keys of all."""

    def __init__(self, host: str, keys: np.ndarray):
        self.host, self.keys = host, keys

    def __contains__(self, digest: int) -> bool:
        key = _key(self.host, digest)
        at = int(np.searchsorted(self.keys, key))
        return at < len(self.keys) and self.keys[at] == key


def _text_batches(shared=None):
    """Texts of (id, url, html, host) by shared sorted keys of templates, or by those in a fifth column."""

    def run(batches):
        held("html", "", dict)
        for batch in slices(batches):
            keys = [shared.value] * batch.num_rows if shared else [np.array(sorted(x or ()), np.int64) for x in batch.column(4).to_pylist()]
            texts = [Page(h or "").text(_OfHost(host, k)) for h, host, k in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), keys)]
            cols = [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())]
            yield pa.RecordBatch.from_arrays(cols, names=["id", "url", "text", "n_chars"])

    return run


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", min_pages: int = MIN_PAGES, min_share: float = MIN_SHARE, templates_at_once: int = TEMPLATES_AT_ONCE) -> DataFrame:
    """(id, url, text, n_chars) for each row of pages.

    Null, empty and textless pages have the empty text. Blocks are joined by one line end in page order; white space
    inside a block, line breaks included, is one space. Pages without a host are taken as one host. Markup left open
    at the page's end counts as closed there. Repeated rows and pages count once where subtrees are counted.

    The templates' keys are broadcast if a count shows at most templates_at_once of 8 bytes; else the pages get theirs
    by joins on the subtrees' keys and the pages' hashes.
    """
    trees = subtrees(pages, url_col, html_col)
    found = cut(templates(trees, min_pages, min_share))
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"), host_of(url_col).alias("host"))
    kind = rows.schema["id"].dataType.simpleString()
    schema = f"id {kind}, url string, text string, n_chars long"
    if found.count() <= templates_at_once:
        keys = np.sort(found.toArrow().column(0).to_numpy())
        return rows.mapInArrow(_text_batches(rows.sparkSession.sparkContext.broadcast(keys)), schema).withColumnRenamed("id", id_col)
    lists = trees.select("page", "key").distinct().join(found, "key").groupBy("page").agg(F.collect_set("key").alias("keys"))
    rows = rows.mapInArrow(_page_batches, f"id {kind}, url string, html string, host string, page long").join(lists, "page", "left")
    return rows.select("id", "url", "html", "host", "keys").mapInArrow(_text_batches(), schema).withColumnRenamed("id", id_col)


def _page_batches(batches):
    for batch in slices(batches):
        pages = [_page(host, text) for host, text in zip(batch.column(3).to_pylist(), batch.column(2).to_pylist())]
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(pages, pa.int64())], names=["id", "url", "html", "host", "page"])
