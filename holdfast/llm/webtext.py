"""Main text of web pages by composite text density.

Every element that can hold blocks is a node. Its density is its characters per tag, adjusted
for links: the share of linked characters and tags against that of the whole body enters as the
base and the argument of a logarithm. The density sum of a node adds the densities of its children
and of its own runs of bare text. The node with the largest sum is found, the least density on its
path up to the body is the threshold, and every node that reaches the threshold contributes the
subtree of largest sum below it. Where the largest node lies in an article (or, without one, in the
main part), the whole article is taken, so that short paragraphs stay.

Menus, page headers and footers, sidebars, notices, adverts, forms, scripts, styles and reader comments
never count: they go by element, by role and by the words of class and id. Words of class and id, and forms, never
remove an article, the main part, or an element that contains one of these; page headers apart, nor an
element with a first heading. A header inside an article or the main part is part of it.

Pages are read as browsers read them where that decides the text: comments, raw text elements,
quoted attribute values, paragraphs and list items without end tags, misnested inline elements. An
unclosed quote ends at the next ``>``; an unclosed comment, script or style reaches to the end. All
passes are linear in the page, whatever its nesting. ``br`` is white space of its block; table cells
are blocks.

Null html counts as empty and gives an empty text; so does a page without main text. A page without
tags is one block. Every row is a result of its own, repeated rows and ids included; null ids and urls
stay null. Whole pages are read, whatever their length. An empty table gives no rows. Only the named
columns are read; others, whatever their names, are ignored.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from math import e, log

import pyarrow as pa
from pyspark.sql import DataFrame

from holdfast.llm.common import PIECE, own_columns, plus

# --- fixed values: element names, and words of class and id ---------------------------------------

BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset "
    "figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p "
    "pre search section summary table tbody td tfoot th thead tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style title textarea xmp iframe noembed noframes".split())
NEVER = frozenset(
    "aside audio button canvas datalist dialog footer head label map menu nav noscript object optgroup option "
    "search select svg template video".split()
)
WRAPPERS = frozenset("fieldset form".split())  # go too, unless they hold the article
IN_HEAD = frozenset("base link meta noscript script style template title".split())
ENDS_P = frozenset(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer "
    "form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre search section summary table ul".split()
)
# An open element of the first list is ended by a start tag of the key, unless one of the second is nearer.
ENDED_BY = {
    "li": (("li",), ("ul", "ol", "menu", "dir")),
    "dt": (("dt", "dd"), ("dl",)),
    "dd": (("dt", "dd"), ("dl",)),
    "option": (("option",), ("select", "datalist", "optgroup")),
    "tr": (("tr",), ("table",)),
    "td": (("td", "th"), ("tr", "table")),
    "th": (("td", "th"), ("tr", "table")),
    "tbody": (("tbody", "thead", "tfoot"), ("table",)),
    "tfoot": (("tbody", "thead", "tfoot"), ("table",)),
    "thead": (("tbody", "thead", "tfoot"), ("table",)),
}
P_SCOPE = ("td", "th", "table", "caption", "button", "object", "template")
END_SCOPE = {"p": P_SCOPE} | {name: ENDED_BY[name][1] for name in ("li", "dt", "dd", "td", "th", "tr")}
ROLES = frozenset(
    "alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search toolbar".split()
)
HINTS = frozenset(
    "ad ads adbox adsense adslot adunit adblock adwrap adwrapper advert adverts advertisement advertising "
    "advertorial alert banner billboard breadcrumb breadcrumbs colophon comment commentlist comments consent "
    "cookie cookiebar cookies copyright dfp disqus footer gdpr header livefyre login "
    "masthead menu menubar modal nav navbar navi navigation newsletter notice notices notification "
    "notifications outbrain overlay pager pagination popup popups promo promos promoted promotion "
    "recommended recommendations related replies reply rail share sharebar sharing sidebar "
    "sidebars sidenav signup skyscraper social sponsor sponsored sponsors subscribe subscription taboola "
    "tagcloud toolbar topbar widget widgets".split()
)
HEADERS = frozenset("header masthead topbar".split())
OF_ARTICLE = frozenset("article chapter content entry post section story title".split())  # before one of HEADERS
# A word after one of these says what a page has, not what the element is.
ABOUT_PAGE = frozenset("has have with without no not is hide show layout".split())

_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)((?:[^>=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+'|(?![\"'])))*+)>")
_PLAIN_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>")
_HINT = re.compile(r"""(?:^|[\s"'/])(class|id|role|itemprop)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""", re.I)
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_RAW_END = {name: re.compile(rf"</{name}(?=[\s/>])", re.I) for name in RAW}

KEEP, HINTED, PAGE_HEADER, OUT = range(4)


@dataclass
class Page:
    """Nodes of a page in document order, parents before children; node 0 is the page itself."""

    parent: list[int] = field(default_factory=list)
    name: list[str] = field(default_factory=list)
    verdict: list[int] = field(default_factory=list)  # KEEP, HINTED, PAGE_HEADER, OUT by the element alone
    marked: list[bool] = field(default_factory=list)  # an article, the main part or a body of an article
    tags: list[int] = field(default_factory=list)  # start tags, its own and those of inline elements in it
    links: list[int] = field(default_factory=list)
    runs: list[tuple[int, int, str, bool]] = field(default_factory=list)  # node, block, text, linked


def _hints(attributes: str) -> tuple[int, bool]:
    """Verdict of class, id and role; and whether role or property name the article."""
    verdict, marked = KEEP, False
    for name, value in _HINT.findall(attributes):
        name, value = name.lower(), value.strip("\"'").strip()
        if name == "role":
            verdict = max(verdict, HINTED if value.lower() in ROLES else KEEP)
            marked |= value.lower() in ("article", "main")
        elif name == "itemprop":
            marked |= value == "articleBody"
        else:
            for one in value.split():
                words = [w.lower() for w in _WORD.findall(one)]
                for k, w in enumerate(words):
                    before = words[k - 1] if k else ""
                    if w in HINTS and before not in ABOUT_PAGE and not (w in HEADERS and before in OF_ARTICLE):
                        verdict = max(verdict, PAGE_HEADER if w in HEADERS else HINTED)
    return verdict, marked


class _Reader:
    """Builds a page from tags and text; keeps the open elements."""

    def __init__(self) -> None:
        self.page = Page()
        self.stack: list[int] = []
        self.open_at: dict[str, list[int]] = {}  # depths of the open elements of a name
        self.block = 0
        self.link_depth = -1  # depth at which a link was opened
        self._push("", KEEP, False)

    def _push(self, name: str, verdict: int, marked: bool) -> None:
        page = self.page
        self.open_at.setdefault(name, []).append(len(self.stack))
        page.parent.append(self.stack[-1] if self.stack else -1)
        self.stack.append(len(page.name))
        for values, value in (
            (page.name, name), (page.verdict, verdict), (page.marked, marked), (page.tags, 1), (page.links, 0),
        ):
            values.append(value)

    def _pop_to(self, depth: int) -> None:
        while len(self.stack) > depth:
            self.open_at[self.page.name[self.stack.pop()]].pop()
        if self.link_depth > len(self.stack):
            self.link_depth = -1

    def _last(self, names: tuple[str, ...]) -> int:
        return max((self.open_at[n][-1] for n in names if self.open_at.get(n)), default=-1)

    def _leave_head(self) -> None:
        if self.open_at.get("head"):
            self._pop_to(self.open_at["head"][-1])

    def text(self, raw: str) -> None:
        if raw:
            if self.page.name[self.stack[-1]] == "head" and not raw.isspace():
                self._leave_head()
            text = entities.unescape(raw) if "&" in raw else raw
            self.page.runs.append((self.stack[-1], self.block, text, self.link_depth >= 0))

    def end(self, name: str) -> None:
        if name in ("body", "html"):
            return  # what follows still belongs to the body
        if name == "a":
            self.link_depth = -1
            return
        self.block += name in BLOCKS
        depths = self.open_at.get(name)
        if depths and depths[-1] > self._last(END_SCOPE.get(name, ())):
            self._pop_to(depths[-1])

    def start(self, name: str, attributes: str) -> None:
        page = self.page
        if name not in IN_HEAD and name not in ("head", "html"):
            self._leave_head()
        if name == "br":
            self.text(" ")
        if name == "a":
            self.link_depth = len(self.stack)
            page.links[self.stack[-1]] += 1
        self.block += name in BLOCKS
        if name not in BLOCKS and name not in NEVER or name in VOID:
            page.tags[self.stack[-1]] += 1
            return
        if name in ("html", "body") and self.open_at.get(name):
            return
        if name in ENDS_P and (p := self._last(("p",))) > self._last(P_SCOPE):
            self._pop_to(p)
        if name in ENDED_BY:
            ended, scope = ENDED_BY[name]
            if (depth := self._last(ended)) > self._last(scope):
                self._pop_to(depth)
        verdict, marked = _hints(attributes) if attributes else (KEEP, False)
        marked |= name in ("article", "main")
        if marked or name in ("html", "body"):
            verdict = KEEP
        elif name in NEVER:
            verdict = OUT
        elif name == "header":
            verdict = PAGE_HEADER
        elif name in WRAPPERS:
            verdict = max(verdict, HINTED)
        self._push(name, verdict, marked)


def parse(html: str) -> Page:
    reader = _Reader()
    at, size, pattern = 0, len(html), _TAG
    while at < size:
        mark = html.find("<", at)
        if mark < 0:
            reader.text(html[at:])
            break
        kind = html[mark + 1 : mark + 3]
        letter = kind[:1].isascii() and kind[:1].isalpha()
        if not letter and kind[:1] not in ("/", "!", "?") or not kind:
            after = html.find("<", mark + 1)  # a lone sign is text
            after = size if after < 0 else after
            reader.text(html[at:after])
            at = after
            continue
        reader.text(html[at:mark])
        if html.startswith("<!--", mark):
            short = html.startswith(("<!-->", "<!--->"), mark)
            end = html.find(">" if short else "-->", mark + 4)
            at = size if end < 0 else end + (1 if short else 3)
            continue
        if not letter and not (kind[0] == "/" and kind[1:].isascii() and kind[1:].isalpha()):
            end = html.find(">", mark)
            at = size if end < 0 else end + 1
            continue
        found = pattern.match(html, mark)
        if found is None and pattern is _TAG:
            pattern = _PLAIN_TAG  # a quote is never closed: from here on tags end at the next sign
            found = pattern.match(html, mark)
        if found is None:
            break  # cut off within a tag
        at = found.end()
        name = found[2].lower()
        if found[1]:
            reader.end(name)
            continue
        if name in RAW:
            end = _RAW_END[name].search(html, at)
            close = html.find(">", end.start()) if end else -1
            at = size if close < 0 else close + 1
            continue
        reader.start(name, found[3])
    return reader.page


# --- density -------------------------------------------------------------------------------------


def density(chars: int, tags: int, link_chars: int, link_tags: int, linked_share: float) -> float:
    """Characters per tag, lowered by links; ``linked_share`` is that of the whole body."""
    if chars <= 0:
        return 0.0
    linked, plain = max(link_chars, 1), max(chars - link_chars, 1)
    base = log(chars / plain * linked + linked_share * chars + e)
    ratio = chars / linked * tags / max(link_tags, 1)
    return chars / tags * max(log(ratio) / log(base), 0.0)


def kept_nodes(page: Page) -> list[bool]:
    """Nodes that may hold main text: neither they nor an element around them are ruled out."""
    n = len(page.name)
    holds_mark, holds_title = list(page.marked), [name == "h1" for name in page.name]
    for i in range(n - 1, 0, -1):
        up = page.parent[i]
        holds_mark[up] |= holds_mark[i]
        holds_title[up] |= holds_title[i]
    kept, within = [True] * n, list(page.marked)
    for i in range(1, n):
        up = page.parent[i]
        stays = (
            page.verdict[i] == KEEP
            or page.verdict[i] != OUT and holds_mark[i]
            or page.verdict[i] == HINTED and holds_title[i]
            or page.verdict[i] == PAGE_HEADER and within[up]
        )
        kept[i] = kept[up] and stays
        within[i] |= within[up]
    return kept


def main_nodes(page: Page) -> list[bool]:
    """Nodes whose text is main text."""
    n = len(page.name)
    kept = kept_nodes(page)
    chars, linked = [0] * n, [0] * n
    tags = [t if k else 0 for t, k in zip(page.tags, kept)]
    links = [t if k else 0 for t, k in zip(page.links, kept)]
    runs = [(node, len(text.strip()), is_link) for node, _, text, is_link in page.runs if kept[node]]
    for node, size, is_link in runs:
        chars[node] += size
        linked[node] += size * is_link
    for i in range(n - 1, 0, -1):
        for values in (chars, linked, tags, links):
            values[page.parent[i]] += values[i]
    if not chars[0]:
        return [False] * n
    share = linked[0] / chars[0]
    dense = [density(*each, share) if k else 0.0 for *each, k in zip(chars, tags, linked, links, kept)]

    # Sums over the children and over runs of bare text, and the largest sum of every subtree.
    sums = [0.0] * n
    for node, size, is_link in runs:
        sums[node] += density(size, 1, size * is_link, int(is_link), share)
    for i in range(1, n):
        sums[page.parent[i]] += dense[i]
    best = list(range(n))
    for i in range(n - 1, 0, -1):
        up = page.parent[i]
        # Of equal sums the node that comes first.
        if kept[i] and (sums[best[i]], -best[i]) > (sums[best[up]], -best[up]):
            best[up] = best[i]

    peak = best[0]
    threshold, article, main, at = dense[peak], -1, -1, peak
    while at >= 0:
        threshold = min(threshold, dense[at])
        article = at if page.name[at] == "article" else article
        main = at if page.name[at] == "main" else main
        at = page.parent[at]
    chosen = [False] * n
    whole = article if article >= 0 else main
    if whole >= 0:
        chosen[whole] = True
    else:
        reached = [False] * n
        for i in range(n):
            above = i == 0 or reached[page.parent[i]]
            reached[i] = above and kept[i] and dense[i] >= threshold
            if reached[i]:
                chosen[best[i]] = True
    for i in range(1, n):
        chosen[i] = kept[i] and (chosen[i] or chosen[page.parent[i]])
    return chosen


def main_text(html: str | None) -> str:
    """Blocks of the main text, one a line."""
    if not html:
        return ""
    page = parse(html)
    chosen = main_nodes(page)
    blocks: dict[int, list[str]] = {}
    for node, block, text, _ in page.runs:
        if chosen[node]:
            blocks.setdefault(block, []).append(text)
    lines = (" ".join("".join(parts).split()) for parts in blocks.values())
    return "\n".join(line for line in lines if line)


# --- Spark ---------------------------------------------------------------------------------------


def main_texts(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """The id and url columns, text, and n_chars (its code points) of every page."""

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            htmls = batch.column(2)
            first, texts, held = 0, [], 0
            for k in range(len(htmls)):
                texts.append(main_text(htmls[k].as_py()))
                held += len(texts[-1])
                if held >= PIECE or k == len(htmls) - 1:
                    yield pa.RecordBatch.from_arrays(
                        [
                            batch.column(0).slice(first, len(texts)),
                            batch.column(1).slice(first, len(texts)),
                            pa.array(texts, pa.string()),
                            pa.array([len(t) for t in texts], pa.int64()),
                        ],
                        names=[id_col, url_col, "text", "n_chars"],
                    )
                    first, texts, held = k + 1, [], 0

    own = own_columns(pages, id_col, url_col, html_col)
    schema = own_columns(pages, id_col, url_col).schema
    return own.mapInArrow(extract, plus(schema, ("text", "string"), ("n_chars", "bigint")))
