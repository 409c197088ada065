"""Main text of web pages by composite text density.

Every block's density is its characters per tag, weighed down by the share of its link characters and link
tags against those of the whole body; inline elements count with their block. The node whose children's densities sum
highest holds the article. The path from there to the body gives the thresholds for the rest: an ancestor at
least as dense as the body is taken whole but for parts made of links; of the others' children those are taken that
reach the least density on the path. Elements that are page furniture by tag, role or class are left out before
densities are computed; no element is taken for its name.

Defined results: a null or empty page, or one without text, gives an empty string; a tag or comment cut off by the
page's end is no text; after a quote that never closes tags end at the next ``>``; unclosed elements end
with the page; of equal sums the subtree with more characters counts, then the outer one; pages of any length and depth take time in proportion;
repeated pages give equal rows; an empty table gives no rows; only the id, url and html columns are read.
"""

from __future__ import annotations

import html as entities
import itertools
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .scratch import path_of

_TAG = re.compile(r"<(?:(/?)([a-zA-Z][^\s/>]*+)|(!--)|[!?])")
_REST = re.compile(r"""((?:[^>"']|"[^"]*+"|'[^']*+')*+)>""")
_ATTR = re.compile(r"""([^\s=/>"']++)(?:\s*+=\s*+(?:"([^"]*+)"|'([^']*+)'|([^\s>"']++)))?+|"[^"]*+"|'[^']*+'""")
_SEEN = ("class", "id", "role", "hidden", "style")
_HEADS = ("h1", "h2", "h3", "h4", "h5", "h6")
_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|[0-9]+")
_RAW = frozenset(("script", "style", "textarea", "title", "iframe", "xmp", "noembed", "noframes"))
_VOID = frozenset(("area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"))
_INLINE = frozenset(
    ("a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "img", "ins", "kbd", "label", "mark", "q", "rp", "rt", "ruby")
    + ("s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr")
)
_DROP = frozenset(
    ("head", "script", "style", "noscript", "template", "nav", "footer", "aside", "form", "iframe", "button", "select", "option", "textarea", "input", "svg", "canvas", "object")
    + ("embed", "audio", "video", "map", "menu", "dialog", "title", "noembed", "noframes", "datalist", "fieldset", "xmp")
)
_ENDS_P = frozenset(
    ("address", "article", "aside", "blockquote", "center", "details", "div", "dl", "fieldset", "figure", "figcaption", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header")
    + ("hr", "main", "menu", "nav", "ol", "p", "pre", "section", "table", "ul")
)
_ENDED = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
_CLOSABLE = frozenset(("p", *(name for names in _ENDED.values() for name in names)))
_SCOPE = frozenset(("ul", "ol", "dl", "table", "body", "html", "article", "section", "div", "main", "tr", "tbody", "thead"))
_FURNITURE = frozenset(
    ("ad", "ads", "adv", "advert", "adverts", "advertisement", "advertising", "adsense", "sponsor", "sponsored", "sponsors", "promo", "promotion", "banner", "cookie", "cookies", "consent")
    + ("gdpr", "notice", "notices", "notification", "alert", "newsletter", "subscribe", "subscription", "signup", "login", "sidebar", "sidebars", "menu", "menus", "nav", "navbar", "navigation")
    + ("breadcrumb", "breadcrumbs", "comment", "comments", "commentlist", "respond", "reply", "replies", "disqus", "share", "sharing", "social", "related", "recommended", "recommendations")
    + ("popup", "modal", "overlay", "widget", "widgets", "pagination", "pager", "toolbar", "search", "disclaimer", "paywall", "skip", "aside", "form")
)
_EDGES = frozenset(("header", "footer", "masthead", "colophon", "copyright"))
_CONTENT = frozenset(("article", "entry", "post", "content", "main", "story", "body", "text"))
_NOT = frozenset(("has", "with", "no", "without"))
_ROLES = frozenset(("navigation", "banner", "contentinfo", "complementary", "search", "form", "alert", "alertdialog", "dialog", "menu", "menubar", "toolbar"))
_TALK = re.compile(r"\s*(?:\d+\s+)?(?:reader\s+)?(?:comments?|replies|responses|leave a (?:reply|comment)|(discussion))(?:\s*\(\d+\))?\s*:?\s*", re.I)

_COMMENTS = re.compile(r"comment|repl(?:y|ies)|respon[ds]|disqus", re.I)


def _furniture(tag: str, attrs: str, in_article: bool) -> bool:
    if tag in _DROP:
        return True
    if tag in ("html", "body", "main", "article"):
        if tag != "article" or not attrs:
            return False
    if tag == "header" and not in_article:
        return True
    if not attrs or attrs.isspace():
        return False
    low = attrs.lower()
    if not any(name in low for name in _SEEN):
        return False
    worded = not (in_article and (tag in _INLINE or tag in _HEADS))
    met = set()
    for m in _ATTR.finditer(attrs):
        name, value = (m[1] or "").lower(), m[2] or m[3] or m[4] or ""
        if name in met:  # of a repeated attribute the first counts
            continue
        met.add(name)
        if name == "hidden" or (name == "aria-hidden" and value.lower() == "true"):
            return True
        if name == "style":
            if "display:none" in value.replace(" ", "").lower():
                return True
        elif name == "role":
            if value.lower() in _ROLES:
                return True
        elif name in ("class", "id") and worded:
            for one in value.split():
                words = {w.lower() for w in _WORDS.findall(one)}
                if words & _NOT:
                    continue
                if words & _FURNITURE or (words & _EDGES and not words & _CONTENT and not in_article):
                    return True
    return False


class _Page:
    """Nodes in page order with parents, and the page's text and block breaks in order.

    What is open is counted by name, by block and by scope, so that an end tag or an implied end without anything to
    close costs nothing: the time is linear in the page.
    """

    def __init__(self, html: str) -> None:
        self.tag, self.up, self.out, self.talk = ["#root"], [-1], [False], [False]
        self.pieces: list[tuple[int, str | None]] = []  # (node, text), or (node, None) at a block's edge
        self.stack, self.article = [0], 0
        self.open: dict[str, int] = {}
        self.inline: list[dict[str, int]] = [{}]  # per open block its open inline elements
        self.scopes: list[dict[str, int]] = [{}]  # per open scope its open elements that others end
        at, end, quotes = 0, len(html), True
        while at < end:
            m = _TAG.search(html, at)
            if m is None or m[2] and (rest := self._rest(html, m.end(), quotes)) is None:
                if m is not None and quotes and html.find(">", m.end()) >= 0:
                    quotes = False  # a quote is never closed: from here on ">" ends tags
                    continue
                tail = html[at:] if m is None else html[at : m.start()]  # else a tag cut off by the page's end
                if m is None and re.match(r"</?[a-zA-Z!?]", html[max(at, html.rfind("<")) :]):
                    tail = html[at : html.rfind("<")]
                if tail:
                    self.pieces.append((self.stack[-1], tail))
                break
            if m.start() > at:
                self.pieces.append((self.stack[-1], html[at : m.start()]))
            if m[2] is None:
                close = html.find("-->", m.end()) if m[3] else html.find(">", m.end())
                at = end if close < 0 else close + (3 if m[3] else 1)
                continue
            attrs, at = rest
            tag = m[2].lower()
            if m[1]:
                self._close(tag)
                continue
            self._imply(tag)
            node = len(self.tag)
            self.tag.append(tag)
            self.up.append(self.stack[-1])
            self.out.append(_furniture(tag, attrs, self.article > 0))
            self.talk.append(tag == "form" or tag == "textarea" or self.out[-1] and bool(_COMMENTS.search(attrs)))
            if tag not in _INLINE:
                self.pieces.append((node, None))
            if tag in _VOID or attrs.endswith("/") and tag not in _RAW and tag in ("path", "circle", "rect"):
                continue
            if tag in _RAW:
                close = re.compile(rf"</{tag}", re.I).search(html, at)
                if close is None:
                    break
                at = close.start()
            self._push(node)

    @staticmethod
    def _rest(html: str, at: int, quotes: bool) -> tuple[str, int] | None:
        """A tag's attributes and its end."""
        if quotes:
            m = _REST.match(html, at)
            return None if m is None else (m[1], m.end())
        close = html.find(">", at)
        return None if close < 0 else (html[at:close], close + 1)

    def _push(self, node: int) -> None:
        tag = self.tag[node]
        self.stack.append(node)
        self.open[tag] = self.open.get(tag, 0) + 1
        self.article += tag in ("article", "main")
        if tag in _INLINE:
            self.inline[-1][tag] = self.inline[-1].get(tag, 0) + 1
        else:
            self.inline.append({})
        if tag in _CLOSABLE:
            self.scopes[-1][tag] = self.scopes[-1].get(tag, 0) + 1
        if tag in _SCOPE:
            self.scopes.append({})

    def _pop(self) -> None:
        tag = self.tag[self.stack[-1]]
        if tag in _SCOPE:
            self.scopes.pop()
        if tag in _CLOSABLE:
            self.scopes[-1][tag] -= 1
        if tag in _INLINE:
            self.inline[-1][tag] -= 1
        else:
            self.inline.pop()
            self.pieces.append((self.stack[-1], None))
        self.article -= tag in ("article", "main")
        self.open[tag] -= 1
        self.stack.pop()

    def _close(self, tag: str) -> None:
        if self.inline[-1].get(tag) if tag in _INLINE else self.open.get(tag):
            while self.tag[self.stack[-1]] != tag:
                self._pop()
            self._pop()

    def _imply(self, tag: str) -> None:
        """End what a new ``tag`` ends: an open paragraph, item or cell of the innermost scope."""
        ended = (("p",) if tag in _ENDS_P else ()) + _ENDED.get(tag, ())
        while any(self.scopes[-1].get(name) for name in ended) or self.tag[self.stack[-1]] in ended:
            while (name := self.tag[self.stack[-1]]) not in ended:
                self._pop()
            self._pop()


def _densities(chars: list[int], links: list[int], tags: list[int], link_tags: list[int], root: int) -> list[float]:
    """Composite text density of every node: characters per tag, times a logarithm of the shares that aren't links.

    The logarithm's base grows with a node's linked characters and with the page's share of them. One is added within both
    logarithms, so that short blocks and pages without links need no rules of their own.
    """
    share = links[root] / chars[root]
    out = [0.0] * len(chars)
    for i, c in enumerate(chars):
        if c:
            t, lc, lt = max(1, tags[i]), links[i], max(1, link_tags[i])
            base = math.log(1 + math.log(c / max(1, c - lc) * lc + share * c + math.e))
            out[i] = c / t * math.log(1 + c * t / (max(1, lc) * lt)) / base
    return out


def main_text(html: str | None) -> str:
    """The main text of one page."""
    if not html:
        return ""
    page = _Page(html)
    tag, up, out = page.tag, page.up, page.out
    n = len(tag)
    last = list(range(n))  # the last node of each subtree
    holds = [t in ("article", "main") for t in tag]
    for i in range(n - 1, 0, -1):
        last[up[i]] = max(last[up[i]], last[i])
        holds[up[i]] |= holds[i] and not out[i]
    talks = [0, *itertools.accumulate(page.talk)]
    for i, text in page.pieces:  # a talk heading makes its container furniture, "Discussion" only beside a list of comments or a form
        if text and tag[i] in _HEADS[1:] and len(text) < 60 and tag[up[i]] in ("div", "section") and (talk := _TALK.fullmatch(entities.unescape(text))):
            if not talk[1] or talks[last[up[i]] + 1] > talks[up[i]]:
                out[up[i]] = True
    for i in range(1, n):
        if out[i] and holds[i] and tag[i] not in _DROP:
            out[i] = False
        out[i] = out[i] or out[up[i]]
    # inline elements but links belong to the block that they are in
    block = [0] * n
    in_link = [False] * n
    for i in range(1, n):
        block[i] = block[up[i]] if tag[i] in _INLINE else i
        in_link[i] = tag[i] == "a" or in_link[up[i]]
    chars, links, tags, link_tags = [0] * n, [0] * n, [0] * n, [0] * n
    pieces = [(i, t if t is None or "&" not in t else entities.unescape(t)) for i, t in page.pieces if not out[i]]
    for i, text in pieces:
        if text:
            size = len(text) - sum(map(text.count, " \t\n\r\f"))
            chars[block[i]] += size
            if in_link[i]:
                links[block[i]] += size
    for i in range(n - 1, -1, -1):
        if not out[i]:
            tags[block[i]] += i == block[i] or tag[i] == "a"
            link_tags[block[i]] += tag[i] == "a"
            if i and i == block[i]:
                for count in (chars, links, tags, link_tags):
                    count[block[up[i]]] += count[i]
    body = next((i for i in range(n) if tag[i] == "body"), 0)
    if not chars[body]:
        body = 0
    if not chars[body]:
        return ""
    density = _densities(chars, links, tags, link_tags, body)
    total, own, kids = [0.0] * n, chars[:], [0] * n
    for i in range(1, n):
        if i == block[i] and chars[i]:
            p = block[up[i]]
            total[p] += density[i]
            own[p] -= chars[i]
            kids[p] += 1
    best = max(range(body, last[body] + 1), key=lambda i: (total[i], chars[i], -i))
    path = [best]
    while path[-1] not in (body, 0):
        path.append(block[up[path[-1]]])
    while len(path) > 1 and kids[path[-1]] == 1 and not own[path[-1]]:  # what holds nothing but one block is no rival of it
        path.pop()
    root, on, threshold = path[-1], set(path), min(density[i] for i in path)
    keep = [False] * n
    keep[best] = True
    for i in range(root, last[root] + 1):
        p = up[i]
        if i == best or i in on:
            keep[i] = i == best
        elif i != block[i]:  # inline: with the text around it
            keep[i] = p != root and p in on or keep[p]
        elif keep[p]:
            keep[i] = True
        elif block[p] in on:  # beside the path: all of what is as dense as the page, else what is dense itself
            whole = block[p] != root and density[block[p]] >= density[root]
            keep[i] = (whole or density[i] >= threshold) and 2 * links[i] < max(1, chars[i])
    own_text = on - {root} | {best}
    return " ".join("".join(" " if t is None else t for i, t in pieces if keep[i] or i in own_text).split())


def extracted(pages: DataFrame) -> DataFrame:
    """``page_id``, ``url``, ``text`` and ``n_chars`` of every page."""
    wide = pages.select("page_id", "url", "html")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 512):
                b = batch.slice(a, 512)
                texts = [main_text(h) for h in b.column(2).to_pylist()]
                yield pa.record_batch([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return wide.mapInArrow(run, f"page_id {wide.schema['page_id'].dataType.simpleString()}, url string, text string, n_chars long")


def op4_text_density(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extracted(spark.read.parquet(path_of(sf_dir, "pages")))
