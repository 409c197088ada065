import html
import html.parser
import math
import time

import pyarrow.parquet as pq
import pytest

from tidewright.llm import html_text

PAGE = """<html><head><title>t</title><style>p{}</style><script>x("</p>")</script></head><body class="page has-sidebar"><header><h1>Site</h1></header><nav><a href=/>Home</a></nav>
<div class="cookie-notice">We use cookies on this site to do things and more things.</div>%s<aside>Side text</aside><form><p>Sign up</p></form><footer><p>&copy; Us</p></footer></body></html>"""
CASES = [
    (PAGE % "<article><h1>Head</h1><p>One &amp; two\n three<p>Fo<b>ur</b> <a href=x>five</a></article><div id=comments><p>Nice!</p></div>", "Head One & two three Four five"),
    (PAGE % "<div class=content><p>A first long paragraph of the text.</p><p>A second, somewhat longer paragraph of it.</p><ul><li>x<li>y</ul></div>", "A first long paragraph of the text. A second, somewhat longer paragraph of it. x y"),
    (PAGE % "<main><section><h2>Part</h2><p>Words here.</p></section><div class='ad'>Buy!</div><section><p>More words.</p></section><section><h3>3 Comments</h3><p>Me too</p></section></main>", "Part Words here. More words."),
    ("plain text only", "plain text only"),
    ("<p>a<p>b<ul><li>x<li>y</ul>", "a b x y"),
    ("a < b &lt;c&gt; and &am", "a < b <c> and &am"),
    ("<!-- never closed <p>x", ""),
    ("<script>x", ""),
    ("<p>x</p><a hr", "x"),
    (None, ""),
    ("", ""),
    ("<br>", ""),
]


@pytest.mark.parametrize(("html", "text"), CASES)
def test_main_text(html, text):
    assert html_text.main_text(html) == text


@pytest.mark.parametrize(
    "part",
    ['<a href="/hidden-gems">Words</a>', '<p title="a hidden place">Words', '<div data-hidden="false">Words</div>', '<a href="/x?id=comments">Words</a>', "<p data-id=comments>Words", "<p aria-hidden=false>Words"]
    + ['<h2 id="search-engines">Words</h2>', '<h2 id="related-work">Words</h2>', '<h3 id="social-media">Words</h3>', '<span class="ad">Words</span>', '<section><h2>Discussion</h2><p>Words</section>', "<p title=x'y title=\"class='ad'\">Words"],
)
def test_article_text_stays(part):
    assert "Words" in html_text.main_text(PAGE % f"<article><p>First part of it.</p>{part}<p>Last part.</p></article>")


@pytest.mark.parametrize(
    "part",
    ["<p hidden>Words", '<p data-x="y"hidden>Words', '<p aria-hidden="true">Words', "<div id=comments>Words</div>", '<p style="display: none">Words', "<div role=search>Words</div>"]
    + ["<section><h2>Discussion</h2><p>Words<form><textarea></textarea></form></section>", "<section><h2>Discussion</h2>Words<ul class=comment-list><li>x</ul></section>", "<section><h2>3 Comments</h2>Words</section>"],
)
def test_furniture_in_articles_goes(part):
    assert "Words" not in html_text.main_text(PAGE % f"<article><p>First part of it.</p>{part}<p>Last part.</p></article>")


def test_deep_and_hostile_pages_end():
    assert html_text.main_text("<div>" * 50_000 + "x") == "x"
    html_text.main_text('<a href="' * 50_000)


@pytest.mark.parametrize(
    "page",
    ["<p " * 300_000, "<b>x</i>" * 100_000, "<b>" * 50_000 + "<hr>" * 50_000, "<b><div>" + "<i>" * 50_000 + "</b>" * 50_000, "<div>" + "<h2>Discussion</h2>" * 30_000, "<a '\"x>" * 30_000, "<li><b>" * 50_000, "<" * 300_000]
    + ["<table><tr><td>" * 30_000 + "</table>", "<p>" + "word " * 400_000, "<!-- " * 100_000],
)
def test_long_pages_take_linear_time(page):
    began = time.time()
    html_text.main_text(page)
    assert time.time() - began < 20


def test_unclosed_quotes_end_at_the_next_tag_end():
    assert html_text.main_text('<p>a</p><a href="x>b</a><p>c</p>') == "a b c"


P = "<p>%s</p>" % ("Some words of a paragraph, " * 8)
SHORT = "<p>Short one.</p>"


@pytest.mark.parametrize(
    ("body", "wanted", "unwanted"),
    [
        ("<div><div>Head<p>Lead</p>%s</div><div><a href=1>One link</a> <a href=2>Other link</a></div></div>" % (P * 3), ["Head", "Lead", "Some"], ["One link"]),
        ("<div><h1>Head</h1>%s<div><h2>Part A</h2>%s</div><div><h2>Part B</h2>%s</div></div><div>Tiny box</div>" % (SHORT, P * 4, SHORT), ["Head", "Short", "Part A", "Part B"], ["Tiny"]),
        ("<table><tr><td><a href=1>Menu one</a><br><a href=2>Menu two</a></td><td><h1>Head</h1>%s</td></tr></table>" % (P * 3), ["Head", "Some"], ["Menu"]),
        ("<div id=page><div><ul>%s</ul></div><div><h1>Head</h1>%s<ul>%s</ul></div></div>" % ("<li><a href=x>Some far linked words</a>" * 9, P, "<li>An item of the text in some words" * 12), ["Head", "Some", "An item"], ["far linked"]),
    ],
)
def test_density_finds_text_without_telling_names(body, wanted, unwanted):
    got = html_text.main_text(f"<html><body>{body}</body></html>")
    assert all(w in got for w in wanted) and not any(u in got for u in unwanted), got


class _Tree(html.parser.HTMLParser):
    """A plain tree of a page: nodes are [tag, class, children], children nodes or texts; nav, footer and advert left out."""

    def __init__(self, page):
        super().__init__()
        self.root = ["#root", "", []]
        self.open = [self.root]
        self.feed(page)
        self.close()

    def handle_starttag(self, tag, attrs):
        if tag in ("p", "h1", "div", "footer", "ul", "article") and any(n[0] == "p" for n in self.open):
            while self.open.pop()[0] != "p":
                pass
        node = [tag, dict(attrs).get("class"), []]
        self.open[-1][2].append(node)
        if tag not in ("br", "meta"):
            self.open.append(node)

    def handle_endtag(self, tag):
        if any(n[0] == tag for n in self.open):
            while self.open.pop()[0] != tag:
                pass

    def handle_data(self, data):
        self.open[-1][2].append(data)


def _naive(page):
    """The densest subtree's text by recursion over the tree."""
    inline = ("b", "br", "a", "i", "em", "span")

    def gone(node):
        return node[0] in ("head", "nav", "footer", "script", "style", "title") or node[1] == "ad"

    def text(node):
        if isinstance(node, str):
            return node
        if gone(node):
            return " "
        inner = "".join(text(c) for c in node[2])
        return inner if node[0] in ("b", "a", "i", "em", "span", "br") else f" {inner} "

    def count(node, what):
        if isinstance(node, str):
            return len("".join(node.split())) if what == "chars" else 0
        return 0 if gone(node) else (what == "tags" and (node[0] not in inline or node[0] == "a")) + sum(count(c, what) for c in node[2])

    def density(node):
        c, t = count(node, "chars"), count(node, "tags")
        return c / t * math.log(1 + c * t) / math.log(2) if c else 0.0

    def blocks(node):
        for c in node[2]:
            if not isinstance(c, str) and not gone(c):
                yield from blocks(c) if c[0] in inline else [c]

    def every(node):
        yield node
        for c in blocks(node):
            yield from every(c)

    tree = _Tree(page).root
    best = max(every(tree), key=lambda n: sum(density(c) for c in blocks(n)))
    return " ".join(text(best).split())


def test_densities_against_recursion():
    pages = [h for h in pq.read_table("/root/testdata/sf0.01/pages.parquet").column("html").to_pylist() if h and "<article" in h][:200]
    nested = ["<html><body><div><div>" + P * a + "</div><div class=ad>Buy this.</div>" + SHORT * b + "</div></body></html>" for a in (1, 2, 5) for b in (0, 1)]
    assert len(pages) == 200
    for page in pages:
        assert html_text.main_text(page) == _naive(page)
    for page in nested:
        assert _naive(page) in html_text.main_text(page)


def test_rows(spark, sf_dir):
    pages = spark.createDataFrame([(1, "u", "<p>x</p>", "n"), (1, "u", "<p>x</p>", "n"), (2, None, None, None), (None, "v", "", "n")], "page_id long, url string, html string, text string")
    got = html_text.extracted(pages)
    assert sorted((r["page_id"] or 0, r["text"], r["n_chars"]) for r in got.collect()) == [(0, "", 0), (1, "x", 1), (1, "x", 1), (2, "", 0)]
    assert html_text.extracted(pages.where("false")).count() == 0
    whole = html_text.op4_text_density(spark, sf_dir)
    assert whole.count() == spark.read.parquet(f"{sf_dir}/pages.parquet").count() and whole.where("n_chars = 0").count() == 0
