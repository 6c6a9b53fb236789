import re
import time
from html.parser import HTMLParser

import pytest

from firnline.llm import html_text, queries

TEXT = "A long enough paragraph of plain prose without a single link in it. " * 4
WANT = TEXT.strip()


@pytest.mark.parametrize("name", ["no-sidebar", "content-sidebar-wrap", "has-header no-comments"])
@pytest.mark.parametrize("tag", ["article", "main", "div"])
def test_a_wrapper_named_like_furniture_keeps_its_text(name, tag):
    inner = f"<{tag}><p>{TEXT}</p></{tag}><div class='sidebar'><p>side text</p></div>"
    assert html_text.extract(f"<div class='x'><div class='{name}'>{inner}</div></div>") == WANT
    assert html_text.extract(f"<div id='wrap-nav'><div class='{name}'>{inner}</div></div><div class=footer>f</div>") == WANT


def test_linked_blocks_of_the_article_stay():
    refs = "".join(f"<li><a href=r{i}>Reference number {i}</a></li>" for i in range(4))
    page = f"<article><p>{TEXT}</p><ol>{refs}</ol><p>{TEXT}</p></article><div class='menu'><ul>{refs}</ul></div>"
    assert html_text.extract(page) == "\n".join([WANT, *(f"Reference number {i}" for i in range(4)), WANT])


def test_unclosed_raw_text():
    assert html_text.extract(f"<title><textarea><article><p>{TEXT}</p></article>") == WANT
    assert html_text.extract(f"<p>{TEXT}</p><script>var x = 1;") == WANT


def test_named_furniture_still_goes():
    teasers = "<article class='comment'><p>a reader says so</p></article>" * 3
    assert html_text.extract(f"<article><p>{TEXT}</p></article><div id='comments'>{teasers}</div>") == WANT


@pytest.mark.parametrize("page", [
    f"<article><h1>Title here</h1><div class='legal'><p>{TEXT}</p></div><p>last line</p></article>",
    f"<article><h1>Title here</h1><section id='search'><p>{TEXT}</p></section><p>last line</p></article>",
    f"<header>the site</header><article><header><h1>Title here</h1></header><p>{TEXT}</p><p>last line</p></article>",
    f"<form><div><h1>Title here</h1><p>{TEXT}</p><p>last line</p></div></form><div class=comments><p>{TEXT}</p></div>",
    f"<div class=notice><p>{TEXT}</p></div><article><h1>Title here</h1><p>{TEXT}</p><p>last line</p></article>",
])
def test_names_alone_take_nothing_from_the_article(page):
    assert html_text.extract(page) == f"Title here\n{WANT}\nlast line"


def test_furniture_longer_than_the_article_goes():
    more = f"<p>{TEXT}</p>" * 4
    page = f"<div><div class='post'><p>{TEXT}</p><p>{TEXT}</p></div><div class='comments'>{more}</div><div class='cookie-notice'><p>{TEXT}</p></div></div>"
    assert html_text.extract(page) == f"{WANT}\n{WANT}"
    assert html_text.extract(f"<div class='notice'><p>{TEXT}</p></div><article><p>short body text.</p></article>") == "short body text."


@pytest.mark.parametrize(
    "page",
    ["<a \"" + "<b " * 40_000, "x</i>" * 30_000, "<div>" * 30_000 + "x", '<a ">' * 30_001, "<p>" * 40_000, "<" * 99_000, "<div class=ad><p>t" * 9_000, "<!--" * 30_000, "<svg>" * 30_000, "<li><ul>" * 20_000, "<title>" * 30_000, "<p><button>" * 8_000 + "<p>a" * 8_000],
    ids=["open quote", "stray end tags", "nested", "odd quotes", "p", "lt", "named", "comments", "unseen", "lists", "raw text", "buttons"],
)
def test_bad_markup_takes_linear_time(page):
    began = time.process_time()
    html_text.extract(page)
    assert time.process_time() - began < 2.5


@pytest.mark.parametrize("page", [
    f"<h1>How it went</h1><div class='content'><p>{TEXT}</p><p>{TEXT}</p></div>",
    f"<div><h1>How it went</h1></div><div class='content'><p>{TEXT}</p><p>{TEXT}</p></div>",
    f"<div class=page><div class=top><h1>How it went</h1><span>by x</span></div><div class=row><div class='content'><p>{TEXT}</p><p>{TEXT}</p></div><div class=sidebar><h1>More</h1>s</div></div></div>",
    f"<nav><h1>Site</h1></nav><h2>How it went</h2><div><p>{TEXT}</p><p>{TEXT}</p></div><div class=footer><h1>End</h1></div>",
    f"<div class=banner><h1>Site</h1></div><h1>How it went</h1><article><p>{TEXT}</p><p>{TEXT}</p></article>",
    f"<h1><a href=/>Site</a></h1><div><h2>How it went</h2><p>{TEXT}</p><p>{TEXT}</p></div>",
])
def test_headlines_without_an_article_around_them(page):
    assert html_text.extract(page) == f"How it went\n{WANT}\n{WANT}"


@pytest.mark.parametrize("outer", ["article", "main"])
@pytest.mark.parametrize("inner", ["section class='login'", "section class='search'", "ol class='legal'", "div class='notice'", "div id='menu'"])
def test_named_sections_of_the_article_stay(outer, inner):
    tag = inner.split()[0]
    assert html_text.extract(f"<{outer}><p>{TEXT}</p><{inner}><p>{TEXT}</p></{tag}><p>{TEXT}</p></{outer}>") == "\n".join([WANT] * 3)
    for sign in ("<input name=q>", "<a href=x>all of these here</a>", "<button>go</button>"):  # forms or links speak for the name
        assert html_text.extract(f"<{outer}><p>{TEXT}</p><{inner}><p>go on</p>{sign}</{tag}><p>{TEXT}</p></{outer}>") == "\n".join([WANT] * 2)


def test_comments_and_adverts_within_the_article_go():
    for name in ("comments", "ad", "newsletter", "related"):
        assert html_text.extract(f"<main><p>{TEXT}</p><div class='{name}'><p>not of the text</p></div><p>{TEXT}</p></main>") == "\n".join([WANT] * 2)


class Brute(HTMLParser):
    """Blocks of the article element, for pages whose furniture is outside it
    or in an element of class ad."""

    def __init__(self, page):
        super().__init__()
        self.inside, self.out, self.now = False, [], []
        self.feed(page)
        self.close()
        self.end()

    def end(self):
        if text := " ".join("".join(self.now).split()):
            self.out.append(text)
        self.now = []

    def handle_starttag(self, tag, attrs):
        self.inside = self.inside or tag == "article"
        if tag in ("p", "h1", "li", "ul", "div", "article"):
            self.end()
        elif tag == "br":
            self.now.append(" ")

    def handle_endtag(self, tag):
        if tag in ("p", "h1", "li", "ul", "div", "article"):
            self.end()
        self.inside = self.inside and tag != "article"

    def handle_data(self, data):
        if self.inside:
            self.now.append(data)


def test_whole_table_by_brute_force(spark, sf):
    for r in queries.op8_main_text(spark, sf).join(spark.read.parquet(f"{sf}/pages.parquet").select("page_id", "html"), "page_id").collect():
        assert r.text == "\n".join(Brute(r.html).out), r.page_id
        assert r.n_chars == len(r.text)
        plain = re.sub(r"<(/?)(article|main)\b", r"<\1div", r.html)  # no element says where the article is
        assert html_text.extract(plain) == r.text


def test_very_long_pages_are_read_whole(spark):
    page = "<nav><a href=x>menu</a></nav><article>" + "".join(f"<p>{TEXT}{i}</p>" for i in range(20_000)) + "</article>"
    d = spark.createDataFrame([(1, "u", page)], "page_id long, url string, html string")
    text = html_text.extract_pages(d).first().text
    assert text.count("\n") == 19_999 and text.endswith("19999")
