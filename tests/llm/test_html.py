"""HTML extraction against an independent reading of generated pages, the contract's cases one by one, and linear time."""

import random
import time
from html.parser import HTMLParser

import pytest
from pyspark.sql import functions as F

from faultloom.llm import html

SKIP = {"nav", "footer", "aside", "form", "script", "style", "title"}
BLOCKS = {"p", "div", "article", "section", "ul", "li", "h1", "h2", "table", "tr", "td", "blockquote", "body", "header", "br"}


class Reader(HTMLParser):
    """The text of the <article> of a well-formed page, by the standard library's parser."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.open, self.out = [], []

    def handle_starttag(self, tag, attrs):
        if tag in BLOCKS:
            self.out.append(" ")
        if tag != "br":
            self.open.append((tag, dict(attrs).get("class", "")))

    def handle_endtag(self, tag):
        self.open.pop()
        if tag in BLOCKS:
            self.out.append(" ")

    def handle_data(self, data):
        if any(t == "article" for t, _ in self.open) and not any(t in SKIP or c in ("comments", "ad", "cookie-notice") for t, c in self.open):
            self.out.append(data)


def generated(rng):
    word = lambda: rng.choice(["alpha", "beta", "&eacute;t&eacute;", "a&amp;b", "gamma\n delta", "x &lt; y", "naïve"])
    words = lambda n: " ".join(word() for _ in range(rng.randint(1, n)))

    def inline():
        return rng.choice([words(12), f"{words(3)}<b>{words(2)}</b>{words(3)}", f'<a href="/x?a=1&b=2">{words(2)}</a> {words(5)}', f"{words(3)}<br>{words(3)}"])

    def block(depth=0):
        kind = rng.randint(0, 9 if depth < 3 else 3)
        if kind < 4:
            return f"<p>{inline()}</p>"
        if kind == 4:
            return "<ul>" + "".join(f"<li>{inline()}</li>" for _ in range(rng.randint(1, 9))) + "</ul>"
        if kind == 5:
            return "<table>" + "".join(f"<tr><td>{words(3)}</td><td>{inline()}</td></tr>" for _ in range(rng.randint(1, 4))) + "</table>"
        if kind == 6:
            return f'<div class="ad">{inline()}</div><!-- <p>no</p> -->'
        inner = "".join(block(depth + 1) for _ in range(rng.randint(1, 4)))
        return rng.choice([f"<section><h2>{words(4)}</h2>{inner}</section>", f'<div class="part-{rng.randint(1, 99)}">{inner}</div>', f"<blockquote>{inner}</blockquote>"])

    inner = f"<h1>{words(6)}</h1>" + "".join(block() for _ in range(rng.randint(2, 8)))
    body = f'<nav><ul><li><a href="/">{words(3)}</a></li></ul></nav><article class="post">{inner}</article>'
    body += f'<div class="comments"><article class="comment"><p>{words(60)}</p></article></div><aside>{words(5)}</aside><footer>{words(9)}</footer>'
    return f"<!DOCTYPE html><html><head><title>{words(3)}</title><style>p{{}}</style><script>var t='</p>';</script></head><body>{body}</body></html>"


def test_generated_pages_equal_the_standard_parser(spark):
    rng = random.Random(8)
    rows = [(i, f"http://h{i % 7}.example/{i}", generated(rng)) for i in range(200)]
    want = {}
    for i, _, page in rows:
        reader = Reader()
        reader.feed(page)
        want[i] = " ".join("".join(reader.out).split())
    out = html.extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert {r.page_id: r.text for r in out} == want
    assert all(r.n_chars == len(r.text) for r in out)


@pytest.mark.parametrize(
    ("page", "text"),
    [
        ("<ul><li>item words here</li><li>more words</li></ul>", "item words here more words"),
        ("<article><h1>T</h1><p>opens</p><ul>" + "<li>list item text</li>" * 8 + "</ul><p>ends</p></article>", "T opens " + "list item text " * 8 + "ends"),
        ("<article><h1>Head</h1><section><p>one</p></section><section><p>two</p></section></article>", "Head one two"),
        ("<main><div class=a><p>short</p></div><div class=b><p>" + "long " * 90 + "</p></div></main>", "short " + "long " * 89 + "long"),
        ("<article><p>before</p><table>" + "<tr><td>cell text</td></tr>" * 50 + "</table><p>after</p></article>", "before " + "cell text " * 50 + "after"),
        ("<div class=post><h2>Head</h2><section><p>" + "word " * 80 + "</p></section></div>", "Head " + "word " * 79 + "word"),
        ("<p title=it's>Hello</p><p>World</p>", "Hello World"),
        ('<div class="content share"><p>Body text</p></div><footer>f</footer>', "Body text"),
        ('<div class="page-with-sidebar sidebar"><article><p>Text</p></article><div class=sidebar>side</div></div>', "Text"),
        ("<table><tr><td>one<td><p>two<p>three</table>", "one two three"),
        ('<p>a<b>b</b>c <span class="ad">ad <span>x</span> y</span>d</p>', "abc d"),
        ("a < b <3 c", "a < b <3 c"),
        ("<p>whole</p><a href='cut", "whole"),
        ("<noscript><div>off</noscript><p>on</p>", "on"),
        ("<p>&eacute;&#39;&nbsp; x</p>", "é' x"),
        ("<div hidden>no</div><div style='display: none'>no</div><p>yes</p>", "yes"),
        ("<nav>only a menu</nav>", ""),
    ],
)
def test_cases_of_the_contract(page, text):
    assert html.extract(page) == text


def test_deep_and_long_pages_take_linear_time():
    def seconds(page):
        t = time.process_time()
        html.extract(page)
        return time.process_time() - t

    for make in (lambda n: "<div>" * n + "x", lambda n: "<i><div>" + "<b class=ad>" * n + "</i>" * n, lambda n: "<p>word" * n, lambda n: '<a b="' * n):
        small = max(seconds(make(4000)), 0.005)
        assert seconds(make(32_000)) < 30 * small  # eight times as much; the square would be 64
    assert html.extract("<div>" * 5000 + "deep").strip() == "deep"


def test_pages_of_a_host_vote_and_ties_are_settled(spark):
    """Pages of one host follow the path of the many; equal votes give one result in any order; all columns pass."""
    rows = [(i, "http://h.example/x", f"<div class='wrap'><div class=post-{i}><p>{'word ' * 40}</p></div><div class=x><p>tail</p></div></div>") for i in range(9)]
    rows += [(20, None, None), (20, None, None), (21, "http://h.example/z", ""), (22, "http://t.example/", "<div class=a>same</div><div class=b>size</div>")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").select("*", F.lit("c").alias("Text"), F.lit("c").alias("path"))
    got = [sorted((r.page_id, r.text) for r in html.extract_pages(d).collect()) for d in (df, df.orderBy(F.desc("page_id")).coalesce(1))]
    assert got[0] == got[1] and len(got[0]) == len(rows)
    by = dict(got[0])
    assert by[20] == by[21] == "" and by[22] == "same size" and by[0] == "word " * 40 + "tail"


def test_paths_too_large_to_broadcast(spark, monkeypatch):
    rows = [(i, f"http://h{min(i, 3)}.example/", f"<article><p>text {i}</p></article>") for i in range(60)]
    monkeypatch.setattr(html, "BROADCAST_BYTES", 0)
    out = html.extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string"))
    assert {r.page_id: r.text for r in out.collect()} == {i: f"text {i}" for i, *_ in rows}


CASES = [
    ('<article><h2 id="related-work">Related work</h2><p>Body text.</p></article>', "Related work Body text."),
    ('<article><section id="comments-on-the-method"><p>On the method.</p></section><p>More.</p></article>', "On the method. More."),
    ('<article><div class="social-impact"><p>Impact.</p></div><p>More.</p></article>', "Impact. More."),
    ('<article><p class="menu-price">Soup 4.50</p><p class="share-price">Up 3</p></article>', "Soup 4.50 Up 3"),
    ('<article><figure class="banner-image"><figcaption>A caption.</figcaption></figure><p>Text.</p></article>', "A caption. Text."),
    ('<article><p>Text.</p><ins class="adsbygoogle">Buy now</ins><div class="related-posts">See also</div><section id="comments"><p>A reader says.</p></section></article>', "Text."),
    ('<article><p>Text.</p><div class="share-buttons">Tweet</div><ul class="social-links"><li>Site</li></ul></article>', "Text."),
]


@pytest.mark.parametrize(("page", "want"), CASES)
def test_names_that_speak_of_the_subject_stay(page, want):
    assert html.extract(f"<html><body><nav>menu</nav>{page}<footer>foot</footer></body></html>", None) == want


def test_titles_and_leads_beside_the_content_stay(spark):
    """Hosts without an <article>: a short title or lead in a container of its own is part of what is told."""
    body = "".join(f"<p>{'words of the long body ' * 60}{k}</p>" for k in range(3))
    text = " ".join(f"{'words of the long body ' * 60}{k}" for k in range(3))
    one = [f'<body><nav>menu</nav><div class="page"><div class="title"><h1>The Title {i}</h1></div><div class="content">{body}</div></div><footer>f</footer></body>' for i in range(6)]
    two = [f'<body><div class="lead">A short lead {i}.</div><div class="content">{body}</div><div class="sidebar">side</div></body>' for i in range(6)]
    rows = [(i, f"http://{h}.org/{i}", p) for h, pages in (("a", one), ("b", two)) for i, p in enumerate(pages)]
    got = {(r["url"]): r["text"] for r in html.extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    want = {f"http://a.org/{i}": f"The Title {i} {text}" for i in range(6)} | {f"http://b.org/{i}": f"A short lead {i}. {text}" for i in range(6)}
    assert got == want
