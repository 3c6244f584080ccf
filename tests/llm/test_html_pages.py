"""HTML extraction on pages with known main text."""

from __future__ import annotations

import time
from collections import Counter

import pytest

from riskweave.llm.html_text import extract, lines_of, main_text, stretches

TEXT = [f"Paragraph {k} of the text has more than enough words to be a part of the main text of a page, and it has a second clause too." for k in range(8)]
ADVERT = "<div class=ad>Buy this</div><div class=ad>Buy that</div><div class=ad>Buy more</div><div class=ad>Buy all</div>"
CARDS = "".join(f"<article><h3><a href=/{k}>Another story, number {k}</a></h3><p>A teaser of the other story.</p></article>" for k in range(12))
ALL = " ".join(TEXT)


def paragraphs(texts) -> str:
    return "".join(f"<p>{t}</p>" for t in texts)


@pytest.mark.parametrize(
    ("page", "want"),
    [
        (f"<body><article>{paragraphs(TEXT)}</article></body>", ALL),
        (f"<body><div>{paragraphs(TEXT)}</div><div>{CARDS}</div></body>", ALL),
        (f"<body><div>{CARDS}</div><div>{paragraphs(TEXT)}</div></body>", ALL),
        (f"<body><div>{paragraphs(TEXT[:4])}{ADVERT}{paragraphs(TEXT[4:])}</div></body>", ALL),
        (f"<body><div>{ADVERT.join(paragraphs([t]) for t in TEXT)}</div><div>{CARDS}</div></body>", ALL),
        (f"<body><div>{paragraphs(TEXT)}{ADVERT}<p>End.</p></div><div>{CARDS}</div></body>", f"{ALL} End."),
        (f"<body><article>{paragraphs(TEXT[:4])}{ADVERT}{paragraphs(TEXT[4:])}</article></body>", ALL),
        (f"<body><article>{paragraphs(TEXT[:4])}</article>{ADVERT}<div>{paragraphs(TEXT[4:])}</div></body>", ALL),
        (f"<body><article>{paragraphs(TEXT)}</article>{ADVERT}<div><p>A short line beside it.</p></div></body>", ALL),
        (f"<body><article>{paragraphs(TEXT[:7])}</article><article>{paragraphs(TEXT[7:])}</article></body>", ALL),
    ],
)
def test_main_text_is_whole(page, want):
    assert main_text(page) == want


@pytest.mark.parametrize(
    ("page", "want"),
    [
        (f"<head><title>T</title><body><p>{TEXT[0]}", TEXT[0]),
        (f"<head><title>T<body><p>{TEXT[0]}", TEXT[0]),
        (f"<p>{TEXT[0]}</p><svg width=1 /><p>{TEXT[1]}</p><svg><svg><text>x</text></svg><text>y</text></svg><p>{TEXT[2]}</p>", " ".join(TEXT[:3])),
        (f"<p>{TEXT[0]}</p><svg width=1><p>{TEXT[1]}</p>", " ".join(TEXT[:2])),
        (f"<div><p class=ad>Ad<p>{TEXT[0]}<p>{TEXT[1]}</div>", " ".join(TEXT[:2])),
        (f"<ul><li class=ad>Ad<li>{TEXT[0]}<ul><li>{TEXT[1]}</ul></ul>", " ".join(TEXT[:2])),
        (f"<dl><dt class=ad>Ad<dd>{TEXT[0]}</dl><table><tr class=ad><td>Ad<tr><td class=ad>Ad<td>{TEXT[1]}</table>", " ".join(TEXT[:2])),
        (f"<article><section id=related-work><h2 id=search-api>Search</h2><p class=share-of-text>{TEXT[0]}</p></section><div class='x share'>Share</div></article>", f"Search {TEXT[0]}"),
        (f"<div><section id=related-work><h2 id=search>Search</h2><p>{TEXT[0]}</p></section><section id=comments>No</section></div>", f"Search {TEXT[0]}"),
        (f"<p>{TEXT[0]}</p><script>var a = 1;<p>no</p>", TEXT[0]),
    ],
)
def test_markup_loses_no_text(page, want):
    assert main_text(page) == want


@pytest.mark.parametrize(
    ("page", "want"),
    [
        (f"<div class='layout no-sidebar'><article>{paragraphs(TEXT)}</article></div>", ALL),
        (f"<div class='layout no-sidebar'><div>{paragraphs(TEXT)}</div></div>", ALL),
        (f"<div class='main-menu-layout'><main>{paragraphs(TEXT)}</main></div><div class=main-menu><p>{TEXT[0]}</p></div>", ALL),
        (f"<article><div class='widget-text'>{paragraphs(TEXT)}</div></article>", ALL),
        (f"<div>{paragraphs(TEXT[:4])}<div class=promo><p>a b</p><p>c</p><p>d</p><p>e</p></div>{paragraphs(TEXT[4:])}</div>", ALL),
        (f"<div>{paragraphs(TEXT[:4])}<p><a href=x>{TEXT[4]}</a></p>{paragraphs(TEXT[5:])}</div>", ALL),
        (f"<article>{paragraphs(TEXT[:7])}<section class='article-footer-notes'><p>{TEXT[7]}</p></section></article>", ALL),
        (f"<article>{paragraphs(TEXT)}<footer><p>Posted by someone.</p></footer></article>", ALL),
        (f"<div><ul><li><a href=1>One</a><li><a href=2>Two</a></ul>{paragraphs(TEXT)}<p><a href=3>More</a></p></div>", ALL),
    ],
)
def test_marks_say_what_is_beside(page, want):
    assert main_text(page) == want


FURNITURE = ["class=comment-list", "class=post-comments", "class=reader-comments", "id=comments", "class=newsletter-signup", "class=ad-slot", "class='x share-buttons'", "class=cookie-banner", "class=sidebar-left", "class=site-footer", "class=related-posts", "id=comments-section", "role=navigation", "hidden", "aria-hidden=true", "style='color:red;display: none'"]


@pytest.mark.parametrize("mark", FURNITURE)
@pytest.mark.parametrize("tag", ["div", "section"])
def test_furniture_goes_inside_articles_and_beside_them(tag, mark):
    more = f"<{tag} {mark}><p>{TEXT[0]}</p><p>Another line of it.</p></{tag}>"
    assert main_text(f"<body><article>{paragraphs(TEXT[1:4])}{more}{paragraphs(TEXT[4:])}</article></body>") == " ".join(TEXT[1:])
    assert main_text(f"<body><article>{paragraphs(TEXT[1:])}</article>{more}</body>") == " ".join(TEXT[1:])
    assert main_text(f"<body>{more}<div>{paragraphs(TEXT[1:])}</div></body>") == " ".join(TEXT[1:])


@pytest.mark.parametrize(
    "page",
    [
        f"<article data-title='the hidden gem'>{paragraphs(TEXT)}</article>",
        f"<div data-x='a hidden gem'>{paragraphs(TEXT)}</div>",
        f"<article data-id='search' data-class=ad>{paragraphs(TEXT)}</article>",
        f"<article title='class=ad id=menu'>{paragraphs(TEXT)}</article>",
        f"<nav data-base=/x/><p>{TEXT[0]}</p><a href=/>Home</a></nav><article>{paragraphs(TEXT)}</article>",
        f"<article>{paragraphs(TEXT)}</article><aside data-u=/a/><p>{TEXT[0]}</p></aside>",
        f"<div class='content-sidebar-wrap'><main>{paragraphs(TEXT)}</main></div>",
        f"<article>{paragraphs(TEXT)}</article><ol class=comment-list>" + "".join(f"<li><article class=comment-body><p>{t} I say.</p></article>" for t in TEXT * 3) + "</ol>",
        f"<article>{paragraphs(TEXT)}<div class=related-posts>{CARDS}</div></article>",
        f"<article>{paragraphs(TEXT)}</article><div class=related-posts>{CARDS}</div>",
        f"<article/>{paragraphs(TEXT)}</article>",
    ],
)
def test_attributes_are_names_and_values(page):
    assert main_text(page) == ALL


@pytest.mark.parametrize("inline", ["<button>Press me</button>", "<span class='ad'>Buy now</span>", "<span hidden>Not shown</span>", "<label for=x>A label</label>", "<b class=share-buttons>Share <i>it</i></b>", "<span class='share'>share"])
def test_inline_elements_lose_their_own_text_only(inline):
    for kind in ("article", "div"):
        assert main_text(f"<{kind}><p>{TEXT[0]} {inline}</p>{paragraphs(TEXT[1:])}</{kind}>") == ALL


@pytest.mark.parametrize("piece", ["<div class='x-ad'><article></article>", "<div class='x-ad'>", "<article class=x-menu><p>", "<div class=ad><article>x</article></div>", "<span class=share>", "<a b='", "<svg a=/>", "<p =/="])
def test_marks_and_attributes_take_linear_time(piece):
    page = piece * (300_000 // len(piece))
    began = time.process_time()
    main_text(page)
    assert time.process_time() - began < 4


@pytest.mark.parametrize("tag", ["p", "div", "b", "li", "td", "article"])
def test_unclosed_tags_take_linear_time(tag):
    n = 100_000
    began = time.process_time()
    assert main_text(f"<{tag}>" * n + "x" + f"</{tag}>" * (n // 2) + "</i>" * n).split() == ["x"]
    assert time.process_time() - began < 8


def test_surge_and_dive_decide_on_every_page(spark, sf):
    """Without its windows no page of the table has a text, and a window wider than the page leaves nothing out."""
    pages = [r["html"] for r in spark.read.parquet(f"{sf}/pages.parquet").collect()]
    lines = [lines_of(h) for h in pages]
    cut = [stretches([x.weight for x in page]) for page in lines]
    assert all(cut) and sum(sum(b - a for a, b in s) < len(page) for s, page in zip(cut, lines)) > len(pages) / 2
    for h, s, page in zip(pages, cut, lines):
        inside = {i for a, b in s for i in range(a, b)}
        assert set(main_text(h).split()) <= {w for i in inside for w in page[i].text.split()}


def test_pages_that_repeat_or_lack_ids(spark):
    page = f"<article>{paragraphs(TEXT)}</article>"
    rows = [(None, None, page), (1, "u", page), (1, "u", page), (1, "v", None), (2, "w", f"<div>{paragraphs(TEXT * 4000)}</div>")]
    found = extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    want = Counter([(None, None, ALL), (1, "u", ALL), (1, "u", ALL), (1, "v", ""), (2, "w", " ".join(TEXT * 4000))])
    assert Counter((r["page_id"], r["url"], r["text"]) for r in found) == want
