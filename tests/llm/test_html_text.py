import re
from html import unescape

import pytest

from findingflow.llm.html_text import extract_text, main_text

PAR = "Some longer sentence that is clearly part of the prose of this page, again and again, with words. "


def page(body):
    return f"<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style><script>var t='</p>';</script></head><body>{body}</body></html>"


@pytest.mark.parametrize(
    "html, want",
    [
        ("", ""),
        (page(""), ""),
        (page(f"<nav><ul><li><a href='/a'>A</a><li><a href='/b'>B</a></ul></nav><!-- x --><div class='ad'>Buy {PAR}</div><article><h1>Head &amp; line</h1><p><b>Lead<br><p>One\n  two &eacute;&#233;.</p><p>{PAR}</p></article><footer>&copy; x</footer>"),
         "Head & line Lead One two éé. " + PAR.strip()),
        (page(f"<div id='menu'><a href='/'>Home</a></div><div class='post'><h2>Head</h2><p>{PAR}</p><p>Short.</p><p>{PAR * 3}</p></div><div class='comments'><p>{PAR}</p></div><div class='sidebar'>{PAR}</div>"),
         " ".join(["Head", PAR.strip(), "Short.", (PAR * 3).strip()])),
        (page(f"<header><h1>Site</h1></header><main><p>{PAR}</p><form><p>Mail me</p><input></form><p class='notice'>Cookies!<p>{PAR}</main>"), PAR.strip() + " " + PAR.strip()),
        ("plain text without tags", "plain text without tags"),
        (page(f"<article><p>a<em>b</em>c <span class='x'>d</span>e</p><section id='comments'><article><p>{PAR * 9}</p></article></section></article>"), "abc de"),
        (page(f"<div class='post social'><p>{PAR}</p><p>{PAR * 2}</p></div>"), PAR.strip() + " " + (PAR * 2).strip()),
        (page(f"<article><p>{PAR}</p><p class='search'>{PAR}</p><div class='ad'>{PAR}</div><p>{PAR}</p></article>"), " ".join([PAR.strip()] * 3)),
        (page(f"<main><p>{PAR * 9}</p><p>Short.</p><article><h2>Card</h2><p>{PAR}</p></article></main>"), f"{(PAR * 9).strip()} Short. Card {PAR.strip()}"),
        (page(f"<article><p>{PAR}</p></article><aside>{PAR}</aside><article><p>{PAR * 2}</p></article>"), f"{PAR.strip()} {(PAR * 2).strip()}"),
        (f"<html><head><title>T</title><meta name='a'><body><div class='social'><p>{PAR}</p></div>", PAR.strip()),
        (f"<title>T</title><p>{PAR}<p>x", PAR.strip() + " x"),
        (page(f"<div class='site-header'><a href='/'>Home</a> Welcome</div><div id='content'><h1>H</h1><p>{PAR * 4}</p><p class='share'>Share this</p><p>{PAR * 4}</p></div><div class='related'><a href='x'>{PAR}</a></div>"),
         f"H {(PAR * 4).strip()} Share this {(PAR * 4).strip()}"),
        (page(f"<article><p>{PAR * 30}</p></article><article><p>{PAR}</p></article>"), f"{(PAR * 30).strip()} {PAR.strip()}"),
        (page(f"<article><p>{PAR}</p><p id='notice-period'>The notice period is two months.</p><p>{PAR}</p></article>"), f"{PAR.strip()} The notice period is two months. {PAR.strip()}"),
        (page(f"<article><p>{PAR * 3}</p><h2>Sources</h2><ul>{''.join(f'<li><a href=x>Source {i}</a>' for i in range(5))}</ul></article>"), f"{(PAR * 3).strip()} Sources {' '.join(f'Source {i}' for i in range(5))}"),
    ],
)
def test_pages(html, want):
    assert main_text(html) == want


def test_deep_nesting_is_linear():
    assert main_text("<div>" * 60_000 + f"<p>{PAR}</p>" + "</span></b>" * 60_000) == PAR.strip()


def article_of(html):
    """The text of the synthetic pages' one article, by plain string work."""
    body = re.sub(r"<(/?(p|h1|h2|article|br)\b[^>]*)>", " ", re.search(r"<article>(.*)</article>", html, re.S)[1])
    return " ".join(unescape(re.sub(r"<[^>]+>", "", body)).split())


def test_whole_articles_of_the_given_pages(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    want = {r.page_id: article_of(r.html) for r in pages.collect()}
    got = {r.page_id: r.text for r in extract_text(pages).collect()}
    assert sum(got[k] == v for k, v in want.items()) == len(want)


def test_ratios_find_the_article_without_tags_that_name_it(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect()
    kept = total = 0
    for r in pages:
        want = article_of(r.html)
        plain = r.html.replace("<article>", "<div>").replace("</article>", "</div>").replace("<nav>", "<div>").replace("</nav>", "</div>").replace("<footer>", "<div>").replace("</footer>", "</div>")
        got = main_text(plain)
        total += len(want) + len(got)
        kept += 2 * len(want) if want in got else 0
    assert kept / total > 0.9


def test_frame(spark):
    rows = [(1, "u", page(f"<article><p>{PAR}</p></article>"), "clash"), (None, None, None, "clash"), (1, "u", "", "clash"), (2, "v", "<p>" + PAR * 3000, "c")]
    got = extract_text(spark.createDataFrame(rows, "page_id long, url string, html string, text string")).collect()
    assert sorted((str(r.page_id), r.n_chars) for r in got) == sorted([("1", len(PAR.strip())), ("None", 0), ("1", 0), ("2", len((PAR * 3000).strip()))])
    assert all(r.n_chars == len(r.text) for r in got)
    assert extract_text(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0
