import random
import re
import time
from html import unescape

import numpy as np
import pytest

from foldwright.llm import html

TREE = html.grow(html.labelled())
LONG = "A paragraph with enough words to be an article's own, which goes on for a while and ends here."

PAGES = {
    "<p>%s</p>" % LONG: LONG,
    "": "",
    None: "",
    "no markup, but enough words in a row to make a paragraph of its own that is read as the text of a page": "no markup, but enough words in a row to make a paragraph of its own that is read as the text of a page",
    f"<body><nav><ul><li><a href='/a'>Home</a><li><a href='/b'>About</a></ul></nav><article><h1>Title</h1><p>One.</p><p>{LONG}</article><footer>(c) by us</footer>": f"Title One. {LONG}",
    f"<article><p>a&amp;b &lt;c&gt; &#233;&nbsp;x<br>y <b>bo</b>ld</p>\n<script>var p='<p>no</p>'</script><style>p{{}}</style><p>{LONG}": f"a&b <c> é x y bold {LONG}",
    f"<article><div class='ad'>Buy this now and here</div><p>{LONG}</p><section class='comments'><p>First reader comment, which is long enough to look like text.</p></section></article>": LONG,
    f"<div id='cookie-notice'>We use cookies on this site and want you to agree to all of them now</div><main><p>{LONG}</p></main><aside>Other words</aside><form>Name <input> <label>Mail</label></form>": LONG,
    f"<!-- <p>no</p> --><main><p>{LONG}<p>{LONG}</main><!-- open <p>no</p>": f"{LONG} {LONG}",
    f"<main><p title='a > b'>{LONG}</p><p>cut & off &am": f"{LONG} cut & off &am",
    f"<header><p>{LONG}</p></header><article><p>{LONG} 2</p></article><div class=sidebar><p>{LONG}</p></div>": f"{LONG} 2",
}


@pytest.mark.parametrize("page", PAGES, ids=range(len(PAGES)))
def test_main_text(page):
    assert html.main_text(page, TREE) == PAGES[page]


def texts(page):
    return [t for t, _ in html.blocks(page)]


def test_unclosed_and_empty_elements_cut_nothing_behind_them():
    assert texts("<p>one <svg/> two</p><p>three</p>") == ["one two", "three"]
    assert texts("<p>one <svg a='/>' /> two</p><p>three <math /> four</p><svg>no</svg>") == ["one two", "three four"]
    for name in ("button", "select", "object", "canvas", "iframe", "template", "noscript", "svg"):
        assert texts(f"<p>one <{name} a=b> two</p><p>three</p>") == ["one two", "three"]
        assert texts(f"<p>one <{name}> two</p><p>three</p><{name}>no</{name}><p>four</p>") == ["one two", "three", "four"]
        assert texts(f"<p>one <{name}>no <b>no</b></{name.upper()} > two</p>") == ["one two"]
    for name in ("svg", "object", "template"):
        assert texts(f"<p>one <{name}>no <{name}>no</{name}> no</{name}> two</p>") == ["one two"]
    assert texts("<p>one</p><button-group><p>two</p></button-group><object-x>three</object-x><svg-icon/><p>four</p>") == ["one", "two", "three", "four"]
    assert texts("<title-x>one</title-x><p>two</p></button><p>three") == ["one", "two", "three"]
    for name in html.RAW.split():
        assert texts(f"<p>one</p><{name}>no<p>no") == ["one"]
        assert texts(f"<p>one</p><{name}>no<p>no<button></{name} x><p>two</p>") == ["one", "two"]
    assert texts("<p>one <svg><title/><style/><path d=''/>no</svg> two</p><p>three</p>") == ["one two", "three"]


def test_marks_of_the_page_are_not_the_articles():
    for page in ("<body class='has-sidebar'>%s</body>", "<html class='no-cookie'><body>%s</body></html>", "<main class='with-sidebar'>%s</main>", "<div class='has-sidebar'><main>%s</main></div>"):
        got = html.blocks(page % f"<article><p>{LONG}</p><div class='ad'>Buy this now</div></article><div class='sidebar'><p>{LONG}</p></div>")
        assert [f[-1] for _, f in got] == [0, 1, 1]
        assert html.main_text(page % f"<article><p>{LONG}</p></article><div class='sidebar'><p>{LONG} 2</p></div>", TREE) == LONG


def test_marks_that_tell_what_a_page_has_empty_nothing():
    for open_ in ("<div class='with-sidebar'>", "<article class='post comments-open'>", "<div class='related-work'>", "<div class='entry-header'>", "<article class='no-sharing has-comments'>"):
        close = f"</{open_[1:].split()[0]}>"
        for body in ("single has-sidebar", "no-header", "is-search"):
            assert html.main_text(f"<body class='{body}'>{open_}<p>{LONG}</p><p>{LONG} 2</p>{close}</body>", TREE) == f"{LONG} {LONG} 2"


def test_comments_adverts_and_hidden_text_are_left_out():
    for name in ("class='related-posts'", "class=related", "id='discussion'", "class='comment-thread'", "style='color:red; display: none'", "hidden", "class='adSlot'"):
        assert html.main_text(f"<article><p>{LONG}</p></article><div {name}><p>{LONG} 2</p></div>", TREE) == LONG
    assert html.main_text(f"<article><p>{LONG}</p></article><article class='comment'><p>{LONG} 2</p></article>", TREE) == LONG
    assert html.main_text(f"<article><p>{LONG}</p><section class='discussion'><p>{LONG} 2</p></section></article>", TREE) == f"{LONG} {LONG} 2"
    for phrase in ("<span class='ad'>Buy <span>now</span> this</span>", "<span hidden>no</span>", "<b style='visibility:hidden'>no</b>", "<a class=sponsored href=x>no</a>"):
        assert html.main_text(f"<article><p>{LONG} {phrase} more</p><p>{LONG}</p></article>", TREE) == f"{LONG} more {LONG}"
    assert html.main_text(f"<article title='the hidden truth' data-x='ad'><p>{LONG}</p></article>", TREE) == LONG
    assert html.main_text(f"<article><p>{LONG} <span class='ad'>open</p><p>{LONG}</article>", TREE) == f"{LONG} {LONG}"
    assert html.main_text(f"<article><p>{LONG} <math><mi>x</mi><mo>=</mo><mn>1</mn></math> holds</p></article>", TREE) == f"{LONG} x=1 holds"


def test_blocks_know_their_neighbours():
    got = html.blocks("<p>one two</p><p><a href=x>three four</a> five six</p><p>seven</p>")
    assert [t for t, _ in got] == ["one two", "three four five six", "seven"]
    assert got[1][1][:6] == (4, 0.5, 2, 0.0, 1, 0.0)


def test_tree_fits_its_table():
    rows = html.labelled()
    assert all(html.decide(TREE, tuple(r[:-1])) == bool(r[-1]) for r in rows)


def test_broken_and_long_pages_end():
    for page in ("<" * 50000, "<a '" * 20000, "<p>" * 20000, "<div>" * 20000 + "x", "</p>" * 20000, "<!--" * 20000, "&" * 50000, '<p a="' * 5000, "<script" * 9000):
        assert isinstance(html.main_text(page, TREE), str)


TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*+>|<(/?)([a-zA-Z][^\s/>]*+)((?>(?:[^>\"']|\"[^\"]*+\"|'[^']*+')*+))>|<[/!?a-zA-Z][^<>]*+\Z",
    re.S,
)


def test_scanner_finds_what_one_pattern_finds():
    draw, bits = random.Random(2), ["<", ">", "<a", "</p", "<p ", "'", '"', "x='", "=", " ", "/", "<!--", "-->", "<!", "<?", "é", "text", "\n", "<div class=x>"]
    for _ in range(20_000):
        page = "".join(draw.choices(bits, k=draw.randrange(25)))
        scanner, at, got = html._Scanner(page), 0, []
        while part := scanner.next(at):
            start, at, m = part
            got.append((start, at, m and m.groups()))
        assert got == [(m.start(), m.end(), m.groups() if m[2] else None) for m in TOKEN.finditer(page)], page


@pytest.mark.parametrize("bit", ["<div class=x ", "<a ", "<p x='", "<p x='>", '<p x="', "<a", "</a ", "<script></script ", "<div>", "<div></x>", "<b style=", "<p>&#0", "<!a", "<p x=\"'", "</p><p "])
def test_broken_pages_take_time_in_proportion(bit):
    for end in ("", ">", "'>", "\"'>", "<p>text"):
        start = time.time()
        html.main_text(bit * (400_000 // len(bit)) + end, TREE)
        assert time.time() - start < 15, end


def test_long_numbers_of_characters():
    assert texts("<p>a&#" + "9" * 6000 + ";b &#" + "0" * 6000 + "65; &#x" + "0" * 5000 + "42; &#233; &#99999999;") == ["a\ufffdb A B é \ufffd"]


def test_other_names_of_what_is_beside_the_article():
    for name in ("id=toc", "role=alert", "id=responses", "class=reviews", "class=paywall", "class=kommentare", "class='table-toc'"):
        assert html.main_text(f"<article><p>{LONG}</p></article><div {name}><p>{LONG} 2</p></div>", TREE) == LONG, name
    assert html.main_text(f"<article><p>{LONG}</p><fieldset>Your name <input></fieldset><p>{LONG}</p></article>", TREE) == f"{LONG} {LONG}"


def test_edges(spark):
    names = "page_id bigint, url string, html string, text string, n_chars string"
    rows = [(1, "u", f"<p>{LONG}", "a", "b"), (None, None, None, None, None), (1, "u", f"<p>{LONG}", "a", "b")]
    got = sorted((tuple(r) for r in html.extract(spark.createDataFrame(rows, names)).collect()), key=str)
    assert got == sorted([(1, "u", LONG), (None, None, ""), (1, "u", LONG)], key=str)
    assert html.extract(spark.createDataFrame([], names)).count() == 0


def test_query_returns_the_articles(spark, data):
    """The pages of the test tables hold whole documents below a title: the title, then the document, and nothing else."""
    docs = {" ".join(r["text"].split()) for r in spark.read.parquet(f"{data}/documents.parquet").collect()}
    pages = {r["page_id"]: r["html"] for r in spark.read.parquet(f"{data}/pages.parquet").collect()}
    rows = html.op5_html_extraction(spark, data).collect()
    assert len(rows) == len(pages)
    for r in rows:
        head = " ".join(unescape(re.search(r"<h1>(.*?)</h1>", pages[r["page_id"]], re.S)[1]).split())
        assert r["n_chars"] == len(r["text"]) and r["text"].startswith(f"{head} ") and r["text"][len(head) + 1 :] in docs
